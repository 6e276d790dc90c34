"""Operator 1: main text of web pages by consensus host paths.

One pass cuts every page into text blocks under a tree of elements. Menus, headers, footers, sidebars,
forms and the like are told by tag and role. Class and id names only support: an element other than a
heading (a paragraph only by the words of notices and adverts) is suspected if a whole name consists of such words (``cookie-notice``, but not
``related-work``), and cleared again if it holds most of the page's unlinked text, unless its children
repeat one shape as reader comments do; elements of one shape that each offer a reply are comments
whatever their names. A container is scored by the text of the blocks below it, less what is linked. The
page's choice is the deepest container with ``NEARLY`` of the best score, widened to its parent while that
adds headings and prose, so that headline and lead stay. Its vote is a hash of its path of tags and class
names (those that look generated are left out).

Spark adds the votes by host and path; the ``RANKS`` first paths of a host go back to its pages' blocks
in a join that Spark broadcasts or shuffles by its size - no html is shuffled or read again. A page's text
comes from all elements of the first of these paths that hold ``ENOUGH`` of its own choice's score, or
else from its own choice.

Time and memory are linear in the page, however deep. Defined cases: null and empty html give an empty
text; null or odd URLs share the empty host; repeated rows get a row each; cut-off pages end where they
end, open comments and tags drop the rest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm.shared import materialize

NEARLY = 0.9
RANKS = 5
#: What the host's path must hold of the score of the page's own choice.
ENOUGH = 0.5
#: A suspected element is cleared if it holds this many times what articles, main parts and headlines hold outside of it.
MOSTLY = 8
#: A path needs this share of its host's votes to overrule a page's own.
LEAST_SHARE = 0.05
#: Elements by kind.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style svg template textarea title select option datalist audio video annotation annotation-xml".split())
UNWANTED = frozenset("aside button dialog footer form header label menu nav".split())
UNWANTED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
UNWANTED_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion discussions disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification notifications pager pagination paywall popup promo promos promoted promotion recommended related replies reply responses share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments discussion discussions disqus replies reply responses".split())
#: Words that may stand beside these in a name.
NEUTRAL_WORDS = frozenset("area articles bar block bottom box buttons card cards col column container content footer form group holder inner item items left link links list main module outer page panel policy post posts reader readers right row section site slot stories thread top user users wrap wrapper".split())
REPLIES = frozenset("reply répondre antworten responder rispondi responde".split())
#: Elements that no class name removes.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
NEVER_SUSPECT = frozenset("html body main h1 h2 h3 h4 h5 h6 blockquote pre td th tr tbody".split())
#: A paragraph is suspected only if its name has one of these.
NOTICE_WORDS = frozenset("ad ads advert advertisement adverts advertising consent cookie cookies gdpr newsletter notice notices notification notifications paywall promo sponsored subscribe subscription".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag that ends an open element of these kinds first, up to the element that bounds the search.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: What stands after an attribute's name: a quote opens a string only right after the sign.
VALUE = r"\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\s>=]++|{VALUE}|\s++)*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
WORDS = re.compile(r"[a-z]+")
NAME_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
#: Names that a build step makes.
GENERATED = re.compile(r"\d|^(css|sc|jsx|jss|emotion|styled?|svelte)-|^[^aeiouy]{4,}$")
ROOT = 0


def words_of(name: str) -> list[str]:
    return [w for part in NAME_PARTS.split(name) for w in WORDS.findall(part.lower())]


def suspicious(name: str) -> tuple[bool, bool]:
    """Whether a class or id name consists of unwanted words, and of those of comments."""
    words = words_of(name)
    if len(words) == 1 and words[0] not in UNWANTED_WORDS:  # commentlist
        words = next(([x, words[0][len(x) :]] for x in sorted(UNWANTED_WORDS, key=len, reverse=True) if len(x) > 3 and words[0].startswith(x) and words[0][len(x) :] in NEUTRAL_WORDS), words)
    bad = any(w in UNWANTED_WORDS for w in words) and all(w in UNWANTED_WORDS or w in NEUTRAL_WORDS for w in words)
    return bad, bad and any(w in COMMENT_WORDS for w in words)




class Page:
    """Blocks of text and the elements above them; elements and blocks lie in the order of the page."""

    def __init__(self, html: str):
        self.parent, self.path, self.tag = [-1], [ROOT], [""]
        #: 1: unwanted by tag, role or attribute; 2: suspected by name; 3: suspected comments
        self.flag = [0]
        #: per block: element, text, linked characters, whether a heading
        self.owner: list[int] = []
        self.texts: list[str] = []
        self.links: list[int] = []
        self.heading: list[bool] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._read(html)
        self._judge()

    def _open(self, parent: int, tag: str, names: list[str], flag: int) -> int:
        stable = sorted({n for n in names if not GENERATED.search(n)})
        key = (self.path[parent], tag + "".join("." + n for n in stable))
        path = self._paths.get(key)
        if path is None:
            path = self._paths[key] = int.from_bytes(blake2b(f"{key[0]}/{key[1]}".encode(), digest_size=8).digest(), "little", signed=True)
        self.parent.append(parent)
        self.path.append(path)
        self.tag.append(tag)
        self.flag.append(flag)
        return len(self.parent) - 1

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]
        count: dict[str, int] = {}
        pieces: list[str] = []
        aside: list[tuple[int, str]] = []  # texts of unwanted inline elements within the block of pieces
        links, linked, heading, owner = 0, 0, False, 0
        special = {0: 0}  # flagged ancestors of each element, itself included

        def flush():
            nonlocal links, heading
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                if text:
                    self.owner.append(owner)
                    self.texts.append(text)
                    self.links.append(min(links, len(text)))
                    self.heading.append(heading)
                pieces.clear()
                for k, text in aside:
                    self.owner.append(k)
                    self.texts.append(text)
                    self.links.append(0)
                    self.heading.append(False)
                aside.clear()
            links, heading = 0, False

        def take(text: str) -> None:
            nonlocal owner, links, heading
            # the innermost flagged inline element counts: its text is a block of its own;
            # one that is unwanted for sure doesn't break the block around it
            top = stack[-1][1]
            if pieces and special[top] != special[owner]:
                if special[top] > special[owner] and self.flag[top] == 1:
                    if text := " ".join(unescape(text).split()):
                        aside.append((top, text))
                    return
                flush()
            if not pieces:
                if text.isspace():
                    return
                owner = top
            pieces.append(text)
            if linked:
                links += len(text)
            heading = heading or any(t in HEADINGS for t, _ in stack[-3:])

        def cut(k: int) -> None:
            nonlocal linked
            for t, _ in stack[k:]:
                linked -= t == "a"
                count[t] -= 1
            del stack[k:]

        at, end = 0, len(html)
        while at < end:
            m = TOKEN.search(html, at)
            if m is None:
                take(html[at:])
                break
            if m.start() > at:
                take(html[at : m.start()])
            at = m.end()
            close, tag, rest = m[1], m[2], m[3]
            if not tag:
                continue
            tag = tag.lower()
            if close:
                if tag in BLOCKS:
                    flush()
                if count.get(tag, 0):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            cut(k)
                            break
                        if stack[k][0] in BLOCKS and tag not in BLOCKS:
                            break
                continue
            if tag in RAW:
                if not rest.endswith("/"):
                    found = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                    at = found.end() if found else end
                if pieces:
                    take(" ")
                continue
            if tag == "br":
                if pieces:
                    take(" ")
                continue
            if tag in BLOCKS:
                flush()
                if count.get("p", 0):
                    for k in range(len(stack) - 1, 0, -1):  # an open paragraph ends here
                        if stack[k][0] == "p":
                            cut(k)
                            break
                        if stack[k][0] in BLOCKS:
                            break
                if tag in CLOSES:
                    ends, bounds = CLOSES[tag]
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in bounds:
                            break
                        if stack[k][0] in ends:
                            cut(k)
                            break
                        if not any(count.get(x, 0) for x in ends):
                            break
            if tag in VOID or rest.endswith("/") and tag not in BLOCKS:
                continue
            parent = stack[-1][1]
            names: list[str] = []
            flag = int(tag in UNWANTED)
            if rest and not rest.isspace():
                for x in ATTRIBUTE.finditer(rest):
                    key, value = x[1].lower(), x[2] or x[3] or x[4] or ""
                    if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                        flag = 1
                    elif key == "role":
                        flag = 1 if value.lower() in UNWANTED_ROLES else flag
                    elif key in ("class", "id"):
                        if key == "class":
                            names += value.split()
                        if flag != 1 and tag not in NEVER_SUSPECT:
                            for name in value.split():
                                bad, comments = suspicious(name)
                                if tag == "p" and not NOTICE_WORDS.intersection(words_of(name)):
                                    continue
                                flag = max(flag, 3 if comments else 2 if bad else 0)
            if tag in ("html", "body"):
                flag = 0
            if tag in BLOCKS or flag:
                k = self._open(parent, tag, names, flag)
                special[k] = special[parent] + (flag > 0)
                stack.append((tag, k))
            else:
                stack.append((tag, parent))
                linked += tag == "a"
            count[tag] = count.get(tag, 0) + 1
        flush()

    def _judge(self) -> None:
        parent, n = self.parent, len(self.parent)
        self._find_replies()
        # what each element holds, unlinked, outside of elements that are unwanted for sure
        if "form" in self.tag:  # some sites wrap the whole page in one
            whole = [0.0] * n
            for k, text, linked in zip(self.owner, self.texts, self.links, strict=True):
                whole[k] += len(text) - linked
            for k in range(n - 1, 0, -1):
                whole[parent[k]] += whole[k]
            for k in range(1, n):
                if self.tag[k] == "form" and 2 * whole[k] > whole[0]:
                    self.flag[k] = 0
        plain, marked = [0.0] * n, [0.0] * n
        in_article = [False] * n
        for k in range(1, n):
            in_article[k] = in_article[parent[k]] or self.tag[k] in ("article", "main", "h1")
        for k, text, linked in zip(self.owner, self.texts, self.links, strict=True):
            plain[k] += len(text) - linked
            marked[k] += in_article[k] * (len(text) - linked)
        shapes: dict[tuple[int, int], int] = {}
        repeated = set()
        for k in range(n - 1, 0, -1):
            if self.flag[k] == 1:
                plain[k] = marked[k] = 0.0
            plain[parent[k]] += plain[k]
            marked[parent[k]] += marked[k]
            shape = (parent[k], self.path[k])
            shapes[shape] = shapes.get(shape, 0) + 1
            if shapes[shape] >= 2 and (self.tag[k] in ("li", "dd") or self.tag[k] not in PROSE):
                repeated.add(parent[k])
        for k in range(1, n):
            # most of the page, and little that is marked as the article elsewhere
            if self.flag[k] >= 2 and 2 * plain[k] > plain[0] and plain[k] > MOSTLY * (marked[0] - marked[k]) and not (self.flag[k] == 3 and (k in repeated or parent[k] in repeated)):
                self.flag[k] = 0
        # unwanted elements above, itself included; and those that aren't headers
        self.inside, self.inside_h = [0] * n, [0] * n
        for k in range(1, n):
            bad = self.flag[k] > 0
            self.inside[k] = self.inside[parent[k]] + bad
            self.inside_h[k] = self.inside_h[parent[k]] + (bad and self.tag[k] != "header")
        # scores, prose among them, and the blocks below, bottom-up
        self.score, prose = [0.0] * n, [0.0] * n
        self.lo, self.hi = [len(self.texts)] * n, [0] * n
        for i, (k, text, linked) in enumerate(zip(self.owner, self.texts, self.links, strict=True)):
            worth = (len(text) - 2.0 * linked) * 0.2 ** self.inside[k]
            self.score[k] += worth
            if self.tag[k] in PROSE:
                prose[k] += worth
            self.lo[k], self.hi[k] = min(self.lo[k], i), i + 1
        for k in range(n - 1, 0, -1):
            p = parent[k]
            if self.inside[k] == self.inside[p]:
                self.score[p] += self.score[k]
                prose[p] += prose[k]
            self.lo[p], self.hi[p] = min(self.lo[p], self.lo[k]), max(self.hi[p], self.hi[k])
        self.prose = prose

    def _find_replies(self) -> None:
        """Flag elements of one shape, side by side, that each offer a reply."""
        seen: dict[tuple[int, int], set[int]] = {}
        for k, text in zip(self.owner, self.texts, strict=True):
            if len(text) > 12 or text.lower() not in REPLIES:
                continue
            for _ in range(6):
                if k <= 0:
                    break
                seen.setdefault((self.parent[k], self.path[k]), set()).add(k)
                k = self.parent[k]
        for found in seen.values():
            if len(found) >= 2:
                for k in found:
                    if self.tag[k] not in ("html", "body", "main"):
                        self.flag[k] = 1

    def choice(self) -> int:
        """The deepest container with nearly the best score, widened while its parent adds headings and prose."""
        n = len(self.parent)
        able = [k for k in range(n) if self.tag[k] in CONTAINERS or k == 0]
        most = max(self.score[k] for k in able)
        if most <= 0:
            return 0
        k = max(k for k in able if self.score[k] >= NEARLY * most)
        while self.tag[k] not in ("article", "main", "body", "") and (p := self.parent[k]) > 0 and self.tag[p] not in ("body", "html") and self.inside[p] == self.inside[k]:
            more = self.score[p] - self.score[k]
            if more < 0 or more > 0 and self.prose[p] - self.prose[k] < 0.8 * more:
                break
            if more > self.score[k]:
                break
            k = p
        return k

    def text(self, path: int) -> str:
        """The blocks of all elements of that path, without those in unwanted elements below them; of unwanted headers, headings stay."""
        rows = [(self.lo[k], self.hi[k], self.inside[k], self.inside_h[k]) for k in range(len(self.parent)) if self.path[k] == path and self.hi[k] > self.lo[k]]
        return assembled(self.texts, [self.inside[k] for k in self.owner], self.alternatives(), rows)

    def alternatives(self) -> list[int]:
        """Per block: the unwanted elements above that aren't headers, for headings; else -1."""
        return [self.inside_h[k] if h else -1 for k, h in zip(self.owner, self.heading, strict=True)]


def assembled(texts: list[str], inside, others, rows) -> str:
    """The texts within one of the rows (lo, hi, inside, inside without headers) and as wanted as it, by line."""
    inside, others = np.asarray(inside, np.int64), np.asarray(others, np.int64)
    keep = np.zeros(len(texts), bool)
    last = 0
    for lo, hi, own, own_h in sorted(rows, key=lambda r: (r[0], -r[1])):
        lo = max(lo, last)  # an element within the one before has been taken with it
        if lo < hi:
            keep[lo:hi] |= (inside[lo:hi] == own) | (others[lo:hi] == own_h)
            last = hi
    return "\n".join(texts[i] for i in np.flatnonzero(keep))


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


#: What one parse leaves of a page. candidates: per path of a container its score, and per element of it the blocks below and its place.
PARSED = (
    "page_id long, url string, host string, own long, own_score double, texts array<string>, inside array<int>, others array<int>, "
    "candidates array<struct<path: long, score: double, lo: int, hi: int, inside: int, inside_h: int>>"
)


def parsed(pages: DataFrame) -> DataFrame:
    """Each page's blocks, containers and own choice."""
    candidate = pa.struct([("path", pa.int64()), ("score", pa.float64()), ("lo", pa.int32()), ("hi", pa.int32()), ("inside", pa.int32()), ("inside_h", pa.int32())])

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                own, own_score, texts, inside, others, candidates = [], [], [], [], [], []
                for html in part.column("html"):
                    page = Page(html.as_py() or "")
                    k = page.choice()
                    own.append(page.path[k])
                    own_score.append(page.score[k])
                    texts.append(page.texts)
                    inside.append([page.inside[j] for j in page.owner])
                    others.append(page.alternatives())
                    able = [j for j in range(len(page.parent)) if page.hi[j] > page.lo[j] and (page.score[j] > 0 and page.tag[j] in CONTAINERS or page.path[j] == page.path[k])]
                    candidates.append([{"path": page.path[j], "score": page.score[j], "lo": page.lo[j], "hi": page.hi[j], "inside": page.inside[j], "inside_h": page.inside_h[j]} for j in able])
                yield pa.record_batch({
                    "page_id": part.column("page_id").cast(pa.int64()), "url": part.column("url"), "host": part.column("host"), "own": pa.array(own, pa.int64()), "own_score": pa.array(own_score, pa.float64()), "texts": pa.array(texts, pa.list_(pa.string())),
                    "inside": pa.array(inside, pa.list_(pa.int32())), "others": pa.array(others, pa.list_(pa.int32())), "candidates": pa.array(candidates, pa.list_(candidate)),
                })

    return pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).mapInArrow(rows, PARSED)


def winners(read: DataFrame) -> DataFrame:
    """host, paths: those with the most votes and ``LEAST_SHARE`` of all, in order. Both counts are added up by tasks first, and tasks leave each host's first paths only."""
    voted = read.where("own_score > 0").groupBy("host", F.col("own").alias("path")).agg(F.count("*").alias("votes"))
    total = voted.groupBy(F.col("host").alias("of")).agg(F.sum("votes").alias("total"))
    first = voted.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))).where(F.col("rank") <= RANKS)
    kept = first.join(total, F.col("host") == F.col("of")).where(F.col("votes") >= LEAST_SHARE * F.col("total"))
    return kept.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path (the hash of the path that the text is from), text, n_chars."""

    def rows(batches):
        for batch in batches:
            paths, texts = [], []
            for own, own_score, blocks, inside, others, candidates, ranked in zip(*(batch.column(n).to_pylist() for n in ("own", "own_score", "texts", "inside", "others", "candidates", "paths")), strict=True):
                score: dict[int, float] = {}
                for c in candidates:
                    score[c["path"]] = score.get(c["path"], 0.0) + c["score"]
                path = next((p for p in ranked or () if score.get(p, 0.0) > 0 and score[p] >= ENOUGH * own_score), own)
                texts.append(assembled(blocks, inside, others, [(c["lo"], c["hi"], c["inside"], c["inside_h"]) for c in candidates if c["path"] == path]))
                paths.append(path)
            yield pa.record_batch([*(batch.column(n) for n in ("page_id", "url", "host")), pa.array(paths, pa.int64()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "host", "path", "text", "n_chars"])

    read = materialize(parsed(pages), "page-blocks")
    chosen = materialize(winners(read), "host-paths").select(F.col("host").alias("of"), "paths")
    return read.join(chosen, F.col("host") == F.col("of"), "left").drop("of").mapInArrow(rows, "page_id long, url string, host string, path long, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op1_html_text": op1_html_text}
