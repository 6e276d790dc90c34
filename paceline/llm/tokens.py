"""Token ids by the tokenizers library, with a bounded cache of words.

The tokenizer of ``word_bpe_49k.json`` drops white space and never joins text across it, so a text's
ids are its words' ids in order. That holds only for this kind of tokenizer; ``words_apart`` checks it
in the file's own description, and other tokenizers encode whole texts.
"""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np

#: Words kept per Python worker, in two generations of which the older one goes when the newer is full.
CACHE_WORDS = 1_000_000
#: Longer words are encoded but not kept.
CACHE_CHARS = 40
#: Marks that the pre-tokenizer always parts from letters before them.
MARKS = ".,;:!?#$%&*|)"


def byte_letters() -> list[str]:
    """The letters that byte-level pre-tokenizers write for bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


BYTE_LETTERS = byte_letters()


def words_apart(path: str) -> bool:
    """Whether white space always ends a token and leaves none itself."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = json.dumps(spec.get("pre_tokenizer"))
    return spec["model"].get("end_of_word_suffix") == "</w>" and '"Removed"' in pre and "ByteLevel" in pre and '"add_prefix_space": false' in pre


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.apart = words_apart(path)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, word: str) -> bytes:
        """Ids of one word of lower-case Latin-1 letters, which normalizer and pre-tokenizer would leave as it is."""
        if not word.isascii():
            word = "".join([BYTE_LETTERS[b] for b in word.encode()])
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that aren't in the cache; those of letters with marks after them come from both parts."""
        if len(self.cache) > CACHE_WORDS // 2:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        found: dict[str, bytes] = {}
        parts: dict[str, tuple[str, str]] = {}
        wanted: dict[str, None] = {}
        for w in words:
            if w in cache or w in found or w in parts:
                continue
            if (x := older.get(w)) is not None:
                found[w] = x
                continue
            core = w.rstrip(MARKS)
            if core.isalpha() and max(core) < "\u0100":
                parts[w] = low, tail = core.lower(), w[len(core) :]
                for x in (low, tail):
                    if x not in cache and x not in found:
                        if (y := older.get(x)) is not None:
                            found[x] = y
                        elif x is low:
                            found[x] = self._encode_letters(x)
                        else:
                            wanted[x] = None
            else:
                wanted[w] = None
        wanted = list(wanted)
        found.update(zip(wanted, self._encode(wanted), strict=True))
        for w, (low, tail) in parts.items():
            found[w] = (found[low] if low in found else cache[low]) + (found[tail] if tail in found else cache[tail])
        cache.update((w, x) for w, x in found.items() if len(w) <= CACHE_CHARS)
        return found

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text, as unsigned 32-bit integers."""
        if not self.apart:
            return np.frombuffer(self._encode([text])[0], np.uint32)
        words = text.replace("\n", " ").split(" ")
        try:
            cache = self.cache
            return np.frombuffer(b"".join([cache[w] for w in words]), np.uint32)
        except KeyError:
            found = self._learn(words)
            cache, older = self.cache, self.older
            return np.frombuffer(b"".join([found[w] if w in found else cache[w] if w in cache else older[w] for w in words]), np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
