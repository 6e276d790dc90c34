"""Operator 6: URL rules by host-suffix and path-prefix expressions.

Each URL is expanded into (host suffix + path prefix) expressions; these meet the rules by an equi-join
on the first four bytes of their SHA-256, and the full digest then confirms a match. Of a URL's
matching rules the longest wins; of equally long ones that with the longer host, then a blocking one.
Only as many host labels and path lengths are expanded as some rule has (a number of distinct lengths,
not of rules). The rules are small or large: Spark broadcasts them or shuffles by its own size check.

Defined cases: null URLs and those without ``://`` have an empty host and path, match nothing and get
the default verdict; repeated rows are judged one by one; rules with a null part are ignored, repeated rules count once; no rules means the default for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.shared import unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"
#: Fixed values: (verdict, host, path) of the registered query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
RULE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("verdict", "host", "path")])


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """urls with host, path, rule (null if none fits) and verdict added."""
    r = rules.where("host is not null and path is not null and verdict is not null").select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path")
    # of one expression, the blocking rule is the first
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict")).withColumn("rule", F.concat("host", "path"))
    shape = r.select(F.size(F.split("host", r"\.", -1)).alias("labels"), F.length("path").alias("chars")).distinct()
    counted = shape.agg(F.collect_set("labels"), F.collect_set("chars")).first()  # distinct lengths only
    labels, chars = (", ".join(str(x) for x in sorted(c)) for c in counted)
    if not labels:
        kept = [urls[c] for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
        return urls.select(*kept, host_of(urls[url]).alias("host"), path_of(urls[url]).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = r.select("rule_verdict", "rule", F.struct(F.length("rule").alias("len"), F.length("host").alias("host_len"), F.col("rule_verdict").alias("v")).alias("rank"), F.sha2(F.concat_ws("\x00", "host", "path"), 256).alias("rule_digest"))
    # names of our own live in a table of its own, so they never meet the caller's
    one_each = urls.select(F.col(url).alias("u")).distinct().withColumns({"h": host_of(F.col("u")), "p": path_of(F.col("u"))})
    expressions = one_each.select(
        "u",
        F.explode(
            F.expr(
                f"flatten(transform(filter(array({labels}), n -> n <= size(split(h, '[.]', -1))), n -> "
                f"transform(filter(array({chars}), m -> m <= length(p)), m -> "
                "sha2(concat_ws('\\0', array_join(slice(split(h, '[.]', -1), -n, n), '.'), substring(p, 1, m)), 256))))"
            )
        ).alias("digest"),
    )
    short = lambda c: F.substring(c, 1, 8)  # noqa: E731  hexadecimal digits of four bytes
    hits = expressions.join(keyed, (short("digest") == short("rule_digest")) & (F.col("digest") == F.col("rule_digest")), "inner")
    of, best = unused("of_url", urls), unused("best_rule", urls)
    chosen = hits.groupBy(F.col("u").alias(of)).agg(F.max_by(F.struct("rule", "rule_verdict"), "rank").alias(best))
    found = urls.join(chosen, urls[url] == chosen[of], "left")
    kept = [urls[c] for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return found.select(*kept, host_of(urls[url]).alias("host"), path_of(urls[url]).alias("path"), chosen[best]["rule"].alias("rule"), F.coalesce(chosen[best]["rule_verdict"], F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, spark.createDataFrame(RULES, RULE_SCHEMA)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT p.*, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC, r.verdict DESC) AS k
  FROM p LEFT JOIN r ON ('.' || p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {"op6_url_filter": ORACLE}
