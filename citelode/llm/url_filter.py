"""URL rules through a blocked Bloom filter. DataFrame functions only.

A rule lists a canonical URL: a host and the start of a path. It fits its host and all
subdomains of it, for paths that start with the rule's. The keys a URL could be listed under
are its host's suffixes with its path's starts; the Bloom filter removes nearly all that are
not listed, a hash join with the list removes the rest, and the longest listed key decides.

Each different URL is judged once. The filter's size is bounded; the list itself may be of any
size, Spark broadcasts it only when it is under its own threshold.

Defined cases: a null URL and one without ``://`` have an empty host and path and fit no
rule. A URL that fits no rule is allowed. Of rules of one length the one with the longer
host decides, then the later in code point order; a rule listed twice counts once, with
``block`` before ``allow``. Rules with a null part are not used. Rows that repeat are judged
each; an empty list allows everything; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelode.llm.common import BlockedBloom
from citelode.session import shared_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The listed URLs of the registered query: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
DEFAULT = "allow"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def listed_keys(host: Column, path: Column, lengths: Column, counts: Column) -> Column:
    """Every key with a number of labels and a path length that the list has, under which a URL could be listed."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.filter(counts, lambda n: n <= F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    pairs = F.transform(suffixes, lambda suffix: F.transform(starts, lambda start: F.struct(suffix.alias("host"), start.alias("path"))))
    return F.flatten(pairs)


def _key(pair: Column) -> Column:
    return F.xxhash64(pair["host"], pair["path"])


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row."""
    listed = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    ).dropna()
    listed = shared_table(listed.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("listed_verdict")), "rules")
    bloom = BlockedBloom.build(listed.select(F.xxhash64("rule_host", "rule_path").alias("key")), "key")
    # Different path lengths and numbers of labels of the list: only keys of these can be listed, however
    # many labels a host has.
    shapes = shared_table(listed.agg(F.struct(
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
        F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.", -1)))).alias("counts"),
    ).alias("shapes")), "shapes")
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = rows.filter("host <> ''").select("host", "path").distinct().withColumn("shapes", shapes.scalar())
    keys = listed_keys(F.col("host"), F.col("path"), F.col("shapes.lengths"), F.col("shapes.counts"))
    hits = bloom.with_possible(urls, "hits", keys, _key).select("host", "path", F.explode("hits").alias("hit")).select("host", "path", "hit.host", "hit.path").toDF(
        "host", "path", "rule_host", "rule_path"
    )
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(
        F.length(rule).alias("length"), F.length("rule_host").alias("host_length"), rule.alias("rule"),
        F.col("listed_verdict").alias("verdict"),
    )
    best = hits.join(listed, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max(rank).alias("best"))
    best = shared_table(best.select("host", "path", "best.rule", "best.verdict"), "judged")
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"))


#: The same in DuckDB.
SQL = r"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT r, rule_host || rule_path AS rule, verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (r)
"""
