"""URL rules by a sort-merge range join, in DataFrame operations alone.

A rule (host, path) fits its host, every subdomain, and every path that starts with its own. In the order
of canonical keys (host labels from the top domain down, then the path; compared as bytes) the urls of one
host that a path prefix fits are an interval that begins with the rule. Rules and urls are sorted together
by key over range partitions and swept. The stack of open rules comes with each rule: the nested rules of
its host whose paths its own path starts with, itself on top. A url takes the stack of the last rule before
it and pops what does not hold it: whatever rule is open at the url began before that rule and so is in its
stack. Each partition begins with the last rule of those before it (one row for each partition is carried).
A url stands in the sweep once for each of its ancestor hosts, so that a rule of a parent domain meets the
url's path too; the longest rule over the ancestors wins (length of host and path together, then of the host).

Rules stand in the sweep once each. Equal urls of one page id are counted once, and urls are ranged by key
and page id, so a hot host or url spreads over partitions. Nothing is broadcast or collected.

Defined results: a null url or one without "://" has empty host and path and no rule; an empty host or
path is legal; repeated rows give repeated rows; without rules every url gets the default verdict; of
rules with equal host and path the one of the smaller verdict ("allow" before "block") holds; rules with a
null host or path fit nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chosen, partitions, table, written

#: Fixed values of the contract: host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
def rules_frame(spark: SparkSession, rules=tuple(RULES)) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_of(url):
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host, path):
    """Labels from the top domain down, a byte that no text holds, then the path; as bytes."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ".").cast("binary"), F.lit(bytearray(b"\xfe")), path.cast("binary"))


def ancestors(host):
    """The host and all that is left of it behind a dot."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, host, stack) of each rule; stack: (path, rule) of the rules of its host that are open behind it, itself the last."""
    r = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    r = r.withColumn("rule", F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("text"), "verdict"))
    sizes = r.groupBy("host").agg(F.collect_set(F.length("path")).alias("sizes"))  # as many as a path has characters at most
    own = r.join(sizes, "host").select("host", "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n"))
    outer = r.select("host", F.col("path").alias("outer"), "rule")
    nested = own.select("host", "path", F.substring("path", F.lit(1), F.col("n")).alias("outer")).join(outer, ["host", "outer"])
    stacks = nested.groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct(F.length("outer").alias("n"), F.col("outer").alias("path"), "rule"))).alias("stack"))
    return stacks.select(key_of(F.col("host"), F.col("path")).alias("key"), F.struct("host", "stack").alias("state"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of each row of `pages`."""
    parts = partitions(pages.sparkSession)
    urls = chosen(pages, page_id=id_column, url=url_column).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    urls = urls.select("page_id", "url", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    page = F.struct("page_id", "url", "copies", "host", "path")
    asked = urls.select(F.explode(ancestors(F.col("host"))).alias("ancestor"), page.alias("page"))
    asked = asked.select(key_of(F.col("ancestor"), F.col("page.path")).alias("key"), F.lit(1).alias("kind"), F.xxhash64("page.page_id").alias("turn"), "ancestor", "page")
    events = rule_events(rules).select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("turn"), "state")
    both = events.unionByName(asked, allowMissingColumns=True)
    # written, so that a row's partition stays what it is
    ranged = written(both.repartitionByRange(parts, "key", "kind", "turn").withColumn("part", F.spark_partition_id()))
    last = ranged.where("kind = 0").groupBy("part").agg(F.max_by("state", "key").alias("state"))
    border = ranged.select("part").distinct().join(last, "part", "left")  # a row for each partition
    carried = border.select("part", F.last("state", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("state")).where("state IS NOT NULL")
    swept = ranged.unionByName(carried.withColumn("kind", F.lit(-1)), allowMissingColumns=True).repartitionByRange(parts, "part")
    order = Window.partitionBy("part").orderBy(F.col("key").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("state", F.last("state", ignorenulls=True).over(order)).where("kind = 1")
    open_ = F.filter("state.stack", lambda r: F.col("page.path").startswith(r["path"]))
    top = F.when(F.col("state.host") == F.col("ancestor"), F.element_at(F.transform(open_, lambda r: r["rule"]), -1))
    best = swept.select("page", F.when(F.size(open_) > 0, top).alias("top")).groupBy("page.page_id", "page.url", "page.copies", "page.host", "page.path").agg(F.max("top").alias("best"))
    result = best.select(
        "page_id", "host", "path", F.col("best.text").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    )
    return result.drop("copy")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark))


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT s.page_id, s.host, s.path, max({'size': length(rhost || rpath), 'host_size': length(rhost), 'text': rhost || rpath, 'verdict': verdict}) AS b
  FROM split s LEFT JOIN rules r
    ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)
  GROUP BY s.page_id, s.host, s.path
)
SELECT s.page_id, s.host, s.path, b.b.text AS rule, coalesce(b.b.verdict, 'allow') AS verdict
FROM split s JOIN best b ON s.page_id IS NOT DISTINCT FROM b.page_id AND s.host = b.host AND s.path = b.path
"""
