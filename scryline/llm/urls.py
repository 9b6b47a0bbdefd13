"""URL filter: a sort-merge range join of hosts with nested rules, by DataFrame functions only.

A host's canonical key is its labels in reverse, each with a dot: `en.example.net` becomes `net.example.en.`.
All subdomains of a rule's host then fill the interval from its key up to the key with its last dot raised.
Such intervals nest or are disjoint. The sweep sorts interval starts, interval ends and page keys together;
each boundary carries the stack of rules that are active after it, and a page sees the stack of the last boundary
before it. Of that stack, the longest rule whose path begins the page's path decides.

Pages are swept by top-level label and salt; there are as many salts as keep a label's share of one to SALT_ROWS pages, so a hot
host is spread over many tasks; the rules of a label are repeated once for each salt. The sweep keeps one row for each pair of rule and page key, never pairs.

Defined results: a url that is null or without `://` has an empty host and path, and no rule; an empty path
fits only rules with an empty path; ties between equally long rules go to `block`; repeated rows are judged
each; an empty table gives no rows; further columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

SALTS, SALT_ROWS = 32, 250_000  # salts at least; pages of one salt at most
#: The rules of the query op5_url_filter: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def boundaries(rules: DataFrame) -> DataFrame:
    """rules (verdict, host, path) -> key, stack: from each boundary on, the rules whose host intervals are open.

    The stack at a start has the rules of that host and of all its parents, found by an equi-join of a host's
    parents with the rules' hosts; at an end, those of the parents alone.
    """
    rules = rules.select("verdict", F.lower("host").alias("host"), "path").distinct().withColumn("key", host_key(F.col("host")))
    by_host = rules.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.length(F.concat("host", "path")).alias("len"), "verdict", "host", "path"))).alias("own"))
    labels = F.split(F.expr("left(key, length(key) - 1)"), r"\.")
    parents = by_host.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("parent"))
    stacked = parents.join(by_host.select(F.col("key").alias("parent"), "own"), "parent").groupBy("key").agg(
        F.flatten(F.collect_list("own")).alias("open"), F.flatten(F.collect_list(F.when(F.col("parent") != F.col("key"), F.col("own")))).alias("closed")
    )
    end = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))  # '/' follows '.'
    return stacked.select("key", F.lit(1).alias("kind"), F.col("open").alias("stack")).unionByName(stacked.select(end.alias("key"), F.lit(0).alias("kind"), F.col("closed").alias("stack")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages (page_id, url), rules (verdict, host, path) -> page_id, host, path, rule, verdict."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", host_key(F.col("host")))
    label = F.substring_index(F.col("key"), ".", 1)
    salts = max(SALTS, -(-pages.count() // SALT_ROWS))
    edges = boundaries(rules).withColumn("label", F.regexp_extract("key", r"^([^./]*)", 1)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    swept = parsed.select(
        "page_id", "host", "path", "key", label.alias("label"), F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int").alias("salt"), F.lit(2).alias("kind")
    ).unionByName(edges, allowMissingColumns=True)
    sweep = Window.partitionBy("label", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = swept.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 2")
    fits = F.filter("active", lambda r: F.expr("true") & F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(r["len"].alias("len"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule"))))
    return active.withColumn("best", longest).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages under RULES; where none fits, `allow`."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(pages, rules)


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC, verdict DESC) AS k
  FROM q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM q LEFT JOIN m ON m.k = 1 AND q.page_id = m.page_id AND q.host = m.host AND q.path = m.path
"""
