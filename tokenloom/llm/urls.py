"""URL filters by a sort-merge range join, in DataFrame operations only.

A host is written with its labels reversed and a dot after each (``com.example.www.``), so
a rule's host and all its subdomains are one interval of keys, and intervals of rules nest
or are apart. Distinct hosts and the borders of the intervals are sorted together, dealt
out by range, and swept once: the running sum of borders is the height of the stack of
open rules, and the last border opened at that height is the innermost rule of a host.
What is open where a range begins is put in at its front. The stack itself, all rules that
hold for an innermost host, is known from the rules alone; a page then looks for the
longest of them whose path its own begins with.

Pages only meet hosts' verdicts in an equi-join that adaptive execution may split; a host
with a third of all pages is one row of the sweep.

Defined results: a null url, or one without ``://``, has empty host and path; an empty
host and a host that no rule fits get the default verdict and a null rule; a path must
begin with the rule's, so ``http://a.net`` does not fit ``net/``; of rules that fit, the one with
the longest host and path wins, then the one with the longer host, then block before
allow; repeated rules count once, rules without a host are ignored; empty tables give no
rows, or the default verdict for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import cut, names, quoted, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``www.example.com`` -> ``com.example.www.``; no host, no key."""
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Rule hosts (key) with all rules that hold there and in subdomains, outer ones too.

    The outer hosts of a host are found by its own labels, so this is linear in the rules.
    """
    clean = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''").distinct()
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "block").alias("block"), F.concat("host", "path").alias("rule"), "path", "verdict")
    own = clean.groupBy(host_key(F.col("host")).alias("key")).agg(F.array_sort(F.collect_set(rule)).alias("own"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    outer = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))).alias("at"))
    held = own.select(F.col("key").alias("at"), "own")
    return outer.join(held, "at").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))


def innermost(hosts: DataFrame, stacks: DataFrame) -> DataFrame:
    """(key, at): for each distinct host key the innermost rule host whose interval has it."""
    # Borders: '/' is the character after '.', so [key, key with '/' at its end) is the interval.
    opens = stacks.select("key", F.lit(1).alias("step"), F.col("key").alias("at"))
    closes = stacks.select(F.expr("concat(substring(key, 1, length(key) - 1), '/')").alias("key"), F.lit(-1).alias("step"), F.col("key").alias("at"))
    points = hosts.select("key", F.lit(0).alias("step"), F.lit(None).cast("string").alias("at"))
    # A border that opens stands before a point of the same key; none closes at a point's key.
    dealt = opens.union(closes).union(points).repartitionByRange("key", (-F.col("step")).alias("o")).withColumn("part", F.spark_partition_id())
    dealt = cut(dealt)
    # Intervals that reach over the beginning of a range are opened again at its front.
    first = dealt.filter("step = 1").select("at", F.col("part").alias("a"))
    last = dealt.filter("step = -1").select("at", F.col("part").alias("b"))
    over = first.join(last, "at").filter("b > a").select(F.col("at").alias("key"), F.lit(1).alias("step"), "at", F.explode(F.expr("sequence(a + 1, b)")).alias("part"))
    swept = dealt.unionByName(over)
    line = Window.partitionBy("part").orderBy("key", F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = swept.withColumn("height", F.sum("step").over(line))
    level = Window.partitionBy("part", "height").orderBy("key", F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.last(F.when(F.col("step") == 1, F.col("at")), ignorenulls=True).over(level)
    return swept.withColumn("top", F.when(F.col("height") > 0, top)).filter("step = 0 AND top IS NOT NULL").select("key", F.col("top").alias("at"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules``: host, path, verdict (block or allow)."""
    key, stack, best = names(pages, "host_key", "rule_stack", "best_rule")
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    seen = pages.select(*(quoted(c) for c in rest), host_of(quoted(url_col)).alias("host"), path_of(quoted(url_col)).alias("path"))
    seen = seen.withColumn(key, F.coalesce(host_key(F.col("host")), F.lit("")))
    stacks = cut(rule_stacks(rules))
    hosts = pages.select(host_key(host_of(quoted(url_col))).alias("key")).filter("key IS NOT NULL").distinct()
    known = innermost(hosts, stacks).join(stacks.select(F.col("key").alias("at"), "stack"), "at").select(F.col("key").alias(key), F.col("stack").alias(stack))
    fits = F.array_max(F.filter(F.col(stack), lambda r: F.startswith(F.col("path"), r["path"])))
    out = seen.join(known, key, "left").withColumn(best, fits)
    return out.select(*(quoted(c) for c in rest), "host", "path", F.col(best)["rule"].alias("rule"), F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op9_urls": op9_urls}
SQL = {
    "op9_urls": r"""
        WITH p AS (
            SELECT page_id,
                translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        m AS (
            SELECT page_id, host, path, h || q AS rule, v
            FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
            QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST) = 1)
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m
    """
}
