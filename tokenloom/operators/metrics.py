"""Ranking quality as grouped aggregates over ranked rows and sparse relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gain(linear: bool = False):
    return F.col("rel") if linear else F.pow(F.lit(2.0), F.col("rel")) - 1


def per_query(ranked: DataFrame, qrels: DataFrame, k: int = 10, linear: bool = False) -> DataFrame:
    """recall, mrr and ndcg at k of each query that has relevant documents."""
    relevant = qrels.filter("rel > 0")
    best = Window.partitionBy("query_idx").orderBy(F.col("rel").desc(), "doc_idx")
    ideal = relevant.withColumn("r", F.row_number().over(best)).groupBy("query_idx").agg(F.count("*").alias("relevant"), F.sum(F.when(F.col("r") <= k, gain(linear) / F.log2(F.col("r") + 1.0))).alias("idcg"))
    hits = ranked.filter(F.col("rank") <= k).join(relevant, ["query_idx", "doc_idx"])
    got = hits.groupBy("query_idx").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(gain(linear) / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(got, "query_idx", "left").select("query_idx", zero(F.col("found") / F.col("relevant")).alias("recall"), zero(1.0 / F.col("first")).alias("mrr"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def for_all(per: DataFrame, queries: DataFrame, missing: float | None = None) -> DataFrame:
    """``per`` with a row for each of ``queries``; one without relevant documents has ``missing`` for every metric (null, or 0.0 as in production reports)."""
    every = queries.select("query_idx").distinct().join(per, "query_idx", "left")
    return every.select("query_idx", *((F.col(c) if missing is None else F.coalesce(c, F.lit(missing))).alias(c) for c in ("recall", "mrr", "ndcg")))


def summary(per: DataFrame) -> DataFrame:
    return per.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("recall", "mrr", "ndcg")))


def agreement(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Mean share of the k best that two rankings have in common."""
    queries = a.select("query_idx").distinct()
    same = a.filter(F.col("rank") <= k).join(b.filter(F.col("rank") <= k).select("query_idx", "doc_idx"), ["query_idx", "doc_idx"]).groupBy("query_idx").count()
    return queries.join(same, "query_idx", "left").agg(F.avg(F.coalesce("count", F.lit(0)) / k).alias("agreement"))


def token_buckets(per: DataFrame, qrels: DataFrame, lengths: DataFrame) -> DataFrame:
    """Quality by the mean length of a query's relevant documents, cut at the tertiles of all lengths."""
    cuts = lengths.agg(F.percentile("n_tokens", F.lit(1 / 3)).alias("lower"), F.percentile("n_tokens", F.lit(2 / 3)).alias("upper"))
    mean = qrels.filter("rel > 0").join(lengths, "doc_idx").groupBy("query_idx").agg(F.avg("n_tokens").alias("n"))
    bucket = F.when(F.col("n") <= F.col("lower"), "short").when(F.col("n") <= F.col("upper"), "medium").otherwise("long")
    return per.join(mean, "query_idx").crossJoin(F.broadcast(cuts)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("queries"), F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"))


def length_summary(lengths: DataFrame) -> DataFrame:
    p = lambda q, n: F.percentile("n_tokens", F.lit(q)).alias(n)
    return lengths.agg(F.min("n_tokens").alias("least"), F.avg("n_tokens").alias("mean"), p(0.5, "p50"), p(0.95, "p95"), p(0.99, "p99"), F.max("n_tokens").alias("most"))


def paired(a: DataFrame, b: DataFrame, metric: str = "ndcg", eps: float = 1e-9) -> DataFrame:
    """Mean difference, wins, losses and ties of two per-query tables."""
    d = F.col("b") - F.col("a")
    both = a.select("query_idx", F.col(metric).alias("a")).join(b.select("query_idx", F.col(metric).alias("b")), "query_idx").filter("a IS NOT NULL AND b IS NOT NULL")
    one = lambda c, n: F.sum(F.when(c, 1).otherwise(0)).alias(n)
    return both.agg(F.count("*").alias("queries"), F.avg(d).alias("mean_delta"), one(d > eps, "wins"), one(d < -eps, "losses"), one(F.abs(d) <= eps, "ties"))


def across(rows: DataFrame) -> DataFrame:
    """Mean, median and geometric mean (of positives; 0 without any) of ``value`` by implementation over datasets."""
    return rows.groupBy("implementation").agg(F.count("value").alias("datasets"), F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).alias("unavailable"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.coalesce(F.exp(F.avg(F.when(F.col("value") > 0, F.ln("value")))), F.lit(0.0)).alias("geomean"))


def across_scales(rows: DataFrame, baseline: str, digits: int) -> DataFrame:
    """Implementations over datasets (implementation, dataset, scale, value), for each scale and for all: means, the mean
    difference from the baseline on the same dataset and scale, and the place by mean."""
    base = rows.filter(F.col("implementation") == baseline).select("dataset", "scale", F.col("value").alias("base"))
    both = rows.join(base, ["dataset", "scale"], "left").withColumn("delta", F.col("value") - F.col("base"))
    keys = [F.col("scale"), F.col("implementation")]
    geomean = F.coalesce(F.exp(F.avg(F.when(F.col("value") > 0, F.ln("value")))), F.lit(0.0))
    out = both.groupingSets([keys[1:], keys], *keys).agg(F.count("value").alias("datasets"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), geomean.alias("geomean"), F.avg("delta").alias("delta"), F.grouping("scale").alias("every"))
    out = out.select(F.when(F.col("every") == 1, "all").otherwise(F.col("scale")).alias("scale"), "implementation", "datasets", *(F.round(c, digits).alias(c) for c in ("mean", "median", "geomean", "delta")))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("scale").orderBy(F.col("mean").desc(), "implementation")))


def metric_ks(text: str, k: int) -> list[int]:
    """Depths of metrics from a list in words; 1 and ``k`` are always among them."""
    given = [int(part) for part in text.split(",") if part.strip()]
    if min([*given, k]) < 1:
        raise ValueError("depths must be positive")
    return sorted({1, k, *given})
