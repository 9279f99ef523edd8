"""Less travelled operators: significance, gates, pooling variants, rotation, adapters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from . import pooling, search

# -- significance ------------------------------------------------------------------------


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact p: twice the lower binomial tail at one half, 1 at most."""
    n, low = (wins + losses).cast("double"), F.least(wins, losses)
    # Logarithms of coefficients follow from one another, so nothing overflows.
    start = F.struct(F.lit(0.0).alias("c"), F.exp(-n * F.log(F.lit(2.0))).alias("s"))

    def step(a: Column, i: Column) -> Column:
        c = a["c"] + F.log((n - i + 1) / i)
        return F.struct(c.alias("c"), (a["s"] + F.exp(c - n * F.log(F.lit(2.0)))).alias("s"))

    tail = F.aggregate(F.when(low > 0, F.sequence(F.lit(1).cast("long"), low.cast("long"))).otherwise(F.array().cast("array<bigint>")), start, step, lambda a: a["s"])
    return F.least(F.lit(1.0), 2 * tail)


def bootstrap(deltas: DataFrame, samples: int = 10_000, seed: int = 20260704) -> DataFrame:
    """95 % interval of the mean of ``deltas`` (delta) over Poisson resamples.

    Equal deltas are one row with their number, whose weights in all resamples are drawn where it lies, from its own
    seed; a task sends one partial sum a resample. Results do not depend on the partitioning.
    """
    held = deltas.filter("delta IS NOT NULL").groupBy(F.col("delta").cast("double").alias("delta")).agg(F.count("*").alias("n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(samples), np.zeros(samples)
        for frame in frames:
            for x, n in zip(frame["delta"].to_numpy(), frame["n"].to_numpy(), strict=True):
                w = np.random.default_rng([seed, int(np.float64(x).view(np.uint64))]).poisson(float(n), samples)
                total += w * x
                weight += w
        yield pd.DataFrame({"resample": np.arange(samples), "total": total, "weight": weight})

    sums = held.mapInPandas(run, "resample int, total double, weight double").groupBy("resample").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
    return quantiles(sums.filter("weight > 0"), F.col("total") / F.col("weight"), {"low": 0.025, "high": 0.975})


# -- scores and rankings -----------------------------------------------------------------


def checksum(scores: DataFrame, reference: DataFrame) -> DataFrame:
    both = scores.join(reference.withColumnRenamed("score", "other"), ["query_idx", "doc_idx"])
    return both.agg(F.count("*").alias("pairs"), F.sum("score").alias("checksum"), F.max(F.abs(F.col("score") - F.col("other"))).alias("max_delta"))


def recall_of(fine: DataFrame, coarse: DataFrame, k: int, keep: int) -> DataFrame:
    """Share of the k best by ``fine`` that are among the ``keep`` best by ``coarse``."""
    a, b = search.top_k(fine, k), search.top_k(coarse, keep).select("query_idx", "doc_idx", F.lit(1).alias("in"))
    return a.join(b, ["query_idx", "doc_idx"], "left").agg(F.avg(F.coalesce("in", F.lit(0))).alias("recall"))


def normalise_results(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_idx, doc_idx, score) of results that name a document by id or by index; finite scores only, an unknown name is an error."""
    named = rows.join(docs.select(F.col("doc_id").alias("name"), F.col("doc_idx").alias("by_id")), "name", "left")
    at = F.coalesce("by_id", F.col("name").try_cast("long"))
    known = named.withColumn("at", at).join(docs.select(F.col("doc_idx").alias("at"), F.lit(True).alias("known")), "at", "left")
    checked = F.when(F.col("known").isNull(), F.raise_error(F.concat(F.lit("unknown document "), F.col("name")))).otherwise(F.col("at"))
    return known.select("query_idx", checked.cast("long").alias("doc_idx"), "score").filter(~F.isnan("score") & (F.abs("score") < float("inf")))


def gates(rows: DataFrame, baseline: str, most_ratio: float) -> DataFrame:
    """Per implementation: whether its value is finite and at most ``most_ratio`` times the baseline's."""
    base = rows.filter(F.col("implementation") == baseline).select("dataset", F.col("value").alias("base"))
    joined = rows.join(base, "dataset")
    ok = ~F.isnan("value") & (F.abs("value") < float("inf")) & (F.col("value") <= most_ratio * F.col("base"))
    return joined.groupBy("implementation").agg(F.bool_and(ok).alias("passed"), F.max(F.col("value") / F.col("base")).alias("worst_ratio"))


def monotone(rows: DataFrame, falling: bool = False) -> DataFrame:
    """Per implementation: whether its finite values never fall (or rise) with ``step``, and the worst step."""
    line = Window.partitionBy("implementation").orderBy("step")
    change = F.col("value") - F.lag("value").over(line)
    change = -change if falling else change
    finite = F.coalesce(~F.isnan("value") & (F.abs("value") < float("inf")), F.lit(False))
    stepped = rows.withColumn("change", change).withColumn("finite", finite)
    return stepped.groupBy("implementation").agg((F.bool_and("finite") & (F.coalesce(F.min("change"), F.lit(0.0)) >= 0)).alias("passed"), F.min("change").alias("worst_step"))


def regret(rows: DataFrame, chosen: Column, most: float = 0.05) -> DataFrame:
    """Per dataset: the chosen route's value over the best one's (the least), less one, and whether it is at most ``most``."""
    worst = F.max(F.when(chosen, F.col("value"))) / F.min("value") - 1
    return rows.groupBy("dataset").agg(F.min_by("implementation", F.struct("value", "implementation")).alias("best_route"), worst.alias("regret")).withColumn("passed", F.coalesce(F.col("regret") <= most, F.lit(False)))


def stage_gate(results: DataFrame, stage: str) -> DataFrame:
    """One row: whether ``stage`` has results, all passed, with finite latencies and metrics (a missing metric is none)."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = F.col("passed") & F.coalesce(finite("latency"), F.lit(False)) & F.coalesce(finite("metric"), F.lit(True))
    return results.filter(F.col("stage") == stage).agg(F.count("*").alias("results"), F.coalesce(F.bool_and(good), F.lit(False)).alias("passed"))


# -- pooling variants --------------------------------------------------------------------


def pool_variant(tokens: DataFrame, factor: int, kind: str) -> DataFrame:
    """Pooled tokens with the mass of each cluster: weighted (by norm), protected (a quarter of largest norm stays as is) or plain."""
    if kind not in ("weighted", "protected", "plain"):
        raise ValueError("kind must be weighted, protected or plain")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("token_pos")
        x = np.stack(frame["emb"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        stay = np.zeros(len(x), bool)
        if kind == "protected":
            stay[np.argsort(-norm, kind="stable")[: len(x) // 4]] = True
        rest = np.flatnonzero(~stay)
        out, mass = [x[i] for i in np.flatnonzero(stay)], [1] * int(stay.sum())
        if len(rest):
            unit = x[rest] / np.maximum(norm[rest, None], 1e-12)
            labels = pooling.ward_labels(unit, -(-len(rest) // factor))
            for c in range(labels.max() + 1):
                members = rest[labels == c]
                w = norm[members] if kind == "weighted" and norm[members].sum() > 0 else np.ones(len(members))
                out.append((x[members] * w[:, None]).sum(0) / w.sum())
                mass.append(len(members))
        return pd.DataFrame({"doc_idx": frame["doc_idx"].iloc[0], "token_pos": np.arange(len(out)), "emb": [v.astype(np.float32) for v in out], "mass": mass})

    return tokens.select("doc_idx", "token_pos", "emb").groupBy("doc_idx").applyInPandas(run, "doc_idx long, token_pos long, emb array<float>, mass long")


# -- rotation ----------------------------------------------------------------------------

#: Rows that a rotation is fitted on, at most.
ROTATION_ROWS = 65_536


def fit_rotation(tokens: DataFrame, steps: int = 40, rows: int = ROTATION_ROWS, seed: int = 0) -> np.ndarray:
    """A rotation that brings vectors near the corners of a cube, fitted on a bounded sample by alternating signs and Procrustes."""
    sample = tokens.select("emb").orderBy(F.xxhash64("emb")).limit(rows).toPandas()
    x = np.stack(sample["emb"].to_numpy()).astype(np.float64)
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(steps):
        u, _, v = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0))
        r = u @ v
    return r


def rotate(tokens: DataFrame, rotation: np.ndarray, vector: str = "emb") -> DataFrame:
    columns = [F.array(*(F.lit(float(v)) for v in rotation[:, j])) for j in range(rotation.shape[1])]
    dot = lambda c: F.aggregate(F.zip_with(vector, c, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    return tokens.withColumn(vector, F.array(*(dot(c).cast("float") for c in columns)))
