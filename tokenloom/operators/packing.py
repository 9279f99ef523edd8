"""Packers: token tables (.., emb) to codes and scales.

Each is a projection of a token row; those with corpus-wide statistics read one row of
aggregates, which is broadcast (one row, whatever the corpus).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.quantiles import quantiles

LOG_FLOOR = 1e-12


def require(tokens: DataFrame, dim: int | None = None) -> None:
    """Vectors of one length, a multiple of eight."""
    row = tokens.agg(F.min(F.size("emb")).alias("a"), F.max(F.size("emb")).alias("b")).first()
    if row.a is None:
        return
    if row.a != row.b or dim is not None and row.a != dim:
        raise ValueError(f"vectors of {row.a} to {row.b} dimensions, not of {dim if dim is not None else 'one number'}")
    if row.a % 8:
        raise ValueError("dim must be divisible by 8")


def with_stat(tokens: DataFrame, **stats: Column) -> DataFrame:
    """``tokens`` with corpus-wide aggregates in every row."""
    return tokens.crossJoin(F.broadcast(tokens.agg(*(c.alias(n) for n, c in stats.items()))))


def pack_signs(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("codes", V.signs(F.col("emb"))).withColumn("token_scale", F.lit(1.0))


def token_scale(tokens: DataFrame, kind: str) -> DataFrame:
    """Column token_scale: mean_abs, l2, fp16, u8, u4 or a number of log levels ``log16``."""
    e = F.col("emb")
    if kind == "mean_abs":
        return tokens.withColumn("token_scale", V.mean_abs(e).cast("double"))
    if kind == "l2":
        return tokens.withColumn("token_scale", V.l2_scale(e).cast("double"))
    if kind == "fp16":
        return tokens.withColumn("token_scale", V.round_fp16(V.mean_abs(e)))
    levels = {"u8": 256, "u4": 16}.get(kind) or int(kind.removeprefix("log"))
    return log_levels(tokens.withColumn("raw", V.mean_abs(e).cast("double")), levels)


def explicit_token_scale(tokens: DataFrame, scales: DataFrame) -> DataFrame:
    """Token scales from a table (doc_idx, token_pos, token_scale); one is needed for every token."""
    out = tokens.drop("token_scale").join(scales.select("doc_idx", "token_pos", F.col("token_scale").cast("double").alias("token_scale")), ["doc_idx", "token_pos"], "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("no scale for token"), F.col("doc_idx").cast("string"), F.col("token_pos").cast("string")))
    return out.withColumn("token_scale", F.coalesce("token_scale", missing.cast("double")))


def log_levels(tokens: DataFrame, levels: int) -> DataFrame:
    """Column raw quantised to evenly spaced levels of its logarithm between the corpus's least and most: log_code and token_scale."""
    tokens = with_stat(tokens.withColumn("ln", F.ln(F.greatest("raw", F.lit(LOG_FLOOR)))), lo=F.min("ln"), hi=F.max("ln"))
    step = (F.col("hi") - F.col("lo")) / (levels - 1)
    code = F.when(F.col("hi") > F.col("lo"), F.rint((F.col("ln") - F.col("lo")) / step)).otherwise(0.0)
    return tokens.withColumn("log_code", code.cast("int")).withColumn("token_scale", F.when(F.col("hi") > F.col("lo"), F.exp(F.col("lo") + code * step)).otherwise(F.col("raw"))).drop("ln", "lo", "hi")


def doc_scale(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_idx, doc_scale): mean |x| over a document's components, 0 for empty ones."""
    per = tokens.select("doc_idx", V.total(F.transform("emb", F.abs)).alias("s"), F.size("emb").alias("n")).groupBy("doc_idx").agg((F.sum("s") / F.sum("n")).alias("doc_scale"))
    return docs.select("doc_idx").join(per, "doc_idx", "left").select("doc_idx", F.coalesce("doc_scale", F.lit(0.0)).alias("doc_scale"))


def global_scale(tokens: DataFrame) -> DataFrame:
    return tokens.agg((F.sum(V.total(F.transform("emb", F.abs))) / F.sum(F.size("emb"))).alias("scale"))


def pack_int4(tokens: DataFrame, granularity: str = "token") -> DataFrame:
    """codes in -7..7 and token_scale; one scale a token, one of the corpus (tensor) or one a dimension (channel)."""
    if granularity == "token":
        tokens = tokens.withColumn("scale32", V.code_scale(F.col("emb"), 7))
    elif granularity == "tensor":
        tokens = with_stat(tokens, most=F.max(V.max_abs(F.col("emb"))))
        tokens = tokens.withColumn("scale32", F.when(F.col("most") == 0, 1.0).otherwise(F.col("most").cast("double") / 7).cast("float")).drop("most")
    elif granularity == "channel":
        per = dim_stat(tokens, F.max(F.abs("x")).alias("m")).withColumn("s", F.when(F.col("m") == 0, F.lit(1.0)).otherwise(F.col("m").cast("double") / 7).cast("float"))
        tokens = tokens.crossJoin(F.broadcast(by_dim(per, "s", "channel_scale")))
        codes = F.zip_with("emb", "channel_scale", lambda x, s: F.greatest(F.lit(-7.0), F.least(F.lit(7.0), F.rint((x / s).cast("float").cast("double")))).cast("int"))
        return tokens.withColumn("codes", codes).withColumn("token_scale", F.lit(1.0))
    else:
        raise ValueError("scale_granularity must be token, tensor or channel")
    return tokens.withColumn("codes", V.scaled_codes(F.col("emb"), F.col("scale32"), 7)).withColumn("token_scale", F.col("scale32").cast("double")).drop("scale32")


def pack_int8(tokens: DataFrame, vector: str = "emb") -> DataFrame:
    return tokens.withColumn("scale32", V.code_scale(F.col(vector), 127)).withColumn("codes", V.scaled_codes(F.col(vector), F.col("scale32"), 127)).withColumn("token_scale", F.col("scale32").cast("double")).drop("scale32")


def pack_residual(tokens: DataFrame) -> DataFrame:
    """Two int4 streams: codes and token_scale of the prefix, residual_codes and residual_scale of what it leaves."""
    one = tokens.withColumn("s1", V.code_scale(F.col("emb"), 7)).withColumn("codes", V.scaled_codes(F.col("emb"), F.col("s1"), 7))
    two = one.withColumn("left_over", F.zip_with("emb", "codes", lambda x, c: (x - (c.cast("float") * F.col("s1")).cast("float")).cast("float")))
    two = two.withColumn("s2", V.code_scale(F.col("left_over"), 7)).withColumn("residual_codes", V.scaled_codes(F.col("left_over"), F.col("s2"), 7))
    return two.withColumn("token_scale", F.col("s1").cast("double")).withColumn("residual_scale", F.col("s2").cast("double")).drop("s1", "s2", "left_over")


def pack_ternary(tokens: DataFrame, threshold: float | None = None) -> DataFrame:
    """Codes -1, 0, 1; without a threshold, the 25th percentile of |x| over the corpus."""
    if threshold is not None:
        return tokens.withColumn("codes", V.ternary(F.col("emb"), threshold)).withColumn("token_scale", F.lit(1.0))
    cut = quantiles(tokens.select(F.explode("emb").alias("x")), F.abs("x"), {"t": 0.25})
    return tokens.crossJoin(F.broadcast(cut)).withColumn("codes", V.ternary(F.col("emb"), F.col("t"))).withColumn("token_scale", F.lit(1.0)).drop("t")


def pack_group_scaled_signs(tokens: DataFrame, group: int = 16) -> DataFrame:
    """Signs times the mean |x| of their group of dimensions, as values."""
    scales = F.flatten(F.transform(V.group_scales(F.col("emb"), group), lambda s: F.array_repeat(s, group)))
    return tokens.withColumn("codes", F.zip_with(V.signs(F.col("emb")), scales, lambda c, s: c * s.cast("double"))).withColumn("token_scale", F.lit(1.0))


# -- statistics of dimensions ------------------------------------------------------------


def dim_stat(tokens: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates of ``x`` by dimension ``d``: as many rows as a vector has components."""
    return tokens.select(F.posexplode("emb").alias("d", "x")).groupBy("d").agg(*aggregates)


def by_dim(stats: DataFrame, column: str, name: str) -> DataFrame:
    """One row with a column of statistics as an array in order of dimension."""
    return stats.agg(F.transform(F.array_sort(F.collect_list(F.struct("d", column))), lambda s: s[column]).alias(name))


def fit_thresholds(tokens: DataFrame, q: float = 0.4) -> DataFrame:
    return quantiles(tokens.select(F.posexplode("emb").alias("d", "x")), F.col("x"), {"t": q}, ("d",))


def fit_centroids(tokens: DataFrame, thresholds: DataFrame | None = None, lloyd: int = 0) -> DataFrame:
    """(d, t, neg, pos): means of the components on each side of a threshold (0 without one); an
    empty side takes the threshold. Lloyd steps move thresholds to the middle."""
    if thresholds is None:
        thresholds = dim_stat(tokens, F.lit(0.0).alias("t"))

    def sides(t: DataFrame) -> DataFrame:
        x = tokens.select(F.posexplode("emb").alias("d", "x")).join(F.broadcast(t.select("d", "t")), "d")
        means = x.groupBy("d").agg(F.first("t").alias("t"), F.avg(F.when(F.col("x").cast("double") < F.col("t"), F.col("x").cast("double"))).alias("neg"), F.avg(F.when(F.col("x").cast("double") >= F.col("t"), F.col("x").cast("double"))).alias("pos"))
        return means.select("d", "t", F.coalesce("neg", "t").alias("neg"), F.coalesce("pos", "t").alias("pos"))

    out = sides(thresholds)
    for _ in range(lloyd):
        out = sides(out.select("d", ((F.col("neg") + F.col("pos")) / 2).alias("t")))
    return out


def pack_centroid_signs(tokens: DataFrame, calibration: DataFrame) -> DataFrame:
    """Signs by threshold as values of their side's centroid (codes are what a score restores)."""
    fitted = calibration.agg(F.array_sort(F.collect_list(F.struct("d", "t", "neg", "pos"))).alias("fit"))
    value = F.zip_with("emb", "fit", lambda x, f: F.when(x.cast("double") >= f["t"], f["pos"]).otherwise(f["neg"]))
    return tokens.crossJoin(F.broadcast(fitted)).withColumn("codes", value).withColumn("token_scale", F.lit(1.0)).drop("fit")


def pack_threshold_signs(tokens: DataFrame, q: float = 0.5) -> DataFrame:
    t = by_dim(fit_thresholds(tokens, q), "t", "thresholds")
    return tokens.crossJoin(F.broadcast(t)).withColumn("codes", V.signs(F.col("emb"), F.col("thresholds"))).withColumn("token_scale", F.lit(1.0)).drop("thresholds")
