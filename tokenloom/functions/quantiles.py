"""Exact percentiles in bounded memory: find the bin that holds a rank, then look inside that bin only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of an octave. Inside one, single precision has some 2^15 different numbers.
OCTAVE = 256
#: Bin of the infinite, beyond all of the finite (the exponents span 2,100 octaves); NaN comes after.
_ENDLESS, _LIFT = 1_000_000, 300_000


def _bin(x: Column) -> Column:
    """A whole number that never falls as ``x`` rises (a logarithm is monotone, its rounding too)."""
    size = F.abs(x)
    octave = F.floor(F.log2(F.when((size > 0) & (size < float("inf")), size)) * OCTAVE).cast("long") + _LIFT
    return F.when(F.isnan(x), F.lit(2 * _ENDLESS)).when(size == float("inf"), F.signum(x).cast("long") * _ENDLESS).when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * octave)


def quantiles(df: DataFrame, value: Column, wanted: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """The percentiles ``wanted`` (name: share, linear between ranks) of ``value`` by group; nulls count for nothing.

    One pass counts bins, a second the different values of the bins that hold a wanted rank. Both combine
    before their exchange, and no buffer holds the values of a group. Without groups: one row, null if empty.
    """
    if not wanted or any(not 0 <= q <= 1 for q in wanted.values()):
        raise ValueError("shares must lie between 0 and 1")
    x = df.select(*by, value.cast("double").alias("x")).filter("x IS NOT NULL").withColumn("bin", _bin(F.col("x")))
    line = Window.partitionBy(*by).orderBy("bin")
    bins = x.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    bins = bins.withColumn("upto", F.sum("n").over(line)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    place = {name: F.lit(q) * (F.col("all") - 1) for name, q in wanted.items()}
    holds = lambda rank: (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto"))
    hit = F.lit(False)
    for p in place.values():
        hit = hit | holds(F.floor(p)) | holds(F.ceil(p))
    # At most two bins for each wanted rank of a group.
    few = bins.filter(hit).select(*(F.col(c).alias(f"_{c}") for c in by), F.col("bin").alias("_bin"), (F.col("upto") - F.col("n")).alias("before"), "all")
    same = F.col("bin") == F.col("_bin")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    inside = x.join(F.broadcast(few) if not by else few, same).groupBy(*by, "bin", "x").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("all").alias("all"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*by, "bin").orderBy("x")))
    parts = []
    for name, p in place.items():
        for side, rank in (("low", F.floor(p)), ("high", F.ceil(p))):
            parts.append(F.max(F.when(holds(rank), F.col("x"))).alias(f"{name}_{side}"))
    found = inside.groupBy(*by).agg(F.max("all").alias("all"), *parts)

    def between(name: str, p: Column) -> Column:
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(name)

    return found.select(*by, *(between(n, p) for n, p in place.items()))
