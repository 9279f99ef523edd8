"""Column expressions over token vectors (arrays of float): codes, scales, bit layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double"))


def round_signed(x: Column, digits: int) -> Column:
    """Half away from zero; what rounds to zero keeps its sign, as in C and DuckDB. F.round alone gives 0.0 for -1e-9."""
    return F.round(F.abs(x), digits) * F.signum(x)


def max_abs(e: Column) -> Column:
    return F.array_max(F.transform(e, F.abs))


def mean_abs(e: Column) -> Column:
    """In double, as a float."""
    return (total(F.transform(e, F.abs)) / F.size(e)).cast("float")


def l2_scale(e: Column) -> Column:
    return (F.sqrt(total(F.transform(e, lambda x: x.cast("double") * x))) / F.sqrt(F.size(e))).cast("float")


def round_fp16(x: Column) -> Column:
    """The nearest binary16 value (half to even), subnormals and overflow too."""
    a = F.abs(x.cast("double"))
    e0 = F.floor(F.log2(F.greatest(a, F.lit(1e-30))))
    e = e0 - F.when(F.pow(F.lit(2.0), e0) > a, 1).otherwise(0) + F.when(F.pow(F.lit(2.0), e0 + 1) <= a, 1).otherwise(0)
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(-14), e) - 10)
    r = F.rint(a / unit) * unit
    return F.signum(x.cast("double")) * F.when(a == 0, 0.0).when(r >= 65520, float("inf")).otherwise(r)


def signs(e: Column, threshold: Column | None = None) -> Column:
    """+1 where a component is at least 0 (or its threshold), else -1; NaN gives -1."""
    bit = lambda x: F.when(~F.isnan(x) & (x >= 0), 1).otherwise(-1)
    if threshold is None:
        return F.transform(e, bit)
    return F.zip_with(e, threshold, lambda x, t: F.when(~F.isnan(x) & (x.cast("double") >= t), 1).otherwise(-1))


def sign_bytes(codes: Column) -> Column:
    """Signs as bytes (array of int), little-endian bits: bit i%8 of byte i/8."""
    return F.transform(F.sequence(F.lit(0), (F.size(codes) / 8 - 1).cast("int")), lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda a, i: a + F.when(F.get(codes, (b * 8 + i).cast("int")) > 0, F.pow(F.lit(2), i).cast("int")).otherwise(0)))


def sign_unbytes(packed: Column) -> Column:
    return F.flatten(F.transform(packed, lambda b: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(F.floor(b / F.pow(F.lit(2), i)) % 2 == 1, 1).otherwise(-1))))


def scaled_codes(e: Column, scale: Column, limit: int) -> Column:
    """clip(rint(x / scale), -limit, limit), half to even, in float as the scale is."""
    return F.transform(e, lambda x: F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), F.rint((x / scale).cast("float").cast("double")))).cast("int"))


def code_scale(e: Column, levels: int) -> Column:
    """max|x| / levels as a float; 1 for a zero vector."""
    s = (max_abs(e) / F.lit(float(levels)).cast("float")).cast("float")
    return F.when(s == 0, F.lit(1.0).cast("float")).otherwise(s)


def nibble_bytes(codes: Column) -> Column:
    """Two int4 codes a byte (array of int): dimension 2j low, 2j+1 high, two's complement."""
    part = lambda j, k: F.pmod(F.get(codes, (j * 2 + k).cast("int")), F.lit(16))
    return F.transform(F.sequence(F.lit(0), (F.size(codes) / 2 - 1).cast("int")), lambda j: part(j, 0) + 16 * part(j, 1))


def nibble_unbytes(packed: Column) -> Column:
    signed = lambda n: F.when(n >= 8, n - 16).otherwise(n)
    return F.flatten(F.transform(packed, lambda b: F.array(signed(b % 16), signed(F.floor(b / 16).cast("int")))))


def ternary(e: Column, threshold: Column | float) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.transform(e, lambda x: F.when(x.cast("double") > t, 1).when(x.cast("double") < -t, -1).otherwise(0))


def group_scales(e: Column, group: int = 16) -> Column:
    """Mean |x| of each run of ``group`` dimensions, as floats."""
    return F.transform(F.sequence(F.lit(0), (F.size(e) / group - 1).cast("int")), lambda g: mean_abs(F.slice(e, (g * group + 1).cast("int"), F.lit(group))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
