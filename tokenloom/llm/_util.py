"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a session on one machine may leave it unset; a temporary one is made there."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tokenloom-checkpoint-")
        context.setCheckpointDir(folder)
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch that goes to a Python worker; by rows alone a batch of long texts has no bound.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded in bytes (as it says itself, else BATCH_BYTES)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df


def names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that clash with none of ``df``'s, one for each wanted name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Bits of a filter for each of its keys, and most words (of 64 bits) of a filter: rows of 16 bytes, so a broadcast of
#: one is at most 16 MB of data. More than 4 million keys only mean more false hits, which all callers settle exactly.
FILTER_BITS = 16
FILTER_WORDS = 1 << 20


def _places(h: Column, words: int) -> tuple[Column, Column]:
    """(the word of a key of 64 bits, its four bits there)."""
    mask = F.lit(0).cast("long")
    for k in range(4):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return F.pmod(F.shiftright(h, 24), F.lit(words)), mask


def may_hold(df: DataFrame, h: Column, keys: DataFrame, out_col: str) -> DataFrame:
    """``df`` with a column more: false where hash ``h`` is surely not among ``keys`` (one column of hashes, materialised).

    The keys travel as a filter whose size is bounded; no row of ``df`` is shuffled.
    """
    (key,) = keys.columns
    n, words = keys.count(), 1 << 10
    if not n:
        return df.withColumn(out_col, F.lit(False))
    while words < FILTER_WORDS and words * 64 < n * FILTER_BITS:
        words *= 2
    slot, bits, hashed = names(df, "slot", "bits", "hashed")
    at, mask = _places(quoted(key), words)
    held = keys.select(at.alias(slot), mask.alias(bits)).groupBy(slot).agg(F.bit_or(bits).alias(bits))
    # The hash is a column, so that it is made once.
    at, mask = _places(quoted(hashed), words)
    marked = df.withColumn(hashed, h).withColumn(slot, at).join(F.broadcast(held), slot, "left")
    return marked.withColumn(out_col, F.coalesce(quoted(bits).bitwiseAND(mask) == mask, F.lit(False))).drop(slot, bits, hashed)


def flag_by_ids(df: DataFrame, id_col: str, ids: DataFrame, out_col: str) -> DataFrame:
    """``df`` with a column more: whether the row's id is one of ``ids`` (one column, materialised). Nulls are equal.

    A filter of the ids finds the rows; a second filter, of ids that only seem to be among
    them, clears these. Rows that hit both, some thousandths, are joined; no other is shuffled.
    """
    maybe, seeming, other = names(df, "maybe", "seeming", "other")
    columns, key = [quoted(c) for c in df.columns], quoted(id_col)
    ids = cut(ids.select(quoted(ids.columns[0]).alias(other)).distinct())
    hashes = ids.select(F.xxhash64(quoted(other)).alias("h"))
    marked = may_hold(df, F.xxhash64(key), hashes, maybe)
    met = may_hold(df.select(key), F.xxhash64(key), hashes, maybe).filter(quoted(maybe)).select(key).distinct()
    false = cut(met.join(ids, key.eqNullSafe(quoted(other)), "left_anti").select(F.xxhash64(key, F.lit(1)).alias("h")))
    if false.isEmpty():
        return marked.withColumnRenamed(maybe, out_col)
    marked = may_hold(marked, F.xxhash64(key, F.lit(1)), false, seeming)
    doubt = quoted(maybe) & quoted(seeming)
    sure = marked.filter(~doubt).select(*columns, quoted(maybe).alias(out_col))
    settled = marked.filter(doubt).select(*columns).join(ids.withColumn(maybe, F.lit(True)), key.eqNullSafe(quoted(other)), "left")
    return sure.union(settled.select(*columns, quoted(maybe).isNotNull().alias(out_col)))


#: Groups that are broadcast at most: those that hold over one in so many rows.
HEAVY_GROUPS = 4096


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` left joined with ``groups`` (one row a ``key``; ``size``: how many of the rows it has). Both are materialised.

    A group of over a 4096th of all rows is broadcast, there are fewer than 4096; so no key of the shuffled join is hot.
    """
    most = max(1, rows.count() // HEAVY_GROUPS)
    heavy = groups.filter(quoted(size) > most)
    (light,) = names(groups, "light")
    met = rows.join(F.broadcast(heavy.withColumn(light, F.lit(False))), key, "left")
    columns = [quoted(c) for c in met.columns if c != light]
    alone = met.filter(quoted(light).isNull()).select(*(quoted(c) for c in rows.columns))
    return met.filter(quoted(light).isNotNull()).select(*columns).union(alone.join(groups.filter(quoted(size) <= most), key, "left").select(*columns))


def without_dropped(df: DataFrame, id_col: str, mark: Column, decided: DataFrame) -> DataFrame:
    """``df`` without the rows that ``decided`` (id, mark, kept; materialised; each row in a group of several) drops.

    As a rule an id is of one row, and rows go by their ids, unshuffled. Only where an id is of dropped and other rows,
    the mark of its rows is made and tells them; equal rows are one before they are shuffled.
    """
    known, key, stays, rows_col, gone_col, goes = names(df, "known", "mark", "stays", "rows", "gone", "goes")
    columns = [quoted(c) for c in df.columns]
    dropped = cut(decided.filter("NOT kept").groupBy(F.col("id").alias(known)).agg(F.count("*").alias(gone_col)))
    rows = flag_by_ids(df.select(quoted(id_col)), id_col, dropped.select(known), goes).filter(quoted(goes)).groupBy(quoted(id_col).alias("id")).agg(F.count("*").alias(rows_col))
    mixed = cut(rows.join(dropped, F.col("id").eqNullSafe(F.col(known))).filter(F.col(rows_col) > F.col(gone_col)).select(known))
    flagged = flag_by_ids(df, id_col, dropped.select(known), goes)
    no = flagged.filter(~quoted(goes)).select(*columns)
    if mixed.isEmpty():
        return no
    unclear = flag_by_ids(df, id_col, mixed, goes).filter(quoted(goes)).select(*columns)
    groups = decided.groupBy(F.col("id").alias(known), F.col("mark").alias(key)).agg(F.max(F.col("kept")).alias(stays))
    (own,) = names(df.select("*", F.lit(0).alias(key)), "own")
    unclear = unclear.withColumn(own, mark)
    # A row whose mark is decided stays once if its group keeps this id; a row of no group of several stays.
    met = unclear.join(groups, (quoted(own) == quoted(key)) & quoted(id_col).eqNullSafe(quoted(known)), "left")
    alone = met.filter(quoted(stays).isNull()).select(*columns)
    one = unclear.dropDuplicates([own, id_col]).join(groups.filter(quoted(stays)), (quoted(own) == quoted(key)) & quoted(id_col).eqNullSafe(quoted(known)), "left_semi")
    return no.union(alone).union(one.select(*columns))
