"""Exact deduplication by progressive refinement.

Three steps, each over what the one before leaves in groups of several: the length of the
normalised text; a hash of that length and the first characters; the hash of the full text. What survives a step goes back to the next scan as a filter of bounded size, so no text is
ever shuffled; the groups themselves are aggregates of lengths or hashes, combined before
the exchange, so a text with any number of copies is one row from each task. Rows meet large
groups by a bounded broadcast.

Defined results: a null text is empty; texts are compared after every run of ASCII white
space became one space; ids that are null sort last, and keep_id is null only if all ids of
a group are; rows that repeat both id and text are copies like any other, of which one
(the first read) is kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import cut, join_groups, may_hold, names, quoted, table, without_dropped

#: Characters of a text that the second step hashes.
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def several(keys: DataFrame) -> DataFrame:
    """What occurs more than once in a column of hashes."""
    (key,) = keys.columns
    return cut(keys.groupBy(key).count().filter("count > 1").select(key))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """``df``'s columns without the text, plus keep_id, group_size, kept and text_sha256 (in place of any so called).

    text_sha256 is null for texts that the cheaper steps have shown to be alone, unless
    ``hash_all`` asks for it.
    """
    rest = [c for c in df.columns if c not in (text_col, "keep_id", "group_size", "kept", "text_sha256")]
    row, norm, met, full, first_col, size = names(df, "row", "norm", "met", "full", "first", "size")
    read = df.select(*(quoted(c) for c in rest), normalised(quoted(text_col)).alias(norm))
    by_length = F.xxhash64(F.length(quoted(norm)))
    by_prefix = F.xxhash64(F.length(quoted(norm)), F.substring(quoted(norm), 1, PREFIX_CHARS))
    # Step 1: lengths.
    lengths = several(read.select(by_length.alias("h")))
    # Step 2: hashed prefixes, of texts whose length is not alone.
    prefixes = several(may_hold(read.select(quoted(norm)), by_length, lengths, met).filter(quoted(met)).select(by_prefix.alias("h")))
    # Step 3: the full hash, of texts whose prefix is not alone.
    sha = F.sha2(quoted(norm), 256)
    marked = may_hold(read, by_prefix, prefixes, met)
    signed = cut(marked.select(*(quoted(c) for c in rest), F.monotonically_increasing_id().alias(row), quoted(met), (sha if hash_all else F.when(quoted(met), sha)).alias(full)))
    # A group's first row by id (nulls last), then by place; only groups of several come back.
    first = F.struct(quoted(id_col).isNull().alias("a"), quoted(id_col).alias("b"), quoted(row).alias("c"))
    groups = cut(signed.filter(quoted(met)).groupBy(quoted(full)).agg(F.min(first).alias(first_col), F.count("*").alias(size)).filter(quoted(size) > 1))
    out = join_groups(signed, groups, full, size)
    alone = quoted(size).isNull()
    return out.select(
        *(quoted(c) for c in rest),
        F.when(alone, quoted(id_col)).otherwise(quoted(first_col)["b"]).alias("keep_id"),
        F.coalesce(quoted(size), F.lit(1)).cast("long").alias("group_size"),
        (alone | (quoted(first_col)["c"] == quoted(row))).alias("kept"),
        quoted(full).alias("text_sha256"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that exact_dedup() keeps. Only texts that may have copies are hashed in full, and none is shuffled unless its id repeats."""
    signed = exact_dedup(df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")), "id")
    decided = cut(signed.filter("group_size > 1").select("id", F.col("text_sha256").alias("mark"), "kept"))
    return without_dropped(df, id_col, F.sha2(normalised(quoted(text_col)), 256), decided)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), hash_all=True)


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
SQL = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """
}
