"""Top-k, rerank and cascade over scored pairs. Ties go to the lower document, or the earlier candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(scores: DataFrame, k: int, digits: int | None = None, tie: Column | str = "doc_idx") -> DataFrame:
    """Rows of the k best per query with rank from 1; a window limit that Spark applies before the exchange."""
    if k < 1:
        raise ValueError("k must be at least 1")
    by = F.round("score", digits) if digits is not None else F.col("score")
    line = Window.partitionBy("query_idx").orderBy(by.desc(), F.col(tie) if isinstance(tie, str) else tie)
    return scores.withColumn("score", by).withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)


def with_ids(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    return ranked.join(docs, "doc_idx").select("query_idx", "rank", "doc_id", "score")


def candidates(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents of a candidate set only, so that nothing else is scored."""
    return docs.join(wanted.select("doc_idx").distinct(), "doc_idx", "left_semi")


def cascade(coarse: DataFrame, fine: DataFrame, keep: int, k: int, digits: int | None = None) -> DataFrame:
    """The k best by ``fine`` among the ``keep`` best by ``coarse``."""
    if not 1 <= k <= keep:
        raise ValueError("1 <= k <= candidates must hold")
    first = top_k(coarse, keep, digits).select("query_idx", "doc_idx")
    return top_k(first.join(fine, ["query_idx", "doc_idx"]), k, digits)


def rerank(scores: DataFrame, order: DataFrame, docs: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """Candidates (pos, doc_id) by score; repeated ones count once, ties go to the earlier."""
    first = order.groupBy("doc_id").agg(F.min("pos").alias("pos"))
    known = first.join(docs, "doc_id")
    return with_ids(top_k(scores.join(known.select("doc_idx", "pos"), "doc_idx"), k, digits, "pos").drop("pos"), docs)
