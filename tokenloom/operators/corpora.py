"""Corpus builders: mixing, stress copies, nested samples, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mix(parts: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(docs, qrels) of several named corpora end to end: ids get the name before them, indexes move on.

    Sparse relevance of disjoint indexes is block-diagonal by itself. Offsets are one number a part.
    """
    docs = qrels = None
    doc_at = query_at = 0
    for name, (d, r) in parts.items():
        dd = d.select((F.col("doc_idx") + doc_at).alias("doc_idx"), F.concat(F.lit(f"{name}:"), "doc_id").alias("doc_id"))
        rr = r.select((F.col("query_idx") + query_at).alias("query_idx"), (F.col("doc_idx") + doc_at).alias("doc_idx"), "rel")
        docs, qrels = (dd, rr) if docs is None else (docs.unionByName(dd), qrels.unionByName(rr))
        doc_at += 1 + (d.agg(F.max("doc_idx")).first()[0] or 0)
        query_at += 1 + (r.agg(F.max("query_idx")).first()[0] or 0)
    return docs, qrels


def positives(docs: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    held = qrels.filter("rel > 0").select("doc_idx").distinct()
    return docs.join(held, "doc_idx", "left_semi"), docs.join(held, "doc_idx", "left_anti")


def numbered(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """Row numbers from 0 over a total order without one task for all: ranges are numbered by
    themselves and moved by the sizes of those before (one row a range)."""
    from ..functions.frames import global_row_number

    return global_row_number(df, order, name)


def stress(docs: DataFrame, qrels: DataFrame, target: int) -> DataFrame:
    """``target`` documents: all with relevance, then others in order, then the others again as copies without relevance."""
    good, other = positives(docs, qrels)
    n_good, n_other = good.count(), other.count()
    if target < n_good:
        raise ValueError("target is under the number of relevant documents")
    want = target - n_good
    fill = numbered(other, "doc_idx")
    if want > n_other:
        if not n_other:
            raise ValueError("no document to repeat")
        rounds = -(-want // n_other)
        fill = fill.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("n", F.col("round") * n_other + F.col("n"))
    else:
        fill = fill.withColumn("round", F.lit(0))
    fill = fill.filter(F.col("n") < want)
    out_at = F.col("n") + n_good
    fill = fill.select("doc_idx", F.when(F.col("round") > 0, F.concat("doc_id", F.lit(":stress-"), out_at.cast("string"))).otherwise(F.col("doc_id")).alias("doc_id"), (F.col("round") > 0).alias("copy"))
    return good.select("doc_idx", "doc_id", F.lit(False).alias("copy")).union(fill)


def nested_plan(docs: DataFrame, qrels: DataFrame, sizes: list[int], seed: int = 17) -> DataFrame:
    """(size, position, doc_idx): samples that contain each other; relevant documents first, then
    by a keyed hash, so a sample never depends on the sizes asked for."""
    good, other = positives(docs, qrels)
    key = lambda label: F.sha2(F.concat_ws("\x1f", F.lit(label), F.lit(str(seed)), F.col("doc_id"), F.col("doc_idx").cast("string")), 256)
    order = good.select("doc_idx", F.lit(0).alias("tier"), key("relevant").alias("k")).union(other.select("doc_idx", F.lit(1).alias("tier"), key("distractor").alias("k")))
    order = numbered(order, "tier", "k", name="position")
    return order.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).filter("position < size").select("size", "position", "doc_idx")


def dedupe(rows: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key with a dense number in order of first sight."""
    first = rows.groupBy(key).agg(F.min(order).alias("first_row"), F.count("*").alias("copies"))
    return numbered(first, "first_row", name="doc_idx")


def text_corpus(rows: DataFrame) -> DataFrame:
    """Title and text to one string: ``title. text``, trimmed; either may be missing."""
    title, text = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("text", F.lit("")))
    return rows.withColumn("body", F.when(title == "", text).when(text == "", title).otherwise(F.concat(title, F.lit(". "), text)))


def offsets(lengths: DataFrame) -> DataFrame:
    """First token of each document (doc_idx, n_tokens) in the flat order of a ragged corpus."""
    from ..functions.frames import running_total

    return running_total(lengths, ["doc_idx"], "n_tokens", "first_token")


def chunks(lengths: DataFrame, budget: int) -> DataFrame:
    """(doc_idx, n_tokens, chunk): documents in order, whole, up to a budget of tokens a chunk.

    Ranges of documents are cut on their own, in one pass each, so a chunk ends at the end of a range too.
    """
    import pandas as pd

    from ..functions.frames import by_range

    def run(frames):
        chunk, used = 0, 0
        for frame in frames:
            out = []
            for n in frame["n_tokens"]:
                if used and used + n > budget:
                    chunk, used = chunk + 1, 0
                used += n
                out.append(chunk)
            yield pd.DataFrame({"doc_idx": frame["doc_idx"], "n_tokens": frame["n_tokens"], "chunk": frame["part"].astype("int64") * (1 << 32) + pd.Series(out, index=frame.index, dtype="int64")})

    dealt = by_range(lengths.select("doc_idx", "n_tokens"), ["doc_idx"])
    return dealt.sortWithinPartitions("part", "doc_idx").mapInPandas(run, "doc_idx long, n_tokens long, chunk long")
