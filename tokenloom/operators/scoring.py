"""Exact late-interaction scores: sum over query tokens of a reduction over document tokens.

Token rows are nested to one row per document (one exchange by doc_idx, or none if the index
is stored so), and scored where they are: the query batch goes to the executors in blocks of
checked size, and a task multiplies whole Arrow batches of documents with a block. Empty
documents score zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDUCERS = ("best_match", "weighted_best_match", "topk2", "topk4", "smoothsim")
#: Query tokens that are sent to the executors at once.
BLOCK_TOKENS = 16_384
#: Numbers of a product of query tokens and document tokens that a task holds at a time (one document at least).
PRODUCT = 4_000_000


def check(reducer: str, temperature: float = 1.0, weighted: bool = False) -> None:
    if reducer not in REDUCERS:
        raise ValueError(f"reducer must be one of {REDUCERS}")
    if not (math.isfinite(temperature) and temperature > 0):
        raise ValueError("temperature must be finite and positive")
    if (reducer == "weighted_best_match") != weighted:
        raise ValueError("query weights go with weighted_best_match, and only with it")


def nest(tokens: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """(doc_idx, tokens: array of struct(token_pos, columns)), empty documents too."""
    nested = tokens.groupBy("doc_idx").agg(F.array_sort(F.collect_list(F.struct("token_pos", *columns))).alias("tokens"))
    return docs.select("doc_idx").join(nested, "doc_idx", "left")


def blocks(queries: DataFrame, tokens: int = BLOCK_TOKENS) -> Iterator[list]:
    """The query batch (query_idx, q_pos, q, weight) in whole queries of at most ``tokens`` tokens, one at a time on the driver."""
    part: list = []
    for row in queries.orderBy("query_idx").groupBy("query_idx").agg(F.array_sort(F.collect_list(F.struct("q_pos", "q", "weight"))).alias("q")).orderBy("query_idx").toLocalIterator():
        if part and sum(len(x.q) for x in part) + len(row.q) > tokens:
            yield part
            part = []
        part.append(row)
    if part:
        yield part


def reduce_tokens(s: np.ndarray, starts: np.ndarray, reducer: str, temperature: float) -> np.ndarray:
    """(query tokens, documents) from (query tokens, document tokens); ``starts``: first token of each document, none empty."""
    most = np.maximum.reduceat(s, starts, axis=1)
    if reducer in ("best_match", "weighted_best_match"):
        return most
    sizes = np.diff(np.r_[starts, s.shape[1]])
    if reducer == "smoothsim":
        shifted = np.exp((s - np.repeat(most, sizes, axis=1)) / temperature)
        return most + temperature * np.log(np.add.reduceat(shifted, starts, axis=1))
    k = int(reducer.removeprefix("topk"))
    return np.stack([np.sort(s[:, a : a + n], axis=1)[:, -min(k, n) :].mean(1) for a, n in zip(starts, sizes, strict=True)], axis=1)


def score(docs: DataFrame, queries: DataFrame, reducer: str = "best_match", temperature: float = 1.0, doc_scale: bool = False, top: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_idx, doc_idx, score) of every pair, or each task's ``top`` best per query, as ranked by scores of so many ``digits``.

    ``docs``: doc_idx, tokens (struct with codes and token_scale), doc_scale if asked for;
    ``queries``: query_idx, q_pos, q (numbers), weight.
    """
    check(reducer, temperature, reducer == "weighted_best_match")
    kept = docs.select("doc_idx", F.transform(F.coalesce("tokens", F.array().cast(docs.schema["tokens"].dataType)), lambda t: F.struct(t["codes"].cast("array<double>").alias("codes"), t["token_scale"].cast("double").alias("token_scale"))).alias("tokens"), (F.col("doc_scale") if doc_scale else F.lit(1.0)).alias("doc_scale"))
    out = None
    for block in blocks(queries):
        ids = np.repeat([r.query_idx for r in block], [len(r.q) for r in block])
        matrix = np.array([t.q for r in block for t in r.q], np.float64)
        weights = np.array([1.0 if t.weight is None else t.weight for r in block for t in r.q])
        one = _score_block(kept, ids, matrix, weights, reducer, temperature, top, digits)
        out = one if out is None else out.union(one)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "query_idx long, doc_idx long, score double")
    return out


def _runs(batch: pa.RecordBatch, tokens: int) -> Iterator[pa.RecordBatch]:
    """A batch of documents in runs of at most so many tokens (one document at least)."""
    ends, at = batch.column("tokens").offsets.to_numpy(), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + tokens, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _score_block(docs: DataFrame, ids: np.ndarray, matrix: np.ndarray, weights: np.ndarray, reducer: str, temperature: float, top: int | None, digits: int | None) -> DataFrame:
    send = docs.sparkSession.sparkContext.broadcast((ids, matrix, weights))
    names = ["query_idx", "doc_idx", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, weights = send.value
        queries, first = np.unique(ids, return_index=True)
        best: tuple[np.ndarray, np.ndarray] | None = None
        for batch in (part for whole in batches for part in _runs(whole, max(1, PRODUCT // max(1, len(ids))))):
            doc = batch.column("doc_idx").to_numpy()
            lists = batch.column("tokens")
            sizes = np.diff(lists.offsets.to_numpy())
            scores = np.zeros((len(queries), len(doc)))
            full = np.flatnonzero(sizes)
            if len(full):
                flat = lists.flatten()
                codes = flat.field("codes").flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
                s = matrix @ codes.T * flat.field("token_scale").to_numpy(zero_copy_only=False)[None, :]
                starts = np.r_[0, np.cumsum(sizes)[:-1]][full]
                scale = batch.column("doc_scale").to_numpy(zero_copy_only=False)[full]
                if reducer == "smoothsim":
                    s = s * np.repeat(scale, sizes[full])[None, :]
                per = reduce_tokens(s, starts, reducer, temperature) * weights[:, None]
                if reducer != "smoothsim":
                    per = per * scale[None, :]
                scores[:, full] = np.add.reduceat(per, first, axis=0)
            if top is None:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, len(doc))), pa.array(np.tile(doc, len(queries))), pa.array(scores.ravel())], names=names)
                continue
            if best is not None:
                scores, doc = np.concatenate([best[1], scores], axis=1), np.concatenate([best[0], np.broadcast_to(doc, scores.shape)], axis=1)
            else:
                doc = np.broadcast_to(doc, scores.shape)
            at = np.lexsort((doc, -(scores if digits is None else np.round(scores, digits))), axis=1)[:, :top]
            best = np.take_along_axis(doc, at, 1), np.take_along_axis(scores, at, 1)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, best[0].shape[1])), pa.array(best[0].ravel()), pa.array(best[1].ravel())], names=names)

    return docs.mapInArrow(run, "query_idx long, doc_idx long, score double")


def query_batch(query_tokens: DataFrame, vector: Column | str = "qemb", weight: Column | None = None) -> DataFrame:
    q = F.col(vector) if isinstance(vector, str) else vector
    return query_tokens.select("query_idx", "q_pos", F.transform(q, lambda x: x.cast("double")).alias("q"), (weight if weight is not None else F.lit(None)).cast("double").alias("weight"))


def override_scale(docs: DataFrame, scale: float | DataFrame) -> DataFrame:
    """``docs`` with a doc_scale for this call: one number, or a table (doc_idx, doc_scale) that must name every document."""
    docs = docs.drop("doc_scale")
    if not isinstance(scale, DataFrame):
        return docs.withColumn("doc_scale", F.lit(float(scale)))
    out = docs.join(scale.select("doc_idx", F.col("doc_scale").cast("double").alias("doc_scale")), "doc_idx", "left")
    missing = F.raise_error(F.concat(F.lit("no scale for document "), F.col("doc_idx").cast("string")))
    return out.withColumn("doc_scale", F.coalesce("doc_scale", missing.cast("double")))
