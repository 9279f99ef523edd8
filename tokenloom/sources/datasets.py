"""Retrieval datasets: four Parquet tables, an importer for NumPy archives, and writes that can be resumed."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Tables

PARTS = ("docs", "doc_tokens", "query_tokens", "qrels")


def write(tables: Tables, path: str) -> None:
    for name in PARTS:
        getattr(tables, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> Tables:
    """The tables of a dataset, checked: unique document ids, vectors of one length."""
    t = Tables(*(spark.read.parquet(f"{path}/{name}") for name in PARTS))
    ids = t.docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if not ids.n or ids.n != ids.d:
        raise ValueError("document ids must be present and unique")
    sizes = t.doc_tokens.select(F.size("emb").alias("n")).union(t.query_tokens.select(F.size("qemb").alias("n"))).agg(F.min("n").alias("a"), F.max("n").alias("b")).first()
    if sizes.a != sizes.b:
        raise ValueError("documents and queries must have vectors of one length")
    return t


def offsets_checked(offsets: np.ndarray, tokens: int) -> np.ndarray:
    if offsets.ndim != 1 or len(offsets) < 2 or not np.issubdtype(offsets.dtype, np.integer) or offsets[0] != 0 or offsets[-1] != tokens or (np.diff(offsets) < 0).any():
        raise ValueError("offsets must be whole, begin at 0, not decrease and end at the number of tokens")
    return offsets


def read_npz(spark: SparkSession, path: str) -> Tables:
    """Import an archive of doc_embeddings, doc_offsets, query_embeddings (2-D with query_offsets, or 3-D) and qrels or relevant_doc_ids.

    Spark reads the file, so it may lie in any store; it is unpacked by one task, as one archive
    must be. Ids default to doc-{i} and query-{i}.
    """
    raw = spark.read.format("binaryFile").load(path).select("content")

    def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
        for frame in frames:
            for content in frame["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as f:
                    yield {k: f[k] for k in f.files}

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in unpacked(frames):
            docs = f["doc_embeddings"]
            at = offsets_checked(f["doc_offsets"], len(docs))
            n = np.diff(at)
            yield pd.DataFrame({"doc_idx": np.repeat(np.arange(len(n)), n), "token_pos": np.arange(len(docs)) - np.repeat(at[:-1], n), "emb": list(docs.astype(np.float32))})

    def queries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in unpacked(frames):
            q = f["query_embeddings"]
            if q.ndim == 3:
                flat, at = q.reshape(-1, q.shape[2]), np.arange(0, q.shape[0] * q.shape[1] + 1, q.shape[1])
            else:
                flat, at = q, offsets_checked(f["query_offsets"], len(q)) if "query_offsets" in f else np.arange(len(q) + 1)
            n = np.diff(at)
            yield pd.DataFrame({"query_idx": np.repeat(np.arange(len(n)), n), "q_pos": np.arange(len(flat)) - np.repeat(at[:-1], n), "qemb": list(flat.astype(np.float32))})

    def docs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in unpacked(frames):
            n = len(f["doc_offsets"]) - 1
            yield pd.DataFrame({"doc_idx": np.arange(n), "doc_id": [str(x) for x in f["doc_ids"]] if "doc_ids" in f else [f"doc-{i}" for i in range(n)]})

    def qrels(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in unpacked(frames):
            if "qrels" in f:
                q, d = np.nonzero(f["qrels"] > 0)
                yield pd.DataFrame({"query_idx": q, "doc_idx": d, "rel": f["qrels"][q, d].astype(np.float64)})
            elif "relevant_doc_ids" in f:
                r = f["relevant_doc_ids"]
                yield pd.DataFrame({"query_idx": np.arange(len(r)), "doc_idx": r.astype(np.int64), "rel": np.ones(len(r))})
            else:
                raise ValueError("the archive has neither qrels nor relevant_doc_ids")

    return Tables(
        raw.mapInPandas(docs, "doc_idx long, doc_id string"),
        raw.mapInPandas(tokens, "doc_idx long, token_pos long, emb array<float>"),
        raw.mapInPandas(queries, "query_idx long, q_pos long, qemb array<float>"),
        raw.mapInPandas(qrels, "query_idx long, doc_idx long, rel double"),
    )


def write_once(df: DataFrame, path: str, fingerprint: dict) -> bool:
    """Write ``df`` unless a finished write with the same fingerprint is there. Whether it wrote.

    The note is written last, so a write that broke off is never taken for a finished one.
    """
    spark, note = df.sparkSession, json.dumps(fingerprint, sort_keys=True)
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/note")
    if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files) and [r.value for r in spark.read.text(f"{path}/note").collect()] == [note]:
        return False
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/note")
    return True
