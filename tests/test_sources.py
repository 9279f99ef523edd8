"""Datasets, archives, resumable writes and overrides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.index import Index, Reranker
from tokenloom.operators import corpora, packing, scoring
from tokenloom.sources import datasets, views


def archive(path, **more):
    rng = np.random.default_rng(6)
    parts = {"doc_embeddings": rng.normal(size=(5, 8)).astype(np.float32), "doc_offsets": np.array([0, 2, 2, 5]), "query_embeddings": rng.normal(size=(2, 3, 8)).astype(np.float32), "qrels": np.array([[0, 0, 2.0], [1.0, 0, 0]])}
    parts = {k: v for k, v in (parts | more).items() if v is not None}
    np.savez(path, **parts)
    return parts


def test_npz_round_trip(spark, tmp_path):
    parts = archive(tmp_path / "a.npz")
    t = datasets.read_npz(spark, str(tmp_path / "a.npz"))
    assert [r.doc_id for r in t.docs.orderBy("doc_idx").collect()] == ["doc-0", "doc-1", "doc-2"]
    assert [(r.doc_idx, r.token_pos) for r in t.doc_tokens.orderBy("doc_idx", "token_pos").collect()] == [(0, 0), (0, 1), (2, 0), (2, 1), (2, 2)]
    assert sorted(tuple(r) for r in t.qrels.collect()) == [(0, 2, 2.0), (1, 0, 1.0)]
    datasets.write(t, str(tmp_path / "d"))
    again = datasets.read(spark, str(tmp_path / "d"))
    got = np.array([r.qemb for r in again.query_tokens.orderBy("query_idx", "q_pos").collect()], np.float32).reshape(2, 3, 8)
    assert np.array_equal(got, parts["query_embeddings"])
    with pytest.raises(Exception, match="offsets"):
        archive(tmp_path / "b.npz", doc_offsets=np.array([0, 3, 2, 5]))
        datasets.read_npz(spark, str(tmp_path / "b.npz")).doc_tokens.collect()
    archive(tmp_path / "c.npz", qrels=None, relevant_doc_ids=np.array([2, 0]))
    assert sorted(tuple(r) for r in datasets.read_npz(spark, str(tmp_path / "c.npz")).qrels.collect()) == [(0, 2, 1.0), (1, 0, 1.0)]


def test_write_once(spark, tmp_path):
    df, path = spark.range(5), str(tmp_path / "w")
    assert datasets.write_once(df, path, {"a": 1}) and not datasets.write_once(df, path, {"a": 1})
    assert datasets.write_once(df, path, {"a": 2}) and spark.read.parquet(f"{path}/data").count() == 5


def test_overrides(spark):
    t = views.load(spark, "/root/testdata/sf0.001")
    nested = scoring.nest(packing.pack_signs(t.doc_tokens), t.docs, "codes", "token_scale")
    batch = scoring.query_batch(t.query_tokens)
    plain = {(r.query_idx, r.doc_idx): r.score for r in scoring.score(nested, batch).collect()}
    twice = scoring.score(scoring.override_scale(nested, 2.0), batch, doc_scale=True).collect()
    assert all(abs(r.score - 2 * plain[r.query_idx, r.doc_idx]) < 1e-9 for r in twice)
    some = t.docs.filter("doc_idx > 0").select("doc_idx", F.lit(1.0).alias("doc_scale"))
    with pytest.raises(Exception, match="no scale"):
        scoring.score(scoring.override_scale(nested, some), batch, doc_scale=True).collect()


def test_chunks_keep_documents_whole(spark):
    rng = np.random.default_rng(9)
    n = rng.integers(0, 30, 500)
    rows = corpora.chunks(spark.createDataFrame([(i, int(v)) for i, v in enumerate(n)], "doc_idx long, n_tokens long"), 64).orderBy("doc_idx").collect()
    assert len(rows) == 500 and [r.chunk for r in rows] == sorted(r.chunk for r in rows)
    sums = {}
    for r in rows:
        sums[r.chunk] = sums.get(r.chunk, 0) + r.n_tokens
    assert max(sums.values()) <= 64 and len(sums) < 1.4 * n.sum() / 64


def test_int8_queries(spark):
    t = views.load(spark, "/root/testdata/sf0.001")
    r = Reranker(Index.from_tokens(t.docs, t.doc_tokens))
    a, b = ({(x.query_idx, x.doc_id): x.score for x in r.search(t.query_tokens, k=5, int4_query=q).collect()} for q in ("float", "int8"))
    assert len(set(a) & set(b)) > 0.8 * len(a) and all(abs(a[k] - b[k]) < 0.05 for k in set(a) & set(b))
    with pytest.raises(ValueError):
        r.search(t.query_tokens, int4_query="int2")
