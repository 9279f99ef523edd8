"""Operators against NumPy, literal fixtures, and the index facade."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import vectors as V
from tokenloom.index import Index, Reranker
from tokenloom.operators import corpora, metrics, packing, pooling, scoring, search
from tokenloom.sources import views

DOCS = {0: 1, 1: 2, 2: 0, 3: 4}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(731)
    rows, mats = [], {}
    for doc, n in DOCS.items():
        mats[doc] = rng.normal(size=(n, 8)).astype(np.float32)
        rows += [(doc, p, [float(x) for x in v]) for p, v in enumerate(mats[doc])]
    tokens = spark.createDataFrame(rows, "doc_idx long, token_pos long, emb array<float>")
    docs = spark.createDataFrame([(d, f"doc-{d}") for d in DOCS], "doc_idx long, doc_id string")
    q = rng.normal(size=(2, 3, 8)).astype(np.float32)
    w = [1.0, -0.5, 0.25]
    queries = spark.createDataFrame([(i, j, [float(x) for x in q[i, j]], w[j]) for i in range(2) for j in range(3)], "query_idx long, q_pos long, qemb array<float>, weight double")
    return tokens, docs, queries, mats, q.astype(np.float64), np.array(w)


def expected(mats, q, reducer, w, tau=0.7):
    out = {}
    for i in range(len(q)):
        for d, m in mats.items():
            s = q[i] @ m.astype(np.float64).T
            if not len(m):
                out[i, d] = 0.0
            elif reducer in ("best_match", "weighted_best_match"):
                out[i, d] = float((s.max(1) * (w if reducer[0] == "w" else 1)).sum())
            elif reducer == "smoothsim":
                out[i, d] = float((tau * np.log(np.exp(s / tau).sum(1))).sum())
            else:
                out[i, d] = float(np.sort(s, 1)[:, -int(reducer[4:]) :].mean(1).sum())
    return out


@pytest.mark.parametrize("reducer", scoring.REDUCERS)
def test_reducers(data, reducer):
    tokens, docs, queries, mats, q, w = data
    nested = scoring.nest(PACK_DENSE(tokens), docs, "codes", "token_scale")
    weighted = reducer == "weighted_best_match"
    got = scoring.score(nested, scoring.query_batch(queries, weight=F.col("weight") if weighted else None), reducer, 0.7 if reducer == "smoothsim" else 1.0).collect()
    want = expected(mats, q, reducer, w)
    assert len(got) == len(want)
    assert all(abs(r.score - want[r.query_idx, r.doc_idx]) < 1e-5 for r in got)


def PACK_DENSE(t):
    return t.withColumn("codes", F.col("emb")).withColumn("token_scale", F.lit(1.0))


def test_query_blocks_give_the_same(data):
    tokens, docs, queries, *_ = data
    nested = scoring.nest(PACK_DENSE(tokens), docs, "codes", "token_scale")
    batch = scoring.query_batch(queries)
    parts = list(scoring.blocks(batch, 3))
    assert [len(p) for p in parts] == [1, 1] and len(scoring.score(nested, batch).collect()) == 8


def test_smoothsim_does_not_overflow(data):
    tokens, docs, queries, *_ = data
    nested = scoring.nest(PACK_DENSE(tokens), docs, "codes", "token_scale")
    big = queries.withColumn("qemb", F.transform("qemb", lambda x: x * 1e6))
    assert all(np.isfinite(r.score) for r in scoring.score(nested, scoring.query_batch(big), "smoothsim", 0.01).collect())


def test_bit_layout_and_nibbles(spark):
    t = spark.createDataFrame([([-1.0, 0.0, 2.0, -3.0, 4.0, -5.0, 6.0, -7.0],)], "emb array<float>")
    row = packing.pack_int4(packing.pack_signs(t).withColumn("bytes", V.sign_bytes(F.col("codes"))).drop("codes", "token_scale")).select("bytes", "codes", V.nibble_unbytes(V.nibble_bytes(F.col("codes"))).alias("back")).first()
    assert row.bytes == [0b01010110] and row.codes == [-1, 0, 2, -3, 4, -5, 6, -7] == row.back


def test_int4_scales(spark):
    t = spark.createDataFrame([(0, [0.0] * 8), (1, [14.0, -14.0] * 4), (2, [0.7, -0.7] * 4)], "k int, emb array<float>")
    assert [round(r.token_scale, 6) for r in packing.pack_int4(t).orderBy("k").collect()] == [1.0, 2.0, 0.1]


def test_fp16(spark):
    x = np.r_[np.random.default_rng(13).normal(size=200), 0.0, 65504, 65519, 65520, 6e-8, 2.0**-24, -1.5, 1e-9].astype(np.float32)
    got = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(V.round_fp16(F.col("x"))).collect()]
    with np.errstate(over="ignore"):
        assert np.array_equal(np.array(got), x.astype(np.float16).astype(np.float64))


def test_validation(spark, data):
    tokens, docs, queries, *_ = data
    with pytest.raises(ValueError, match="divisible by 8"):
        packing.require(spark.createDataFrame([([1.0] * 7,)], "emb array<float>"))
    for args in (("nosuch", 1.0, False), ("best_match", 0.0, False), ("weighted_best_match", 1.0, False), ("best_match", 1.0, True)):
        with pytest.raises(ValueError):
            scoring.check(*args)
    with pytest.raises(ValueError):
        Index.from_tokens(docs, tokens, "nosuch")
    with pytest.raises(ValueError):
        pooling.pool(tokens, 0)
    with pytest.raises(ValueError):
        search.cascade(None, None, 2, 3)


@pytest.mark.parametrize("mode", ["auto", "binary", "balanced", "compact", "binary_token_scale_u8", "max_compression", "binary_q40", "int4", "int4_residual", "ternary", "int8", "dense"])
def test_index_round_trip(spark, data, tmp_path, mode):
    tokens, docs, queries, *_ = data
    index = Index.from_tokens(docs, tokens, mode)
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    assert again.mode == index.mode and again.num_docs == 4 and again.memory_report()["encoded_bytes"] > 0
    a, b = (sorted((r.query_idx, r.rank, r.doc_id, round(r.score, 6)) for r in Reranker(x).search(queries, k=3).collect()) for x in (index, again))
    assert a == b and len(a) == 6


def test_cascade_with_all_candidates_is_exact(data):
    tokens, docs, queries, *_ = data
    r = Reranker(Index.from_tokens(docs, tokens, "int4_residual"))
    plain, staged = ([(x.query_idx, x.rank, x.doc_id) for x in y.orderBy("query_idx", "rank").collect()] for y in (r.search(queries, k=2), r.search(queries, k=2, rescore_candidates=4)))
    assert plain == staged
    with pytest.raises(ValueError):
        Reranker(Index.from_tokens(docs, tokens, "binary")).search(queries, rescore_candidates=2)


def test_rerank(data):
    tokens, docs, queries, *_ = data
    r = Reranker(Index.from_tokens(docs, tokens, "binary"))
    got = r.rerank(queries, ["doc-3", "doc-1", "doc-1"], k=5).collect()
    assert len(got) == 4 and {x.doc_id for x in got} == {"doc-3", "doc-1"}
    with pytest.raises(KeyError):
        r.rerank(queries, ["none"])
    assert r.rerank(queries, []).count() == 0


def test_ties_go_to_the_lower_document(spark):
    s = spark.createDataFrame([(0, 2, 8.0), (0, 0, 8.0), (0, 1, 8.0)], "query_idx long, doc_idx long, score double")
    assert [r.doc_idx for r in search.top_k(s, 2).orderBy("rank").collect()] == [0, 1]


def test_ward_pooling():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 16)) * 5
    x = (np.repeat(centres, 4, 0) + rng.normal(size=(12, 16)) * 0.01).astype(np.float32)
    labels = pooling.ward_labels(x / np.linalg.norm(x, axis=1, keepdims=True), 3)
    assert len(set(labels)) == 3 and all(len(set(labels[i : i + 4])) == 1 for i in (0, 4, 8))
    assert pooling.pool_matrix(x, 4).shape == (3, 16) and pooling.pool_matrix(x, 1) is x


def test_builders(spark, data):
    _, docs, *_ = data
    qrels = spark.createDataFrame([(0, 1, 1.0), (0, 3, 2.0)], "query_idx long, doc_idx long, rel double")
    stressed = corpora.stress(docs, qrels, 7).collect()
    assert len(stressed) == 7 and sorted(r.doc_id for r in stressed if r.copy) == ["doc-0:stress-4", "doc-0:stress-6", "doc-2:stress-5"]
    with pytest.raises(ValueError):
        corpora.stress(docs, qrels, 1)
    plan = corpora.nested_plan(docs, qrels, [2, 3]).collect()
    small, large = ({r.doc_idx for r in plan if r["size"] == n} for n in (2, 3))
    assert small == {1, 3} and small < large


def test_metrics(spark):
    ranked = spark.createDataFrame([(0, 5, 1), (0, 1, 2)], "query_idx long, doc_idx long, rank int")
    qrels = spark.createDataFrame([(0, 1, 2.0), (0, 9, 1.0), (1, 3, 1.0)], "query_idx long, doc_idx long, rel double")
    got = {r.query_idx: r for r in metrics.per_query(ranked, qrels, 10).collect()}
    assert got[0].recall == 0.5 and got[0].mrr == 0.5 and abs(got[0].ndcg - (3 / np.log2(3)) / (3 + 1 / np.log2(3))) < 1e-9
    assert got[1].ndcg == 0.0


def test_registered_queries_have_matching_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 80


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_products_are_bounded(spark, monkeypatch):
    """Scores and each task's best are the same whatever is multiplied at a time."""
    t = views.load(spark, "/root/testdata/sf0.001")
    nested = scoring.nest(packing.pack_signs(t.doc_tokens), t.docs, "codes", "token_scale")
    batch = scoring.query_batch(t.query_tokens)
    rows = lambda df: sorted((r.query_idx, r.doc_idx, round(r.score, 9)) for r in df.collect())
    whole, best = rows(scoring.score(nested, batch)), rows(search.top_k(scoring.score(nested, batch, top=3, digits=6), 3))
    monkeypatch.setattr(scoring, "PRODUCT", 40)
    assert rows(scoring.score(nested, batch)) == whole
    assert rows(search.top_k(scoring.score(nested, batch, top=3, digits=6), 3)) == best


def test_centroid_query_transform_keeps_the_sign_of_zero(spark, tmp_path):
    """Bit for bit as its SQL, where small negative components round to -0.0."""
    import duckdb

    from tokenloom import registry

    rng = np.random.default_rng(41)
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(rng.choice([-0.5, -1e-7, -0.0, 0.0, 1e-7, 0.5], (200, 8)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(f"SELECT * FROM ({registry.SQL['centroid_query_transform']}) ORDER BY 1, 2").fetchall()
    got = registry.QUERIES["centroid_query_transform"](spark, str(tmp_path)).orderBy("query_idx", "q_pos").collect()
    assert [[*map(repr, r.q)] for r in got] == [[*map(repr, r[2])] for r in want] and any("-0.0" in map(repr, r[2]) for r in want)
