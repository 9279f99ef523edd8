"""Evaluation layer, pooling variants, rotation, adapters and the query stream."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import frames, text
from tokenloom.functions.quantiles import quantiles
from tokenloom.index import Index
from tokenloom.operators import experiments, metrics
from tokenloom.streaming.queries import search_stream


def test_sign_test(spark):
    rows = [(0, 0), (3, 0), (5, 5), (267, 425), (9000, 9400)]
    got = [r[0] for r in spark.createDataFrame(rows, "w long, l long").select(experiments.sign_test(F.col("w"), F.col("l"))).collect()]
    for (w, losses), p in zip(rows, got, strict=True):
        n = w + losses
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(w, losses) + 1)) / 2**n) if n < 2000 else None
        assert want is None and 0 < p < 0.01 or abs(p - want) < 1e-9


def test_bootstrap_covers_the_mean(spark):
    x = np.random.default_rng(4).normal(0.1, 1, 400)
    row = experiments.bootstrap(spark.createDataFrame([(float(v),) for v in x], "delta double"), samples=800).first()
    half = 1.96 * x.std() / 20
    assert abs(row.low - (x.mean() - half)) < 0.04 and abs(row.high - (x.mean() + half)) < 0.04


def test_normalise_results(spark):
    docs = spark.createDataFrame([(0, "a"), (1, "b")], "doc_idx long, doc_id string")
    rows = spark.createDataFrame([(0, "b", 1.0), (0, "0", float("inf")), (1, "0", 2.0)], "query_idx long, name string, score double")
    assert sorted(tuple(r) for r in experiments.normalise_results(rows, docs).collect()) == [(0, 1, 1.0), (1, 0, 2.0)]
    with pytest.raises(Exception, match="unknown document"):
        experiments.normalise_results(rows.withColumn("name", F.lit("zz")), docs).collect()


def test_pool_variants_keep_the_mass(spark):
    rng = np.random.default_rng(1)
    rows = [(d, p, [float(v) for v in rng.normal(size=8)]) for d in range(3) for p in range(9)]
    tokens = spark.createDataFrame(rows, "doc_idx long, token_pos long, emb array<float>")
    for kind in ("weighted", "protected", "plain"):
        mass = {r.doc_idx: r.m for r in experiments.pool_variant(tokens, 3, kind).groupBy("doc_idx").agg(F.sum("mass").alias("m")).collect()}
        assert mass == {0: 9, 1: 9, 2: 9}
    with pytest.raises(ValueError):
        experiments.pool_variant(tokens, 3, "odd")


def test_rotation_is_orthogonal_and_helps(spark):
    rng = np.random.default_rng(2)
    rows = [(0, i, [float(v) for v in np.r_[rng.normal(), np.zeros(7)] + 0.01 * rng.normal(size=8)]) for i in range(60)]
    tokens = spark.createDataFrame(rows, "doc_idx long, token_pos long, emb array<float>")
    r = experiments.fit_rotation(tokens, steps=15)
    assert np.allclose(r @ r.T, np.eye(8), atol=1e-9)
    x = np.array([v for _, _, v in rows])
    assert np.abs(x @ r).sum() > 1.5 * np.abs(x).sum()
    turned = np.array([t.emb for t in experiments.rotate(tokens, r).orderBy("token_pos").collect()])
    assert np.allclose(turned, x @ r, atol=1e-5)


def test_frames(spark):
    df = spark.range(0, 1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    assert [r.n for r in frames.global_row_number(df, ["x"], "n").orderBy("x").collect()] == list(range(1000))
    got = frames.running_total(df.withColumn("v", F.col("x") % 5), ["x"], "v", "s").orderBy("x").collect()
    assert [r.s for r in got] == np.concatenate([[0], np.cumsum([i % 5 for i in range(999)])]).tolist()


def test_text_helpers(spark):
    row = spark.createDataFrame([("  Ab c__D! ", "set:12", "x-limit7", "none")], "a string, b string, c string, d string").select(text.slug(F.col("a")), *(text.scale_key(F.col(c), F.lit(9)) for c in "bcd")).first()
    assert list(row) == ["ab-c-d", "12", "7", "9"]


def test_names(spark):
    row = spark.createDataFrame([("Éa/Größe 7_val_subsampled", "org/ColPali-v1.2")], "a string, b string").select(text.embedding_file(F.col("a"), F.col("b"), F.lit(9)), text.dataset_name(F.lit("x/y_train_subsampled_test_subsampled")), text.model_name(F.lit("m/Some.Model"))).first()
    assert list(row) == ["vidore-größe-7-colpali-limit9.npz", "y", "some-model"]
    assert metrics.metric_ks("5, 10,,5", 20) == [1, 5, 10, 20]
    with pytest.raises(ValueError):
        metrics.metric_ks("0", 5)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=900), np.zeros(300), rng.normal(size=300).astype(np.float32) * 1e-30, [1e300, -1e300, np.inf, -np.inf, 5e-324]])
    rows = [(int(i % 3), float(v)) for i, v in enumerate(x)] + [(3, 7.0), (4, None), (None, 2.5), (None, 3.5)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(5)
    shares = {"a": 0.0, "b": 0.013, "c": 0.25, "d": 0.5, "e": 0.9, "f": 0.98}
    got = {r.g: r for r in quantiles(df, F.col("x"), shares, ("g",)).collect()}
    assert sorted(got, key=str) == [0, 1, 2, 3, None]
    for g, r in got.items():
        values = sorted(v for k, v in rows if k == g and v is not None)
        for name, q in shares.items():
            place = q * (len(values) - 1)
            low, high = values[math.floor(place)], values[math.ceil(place)]
            want = low if low == high else (math.ceil(place) - place) * low + (place - math.floor(place)) * high
            assert r[name] == want or math.isclose(r[name], want, rel_tol=1e-12), (g, name)
    assert quantiles(df, F.col("x"), {"m": 0.5}).first().m == 0.0
    assert quantiles(df.limit(0), F.col("x"), {"m": 0.5}).first().m is None


def test_gates(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 2.0), ("b", 2, 1.5), ("c", 1, float("nan"))], "implementation string, step int, value double")
    assert {r.implementation: r.passed for r in experiments.monotone(rows).collect()} == {"a": True, "b": False, "c": False}
    results = spark.createDataFrame([("s", True, 1.0, None), ("t", True, float("inf"), 1.0), ("u", False, 1.0, 1.0)], "stage string, passed boolean, latency double, metric double")
    assert [tuple(experiments.stage_gate(results, s).first()) for s in "stuv"] == [(1, True), (1, False), (1, False), (0, False)]


def test_query_stream(spark, tmp_path):
    rng = np.random.default_rng(8)
    tokens = spark.createDataFrame([(d, p, [float(v) for v in rng.normal(size=8)]) for d in range(5) for p in range(3)], "doc_idx long, token_pos long, emb array<float>")
    docs = spark.createDataFrame([(d, f"doc-{d}") for d in range(5)], "doc_idx long, doc_id string")
    index = Index.from_tokens(docs, tokens)
    schema = "query_idx long, q_pos long, qemb array<float>"
    for i in range(2):
        spark.createDataFrame([(i, p, [float(v) for v in rng.normal(size=8)]) for p in range(2)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    got = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    search_stream(stream, index, lambda rows, n: got.extend((r.query_idx, r.rank) for r in rows.collect()), k=2, checkpoint=str(tmp_path / "c")).awaitTermination(120)
    assert sorted(got) == [(0, 1), (0, 2), (1, 1), (1, 2)]
