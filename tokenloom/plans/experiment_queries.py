"""Registered queries of the experiments and the evaluation layer around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.frames import global_row_number
from ..functions.quantiles import quantiles
from ..operators import corpora, experiments, metrics, packing, scoring, search
from ..sources import views
from . import retrieval as R
from .corpus_queries import _FEW, _key, best_relevant
from .retrieval import _cascaded, _CODES, _DENSE, _FITS, _LOG16, _S127, _SIGNS, _TWO, _metric_sql, _per, _r6, _R6, _scored, _scored_sql, _second, query, score_sql, top_sql


@query("int8_query_pack", f"SELECT query_idx, q_pos, {_CODES.format(_S127.replace('emb', 'qemb'), 127, 'qemb')} AS codes, {_S127.replace('emb', 'qemb')}::DOUBLE AS token_scale FROM query_tokens")
def _int8_query(s, d):
    return packing.pack_int8(views.load(s, d).query_tokens, "qemb").select("query_idx", "q_pos", "codes", "token_scale")


@query("sign_query_pack", "SELECT query_idx, q_pos, [CASE WHEN x >= 0 THEN 1 ELSE -1 END for x in qemb] AS codes FROM query_tokens")
def _sign_query(s, d):
    return views.load(s, d).query_tokens.select("query_idx", "q_pos", V.signs(F.col("qemb")).alias("codes"))


@query("fp16_cast", f", x AS (SELECT doc_idx, token_pos, unnest(emb) AS val, unnest(range(len(emb))) AS i FROM doc_tokens), y AS (SELECT doc_idx, token_pos, i, {R._fp16('val')} AS half FROM x) SELECT doc_idx, token_pos, list(half ORDER BY i) AS values FROM y GROUP BY ALL")
def _fp16(s, d):
    return views.load(s, d).doc_tokens.select("doc_idx", "token_pos", F.transform("emb", V.round_fp16).alias("values"))


@query("scale_code_nibbles", f"""{_LOG16}, c AS (SELECT round_even((v - lo) / ((hi - lo) / 15), 0)::INT AS c, row_number() OVER (ORDER BY doc_idx, token_pos) - 1 AS n FROM l, m)
    SELECT n // 2 AS byte_no, (sum(CASE WHEN n % 2 = 0 THEN c ELSE 16 * c END))::INT AS byte FROM c GROUP BY 1""")  # fmt: skip
def _nibbles(s, d):
    """Four-bit scale codes in flat order, two a byte, the first low."""
    t = packing.token_scale(views.load(s, d).doc_tokens, "u4").select("doc_idx", "token_pos", "log_code")
    t = global_row_number(t, ["doc_idx", "token_pos"], "n")
    return t.groupBy(F.expr("n div 2").alias("byte_no")).agg(F.sum(F.when(F.col("n") % 2 == 0, F.col("log_code")).otherwise(16 * F.col("log_code"))).cast("int").alias("byte"))


_FIT = _FITS["centroid_fit"][0] + ", fr AS (SELECT list(struct_pack(t := t, neg := neg, pos := pos) ORDER BY d) AS f FROM fit)"
_QT = "SELECT query_idx, q_pos, [qemb[i]::DOUBLE * (f[i].pos - f[i].neg) for i in range(1, len(qemb) + 1)] AS q, 1.0 AS w FROM query_tokens, fr"


def _fitted(t):
    return packing.fit_centroids(t).agg(F.array_sort(F.collect_list(F.struct("d", "t", "neg", "pos"))).alias("fit"))


@query("centroid_query_transform", f"{_FIT} SELECT query_idx, q_pos, [round(x, 6) for x in q] AS q FROM ({_QT})")
def _transform(s, d):
    t = views.load(s, d)
    q = t.query_tokens.crossJoin(F.broadcast(_fitted(t.doc_tokens)))
    return q.select("query_idx", "q_pos", F.zip_with("qemb", "fit", lambda x, f: V.round_signed(x.cast("double") * (f["pos"] - f["neg"]), 6)).alias("q"))


@query("centroid_restored", f"""{_FIT}{score_sql("SELECT doc_idx, [CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END for x in emb] AS e, 1.0 AS ts FROM doc_tokens", _QT).replace(f', {R.DIGITS}) AS score', ', 12) AS score')},
    k AS (SELECT query_idx, sum(list_sum([qemb[i]::DOUBLE * (f[i].pos + f[i].neg) for i in range(1, len(qemb) + 1)])) AS c FROM query_tokens, fr GROUP BY query_idx)
    SELECT query_idx, doc_idx, round(0.5 * score + 0.5 * c, {R.DIGITS}) AS score FROM scores JOIN k USING (query_idx)""")  # fmt: skip
def _restored(s, d):
    """Signs against transformed queries, then the constant of each query; empty documents get the constant alone."""
    t = views.load(s, d)
    q = t.query_tokens.crossJoin(F.broadcast(_fitted(t.doc_tokens)))
    moved = q.withColumn("q", F.zip_with("qemb", "fit", lambda x, f: x.cast("double") * (f["pos"] - f["neg"])))
    constant = q.groupBy("query_idx").agg(F.sum(V.total(F.zip_with("qemb", "fit", lambda x, f: x.cast("double") * (f["pos"] + f["neg"])))).alias("c"))
    nested = scoring.nest(packing.pack_signs(t.doc_tokens), t.docs, "codes", "token_scale")
    out = scoring.score(nested, scoring.query_batch(moved, "q")).join(F.broadcast(constant), "query_idx")
    return out.select("query_idx", "doc_idx", F.round(0.5 * F.round("score", 12) + 0.5 * F.col("c"), R.DIGITS).alias("score"))


@query("score_checksum", f"{_TWO} SELECT count(*) AS pairs, round(sum(b.score), 3) AS checksum, round(max(abs(b.score - a.score)), 4) AS max_delta FROM scores_b b JOIN scores a USING (query_idx, doc_idx)")
def _checksum(s, d):
    out = experiments.checksum(_scored(s, d, "binary_best_match"), _scored(s, d, "dense_best_match"))
    return out.select("pairs", F.round("checksum", 3).alias("checksum"), F.round("max_delta", 4).alias("max_delta"))


@query("recall_of_rescore", f"{_TWO}, a AS {top_sql(10)}, b AS {top_sql(20, 'scores_b')} SELECT round(avg((b.doc_idx IS NOT NULL)::INT), 6) AS recall FROM a LEFT JOIN b USING (query_idx, doc_idx)")
def _recall_of(s, d):
    return experiments.recall_of(_scored(s, d, "dense_best_match"), _scored(s, d, "binary_best_match"), 10, 20).select(*_r6("recall"))


@query("cascade_binary_dense", f"{_TWO}, kept AS (SELECT query_idx, doc_idx FROM {top_sql(20, 'scores_b')}), fine AS (SELECT scores.* FROM scores JOIN kept USING (query_idx, doc_idx)) SELECT query_idx, rank, doc_id, score FROM {top_sql(5, 'fine')} JOIN docs USING (doc_idx)")
def _cascade(s, d):
    return search.with_ids(_cascaded(s, d, "binary_best_match", "dense_best_match", 20, 5), views.load(s, d).docs)


@query("rankings_export", f"{_DENSE}, r AS {top_sql(10)} SELECT query_idx, list(doc_id ORDER BY rank) AS doc_ids, list(score ORDER BY rank) AS scores FROM r JOIN docs USING (doc_idx) GROUP BY query_idx")
def _export(s, d):
    ranked = search.with_ids(search.top_k(_scored(s, d, "dense_best_match"), 10), views.load(s, d).docs)
    row = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))
    return ranked.groupBy("query_idx").agg(row.alias("r")).select("query_idx", F.transform("r", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("r", lambda x: x["score"]).alias("scores"))


@query("external_results", "SELECT query_idx, doc_idx, 1.0 / (1 + doc_idx) AS score FROM (SELECT DISTINCT query_idx FROM query_tokens), docs")
def _external(s, d):
    t = views.load(s, d)
    name = F.when(F.col("doc_idx") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_idx").cast("string"))
    rows = t.docs.select(name.alias("name"), (1.0 / (1 + F.col("doc_idx"))).alias("score")).crossJoin(F.broadcast(t.query_tokens.select("query_idx").distinct()))
    return experiments.normalise_results(rows, t.docs)


_PER2 = f"{_TWO}{_metric_sql('scores')}{_metric_sql('scores_b', suffix='_b')}"


@query("per_dataset_table", f"""{_PER2}, r AS (SELECT (query_idx % 3)::VARCHAR AS dataset, avg(a.ndcg) AS dense, avg(b.ndcg) AS "binary" FROM per a JOIN per_b b USING (query_idx) GROUP BY 1)
    SELECT dataset, round(dense, 6) AS dense, round("binary", 6) AS "binary" FROM r UNION ALL SELECT 'mean', round(avg(dense), 6), round(avg("binary"), 6) FROM r""")  # fmt: skip
def _table(s, d):
    rows = None
    for key, name in (("dense", "dense_best_match"), ("binary", "binary_best_match")):
        one = _per(s, d, name).select((F.col("query_idx") % 3).cast("string").alias("dataset"), F.lit(key).alias("implementation"), "ndcg")
        rows = one if rows is None else rows.union(one)
    wide = rows.groupBy("dataset").pivot("implementation", ["dense", "binary"]).agg(F.avg("ndcg"))
    every = wide.union(wide.agg(F.lit("mean").alias("dataset"), F.avg("dense"), F.avg("binary")))
    return every.select("dataset", *_r6("dense", "binary"))


@query("row_derivations", f"""{_PER2}, z AS (SELECT count(*) AS n, max(len(emb)) AS dim FROM doc_tokens),
    m AS (SELECT 'dense' AS implementation, avg(ndcg) AS ndcg, 4 AS w FROM per UNION ALL SELECT 'binary', avg(ndcg), 1/8 FROM per_b)
    SELECT implementation, round(ndcg, 6) AS ndcg, round(ndcg - (SELECT ndcg FROM m WHERE implementation = 'dense'), 6) AS delta, (w * n * dim)::BIGINT AS bytes, round(4 / w, 4)::DOUBLE AS compression FROM m, z""")  # fmt: skip
def _rows(s, d):
    rows = None
    for key, name, width in (("dense", "dense_best_match", 4.0), ("binary", "binary_best_match", 0.125)):
        one = metrics.summary(_per(s, d, name)).select(F.lit(key).alias("implementation"), "ndcg", F.lit(width).alias("w"))
        rows = one if rows is None else rows.union(one)
    z = views.load(s, d).doc_tokens.agg(F.count("*").alias("n"), F.max(F.size("emb")).alias("dim"))
    base = rows.filter("implementation = 'dense'").select(F.col("ndcg").alias("base"))
    out = rows.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(z))
    return out.select("implementation", *_r6("ndcg"), F.round(F.col("ndcg") - F.col("base"), 6).alias("delta"), (F.col("w") * F.col("n") * F.col("dim")).cast("long").alias("bytes"), F.round(4 / F.col("w"), 4).alias("compression"))


@query("latency_stats", "WITH t AS (SELECT event_type AS implementation, value AS ms FROM events) SELECT implementation, round(min(ms), 4) AS best, round(avg(ms), 4) AS mean, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, round(quantile_cont(ms, 0.99), 4) AS p99 FROM t GROUP BY 1")
def _latency(s, d):
    t = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("implementation"), F.col("value").alias("ms"))
    out = t.groupBy("implementation").agg(F.min("ms").alias("best"), F.avg("ms").alias("mean")).join(quantiles(t, F.col("ms"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ("implementation",)), "implementation")
    return out.select("implementation", *(F.round(c, 4).alias(c) for c in ("best", "mean", "p50", "p95", "p99")))


_GATE = "WITH r AS (SELECT event_type AS implementation, user_id % 3 AS dataset, avg(value) AS value FROM events GROUP BY ALL)"


@query("performance_gates", f"{_GATE} SELECT r.implementation, bool_and(r.value <= 1.01 * b.value) AS passed, round(max(r.value / b.value), 6) AS worst_ratio FROM r JOIN r b ON r.dataset = b.dataset AND b.implementation = 'view' GROUP BY 1")
def _gates(s, d):
    r = s.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("implementation"), (F.col("user_id") % 3).alias("dataset")).agg(F.avg("value").alias("value"))
    return experiments.gates(r, "view", 1.01).withColumn("worst_ratio", F.round("worst_ratio", 6))


_STEPS = "WITH r AS (SELECT event_type AS implementation, user_id % 5 AS step, round(avg(value), 9) AS value FROM events GROUP BY ALL)"


def _by_step(s, d, name="step", parts=5):
    return s.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("implementation"), (F.col("user_id") % parts).alias(name)).agg(F.round(F.avg("value"), 9).alias("value"))


@query("monotone_gate", f"{_STEPS}, c AS (SELECT implementation, value - lag(value) OVER (PARTITION BY implementation ORDER BY step) AS change FROM r) SELECT implementation, coalesce(min(change), 0) >= 0 AS passed, round(min(change), 6) AS worst_step FROM c GROUP BY 1")
def _monotone(s, d):
    return experiments.monotone(_by_step(s, d)).withColumn("worst_step", F.round("worst_step", 6))


@query("regret_gate", "WITH r AS (SELECT event_type AS implementation, user_id % 7 AS dataset, round(avg(value), 9) AS value FROM events GROUP BY ALL) SELECT dataset, arg_min(implementation, value) AS best_route, round(max(value) FILTER (implementation = 'view') / min(value) - 1, 6) AS regret, coalesce(max(value) FILTER (implementation = 'view') / min(value) - 1 <= 0.05, false) AS passed FROM r GROUP BY 1")
def _regret(s, d):
    return experiments.regret(_by_step(s, d, "dataset", 7), F.col("implementation") == "view").withColumn("regret", F.round("regret", 6))


@query("stage_gate", "SELECT count(*) AS results, coalesce(bool_and(quality >= 0 AND isfinite(doc_id::DOUBLE)), false) AS passed FROM labels WHERE doc_id % 2 = 0")
def _stage(s, d):
    rows = s.read.parquet(f"{d}/labels.parquet").select(F.when(F.col("doc_id") % 2 == 0, "smoke").otherwise("full").alias("stage"), (F.col("quality") >= 0).alias("passed"), F.col("doc_id").cast("double").alias("latency"), F.lit(None).cast("double").alias("metric"))
    return experiments.stage_gate(rows, "smoke")


_SCALES = """WITH r AS (SELECT event_type AS implementation, user_id % 5 AS dataset, (user_id % 2)::VARCHAR AS scale, round(avg(value), 9) AS value FROM events GROUP BY ALL), b AS (SELECT r.*, value - (SELECT any_value(value) FROM r x WHERE x.implementation = 'view' AND x.dataset = r.dataset AND x.scale = r.scale) AS delta FROM r),
    a AS (SELECT scale, implementation, count(value) AS datasets, avg(value) AS mean, quantile_cont(value, 0.5) AS median, coalesce(exp(avg(ln(CASE WHEN value > 0 THEN value END))), 0) AS geomean, avg(delta) AS delta FROM b GROUP BY GROUPING SETS ((implementation), (scale, implementation)))
    SELECT coalesce(scale, 'all') AS scale, implementation, datasets, round(mean, 6) AS mean, round(median, 6) AS median, round(geomean, 6) AS geomean, round(delta, 6) AS delta, row_number() OVER (PARTITION BY scale ORDER BY round(mean, 6) DESC, implementation) AS place FROM a"""


@query("multi_dataset_scales", _SCALES)
def _by_scale(s, d):
    rows = s.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("implementation"), (F.col("user_id") % 5).alias("dataset"), (F.col("user_id") % 2).cast("string").alias("scale")).agg(F.round(F.avg("value"), 9).alias("value"))
    return metrics.across_scales(rows, "view", 6)


@query("sign_test", "WITH x AS (SELECT source, count(*) FILTER (n_chars > 2000) AS w, count(*) FILTER (n_chars <= 2000) AS l FROM documents GROUP BY source), t AS (SELECT source, w, l, i FROM x, range(0, 200000) g(i) WHERE i <= least(w, l)) SELECT source, any_value(w) AS wins, any_value(l) AS losses, round(least(1.0, 2 * sum(exp(lgamma(w + l + 1.0) - lgamma(i + 1.0) - lgamma(w + l - i + 1.0) - (w + l) * ln(2)))), 6) AS p FROM t GROUP BY source")
def _sign(s, d):
    """Exact two-sided sign test of wins and losses by group (here: long and short documents of a source)."""
    x = s.read.parquet(f"{d}/documents.parquet").groupBy("source").agg(F.count_if(F.col("n_chars") > 2000).alias("wins"), F.count_if(F.col("n_chars") <= 2000).alias("losses"))
    return x.withColumn("p", F.round(experiments.sign_test(F.col("wins"), F.col("losses")), 6))


@query("paired_bootstrap")
def _bootstrap(s, d):
    a, b = (_per(s, d, n).select("query_idx", F.col("ndcg").alias(n)) for n in ("dense_best_match", "binary_best_match"))
    return experiments.bootstrap(a.join(b, "query_idx").select((F.col("binary_best_match") - F.col("dense_best_match")).alias("delta")))


@query("nested_scale_materialize", f"""{_FEW}, o AS (SELECT doc_idx, doc_id, 0 AS tier, {_key('relevant')} AS k FROM good UNION ALL SELECT doc_idx, doc_id, 1, {_key('distractor')} FROM other),
    p AS (SELECT doc_idx, doc_id, row_number() OVER (ORDER BY tier, k) - 1 AS position, count(*) OVER () AS n FROM o), g AS (SELECT *, r * n + position AS place FROM p, (SELECT unnest([0, 1, 2]) AS r))
    SELECT place AS position, CASE WHEN r > 0 THEN doc_id || '::nested-scale-copy-' || r ELSE doc_id END AS doc_id, r = 0 AS has_relevance, sha256(doc_id || chr(31) || r) AS digest FROM g WHERE place < 130""")  # fmt: skip
def _materialize(s, d):
    t = views.load(s, d)
    n = t.docs.count()
    plan = corpora.nested_plan(t.docs, best_relevant(t.qrels), [n]).join(t.docs, "doc_idx")
    g = plan.withColumn("r", F.explode(F.array(*map(F.lit, range(3))))).withColumn("at", F.col("r") * n + F.col("position")).filter("at < 130")
    name = F.when(F.col("r") > 0, F.concat("doc_id", F.lit("::nested-scale-copy-"), F.col("r").cast("string"))).otherwise(F.col("doc_id"))
    return g.select(F.col("at").cast("long").alias("position"), name.alias("doc_id"), (F.col("r") == 0).alias("has_relevance"), F.sha2(F.concat_ws("\x1f", "doc_id", F.col("r").cast("string")), 256).alias("digest"))


for _kind in ("weighted", "protected", "plain"):
    query(f"ward_pool_{_kind}")(lambda s, d, k=_kind: experiments.pool_variant(views.load(s, d).doc_tokens, 2, k).withColumn("emb", F.transform("emb", lambda x: F.round(x, 5))))


@query("itq_rotation")
def _itq(s, d):
    """Share of vectors' energy along their signs, before and after a fitted rotation."""
    t = views.load(s, d).doc_tokens
    turned = experiments.rotate(t, experiments.fit_rotation(t))
    gain = F.avg(V.total(F.transform("emb", F.abs)) / (F.sqrt(F.size("emb")) * F.sqrt(V.dot(F.col("emb"), F.col("emb")))))
    return t.agg(F.round(gain, 4).alias("before")).crossJoin(turned.agg(F.round(gain, 4).alias("after")))
