"""Registered queries of corpus builders, text helpers and accounting, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions import vectors as V
from ..functions.quantiles import quantiles
from ..operators import corpora, packing, scoring
from ..sources import views
from .retrieval import _SIGN_D, lengths, query, score_sql


def _two(s, d):
    t = views.load(s, d)
    half = lambda df, k: df.filter(F.col("doc_idx") % 2 == k).withColumn("doc_idx", F.expr("doc_idx div 2"))
    return {n: (half(t.docs, k), half(t.qrels, k)) for k, n in enumerate(("even", "odd"))}


_PARTS = """, a AS (SELECT doc_idx // 2 AS doc_idx, doc_id FROM docs WHERE doc_idx % 2 = 0), b AS (SELECT doc_idx // 2 AS doc_idx, doc_id FROM docs WHERE doc_idx % 2 = 1),
    ra AS (SELECT query_idx, doc_idx // 2 AS doc_idx, rel FROM qrels WHERE doc_idx % 2 = 0), rb AS (SELECT query_idx, doc_idx // 2 AS doc_idx, rel FROM qrels WHERE doc_idx % 2 = 1)"""


@query("mixed_corpus", f"{_PARTS} SELECT doc_idx, 'even:' || doc_id AS doc_id FROM a UNION ALL SELECT doc_idx + (SELECT max(doc_idx) + 1 FROM a), 'odd:' || doc_id FROM b")
def _mixed(s, d):
    return corpora.mix(_two(s, d))[0]


@query("mixed_qrels", f"{_PARTS} SELECT * FROM ra UNION ALL SELECT query_idx + (SELECT max(query_idx) + 1 FROM ra), doc_idx + (SELECT max(doc_idx) + 1 FROM a), rel FROM rb")
def _mixed_qrels(s, d):
    return corpora.mix(_two(s, d))[1]


def best_relevant(qrels):
    """The most relevant document of each query."""
    return qrels.groupBy("query_idx").agg(F.min_by(F.struct("doc_idx", "rel"), F.struct(-F.col("rel"), "doc_idx")).alias("b")).select("query_idx", "b.doc_idx", "b.rel")


_FEW = ", few AS (SELECT * FROM qrels QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY rel DESC, doc_idx) = 1), good AS (SELECT * FROM docs SEMI JOIN few USING (doc_idx)), other AS (SELECT *, row_number() OVER (ORDER BY doc_idx) - 1 AS n FROM docs ANTI JOIN few USING (doc_idx)), c AS (SELECT (SELECT count(*) FROM good) AS g, (SELECT count(*) FROM other) AS o, 2 * (SELECT count(*) FROM docs) + 5 AS target)"


@query("docscale_stress", f"""{_FEW}, f AS (SELECT doc_idx, doc_id, r, r * o + n AS n, g FROM other, c, (SELECT unnest(range(0, 50)) AS r) WHERE r * o + n < target - g)
    SELECT doc_idx, doc_id, false AS copy FROM good UNION ALL SELECT doc_idx, CASE WHEN r > 0 THEN doc_id || ':stress-' || (n + g) ELSE doc_id END, r > 0 FROM f""")  # fmt: skip
def _stress(s, d):
    t = views.load(s, d)
    return corpora.stress(t.docs, best_relevant(t.qrels), 2 * t.docs.count() + 5)


def _key(label: str) -> str:
    return f"sha256('{label}' || chr(31) || '17' || chr(31) || doc_id || chr(31) || doc_idx)"


@query("nested_scale_plan", f"""{_FEW}, o AS (SELECT doc_idx, 0 AS tier, {_key('relevant')} AS k FROM good UNION ALL SELECT doc_idx, 1, {_key('distractor')} FROM other),
    p AS (SELECT doc_idx, row_number() OVER (ORDER BY tier, k) - 1 AS position FROM o) SELECT size, position, doc_idx FROM p, (SELECT unnest([10, 20, 40]) AS size) WHERE position < size""")  # fmt: skip
def _nested(s, d):
    t = views.load(s, d)
    return corpora.nested_plan(t.docs, best_relevant(t.qrels), [10, 20, 40])


@query("dedupe_docs", "WITH k AS (SELECT lang || ':' || source AS key, min(doc_id) AS first_row, count(*) AS copies FROM documents GROUP BY 1) SELECT key, first_row, copies, row_number() OVER (ORDER BY first_row) - 1 AS doc_idx FROM k")
def _dedupe(s, d):
    rows = s.read.parquet(f"{d}/documents.parquet").select(F.concat_ws(":", "lang", "source").alias("key"), "doc_id")
    return corpora.dedupe(rows, "key", "doc_id")


@query("text_corpus", "WITH r AS (SELECT doc_id, trim(source) AS a, trim(coalesce(text, '')) AS b FROM documents) SELECT doc_id, CASE WHEN a = '' THEN b WHEN b = '' THEN a ELSE a || '. ' || b END AS body FROM r")
def _text(s, d):
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("source").alias("title"), "text")
    return corpora.text_corpus(rows).select("doc_id", "body")


@query("text_qrels", "WITH j AS (SELECT doc_id, doc_id % 50 AS query_id, quality + toxic AS score FROM labels) SELECT query_id, doc_id, max(score)::DOUBLE AS rel FROM j WHERE score > 0 GROUP BY ALL")
def _text_qrels(s, d):
    j = s.read.parquet(f"{d}/labels.parquet").select((F.col("doc_id") % 50).alias("query_id"), "doc_id", (F.col("quality") + F.col("toxic")).alias("score"))
    return j.filter("score > 0").groupBy("query_id", "doc_id").agg(F.max("score").cast("double").alias("rel"))


@query("flatten_offsets", f", ln AS (SELECT d.doc_idx, count(t.doc_idx) AS n_tokens FROM docs d LEFT JOIN doc_tokens t USING (doc_idx) GROUP BY d.doc_idx) SELECT doc_idx, n_tokens, coalesce(sum(n_tokens) OVER (ORDER BY doc_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_token FROM ln")
def _offsets(s, d):
    return corpora.offsets(lengths(s, d))


@query("query_sample", "SELECT query_idx, q_pos FROM query_tokens WHERE query_idx IN (SELECT query_idx FROM (SELECT DISTINCT query_idx FROM query_tokens) ORDER BY sha256('7' || chr(31) || query_idx) LIMIT 5)")
def _sample(s, d):
    """A deterministic sample of queries: the first by a keyed hash."""
    q = views.load(s, d).query_tokens
    few = q.select("query_idx").distinct().orderBy(F.sha2(F.concat_ws("\x1f", F.lit("7"), F.col("query_idx").cast("string")), 256)).limit(5)
    return q.join(F.broadcast(few), "query_idx", "left_semi").select("query_idx", "q_pos")


@query("query_prefix", "SELECT query_idx, q_pos FROM query_tokens WHERE query_idx < 4")
def _prefix(s, d):
    return views.load(s, d).query_tokens.filter("query_idx < 4").select("query_idx", "q_pos")


@query("batch_fidelity", """, c AS (SELECT list_cosine_similarity([v::DOUBLE for v in emb], [v::DOUBLE for v in h]) AS c FROM (SELECT emb, [round_even(v::DOUBLE * 1024, 0) / 1024 for v in emb] AS h FROM doc_tokens))
    SELECT count(*) AS tokens, round(min(c), 6) AS least, min(c) >= 0.999 AS passed FROM c""")  # fmt: skip
def _fidelity(s, d):
    """Least cosine of two encodings of the same tokens."""
    t = views.load(s, d).doc_tokens
    other = t.select("doc_idx", "token_pos", F.transform("emb", lambda x: F.rint(x.cast("double") * 1024) / 1024).alias("h"))
    both = t.join(other, ["doc_idx", "token_pos"])
    c = V.dot(F.col("emb"), F.col("h")) / (F.sqrt(V.dot(F.col("emb"), F.col("emb"))) * F.sqrt(V.dot(F.col("h"), F.col("h"))))
    return both.agg(F.count("*").alias("tokens"), F.round(F.min(c), 6).alias("least"), (F.min(c) >= 0.999).alias("passed"))


_MODES = {"dense": ("4 * dim * n", None), "binary": ("n * dim // 8", None), "binary_token_scale": ("n * dim // 8 + 2 * n", None), "binary_token_scale_u8": ("n * dim // 8 + n + 16", None), "binary_token_scale_u4": ("n * dim // 8 + (n + 1) // 2 + 16", None), "int4": ("n * dim // 2 + 4", None), "int4_per_token": ("n * dim // 2 + 4 + 4 * n", None), "int4_residual": ("n * dim + 8 + 8 * n", None), "binary_q40": ("n * dim // 8 + 12 * dim", None), "int8": ("n * (dim + 4)", None), "ternary": ("n * dim // 4", None)}


@query("storage_report", ", z AS (SELECT count(*) AS n, max(len(emb)) AS dim FROM doc_tokens) " + " UNION ALL ".join(f"SELECT '{m}' AS mode, ({x})::BIGINT AS encoded_bytes, round(4.0 * n * dim / ({x}), 4)::DOUBLE AS compression FROM z" for m, (x, _) in _MODES.items()))
def _storage(s, d):
    z = views.load(s, d).doc_tokens.agg(F.count("*").alias("n"), F.max(F.size("emb")).alias("dim"))
    rows = F.array(*(F.struct(F.lit(m).alias("mode"), F.expr(x.replace("//", "div")).cast("long").alias("encoded_bytes")) for m, (x, _) in _MODES.items()))
    out = z.select("n", "dim", F.explode(rows).alias("r")).select("r.*", "n", "dim")
    return out.select("mode", "encoded_bytes", F.round(4.0 * F.col("n") * F.col("dim") / F.col("encoded_bytes"), 4).alias("compression"))


@query("residual_binary_mse", """, a AS (SELECT doc_idx, token_pos, [v::DOUBLE for v in emb] AS e, (list_sum([abs(x::DOUBLE) for x in emb]) / len(emb)) AS a1 FROM doc_tokens),
    b AS (SELECT *, [x - (CASE WHEN x >= 0 THEN a1 ELSE -a1 END) for x in e] AS r FROM a), c AS (SELECT *, list_sum([abs(x) for x in r]) / len(r) AS a2 FROM b),
    g AS (SELECT list_sum([x * x for x in r]) / len(r) AS m1, list_sum([pow(x - (CASE WHEN x >= 0 THEN a2 ELSE -a2 END), 2) for x in r]) / len(r) AS m2 FROM c)
    SELECT round(avg(m1), 8) AS mse_one, round(avg(m2), 8) AS mse_two FROM g""")  # fmt: skip
def _residual_mse(s, d):
    """Reconstruction error of one and of two stages of scaled signs."""
    t = views.load(s, d).doc_tokens.select(F.transform("emb", lambda x: x.cast("double")).alias("e"))
    mean = lambda x: V.total(F.transform(x, F.abs)) / F.size(x)
    rest = lambda x, a: F.transform(x, lambda v: v - F.when(v >= 0, a).otherwise(-a))
    t = t.withColumn("a1", mean(F.col("e"))).withColumn("r", rest(F.col("e"), F.col("a1"))).withColumn("a2", mean(F.col("r"))).withColumn("r2", rest(F.col("r"), F.col("a2")))
    mse = lambda x: V.total(F.transform(x, lambda v: v * v)) / F.size(x)
    return t.agg(F.round(F.avg(mse(F.col("r"))), 8).alias("mse_one"), F.round(F.avg(mse(F.col("r2"))), 8).alias("mse_two"))


_ALT = """, t AS (SELECT doc_idx, token_pos, list_sum([abs(x::DOUBLE) for x in emb]) / len(emb) AS mean, list_max([abs(x::DOUBLE) for x in emb]) AS most FROM doc_tokens),
    r AS (SELECT doc_idx, token_pos, 1 / mean AS inverse, 1 / sqrt(mean) AS inverse_half, most AS max_abs, most / mean AS spikiness, sqrt(most / mean) AS spikiness_half FROM t)
    SELECT doc_idx, token_pos, """ + ", ".join(f"round({c} / (SELECT avg({c}) FROM r), 6) AS {c}" for c in ("inverse", "inverse_half", "max_abs", "spikiness", "spikiness_half")) + " FROM r"  # fmt: skip


@query("alternative_scales", _ALT)
def _alternative(s, d):
    """Token scales of other kinds, each over its mean."""
    mean, most = V.total(F.transform("emb", F.abs)) / F.size("emb"), V.max_abs(F.col("emb")).cast("double")
    kinds = {"inverse": 1 / mean, "inverse_half": 1 / F.sqrt(mean), "max_abs": most, "spikiness": most / mean, "spikiness_half": F.sqrt(most / mean)}
    t = views.load(s, d).doc_tokens.select("doc_idx", "token_pos", *(c.alias(n) for n, c in kinds.items()))
    means = t.agg(*(F.avg(n).alias(f"m_{n}") for n in kinds))
    return t.crossJoin(F.broadcast(means)).select("doc_idx", "token_pos", *(F.round(F.col(n) / F.col(f"m_{n}"), 6).alias(n) for n in kinds))


@query("tempered_scales", """, t AS (SELECT doc_idx, token_pos, (list_sum([abs(x::DOUBLE) for x in emb]) / len(emb))::FLOAT::DOUBLE AS v FROM doc_tokens), m AS (SELECT quantile_cont(v, 0.05) AS lo, quantile_cont(v, 0.95) AS hi FROM t)
    SELECT doc_idx, token_pos, round(pow(least(greatest(v, lo), hi), 0.5), 6) AS token_scale FROM t, m""")  # fmt: skip
def _tempered(s, d):
    """Scales clipped to percentiles, then to a power."""
    t = packing.token_scale(views.load(s, d).doc_tokens, "mean_abs").select("doc_idx", "token_pos", F.col("token_scale").alias("v"))
    m = quantiles(t, F.col("v"), {"lo": 0.05, "hi": 0.95})
    return t.crossJoin(F.broadcast(m)).select("doc_idx", "token_pos", F.round(F.pow(F.least(F.greatest("v", "lo"), "hi"), F.lit(0.5)), 6).alias("token_scale"))


_SLUG = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')"


@query("slugs", f"SELECT page_id, {_SLUG.format('url')} AS slug, {_SLUG.format(chr(39) + 'Page ' + chr(39) + ' || page_id')} AS name FROM pages")
def _slugs(s, d):
    p = s.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", text.slug(F.col("url")).alias("slug"), text.slug(F.concat(F.lit("Page "), F.col("page_id").cast("string"))).alias("name"))


_LAST = "regexp_extract({0}, '[^/]*$')"


@query("short_names", f"""WITH n AS (SELECT page_id, {_LAST.format('host')} AS d, lower({_LAST.format("url || CASE page_id % 3 WHEN 0 THEN '-ColQwen2.5' WHEN 1 THEN '-colpali-v1' ELSE '' END")}) AS m
    FROM (SELECT page_id, url, split_part(url, '/', 3) || CASE page_id % 4 WHEN 0 THEN '_test_subsampled' WHEN 1 THEN '_val_subsampled_train_subsampled' ELSE '' END AS host FROM pages)),
    k AS (SELECT page_id, {_SLUG.format("CASE WHEN d LIKE '%!_val!_subsampled!_train!_subsampled' ESCAPE '!' THEN left(d, len(d) - 32) ELSE regexp_replace(d, '_(test|val)_subsampled$', '') END")} AS dataset_name,
        CASE WHEN contains(m, 'colqwen2') THEN 'colqwen2' WHEN contains(m, 'colpali') THEN 'colpali' ELSE {_SLUG.format('m')} END AS model_name FROM n)
    SELECT page_id, dataset_name, model_name, 'vidore-' || dataset_name || '-' || model_name || '-limit' || page_id || '.npz' AS file_name FROM k""")  # fmt: skip
def _short_names(s, d):
    """Names of datasets and models for tables and files."""
    n = F.col("page_id")
    host = F.concat(F.split_part("url", F.lit("/"), F.lit(3)), F.when(n % 4 == 0, "_test_subsampled").when(n % 4 == 1, "_val_subsampled_train_subsampled").otherwise(""))
    model = F.concat("url", F.when(n % 3 == 0, "-ColQwen2.5").when(n % 3 == 1, "-colpali-v1").otherwise(""))
    p = s.read.parquet(f"{d}/pages.parquet").select("page_id", host.alias("host"), model.alias("model"))
    return p.select("page_id", text.dataset_name(F.col("host")).alias("dataset_name"), text.model_name(F.col("model")).alias("model_name"), text.embedding_file(F.col("host"), F.col("model"), n).alias("file_name"))


@query("scale_keys", "WITH n AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ':' || doc_id WHEN doc_id % 3 = 1 THEN source || '-limit' || doc_id ELSE source END AS name, n_chars FROM documents) SELECT doc_id, coalesce(nullif(regexp_extract(name, ':([0-9]+)$', 1), ''), nullif(regexp_extract(name, 'limit([0-9]+)', 1), ''), n_chars::VARCHAR) AS scale_key FROM n")
def _scale_keys(s, d):
    t = s.read.parquet(f"{d}/documents.parquet")
    i = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(":"), i)).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("-limit"), i)).otherwise(F.col("source"))
    return t.select("doc_id", text.scale_key(name, F.col("n_chars")).alias("scale_key"))


@query("explicit_token_scale", f"{score_sql(_SIGN_D.format('1.0 / (1 + token_pos)'))} SELECT * FROM scores")
def _explicit(s, d):
    t = views.load(s, d)
    scales = t.doc_tokens.select("doc_idx", "token_pos", (1.0 / (1 + F.col("token_pos"))).alias("token_scale"))
    nested = scoring.nest(packing.explicit_token_scale(packing.pack_signs(t.doc_tokens), scales), t.docs, "codes", "token_scale")
    return scoring.score(nested, scoring.query_batch(t.query_tokens)).withColumn("score", F.round(F.col("score") + 0.0, 5))


@query("scale_override", f"{score_sql(_SIGN_D.format('1.0'), reducer='topk2').replace(', 5) AS score', ', 12) AS score')} SELECT query_idx, doc_idx, round(2.5 * score, 5) + 0.0 AS score FROM scores")
def _override(s, d):
    t = views.load(s, d)
    nested = scoring.override_scale(scoring.nest(packing.pack_signs(t.doc_tokens), t.docs, "codes", "token_scale"), 2.5)
    return scoring.score(nested, scoring.query_batch(t.query_tokens), "topk2", doc_scale=True).withColumn("score", F.round("score", 5) + 0.0)


@query("doc_chunks")
def _chunks(s, d):
    return corpora.chunks(lengths(s, d), 64)
