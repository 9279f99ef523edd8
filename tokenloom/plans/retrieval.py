"""Registered retrieval queries and their SQL twins.

One template scores every format: documents become (codes, token_scale), queries numbers, and
a reducer is named. Scores are rounded alike on both sides before they order anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.frames import checkpointed
from ..operators import metrics, packing, pooling, scoring, search
from ..sources import views

DIGITS = 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"{views.SQL}\n{sql}" if not sql.lstrip().startswith("WITH") else sql
        return f

    return add


def rounded(e: Column, digits: int = DIGITS) -> Column:
    return F.round(e, digits)


# -- packers ------------------------------------------------------------------------------

KEYS = ("doc_idx", "token_pos")
HALF = "round_even({0}, 0)"


def _packer(name: str, f: Callable[[DataFrame], DataFrame], columns: Callable[[], list[Column | str]], sql: str) -> None:
    """Columns come from a function: none can be made before there is a session."""
    query(name, sql)(lambda s, d: f(views.load(s, d).doc_tokens).select(*KEYS, *columns()))


_S7 = "(CASE WHEN list_max([abs(x) for x in emb]) = 0 THEN 1 ELSE list_max([abs(x) for x in emb]) / 7::FLOAT END)::FLOAT"
_S127 = _S7.replace("7::FLOAT", "127::FLOAT")
_CODES = "[greatest(-{1}, least({1}, round_even((x / {0})::FLOAT::DOUBLE, 0)))::INT for x in {2}]"
_SIGNS = "[CASE WHEN x >= 0 THEN 1 ELSE -1 END for x in emb]"
_MEAN = "(list_sum([abs(x::DOUBLE) for x in emb]) / len(emb))::FLOAT"


def _fp16(x: str) -> str:
    return f"""(SELECT CASE WHEN a = 0 THEN 0.0 WHEN r >= 65520 THEN 'inf'::DOUBLE ELSE sign(v) * r END FROM (
        SELECT v, a, round_even(a / u, 0) * u AS r FROM (SELECT v, a, pow(2.0, greatest(-14, e0 - (pow(2.0, e0) > a)::INT + (pow(2.0, e0 + 1) <= a)::INT) - 10) AS u
        FROM (SELECT v, abs(v) AS a, floor(log2(greatest(abs(v), 1e-30))) AS e0 FROM (SELECT ({x})::DOUBLE AS v)))))"""


_packer("sign_pack", packing.pack_signs, lambda: [V.sign_bytes(F.col("codes")).alias("bytes")],
        f"SELECT doc_idx, token_pos, [list_sum([(emb[b * 8 + i + 1] >= 0)::INT * (1 << i) for i in range(8)])::INT for b in range(len(emb) // 8)] AS bytes FROM doc_tokens")
_packer("sign_unpack", lambda t: packing.pack_signs(t).withColumn("codes", V.sign_unbytes(V.sign_bytes(F.col("codes")))), lambda: ["codes"], f"SELECT doc_idx, token_pos, {_SIGNS} AS codes FROM doc_tokens")
_packer("int4_pack_token", packing.pack_int4, lambda: ["codes", "token_scale"], f"SELECT doc_idx, token_pos, {_CODES.format(_S7, 7, 'emb')} AS codes, {_S7}::DOUBLE AS token_scale FROM doc_tokens")
_packer("int4_pack_tensor", lambda t: packing.pack_int4(t, "tensor"), lambda: ["codes"],
        f", m AS (SELECT (max(list_max([abs(x) for x in emb]))::DOUBLE / 7)::FLOAT AS s FROM doc_tokens) SELECT doc_idx, token_pos, {_CODES.format('s', 7, 'emb')} AS codes FROM doc_tokens, m")
_packer("int4_pack_channel", lambda t: packing.pack_int4(t, "channel"), lambda: ["codes"],
        """, u AS (SELECT doc_idx, token_pos, unnest(emb) AS x, unnest(range(len(emb))) AS d FROM doc_tokens),
        c AS (SELECT d, (CASE WHEN max(abs(x)) = 0 THEN 1 ELSE max(abs(x))::DOUBLE / 7 END)::FLOAT AS s FROM u GROUP BY d)
        SELECT doc_idx, token_pos, list(greatest(-7, least(7, round_even((x / s)::FLOAT::DOUBLE, 0)))::INT ORDER BY d) AS codes FROM u JOIN c USING (d) GROUP BY ALL""")  # fmt: skip
_packer("nibble_pack", packing.pack_int4, lambda: [V.nibble_bytes(F.col("codes")).alias("bytes")],
        f", c AS (SELECT doc_idx, token_pos, {_CODES.format(_S7, 7, 'emb')} AS k FROM doc_tokens) SELECT doc_idx, token_pos, [((k[2 * j + 1] + 16) % 16 + 16 * ((k[2 * j + 2] + 16) % 16))::INT for j in range(len(k) // 2)] AS bytes FROM c")
_packer("nibble_unpack", lambda t: packing.pack_int4(t).withColumn("codes", V.nibble_unbytes(V.nibble_bytes(F.col("codes")))), lambda: ["codes"], f"SELECT doc_idx, token_pos, {_CODES.format(_S7, 7, 'emb')} AS codes FROM doc_tokens")
_packer("int8_pack", packing.pack_int8, lambda: ["codes", "token_scale"], f"SELECT doc_idx, token_pos, {_CODES.format(_S127, 127, 'emb')} AS codes, {_S127}::DOUBLE AS token_scale FROM doc_tokens")
_packer("int8_round", lambda t: t.withColumn("codes", V.scaled_codes(F.col("emb"), F.lit(1.0).cast("float"), 127)), lambda: ["codes"], f"SELECT doc_idx, token_pos, {_CODES.format('1::FLOAT', 127, 'emb')} AS codes FROM doc_tokens")
_packer("ternary_pack", lambda t: packing.pack_ternary(t, 0.05), lambda: ["codes"], "SELECT doc_idx, token_pos, [CASE WHEN x > 0.05::DOUBLE THEN 1 WHEN x < -0.05::DOUBLE THEN -1 ELSE 0 END for x in [v::DOUBLE for v in emb]] AS codes FROM doc_tokens")
_packer("ternary_threshold", packing.pack_ternary, lambda: ["codes"],
        ", t AS (SELECT quantile_cont(abs(x::DOUBLE), 0.25) AS t FROM (SELECT unnest(emb) AS x FROM doc_tokens)) SELECT doc_idx, token_pos, [CASE WHEN x > t THEN 1 WHEN x < -t THEN -1 ELSE 0 END for x in [v::DOUBLE for v in emb]] AS codes FROM doc_tokens, t")
_RES = f""", a AS (SELECT doc_idx, token_pos, emb, {_S7} AS s1 FROM doc_tokens),
    b AS (SELECT *, {_CODES.format('s1', 7, 'emb')} AS codes FROM a),
    c AS (SELECT doc_idx, token_pos, s1, codes, [(emb[i] - (codes[i]::FLOAT * s1)::FLOAT)::FLOAT for i in range(1, len(emb) + 1)] AS emb FROM b),
    r AS (SELECT doc_idx, token_pos, s1, codes, emb AS rest, {_S7} AS s2 FROM c),
    res AS (SELECT doc_idx, token_pos, codes, s1::DOUBLE AS token_scale, s2::DOUBLE AS residual_scale, {_CODES.format('s2', 7, 'rest')} AS residual_codes FROM r)"""
_packer("residual_pack", packing.pack_residual, lambda: ["codes", "token_scale", "residual_codes", "residual_scale"], f"{_RES} SELECT * FROM res")
_packer("scale_token_mean", lambda t: packing.token_scale(t, "mean_abs"), lambda: [rounded(F.col("token_scale"), 7).alias("token_scale")], f"SELECT doc_idx, token_pos, round({_MEAN}::DOUBLE, 7) AS token_scale FROM doc_tokens")
_packer("scale_token_l2", lambda t: packing.token_scale(t, "l2"), lambda: [rounded(F.col("token_scale"), 7).alias("token_scale")], "SELECT doc_idx, token_pos, round((sqrt(list_sum([x::DOUBLE * x for x in emb])) / sqrt(len(emb)))::FLOAT::DOUBLE, 7) AS token_scale FROM doc_tokens")
_packer("scale_token_fp16", lambda t: packing.token_scale(t, "fp16"), lambda: ["token_scale"], f"SELECT doc_idx, token_pos, {_fp16(_MEAN)} AS token_scale FROM doc_tokens")


def _log(levels: int) -> str:
    return f""", l AS (SELECT doc_idx, token_pos, ln(greatest({_MEAN}::DOUBLE, 1e-12)) AS v FROM doc_tokens), m AS (SELECT min(v) AS lo, max(v) AS hi FROM l)
    SELECT doc_idx, token_pos, round_even((v - lo) / ((hi - lo) / {levels - 1}), 0)::INT AS log_code, round(exp(lo + round_even((v - lo) / ((hi - lo) / {levels - 1}), 0) * ((hi - lo) / {levels - 1})), 6) AS token_scale FROM l, m"""


for _name, _levels in (("scale_token_u8", 256), ("scale_token_u4", 16), ("scale_token_log2", 2), ("scale_token_log4", 4)):
    _packer(_name, lambda t, n=_levels: packing.token_scale(t, f"log{n}"), lambda: ["log_code", rounded(F.col("token_scale"), 6).alias("token_scale")], _log(_levels))
_packer("scale_group16", lambda t: t.withColumn("scales", V.group_scales(F.col("emb"))), lambda: [F.transform("scales", lambda x: F.round(x.cast("double"), 6)).alias("scales")],
        "SELECT doc_idx, token_pos, [round((list_sum([abs(x::DOUBLE) for x in emb[g * 16 + 1 : g * 16 + 16]]) / 16)::FLOAT::DOUBLE, 6) for g in range(len(emb) // 16)] AS scales FROM doc_tokens")

query("scale_global", "SELECT round(sum(list_sum([abs(x::DOUBLE) for x in emb])) / sum(len(emb)), 8) AS scale FROM doc_tokens")(lambda s, d: packing.global_scale(views.load(s, d).doc_tokens).select(rounded(F.col("scale"), 8).alias("scale")))
_DOC_SCALE = "(SELECT d.doc_idx, coalesce(sum(list_sum([abs(x::DOUBLE) for x in emb])) / sum(len(emb)), 0.0) AS doc_scale FROM docs d LEFT JOIN doc_tokens t USING (doc_idx) GROUP BY d.doc_idx)"


@query("scale_doc", f"SELECT doc_idx, round(doc_scale, 8) AS doc_scale FROM {_DOC_SCALE}")
def _scale_doc(s, d):
    t = views.load(s, d)
    return packing.doc_scale(t.doc_tokens, t.docs).select("doc_idx", rounded(F.col("doc_scale"), 8).alias("doc_scale"))


_UNNEST = ", u AS (SELECT unnest([v::DOUBLE for v in emb]) AS x, unnest(range(len(emb))) AS d FROM doc_tokens)"


def _fit_sql(thresholds: str, steps: int = 0) -> str:
    out, last = f"{_UNNEST}, f0t AS ({thresholds})", "f0t"
    for i in range(steps + 1):
        out += f", f{i} AS (SELECT d, t, coalesce(avg(x) FILTER (x < t), t) AS neg, coalesce(avg(x) FILTER (x >= t), t) AS pos FROM u JOIN {last} USING (d) GROUP BY d, t)"
        last = f"f{i + 1}t"
        if i < steps:
            out += f", {last} AS (SELECT d, (neg + pos) / 2 AS t FROM f{i})"
    return out + f", fit AS (SELECT d, t, neg, pos FROM f{steps})"


_FITS = {"centroid_fit": (_fit_sql("SELECT DISTINCT d, 0.0::DOUBLE AS t FROM u"), lambda t: packing.fit_centroids(t)), "centroid_q40_fit": (_fit_sql("SELECT d, quantile_cont(x, 0.4) AS t FROM u GROUP BY d"), lambda t: packing.fit_centroids(t, packing.fit_thresholds(t, 0.4))), "centroid_lloyd": (_fit_sql("SELECT DISTINCT d, 0.0::DOUBLE AS t FROM u", 3), lambda t: packing.fit_centroids(t, lloyd=3))}
for _name, (_sql, _fit) in _FITS.items():
    query(_name, f"{_sql} SELECT d, round(t, 7) AS t, round(neg, 7) AS neg, round(pos, 7) AS pos FROM fit")(lambda s, d, f=_fit: f(views.load(s, d).doc_tokens).select("d", *(F.round(c, 7).alias(c) for c in ("t", "neg", "pos"))))

# -- scores -------------------------------------------------------------------------------

DOUBLES = "[v::DOUBLE for v in {0}]"


def score_sql(docs: str, queries: str = "SELECT query_idx, q_pos, [v::DOUBLE for v in qemb] AS q, 1.0 AS w FROM query_tokens", reducer: str = "best_match", tau: float = 0.7, scaled: bool = False) -> str:
    """CTE ``scores`` (query_idx, doc_idx, score); ``docs`` selects doc_idx, e (doubles), ts."""
    ds = "coalesce(g.doc_scale, 0)" if scaled else "1.0"
    before, after = (f"* {ds}", "") if reducer == "smoothsim" else ("", f"* {ds}")
    per = {"best_match": "max(s)", "weighted_best_match": "any_value(w) * max(s)", "topk2": "list_avg(list_sort(list(s), 'DESC')[1:2])", "topk4": "list_avg(list_sort(list(s), 'DESC')[1:4])", "smoothsim": f"max(m) + {tau} * ln(sum(exp((s - m) / {tau})))"}[reducer]
    return f""", dq AS ({queries}), dd AS ({docs}), dg AS {_DOC_SCALE},
    p0 AS (SELECT query_idx, q_pos, w, doc_idx, list_inner_product(q, e) * ts {before} AS s FROM dq, dd LEFT JOIN dg g USING (doc_idx)),
    p1 AS (SELECT *, max(s) OVER (PARTITION BY query_idx, q_pos, doc_idx) AS m FROM p0),
    p2 AS (SELECT query_idx, q_pos, doc_idx, {per} AS r FROM p1 GROUP BY query_idx, q_pos, doc_idx),
    p3 AS (SELECT query_idx, doc_idx, sum(r) AS r FROM p2 GROUP BY query_idx, doc_idx),
    scores AS (SELECT qq.query_idx, d.doc_idx, round(coalesce(p3.r {after}, 0) + 0.0, {DIGITS}) AS score
        FROM (SELECT DISTINCT query_idx FROM query_tokens) qq CROSS JOIN docs d LEFT JOIN p3 USING (query_idx, doc_idx) LEFT JOIN dg g USING (doc_idx))"""


def top_sql(k: int = 10, source: str = "scores") -> str:
    return f"(SELECT query_idx, doc_idx, score, row_number() OVER (PARTITION BY query_idx ORDER BY score DESC, doc_idx)::INT AS rank FROM {source} QUALIFY rank <= {k})"


_PLAIN = f"SELECT doc_idx, {DOUBLES.format('emb')} AS e, 1.0 AS ts FROM doc_tokens"
_SIGN_D = f"SELECT doc_idx, {DOUBLES.format(_SIGNS)} AS e, {{0}} AS ts FROM doc_tokens"
_INT4_D = f"SELECT doc_idx, {DOUBLES.format(_CODES.format(_S7, 7, 'emb'))} AS e, {_S7}::DOUBLE AS ts FROM doc_tokens"
_TENSOR_D = f"SELECT doc_idx, [v::DOUBLE * s::DOUBLE for v in {_CODES.format('s', 7, 'emb')}] AS e, 1.0 AS ts FROM doc_tokens, (SELECT (max(list_max([abs(x) for x in emb]))::DOUBLE / 7)::FLOAT AS s FROM doc_tokens)"
_Q8 = f"SELECT query_idx, q_pos, {DOUBLES.format(_CODES.format(_S127.replace('emb', 'qemb'), 127, 'qemb'))} AS q, 1.0 AS w FROM query_tokens"
_QSIGN = "SELECT query_idx, q_pos, [CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END for x in qemb] AS q, 1.0 AS w FROM query_tokens"
_QW = "SELECT query_idx, q_pos, [v::DOUBLE for v in qemb] AS q, 1.0 / (1 + q_pos) - 0.25 AS w FROM query_tokens"


def dense(t: DataFrame) -> DataFrame:
    return t.withColumn("codes", F.col("emb")).withColumn("token_scale", F.lit(1.0))


def scaled_signs(kind: str):
    return lambda t: packing.token_scale(packing.pack_signs(t), kind)


def tensor_int4(t: DataFrame) -> DataFrame:
    packed = packing.with_stat(packing.pack_int4(t, "tensor").drop("token_scale"), most=F.max(V.max_abs(F.col("emb"))))
    return packed.withColumn("token_scale", (F.col("most").cast("double") / 7).cast("float").cast("double"))


def int8_queries(q: DataFrame) -> DataFrame:
    """Integer query codes; the scale of a query token is left to whoever needs it."""
    return packing.pack_int8(q, "qemb").withColumn("qemb", F.col("codes")).drop("codes", "token_scale")


def sign_queries(q: DataFrame) -> DataFrame:
    return q.withColumn("qemb", V.signs(F.col("qemb")))


def residual_values(t: DataFrame) -> DataFrame:
    both = F.zip_with("codes", "residual_codes", lambda a, b: a * F.col("token_scale") + b * F.col("residual_scale"))
    return packing.pack_residual(t).withColumn("codes", both).withColumn("token_scale", F.lit(1.0))


def plain_codes(t: DataFrame) -> DataFrame:
    return packing.pack_int4(t).withColumn("token_scale", F.lit(1.0))


_RES_D = "SELECT doc_idx, [codes[i] * token_scale + residual_codes[i] * residual_scale for i in range(1, len(codes) + 1)] AS e, 1.0 AS ts FROM res"


def scores(s: SparkSession, d: str, pack: Callable[[DataFrame], DataFrame], ask: Callable[[DataFrame], DataFrame] = lambda q: q, reducer: str = "best_match", scaled: bool = False, weight: Column | None = None, only: Callable[[DataFrame], DataFrame] | None = None, top: int | None = None) -> DataFrame:
    t = views.load(s, d)
    tokens, docs = t.doc_tokens, t.docs
    if only:
        docs = only(docs)
        tokens = search.candidates(tokens, docs)
    nested = scoring.nest(pack(tokens), docs, "codes", "token_scale")
    if scaled:
        nested = nested.join(packing.doc_scale(tokens, docs), "doc_idx")
    batch = scoring.query_batch(ask(t.query_tokens), weight=weight)
    return scoring.score(nested, batch, reducer, 0.7 if reducer == "smoothsim" else 1.0, scaled, top, DIGITS).withColumn("score", F.round(F.col("score") + 0.0, DIGITS))


_Q40, _ZERO = _FITS["centroid_q40_fit"], _FITS["centroid_fit"]
_FIT_ROW = ", fr AS (SELECT list(struct_pack(t := t, neg := neg, pos := pos) ORDER BY d) AS f FROM fit)"
_CENTROID_D = "SELECT doc_idx, [CASE WHEN emb[i]::DOUBLE >= f[i].t THEN f[i].pos ELSE f[i].neg END for i in range(1, len(emb) + 1)] AS e, 1.0 AS ts FROM doc_tokens, fr"
_LOG16 = f", l AS (SELECT doc_idx, token_pos, emb, ln(greatest({_MEAN}::DOUBLE, 1e-12)) AS v FROM doc_tokens), m AS (SELECT min(v) AS lo, max(v) AS hi FROM l)"
_MEDIAN = f"{_UNNEST}, th AS (SELECT list(t ORDER BY d) AS t FROM (SELECT d, quantile_cont(x, 0.5) AS t FROM u GROUP BY d))"

#: name: (pack, queries, reducer, doc scale, SQL before, SQL of documents, SQL of queries)
FORMATS: dict[str, tuple] = {
    "dense_best_match": (dense, None, "best_match", False, "", _PLAIN, None),
    "weighted_best_match": (dense, "w", "weighted_best_match", False, "", _PLAIN, _QW),
    "topk2": (dense, None, "topk2", False, "", _PLAIN, None),
    "topk4": (dense, None, "topk4", False, "", _PLAIN, None),
    "smoothsim": (dense, None, "smoothsim", False, "", _PLAIN, None),
    "binary_best_match": (packing.pack_signs, None, "best_match", False, "", _SIGN_D.format("1.0"), None),
    "binary_binary_best_match": (packing.pack_signs, sign_queries, "best_match", False, "", _SIGN_D.format("1.0"), _QSIGN),
    "int8q_binary_best_match": (packing.pack_signs, int8_queries, "best_match", False, "", _SIGN_D.format("1.0"), _Q8),
    "token_scale_best_match": (scaled_signs("mean_abs"), None, "best_match", False, "", _SIGN_D.format(f"{_MEAN}::DOUBLE"), None),
    "token_scale_fp16_best_match": (scaled_signs("fp16"), None, "best_match", False, "", _SIGN_D.format(_fp16(_MEAN)), None),
    "token_scale_u4_best_match": (scaled_signs("u4"), None, "best_match", False, _LOG16, f"SELECT doc_idx, {DOUBLES.format(_SIGNS)} AS e, exp(lo + round_even((v - lo) / ((hi - lo) / 15), 0) * ((hi - lo) / 15)) AS ts FROM l, m", None),
    "doc_scale_best_match": (packing.pack_signs, None, "best_match", True, "", _SIGN_D.format("1.0"), None),
    "doc_scale_smoothsim": (packing.pack_signs, None, "smoothsim", True, "", _SIGN_D.format("1.0"), None),
    "group16_best_match": (packing.pack_group_scaled_signs, None, "best_match", False, "", "SELECT doc_idx, [(CASE WHEN emb[i] >= 0 THEN 1 ELSE -1 END) * (list_sum([abs(x::DOUBLE) for x in emb[((i - 1) // 16) * 16 + 1 : ((i - 1) // 16) * 16 + 16]]) / 16)::FLOAT::DOUBLE for i in range(1, len(emb) + 1)] AS e, 1.0 AS ts FROM doc_tokens", None),
    "threshold_sign_best_match": (packing.pack_threshold_signs, None, "best_match", False, _MEDIAN, "SELECT doc_idx, [CASE WHEN emb[i]::DOUBLE >= t[i] THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END for i in range(1, len(emb) + 1)] AS e, 1.0 AS ts FROM doc_tokens, th", None),
    "centroid_best_match": (lambda t: packing.pack_centroid_signs(t, packing.fit_centroids(t)), None, "best_match", False, _ZERO[0] + _FIT_ROW, _CENTROID_D, None),
    "centroid_q40_best_match": (lambda t: packing.pack_centroid_signs(t, packing.fit_centroids(t, packing.fit_thresholds(t))), None, "best_match", False, _Q40[0] + _FIT_ROW, _CENTROID_D, None),
    "ternary_best_match": (lambda t: packing.pack_ternary(t, 0.05), None, "best_match", False, "", "SELECT doc_idx, [CASE WHEN x > 0.05::DOUBLE THEN 1.0::DOUBLE WHEN x < -0.05::DOUBLE THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END for x in [v::DOUBLE for v in emb]] AS e, 1.0 AS ts FROM doc_tokens", None),
    "int4_best_match": (packing.pack_int4, None, "best_match", False, "", _INT4_D, None),
    "int4_tensor_best_match": (tensor_int4, None, "best_match", False, "", _TENSOR_D, None),
    "int8_best_match": (packing.pack_int8, None, "best_match", False, "", f"SELECT doc_idx, {DOUBLES.format(_CODES.format(_S127, 127, 'emb'))} AS e, {_S127}::DOUBLE AS ts FROM doc_tokens", None),
    "int8q_int8_best_match": (packing.pack_int8, int8_queries, "best_match", False, "", f"SELECT doc_idx, {DOUBLES.format(_CODES.format(_S127, 127, 'emb'))} AS e, {_S127}::DOUBLE AS ts FROM doc_tokens", _Q8),
    "int8q_int4_best_match": (packing.pack_int4, int8_queries, "best_match", False, "", _INT4_D, _Q8),
    "residual_score": (residual_values, None, "best_match", False, _RES, _RES_D, None),
    "prefix_score": (packing.pack_int4, None, "best_match", False, "", _INT4_D, None),
}


def _scored(s: SparkSession, d: str, name: str, **more) -> DataFrame:
    pack, ask, reducer, scaled, *_ = FORMATS[name]
    weight = F.lit(1.0) / (1 + F.col("q_pos")) - 0.25 if ask == "w" else None
    return scores(s, d, pack, ask if callable(ask) else lambda q: q, reducer, scaled, weight, **more)


def _scored_sql(name: str) -> str:
    _, _, reducer, scaled, before, docs, ask = FORMATS[name]
    return before + (score_sql(docs, ask, reducer, scaled=scaled) if ask else score_sql(docs, reducer=reducer, scaled=scaled))


for _name in FORMATS:
    query(_name, f"{_scored_sql(_name)} SELECT * FROM scores")(lambda s, d, n=_name: _scored(s, d, n))


# -- search -------------------------------------------------------------------------------


def _top(name: str, key: str, k: int = 10) -> None:
    @query(key, f"{_scored_sql(name)} SELECT query_idx, rank, doc_id, score FROM {top_sql(k)} JOIN docs USING (doc_idx)")
    def run(s, d):
        return search.with_ids(search.top_k(_scored(s, d, name, top=k), k), views.load(s, d).docs)


_top("dense_best_match", "search_topk")
_top("int4_best_match", "int4_topk")
_top("ternary_best_match", "ternary_topk")
_top("centroid_q40_best_match", "centroid_topk")
_top("prefix_score", "prefix_topk")
_top("binary_best_match", "binary_topk")
_top("token_scale_fp16_best_match", "balanced_topk")
_top("smoothsim", "smoothsim_topk")

_INTS = score_sql(f"SELECT doc_idx, {DOUBLES.format(_CODES.format(_S7, 7, 'emb'))} AS e, 1.0 AS ts FROM doc_tokens", _Q8)


@query("int8q_int4_best_match_topk", f"{_INTS} SELECT query_idx, rank, doc_id, score::BIGINT AS score FROM {top_sql()} JOIN docs USING (doc_idx)")
def _flagship(s, d):
    """Integers only: int8 query codes against int4 document codes."""
    ranked = search.top_k(scores(s, d, plain_codes, int8_queries, top=10), 10)
    return search.with_ids(ranked, views.load(s, d).docs).withColumn("score", F.col("score").cast("long"))


@query("candidate_score", f"{_scored_sql('dense_best_match')} SELECT * FROM scores WHERE doc_idx IN (SELECT doc_idx FROM qrels WHERE rel = 2)")
def _candidate_score(s, d):
    wanted = views.load(s, d).qrels.filter("rel = 2")
    return _scored(s, d, "dense_best_match", only=lambda docs: search.candidates(docs, wanted))


_ORDER = "SELECT 'doc-' || ((i * 5) % 12) AS doc_id, i AS pos FROM range(20) t(i)"


@query("rerank", f"""{_scored_sql('int4_best_match')}, o AS (SELECT doc_id, min(pos) AS pos FROM ({_ORDER}) GROUP BY doc_id)
    SELECT query_idx, row_number() OVER (PARTITION BY query_idx ORDER BY score DESC, pos)::INT AS rank, doc_id, score
    FROM scores JOIN docs USING (doc_idx) JOIN o USING (doc_id) QUALIFY rank <= 8""")  # fmt: skip
def _rerank(s, d):
    docs = views.load(s, d).docs
    order = s.range(20).select(F.concat(F.lit("doc-"), ((F.col("id") * 5) % 12).cast("string")).alias("doc_id"), F.col("id").alias("pos"))
    wanted = docs.join(F.broadcast(order.select("doc_id").distinct()), "doc_id", "left_semi")
    return search.rerank(_scored(s, d, "int4_best_match", only=lambda x: search.candidates(x, wanted)), order, docs, 8)


_CASCADE = _RES + score_sql(_INT4_D).replace("scores AS", "coarse AS").replace(" dq AS", " dq1 AS").replace("FROM dq,", "FROM dq1,").replace(" dd AS", " dd1 AS").replace(", dd LEFT", ", dd1 LEFT")
for _p in ("dg", "p0", "p1", "p2", "p3"):
    _CASCADE = _CASCADE.replace(f" {_p} AS", f" {_p}c AS").replace(f"FROM {_p} ", f"FROM {_p}c ").replace(f"JOIN {_p} ", f"JOIN {_p}c ").replace(f"FROM {_p})", f"FROM {_p}c)").replace(f"{_p}.r", f"{_p}c.r")


@query("cascade_topk", f"""{_CASCADE}{score_sql(_RES_D)}, kept AS (SELECT query_idx, doc_idx FROM {top_sql(20, 'coarse')}), fine AS (SELECT * FROM scores JOIN kept USING (query_idx, doc_idx))
    SELECT query_idx, rank, doc_id, score FROM {top_sql(5, 'fine')} JOIN docs USING (doc_idx)""")  # fmt: skip
def _cascade(s, d):
    return search.with_ids(_cascaded(s, d, "prefix_score", "residual_score", 20, 5), views.load(s, d).docs)


def _cascaded(s: SparkSession, d: str, coarse: str, fine: str, keep: int, k: int) -> DataFrame:
    """Each task's best ``keep`` by the coarse scores leave it; only documents that are among some query's are scored again."""
    first = checkpointed(search.top_k(_scored(s, d, coarse, top=keep), keep).select("query_idx", "doc_idx"))
    return search.top_k(first.join(_scored(s, d, fine, only=lambda docs: search.candidates(docs, first)), ["query_idx", "doc_idx"]), k)


_MEANP = """, mp AS (SELECT doc_idx, list(m ORDER BY d) AS e FROM (SELECT doc_idx, d, avg(x)::FLOAT::DOUBLE AS m FROM (SELECT doc_idx, unnest([v::DOUBLE for v in emb]) AS x, unnest(range(len(emb))) AS d FROM doc_tokens) GROUP BY doc_idx, d) GROUP BY doc_idx),
    mq AS (SELECT query_idx, list(m ORDER BY d) AS q FROM (SELECT query_idx, d, avg(x)::FLOAT::DOUBLE AS m FROM (SELECT query_idx, unnest([v::DOUBLE for v in qemb]) AS x, unnest(range(len(qemb))) AS d FROM query_tokens) GROUP BY query_idx, d) GROUP BY query_idx)"""


def mean_pool(tokens: DataFrame, key: str, vector: str) -> DataFrame:
    """One vector a group: means in double, as floats. Empty documents have none."""
    per = tokens.select(key, F.posexplode(vector).alias("d", "x")).groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).cast("float").alias("m"))
    return per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("v"))


@query("meanpool_search", f"{_MEANP}, s1 AS (SELECT query_idx, doc_idx, round(list_inner_product(q, e), {DIGITS}) AS score FROM mq, mp) SELECT query_idx, rank, doc_id, score FROM {top_sql(10, 's1')} JOIN docs USING (doc_idx)")
def _meanpool(s, d):
    t = views.load(s, d)
    nested = mean_pool(t.doc_tokens, "doc_idx", "emb").select("doc_idx", F.array(F.struct(F.lit(0).alias("token_pos"), F.col("v").alias("codes"), F.lit(1.0).alias("token_scale"))).alias("tokens"))
    asked = mean_pool(t.query_tokens, "query_idx", "qemb").select("query_idx", F.lit(0).alias("q_pos"), F.col("v").alias("qemb"))
    out = scoring.score(nested, scoring.query_batch(asked), top=10, digits=DIGITS).withColumn("score", F.round("score", DIGITS))
    return search.with_ids(search.top_k(out, 10), t.docs)


@query("token_candidate_rerank", f"""{_scored_sql('dense_best_match')},
    tk AS (SELECT query_idx, q_pos, doc_idx, token_pos, round(list_inner_product([v::DOUBLE for v in qemb], [v::DOUBLE for v in emb]), {DIGITS}) AS s FROM query_tokens, doc_tokens
        QUALIFY row_number() OVER (PARTITION BY query_idx, q_pos ORDER BY s DESC, doc_idx, token_pos) <= 8),
    c AS (SELECT DISTINCT query_idx, doc_idx FROM tk), s1 AS (SELECT * FROM scores JOIN c USING (query_idx, doc_idx))
    SELECT query_idx, rank, doc_id, score FROM {top_sql(5, 's1')} JOIN docs USING (doc_idx)""")  # fmt: skip
def _token_candidates(s, d):
    """The 8 nearest tokens of each query token name the documents that are scored in full."""
    t = views.load(s, d)
    one = t.doc_tokens.select((F.col("doc_idx") * 8 + F.col("token_pos")).alias("doc_idx"), F.array(F.struct(F.lit(0).alias("token_pos"), F.col("emb").alias("codes"), F.lit(1.0).alias("token_scale"))).alias("tokens"))
    asked = scoring.query_batch(t.query_tokens.select((F.col("query_idx") * 64 + F.col("q_pos")).alias("query_idx"), F.lit(0).alias("q_pos"), "qemb"))
    near = search.top_k(scoring.score(one, asked, top=8, digits=DIGITS).withColumn("score", F.round("score", DIGITS)), 8)
    wanted = near.select(F.expr("query_idx div 64").alias("query_idx"), F.expr("doc_idx div 8").alias("doc_idx")).distinct()
    fine = _scored(s, d, "dense_best_match", only=lambda docs: search.candidates(docs, wanted))
    return search.with_ids(search.top_k(fine.join(wanted, ["query_idx", "doc_idx"]), 5), t.docs)


@query("query_prune", f"""{_MEANP},
    c AS (SELECT query_idx, q_pos, round(list_cosine_similarity([v::DOUBLE for v in qemb], q), {DIGITS}) AS sim, count(*) OVER (PARTITION BY query_idx) AS n FROM query_tokens JOIN mq USING (query_idx))
    SELECT query_idx, q_pos, sim FROM c QUALIFY row_number() OVER (PARTITION BY query_idx ORDER BY sim, q_pos) <= ceil(0.5 * n)""")  # fmt: skip
def _query_prune(s, d):
    """Half of a query's tokens stay: those least like their mean."""
    from pyspark.sql import Window

    q = views.load(s, d).query_tokens
    norm = lambda x: F.sqrt(V.dot(x, x))
    sim = F.round(V.dot(F.col("qemb"), F.col("v")) / (norm(F.col("qemb")) * norm(F.col("v"))), DIGITS)
    whole = Window.partitionBy("query_idx")
    c = q.join(mean_pool(q, "query_idx", "qemb"), "query_idx").select("query_idx", "q_pos", sim.alias("sim"), F.count("*").over(whole).alias("n"))
    return c.withColumn("r", F.row_number().over(whole.orderBy("sim", "q_pos"))).filter(F.col("r") <= F.ceil(0.5 * F.col("n"))).select("query_idx", "q_pos", "sim")


@query("ward_pool")
def _ward(s, d):
    return pooling.pool(views.load(s, d).doc_tokens, 3).withColumn("emb", F.transform("emb", lambda x: F.round(x, 6)))


@query("pooled_binary_topk")
def _pooled(s, d):
    t = views.load(s, d)
    nested = scoring.nest(packing.pack_signs(pooling.pool(t.doc_tokens, 3)), t.docs, "codes", "token_scale")
    return search.with_ids(search.top_k(scoring.score(nested, scoring.query_batch(t.query_tokens)).withColumn("score", F.round("score", DIGITS)), 10), t.docs)


# -- metrics ------------------------------------------------------------------------------


def _metric_sql(source: str, gain: str = "pow(2, rel) - 1", suffix: str = "") -> str:
    return f""", rk{suffix} AS {top_sql(10, source)},
    id{suffix} AS (SELECT query_idx, count(*) AS n, sum(({gain}) / log2(r + 1)) FILTER (r <= 10) AS idcg FROM (SELECT query_idx, rel, row_number() OVER (PARTITION BY query_idx ORDER BY rel DESC, doc_idx) AS r FROM qrels WHERE rel > 0) GROUP BY query_idx),
    hit{suffix} AS (SELECT query_idx, count(*) AS found, min(rank) AS first, sum(({gain}) / log2(rank + 1)) AS dcg FROM rk{suffix} JOIN qrels USING (query_idx, doc_idx) WHERE rel > 0 GROUP BY query_idx),
    per{suffix} AS (SELECT query_idx, coalesce(found / n, 0.0)::DOUBLE AS recall, coalesce(1.0 / first, 0.0)::DOUBLE AS mrr, coalesce(dcg / idcg, 0.0)::DOUBLE AS ndcg FROM id{suffix} LEFT JOIN hit{suffix} USING (query_idx))"""


def _per(s: SparkSession, d: str, name: str, linear: bool = False) -> DataFrame:
    return metrics.per_query(search.top_k(_scored(s, d, name, top=10), 10), views.load(s, d).qrels, 10, linear)


_DENSE = _scored_sql("dense_best_match")
_R6 = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)
_r6 = lambda *c: [F.round(x, 6).alias(x) for x in c]


@query("ranking_metrics", f"{_DENSE}{_metric_sql('scores')} SELECT round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM per")
def _ranking_metrics(s, d):
    return metrics.summary(_per(s, d, "dense_best_match")).select(*_r6("recall", "mrr", "ndcg"))


@query("per_query_ndcg", f"{_DENSE}{_metric_sql('scores')} SELECT query_idx, {_R6('recall', 'mrr', 'ndcg')} FROM per")
def _per_query(s, d):
    return _per(s, d, "dense_best_match").select("query_idx", *_r6("recall", "mrr", "ndcg"))


@query("ndcg_linear", f"{_DENSE}{_metric_sql('scores', 'rel')} SELECT query_idx, {_R6('ndcg')} FROM per")
def _linear(s, d):
    return _per(s, d, "dense_best_match", True).select("query_idx", *_r6("ndcg"))


_STRICT = _DENSE + ", strict AS (SELECT * FROM qrels WHERE rel = 2)" + _metric_sql("scores").replace("qrels", "strict") + ", every AS (SELECT DISTINCT query_idx FROM query_tokens)"
_R8 = lambda *c, by="{0}": ", ".join(f"round({by.format(x)}, 8) AS {x}" for x in c)


def _strict(s: SparkSession, d: str, missing: float | None) -> DataFrame:
    """Quality where only the best grade counts as relevant, so that queries may have no relevant document."""
    t = views.load(s, d)
    per = metrics.per_query(search.top_k(_scored(s, d, "dense_best_match", top=10), 10), t.qrels.filter("rel = 2"), 10)
    return metrics.for_all(per, t.query_tokens, missing).select("query_idx", *(F.round(c, 8).alias(c) for c in ("recall", "ndcg")))


@query("per_query_quality", f"{_STRICT} SELECT query_idx, {_R8('recall', 'ndcg')} FROM every LEFT JOIN per USING (query_idx)")
def _quality_null(s, d):
    return _strict(s, d, None)


@query("production_quality", f"{_STRICT} SELECT query_idx, {_R8('recall', 'ndcg', by='coalesce({0}, 0.0)')} FROM every LEFT JOIN per USING (query_idx)")
def _quality_zero(s, d):
    return _strict(s, d, 0.0)


def _second(name: str) -> str:
    """A second format's scores under other names, beside the dense ones."""
    out = _scored_sql(name)
    for c in ("dq", "dd", "dg", "p0", "p1", "p2", "p3", "scores"):
        out = out.replace(f" {c} AS", f" {c}_b AS").replace(f"FROM {c} ", f"FROM {c}_b ").replace(f"FROM {c},", f"FROM {c}_b,").replace(f"FROM {c})", f"FROM {c}_b)").replace(f", {c} LEFT", f", {c}_b LEFT").replace(f"JOIN {c} ", f"JOIN {c}_b ").replace(f"{c}.r", f"{c}_b.r")
    return out


_TWO = _DENSE + _second("binary_best_match")


@query("topk_agreement", f"{_TWO}, a AS {top_sql(10)}, b AS {top_sql(10, 'scores_b')} SELECT round(count(*) FILTER (b.doc_idx IS NOT NULL) / (10.0 * count(DISTINCT query_idx)), 6) AS agreement FROM a LEFT JOIN b USING (query_idx, doc_idx)")
def _agreement(s, d):
    a, b = (search.top_k(_scored(s, d, n, top=10), 10) for n in ("dense_best_match", "binary_best_match"))
    return metrics.agreement(a, b, 10).select(*_r6("agreement"))


@query("paired_deltas", f"{_TWO}{_metric_sql('scores')}{_metric_sql('scores_b', suffix='_b')}, x AS (SELECT b.ndcg - a.ndcg AS e FROM per a JOIN per_b b USING (query_idx)) SELECT count(*) AS queries, round(avg(e), 6) AS mean_delta, count(*) FILTER (e > 1e-9) AS wins, count(*) FILTER (e < -1e-9) AS losses, count(*) FILTER (abs(e) <= 1e-9) AS ties FROM x")
def _paired(s, d):
    out = metrics.paired(_per(s, d, "dense_best_match"), _per(s, d, "binary_best_match"))
    return out.withColumn("mean_delta", F.round("mean_delta", 6))


_LEN = "(SELECT d.doc_idx, count(t.doc_idx) AS n_tokens FROM docs d LEFT JOIN doc_tokens t USING (doc_idx) GROUP BY d.doc_idx)"


def lengths(s: SparkSession, d: str) -> DataFrame:
    t = views.load(s, d)
    return t.docs.select("doc_idx").join(t.doc_tokens.groupBy("doc_idx").agg(F.count("*").alias("n_tokens")), "doc_idx", "left").select("doc_idx", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


@query("doc_token_summary", f"SELECT min(n_tokens) AS least, round(avg(n_tokens), 6) AS mean, quantile_cont(n_tokens, 0.5) AS p50, round(quantile_cont(n_tokens, 0.95), 6) AS p95, round(quantile_cont(n_tokens, 0.99), 6) AS p99, max(n_tokens) AS most FROM {_LEN}")
def _length_summary(s, d):
    return metrics.length_summary(lengths(s, d)).select("least", *_r6("mean", "p50", "p95", "p99"), "most")


@query("token_buckets", f"""{_DENSE}{_metric_sql('scores')}, ln AS {_LEN}, cuts AS (SELECT quantile_cont(n_tokens, 1/3) AS lower, quantile_cont(n_tokens, 2/3) AS upper FROM ln),
    mn AS (SELECT query_idx, avg(n_tokens) AS n FROM qrels JOIN ln USING (doc_idx) WHERE rel > 0 GROUP BY query_idx)
    SELECT CASE WHEN n <= lower THEN 'short' WHEN n <= upper THEN 'medium' ELSE 'long' END AS bucket, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall FROM per JOIN mn USING (query_idx), cuts GROUP BY 1""")  # fmt: skip
def _buckets(s, d):
    return metrics.token_buckets(_per(s, d, "dense_best_match"), views.load(s, d).qrels, lengths(s, d)).select("bucket", "queries", *_r6("ndcg", "recall"))


@query("multi_dataset_agg", f"""{_TWO}{_metric_sql('scores')}{_metric_sql('scores_b', suffix='_b')},
    rows AS (SELECT 'dense' AS implementation, query_idx % 3 AS dataset, avg(ndcg) AS value FROM per GROUP BY ALL UNION ALL SELECT 'binary', query_idx % 3, avg(ndcg) FROM per_b GROUP BY ALL)
    SELECT implementation, count(value) AS datasets, count(*) FILTER (value IS NULL) AS unavailable, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(coalesce(exp(avg(ln(CASE WHEN value > 0 THEN value END))), 0), 6) AS geomean FROM rows GROUP BY implementation""")  # fmt: skip
def _across(s, d):
    rows = None
    for key, name in (("dense", "dense_best_match"), ("binary", "binary_best_match")):
        one = _per(s, d, name).groupBy((F.col("query_idx") % 3).alias("dataset")).agg(F.avg("ndcg").alias("value")).withColumn("implementation", F.lit(key))
        rows = one if rows is None else rows.unionByName(one)
    return metrics.across(rows).select("implementation", "datasets", "unavailable", *_r6("mean", "median", "geomean"))
