"""Index and Reranker: packed multi-vector documents as a table, searched exactly.

An index is one row per document (doc_idx, doc_id, tokens), with codes of small integers that
Parquet stores at a few bits a value; prefix and residual codes are fields of their own, so a
coarse scan reads the prefix only. Metadata travels as a JSON row beside the table, read and
written by Spark, so an index may lie in any store.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import packing, pooling, scoring, search

VERSION = 1
#: Presets and the modes they stand for.
PRESETS = {"balanced": "binary_token_scale", "max_quality": "int4_per_token", "max_compression": "pooled_binary", "compact": "binary_token_scale_u4", "max_speed": "binary", "auto": "int4_per_token"}
PACKERS = {
    "binary": packing.pack_signs,
    "binary_token_scale": lambda t: packing.token_scale(packing.pack_signs(t), "fp16"),
    "binary_token_scale_u8": lambda t: packing.token_scale(packing.pack_signs(t), "u8"),
    "binary_token_scale_u4": lambda t: packing.token_scale(packing.pack_signs(t), "u4"),
    "pooled_binary": packing.pack_signs,
    "binary_q40": lambda t: packing.pack_centroid_signs(t, packing.fit_centroids(t, packing.fit_thresholds(t, 0.4))),
    "int4": lambda t: packing.pack_int4(t, "tensor").withColumn("token_scale", F.lit(1.0)),
    "int4_per_token": packing.pack_int4,
    "int4_residual": packing.pack_residual,
    "ternary": packing.pack_ternary,
    "int8": packing.pack_int8,
    "dense": lambda t: t.withColumn("codes", F.col("emb")).withColumn("token_scale", F.lit(1.0)),
}
#: Bytes of n tokens of d dimensions.
BYTES = {
    "binary": lambda n, d: n * d // 8,
    "binary_token_scale": lambda n, d: n * d // 8 + 2 * n,
    "binary_token_scale_u8": lambda n, d: n * d // 8 + n + 16,
    "binary_token_scale_u4": lambda n, d: n * d // 8 + (n + 1) // 2 + 16,
    "pooled_binary": lambda n, d: n * d // 8,
    "binary_q40": lambda n, d: n * d // 8 + 12 * d,
    "int4": lambda n, d: n * d // 2 + 4,
    "int4_per_token": lambda n, d: n * d // 2 + 4 + 4 * n,
    "int4_residual": lambda n, d: n * d + 8 + 8 * n,
    "ternary": lambda n, d: n * d // 4,
    "int8": lambda n, d: n * (d + 4),
    "dense": lambda n, d: 4 * n * d,
}


@dataclass(frozen=True)
class Index:
    mode: str
    table: DataFrame
    metadata: dict = field(default_factory=dict)

    @classmethod
    def from_tokens(cls, docs: DataFrame, tokens: DataFrame, mode: str = "auto", pool_factor: int | None = None, metadata: dict | None = None) -> Index:
        """``docs``: doc_idx, doc_id (unique); ``tokens``: doc_idx, token_pos, emb."""
        asked, mode = mode, PRESETS.get(mode, mode)
        if mode not in PACKERS:
            raise ValueError(f"unknown mode {mode!r}")
        if pool_factor is not None and (isinstance(pool_factor, bool) or not isinstance(pool_factor, int) or pool_factor < 1):
            raise ValueError("pool_factor must be an integer of at least 1")
        packing.require(tokens)
        docs = docs.select("doc_idx", F.col("doc_id").cast("string").alias("doc_id"))
        n = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
        if not n.n or n.n != n.ids:
            raise ValueError("document ids must be present and unique")
        if mode.startswith(("int4", "int8")):
            bad = tokens.filter(F.exists("emb", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())).limit(1).count()
            if bad:
                raise ValueError("embeddings must be finite")
        meta = dict(metadata or {})
        if mode == "pooled_binary":
            factor = pool_factor or (3 if asked == "max_compression" else 2)
            meta |= {"pool_factor": factor, "original_tokens": tokens.count()}
            tokens = pooling.pool(tokens, factor)
        elif pool_factor not in (None, 1):
            meta |= {"pool_factor": pool_factor, "original_tokens": tokens.count()}
            tokens = pooling.pool(tokens, pool_factor)
        packed = PACKERS[mode](tokens)
        if mode == "int4":
            packed = packing.with_stat(packed, s=F.max(F.array_max(F.transform("emb", F.abs)))).withColumn("token_scale", F.when(F.col("s") == 0, 1.0).otherwise(F.col("s").cast("double") / 7).cast("float").cast("double"))
        if mode not in ("binary_q40", "dense"):
            packed = packed.withColumn("codes", F.col("codes").cast("array<tinyint>"))
        columns = ["codes", "token_scale"]
        if mode == "int4_residual":
            packed = packed.withColumn("residual_codes", F.col("residual_codes").cast("array<tinyint>"))
            columns += ["residual_codes", "residual_scale"]
        return cls(mode, scoring.nest(packed, docs, *columns).join(docs, "doc_idx"), meta)

    def save(self, path: str) -> None:
        self.table.repartition("doc_idx").sortWithinPartitions("doc_idx").write.mode("overwrite").parquet(f"{path}/documents")
        note = json.dumps({"version": VERSION, "format": "tokenloom-index", "mode": self.mode, "metadata": self.metadata})
        self.table.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str) -> Index:
        note = json.loads(spark.read.text(f"{path}/meta").first().value)
        if note.get("format") != "tokenloom-index" or note.get("version") != VERSION or note.get("mode") not in PACKERS:
            raise ValueError("not an index of this version")
        table = spark.read.parquet(f"{path}/documents")
        fields = set(table.schema["tokens"].dataType.elementType.names)
        if not {"codes", "token_scale"} <= fields or ("residual_codes" in fields) != (note["mode"] == "int4_residual"):
            raise ValueError("the table does not hold what its mode needs")
        limit = {"int4": 7, "int4_per_token": 7, "int4_residual": 7, "int8": 127}.get(note["mode"])
        if limit:
            wrong = F.exists("tokens", lambda t: F.exists(t["codes"], lambda c: F.abs(c) > limit) | (t["token_scale"] <= 0) | F.isnan(t["token_scale"]))
            if table.filter(wrong).limit(1).count():
                raise ValueError("codes or scales out of range")
        return cls(note["mode"], table, note["metadata"])

    @property
    def num_docs(self) -> int:
        return self.table.count()

    def memory_report(self) -> dict:
        row = self.table.select(F.explode("tokens").alias("t")).agg(F.count("*").alias("n"), F.max(F.size("t.codes")).alias("d")).first()
        n, d = row.n, row.d or 0
        encoded = BYTES[self.mode](n, d)
        return {"tokens": n, "dim": d, "encoded_bytes": encoded, "compression_vs_fp32": 4.0 * n * d / encoded if encoded else 0.0}


@dataclass(frozen=True)
class Reranker:
    index: Index

    def _docs(self, fine: bool) -> DataFrame:
        table = self.index.table
        if self.index.mode != "int4_residual":
            return table
        if not fine:
            return table.select("doc_idx", "doc_id", F.transform("tokens", lambda t: F.struct(t["token_pos"].alias("token_pos"), t["codes"].alias("codes"), t["token_scale"].alias("token_scale"))).alias("tokens"))
        fused = lambda t: F.zip_with(t["codes"], t["residual_codes"], lambda a, b: a * t["token_scale"] + b * t["residual_scale"])
        return table.select("doc_idx", "doc_id", F.transform("tokens", lambda t: F.struct(t["token_pos"].alias("token_pos"), fused(t).alias("codes"), F.lit(1.0).alias("token_scale"))).alias("tokens"))

    def _check(self, reducer: str, temperature: float, weighted: bool) -> None:
        scoring.check(reducer, temperature, weighted)
        if self.index.mode == "binary_q40" and reducer != "best_match":
            raise ValueError("binary_q40 supports best_match only")

    def search(self, queries: DataFrame, k: int = 10, rescore_candidates: int | None = None, reducer: str = "best_match", query_weights: bool = False, temperature: float = 1.0, int4_query: str = "float") -> DataFrame:
        """(query_idx, rank, doc_id, score); with int4_query="int8", int4 documents meet int8 query codes (best_match over
        the whole index only). ``queries``: query_idx, q_pos, qemb and, if weighted, weight."""
        self._check(reducer, temperature, query_weights)
        if k < 1:
            raise ValueError("k must be at least 1")
        if int4_query not in ("float", "int8"):
            raise ValueError("int4_query must be float or int8")
        if int4_query == "int8" and self.index.mode in ("int4", "int4_per_token") and reducer == "best_match":
            coded = packing.pack_int8(queries, "qemb")
            queries = coded.withColumn("qemb", F.transform("codes", lambda c: c * F.col("token_scale")))
        batch = scoring.query_batch(queries, weight=F.col("weight") if query_weights else None)
        docs = self.index.table.select("doc_idx", "doc_id")
        if rescore_candidates is None:
            best = scoring.score(self._docs(True), batch, reducer, temperature, top=k)
            return search.with_ids(search.top_k(best, k), docs)
        if self.index.mode != "int4_residual":
            raise ValueError("rescore_candidates needs an int4_residual index")
        if not 1 <= k <= rescore_candidates:
            raise ValueError("1 <= k <= candidates must hold")
        coarse = search.top_k(scoring.score(self._docs(False), batch, reducer, temperature, top=rescore_candidates), rescore_candidates).select("query_idx", "doc_idx")
        few = search.candidates(self._docs(True), coarse)
        fine = scoring.score(few, batch, reducer, temperature).join(coarse, ["query_idx", "doc_idx"])
        return search.with_ids(search.top_k(fine, k), docs)

    def rerank(self, queries: DataFrame, candidate_ids: list[str], k: int = 10, reducer: str = "best_match", query_weights: bool = False, temperature: float = 1.0) -> DataFrame:
        """Candidates by score; repeated ones count once, ties go to the earlier; an unknown id is a KeyError."""
        self._check(reducer, temperature, query_weights)
        spark = self.index.table.sparkSession
        ids = list(dict.fromkeys(map(str, candidate_ids)))
        order = spark.createDataFrame([(i, p) for p, i in enumerate(ids)], "doc_id string, pos long")
        docs = self.index.table.select("doc_idx", "doc_id")
        known = {r.doc_id for r in docs.join(F.broadcast(order), "doc_id").select("doc_id").collect()} if ids else set()
        for i in ids:
            if i not in known:
                raise KeyError(i)
        if not ids or k < 1:
            return spark.createDataFrame([], "query_idx long, rank int, doc_id string, score double")
        batch = scoring.query_batch(queries, weight=F.col("weight") if query_weights else None)
        few = self._docs(True).join(F.broadcast(order.select("doc_id")), "doc_id", "left_semi")
        return search.rerank(scoring.score(few, batch, reducer, temperature), order, docs, k)
