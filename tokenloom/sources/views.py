"""Multi-vector tables: ragged documents and queries in token-long form.

doc_tokens (doc_idx, token_pos, emb), query_tokens (query_idx, q_pos, qemb), docs (doc_idx,
doc_id) and qrels (query_idx, doc_idx, rel), derived from a table of single vectors by
arithmetic on its key alone, so a scan of any of them prunes to the columns it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tables:
    docs: DataFrame
    doc_tokens: DataFrame
    query_tokens: DataFrame
    qrels: DataFrame


def from_embeddings(vectors: DataFrame) -> Tables:
    """Eight vectors a document (ragged, some empty), a query from each fifty, graded relevance by label."""
    vectors = vectors.withColumn("doc_idx", F.expr("vec_id div 8")).withColumn("query_idx", F.expr("vec_id div 50"))
    docs = vectors.select("doc_idx").distinct().withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_idx").cast("string")))
    doc_tokens = vectors.filter("vec_id % 8 < doc_idx % 9").select("doc_idx", F.expr("vec_id % 8").alias("token_pos"), F.col("embedding").alias("emb"), "label")
    query_tokens = vectors.filter("vec_id % 50 < 2 + query_idx % 3").select("query_idx", F.expr("vec_id % 50").alias("q_pos"), F.col("embedding").alias("qemb"), "label")
    # Labels are few: relevance is an equi-join on the label of counts, not of tokens.
    wanted = query_tokens.filter("q_pos = 0").select("query_idx", "label")
    held = doc_tokens.groupBy("doc_idx", "label").count()
    qrels = wanted.join(held, "label").select("query_idx", "doc_idx", F.least(F.col("count"), F.lit(2)).cast("double").alias("rel"))
    return Tables(docs, doc_tokens.drop("label"), query_tokens.drop("label"), qrels)


def load(spark: SparkSession, sf_dir: str) -> Tables:
    return from_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same tables for DuckDB, to stand before a query.
SQL = """WITH docs AS (SELECT DISTINCT vec_id // 8 AS doc_idx, 'doc-' || (vec_id // 8) AS doc_id FROM embeddings),
doc_tokens AS (SELECT vec_id // 8 AS doc_idx, vec_id % 8 AS token_pos, embedding AS emb, label FROM embeddings WHERE vec_id % 8 < (vec_id // 8) % 9),
query_tokens AS (SELECT vec_id // 50 AS query_idx, vec_id % 50 AS q_pos, embedding AS qemb, label FROM embeddings WHERE vec_id % 50 < 2 + (vec_id // 50) % 3),
qrels AS (
    SELECT query_idx, doc_idx, least(count(*), 2)::DOUBLE AS rel
    FROM query_tokens q JOIN doc_tokens d USING (label) WHERE q_pos = 0 GROUP BY ALL)"""
