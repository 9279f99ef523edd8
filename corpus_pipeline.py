"""A corpus pipeline: each stage gets the documents that its predecessor kept, whole.

toxicity drops what it predicts as toxic; exact dedup keeps the first of equal texts; near
dedup keeps one document of each group of near-duplicates; pii rewrites texts without
personal data (n_chars follows); packing places what is left into sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm import bpe, exact_dedup, packing, pii, simhash, toxicity
from tokenloom.llm._util import names, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (score,) = names(docs, "score")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col=score).filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, bpe.vocabulary_path(), with_ids=False)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("pii", clean), ("packing", pack)]

#: The toxicity stage learns by iteration and the packing depends on the order of rows: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder, read again, and deleted once the next is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:  # the input of the stage just written is needed no more
                before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
                before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
