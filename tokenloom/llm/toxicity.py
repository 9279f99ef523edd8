"""Toxicity by class-conditional Kneser-Ney models.

A toxic and an ordinary model are fitted on labelled rows. Both count in how many documents of
their class a word occurs (its continuation counts, with documents as contexts), discount each
count, and hand what that frees to one shared backoff: the same counts over both classes. The
discount of a count is a constant, and what the shared counts let expect of the class, and SIGMAS
standard deviations of that: a word keeps a likelihood of its own in a class only as far as the
backoff does not explain it, and all others are as likely in both models but for the weights of
their backoffs. A text's score compares its log-likelihoods under the two models over all of its
words, divided by their number; a rising curve, logistic in the root of that difference and fitted
on the same rows with each row's own counts left out, turns it into a probability.

What is learnt is bounded: at most SAMPLE_ROWS labelled documents of each class (the first by a
hash of the id), with all their words. The curve weights a document by how many labelled ones of
its class it stands for, so the share of toxic texts that it learns is that of all labels.
Scoring reads every whole text where it is.

Defined results: null and empty texts are scored like one of unknown words; without labelled rows
of both classes every score is the share of toxic labels among them (0 if none); labels that
are null, and labels of unknown documents, teach nothing; several labels of one document
count as the largest; an id of several rows teaches nothing; null ids are in no held-out part; rows are scored one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._util import bounded_batches, cut, names, quoted, table

SAMPLE_ROWS = 10_000
#: A count's discount: a constant, and so many standard deviations over what the shared counts let expect.
DISCOUNT = 0.75
SIGMAS = 3.0
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


class KneserNey:
    """The two models. ``toxic`` and ``ordinary`` are sums of counts, ``words`` the number of different ones."""

    def __init__(self, toxic: float, ordinary: float, words: int, discount: float = DISCOUNT, sigmas: float = SIGMAS):
        self.toxic, self.ordinary, self.words, self.discount, self.sigmas = toxic, ordinary, words, discount, sigmas
        self.freed = (1.0, 1.0)

    def kept(self, count, both, total: float, greatest=np.maximum, root=np.sqrt):
        """What a class keeps of a word's count; on columns too, with their functions."""
        expected = both * (total / (self.toxic + self.ordinary))
        return greatest(count - expected - self.sigmas * root(expected) - self.discount, 0.0)

    def difference(self, toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
        """Log-likelihood under the toxic model less that under the ordinary one."""
        both = toxic + ordinary
        shared = (both + 1.0) / (self.toxic + self.ordinary + self.words + 1.0)
        p = self.kept(toxic, both, self.toxic) / self.toxic + self.freed[0] * shared
        q = self.kept(ordinary, both, self.ordinary) / self.ordinary + self.freed[1] * shared
        return np.log(p) - np.log(q)

    @property
    def unknown(self) -> float:
        """The difference of a word that neither model knows more of than the backoff."""
        return math.log(self.freed[0]) - math.log(self.freed[1])


def feature(found: list[str], difference: dict[str, float], unknown: float) -> float:
    """Length-normalised difference of a text's log-likelihoods, from that of unknown words; its root, with the sign."""
    get = difference.get
    x = math.fsum(d - unknown for w in found if (d := get(w)) is not None) / max(1, len(found))
    return math.copysign(math.sqrt(abs(x)), x)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method. ``rows``: how many rows each one stands for."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    rows = np.ones(len(y)) if rows is None else rows
    share = float(np.average(y, weights=rows))
    w[-1] = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
    penalty = ridge * rows.sum() * np.diag([1e-4] * (x.shape[1] - 1) + [0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((rows * np.logaddexp(0, np.where(y > 0, -z, z))).sum() + w @ penalty @ w / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (rows * (p - y)) + penalty @ w
        step = np.linalg.lstsq((x * (rows * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), slope, rcond=None)[0]
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic) of a bounded sample and the number of labelled documents of each class; its ids, at most twice sample_rows, are broadcast."""
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(quoted(id_col)) & quoted(id_col).isNotNull()).groupBy(quoted(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    single = docs.groupBy(quoted(id_col).alias("_id")).agg(F.count("*").alias("rows")).filter("rows = 1")
    known = cut(known.join(single, "_id", "left_semi"))
    labelled = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = lambda c: known.filter(F.col("toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    return docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("text")).join(F.broadcast(part(0).union(part(1))), "_id").select("text", "toxic"), labelled


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, discount: float = DISCOUNT, sigmas: float = SIGMAS) -> tuple[dict[str, float], float, list[float]]:
    """(difference of each word that has its own, that of all others, slope and constant of the curve)."""
    sample, labelled = labelled_sample(bounded_batches(docs), labels, id_col, text_col, label_col, sample_rows)
    sample = cut(sample)
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("toxic", T.IntegerType()), T.StructField("ordinary", T.IntegerType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in bpe.slices(batch, "text", 500_000):
                out: list[str] = []
                y: list[int] = []
                for text, toxic in zip(texts, rows.column("toxic").to_pylist(), strict=True):
                    found = set(words(text))
                    out += found
                    y += [int(toxic == 1)] * len(found)
                toxic = np.array(y, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic), pa.array(1 - toxic)], names=schema.names)

    counts = cut(sample.mapInArrow(count, schema).groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")))
    totals = counts.agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.count("*").alias("words")).first()
    if not totals["toxic"] or not totals["ordinary"]:
        share = labelled.get(1, 0) / max(1, labelled.get(0, 0) + labelled.get(1, 0))
        return {}, 0.0, [0.0, math.inf if share == 1 else -math.inf if not share else math.log(share / (1 - share))]
    model = KneserNey(totals["toxic"], totals["ordinary"], totals["words"], discount, sigmas)
    both = F.col("toxic") + F.col("ordinary")
    kept = lambda c, both: model.kept(F.col(c), both, totals[c], lambda x, low: F.greatest(x, F.lit(low)), F.sqrt)
    # A word may be one of a class's own for want of the scored row alone, so words that are nearly so are taken too.
    told = counts.filter(sum(kept(c, b) for c in ("toxic", "ordinary") for b in (both, both - 1)) > 0).orderBy("word").toPandas()
    t, o = (told[n].to_numpy(np.float64) for n in ("toxic", "ordinary"))
    own = lambda n, total: 1.0 - math.fsum(model.kept(n, t + o, total)) / total
    model.freed = own(t, model.toxic), own(o, model.ordinary)
    table_of = lambda x: {w: float(v) for w, v in zip(told["word"], x, strict=True)}
    difference = table_of(model.difference(t, o))
    # A labelled row is scored by what the others tell.
    others = table_of(model.difference(np.maximum(t - 1, 0), o)), table_of(model.difference(t, np.maximum(o - 1, 0)))
    send, unknown = docs.sparkSession.sparkContext.broadcast(others), model.unknown

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_toxic, without_ordinary = send.value
        for batch in batches:
            for rows, texts in bpe.slices(batch, "text"):
                toxic = rows.column("toxic").to_pylist()
                x = [feature(words(a), without_toxic if b == 1 else without_ordinary, unknown) for a, b in zip(texts, toxic, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array([int(v == 1) for v in toxic], pa.int32())], names=["x", "y"])

    rows = sample.mapInArrow(score, "x double, y int").toPandas().sort_values(["x", "y"])
    y = rows["y"].to_numpy(np.float64)
    stands_for = np.where(y > 0, labelled.get(1, 0) / max(1, y.sum()), labelled.get(0, 0) / max(1, len(y) - y.sum()))
    x = rows[["x"]].to_numpy()
    curve = logistic(x, y, rows=stands_for)
    if curve[0] < 0:  # the rows tell nothing: the curve must not fall
        curve = np.array([0.0, logistic(x[:, :0], y, rows=stands_for)[0]])
    return {w: d for w, d in difference.items() if abs(d - unknown) > 1e-12}, unknown, curve.tolist()


def score(df: DataFrame, model: tuple[dict[str, float], float, list[float]], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with a score from 0 to 1 in a column more. Map-only; the model is of bounded size."""
    (out_col,) = names(df, score_col)
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.DoubleType())])
    send = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        difference, unknown, (a, b) = send.value
        for batch in batches:
            for rows, texts in bpe.slices(batch, text_col):
                out = []
                for text in texts:
                    z = a * feature(words(text), difference, unknown) + b
                    out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.float64())], names=schema.names)

    return bounded_batches(df).mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
SQL: dict[str, str] = {}
