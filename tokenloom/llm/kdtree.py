"""Exact top-k inner-product search with a KD-tree per shard.

A shard is a run of an index's rows in the order of the top of a KD-tree: median splits on the widest
component of a bounded sample deal the table out, so shards have tight boxes of their own. Each shard
is a KD-tree (median splits, tight bounding boxes, nodes kept). Queries search their home shard first.
The k-th score found there goes with the query; the boxes of all shards are a small table, and
a query is dealt only to shards whose box can reach its k-th score. In a shard a batch of
queries walks the tree best child first and leaves a node whose bound is under a query's k-th score.

A task holds one shard of bounded size and one batch of queries. Results of a query are at
most k rows from each shard that it visits.

Defined results: vectors that are null or empty or hold null or non-finite components take
no part; vectors are compared with those of the same length only; ties go to the smaller id;
every row is a candidate, repeats of a row each by itself; a query's own id is left out, and
queries under one id share the results of the first of them in order of their components; fewer
candidates than k give fewer rows; rows with a null id take no part. Components over 2**63 / 256
count as that; scores are exact while they fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import bounded_batches, cut, quoted, table

SHARD_ROWS = 32_768
LEAF_ROWS = 256
#: Queries of a batch that are searched together.
BATCH_QUERIES = 512
#: Points of the sample that shapes the shards, and queries' bounds that are worked out at a time.
SAMPLE_POINTS = 65_536


def quantised(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * component) as longs; null where the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * factor).cast("long"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, whole)


class KdTree:
    """A KD-tree over integer vectors: nodes with tight boxes, children of inner ones, rows of leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")  # so ties inside a leaf are by id
        ids, vectors = ids[order], vectors[order]
        self.ids = ids
        # Products of floats are exact up to 2**53 and much faster than those of integers.
        most = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.exact = 2.0**53 / max(1.0, most * vectors.shape[1])
        self.whole = vectors
        self.vectors = vectors.astype(np.float64)
        self.rows: list[np.ndarray | None] = []
        self.children: list[tuple[int, int]] = []
        low, high = [], []

        def grow(idx: np.ndarray) -> int:
            at, part = len(self.rows), self.vectors[idx]
            low.append(part.min(0)), high.append(part.max(0))
            self.rows.append(None), self.children.append((-1, -1))
            spread = high[at] - low[at]
            if len(idx) <= leaf or not spread.any():
                self.rows[at] = np.sort(idx)
            else:
                by = np.argsort(part[:, int(np.argmax(spread))], kind="stable")
                self.children[at] = grow(idx[by[: len(by) // 2]]), grow(idx[by[len(by) // 2 :]])
            return at

        if len(ids):
            grow(np.arange(len(ids)))
        self.low, self.high = np.array(low).reshape(len(low), -1), np.array(high).reshape(len(high), -1)

    def bounds(self, node: int, queries: np.ndarray, small: bool) -> np.ndarray:
        """The best score that a node's box can give: each component at its better end."""
        return box_bounds(queries, self.low[node : node + 1], self.high[node : node + 1], small)[:, 0]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, id, score) arrays that hold each query's best k over its kth score (ties with it too)."""
        if not len(self.ids):
            return
        floats = queries.astype(np.float64)
        small = float(np.abs(floats).max(initial=0)) <= self.exact
        n, kth = len(queries), kth.astype(np.float64).copy()
        low = -np.inf if small else np.iinfo(np.int64).min
        best_score = np.full((n, k), low) if small else np.full((n, k), low, np.int64)
        best_id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        have = np.zeros(n, np.int64)

        def take(rows: np.ndarray, q: np.ndarray) -> None:
            scores = floats[q] @ self.vectors[rows].T if small else queries[q] @ self.whole[rows].T
            ids = np.broadcast_to(self.ids[rows], scores.shape)
            own = ids == query_ids[q][:, None]
            all_scores = np.concatenate([best_score[q], np.where(own, low, scores)], axis=1)
            all_ids = np.concatenate([best_id[q], np.where(own, np.iinfo(np.int64).max, ids)], axis=1)
            # Only what reaches the k-th largest can stay; sort that by score, then id.
            if all_scores.shape[1] > 4 * k:
                cut_at = np.partition(all_scores, all_scores.shape[1] - k, axis=1)[:, all_scores.shape[1] - k]
                keep = int((all_scores >= cut_at[:, None]).sum(1).max())
                if keep < all_scores.shape[1]:
                    top = np.argpartition(all_scores, all_scores.shape[1] - keep, axis=1)[:, all_scores.shape[1] - keep :]
                    all_scores, all_ids = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
            # From large to small; ~x turns integers around without overflow.
            at = np.lexsort((all_ids, -all_scores if small else ~all_scores), axis=1)[:, :k]
            best_score[q], best_id[q] = np.take_along_axis(all_scores, at, 1), np.take_along_axis(all_ids, at, 1)
            have[q] = np.minimum(k, have[q] + len(rows) - own.sum(1))
            full = q[have[q] >= k]
            kth[full] = np.maximum(kth[full], best_score[full, k - 1])

        def walk(node: int, q: np.ndarray, bound: np.ndarray) -> None:
            alive = bound >= kth[q]
            q = q[alive]
            if not len(q):
                return
            if self.rows[node] is not None:
                take(self.rows[node], q)
                return
            left, right = self.children[node]
            to_left, to_right = self.bounds(left, floats[q], small), self.bounds(right, floats[q], small)
            first = to_left >= to_right
            # Each query's better child first; what it finds there may spare it the other.
            walk(left, q[first], to_left[first])
            walk(right, q, to_right)
            walk(left, q[~first], to_left[~first])

        walk(0, np.arange(n), self.bounds(0, floats, small))
        q, r = np.nonzero(np.arange(k)[None, :] < have[:, None])
        yield query_ids[q], best_id[q, r], best_score[q, r].astype(np.int64)


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray, small: bool) -> np.ndarray:
    """(queries, boxes). Float sums of large values may be a little low, so they get a margin."""
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return bound if small else bound + np.abs(bound) * 1e-9 + 1


def fit_shards(sample: np.ndarray, shards: int) -> list | int:
    """The top of the tree as nested [component, border, below, from there on]; a leaf is the number of a shard."""
    made = iter(range(1 << 30))

    def grow(points: np.ndarray, want: int) -> list | int:
        spread = points.max(0) - points.min(0) if len(points) > 1 else np.zeros(1)
        if want <= 1 or not spread.any():
            return next(made)
        dim = int(np.argmax(spread))
        border = float(np.partition(points[:, dim], len(points) // 2)[len(points) // 2])
        below = points[:, dim] < border
        if not below.any():
            border = float(points[:, dim][points[:, dim] > border].min())
            below = points[:, dim] < border
        return [dim, border, grow(points[below], want // 2), grow(points[~below], want - want // 2)]

    return grow(sample, shards)


def shard_of(tree: list | int, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int32)

    def walk(node: list | int, idx: np.ndarray) -> None:
        if isinstance(node, int):
            out[idx] = node
        elif len(idx):
            below = points[idx, node[0]] < node[1]
            walk(node[2], idx[below]), walk(node[3], idx[~below])

    walk(tree, np.arange(len(points)))
    return out


def _search(k: int):
    """Over rows (shard, dim, is_query, id, vector, kth) sorted so: a shard's vectors, then its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, tree = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, dim = batch.column("shard").to_numpy(), batch.column("dim").to_numpy()
            asks = batch.column("is_query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (asks[1:] != asks[:-1])])
            for a, b in zip(edges, np.r_[edges[1:], len(shard)], strict=True):
                key = int(shard[a]), int(dim[a])
                if key != now:
                    now, ids, vectors, tree = key, [], [], None
                part = batch.slice(a, b - a)
                of = part.column("id").to_numpy()
                block = part.column("vector").flatten().to_numpy().reshape(b - a, key[1])
                if not asks[a]:
                    ids.append(of), vectors.append(block)
                    continue
                if not ids:
                    continue
                if tree is None:
                    tree = KdTree(np.concatenate(ids), np.concatenate(vectors))
                    vectors = []
                kth = part.column("kth").to_pandas().fillna(-np.inf).to_numpy(np.float64)
                for i in range(0, b - a, BATCH_QUERIES):
                    for q, v, s in tree.search(of[i : i + BATCH_QUERIES], block[i : i + BATCH_QUERIES], kth[i : i + BATCH_QUERIES], k):
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], schema=schema)

    return run


def top_k(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row that ``queries`` holds for."""
    found = "query_id long, vec_id long, score long"
    spark = df.sparkSession
    clean = df.select(quoted(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), quantised(quoted(vector_col)).alias("vector")).filter("vector IS NOT NULL AND id IS NOT NULL").withColumn("dim", F.size("vector"))
    # By length: how many shards, from a bounded sample in an order of hashes.
    sizes = {r.dim: r.n for r in clean.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    trees: dict[int, list | int] = {}
    for dim, n in sizes.items():
        shards, trees[dim] = math.ceil(n / shard_rows), 0
        if shards > 1:
            some = clean.filter(F.col("dim") == dim).select("vector").orderBy(F.xxhash64("id", "vector")).limit(min(SAMPLE_POINTS, 256 * shards)).toPandas()
            trees[dim] = fit_shards(np.array(some["vector"].tolist(), np.float64).reshape(-1, dim), shards)
    send = spark.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                points = part.column("vector").flatten().to_numpy().reshape(-1, dim)
                yield part.append_column("shard", pa.array(shard_of(send.value[int(dim)], points)))

    dealt = cut(bounded_batches(clean).mapInArrow(deal, T.StructType([*clean.schema.fields, T.StructField("shard", T.IntegerType())])))
    # Median splits cannot part equal vectors: a shard that came out too large is cut by a hash of the ids.
    many = dealt.groupBy("dim", "shard").agg(F.ceil(F.count("*") / shard_rows).alias("ways"))
    way = F.pmod(F.xxhash64("id"), F.col("ways"))
    dealt = dealt.join(F.broadcast(many), ["dim", "shard"]).withColumn("shard", F.col("shard").cast("long") * 2**32 + way).drop("ways")
    several = not many.filter("shard > 0 OR ways > 1").isEmpty()
    held = dealt.select("shard", "dim", F.lit(False).alias("is_query"), "id", "vector", F.lit(None).cast("double").alias("kth"))
    # Of queries under one id, the first.
    asked = dealt.filter("asks").groupBy("id").agg(F.min(F.struct("dim", "vector", "shard")).alias("q")).select("id", "q.dim", "q.vector", "q.shard")

    def search(asking: DataFrame) -> DataFrame:
        return held.unionByName(asking).repartition("shard", "dim").sortWithinPartitions("shard", "dim", "is_query", "id").mapInArrow(_search(k), found)

    at_home = cut(search(asked.select("shard", "dim", F.lit(True).alias("is_query"), "id", "vector", F.lit(None).cast("double").alias("kth"))))
    everything = at_home
    if several:
        at = dealt.select("dim", "shard", F.posexplode("vector").alias("i", "x")).groupBy("dim", "shard", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
        boxes = at.groupBy("dim", "shard").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("box")).collect()
        of = {dim: [b for b in boxes if b.dim == dim] for dim in trees}
        bounds = spark.sparkContext.broadcast({dim: (np.array([b.shard for b in some], np.int64), *(np.array([[getattr(c, side) for c in b.box] for b in some], np.float64) for side in ("low", "high"))) for dim, some in of.items()})

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims):
                    part = batch.filter(pa.array(dims == dim))
                    points = part.column("vector").flatten().to_numpy().reshape(-1, dim).astype(np.float64)
                    shards, low, high = bounds.value[int(dim)]
                    kth = part.column("kth").to_numpy(zero_copy_only=False)
                    for at in range(0, len(points), BATCH_QUERIES):
                        can = ~(box_bounds(points[at : at + BATCH_QUERIES], low, high, False) < kth[at : at + BATCH_QUERIES, None])
                        can &= shards[None, :] != part.column("shard").to_numpy()[at : at + BATCH_QUERIES, None]
                        q, s = np.nonzero(can)
                        rows = part.slice(at, BATCH_QUERIES).take(pa.array(q))
                        yield pa.RecordBatch.from_arrays([pa.array(shards[s]), rows.column("dim"), pa.array(np.ones(len(q), bool)), rows.column("id"), rows.column("vector"), rows.column("kth")], names=["shard", "dim", "is_query", "id", "vector", "kth"])

        kth = at_home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("kth"))
        asking = asked.join(kth, asked.id == kth.query_id, "left").select("shard", "dim", "id", "vector", "kth")
        everything = at_home.unionByName(search(asking.mapInArrow(reach, held.schema)))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return everything.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op6_topk": op6_topk}
SQL = {
    "op6_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """
}
