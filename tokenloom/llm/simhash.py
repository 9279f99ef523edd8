"""Near-duplicates by SimHash fingerprints and vantage-point trees.

Fingerprints are made where the texts are read. Equal ones collapse in an aggregate that
combines before the exchange, so a text with any number of copies is one point. The
distinct points are dealt out by the top of a vantage-point tree, fitted on a bounded
sample: a point belongs to one leaf shard and visits those later shards that the triangle
bound cannot rule out, so each pair within the radius meets in one shard at least. A shard
is searched by a vantage-point tree of its own and leaves a spanning forest of its links,
never more rows than points. Components of the forests come from alternating star
contractions, cut by checkpoints.

near_dedup() links 64-bit fingerprints of three-word shingles at two bits; similar() groups texts
alike at a Jaccard similarity of 0.8 by five-word shingles, through wider fingerprints and a tree
for each half word of them. Pairs that these leave in different groups are found by their rarest
shingles, of which alike sets share one.

A distinct point has at most 2080 others within two bits, so no group makes all its pairs.

Defined results: a null text is empty; a text without words has fingerprint zero, linked
like any other; of repeated ids each row is returned; null ids count as larger than any
other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import bounded_batches, cut, join_groups, may_hold, names, quoted, table, without_dropped

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
#: Points that a shard is meant to hold, and points of the sample that the top of the tree is fitted on.
SHARD_POINTS = 32_768
SAMPLE_POINTS = 65_536
#: Shingles that are summed at a time.
BLOCK = 65_536


def shingle_hashes(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in blocks. bytes.lower() and bytes.split() know ASCII only, as is wanted."""
    parts = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if not parts:
        return
    n = max(1, len(parts) - words + 1)
    for at in range(0, n, BLOCK):
        yield np.fromiter((digest(b" ".join(parts[i : i + words]), seed) for i in range(at, min(n, at + BLOCK))), np.uint64, min(n, at + BLOCK) - at)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 bits, each set if over half of the shingle hashes have it."""
    ones, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text or "", words, seed):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fp", words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``df`` with the text column replaced by its fingerprint as a signed long. Map-only."""
    keep = [c for c in df.columns if c != text_col]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out_col, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(text_col)], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(marks.view(np.int64))], names=schema.names)

    return bounded_batches(df).mapInArrow(run, schema)


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


# -- the top of the tree ---------------------------------------------------------------


def fit(sample: np.ndarray, leaves: int, radius: int = RADIUS) -> list:
    """A tree as nested [vantage, median, inside, outside]; a leaf is its number."""
    made = iter(range(1 << 30))

    def grow(points: np.ndarray, want: int) -> list | int:
        if want <= 1 or len(points) < 4:
            return next(made)
        # Of some candidates, the vantage point whose median leaves the fewest points in the band of both sides.
        best = None
        for v in points[:: max(1, len(points) // 16)][:16]:
            d = distance(points, v)
            m = int(np.median(d))
            inside = d <= m
            if inside.all() or not inside.any():
                continue
            band = int(((d > m - radius) & (d <= m + radius)).sum()) + abs(2 * int(inside.sum()) - len(points))
            if best is None or band < best[0]:
                best = band, v, m, inside
        if best is None:
            return next(made)
        _, v, m, inside = best
        return [int(v), m, grow(points[inside], want // 2), grow(points[~inside], want - want // 2)]

    return [grow(sample, leaves)]


def route(tree: list, points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the point, leaf, whether it belongs there) of each point's own leaf and of the later ones that it visits."""
    at, leaf, own = [], [], []

    def walk(node: list | int, idx: np.ndarray, home: np.ndarray) -> None:
        if not len(idx):
            return
        if isinstance(node, int):
            at.append(idx), leaf.append(np.full(len(idx), node, np.int32)), own.append(home)
            return
        v, m, inside, outside = node
        d = distance(points[idx], np.uint64(v))
        # Leaves are numbered from the inside on: a point at home outside needs no visit inside.
        near, far = home & (d <= m) | ~home & (d <= m + radius), home & (d > m) | ~home & (d > m - radius) | home & (d <= m) & (d > m - radius)
        walk(inside, idx[near], home[near])
        walk(outside, idx[far], (home & (d > m))[far])

    walk(tree[0], np.arange(len(points)), np.ones(len(points), bool))
    return np.concatenate(at or [np.zeros(0, int)]), np.concatenate(leaf or [np.zeros(0, np.int32)]), np.concatenate(own or [np.zeros(0, bool)])


# -- in a shard ------------------------------------------------------------------------


def close_leaves(members: np.ndarray, queries: np.ndarray, radius: int = RADIUS, leaf: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members, queries) by index for each leaf of a vantage-point tree over the members and the queries that may reach it."""
    stack = [(np.arange(len(members)), np.arange(len(queries)))]
    while stack:
        m_idx, q_idx = stack.pop()
        if not len(m_idx) or not len(q_idx):
            continue
        if len(m_idx) > leaf:
            vantage = members[m_idx[len(m_idx) // 2]]
            d = distance(members[m_idx], vantage)
            cutoff = int(np.median(d))
            inside = d <= cutoff
            if inside.all():
                cutoff = int(d.max()) - 1
                inside = d <= cutoff
            if inside.any() and not inside.all():
                dq = distance(queries[q_idx], vantage)
                stack += [(m_idx[inside], q_idx[dq <= cutoff + radius]), (m_idx[~inside], q_idx[dq > cutoff - radius])]
                continue
        yield m_idx, q_idx


def close_pairs(members: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, member) within the radius, in blocks."""
    for m_idx, q_idx in close_leaves(members, queries, radius):
        step = max(1, 4_000_000 // len(m_idx))
        for at in range(0, len(q_idx), step):
            part = q_idx[at : at + step]
            q, m = np.nonzero(np.bitwise_count(queries[part][:, None] ^ members[m_idx][None, :]) <= radius)
            yield part[q], m_idx[m]


class Forest:
    """Union-find over numbered points; the smallest of a set is its root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, idx: np.ndarray) -> np.ndarray:
        r = self.up[idx]
        while True:
            further = self.up[r]
            if np.array_equal(further, r):
                return r
            r = further

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        up = self.up
        while True:
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            lo, hi = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(up, hi, lo)


def shard_forest(members: np.ndarray, visitors: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, smaller point) that connect whatever is linked in a shard."""
    points = np.concatenate([members, visitors])
    forest = Forest(len(points))
    for q, m in close_pairs(members, points, radius):
        far = q != m
        forest.link(q[far], m[far])
    root = forest.roots(np.arange(len(points)))
    moved = root != np.arange(len(points))
    return points[moved], points[root[moved]]


def links(points: DataFrame, radius: int = RADIUS, shard_points: int | None = None, sample_points: int = SAMPLE_POINTS) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that connect all within the radius."""
    spark, n = points.sparkSession, points.count()
    leaves = max(1, min(sample_points // 16, math.ceil(n / (shard_points or SHARD_POINTS))))
    sample = np.zeros(0, np.uint64)
    if leaves > 1:  # a bounded sample; it shapes the tree and decides nothing else
        rows = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(sample_points, 512 * leaves)).toPandas()
        sample = rows["fp"].to_numpy(np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(fit(sample, leaves, radius))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame["fp"].to_numpy(np.int64).view(np.uint64)
            at, leaf, own = route(tree.value, x, radius)
            yield pd.DataFrame({"leaf": leaf, "own": own, "fp": x[at].view(np.int64)})

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        x, own = frame["fp"].to_numpy(np.int64).view(np.uint64), frame["own"].to_numpy(bool)
        u, v = shard_forest(x[own], x[~own], radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return points.select("fp").mapInPandas(deal, "leaf int, own boolean, fp long").groupBy("leaf").applyInPandas(search, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); the root is the smallest node. Alternating star contractions."""

    def down(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = cut(down(edges))
    before = state(edges)
    while before[0]:
        # Large star: larger neighbours go to the smallest one.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: smaller neighbours, and the node itself, go to the smallest one.
        large = down(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = cut(down(small))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row: the id, fp (signed long), component_id, the smallest id that links lead to, and root, the group's own number."""
    marked = cut(fingerprints(df.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")), words=words))
    return grouped(marked, "fp", lambda points: links(points, radius)).withColumnRenamed("id", id_col)


def grouped(marked: DataFrame, mark: str, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``marked`` (id, mark, ..) with component_id and root, by the links (u, v) between distinct marks."""
    points = cut(marked.groupBy(mark).agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    roots = components(link(points))
    of = cut(points.join(roots, points[mark] == roots.node, "left").select(mark, "least", "copies", F.coalesce("root", mark).alias("root")))
    first = cut(of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("marks")))
    groups = cut(join_groups(of.drop("least"), first, "root", "marks").drop("marks"))
    return join_groups(marked, groups, mark, "copies").drop("copies")


# -- by similarity ---------------------------------------------------------------------
#
# Two bits of 64 leave out most texts that are alike at 0.8. For a similarity, a text gets a wide
# fingerprint of several words, whose distance tells the angle of two shingle sets well, and each
# half word of it is a sketch with a vantage-point tree of its own: texts meet where one of their
# sketches is within two bits, and are linked if the wide fingerprints agree.

WIDE_WORDS = 8
WIDE_SHINGLE = 5
SIMILARITY = 0.8
WIDE_SHARD_POINTS = 262_144
SKETCH_RADIUS = 2


#: Standard deviations under which a distance is sure to be of texts alike, and over which it is not.
SURE, DOUBT = 3.0, 2.5


def widest(similarity: float, deviations: float, words: int = WIDE_WORDS) -> int:
    """Differing bits of wide fingerprints at a Jaccard similarity, and so many standard deviations more.

    The cosine of sets of a size is 2J / (1 + J).
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(64 * words * share + deviations * math.sqrt(64 * words * share * (1 - share)))


def shingle_set(text: str | None, words: int = WIDE_SHINGLE) -> np.ndarray:
    """A text's different shingles by their hashes, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text or "", words)]))


def wide_fingerprint(h: np.ndarray, count: int = WIDE_WORDS) -> np.ndarray:
    """``count`` words of fingerprint over a set of shingle hashes, each from the same hash mixed anew."""
    if not len(h):
        return np.zeros(count, np.uint64)
    ones = np.zeros(64 * count, np.int64)
    steps = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096, None] + steps[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.astype(">u8").view(np.uint8)).reshape(len(x), -1).sum(0, dtype=np.int32)
    return np.frombuffer(np.packbits(2 * ones > len(h)).tobytes(), ">u8").astype(np.uint64)


#: Shingles that repeats are counted in at a time, and frequent shingles at most. Both shape the order of shingles and decide nothing else.
COUNTED = 2_097_152
COMMON = 262_144


def common_shingles(df: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that several of all texts have, the most frequent ones.

    A task counts in blocks and gives what is repeated in one, so little is shuffled: of b blocks, a shingle of more than
    about the square root of 2b texts is met twice in one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def repeated() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

        for batch in batches:
            for text in batch.column(text_col):
                held.append(shingle_set(text.as_py()))
                size += len(held[-1])
                if size >= COUNTED:
                    yield repeated()
                    held, size = [], 0
        yield repeated()

    counts = cut(bounded_batches(df.select(text_col)).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    # As Arrow tables: rows of Python objects would take the driver some hundred MB.
    levels = counts.groupBy("n").count().orderBy(F.desc("n")).toArrow()
    fits = levels.column("n").to_numpy()[np.cumsum(levels.column("count").to_numpy()) <= COMMON]
    rows = counts.filter(F.col("n") >= (int(fits.min()) if len(fits) else 1 << 62)).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], rows.column("n").to_numpy()[order]


def rarest(h: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first shingles of a set in one order of all, rare ones first: so many that sets alike at the similarity share one.

    Alike sets share at least similarity * len(h), so one of any len(h) - ceil(similarity * len(h)) + 1.
    """
    known, counts = common
    weight = np.zeros(len(h), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        weight = np.where(known[at] == h, counts[at], 0)
    return h[np.lexsort((h, weight))][: max(0, len(h) - math.ceil(similarity * len(h) - 1e-9) + 1) if len(h) else 0]


def sketches(df: DataFrame, similarity: float, text_col: str = "text") -> DataFrame:
    """``df`` with the text replaced by ``wide`` (array of signed longs), ``of`` (its shingle set's hash), ``size`` and ``rare`` (see rarest()). Map-only."""
    keep = [c for c in df.columns if c != text_col]
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("wide", longs), T.StructField("of", T.LongType()), T.StructField("size", T.LongType()), T.StructField("rare", longs)])
    common = df.sparkSession.sparkContext.broadcast(common_shingles(df, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide, of, size, rare = [], [], [], [np.zeros(0, np.uint64)]
            for text in batch.column(text_col):
                h = shingle_set(text.as_py())
                wide.append(wide_fingerprint(h))
                of.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                size.append(len(h))
                rare.append(rarest(h, common.value, similarity))
            flat = pa.array(np.array(wide, np.uint64).ravel().view(np.int64))
            wides = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, WIDE_WORDS, dtype=np.int32)), flat)
            rares = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in rare]).astype(np.int32)), pa.array(np.concatenate(rare).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), wides, pa.array(np.array(of, np.uint64).view(np.int64)), pa.array(size, pa.int64()), rares], names=schema.names)

    return bounded_batches(df).mapInArrow(run, schema)


#: Pairs that are looked at together: a few MB of each array.
PAIRS = 131_072


def differing(wide: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Differing bits of the wide fingerprints (one row a word) of two lists of points."""
    out = np.zeros(len(u), np.int16)
    for word in wide:
        out += np.bitwise_count(word[u] ^ word[v])
    return out


def linked(forest: Forest, wide: np.ndarray, marks: np.ndarray, q: np.ndarray, m: np.ndarray, sure: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Link what is surely alike among all of q with all of m, without looking at pairs that are together already;
    give the pairs in doubt and their bits.

    A large group of near copies is soon one set: then only what is not in it is compared.
    """
    parts = [(q, m)]
    if len(q) * len(m) > PAIRS:
        for side in (q, m):
            pivot = np.full(len(side), m[0])
            near = (distance(marks[side], marks[pivot]) <= SKETCH_RADIUS) & (differing(wide, side, pivot) <= sure)
            forest.link(side[near], pivot[near])
        root = forest.roots(m[:1])[0]
        q_in, m_in = forest.roots(q) == root, forest.roots(m) == root
        parts = [(q[~q_in], m), (q[q_in], m[~m_in])]
    for a, b in parts:
        step = max(1, PAIRS // max(1, len(b)))
        for at in range(0, len(a) if len(b) else 0, step):
            x = a[at : at + step]
            for left in range(0, len(b), PAIRS):
                y = b[left : left + PAIRS]
                i, j = np.nonzero(np.bitwise_count(marks[x][:, None] ^ marks[y][None, :]) <= SKETCH_RADIUS)
                u, v = x[i], y[j]
                apart = forest.roots(u) != forest.roots(v)
                u, v = u[apart], v[apart]
                bits = differing(wide, u, v)
                forest.link(u[bits <= sure], v[bits <= sure])
                doubt = (bits > sure) & (bits <= most)
                if doubt.any():
                    yield u[doubt], v[doubt], bits[doubt]


def closest(forest: Forest, u: np.ndarray, v: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs between sets of ``forest``, a minimum spanning forest by bits: each set takes its closest pair, over and over."""
    order = np.argsort(bits, kind="stable")
    u, v, bits = u[order], v[order], bits[order]
    sets, left, kept = Forest(0), np.arange(len(u)), []
    sets.up = forest.up.copy()
    while True:
        a, b = sets.roots(u[left]), sets.roots(v[left])
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            break
        best = np.full(len(sets.up), len(u))
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        chosen = np.unique(best[best < len(u)])
        kept.append(chosen)
        sets.link(u[chosen], v[chosen])
    at = np.concatenate(kept) if kept else np.zeros(0, int)
    return u[at], v[at], bits[at]


def wide_links(points: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v, sure) between numbered points (mark, wide) whose sketches meet and whose wide fingerprints agree.

    Each shard leaves a spanning forest of what is surely alike, and of what is in doubt the closest pairs
    that would join its sets: never more rows than points.
    """
    spark, n = points.sparkSession, points.count()
    leaves = max(1, min(SAMPLE_POINTS // 16, math.ceil(n / WIDE_SHARD_POINTS)))
    sure, most, tables = widest(similarity, -SURE), widest(similarity, DOUBT), 2 * WIDE_WORDS

    def sketch(wide: np.ndarray, table: int) -> np.ndarray:
        word = wide[:, table // 2]
        return word >> np.uint64(32) if table % 2 else word & np.uint64(0xFFFFFFFF)

    sample = np.zeros((0, WIDE_WORDS), np.uint64)
    if leaves > 1:
        rows = points.select("wide").orderBy(F.xxhash64("wide")).limit(min(SAMPLE_POINTS, 512 * leaves)).toPandas()
        sample = np.array(rows["wide"].tolist(), np.int64).view(np.uint64).reshape(-1, WIDE_WORDS)
    trees = spark.sparkContext.broadcast([fit(sketch(sample, t), leaves, SKETCH_RADIUS) for t in range(tables)])
    names = ["part", "own", "mark", *(f"w{i}" for i in range(WIDE_WORDS))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark = batch.column("mark").to_numpy()
            wide = batch.column("wide").flatten().to_numpy().view(np.uint64).reshape(-1, WIDE_WORDS)
            for t in range(tables):
                at, leaf, own = route(trees.value[t], sketch(wide, t), SKETCH_RADIUS)
                yield pa.RecordBatch.from_arrays([pa.array((leaf * tables + t).astype(np.int32)), pa.array(own), pa.array(mark[at]), *(pa.array(wide[at, i].view(np.int64)) for i in range(WIDE_WORDS))], names=names)

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("own", ascending=False, kind="stable")
        wide = np.stack([frame[f"w{i}"].to_numpy(np.int64).view(np.uint64) for i in range(WIDE_WORDS)])
        mark, own = frame["mark"].to_numpy(np.int64), int(frame["own"].sum())
        marks = sketch(wide.T, int(frame["part"].iloc[0]) % tables)
        forest = Forest(len(mark))
        found, size = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int16))], 0
        for m, q in close_leaves(marks[:own], marks, SKETCH_RADIUS):
            for pairs in linked(forest, wide, marks, q, m, sure, most):
                found.append(pairs)
                size += len(pairs[0])
                if size > 8 * PAIRS:  # what is not of the spanning forest so far is not of the last one
                    found, size = [closest(forest, *map(np.concatenate, zip(*found, strict=True)))], 0
        u, v, _ = closest(forest, *map(np.concatenate, zip(*found, strict=True)))
        root = forest.roots(np.arange(len(mark)))
        moved = root != np.arange(len(mark))
        out = pd.DataFrame({"u": np.r_[mark[moved], mark[u]], "v": np.r_[mark[root[moved]], mark[v]]})
        return out.assign(sure=np.arange(len(out)) < moved.sum())

    dealt = points.select("mark", "wide").mapInArrow(deal, ", ".join(["part int", "own boolean", "mark long", *(f"w{i} long" for i in range(WIDE_WORDS))]))
    return dealt.groupBy("part").applyInPandas(search, "u long, v long, sure boolean")


def shingle_sets(df: DataFrame, text_col: str = "text", out_col: str = "shingles") -> DataFrame:
    """``df`` with the text replaced by the hashes of its different shingles (array of signed longs). Map-only."""
    keep = [c for c in df.columns if c != text_col]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out_col, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                sets = [shingle_set(t.as_py()).view(np.int64) for t in rows.column(text_col)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=schema.names)

    return bounded_batches(df).mapInArrow(run, schema)


#: Ways that the pairs of a point are dealt to if it is in over a 4096th of all of them.
HUB_WAYS = 64


def beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (u, v, ..) with of_u and of_v, what ``sets`` (mark, shingles; one row a mark) has of both. Both are materialised."""
    most = max(1, pairs.count() // 4096)
    hubs = {side: F.broadcast(cut(pairs.groupBy(side).count().filter(F.col("count") > most).select(F.col(side).alias("hub")))) for side in ("u", "v")}  # fewer than 4096 rows each
    for side, other in (("u", "v"), ("v", "u")):
        way = F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64(other), F.lit(HUB_WAYS))).otherwise(0)
        dealt = pairs.join(hubs[side], F.col(side) == F.col("hub"), "left").withColumn("way", way).drop("hub")
        ways = F.when(F.col("hub").isNotNull(), F.sequence(F.lit(0).cast("long"), F.lit(HUB_WAYS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
        held = sets.join(hubs[side], F.col("mark") == F.col("hub"), "left").select(F.col("mark").alias(side), F.explode(ways).alias("way"), F.col("shingles").alias(f"of_{side}"))
        pairs = dealt.withColumn("way", F.col("way").cast("long")).join(held, [side, "way"]).drop("way")
    return pairs


def alike(pairs: DataFrame, keyed: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (u, v, ..; materialised marks) whose texts' shingle sets have a Jaccard similarity of ``similarity`` or more.

    Only texts that are in doubt are shuffled, one for each mark, as hashes of their shingles.
    """
    marks = pairs.select(F.col("u").alias("mark")).union(pairs.select(F.col("v").alias("mark"))).distinct()
    text_of = cut(marked.join(marks, "mark", "left_semi").groupBy("mark").agg(F.min("text_key").alias("text_key")))
    texts = may_hold(keyed.select("text_key", "text"), F.xxhash64("text_key"), cut(text_of.select(F.xxhash64("text_key").alias("h"))), "_maybe").filter("_maybe").drop("_maybe")
    sets = shingle_sets(texts).groupBy("text_key").agg(F.first("shingles").alias("shingles"))
    sets = cut(text_of.join(sets, "text_key").select("mark", "shingles"))
    pairs = beside(pairs, sets)
    both = F.size(F.array_intersect("of_u", "of_v"))
    # The set of a text without words is empty; two of those have one fingerprint, so no pair is of two.
    return pairs.filter(both >= F.lit(similarity) * (F.size("of_u") + F.size("of_v") - both) - 1e-9).drop("of_u", "of_v")


#: Rows of a shingle that meet at a time.
MEET = 1024


def left_apart(rare: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v, root_u, root_v) of shingle sets in different groups that may be alike: all that are, and few others.

    ``rare``: mark, of, size, rare of each text (materialised); ``roots``: node, root of the marks that have one.
    Alike sets share one of their rarest shingles, and at the first that they share, what is left of both is enough: sets meet
    only there. With what is not among their rarest, so are those that they share. Of a shingle only sets outside its largest
    group are compared with all.
    """
    shared = cut(rare.select(F.explode("rare").alias("sig")).groupBy("sig").count().filter("count > 1").select("sig"))  # by copies too
    rows = rare.select("mark", "of", "size", F.posexplode("rare").alias("at", "sig"))
    rows = may_hold(rows, F.col("sig"), shared, "_maybe").filter("_maybe").drop("_maybe").distinct()
    rows = cut(rows.join(roots, F.col("mark") == F.col("node"), "left").select("sig", "of", "size", "at", F.coalesce("root", "mark").alias("root")))
    sizes = rows.groupBy("sig", "root").agg(F.count("*").alias("n"))
    several = sizes.groupBy("sig").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.max_by("root", F.struct("n", "root")).alias("largest")).filter("groups > 1").drop("groups")
    rows = cut(join_groups(rows, cut(several), "sig", "n").filter("n IS NOT NULL"))
    ways = F.ceil(F.col("n") / MEET)
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("of", "size", "at", "root")]
    every = F.explode(F.sequence(F.lit(0).cast("long"), ways - 1)).alias("way")
    apart = rows.filter("root <> largest").select("sig", every, *side("u"))
    all_rows = rows.select("sig", F.pmod(F.xxhash64("of"), ways).alias("way"), (F.col("root") == F.col("largest")).alias("in_largest"), *side("v"))
    need = F.lit(similarity / (1 + similarity)) * (F.col("size_u") + F.col("size_v")) - 1e-6
    enough = F.least(F.col("size_u") - F.col("at_u"), F.col("size_v") - F.col("at_v")) >= need
    met = apart.join(all_rows, ["sig", "way"]).filter((F.col("root_u") != F.col("root_v")) & (F.col("of_u") != F.col("of_v")) & (F.col("in_largest") | (F.col("of_u") < F.col("of_v"))) & enough)
    # Of the shared shingles one set has all that it keeps in its rarest among those of both, or the other has.
    rest = F.ceil(F.lit(similarity) * F.greatest("size_u", "size_v") - 1e-9) - 1
    # A pair may meet by one shingle as (u, v) and by another as (v, u).
    swap = F.col("of_u") > F.col("of_v")
    pairs = cut(met.select(*(F.when(swap, F.col(b)).otherwise(F.col(a)).alias(c) for a, b, c in (("of_u", "of_v", "u"), ("of_v", "of_u", "v"), ("root_u", "root_v", "root_u"), ("root_v", "root_u", "root_v"))), F.ceil(need - rest).alias("least")).distinct())
    marks = cut(pairs.select(F.col("u").alias("of")).union(pairs.select(F.col("v").alias("of"))).distinct())
    kept = may_hold(rare.select("of", "rare"), F.col("of"), marks, "_maybe").filter("_maybe").groupBy(F.col("of").alias("mark")).agg(F.first("rare").alias("shingles"))
    return beside(pairs, cut(kept)).filter(F.size(F.array_intersect("of_u", "of_v")) >= F.col("least")).select("u", "v", "root_u", "root_v")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: the id, text_key, component_id and root of groups alike at ``similarity`` or more (Jaccard, five words).

    Fingerprints find the groups; pairs of different groups that they leave out are found by rare shingles and settled by the sets.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    keyed = df.select(quoted(id_col).alias("id"), F.md5(text).alias("text_key"), text.alias("text"))
    sketched = cut(sketches(keyed, similarity).withColumn("mark", F.xxhash64("wide")))
    marked = cut(sketched.select("id", "text_key", "mark", "of"))
    wides = sketched.select("mark", "wide")

    def link(points: DataFrame) -> DataFrame:
        found = cut(wide_links(cut(wides.groupBy("mark").agg(F.first("wide").alias("wide"))), similarity).distinct())
        doubt = cut(found.filter("NOT sure").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        near = components(found.filter("sure").select("u", "v").union(alike(doubt, keyed, marked.select("mark", "text_key"), similarity)))
        pairs = cut(left_apart(sketched.select("mark", "of", "size", "rare"), near, similarity))
        rest = alike(pairs, keyed, marked.select(F.col("of").alias("mark"), "text_key"), similarity)
        return near.select(F.col("node").alias("u"), F.col("root").alias("v")).union(rest.select("root_u", "root_v"))

    return grouped(marked.select("id", "text_key", "mark"), "mark", link).select(F.col("id").alias(id_col), "text_key", "component_id", "root")


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = SIMILARITY) -> DataFrame:
    """``df`` with one row of each group of near-duplicates, that of the smallest id. Only texts of groups of several are shuffled.

    Groups are texts alike at ``similarity``, or, without one, those of near_dedup().
    """
    if similarity is None:
        both = df.select(quoted(id_col).alias("id"), F.md5(F.coalesce(quoted(text_col), F.lit(""))).alias("text_key"), quoted(text_col).alias("text"))
        marked = cut(grouped(cut(fingerprints(both)), "fp", links).select("id", "text_key", "component_id", "root"))
    else:
        marked = cut(similar(df, id_col, text_col, similarity).withColumnRenamed(id_col, "id"))
    several = cut(marked.groupBy("root").count().filter("count > 1"))
    together = cut(join_groups(marked, several, "root", "count").filter("count IS NOT NULL").withColumn("row", F.monotonically_increasing_id()))
    # The first row of a group by id, then by text and place.
    first = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("text_key").alias("c"), F.col("row").alias("d"))
    firsts = cut(together.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("n")))
    decided = join_groups(together.select("id", "text_key", "root", first.alias("own")), firsts, "root", "n")
    decided = cut(decided.select("id", F.col("text_key").alias("mark"), (F.col("own") == F.col("first")).alias("kept")))
    return without_dropped(df, id_col, F.md5(F.coalesce(quoted(text_col), F.lit(""))), decided)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
SQL: dict[str, str] = {}
