"""Language-model scoring by cross-entropy difference.

A target model (of all rows known as good) and a background model (of all documents) share
one vocabulary and one smoothing, so they differ in their counts only. A document's score is
the mean over its tokens of target loss minus background loss, in bits: the lower, the more it
is like the target.

Every word of the corpus is in the vocabulary and every bigram is counted by itself, with
Dirichlet smoothing by the unigrams of the same model. A text ends with an end sign, which is
not scored: so a word is a context as often as it occurs. Texts are read once, in chunks. A
chunk sends each of its words and bigrams once, as a hashed key with its counts, to the
part that the key belongs to; a part adds up and answers with what the rest of the corpus adds
to the chunk's own counts. Parts grow in number with the corpus, not in size, and a common word
is one key a chunk wherever it occurs. Nothing but totals reaches the driver.

Defined results: a null text is empty; a text without words has no tokens and score, losses
and n_tokens of zero; without target rows both models are the background and all scores are
zero; null ids are scored like others and never are target; rows are scored one by one; an
empty table gives no rows. Words and bigrams are told apart by their keys, whose length grows
with the logarithm of the corpus: the share of keys that meet another one is under 2**-24
(up to 2**39 tokens).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._util import bounded_batches, cut, names, quoted, flag_by_ids, table
from .toxicity import words

#: Tokens of the corpus for each part that adds up counts.
PART_TOKENS = 1_000_000
#: Weight of the unigram model, in observations of the context.
PRIOR = 64.0
#: Words whose keys a task keeps, characters of a chunk, and bits of a key beyond the logarithm of the corpus' tokens.
HELD_WORDS = 300_000
CHUNK_CHARS = 8_000_000
SPARE_BITS = 24
#: Stands before the first word of a text.
BEGIN = np.uint64(0x243F6A8885A308D3)


def bits(grams: np.ndarray, contexts: np.ndarray, unigrams: np.ndarray, total: float) -> np.ndarray:
    """Loss of each token from its counts; ``total`` is that of the unigrams, smoothed."""
    return -np.log2((grams + PRIOR * (unigrams + 1.0) / total) / (contexts + PRIOR))


# -- chunks of texts -------------------------------------------------------------------


class WordKeys(dict):
    """Word -> key."""

    def __missing__(self, word: str) -> int:
        import xxhash

        key = self[word] = xxhash.xxh64_intdigest(word)
        return key


def packed(values: np.ndarray) -> bytes:
    """An array in small, plane by plane: most high bytes are zero."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, by their steps."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


CHUNK = "chunk string, tokens long, target long, texts long, target_texts long, rows binary, lengths binary, good binary, words binary, often binary, at binary"
BLOCK = "part int, chunk string, keys binary, n binary, good binary"
REPLY = "chunk string, part int, target binary, background binary"


def chunked(df: DataFrame, text_col: str = "text", good_col: str | None = None) -> DataFrame:
    """Rows of ``df`` in chunks (CHUNK): all columns but the text and ``good_col``, the lengths in tokens, word keys and which of them stands where. Map-only."""
    keep = [c for c in df.columns if c not in (text_col, good_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = WordKeys()
        for batch in batches:
            for rows, texts in bpe.slices(batch, text_col, CHUNK_CHARS):
                if len(keys) > HELD_WORDS:
                    keys = WordKeys()
                found = [words(t) for t in texts]
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                every = np.fromiter((keys[w] for f in found for w in f), np.uint64, int(lengths.sum()))
                known, at, often = np.unique(every, return_inverse=True, return_counts=True)
                rank = np.empty(len(known), np.uint32)
                rank[by_use(often)] = np.arange(len(known), dtype=np.uint32)
                good = np.array(rows.column(good_col).to_pylist(), bool) if good_col else np.zeros(len(found), bool)
                sink = pa.BufferOutputStream()
                own = rows.select(keep)
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_batch(own)
                yield pa.RecordBatch.from_pylist([{
                    "chunk": uuid.uuid4().hex, "tokens": len(every), "target": int(lengths[good].sum()), "texts": int((lengths > 0).sum()), "target_texts": int((lengths[good] > 0).sum()),
                    "rows": sink.getvalue().to_pybytes(), "lengths": packed(lengths), "good": packed(good), "words": packed_keys(known), "often": packed(often.astype(np.uint32)), "at": packed(rank[at]),
                }], schema=CHUNK_ARROW)

    return bounded_batches(df).mapInArrow(run, CHUNK)


CHUNK_ARROW = pa.schema([("chunk", pa.string()), *((n, pa.int64()) for n in ("tokens", "target", "texts", "target_texts")), *((n, pa.binary()) for n in ("rows", "lengths", "good", "words", "often", "at"))])
BLOCK_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.string()), *((n, pa.binary()) for n in ("keys", "n", "good"))])
REPLY_ARROW = pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("target", pa.binary()), ("background", pa.binary())])


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def by_use(often: np.ndarray) -> np.ndarray:
    """Words from common to rare: small numbers for most tokens."""
    return np.argsort(-often.astype(np.int64), kind="stable")


def keys_of(known: np.ndarray, at: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys of a chunk; where each token's word, context and bigram stand in them). The begin sign stands behind all."""
    word = known[at]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    before[starts] = BEGIN
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        words = mixed(known + np.uint64(0x9E3779B97F4A7C15)) >> shift
        grams, gram = np.unique(mixed(mixed(before) * np.uint64(0xD1342543DE82EF95) + word) >> shift, return_inverse=True)
    keys, place = np.unique(np.concatenate([words, grams]), return_inverse=True)
    of_word = place[: len(words)][at]
    context = np.empty_like(of_word)
    context[1:] = of_word[:-1]
    context[starts] = len(keys)
    return keys, of_word, context, place[len(words) :][gram]


def own_counts(size: int, places: tuple[np.ndarray, ...]) -> np.ndarray:
    """How often the chunk itself has each key."""
    return sum(np.bincount(place, minlength=size) for place in places).astype(np.uint32)


def chunk_arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpacked_keys(row["words"]), by_use(unpacked(row["often"], np.uint32))[unpacked(row["at"], np.uint32)], unpacked(row["lengths"], np.int64)


def edges_of(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each part begins in sorted keys."""
    part = ((keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(part, np.arange(parts + 1))


def blocks(chunks: DataFrame, parts: int, bits: int, counted: bool, asked: bool) -> DataFrame:
    """(BLOCK) the keys of each chunk by part, with their counts if ``counted``, and with the chunk to answer if ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                known, at, lengths = chunk_arrays(row)
                if not len(at):
                    continue
                keys, word, _, gram = keys_of(known, at, lengths, bits)
                n, good = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32)
                if counted:
                    is_good = np.repeat(unpacked(row["good"], np.bool_), lengths)
                    n, good = own_counts(len(keys), (word, gram)), own_counts(len(keys), (word[is_good], gram[is_good]))
                edges = edges_of(keys, parts, bits)
                used = np.flatnonzero(np.diff(edges))
                cutting = lambda x, pack: pa.array([pack(x[edges[p] : edges[p + 1]]) for p in used], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([row["chunk"] if asked else None] * len(used), pa.string()), cutting(keys, packed_keys), cutting(n, packed), cutting(good, packed)], schema=BLOCK_ARROW)

    return chunks.select("chunk", "lengths", "good", "words", "often", "at").mapInArrow(run, BLOCK)


def answer(found: pa.Table) -> pa.Table:
    """For each block of a part that a chunk asks for: what the rest of the corpus adds to its counts (REPLY)."""
    asked = [unpacked_keys(x) for x in found.column("keys").to_pylist()]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    more = []
    for name in ("good", "n"):
        own = np.concatenate([unpacked(x, np.uint32) for x in found.column(name).to_pylist()]).astype(np.int64)
        more.append(np.bincount(at, own, len(keys)).astype(np.int64)[at] - own)
    out, end = [], 0
    for chunk, part, own in zip(found.column("chunk").to_pylist(), found.column("part").to_pylist(), asked, strict=True):
        start, end = end, end + len(own)
        if chunk is not None:
            out.append({"chunk": chunk, "part": part, "target": packed(more[0][start:end]), "background": packed(more[1][start:end])})
    return pa.Table.from_pylist(out, schema=REPLY_ARROW)


# -- models ----------------------------------------------------------------------------


def distinct_words(chunks: DataFrame) -> dict[str, int]:
    """The vocabulary's size, empty without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("words"):
                yield pa.RecordBatch.from_arrays([pa.array(unpacked_keys(data.as_py()).view(np.int64))], names=["word"])

    n = chunks.select("words").mapInArrow(run, "word long").distinct().count()
    return {"words": n} if n else {}


def vocabulary(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """The number of distinct words of all documents, as "words"; empty without any."""
    return distinct_words(chunked(docs.select(quoted(text_col).alias(text_col)), text_col))


@dataclass
class Models:
    """The corpus in chunks, with the totals of both models."""

    docs: DataFrame
    text_col: str
    chunks: DataFrame
    vocabulary: dict[str, int]
    tokens: int
    target: int
    texts: int
    target_texts: int


def fit(docs: DataFrame, target: DataFrame, ids: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Models:
    """Both models of ``docs``. ``target``: ids, any number of them; ``ids``: the vocabulary, if it is known.

    Texts are not shuffled: the ids go to them as filters of bounded size.
    """
    (good,) = names(docs, "good")
    marked = flag_by_ids(docs, id_col, target.select(quoted(id_col)).filter(quoted(id_col).isNotNull()), good)
    chunks = cut(chunked(marked, text_col, good))
    totals = chunks.agg(*(F.coalesce(F.sum(n), F.lit(0)) for n in ("tokens", "target", "texts", "target_texts"))).first()
    return Models(docs, text_col, chunks, distinct_words(chunks) if ids is None else ids, *totals)


def score(df: DataFrame, ids: dict[str, int], models: Models, text_col: str = "text") -> DataFrame:
    """``df`` without the text, plus n_tokens, target_loss, background_loss and score (in place of any so called)."""
    keep = [c for c in df.columns if c not in (text_col, "n_tokens", "target_loss", "background_loss", "score")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("target_loss", "background_loss", "score"))])
    parts, key_bits = max(1, math.ceil(models.tokens / PART_TOKENS)), min(64, max(40, 1 + SPARE_BITS + models.tokens.bit_length()))
    itself = df is models.docs and text_col == models.text_col
    if itself:
        chunks, sent = models.chunks, blocks(models.chunks, parts, key_bits, True, True)
    else:
        chunks = cut(chunked(df, text_col))
        sent = blocks(models.chunks, parts, key_bits, True, False).union(blocks(chunks, parts, key_bits, False, True))
    more = ids.get("words", 0) + 2
    totals = float(models.target + more), float(models.tokens + more)
    flat, models_texts = not models.target, (models.target_texts, models.texts)  # no target: both are the background

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.to_pylist()
        known, at, lengths = chunk_arrays(row)
        own = pa.ipc.open_stream(row["rows"]).read_all()
        means = []
        if len(at):
            keys, word, context, gram = keys_of(known, at, lengths, key_bits)
            of = np.repeat(np.arange(len(lengths)), lengths)
            order = np.argsort(right.column("part").to_numpy())
            is_good = np.repeat(unpacked(row["good"], np.bool_), lengths)
            for name, mine, total, texts in (("target", is_good, totals[0], models_texts[0]), ("background", slice(None), totals[1], models_texts[1])):
                data = right.column(name).to_pylist()
                counts = np.concatenate([unpacked(data[i], np.int64) for i in order])
                if itself:
                    counts += own_counts(len(keys), (word[mine], gram[mine]))
                counts = np.append(counts, texts).astype(np.float64)
                means.append(np.bincount(of, bits(counts[gram], counts[context], counts[word], total), len(lengths)) / np.maximum(lengths, 1))
            if flat:
                means[0] = means[1]
        else:
            means = [np.zeros(len(lengths))] * 2
        return pa.Table.from_arrays([*(own.column(c) for c in keep), pa.array(lengths), pa.array(means[0]), pa.array(means[1]), pa.array(means[0] - means[1])], names=schema.names)

    replies = sent.groupBy("part").applyInArrow(answer, REPLY)
    return chunks.drop("tokens", "target", "texts", "target_texts").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def target_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    return labels.filter((F.col(label_col) == 1) & quoted(id_col).isNotNull()).select(quoted(id_col)).distinct()


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    models = fit(docs, target_ids(table(spark, sf_dir, "labels")))
    return score(docs, models.vocabulary, models)


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
SQL: dict[str, str] = {}
