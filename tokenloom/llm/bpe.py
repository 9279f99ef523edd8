"""BPE encoding and decoding by prefix-sharing trie traversal.

Words are encoded through the *last-token state* of their prefixes: the encoding of a
prefix ends in one token only, the one that the encoding of what stands before it
accepts as a neighbour. Distinct words are sorted, which is a depth-first walk of their
trie; the states of a shared prefix stay on a stack and are computed once. No merge loop
runs over a word.

Defined results: a null text counts as empty; an empty text (or one of white space)
encodes to no ids and decodes to an empty string; repeated rows and null ids pass
through row by row; very long words cost time in proportion to their length.
"""

from __future__ import annotations

import array
import functools
import json
import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._util import bounded_batches, names, table

LITTLE = sys.byteorder == "little" and array.array("I").itemsize == 4

END = "</w>"
#: Ids of a run of texts that are written out together.
JOINED_IDS = 262_144
#: Chunks and words that an encoder keeps at most; none is of more than CACHE_BYTES, so an entry takes five times that at most.
CACHE_CHUNKS = 400_000
CACHE_WORDS = 400_000
CACHE_BYTES = 64
#: Pairs of neighbours whose acceptance is remembered at most.
CACHE_PAIRS = 200_000


class Recent:
    """Ids by text, of what was met of late, in two Arrow arrays of at most ``most`` entries."""

    def __init__(self, most: int):
        self.most, self.turn = most, 0
        self.keys, self.ids, self.used = pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, np.int32)

    def __call__(self, wanted: pa.StringArray, encode: Callable[[list[str]], list[bytes]]) -> pa.BinaryArray:
        """Ids, in bytes, of distinct texts; those that are not known are encoded together. Long texts are not kept."""
        self.turn += 1
        known = pc.index_in(wanted, value_set=self.keys)
        missing = known.is_null()
        fresh, missed = wanted.filter(missing), missing.to_numpy(zero_copy_only=False)
        at = np.where(missed, len(self.keys) + np.cumsum(missed) - 1, known.fill_null(0).to_numpy())
        keys = pa.concat_arrays([self.keys, fresh])
        ids = pa.concat_arrays([self.ids, pa.array(encode(fresh.to_pylist()), pa.binary())])
        used = np.r_[self.used, np.zeros(len(fresh), np.int32)]
        used[at] = self.turn
        found = ids.take(pa.array(at))
        keep = pc.less_equal(pc.binary_length(keys), CACHE_BYTES).to_numpy(zero_copy_only=False)
        if keep.sum() > self.most:
            # What was used last stays, half as many.
            last = np.where(keep, used, -1)
            late = np.argpartition(last, len(last) - self.most // 2)[len(last) - self.most // 2 :]
            keep = np.zeros(len(last), bool)
            keep[late] = True
        if not keep.all():
            keys, ids, used = keys.filter(pa.array(keep)), ids.filter(pa.array(keep)), used[keep]
        self.keys, self.ids, self.used = keys, ids, used
        return found


def packed_ids(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()


class WordBpe:
    """A byte-level BPE with word ends, read from a ``tokenizers`` JSON file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(END) or t == END}
        self.final = {t[: -len(END)]: i for t, i in vocab.items() if t.endswith(END) and t != END}
        self.longest = max(map(len, self.inner))
        self.longest_final = max(map(len, self.final))
        # A merge's product by its pair, and the pair by the product; order is the rank of the merge that makes a token.
        self.product: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[a + b]
            self.product[vocab[a], vocab[b]] = made
            self.parts.setdefault(made, (vocab[a], vocab[b]))
            self.order.setdefault(made, rank)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Fixed value: how the vocabulary splits text into words, here for printable ASCII and Latin-1 letters in lower case.
        self.words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
        self.plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
        # A line of plain letters, perhaps with marks after them; another line gives two empty strings.
        self.simple = re.compile(r"^(?:([a-zß-öø-ÿ]+)([.,;:!?%&$#*|]*)|.*)$", re.MULTILINE)
        # Other text is normalised and split by the library, whose tables of letters and compositions count.
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(file)
        self.normalise, self.presplit = tool.normalizer.normalize_str, tool.pre_tokenizer.pre_tokenize_str
        # A Latin-1 letter stands for several byte letters.
        self.plain_letters = re.compile("[ -~ß-öø-ÿ]+")
        self.letters = {ord(c): self.presplit(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.held = Recent(CACHE_WORDS)

    # -- text to words ---------------------------------------------------------------

    def split(self, chunk: str) -> list[str | int]:
        """The words of a chunk without white space, plain or in byte letters; special tokens as ids."""
        out: list[str | int] = []
        for part in self.specials.split(chunk) if self.specials and "<" in chunk else (chunk,):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if self.plain.fullmatch(part):
                    out += self.words.findall(part.lower())
                else:
                    out += [w for w, _ in self.presplit(self.normalise(part))]
        return out

    # -- words to ids ----------------------------------------------------------------

    def accepts(self, left: int, right: int) -> bool:
        """Whether merging the letters of both tokens in rank order gives these two tokens.

        The merges inside both are undone from the latest on; the pair fails if a merge
        across the border would have come before one that has been undone.
        """
        known = self.neighbours.get((left, right))
        if known is not None:
            return known
        key, order, parts, product = (left, right), self.order, self.parts, self.product
        undone, on_left, good = sys.maxsize, False, True
        while True:
            made = product.get((left, right))
            if made is not None:
                rank = order[made]
                # At equal rank the leftmost pair goes first.
                if rank < undone or rank == undone and not on_left:
                    good = False
                    break
            ranks = order.get(left, -1), order.get(right, -1)
            if ranks == (-1, -1):
                break
            if ranks[0] > ranks[1]:
                undone, on_left, left = ranks[0], True, parts[left][1]
            else:
                undone, on_left, right = ranks[1], False, parts[right][0]
        if len(self.neighbours) >= CACHE_PAIRS:
            self.neighbours.clear()
        self.neighbours[key] = good
        return good

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words. Sorted, they come as a depth-first walk of their trie."""
        inner, final, accepts, known = self.inner.get, self.final.get, self.accepts, self.neighbours.get
        longest, longest_final = self.longest, self.longest_final
        out: dict[str, list[int]] = {}
        state: list[int] = [-1]  # the last token of the prefix of each length
        start: list[int] = [0]  # and where it begins
        before = ""
        for word in sorted(set(words)):
            n = len(word)
            same, most = 0, min(len(state) - 1, n - 1, len(before))
            while same < most and before[same] == word[same]:
                same += 1
            del state[same + 1 :], start[same + 1 :]
            for i in range(same + 1, n):
                for j in range(i - longest if i > longest else 0, i):
                    token = inner(word[j:i])
                    if token is not None:
                        if not j:
                            break
                        good = known((state[j], token))
                        if good or good is None and accepts(state[j], token):
                            break
                else:
                    raise ValueError(f"no token ends {word[:i]!r}")
                state.append(token)
                start.append(j)
            for j in range(n - longest_final if n > longest_final else 0, n):
                token = final(word[j:])
                if token is not None and (not j or accepts(state[j], token)):
                    break
            else:
                raise ValueError(f"no token ends {word!r}")
            ids = [token]
            while j:
                ids.append(state[j])
                j = start[j]
            ids.reverse()
            out[word] = ids
            before = word
        return out

    def chunks_by_words(self, chunks: list[str], ids_of: Callable[[pa.StringArray], pa.BinaryArray]) -> list[bytes]:
        """Ids of chunks in bytes, from those of their distinct words. Most chunks are a word of plain letters, perhaps with marks."""
        if not chunks:
            return []
        found = self.simple.findall("\n".join(chunks).lower())
        split = {c: self.split(c) for c, (word, _) in zip(chunks, found, strict=True) if not word}
        wanted = {word for word, _ in found}
        wanted.update([marks for _, marks in found if marks], *([w for w in words if isinstance(w, str)] for words in split.values()))
        wanted.discard("")
        distinct = list(wanted)
        of = dict(zip(distinct, ids_of(pa.array(distinct, pa.string())).to_pylist(), strict=True))
        whole = {c: b"".join([of[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in words]) for c, words in split.items()}
        return [(of[word] + of[marks] if marks else of[word]) if word else whole[c] for c, (word, marks) in zip(chunks, found, strict=True)]

    def byte_letters(self, word: str) -> str:
        """A plain word in byte letters. (No word in byte letters is one of plain letters beyond ASCII.)"""
        return word if word.isascii() or not self.plain_letters.fullmatch(word) else word.translate(self.letters)

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian 32-bit integers. Words of late are kept; all others share one trie."""
        return self.chunks_by_words(chunks, lambda words: self.held(words, self.encode_new))

    def encode_new(self, words: list[str]) -> list[bytes]:
        spelt = [self.byte_letters(w) for w in words]
        ids = self.encode_words(spelt)
        return [packed_ids(ids[w]) for w in spelt]

    def decode(self, ids: Iterable[int]) -> str:
        """As a vocabulary without a decoder decodes: the tokens, special ones too, with a space between."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])

    @functools.cached_property
    def written(self) -> dict[str, pa.Array]:
        """By id: the tokens, and the ids in decimal."""
        size = max(self.tokens) + 1
        return {"tokens": pa.array([self.tokens.get(i) for i in range(size)], pa.binary()), "decimals": pa.array([str(i) for i in range(size)], pa.binary())}

    def joined(self, ids: pa.ListArray, what: str) -> Iterator[pa.Array]:
        """Each list's tokens (decoded text) or decimal ids with a space between, as bytes, in runs of lists of a bounded size together."""
        of, ends, at = self.written[what], ids.offsets.to_numpy(), 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + JOINED_IDS)) - 1)
            words = of.take(ids.values.slice(ends[at], min(ends[to] - ends[at], JOINED_IDS)))
            if words.null_count:
                raise KeyError("an id that the vocabulary has not")
            out = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.minimum(ends[at : to + 1] - ends[at], len(words)).astype(np.int32)), words), b" ")
            for more in range(ends[at] + len(words), ends[to], JOINED_IDS):  # of one long list
                words = of.take(ids.values.slice(more, min(ends[to] - more, JOINED_IDS)))
                out = pc.binary_join_element_wise(out, pa.array([b" ".join(words.to_pylist())]), b" ")
            yield out
            at = to


# White space is what Unicode calls so; str.split() takes four control characters more.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("(?:(?![\x1c-\x1f])\\s)+")


def chunks_of(text: str) -> list[str]:
    if _ODD.search(text):
        return [c for c in _SPACE.split(text) if c]
    return text.split()


def split_texts(texts: pa.StringArray) -> pa.ListArray:
    """The chunks of each text between white space; empty ones may be among them."""
    texts = texts.fill_null("")
    if pc.any(pc.match_substring_regex(texts, "[\\x1c-\\x1f]")).as_py():
        return pa.array([chunks_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.utf8_split_whitespace(texts)


class Encoder:
    """Texts to ids by their distinct chunks; those of late are kept in a bounded number of bytes."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = CACHE_CHUNKS):
        self.encode, self.held = encode, Recent(most)

    def __call__(self, texts: pa.StringArray) -> pa.BinaryArray:
        """Each text's ids in bytes. All new chunks of the batch go into one trie."""
        split = split_texts(texts)
        chunks = split.flatten().dictionary_encode()
        ids = self.held(chunks.dictionary, self.encode).take(chunks.indices)
        return pc.binary_join(pa.ListArray.from_arrays(split.offsets, ids), b"")


def vocabulary_file(path: str) -> str:
    """A vocabulary's place on this machine: as given, or as shipped with addFile."""
    import os

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """One vocabulary for each Python worker."""
    return WordBpe(vocabulary_file(path))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(loaded(path).encode_chunks)


def runs(batch: pa.RecordBatch, column: str, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of bounded text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most_chars:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)
    # What Arrow holds for later would stay with the worker.
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: str, most_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A batch in runs, with their texts."""
    for rows in runs(batch, column, most_chars):
        yield rows, rows.column(column).to_pylist()


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the text column replaced by its token ids (array of int). Map-only."""
    keep = [c for c in df.columns if c != text_col]
    (ids_col,) = names(df.select(*[f"`{c}`" for c in keep]), ids_col)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = encoder(vocabulary)
        for batch in batches:
            for rows in runs(batch, text_col):
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), listed(encoded(rows.column(text_col)))], names=[*keep, ids_col])

    return bounded_batches(df).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the ids column replaced by its decoded text. Map-only; null ids give an empty text."""
    keep = [c for c in df.columns if c != ids_col]
    (text_col,) = names(df.select(*[f"`{c}`" for c in keep]), text_col)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = loaded(vocabulary).joined
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = batch.slice(i, 256)
                texts = pa.concat_arrays([pa.array([], pa.string()), *(x.cast(pa.string()) for x in joined(pc.fill_null(rows.column(ids_col), pa.scalar([], rows.column(ids_col).type)), "tokens"))])
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), texts], names=[*keep, text_col])

    return bounded_batches(df).mapInArrow(run, schema)


def listed(ids: pa.BinaryArray) -> pa.ListArray:
    """Ids in bytes as lists of integers."""
    _, offsets, data = ids.buffers()
    ends = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1]
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]) // 4, [None, data]) if data is not None and ends[-1] else pa.array([], pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends // 4), flat)


def digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass; the ids and texts leave as digests only."""
    import hashlib

    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoded = loaded(vocabulary), encoder(vocabulary)
        sha = lambda columns: [hashlib.sha256(x.as_buffer()).hexdigest() for column in columns for x in column]
        for batch in batches:
            for rows in runs(batch, text_col):
                ids = listed(encoded(rows.column(text_col)))
                yield pa.RecordBatch.from_arrays([rows.column(id_col), pc.list_value_length(ids).cast(pa.int64()), pa.array(sha(bpe.joined(ids, "decimals")), pa.string()), pa.array(sha(bpe.joined(ids, "tokens")), pa.string())], names=schema.names)

    return bounded_batches(df).select(id_col, text_col).mapInArrow(run, schema)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op8_bpe": op8_bpe}
SQL: dict[str, str] = {}
