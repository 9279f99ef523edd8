"""Best-fit packing of token sequences.

Bounded-space online best-fit: a packer keeps a fixed number of open bins in a bitset
keyed by free space. A piece goes to the open bin that it leaves with the least space;
if none has room, a new bin opens, and at the limit the fullest one closes first.

Texts are tokenised where they are read; only rows of a few numbers (and, on request, the
ids) are dealt out for packing, in partitions of even size whatever keys they hold. A packer
takes its pieces in a hashed order and in blocks, each from long to short: short pieces fill up
what long ones leave, and the open bins suffice for a partition of any size. (Sorting a whole
partition would open bins for long pieces only and close them before short ones come.)

Defined results: a null text is empty and gives the end id alone; a document over the
limit is cut into full pieces and a rest; repeated rows and null ids are packed row by row;
an empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from ._util import bounded_batches, table

#: Tokens of a sequence, and open bins of a packer.
SEQUENCE_TOKENS = 4096
OPEN_BINS = 4096
#: Pieces that are ordered at a time.
BLOCK_PIECES = 8192
END_ID = 1


class BestFit:
    """Online best-fit with at most ``open_bins`` open bins."""

    def __init__(self, size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS):
        self.size, self.limit = size, open_bins
        self.bits = 0  # bit f: a bin with f free is open
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it of a piece of 1 to ``size`` tokens."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.open -= 1
            free, at = self.size, self.made
            self.made += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return at, self.size - free

    def _take(self, free: int) -> int:
        at = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return at


@functools.lru_cache(maxsize=2)
def tokenizer_encoder(path: str) -> bpe.Encoder:
    """Ids by the tokenizers library's model, a distinct word at a time."""
    from tokenizers import Tokenizer

    words = bpe.loaded(path)
    tokenize = Tokenizer.from_file(bpe.vocabulary_file(path)).model.tokenize
    held = bpe.Recent(bpe.CACHE_WORDS)

    def encode_words(found: list[str]) -> list[bytes]:
        return [bpe.packed_ids([t.id for t in tokenize(words.byte_letters(w))]) for w in found]

    def encode(chunks: list[str]) -> list[bytes]:
        return words.chunks_by_words(chunks, lambda found: held(found, encode_words))

    return bpe.Encoder(encode)


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, its ids. Map-only."""
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema, end, step = T.StructType(fields), end_id.to_bytes(4, "little"), 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_encoder(vocabulary)
        for batch in batches:
            for rows in bpe.runs(batch, text_col):
                of, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, data in enumerate(encode(rows.column(text_col))):
                    data = data.as_py() + end
                    for k, at in enumerate(range(0, len(data), step)):
                        part = data[at : at + step]
                        of.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<i4"))
                columns = [rows.column(id_col).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=schema.names)

    return bounded_batches(df).select(id_col, text_col).mapInArrow(run, schema)


def pack(parts: DataFrame, length_col: str = "length", size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """``parts`` with sequence_id and offset. One exchange of narrow rows, even for any keys.

    Numbers of sequences hold the partition in their upper half. Rows in a partition are
    ordered in full, so a lost task makes the same bins again.
    """
    schema = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_PIECES):
                held.append(batch.slice(at, BLOCK_PIECES))
                if sum(x.num_rows for x in held) >= BLOCK_PIECES:
                    yield pa.Table.from_batches(held)
                    held = []
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(size, open_bins), TaskContext.get().partitionId() << 40
        for block in blocks(batches):
            block = block.take(pa.array(np.argsort(-block.column(length_col).to_numpy(), kind="stable")))
            placed = [bins.place(n) for n in block.column(length_col).to_pylist()]
            block = block.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
            yield from block.append_column("offset", pa.array([o for _, o in placed], pa.int64())).to_batches()

    narrow = [F.col(c) for c in parts.columns if c != "ids"]
    return parts.hint("rebalance").sortWithinPartitions(F.xxhash64(*narrow), *narrow).mapInArrow(run, schema)


def pack_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    return pack(pieces(df, vocabulary, id_col, text_col, size, end_id, with_ids), size=size, open_bins=open_bins)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), bpe.vocabulary_path(), with_ids=False)


QUERIES = {"op1_packing": op1_packing}
SQL: dict[str, str] = {}
