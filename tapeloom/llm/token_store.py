"""Token ids in a directly addressable binary format, written and read through Spark.

Codes: an id is cut into 8-bit chunks. Level 0 holds the low chunk of every id and a
bitmap that says which ids go on; level 1 holds the next chunk of just those, and so
on. A rank directory (set bits before each 512-bit block) turns a position of one
level into a position of the next, so any token is read with one lookup per level and
no decoding of a block.

Files: a table of segments in Parquet, written by Spark's committer, so that a lost
executor or a repeated task leaves no half file and any store that Spark writes will
do. A segment holds whole documents, about ``SEGMENT`` ids, in ascending order; shards
are ranges of doc_id, dealt by the range exchange.

Defined results: null text counts as empty and has the end id alone; rows with the
same doc_id are all kept, ordered by text; null doc_ids come first; an empty table
writes no segment and gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, Workspace, scratch, small_batches, text_or_empty, tidy

SEGMENT = 1 << 18
BLOCK = 512
BLOCK_BYTES = BLOCK // 8


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned 32-bit ids."""
    levels, rest = [], np.ascontiguousarray(ids, dtype=np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % BLOCK_BYTES, np.uint8)])
        ranks = np.cumsum(np.bitwise_count(bits).reshape(-1, BLOCK_BYTES).sum(axis=1, dtype=np.uint32), dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), ranks])
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()))
        if not more.any():
            break
        rest = rest[more] >> 8
    head = struct.pack("<I", len(levels)) + b"".join(struct.pack("<I", n) for n, *_ in levels)
    return head + b"".join(c + b + r for _, c, b, r in levels)


class Codes:
    """Reads what :func:`pack` made: any token alone, or all of them."""

    def __init__(self, data: bytes):
        (depth,) = struct.unpack_from("<I", data)
        sizes, at = struct.unpack_from(f"<{depth}I", data, 4), 4 + 4 * depth
        self.levels = []
        for n in sizes:
            chunk = np.frombuffer(data, np.uint8, n, at)
            width = -(-n // BLOCK) * BLOCK_BYTES
            bits = np.frombuffer(data, np.uint8, width, at + n)
            ranks = np.frombuffer(data, "<u4", width // BLOCK_BYTES + 1, at + n + width)
            self.levels.append((chunk, bits, ranks))
            at += n + width + 4 * len(ranks)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Token ``i``: one byte, one bit and one rank for each level."""
        value = shift = 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                return value
            block = byte // BLOCK_BYTES
            before = int(np.bitwise_count(bits[block * BLOCK_BYTES : byte]).sum()) + (int(bits[byte]) & ((1 << bit) - 1)).bit_count()
            i, shift = int(ranks[block]) + before, shift + 8
        raise ValueError("damaged codes")

    def all(self) -> np.ndarray:
        out = np.zeros(0, np.uint32)
        for chunk, bits, _ in reversed(self.levels):
            here = chunk.astype(np.uint32)
            if len(out):
                here[np.unpackbits(bits, count=len(here), bitorder="little").view(bool)] |= out << 8
            out = here
        return out


#: Characters for which the word-wise path is the same as the library's, as the text is
#: in composed form already and the classes below hold all letters, digits and blanks.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa0-\xff]*")
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


class WordEncoder:
    """Ids of whole texts, as the tokenizers library gives them.

    Texts of plain Latin characters are cut into the pre-tokens that the tokenizer's
    own pattern makes, and the model is asked once for each distinct one; all other
    texts, and those that name a special token, go through the library as a whole.
    """

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = tuple(t.content for t in self.whole.get_added_tokens_decoder().values())
        # the printable stand-ins that byte-level models use for bytes
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.to_chars = {b: chr(c) for b, c in stand_in.items()}
        self.table = Memo(self._model, limit)
        self.wordwise = self._agrees()

    def _model(self, word: str) -> bytes:
        chars = word if word.isascii() else word.encode().decode("latin-1").translate(self.to_chars)
        return np.array([t.id for t in self.model.tokenize(chars)], "<u4").tobytes()

    def _agrees(self) -> bool:
        """Whether this tokenizer is one that the word-wise path is made for."""
        probe = "It's A  tête-à-tête, nº 12½:\tWe'll É 'Über' x×y!!\n''S don't-- ¿Qué?"
        return WORD.findall(probe.lower()) != [] and self._words(probe) == self._library(probe)

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.table.__getitem__, WORD.findall(text.lower())))

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.wordwise and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self._words(text)
        return self._library(text)


@cache
def encoder_of(path: str) -> WordEncoder:
    """One encoder, and so one table of words, in each Python worker for all its tasks."""
    return WordEncoder(path, limit=500_000)


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, text_col: str = "text") -> None:
    """Encode ``docs`` and write segments in ascending doc_id order under ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select("doc_id", text_or_empty(text_col).alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), encoder_of(tokenizer_path)
        first, seg, n, doc_ids, sizes, held = 0, 0, 0, [], [], []

        def segment() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(held), "<u4"))
            row = [[shard], [seg], [first], [n], [list(doc_ids)], [list(sizes)], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encoder.encode(text) + end
                doc_ids.append(doc_id)
                sizes.append(len(ids) // 4)
                held.append(ids)
                n += sizes[-1]
                if n >= SEGMENT:
                    yield segment()
                    first, seg, n, doc_ids, sizes, held = first + n, seg + 1, 0, [], [], []
        if held:
            yield segment()

    names = ["shard", "segment", "first", "n_ids", "doc_ids", "sizes", "codes"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    kinds = "shard int, segment int, first long, n_ids long, doc_ids array<long>, sizes array<int>, codes binary"
    ordered.mapInArrow(tidy(run), kinds).write.parquet(path)


SCHEMA = "shard int, segment int, first long, n_ids long, doc_ids array<long>, sizes array<int>, codes binary"


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    small_batches(spark)
    # one row per shard, and as many shards as the range exchange had partitions
    sums = sorted((r["shard"], r["n"]) for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    starts, at = [], 0
    for shard, n in sums:
        starts.append((shard, at))
        at += n
    base = spark.createDataFrame(starts, "shard int, base long")
    rows = segments.join(F.broadcast(base), "shard").select((F.col("base") + F.col("first")).alias("start"), "doc_ids", "sizes", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, sizes, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, sizes = Codes(codes).all().astype("<u4"), np.array(sizes, np.int64)
                ends = np.cumsum(sizes)
                own = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                made = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(start + ends - sizes, pa.int64()),
                    pa.array(sizes),
                    pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    made, names = [*made, pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(made, names=names)

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return rows.mapInArrow(tidy(run), kinds)


def store(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write ``docs`` to token files and return what reading them back gives.

    Without a ``path`` the files are only there in between.
    """
    with Workspace(docs.sparkSession) as work:
        files = path or work.own(scratch(docs.sparkSession, "tokens"))
        write(docs, tokenizer_path, files, end_id)
        return work.keep(read(docs.sparkSession, files))
