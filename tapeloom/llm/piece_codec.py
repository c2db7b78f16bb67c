"""Encoding and decoding with a SentencePiece model through a distinct-chunk table.

A piece of the model never holds a white-space marker after another character, and
never a line feed, so no merge crosses the end of a marked word or a line end. Text
can therefore be cut into chunks, each distinct chunk segmented once, and the ids
joined back by position; the result equals a whole-text call of the library.
The table lives in each Python worker, for all its tasks, and is bounded: at scale a
shuffled table of all distinct words of a corpus would move more bytes than the words it
saves. What is decoded are the ids of the whole document.

Defined results: null text counts as empty and has no ids; texts of any length are
cut the same way; chunks over 64 characters are segmented each time they occur;
repeated rows and rows with the same id are encoded each on its own; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memo, resident, small_batches, text_or_empty, tidy

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")


class ChunkTable:
    """Ids of whole texts, from a bounded table of distinct chunks."""

    def __init__(self, model_path: str, limit: int = 250_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.cuttable = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        self.feed = self.sp.encode("\n")
        self.cuttable &= len(self.feed) == 2 and self.sp.decode(self.feed) == "\n"
        self.table = Memo(self._segment, limit)

    def _segment(self, chunk: str) -> bytes:
        """The ids of one chunk as decimals, each with a comma behind it."""
        if chunk[0] == MARK and chunk != MARK:
            ids = self.sp.encode(chunk[1:].replace(MARK, " "))
        else:  # without a word or without a marker: as it stands behind a line feed
            ids = self.sp.encode("\n" + chunk.replace(MARK, " "))[len(self.feed) :]
        return b"".join(b"%d," % i for i in ids)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of ``text`` as comma-ended decimals, and what they decode to."""
        if not self.cuttable:
            ids = self.sp.encode(text)
            return b"".join(b"%d," % i for i in ids), self.sp.decode(ids)
        if not text:
            return b"", ""
        marked = MARK + text.replace(" ", MARK)
        chunks = CHUNK.findall(marked)
        coded = b"".join(map(self.table.__getitem__, chunks))
        return coded, self.sp.decode(list(map(int, coded[:-1].split(b","))))


def table_of(model_path: str) -> ChunkTable:
    """One table of chunks in each Python worker for all its tasks."""
    return resident(_name(model_path), lambda: ChunkTable(model_path))


def _name(model_path: str) -> str:
    return f"pieces {model_path}"


def encode(
    docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False
) -> DataFrame:
    """Ids and round trip of every text: ``keep``, n_tokens, ids_sha256, decoded_sha256.

    ``with_ids`` adds the ids themselves.
    """
    small_batches(docs.sparkSession)
    source = docs.select(*keep, text_or_empty(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model_path)
        for batch in batches:
            n, ids_sha, text_sha, ids = [], [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                coded, decoded = table.encode(text)
                n.append(coded.count(b","))
                ids_sha.append(hashlib.sha256(coded[:-1]).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids.append(np.fromstring(coded[:-1], np.int32, sep=",") if coded else [])
            made = [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                made.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *names])

    return source.mapInArrow(tidy(run, _name(model_path)), schema)
