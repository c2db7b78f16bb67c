"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a line of the text. Each is hashed to a wide vector, and a document's
fingerprint is the sum of the vectors of its paragraphs, modulo powers of two: equal
multisets of paragraphs have equal fingerprints in whatever order, and adding or
subtracting a paragraph's vector inserts or deletes it.

Two parts: ``EXACT`` lanes of 32 uniform bits, from whole paragraphs, decide equality.
``LIKE`` lanes of 32 bits sum +1 or -1 from runs of ``RUN`` words of each paragraph. The
square of a difference of two such sums estimates how many runs are not shared, so
likeness = 1 - |a - b|^2 / (|a|^2 + |b|^2), cut to 0..1, estimates the shared part without
the texts; its standard error is about sqrt(2 / LIKE).

Defined results: null text counts as empty; empty texts are equal to each other and have
likeness 1; rows with the same doc_id are ordered by text, null ids come last; a table
with one row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shards, small_batches, text_or_empty, tidy

EXACT, LIKE, RUN = 32, 256, 8
#: Documents in one range of ids, as long as there are ranges enough to go round.
RANGE = 5_000
PIECES = re.compile(r"(?:\S+\s*){1,%d}" % RUN)
LEAST = -(2**63)


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words64(seeds: np.ndarray, n: int) -> np.ndarray:
    """``n`` words of 64 pseudorandom bits for each seed."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(seeds[:, None] + step)


def _sums(vectors: np.ndarray, counts: list[int], kind) -> np.ndarray:
    """Sums of consecutive rows, ``counts`` of them at a time; 0 rows sum to 0."""
    out = np.zeros((len(counts), vectors.shape[1]), kind)
    have = [i for i, c in enumerate(counts) if c]
    if have:
        starts = np.concatenate([[0], np.cumsum([counts[i] for i in have])[:-1]])
        out[have] = np.add.reduceat(vectors, starts, axis=0, dtype=kind)
    return out


def vectors(texts: list[str], block: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """EXACT lanes (uint32) and LIKE lanes (int32) of each text."""
    exact = np.zeros((len(texts), EXACT), np.uint32)
    like = np.zeros((len(texts), LIKE), np.int32)
    whole, runs, n_whole, n_runs, first = [], [], [], [], 0

    def flush(last: int) -> None:
        with np.errstate(over="ignore"):
            lanes = _words64(np.array(whole, np.uint64), EXACT // 2).view(np.uint32)
            exact[first:last] = _sums(lanes, n_whole, np.uint32)
            bits = np.unpackbits(_words64(np.array(runs, np.uint64), LIKE // 64).view(np.uint8), axis=1)
            ones = _sums(bits, n_runs, np.int64)
            like[first:last] = (2 * ones - np.array(n_runs)[:, None]).astype(np.int32)

    for i, text in enumerate(texts):
        paragraphs = text.split("\n") if text else []
        whole += [xxhash.xxh3_64_intdigest(p.encode()) for p in paragraphs]
        own = [r for p in paragraphs for r in PIECES.findall(p)]
        runs += [xxhash.xxh3_64_intdigest(r.rstrip().encode(), 1) for r in own]
        n_whole.append(len(paragraphs))
        n_runs.append(len(own))
        if len(runs) + len(whole) >= block:
            flush(i + 1)
            whole, runs, n_whole, n_runs, first = [], [], [], [], i + 1
    if n_whole:
        flush(len(texts))
    return exact, like


def encoded(exact: np.ndarray, like: np.ndarray) -> list[str]:
    return [base64.b64encode(e.astype("<u4").tobytes() + k.astype("<i4").tobytes()).decode() for e, k in zip(exact, like, strict=True)]


def decoded(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    data = base64.b64decode(fingerprint)
    return np.frombuffer(data, "<u4", EXACT), np.frombuffer(data, "<i4", LIKE, 4 * EXACT)


def fingerprint(text: str | None) -> str:
    return encoded(*vectors([text or ""]))[0]


def insert(fingerprint: str, paragraphs: list[str], sign: int = 1) -> str:
    """The fingerprint after adding (or, with sign -1, deleting) whole paragraphs."""
    (e, k), (pe, pk) = decoded(fingerprint), vectors(["\n".join(paragraphs)] if paragraphs else [""])
    with np.errstate(over="ignore"):
        if sign > 0:
            return encoded((e + pe[0])[None], (k + pk[0])[None])[0]
        return encoded((e - pe[0])[None], (k - pk[0])[None])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated shared part of rows of LIKE lanes, 0 to 1."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    whole = (a * a).sum(axis=1) + (b * b).sum(axis=1)
    apart = ((a - b) ** 2).sum(axis=1)
    return np.clip(np.where(whole > 0, 1 - apart / np.where(whole > 0, whole, 1), (apart == 0) * 1.0), 0, 1)


def _firsts(docs: DataFrame, parts: int) -> list[int]:
    """The greatest doc_id of each of ``parts`` ranges, least first: one number a range."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            ids = np.asarray(batch.column(0))
            if len(ids):
                best = int(ids.max()) if best is None else max(best, int(ids.max()))
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best], pa.int64())], names=["first"])

    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(LEAST)).alias("k")).repartitionByRange(parts, "k")
    return sorted({r["first"] for r in ids.mapInArrow(tidy(top), "first long").collect()})


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt to shards of descending doc_id, each shard ending with its successor.

    The first document of a shard goes a second time, as ``carry``, to the shard before
    it (that of the first shard to the last), so every row finds the next one in its own
    task, and no task sees more than a range of the ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(shards(spark), -(-docs.count() // RANGE))
    firsts = np.array(_firsts(docs, parts), np.int64)
    n = len(firsts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.asarray(batch.column(0))
            place = np.searchsorted(firsts, key)
            shard = n - 1 - place
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.zeros(len(key), bool)), *batch.columns], names=names)
            if len(edge := np.flatnonzero(firsts[place] == key)):
                rest = batch.take(pa.array(edge))
                yield pa.RecordBatch.from_arrays([pa.array((shard[edge] - 1) % n), pa.array(np.ones(len(edge), bool)), *rest.columns], names=names)

    names = ["shard", "carry", "k", "doc_id", "text"]
    source = docs.select(F.coalesce(F.col("doc_id"), F.lit(LEAST)).alias("k"), "doc_id", text_or_empty().alias("text"))
    dealt = source.mapInArrow(tidy(deal), "shard long, carry boolean, k long, doc_id long, text string")
    return dealt.repartition(max(n, 1), "shard").sortWithinPartitions("shard", "carry", F.desc("k"), "text")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited text has its last half replaced by as much of the next document's start.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the row that still waits for its next one
        for batch in batches:
            shard, carry, _, doc_id, text = (c.to_pylist() for c in batch.columns)
            exact, like = vectors(text)
            rows = list(zip(shard, carry, doc_id, text, exact, like, strict=True))
            pairs = []
            for row in rows:
                if before is not None and before[0] == row[0] and not before[1]:
                    pairs.append((before, row))
                before = row
            if not pairs:
                continue
            half = [len(a[3]) // 2 for a, _ in pairs]
            edited = [a[3][: len(a[3]) - h] + b[3][:h] for (a, b), h in zip(pairs, half, strict=True)]
            e_exact, e_like = vectors(edited)
            own = np.array([a[5] for a, _ in pairs])
            cols = [
                [a[2] for a, _ in pairs],
                [len(a[3]) for a, _ in pairs],
                [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                encoded(np.array([a[4] for a, _ in pairs]), own),
                encoded(e_exact, e_like),
                likeness(own, e_like),
                likeness(own, np.array([b[5] for _, b in pairs])),
            ]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(tidy(run), kinds)
