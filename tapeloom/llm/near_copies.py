"""Near copies of documents: consistent weighted sampling, bands, weighted Jaccard.

Shingles are runs of five words (runs of letters and digits, A-Z lower-cased); a text of
fewer words is one shingle. A shingle weighs its count in the text times its IDF.

IDF: 1/2 + 1/2 log(N / df) / log(N / rare), where ``rare`` is ``RARE`` of all N documents, or
``FEW`` if that is more; so a shingle in at most that many documents weighs 1, more frequent
ones less, down to 1/2 for one that every document has. The half that does not fall bounds
what a large group of near copies can hide of itself, as its shared shingles become frequent
and the few changed ones rare: pairs of 8/9 by plain counts stay at 0.8 or more in any group.
Document frequencies are exact and over all documents: a shingle that common overall is half
that common in some block of documents, so blocks name candidates, and a second pass, if
there are any, counts just those; both lists are bounded whatever the corpus, by the length
of a document over ``RARE``.

Signatures: improved consistent weighted sampling (Ioffe 2010), each shingle sampled
once, in a bin chosen by its hash; empty bins borrow from the next full one. ``BANDS``
bands of ``ROWS`` bins find a pair of similarity 0.8 with probability 0.988, one of 0.85
with 0.9995. Pairs in a common band are compared as texts, unless the total weights rule
the similarity out or the samples do: of the bins that either text fills itself, fewer agree
than of a similar pair would with a probability of ``LOST``, by Hoeffding's bound for draws
without replacement. Short texts fill few bins, so little can be said and they are compared.

Documents of equal words are one node. Candidate pairs are verified on all shingles, hub
by hub (see graph.py), and classes are the connected components. In buckets of more than
``CROWD`` members, those that are not in the largest class by then are compared with all
others where they stand, see crowd_links().

Defined results: null and empty texts are classes of their own; texts without words share
a class if they are equal; null doc_ids have a null class; rows with the same doc_id share
a class; the class id is the least doc_id in it; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph
from .common import Memo, Workspace, materialize, small_batches, tidy
from .decontaminate import words_of

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 8
BINS = BANDS * ROWS
#: Numbers of 64 bits that hold a bit a bin, and bits kept of a sample.
WIDE, PLANES = BINS // 64, 4
COMMON = 0.5
#: Share, and number, of documents up to which op6 takes a shingle as rare.
RARE, FEW = 0.001, 2
#: Shingles in a block, some 15,000 documents; it takes 50 MB or so.
BLOCK = 4_000_000
#: Documents of a task that names shingles, at least, times the share from which they are named:
#: one that has but a few documents would name each shingle of them.
NAMING = 8
#: Probability that the samples rule out a pair that is similar.
LOST = 1e-6
#: Members of a bucket that are compared pair by pair.
CROWD = 32
#: Documents whose ids are sent to all executors at most; beyond, a join deals them out.
SENT = 1_000_000

U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _uniform(h: np.ndarray, k: int) -> np.ndarray:
    return ((_mix(h + U(k) * _GOLD) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


class Shingler:
    """Distinct shingles of texts, with counts."""

    def __init__(self, words: int = WORDS):
        self.n = words
        self.table = Memo(xxhash.xxh3_64_intdigest, limit=250_000)
        with np.errstate(over="ignore"):
            self.odd = _mix(np.arange(1, words + 1, dtype=U) * _GOLD) | U(1)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter(map(self.table.__getitem__, words), U, len(words))
        n = max(1, len(h) - self.n + 1) if len(h) else 0
        out = np.zeros(n, U)
        for i in range(min(self.n, len(h))):
            out += h[i : i + n] * self.odd[i]
        return np.unique(_mix(out), return_counts=True)


class Weights:
    """IDF of shingles: 1 unless among the common ones, of which each is in more than ``rare`` of all."""

    def __init__(self, common: dict[int, int], docs: int, rare: float = COMMON):
        self.keys = np.array(sorted(common), U)
        share = np.array([common[int(k)] / max(docs, 1) for k in self.keys])
        self.values = 0.5 + 0.5 * np.log(np.maximum(share, 1e-12)) / np.log(rare)

    def __call__(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = counts.astype(np.float64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
            hit = self.keys[at] == shingles
            out[hit] *= self.values[at[hit]]
        return out


def signatures_of(features: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A row per text of one sample per bin; two rows agree in a bin with the probability
    of the weighted Jaccard similarity. And which bins hold a sample of their own."""
    n = len(features)
    owner = np.repeat(np.arange(n), [len(k) for k, _ in features])
    shingles, weights = np.concatenate([k for k, _ in features]), np.concatenate([w for _, w in features])
    r = -np.log(_uniform(shingles, 1) * _uniform(shingles, 2))
    c = -np.log(_uniform(shingles, 3) * _uniform(shingles, 4))
    t = np.floor(np.log(weights) / r + _uniform(shingles, 5))
    a = np.log(c) - r * (t - _uniform(shingles, 5)) - r
    bins = (_mix(shingles + U(6) * _GOLD) % U(BINS)).astype(np.int64)
    sample = _mix(shingles + t.astype(np.int64).view(U) * U(0xD6E8FEB86659FD93))
    order = np.lexsort((shingles, a))[::-1]
    least = np.full(n * BINS, -1)
    least[(owner * BINS + bins)[order]] = order  # the last one assigned, that of the least a, stays
    least = least.reshape(n, BINS)
    place = np.arange(2 * BINS)  # twice around, so that the next full bin is always ahead
    full = np.where(np.concatenate([least, least], axis=1) >= 0, place, 4 * BINS)
    ahead = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1][:, :BINS]
    taken = sample[np.take_along_axis(least, ahead % BINS, axis=1)]
    return _mix(taken + (ahead - place[:BINS]).astype(U) * _GOLD), least >= 0


def bands(samples: np.ndarray) -> np.ndarray:
    """Keys of the bands of each row of samples."""
    rows = samples.reshape(len(samples), BANDS, ROWS)
    key = np.arange(BANDS, dtype=U)[None, :]
    for i in range(ROWS):
        key = _mix(key * _GOLD + rows[:, :, i])
    return key.view(np.int64)


def planes(samples: np.ndarray, full: np.ndarray) -> np.ndarray:
    """A bit a bin, in rows of numbers of 64: which bins are full, then four bits of their samples."""
    bits = [full, *(full & ((samples >> U(b)) & U(1)).astype(bool) for b in range(PLANES))]
    return np.concatenate([np.packbits(x, axis=1, bitorder="little").view("<u8") for x in bits], axis=1).view(np.int64)


def alike(least: float) -> Callable[[str, str], tuple[Column, Column]]:
    """Whether total weights and samples allow a similarity of ``least``, and how many samples agree.

    The shared part is at most the lighter text, the whole at least the heavier one. Of the
    ``n`` bins that either text fills, at least ``least * n - sqrt(-ln(LOST) * n / 2)`` agree.
    """

    def told(x: str, y: str) -> tuple[Column, Column]:
        xw, yw = F.col(f"{x}.weight"), F.col(f"{y}.weight")
        apart = [" | ".join(f"({x}.s{w + WIDE * b} ^ {y}.s{w + WIDE * b})" for b in range(1, PLANES + 1)) for w in range(WIDE)]
        either = " + ".join(f"bit_count({x}.s{w} | {y}.s{w})" for w in range(WIDE))
        same = " + ".join(f"bit_count({x}.s{w} & {y}.s{w} & ~({apart[w]}))" for w in range(WIDE))
        agree = F.expr(f"{same} >= {least}D * ({either}) - sqrt({-math.log(LOST) / 2}D * ({either}))")
        return (F.least(xw, yw) >= F.greatest(xw, yw) * F.lit(least - 1e-9)) & agree, F.expr(same)

    return told


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted shingles, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][i], b[1][j]
    whole = a[1].sum() + b[1].sum() - np.minimum(x, y).sum()
    return float(np.minimum(x, y).sum() / whole) if whole else 0.0


def _texts(batch: pa.RecordBatch, column: int) -> list:
    return batch.column(column).to_pylist()


def common_shingles(docs: DataFrame, block: int = 1_000_000, rare: float = COMMON) -> Weights:
    """IDF from exact document frequencies of all shingles in more than ``rare`` of the documents
    (and more than ``FEW``). Blocks have to hold 1 / ``rare`` documents, or they name every shingle;
    so small partitions are read ``NAMING / rare`` documents a task, however many there are."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size, n = Shingler(), [], 0, 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(rare / 2 * n, 1)
            made = [pa.array(np.append(keys[often].view(np.int64), 0)), pa.array(np.append(counts[often], 0)), pa.array(np.append(np.zeros(often.sum(), np.int64), n))]
            return pa.RecordBatch.from_arrays(made, names=["shingle", "n", "docs"])

        with np.errstate(over="ignore"):
            for batch in batches:
                for text in _texts(batch, 0):
                    own, _ = shingler(words_of(text))
                    held.append(own)
                    size, n = size + len(own), n + 1
                if size >= 2 * block:  # keep a block's worth back, so that the last one is no splinter
                    cut = len(held) // 2
                    rest, held[cut:] = held[cut:], []
                    kept, n = n - cut, cut
                    yield out()
                    held, n = rest, kept
                    size = sum(map(len, held))
            if held:
                yield out()

    texts = docs.select("text")
    tasks = max(int(docs.count() * rare / NAMING), 1)
    rows = texts.coalesce(tasks).mapInArrow(tidy(named), "shingle long, n long, docs long")
    found = materialize(rows.groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "df")
    total = found.agg(F.sum("docs")).first()[0] or 0
    share = min(max(rare, FEW / max(total, 1)), COMMON)
    candidates = found.filter(F.col("n") > share / 2 * total).select("shingle").toArrow()["shingle"].to_numpy()
    if not len(candidates):
        return Weights({}, total)
    wanted = np.sort(candidates.view(U))  # of bounded size, see above

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, keys = Shingler(), wanted
        counts = np.zeros(len(keys), np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                for text in _texts(batch, 0):
                    own, _ = shingler(words_of(text))
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    counts[at[keys[at] == own]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[counts > 0].view(np.int64)), pa.array(counts[counts > 0])], names=["shingle", "n"])

    exact = texts.mapInArrow(tidy(counted), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    often = exact.filter(F.col("n") > share * total).toArrow()
    return Weights({k % 2**64: n for k, n in zip(*(often[c].to_pylist() for c in ("shingle", "n")), strict=True)}, total, share)


def signatures(docs: DataFrame, weigh: Weights) -> DataFrame:
    """doc_id, d1 and d2 (digest of the words, else of the text; null without text), band keys,
    samples in four bits each (planes()) and total weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = _texts(batch, 1)
                said = [words_of(text) for text in texts]
                whole = [b" ".join(words) if words else b"\0" + text.encode() if text else None for words, text in zip(said, texts, strict=True)]
                digests = [None if w is None else xxhash.xxh3_128_intdigest(w) for w in whole]
                d1 = [None if d is None else (d >> 64) - 2**63 for d in digests]
                d2 = [None if d is None else (d & (2**64 - 1)) - 2**63 for d in digests]
                features = [(own, weigh(own, counts)) for own, counts in (shingler(words) for words in said if words)]
                samples, full = signatures_of(features) if features else (np.zeros((0, BINS), U), np.zeros((0, BINS), bool))
                keys, marks, totals = iter(bands(samples)), iter(planes(samples, full)), iter([float(w.sum()) for _, w in features])
                longs = pa.list_(pa.int64())
                made = [
                    batch.column(0),
                    pa.array(d1, pa.int64()),
                    pa.array(d2, pa.int64()),
                    pa.array([next(keys) if words else None for words in said], longs),
                    pa.array([next(marks) if words else None for words in said], longs),
                    pa.array([next(totals) if words else None for words in said], pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "d1", "d2", "keys", "marks", "weight"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, d1 long, d2 long, keys array<long>, marks array<long>, weight double")


def verified(pairs: DataFrame, texts: DataFrame, weigh: Weights, least: float) -> DataFrame:
    """The pairs (a: member, b: hub) whose texts are similar enough.

    Members meet their hub in a partition, hub first; a hub of many members is dealt to
    one place for every 200 of them.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hubs = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / 200).cast("long").alias("places"))
    member = pairs.join(hubs, "b").select("a", F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("places")).alias("place"))
    member = member.join(texts, member["a"] == texts["id"]).select("hub", "place", F.lit(1).alias("kind"), "id", "text")
    hub = hubs.join(texts, hubs["b"] == texts["id"]).select(
        F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1)).alias("place"), F.lit(0).alias("kind"), "id", "text"
    )
    dealt = hub.unionByName(member).repartition(parts, "hub", "place").sortWithinPartitions("hub", "place", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, own = Shingler(), None, None

        def features(text: str) -> tuple[np.ndarray, np.ndarray]:
            shingles, counts = shingler(words_of(text))
            return shingles, weigh(shingles, counts)

        with np.errstate(over="ignore"):
            for batch in batches:
                a, b = [], []
                for hub_id, _, kind, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == 0:
                        now, own = hub_id, features(text)
                    elif now == hub_id and similarity(own, features(text)) >= least:
                        a.append(doc)
                        b.append(hub_id)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long")


#: Documents that others are compared with in one place, and how many of those.
BENCH, QUEUE = 64, 2_000


def crowd_links(hubs: DataFrame, members: DataFrame, texts: DataFrame, weigh: Weights, least: float) -> DataFrame:
    """(a, b) of all pairs of a hub and a member of its crowd (crowd, id) that are similar.

    Hubs are dealt to benches of ``BENCH``; for each, members come by in queues of some
    ``QUEUE``, and each is compared with all hubs of the bench where it stands. So no pair
    is made but those that are links, and no task has more than a bench and a queue.
    """
    parts = int(hubs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = members.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / QUEUE).cast("long").alias("places"))
    turn = F.row_number().over(Window.partitionBy("crowd").orderBy("id")) - 1
    seated = materialize(hubs.withColumn("turn", turn).select("crowd", "id", F.expr(f"cast(turn div {BENCH} as long)").alias("bench")), "hubs")
    ends = seated.groupBy("crowd").agg(F.max("bench").alias("last"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    sitting = seated.join(places, "crowd").withColumn("place", each(F.col("places") - 1)).select("crowd", "bench", "place", F.lit(0).alias("kind"), "id")
    coming = members.join(places, "crowd").withColumn("place", F.pmod(F.xxhash64("id"), F.col("places"))).join(ends, "crowd").withColumn("bench", each(F.col("last")))
    coming = coming.select("crowd", "bench", "place", F.lit(1).alias("kind"), "id")
    rows = sitting.unionByName(coming).join(texts, "id").select("crowd", "bench", "place", "kind", "id", "text")
    dealt = rows.repartition(parts, "crowd", "bench", "place").sortWithinPartitions("crowd", "bench", "place", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, at, own = Shingler(), None, []

        def features(text: str) -> tuple[np.ndarray, np.ndarray]:
            shingles, counts = shingler(words_of(text))
            return shingles, weigh(shingles, counts)

        with np.errstate(over="ignore"):
            for batch in batches:
                a, b = [], []
                for *place, kind, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if place != at:
                        at, own = place, []
                    shingles, weights = features(text)
                    if kind == 0:
                        own.append((doc, dict(zip(shingles.tolist(), weights.tolist(), strict=True)), float(weights.sum())))
                        continue
                    mine, total = dict(zip(shingles.tolist(), weights.tolist(), strict=True)), float(weights.sum())
                    for hub, theirs, whole in own:
                        if hub != doc and min(total, whole) >= least * max(total, whole) - 1e-9:
                            shared = sum(min(mine[k], theirs[k]) for k in mine.keys() & theirs.keys())
                            if shared >= least * (total + whole - shared) - 1e-9:
                                a.append(max(doc, hub))
                                b.append(min(doc, hub))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def only(docs: DataFrame, ids: DataFrame, name: str = "doc_id", how: str = "left_semi") -> DataFrame:
    """``docs`` with (or, left_anti, without) ``ids``, sent to all executors if few."""
    few = ids.limit(SENT + 1).count() <= SENT
    return docs.join(F.broadcast(ids) if few else ids, name, how)


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, copies): a row per document; copies counts rows of equal words."""
    small_batches(docs.sparkSession)
    with Workspace(docs.sparkSession) as work:
        weights = common_shingles(docs, BLOCK, RARE)
        table = materialize(signatures(docs, weights), "signatures")
        equal = table.filter("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"))
        equal = materialize(equal, "equal")
        heads = table.join(equal.select("d1", "d2", F.col("node").alias("doc_id")), ["d1", "d2", "doc_id"], "left_semi").dropDuplicates(["d1", "d2"])
        keys = heads.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key"))
        keys = materialize(graph.shared_buckets(keys), "shared")
        wanted = materialize(keys.select(F.col("id").alias("doc_id")).distinct(), "wanted")
        sketches = heads.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(
            F.col("doc_id").alias("id"), F.struct("weight", *[F.col("marks")[i].alias(f"s{i}") for i in range(WIDE * (PLANES + 1))]).alias("sketch")
        )
        texts = only(docs.select("doc_id", "text").filter("doc_id is not null"), wanted).select(F.col("doc_id").alias("id"), "text")
        texts = materialize(texts.dropDuplicates(["id"]), "texts")
        verify = lambda pairs: verified(pairs, texts, weights, least)
        scan = lambda hubs, members: crowd_links(hubs, members, texts, weights, least)
        roots = graph.classes(keys, sketches, alike(least), verify, "links", scan=scan, crowd=CROWD, python=True)
        groups = equal.join(roots, "node", "left").withColumn("class_id", F.coalesce("root", "node"))
        groups = groups.filter("copies > 1 or class_id <> node").select("d1", "d2", "class_id", "copies")
        rows = table.select("doc_id", "d1", "d2").join(groups, ["d1", "d2"], "left")
        return work.keep(rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies")))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the one with the least doc_id."""
    found = classes(docs, least)
    dropped = found.filter("doc_id <> class_id").select("doc_id").distinct()
    kept = only(docs, dropped, how="left_anti")
    twice = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if twice.isEmpty():
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))
