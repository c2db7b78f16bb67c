"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items is built once from the benchmark and sent to the executors,
which stream each document's words through it and track the longest match that ends at
each word. A match of at least ``WINDOW`` words marks the last ``WINDOW`` as hit, and the
automaton's state says which items hold that window; an item with fewer words is one
window of its own length.

A benchmark is a stated query set. One automaton holds at most some ``BLOCK_WORDS`` words
of it. A larger benchmark goes in blocks: for each in turn an automaton is built, sent, run
over all texts in a pass of its own and given up, so no worker ever holds two; the passes'
hits, which are few, are merged by document.

``clean`` removes what is over the limits: documents of which hit words are a twentieth or
more go, and the others lose the spans of their hits.

Words are maximal runs of digits, letters a-z (after lower-casing A-Z) and characters
beyond ASCII. Null and empty texts have no words and are clean; items without words match
nothing; repeated rows are judged each on its own; equal items all count; null item_ids
are hit like others but not named. Empty tables give empty results, or clean documents.
Where a kept column is called like one of the results, the result takes its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, materialize, small_batches, tidy

WINDOW = 13
#: Words of the benchmark in one automaton: a hundred MB of Python objects or so.
BLOCK_WORDS = 200_000

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """All factors of a set of word sequences, with the items that hold their windows."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        ends: list[tuple[int, int]] = []  # state of a prefix of at least a window, item
        short: list[tuple[int, int, int]] = []  # state, item's length, item
        pairs = set()
        for k, (_, words) in enumerate(items):
            codes = [self.ids.setdefault(w, len(self.ids)) for w in words]
            pairs.update(zip(codes, codes[1:], strict=False))
            last = 0
            for i, c in enumerate(codes):
                last = self._extend(last, c)
                if i + 1 >= window:
                    ends.append((last, k))
            if 0 < len(codes) < window:
                short.append((last, len(codes), k))
        # the state that stands for the last `window` words of a match, for each state
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.anchor = [-1] * len(self.link)
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.anchor[v] = v if self.length[up] < window else self.anchor[up]
        held: dict[int, set[int]] = {}
        for v, k in ends:
            held.setdefault(self.anchor[v], set()).add(k)
        self.held = held
        # short items: those that end a match, found along the suffix links
        own: dict[int, list[tuple[int, int]]] = {}
        for v, n, k in short:
            own.setdefault(v, []).append((n, k))
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v in order:
            found = own.get(v, []) + self.short.get(self.link[v], []) if v else []
            if found:
                self.short[v] = found
        self.least = min([window, *(n for _, n, _ in short)])
        self.pairs = np.array(sorted(a * len(self.ids) + b for a, b in pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of ``words``, in order and not touching, and the items that occur."""
        n, spans, items = len(words), [], set()
        if not n or not self.ids:
            return spans, items
        codes = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, n)
        known = codes >= 0
        if self.least == 1:
            runs = _runs(known)
        else:  # only where neighbours stand side by side in some item can a match go on
            joined = known[:-1] & known[1:]
            at = np.flatnonzero(joined)
            key = codes[at] * len(self.ids) + codes[at + 1]
            place = np.searchsorted(self.pairs, key)
            place[place == len(self.pairs)] = 0
            joined[at] = self.pairs[place] == key if len(self.pairs) else False
            runs = [(a, b + 1) for a, b in _runs(joined)]
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for a, b in runs:
            if b - a < self.least:
                continue
            v = size = 0
            for i, c in enumerate(codes[a:b].tolist(), a):
                while v and c not in nxt[v]:
                    v = link[v]
                    size = length[v]
                to = nxt[v].get(c)
                if to is None:
                    v = size = 0
                    continue
                v, size = to, size + 1
                if size >= window:
                    u = v
                    while length[link[u]] >= window:  # the match may be shorter than the state
                        u = link[u]
                    items |= self.held[u]
                    _add(spans, i + 1 - window, i + 1)
                for m, k in self.short.get(v, ()):
                    if m <= size:
                        items.add(k)
                        _add(spans, i + 1 - m, i + 1)
        return spans, items


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _add(spans: list[tuple[int, int]], a: int, b: int) -> None:
    """Spans come by their ends; one that touches the last ones swallows them."""
    while spans and spans[-1][1] >= a:
        x, y = spans.pop()
        a, b = min(a, x), max(b, y)
    spans.append((a, b))


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata over the items, each of about ``block_words`` words, read one by one."""
    held, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if words:
            held.append((None if row["item_id"] is None else str(row["item_id"]), words))
            n += len(words)
        if n >= block_words:
            yield SuffixAutomaton(held, window)
            held, n = [], 0
    if held:
        yield SuffixAutomaton(held, window)


SPANS, ITEMS = pa.list_(pa.list_(pa.int32())), pa.list_(pa.string())


def _hits(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """``rows`` (the last column is text) with the spans and items of one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            found = [automaton.scan(words_of(text)) for text in batch.column(batch.num_columns - 1).to_pylist()]
            spans = pa.array([[list(s) for s in x] for x, _ in found], SPANS)
            items = pa.array([sorted({automaton.names[k] for k in y}, key=str) for _, y in found], ITEMS)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans, items], names=[*batch.schema.names, "spans", "items"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(tidy(run), f"{schema}, spans array<array<int>>, items array<string>")


def _marked(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """``rows`` (kept, text) with spans and items of the whole benchmark."""
    spark = rows.sparkSession
    small_batches(spark)
    automata = blocks(benchmark, window)
    some = [a for a in (next(automata, None), next(automata, None)) if a]
    if not some:
        return rows.withColumns({"spans": F.array().cast("array<array<int>>"), "items": F.array().cast("array<string>")})
    if len(some) == 1:
        return _hits(rows, spark.sparkContext.broadcast(some[0]))
    with Workspace(spark) as work:
        texts = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "texts")
        hits = None
        for automaton in chain((some.pop(0), some.pop(0)), automata):
            with Workspace(spark) as turn:
                one = turn.keep(_hits(texts.select("row", "text"), turn.share(automaton)).filter("size(spans) > 0").drop("text"), "hits")
            hits = one if hits is None else hits.unionByName(one)
        met = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        whole = texts.join(met, "row", "left")
        none = {"spans": F.coalesce("spans", F.array().cast("array<array<int>>")), "items": F.coalesce("items", F.array().cast("array<string>"))}
        return work.keep(whole.withColumns(none).select("kept", "text", "spans", "items"))


def _judged(rows: DataFrame, benchmark: DataFrame, window: int, share: float, with_text: bool) -> DataFrame:
    """kept and the columns of scan()."""
    parts = round(1 / share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for text, spans, items in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                merged: list[tuple[int, int]] = []
                for a, b in sorted(spans, key=lambda s: s[1]):
                    _add(merged, a, b)
                n, hit = len(words_of(text)), sum(b - a for a, b in merged)
                said = ",".join(sorted(x for x in items if x is not None))
                row = [n, hit, len(items), hashlib.sha256(said.encode()).hexdigest(), hit > 0 and parts * hit >= n, [list(s) for s in merged]]
                told.append([*row, without(text, merged)] if with_text else row)
            made = [pa.array([r[i] for r in told], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["kept", *names])

    names = [*RESULT, "cleaned"] if with_text else list(RESULT)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), SPANS, pa.string()][: len(names)]
    kinds = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>" + ", cleaned string" * with_text
    marked = _marked(rows, benchmark, window)
    return marked.mapInArrow(tidy(run), f"kept {rows.schema['kept'].dataType.simpleString()}, {kinds}")


RESULT = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    keep: tuple[str, ...] = ("doc_id",),
    share: float = 0.05,
    with_text: bool = False,
) -> DataFrame:
    """Per document: ``keep``, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    ``contaminated`` where hit words are at least ``share`` of all. ``with_text`` adds
    cleaned, the text without the characters from the first to the last word of each span.
    """
    rows = _judged(docs.select(F.struct(*keep).alias("kept"), "text"), benchmark, window, share, with_text)
    own = rows.columns[1:]
    return rows.select(*[F.col("kept")[k].alias(k) for k in keep if k not in own], *own)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05) -> DataFrame:
    """``docs`` without the contaminated ones; the others' texts without the spans of hits.

    Columns and texts without hits stay as they are.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = _judged(docs.select(F.struct(*rest).alias("kept"), "text"), benchmark, window, share, with_text=True).filter("not contaminated")
    return rows.select(*[F.col("cleaned").alias("text") if c == "text" else F.col("kept")[c].alias(c) for c in docs.columns])


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the characters of the words in ``spans``."""
    if not text or not spans:
        return text
    data = text.encode()
    folded = data.translate(_FOLD)
    starts, ends, at = [], [], 0
    for w in folded.split():
        at = folded.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, done = [], 0
    for a, b in spans:
        out.append(data[done : starts[a]])
        done = ends[b - 1]
    return b"".join([*out, data[done:]]).decode()


def sql(window: int = WINDOW) -> str:
    """DuckDB SQL for the rows of :func:`scan`, by joining all windows as strings."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
        i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
        cut AS (SELECT item, w, least({window}, len(w)) AS k, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
        iw AS (SELECT DISTINCT item, k, array_to_string(w[p : p + k - 1], ' ') AS win FROM cut),
        placed AS (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) AS ks WHERE len(w) >= k),
        met AS (SELECT r, p, dw.k, item FROM (SELECT r, k, p, array_to_string(w[p : p + k - 1], ' ') AS win FROM placed) AS dw JOIN iw ON iw.k = dw.k AND iw.win = dw.win),
        hits AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM met) AS x GROUP BY r),
        named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""
