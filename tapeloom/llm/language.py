"""Language identification: known words first, character n-grams for the rest.

Training counts words per language over labelled documents, and the character n-grams of
each length in them. A known word scores by its per-language log frequencies. An unseen
word falls back to its longest n-grams of which any is known, 5 characters, then 4, down
to 1. A document's score per language is the sum over all its words. Words are runs of
letters.

Training reads at most ``max_rows`` labelled documents, those with the least hashes of
their ids, and keeps all their words and n-grams; so the model's size is bounded by that
parameter, at any scale. The counting is distributed; the driver gets the counts as arrays,
and the model is arrays of hashes and log frequencies.

Defined results: null text, or text without a letter, is ``und`` with score 0; texts of
any length are read whole; ties between languages go to the first by name; without any
labelled row every document is ``und``; repeated rows are judged alike.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, resident, small_batches, tidy


def _class(chars: list[int]) -> str:
    """A regular expression's class of code points in ascending order, as ranges."""
    breaks = [i for i in range(len(chars)) if not i or chars[i] != chars[i - 1] + 1]
    return "".join(f"{re.escape(chr(chars[a]))}-{re.escape(chr(chars[b - 1]))}" for a, b in zip(breaks, [*breaks[1:], len(chars)], strict=True))


#: Words as the text is read, quickly; LETTERS cuts each distinct one into runs of letters,
#: as numerals like a superscript two count among the word characters that are no digits.
WORD = re.compile(r"[^\W\d_]+")
LETTERS = re.compile(rf"[^\W_{_class([c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isalpha()])}]+")
LONGEST = 5
#: Characters of a word that is kept in a worker's table at most.
LONG = 64
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    """The documents that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def key_of(gram: str) -> int:
    """What Spark's xxhash64() makes of a string."""
    value = xxhash.xxh64_intdigest(gram.encode("utf-8", "surrogatepass"), 42)
    return value - 2**64 if value >> 63 else value


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = []
        for lang, read in counts.items():
            c: Counter = Counter()
            for w, n in read.items():
                for run in LETTERS.findall(w):
                    c[run] += n
            rows += [(lang, 0, w, n) for w, n in c.items()]
            for size in range(1, LONGEST + 1):
                found: Counter = Counter()
                for w, n in c.items():
                    for g in grams(w, size):
                        found[g] += n
                rows += [(lang, size, g, n) for g, n in found.items()]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = [pa.string(), pa.int32(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["lang", "size", "gram", "n"])

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        if sum(map(len, counts.values())) > 200_000:
            yield out()
            counts = {}
    if counts:
        yield out()


class Model:
    """Log frequencies of words (size 0) and n-grams (sizes 1 to 5) per language.

    Of each count: ``lang``, a place in ``langs``, which are in order of name; ``size``;
    ``key``, the gram's hash; and ``n``. A table is the hashes in ascending order and a row
    of log frequencies for each.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, size: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.name, self.langs = uuid.uuid4().hex, langs
        at, keys = np.asarray(lang, np.int64), np.asarray(key, np.int64)
        size, n = np.asarray(size), np.asarray(n, np.float64)
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(LONGEST + 1):
            own = size == k
            distinct, row = np.unique(keys[own], return_inverse=True)
            counts = np.zeros((len(distinct), len(self.langs)))
            np.add.at(counts, (row, at[own]), n[own])
            self.tables.append((distinct, (np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * (len(distinct) + 1))).astype(np.float32)))

    def _found(self, size: int, grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``grams`` the table of their size has, and the rows of those."""
        keys, values = self.tables[size]
        if not len(keys):
            return np.zeros(len(grams), bool), values[:0]
        wanted = np.fromiter(map(key_of, grams), np.int64, len(grams))
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        hit = keys[at] == wanted
        return hit, values[at[hit]]

    def known(self, size: int, grams: list[str]) -> np.ndarray:
        """A row for each of ``grams`` that the table of their size has."""
        return self._found(size, grams)[1]

    def words(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own, or the mean of those of its longest known n-grams."""
        out, left = np.zeros((len(words), len(self.langs))), np.arange(len(words))
        for size in (0, *range(LONGEST, 0, -1)):
            cut = [grams(words[i], size) if size else [words[i]] for i in left]
            hit, rows = self._found(size, [g for own in cut for g in own])
            owner = np.repeat(np.arange(len(left)), [len(own) for own in cut])[hit]
            n = np.bincount(owner, minlength=len(left))
            for k in range(out.shape[1]):
                out[left, k] = np.bincount(owner, rows[:, k], len(left)) / np.maximum(n, 1)
            left = left[n == 0]
            if not len(left):
                break
        return out

    def word(self, word: str) -> np.ndarray:
        return self.words([word])[0]


class Scorer:
    """Scores of documents under a model, with a bounded table of the words met."""

    def __init__(self, model: Model, limit: int = 200_000):
        self.model, self.limit = model, limit
        self.rows = np.zeros((limit + 1, max(1, len(model.langs))))
        self.table: dict[str, int] = {}
        self.n = 1  # row 0 is that of words without a letter

    def _places(self, words: list[str]) -> np.ndarray:
        """The row of each word; words not met before are looked up together."""
        new = list(set(words).difference(self.table))
        cut = [[word] if word.isalpha() else LETTERS.findall(word) for word in new]
        runs = [run for own in cut for run in own]
        owner = np.repeat(np.arange(len(new)), [len(own) for own in cut])
        if runs:
            self.rows[self.n : self.n + len(new)] = 0
            np.add.at(self.rows, self.n + owner, self.model.words(runs))
        self.table.update((word, self.n + i if own else 0) for i, (word, own) in enumerate(zip(new, cut, strict=True)))
        self.n += len(new)
        at = np.fromiter(map(self.table.__getitem__, words), np.int64, len(words))
        for word in new:
            if len(word) > LONG:
                del self.table[word]
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        total, n = np.zeros(self.rows.shape[1]), 0
        for a in range(0, len(words), 10_000):  # so that the table can be emptied between
            part = words[a : a + 10_000]
            if self.n + len(part) > self.limit:
                self.table.clear()
                self.n = 1
            at = self._places(part)
            total += self.rows[at].sum(axis=0)
            n += np.count_nonzero(at)
        if not n:
            return UNKNOWN, 0.0
        best = int(np.argmax(total))
        # how sure: the softmax of the mean over words, sharper with more of them up to 30
        mean = (total - total[best]) / n * min(n, 30)
        return self.model.langs[best], float(round(1 / np.exp(mean).sum(), 6))


def train(docs: DataFrame, max_rows: int = 20_000) -> Model:
    """A model from ``text`` and ``lang`` of the documents that are not held out."""
    small_batches(docs.sparkSession)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).distinct()
    rows = labelled.join(F.broadcast(ids), "doc_id", "left_semi").select("lang", "text")
    counts = rows.mapInArrow(tidy(_count), "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    found = counts.select("lang", "size", F.xxhash64("gram").alias("key"), "n").toArrow()
    coded = found["lang"].combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    place = np.array([langs.index(x) for x in names], np.int64)
    lang = place[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
    model = Model(langs, lang, *(found[c].to_numpy() for c in ("size", "key", "n")))
    del found, coded, lang
    release(docs.sparkSession)
    return model


def scorer(model: Model) -> Scorer:
    """The scorer of this Python worker, for the tasks that follow."""
    return resident(model.name, lambda: Scorer(model))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with lang_pred and score (0 to 1) of every document's whole text."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in batches:
            said = [score(text) for text in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return source.mapInArrow(tidy(run, model.name), schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those that have no letter, and so no language; columns as they are."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    name = model.name  # the model itself goes by broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([score(text)[0] != UNKNOWN for text in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run, name), docs.schema)
