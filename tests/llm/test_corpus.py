"""Scans, fingerprints, dedup and decontamination against brute force on small documents."""

import hashlib
import math
import os
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.llm import common, decontaminate, fingerprint, graph, language, licenses, line_dedup, near_copies

DOCS = "doc_id long, text string"


def words(n, seed=0, vocabulary=5000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}x{rng.randrange(50)}" for _ in range(n)]


# -- licenses


def test_license_texts_in_other_spellings(spark):
    other = "The  " + licenses.MIT.upper().replace("COPYRIGHT (C) <YEAR> <HOLDERS>", "COPYRIGHT (C) 2020 SOMEONE ELSE").replace("SUBLICENSE", "SUB-LICENSE")
    rows = [
        (1, licenses.MIT), (2, other.removeprefix("The  ")), (3, "prose\nReleased under the MIT Licence!\nmore"), (4, None), (5, ""), (6, "...\n--"), (7, licenses.ISC + " extra"),
        (8, "Licensed under CC BY-NC 4.0."), (8, "Licensed under CC BY-NC 4.0."), (9, "SPDX-License-Identifier: Apache-2.0"), (10, "Copyright 2020 X\nAll rights reserved."),
    ]
    got = licenses.scan(spark.createDataFrame(rows, DOCS)).collect()
    found = {r["doc_id"]: (r["license"], r["notices"]) for r in got}
    assert len(got) == len(rows)
    assert found[1] == found[2] == ("MIT", "MIT") and found[3] == (None, "MIT") and found[7][0] is None and found[9][1] == "Apache-2.0"
    assert found[4] == found[5] == found[6] == found[10] == (None, "")
    assert {r["doc_id"] for r in got if r["text_digest"] is None} == {4, 5, 6, 10}


def test_license_scan_equals_sql(spark):
    rows = [(i, t) for i, t in enumerate([licenses.ZLIB, licenses.UNLICENSE, "a\rb copyright x", "© 2020\nfoo & bar", "Licensed under the Apache License, Version 2.0.", None, "x\n\nLICENCE"])]
    docs = spark.createDataFrame(rows, DOCS)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(licenses.sql()).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in licenses.scan(docs).collect())


def test_licenses_at_every_width_and_in_comments(spark):
    def wrapped(text, width, prefix=""):
        paragraphs = [textwrap.wrap(x, width, break_long_words=False, break_on_hyphens=False) for x in text.split("\n\n")]
        return ("\n" + prefix + "\n").join("\n".join(prefix + line for line in x) for x in paragraphs)

    cases = [(name, wrapped(text.replace("<year> <holders>", "2019-2024 Some One <a@b.c>"), width, prefix)) for name, text in licenses.TEXTS for width in (*range(60, 101), 10**6) for prefix in ("", " * ")]
    for name, path in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(f := f"/usr/share/common-licenses/{path}"):
            with open(f, encoding="utf-8") as file:
                text = file.read()
            cases += [(name, text), (name, " ".join(text.split())), *((name, wrapped(text, width, "# ")) for width in (60, 72, 100))]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)], DOCS)
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    assert [(cases[i][0], i) for i in range(len(cases)) if got[i] != cases[i][0]] == []


def test_a_long_license_on_one_line_and_columns_of_the_same_name(spark):
    docs = spark.createDataFrame([(1, "prose\n" + " ".join(licenses.UNLICENSE.split()) + "\nmore", "x")], DOCS + ", license string")
    got = licenses.scan(docs, keep=("doc_id", "license")).first()
    assert (got["doc_id"], got["license"], got["notices"]) == (1, None, "Unlicense")


def test_no_python_in_native_plans(spark):
    docs = spark.createDataFrame([(1, "a\nb")], DOCS)
    for df in (licenses.scan(docs), line_dedup.signatures(line_dedup.lines(docs)), line_dedup.dedup(docs)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString() and "Arrow" not in df._jdf.queryExecution().executedPlan().toString()


# -- language


def tongue(lang, n, seed):
    parts = {"aa": ["ba", "bo", "ta"], "zz": ["ki", "ku", "ri"]}[lang]
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_of_held_out_documents(spark):
    rows = [(i, tongue(lang, 30, i), lang) for i, lang in enumerate(["aa", "zz"] * 60)] + [(900, None, "aa"), (901, "123 ...", "zz"), (902, "", None), (903, "kikurikuku" * 3000, None), (None, "babo", None)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = language.train(docs)
    said = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert all(said[i]["lang_pred"] == lang for i, _, lang in rows[:120])
    assert [said[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and said[903]["lang_pred"] == "zz" and said[None]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in said.values())
    held = {r[0] for r in docs.filter(language.held_out()).select("doc_id").collect()}
    assert held == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}


def test_training_never_sees_held_out_rows_or_more_than_its_bound(spark):
    rows = [(i, "unique" + str(i) if zlib.crc32(str(i).encode()) % 4 == 2 else "common", "aa") for i in range(60)]
    model = language.train(spark.createDataFrame(rows, DOCS + ", lang string"))
    assert len(model.tables[0][0]) == 1 and model.known(0, ["common"])[0][0] <= 0
    few = language.train(spark.createDataFrame([(i, f"only{chr(97 + i % 26)}{chr(97 + i // 26)}", "aa") for i in range(200)], DOCS + ", lang string"), max_rows=5)
    assert len(few.tables[0][0]) == 5


def test_no_labels_no_language(spark):
    docs = spark.createDataFrame([(1, "abc", None)], DOCS + ", lang string")
    assert language.predict(docs, language.train(docs)).first()["lang_pred"] == "und"


def test_unseen_words_fall_back_to_shorter_grams():
    model = language.Model(["a", "b"], [0, 1, 0], [0, 1, 1], [language.key_of(x) for x in ("known", "q", "k")], [5, 9, 9])
    assert (model.word("known") == model.known(0, ["known"])[0]).all()
    assert np.argmax(model.word("zq")) == 1 and (model.word("éé") == 0).all()


def naive_language(rows, text):
    """Scores by plain dictionaries of strings, straight from the description."""
    langs = sorted({lang for _, lang in rows})
    counts = {}
    for train, lang in rows:
        for w in re.findall(r"[a-zà-ÿ]+", train.lower()):
            for size in range(6):
                for g in [w] if size == 0 else [w[i] for i in range(len(w))] if size == 1 else [f"<{w}>"[i : i + size] for i in range(len(w) + 3 - size)]:
                    counts.setdefault(size, {}).setdefault(g, dict.fromkeys(langs, 0))[lang] += 1

    def logs(size, g):
        table = counts[size]
        return [math.log(table[g][x] + 0.5) - math.log(sum(t[x] for t in table.values()) + 0.5 * (len(table) + 1)) for x in langs]

    total, said = [0.0] * len(langs), re.findall(r"[a-zà-ÿ]+", text.lower())
    for w in said:
        rows = [logs(0, w)] if w in counts[0] else []
        for size in range(5, 0, -1):
            if not rows:
                gs = [w[i] for i in range(len(w))] if size == 1 else [f"<{w}>"[i : i + size] for i in range(len(w) + 3 - size)]
                rows = [logs(size, g) for g in gs if g in counts[size]]
        for k in range(len(langs)):
            total[k] += sum(r[k] for r in rows) / len(rows) if rows else 0.0
    best = max(range(len(langs)), key=lambda k: (total[k], -k))
    mean = [(t - total[best]) / len(said) * min(len(said), 30) for t in total]
    return langs[best], 1 / sum(map(math.exp, mean))


def test_scores_equal_brute_force(spark):
    rng = random.Random(8)
    labelled = [(tongue(lang, rng.randrange(1, 40), i) + (" éàü" if i % 3 else ""), lang) for i, lang in enumerate(["aa", "zz", "aa"] * 20)]
    texts = [tongue("aa", 3, 900) + " " + tongue("zz", k, 901 + k) + " xylé Babo" for k in range(8)]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][: len(labelled)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in zip(ids, labelled, strict=True)], DOCS + ", lang string")
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()}
    for i, text in enumerate(texts):
        lang, score = naive_language(labelled, text)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=2e-6)


def test_new_words_of_a_text_are_looked_up_together(monkeypatch):
    """A table's lookup costs far more than a word: one for each length, not one for each word."""
    model = language.Model(["a", "b"], [0, 1, 0, 1], [0, 1, 1, 2], [language.key_of(x) for x in ("known", "q", "k", "<z")], [5, 9, 9, 4])
    lookups, found = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: lookups.append(1) or found(*a, **k))
    score, text = language.Scorer(model, limit=300), " ".join(["known", "k2k", "½", "y" * 100, *words(250, seed=3)])
    want = sum(model.word(run) for w in language.WORD.findall(text) for run in language.LETTERS.findall(w))
    lookups.clear()
    first, cost = score(text), len(lookups)
    assert 0 < cost <= 6 and "y" * 100 not in score.table and score(text) == first
    assert first[0] == model.langs[int(np.argmax(want))]


def test_a_worker_keeps_the_table_of_one_operator():
    made = []
    one = common.resident("one", lambda: made.append("one") or [1])
    assert common.resident("one", list) is one
    common.resident("two", lambda: made.append("two") or [2])
    assert list(common._resident) == ["two"] and made == ["one", "two"]
    assert list(common.tidy(iter, "two")([5])) == [5] and list(common._resident) == ["two"]
    assert list(common.tidy(iter)([5])) == [5] and not common._resident


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "baba", "aa"), (3, "² ½ Ⅷ", None), (4, "baba² ½", None)], DOCS + ", lang string")
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, language.train(docs)).collect()}
    assert said == {1: ("aa", 1.0), 3: ("und", 0.0), 4: ("aa", 1.0)}


def test_empty_tables_of_scans(spark):
    none = spark.createDataFrame([], DOCS + ", lang string")
    assert language.predict(none, language.train(none)).count() == language.accepted(none, language.train(none)).count() == 0
    assert licenses.scan(none).count() == 0
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.scan(none, bench).count() == decontaminate.clean(none, bench).count() == 0


def test_accepted_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "baba", "aa", 7), (3, "123", "aa", 8), (4, None, None, 9)], "doc_id long, text string, lang string, score int")
    kept = language.accepted(docs, language.train(docs))
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1]


# -- fingerprints


def edits(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else fingerprint.LEAST), r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((doc_id, text, text[: len(text) - half] + after[:half], after))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 200])
def test_edited_texts(spark, n):
    rng = random.Random(n)
    rows = [(i * 7, "\n".join(" ".join(words(rng.randrange(12), seed=i * 50 + j)) for j in range(rng.randrange(6))) + "é😀"[: i % 3]) for i in range(n)]
    if n > 100:
        rows += [(None, "no id"), (14, "same id"), (21, None), (10**15, "far"), (-5, "")]
    got = fingerprint.compare_edits(spark.createDataFrame(rows, DOCS)).collect()
    want = edits(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got if r["doc_id"] is not None) == sorted(
        (False, d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.fingerprint(t), fingerprint.fingerprint(e)) for d, t, e, _ in want if d is not None
    )
    assert len(got) == len(rows) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_no_documents_no_fingerprints(spark):
    assert fingerprint.compare_edits(spark.createDataFrame([], DOCS)).count() == 0


def test_order_does_not_matter_and_edits_are_incremental():
    a, b, c = ("one two three", "four five", "six")
    whole = fingerprint.fingerprint("\n".join((a, b, c)))
    assert whole == fingerprint.fingerprint("\n".join((c, a, b))) != fingerprint.fingerprint("\n".join((a, b)))
    assert fingerprint.insert(fingerprint.fingerprint("\n".join((a, b))), [c]) == whole
    assert fingerprint.insert(whole, [c], -1) == fingerprint.fingerprint("\n".join((b, a)))
    assert fingerprint.fingerprint("a\na") != fingerprint.fingerprint("a")


def test_likeness_follows_the_shared_part():
    x = [" ".join(words(8, seed=i)) for i in range(200)]
    y = [" ".join(words(8, seed=1000 + i)) for i in range(200)]
    for shared in (0, 50, 100, 150, 200):
        _, like = fingerprint.vectors(["\n".join(x), "\n".join(x[:shared] + y[shared:])])
        assert fingerprint.likeness(like[:1], like[1:])[0] == pytest.approx(shared / 200, abs=0.25)


def test_likeness_of_texts_that_repeat_a_line():
    for n in (4_000, 40_000):
        _, like = fingerprint.vectors(["a b c\n" * n, "a b c\n" * (n * 3 // 4)])
        assert fingerprint.likeness(like[:1], like[1:])[0] == pytest.approx(1 - 0.0625 / 1.5625, abs=0.01)


# -- near copies


def classes_of(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in ((a, b) for a, b in edges if a != b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (6, 6), (1, 2)] + [(100 + i, 101 + i) for i in range(60)]
    for python in (False, True):
        got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), python).collect()}
        assert got == classes_of(edges, {n for e in edges for n in e if e[0] != e[1]})
        assert graph.components(spark.createDataFrame([], "a long, b long"), python).count() == 0


@pytest.mark.parametrize("size", [12, 150])
def test_groups_joined_by_one_pair_of_members(spark, size):
    one, two, odd = range(size), range(1000, 1000 + size), range(5000, 5003)
    edges = {(a, b) for group in (one, two) for a in group for b in group if a > b} | {(1000 + size // 2, size // 3)}
    ids = [*one, *two, *odd]
    members = spark.createDataFrame([(key, i) for key in (0, 7) for i in ids], "key long, id long")
    sketches = spark.createDataFrame([(i, (0,)) for i in ids], "id long, sketch struct<x long>")
    links = spark.createDataFrame(sorted(edges), "a long, b long")
    with common.Workspace(spark) as work:
        roots = work.keep(graph.classes(members, sketches, lambda x, y: (F.lit(True), F.lit(0)), lambda pairs: pairs.join(links, ["a", "b"]), "test", python=True))
    assert {r["node"]: r["root"] for r in roots.collect()} == dict.fromkeys([*one, *two], 0)


def test_unlike_lines_with_common_words_are_compared_linearly(spark, monkeypatch):
    """All lines of a crowd share two long words; one in ten is a changed copy of another."""
    verified, near = [], line_dedup.near
    monkeypatch.setattr(line_dedup, "near", lambda pairs, texts, least: verified.append(pairs.count()) or near(pairs, texts, least))
    counts = []
    for n in (400, 800, 1600):
        texts = ["commonword otherword " + " ".join(words(12, seed=31 * n + i, vocabulary=10**6)) for i in range(n)]
        copies = [" ".join([*t.split(" ")[:-1], "changed"]) for t in texts[::10]]
        docs = spark.createDataFrame(list(enumerate(texts + copies)), DOCS)
        kept = line_dedup.dedup(docs).filter("text <> ''").count()
        assert kept == n
        counts.append(sum(verified))
        verified.clear()
    assert counts[2] <= 2.5 * counts[1] and counts[1] <= 2.5 * counts[0]


def test_lines_of_up_to_256_characters_are_aligned_by_the_least_edits(spark):
    """The same long words in another order: words at which lines are aligned do not cost a link."""
    rng, pairs = random.Random(8), []
    for i in range(200):
        w = ["".join(rng.choices("abcdefgh", k=rng.choice([3, 7]))) for _ in range(35)]
        y = list(w)
        for _ in range(3):
            at = rng.randrange(34)
            y[at], y[at + 1] = y[at + 1], y[at]
        y = [v[:2] + "z" + v[3:] if rng.random() < 0.55 else v for v in y]
        pairs.append((2 * i + 1, 2 * i, " ".join(w)[:256], " ".join(y)[:256]))
    rows = spark.createDataFrame(pairs, "a long, b long, x string, y string").cache()
    texts = rows.selectExpr("a id", "x line").union(rows.selectExpr("b", "y"))
    with common.Workspace(spark):
        got = {r["a"] for r in line_dedup.near(rows.select("a", "b"), texts, 0.8).collect()}
    want = {a for a, _, x, y in pairs if edit_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9}
    assert got == want and 0 < len(want)


@pytest.fixture(scope="module")
def copies():
    """Texts with changed copies of all degrees, many in one group, and unrelated ones."""
    rng, rows, n = random.Random(5), [], 0
    for g in range(14):
        base = words(rng.choice([6, 12, 40, 120, 300]), seed=g)
        for _ in range(60 if g == 3 else rng.randrange(1, 6)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                text[rng.randrange(len(text))] = f"changed{rng.randrange(10**6)}"
            rows.append((n, " ".join(text)))
            n += 1
    common_line = " ".join(words(9, seed=77))
    rows += [(n + i, common_line + "\n" + " ".join(words(30, seed=500 + i))) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, ""), (1003, "..."), (1009, "..."), (1004, "one two"), (1005, "One, TWO!"), (1006, "one two three"), (1007, "x" * 200_000), (1008, rows[0][1]), (1008, rows[0][1]), (None, rows[0][1])]
    return rows


def test_classes_equal_brute_force(spark, copies):
    docs = spark.createDataFrame(copies, DOCS)
    weights = near_copies.common_shingles(docs)
    shingler, features = near_copies.Shingler(), {}
    with np.errstate(over="ignore"):
        for doc_id, text in copies:
            if doc_id is not None and (w := decontaminate.words_of(text)):
                keys, counts = shingler(w)
                features[doc_id] = keys, weights(keys, counts)
    ids = sorted(features)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if near_copies.similarity(features[a], features[b]) >= 0.8]
    edges += [(a, b) for a, x in copies for b, y in copies if x and x == y and None not in (a, b)]
    want = classes_of(edges, {d for d, _ in copies if d is not None})
    rows = near_copies.classes(docs).collect()
    assert len(rows) == len(copies)
    assert {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None} == want
    assert [r["class_id"] for r in rows if r["doc_id"] is None] == [None]
    kept = [r["doc_id"] for r in near_copies.keep_one(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(want.values())) and kept.count(None) == 1


def short_pairs():
    """Texts of different lengths and copies at a similarity of 0.8 to 0.9, by length."""
    rows, n = [], 0
    for size, changed in ((8, None), (10, None), (20, None), (50, 25), (100, 50)):
        for k in range(60):
            text = words(size, seed=7919 * size + k, vocabulary=10**6)
            copy = [*text, "appended"] if changed is None else [*text[:changed], "changed", *text[changed + 1 :]]
            rows += [(n, " ".join(text)), (n + 1, " ".join(copy))]
            n += 2
    return rows


def test_short_copies_in_a_common_band_are_one_class(spark):
    rows = short_pairs()
    shingler, features = near_copies.Shingler(), []
    with np.errstate(over="ignore"):
        for _, text in rows:
            shingles, counts = shingler(decontaminate.words_of(text))
            features.append((shingles, counts.astype(float)))
        keys = near_copies.bands(near_copies.signatures_of(features)[0])
    like = [near_copies.similarity(features[i], features[i + 1]) >= 0.8 for i in range(0, len(rows), 2)]
    meet = [(keys[i] == keys[i + 1]).any() for i in range(0, len(rows), 2)]
    found = {r["doc_id"]: r["class_id"] for r in near_copies.classes(spark.createDataFrame(rows, DOCS)).collect()}
    together = [found[i] == found[i + 1] for i in range(0, len(rows), 2)]
    assert sum(like) > 200
    assert together == [a and b for a, b in zip(like, meet, strict=True)]


def test_document_frequencies_are_exact(spark):
    rows = [(i, "a b c d e f" + (" g" if i % 5 else "")) for i in range(80)] + [(100 + i, " ".join(words(20, seed=i))) for i in range(20)]
    weights = near_copies.common_shingles(spark.createDataFrame(rows, DOCS))
    assert sorted(round(float(v), 6) for v in weights.values) == sorted(round(float(0.5 + 0.5 * np.log(s) / np.log(0.5)), 6) for s in (0.8, 0.8, 0.64))


def test_frequent_shingles_weigh_less_by_idf(spark):
    """40 of 400 documents share 40 words and have 4 of their own: alike by counts, not by TF-IDF."""
    shared = words(40, seed=1, vocabulary=10**6)
    texts = [" ".join([*shared, *words(4, seed=100 + i, vocabulary=10**6)]) for i in range(40)]
    texts += [" ".join(words(60, seed=1000 + i, vocabulary=10**6)) for i in range(300)]
    texts += [t + " appended" for t in texts[40:100]]  # pairs of near copies
    bags = []
    for t in texts:
        w, bag = t.split(), {}
        for i in range(len(w) - 4):
            bag[tuple(w[i : i + 5])] = bag.get(tuple(w[i : i + 5]), 0) + 1
        bags.append(bag)
    df = {}
    for bag in bags:
        for s in bag:
            df[s] = df.get(s, 0) + 1
    n = len(texts)
    idf = {s: 0.5 + 0.5 * min(1.0, math.log(n / x) / math.log(n / max(2, n / 1000))) for s, x in df.items()}

    def like(a, b, weigh):
        both = sum(min(a[s], b[s]) * weigh(s) for s in a.keys() & b.keys())
        return both / (sum(x * weigh(s) for bag in (a, b) for s, x in bag.items()) - both)

    assert like(bags[0], bags[1], lambda s: 1) >= 0.8 > like(bags[0], bags[1], idf.get)
    edges = [(i, j) for i in range(n) for j in range(i) if bags[i].keys() & bags[j].keys() and like(bags[i], bags[j], idf.get) >= 0.8]
    found = {r["doc_id"]: r["class_id"] for r in near_copies.classes(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert len(edges) == 60 and found == classes_of(edges, range(n))


def test_small_partitions_name_no_more_shingles(spark, monkeypatch):
    """A shingle of one document in 4,000 is no candidate, however few documents a partition has."""
    made, materialize = [], near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", lambda df, tag: made.append(materialize(df, tag)) or made[-1])
    rows = [(i, " ".join(["a b c d e f"] * (i % 100 == 0) + words(12, seed=i, vocabulary=10**6))) for i in range(4_000)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = [near_copies.common_shingles(docs.repartition(parts), near_copies.BLOCK, near_copies.RARE) for parts in (4, 200)]
    assert made[1].count() <= 2 * made[0].count() < 100
    assert [len(w.keys) for w in weights] == [2, 2] and (weights[0].values == weights[1].values).all()


def test_samples_agree_as_often_as_weights_do():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    w = rng.choice([0.5, 0.8, 1.0, 2.0, 3.0], 3000)
    a, b = (keys[:2400], w[:2400]), (keys[600:], w[600:] * rng.choice([1.0, 1.0, 0.5], 2400))
    a, b = [(k[o], v[o]) for k, v in (a, b) for o in [np.argsort(k)]]
    with np.errstate(over="ignore"):
        x, y = near_copies.signatures_of([a, b])[0]
        alone = near_copies.signatures_of([b])[0][0]
    assert (alone == y).all()
    agree = (x == y).mean()
    assert agree == pytest.approx(near_copies.similarity(a, b), abs=0.12)


def test_empty_documents_table(spark):
    assert near_copies.classes(spark.createDataFrame([], DOCS)).count() == 0


# -- lines


def line_rows():
    rng = random.Random(3)
    lines = [" ".join(words(rng.choice([2, 5, 12, 30]), seed=900 + i)) for i in range(60)]
    docs = []
    for d in range(40):
        out = []
        for _ in range(rng.randrange(1, 8)):
            line = rng.choice(lines)
            if rng.random() < 0.3 and len(line) > 60:
                w = line.split()
                w[rng.randrange(len(w))] = "zebra"
                line = " ".join(w)
            out.append(line.upper() if rng.random() < 0.2 else line)
        docs.append((d, "\n".join(out)))
    return docs


def brute_lines(docs):
    plain = lambda x: re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", x.lower()).strip()
    occurrences = {}
    for d, text in docs:
        if d is not None and text is not None:
            for i, line in enumerate(text.split("\n")):
                if plain(line):
                    occurrences.setdefault(plain(line), []).append((d, i))
    keys = list(occurrences)
    pairs = [(i, j, plain(keys[i]), plain(keys[j])) for i in range(len(keys)) for j in range(i)]
    con = duckdb.connect()
    con.execute("CREATE TABLE p (i INT, j INT, a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?, ?)", pairs or [(0, 0, "", "")])
    near = con.execute("SELECT i, j FROM p WHERE levenshtein(a, b) <= floor(0.2 * greatest(length(a), length(b)) + 1e-9)").fetchall()
    root = classes_of(near, range(len(keys)))
    first = {}
    for i, k in enumerate(keys):
        first[root[i]] = min(first.get(root[i], (1 << 60, 0)), min(occurrences[k]))
    lost = {}
    for i, k in enumerate(keys):
        for o in occurrences[k]:
            if o != first[root[i]]:
                lost.setdefault(o[0], set()).add(o[1])
    return lost


def test_lines_equal_brute_force(spark):
    docs = line_rows() + [(100, None), (101, ""), (102, "\n\n---\n---"), (103, "  Same Line here \nsame line here"), (None, "same line here"), (104, "same line here!")]
    frame = spark.createDataFrame([(d, t, "s", 1) for d, t in docs], DOCS + ", drop string, n_lines int").withColumnRenamed("n_lines", "other")
    got = {r["doc_id"]: r for r in line_dedup.dedup(frame).collect()}
    lost, found = brute_lines(docs), {}
    for d, text in docs:
        if d is not None and text:
            kept, raw = got[d]["text"].split("\n") if got[d]["text"] else [], text.split("\n")
            rest = iter(raw)  # kept lines are a subsequence
            assert all(x in rest for x in kept) and got[d]["n_dropped"] == len(raw) - len(kept) or not kept
            want = "\n".join(x for i, x in enumerate(raw) if i not in lost.get(d, ()))
            found[d] = got[d]["text"] == want, got[d]["n_dropped"] - len(lost.get(d, ()))
    # no line is dropped that should stay, and nearly all that should go are
    assert all(more <= 0 for _, more in found.values())
    assert -sum(more for _, more in found.values()) <= 0.05 * sum(map(len, lost.values()))
    assert sum(same for same, _ in found.values()) >= 0.95 * len(found)
    assert got[103]["text"] == "  Same Line here " and got[104]["text"] == "" and got[None]["text"] == "same line here" and got[102]["text"] == "\n\n---\n---"


def test_a_long_line_and_its_changed_copy(spark):
    w = words(12_000, seed=4)
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join([*w[:6000], "new", *w[6001:]])), (3, " ".join(words(12_000, seed=5)))], DOCS)
    assert [r["text"] == "" for r in line_dedup.dedup(docs).orderBy("doc_id").collect()] == [False, True, False]


def kept_lines(spark, *lines):
    rows = line_dedup.dedup(spark.createDataFrame(list(enumerate(lines)), DOCS)).collect()
    return sorted(r["doc_id"] for r in rows if r["text"])


def test_characters_decide(spark):
    a = "the same twelve words as in each other line of this template "
    urls = [a + "".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=120)) for i in range(2)]
    assert kept_lines(spark, *urls) == [0, 1]


def test_long_lines_with_many_typos(spark):
    for n in (100, 130):  # 900 and 1,170 characters
        w = [x.ljust(8, "q")[:8] for x in words(n, seed=n, vocabulary=10**6)]
        assert kept_lines(spark, " ".join(w), " ".join("z" + x[1:] if i % 4 == 1 else x for i, x in enumerate(w))) == [0]


def test_lines_of_equal_normal_form_are_one_node(spark):
    assert kept_lines(spark, "a-b c", "a b c", "A\tb, c!") == [0]


def test_one_long_word_does_not_outweigh_characters(spark):
    w = words(20, seed=6)
    assert kept_lines(spark, " ".join([*w, "x" * 80]), " ".join([*w, "y" * 80])) == [0, 1]


def test_copies_in_a_crowd_that_share_two_blocks_only(spark):
    """200 unlike lines share two long words; a copy of one has all its other long words changed."""
    letters = lambda n, seed: "".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=n))
    shared = lambda i: ["commonword", "otherword", *(letters(7, 100 * i + k) for k in range(6)), *(letters(5, 100 * i + k) for k in range(6, 18))]
    lines = [" ".join(shared(i)) for i in range(200)]
    lines.append(" ".join(x[:3] + ("q" if x[3] != "q" else "z") + x[4:] if len(x) == 7 else x for x in shared(90)))
    assert kept_lines(spark, *lines) == list(range(200))


def test_recall_by_line_length(spark):
    rng, rows = random.Random(11), []
    sizes, pairs = (4, 6, 8, 10, 14, 20, 40, 120), 100
    for size in sizes:
        for _ in range(pairs):
            w = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 11))) for _ in range(size)]
            copy = list(w)
            for at in rng.sample(range(size), max(1, size // 8)):
                copy[at] = "q" + w[at][1:] + "z" if size < 8 else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=len(w[at])))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(copy))]
    like = [len(a) * 0.8 >= 0 and edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True)]
    gone = {r["doc_id"] for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect() if not r["text"]}
    assert gone <= {2 * i + 1 for i, near in enumerate(like) if near}
    for k, size in enumerate(sizes):
        own = [i for i in range(k * pairs, (k + 1) * pairs) if like[i]]
        found = sum(2 * i + 1 in gone for i in own) / len(own)
        print("recall", size, len(own), found)
        assert found >= (0.9 if size < 8 else 0.95)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_no_lines(spark):
    assert line_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


# -- benchmark


def brute_hits(items, text, window=13):
    w, hit, names = decontaminate.words_of(text), set(), set()
    for name, item in items:
        iw = decontaminate.words_of(item)
        k = min(window, len(iw))
        for a in range(len(iw) - k + 1) if iw else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == iw[a : a + k]:
                    hit.update(range(i, i + k))
                    names.add(str(name))
    return len(w), len(hit), names


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("ab c".split() + ["a"]), max_size=9), max_size=4), st.lists(st.sampled_from(["a", "ab", "c", "zz"]), max_size=40), st.integers(1, 5)
)
def test_automaton_equals_brute_force(items, doc, window):
    named = [(str(i), " ".join(x)) for i, x in enumerate(items)]
    automaton = decontaminate.SuffixAutomaton([(n, decontaminate.words_of(t)) for n, t in named if t], window)
    spans, found = automaton.scan(decontaminate.words_of(" ".join(doc)))
    n, hit, names = brute_hits([x for x in named if x[1]], " ".join(doc), window)
    assert sum(b - a for a, b in spans) == hit and {automaton.names[k] for k in found} == names
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("block_words", [10**6, 20])
def test_contamination(spark, monkeypatch, block_words):
    items = [(1, " ".join(words(30, seed=1))), (2, "Short item, here!"), (3, None), (4, "..."), (5, " ".join(words(30, seed=1)[5:])), (10, "Ünï çode x")]
    clean, passage = words(400, seed=9), words(30, seed=1)
    rows = [
        (1, " ".join(clean)), (2, " ".join(clean[:50] + passage[3:20] + clean[50:])), (3, " ".join(passage)), (4, "SHORT, item -- Here"), (5, None), (6, ""),
        (7, " ".join(clean[:9] + passage[:12] + clean[9:20])), (8, "a ünï çode x b"), (8, "a ünï çode x b"), (None, " ".join(passage)),
    ]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "blocks", lambda b, w, f=decontaminate.blocks: f(b, w, block_words))
    got = decontaminate.scan(docs, bench, with_text=True).collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        n, hit, names = brute_hits(items, text)
        r = next(r for r in got if r["doc_id"] == doc_id)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
        assert brute_hits(items, r["cleaned"])[1] == 0 or not r["spans"]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted((str(r["doc_id"]), r["cleaned"] or "") for r in got if not r["contaminated"])
    both = decontaminate.scan(docs.withColumn("spans", F.lit(1)), bench, keep=("doc_id", "spans"))
    assert both.columns.count("spans") == 1 and both.count() == len(rows)


def test_no_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    r = decontaminate.scan(docs, spark.createDataFrame([], "item_id long, text string")).first()
    assert (r["n_words"], r["n_hit"], r["contaminated"]) == (2, 0, False)


# -- common


def test_a_full_table_forgets_and_long_keys_are_not_kept():
    memo = common.Memo(len, limit=3, longest=5)
    assert list(map(memo.__getitem__, ["a", "bb", "ccc", "dddd", "toolong", "a"])) == [1, 2, 3, 4, 7, 1]
    assert len(memo) <= 3 and "toolong" not in memo


def test_workspace_deletes_all_but_the_result(spark):
    import os

    with common.Workspace(spark) as work:
        first = common.materialize(spark.range(3).toDF("id"), "gone")
        out = work.keep(first.filter("id > 0"))
        paths = list(work.paths)
    assert out.count() == 2 and paths and not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_a_broadcast_ends_with_its_workspace(spark):
    with common.Workspace(spark) as work:
        sent = work.share([1, 2])
        assert spark.range(1).rdd.map(lambda _: sent.value[1]).collect() == [2]
    with pytest.raises(Exception, match="destroyed|Broadcast"):
        spark.range(1).rdd.map(lambda _: sent.value[1]).collect()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = " ".join(words(60, seed=1))
    rows = [(1, base, "aa"), (2, base + " more", "aa"), (4, "12 34", "aa"), (5, " ".join(words(30, seed=8)), "aa"), (6, " ".join(words(50, seed=9)) + "\nshared line of text\nx", "zz"), (7, "shared line of text\n" + " ".join(words(50, seed=10)), "zz")]
    docs = spark.createDataFrame([(d, t, lang, "s", len(t)) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(words(30, seed=8)[:20]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    stage_docs = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = common.materialize(stage(spark, stage_docs, str(tmp_path)), "t")
        assert stage_docs.columns == docs.columns
        kept[name] = {r["doc_id"]: r["text"] for r in stage_docs.collect()}
    assert set(kept["language_id"]) == {1, 2, 5, 6, 7}
    assert kept["line_dedup"][2] == "" and kept["line_dedup"][7] == rows[5][1].split("\n")[1]
    assert set(kept["decontamination"]) == {1, 2, 6, 7}
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 6, 7} and all(len(r["ids"]) == r["n_tokens"] for r in out)


@pytest.mark.parametrize("name", ["line_dedup", "near_dedup", "decontamination", "sentencepiece"])
def test_a_stage_begins_without_the_garbage_of_the_one_before(spark, sf_dir, monkeypatch, name):
    """A heap that a stage made the executors take goes back to the system before the next one runs."""
    import corpus_pipeline

    stage, heap = dict(corpus_pipeline.STAGES)[name], spark._jvm.java.lang.Runtime.getRuntime()
    docs = spark.createDataFrame([(1, "a line of some words")], DOCS)
    spark._jvm.System.gc()
    least = heap.totalMemory()
    spark.range(0, 8_000_000, 1, 8).selectExpr("md5(cast(id as string)) as x").orderBy("x").select(F.max("x")).collect()
    monkeypatch.setattr(common, "release", lambda spark: None)  # the driver's, which is the executor here
    for module, call in (("line_dedup", "dedup"), ("near_copies", "keep_one"), ("decontaminate", "clean"), ("piece_codec", "encode")):
        monkeypatch.setattr(getattr(corpus_pipeline, module), call, lambda docs, *_, **__: docs)
    before = heap.totalMemory()
    stage(spark, docs, sf_dir)
    assert before > 2 * least and heap.totalMemory() < before / 2
