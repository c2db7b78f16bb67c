"""SentencePiece ids, token files and archives: held against the libraries and round trips."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import archive, chat, piece_codec, queries, token_store

TEXTS = [
    None, "", " ", "  a  b ", "a\nb\n\n c", "▁ ▁▁x", "tab\there\r\n", "naïve Über ÑANDÚ ß", "日本語 と english", "😀 emoji🙂", "it's WE'LL 12½ <|endoftext|> x",
    "<s>hi</s> <0x41> [INST]", "a\x00b\x01c", "x" * 5000, "word " * 3000, "é combining", " nb sp em", "İstanbul ΑΣ Σ", "same", "same", "''s '' ' -- ¿?",
]


def frame(spark, texts=TEXTS, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))


def test_pieces_equal_the_library(spark, pieces):
    got = {r["doc_id"]: r for r in piece_codec.encode(frame(spark), queries.vocabulary("piece_bpe_32k.model"), with_ids=True).collect()}
    for i, text in enumerate(TEXTS):
        ids = pieces.encode(text or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(pieces.decode(ids).encode()).hexdigest()


def test_the_ids_of_the_text_are_decoded():
    table = piece_codec.ChunkTable(queries.vocabulary("piece_bpe_32k.model"))
    assert table.encode("one two three")[1] == "one two three"
    for chunk in list(table.table):
        table.table[chunk] = table.table[chunk] * 2  # as if ids were joined wrongly
    assert table.encode("one two three")[1] != "one two three"


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n▁ab.,é日😀\t\x00<>0x"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_chunks_equal_the_library(text):
    table = test_chunks_equal_the_library.__dict__.setdefault("table", piece_codec.ChunkTable(queries.vocabulary("piece_bpe_32k.model"), limit=50))
    coded, decoded = table.encode(text)
    ids = table.sp.encode(text)
    assert coded == b"".join(b"%d," % i for i in ids) and decoded == table.sp.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" '\nstrevmldAZé½²ª×ß .,-¿\t"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_equal_the_library(text):
    encoder = test_words_equal_the_library.__dict__.setdefault("encoder", token_store.WordEncoder(queries.vocabulary("word_bpe_49k.json"), limit=50))
    assert encoder.wordwise
    assert encoder.encode(text) == encoder._library(text)


def test_token_files(spark, words, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", 50)
    docs = frame(spark).unionByName(spark.createDataFrame([(3, "again"), (None, "no id")], "doc_id long, text string"))
    path = str(tmp_path / "tokens")
    token_store.write(docs, queries.vocabulary("word_bpe_49k.json"), path)
    got = sorted((r.asDict() for r in token_store.read(spark, path, with_ids=True).collect()), key=lambda r: r["start"])
    rows = sorted([(i, t or "") for i, t in enumerate(TEXTS)] + [(3, "again"), (None, "no id")], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = [*words.encode(text, add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (doc_id, at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_no_documents_no_tokens(spark, tmp_path):
    path = str(tmp_path / "none")
    token_store.write(frame(spark, []), queries.vocabulary("word_bpe_49k.json"), path)
    assert token_store.read(spark, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70000), st.integers(0, 2**32 - 1)), max_size=1500))
def test_any_token_is_addressable(ids):
    codes = token_store.Codes(token_store.pack(np.array(ids, np.uint32)))
    assert codes.all().tolist() == ids and len(codes) == len(ids)
    for i in range(0, len(ids), 7):
        assert codes[i] == ids[i]


PAGES = [
    (1, "http://a", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "http://d\r\nX: y", ""), (5, "http://e", "line\r\n\r\nWARC/1.1\r\nend\r\n\r\n"),
    (6, "http://f", "é日😀" * 50), (7, "http://g", "\n"), (8, "http://h", "\r\n"), (9, "http://i", "a\r"), (None, "http://j", "<p>one</p>"), (10, "http://k", "x" * 1000),
]


@pytest.mark.parametrize("chunk", [archive.CHUNK, 7])
def test_archives(spark, tmp_path, chunk):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in archive.round_trip(pages, str(tmp_path / f"w{chunk}"), chunk).collect()}
    assert len(got) == len(PAGES)
    last = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            last[html or ""] = max(last.get(html or "", 0), page_id)
    for page_id, _, html in PAGES:
        payload, r = (html or "").encode(), got[page_id]
        first = last[html or ""]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page_id == first else ("revisit", first))


def test_chunk_rows_carry_running_digests(spark, tmp_path):
    pages = spark.createDataFrame([(10, "http://k", "abc" * 100)], "page_id long, url string, html string")
    path = str(tmp_path / "c")
    archive.write(pages, path, chunk=64)
    rows = sorted(archive.read(spark, path, chunk=64).collect(), key=lambda r: r["chunk_no"])
    assert b"".join(r["payload"] for r in rows) == b"abc" * 100 and max(len(r["payload"]) for r in rows) <= 64
    assert [r["last"] for r in rows] == [False] * (len(rows) - 1) + [True]
    assert rows[-1]["payload_bytes"] == 300


def test_repeated_pages_of_many_chunks_stay_whole(spark, tmp_path):
    """Copies of one page, all responses, and others between them, dealt over partitions."""
    long = "".join(chr(97 + i % 26) + ("é" if i % 50 == 0 else "") for i in range(40_000))
    rows = [(9, "http://same", long)] * 5 + [(i, f"http://{i}", f"{i}" + long[: 3000 * i]) for i in range(1, 9)] + [(3, None, long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    path = str(tmp_path / "many")
    archive.write(pages, path, chunk=100)
    table = archive.read(spark, path, chunk=100).collect()  # each digest is held against the payload as it is read
    ends = [r for r in table if r["last"]]
    assert len(ends) == len(rows) and max(len(r["payload"]) for r in table) <= 100
    for r in ends:
        text = next(t for i, _, t in rows if i == r["page_id"] and (i != 3 or (r["record_type"] == "revisit") == (t is long)))
        assert r["payload_bytes"] == len(text.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
    assert {(r["page_id"], r["refers_to"]) for r in ends if r["record_type"] == "revisit"} == {(3, 9)}
    assert sum(r["record_type"] == "revisit" for r in ends) == 1


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive.round_trip(pages, str(tmp_path / "e")).count() == 0


def test_archives_are_plain_warc(spark, tmp_path):
    import glob
    import gzip

    pages = spark.createDataFrame([(1, "http://a", "hello")], "page_id long, url string, html string").coalesce(1)
    archive.write(pages, str(tmp_path / "p"))
    data = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "p/*.gz")))
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    assert lines[0] == b"WARC/1.1" and b"WARC-Type: response" in lines and rest.endswith(b"\r\n\r\nhello\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in lines if x.startswith(b"Content-Length"))
    assert size == len(rest) - 4


def test_a_role_with_a_line_feed_comes_back(spark):
    turns = spark.createDataFrame([(1, 0, "a\nb", "c\nd")], "conv_id long, turn long, role string, text string")
    said = chat.format_paths(chat.trees(turns)).first()["formatted"]
    assert chat.parse(said) == [("a\nb", "c\nd")]


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (2, 1, "assistant", None), (2, 0, "user", "a\\b \\<| <|"), (3, 0, None, "[INST]"), (3, 0, "assistant", "</s>"),
    (None, 0, "user", "lost"), (4, None, "system", "first"), (4, 0, "user", "second"), (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "a\nb<|im_end|>", ""), (7, 3, "assistant", "é😀" * 10),
]


def expected(rows):
    groups = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        groups.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return groups


def test_conversations_come_back(spark):
    got = {r["conv_id"]: r for r in chat.round_trip(spark, spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")).collect()}
    want = expected(TURNS)
    assert set(got) == set(want)
    for k, turns in want.items():
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        masked = "".join(text for role, text in turns if role == "assistant")
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(masked), hashlib.sha256(masked.encode()).hexdigest())


def test_no_conversations(spark):
    assert chat.round_trip(spark, spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_branches_are_ranked_by_score(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.5), (1, 4, 3, "user", "more", 0.0), (1, 5, 4, "assistant", "end", 0.2),
        (2, 7, 99, "user", "orphan", None), (3, 1, 2, "user", "round", 1.0), (3, 2, 1, "user", "and round", 1.0), (4, 1, None, "user", "tie", 0.0), (4, 2, 1, "assistant", "a", 1.0), (4, 3, 1, "assistant", "b", 1.0),
    ]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    best = {r["tree"]: [t for _, t in chat.parse(r["formatted"])] for r in chat.format_paths(nodes, 1).collect()}
    assert best == {1: ["q", "good", "more", "end"], 2: ["orphan"], 4: ["tie", "a"]}
    every = chat.format_paths(nodes, None).collect()
    assert sorted((r["tree"], r["rank"]) for r in every) == [(1, 1), (1, 2), (2, 1), (4, 1), (4, 2)]
    assert [t for _, t in chat.parse(next(r["formatted"] for r in every if r["tree"] == 1 and r["rank"] == 2))] == ["q", "bad"]


def test_long_chain(spark):
    turns = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(301)]
    r = chat.round_trip(spark, spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).first()
    assert r["n_turns"] == 301 and r["loss_chars"] == sum(len(f"t{i}") for i in range(1, 301, 2))
