"""Token shards and counts against the library on whole texts."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import tokenbits, tokencounts
from gleaner.llm.queries import tokenizer_path

TEXTS = [
    (3, "Hello, World! it's 10.5% <|endoftext|> done."), (1, None), (2, ""), (7, "É é ǅ  x y\tz\r\n'll I'LL"), (5, "a" * 3000 + " b.,., c.d e., ,f İx ΑΣ ΣΑΣ."),
    (None, "no id"), (9, "x́ ́y ñ ñ"), (8, "Hello, World! it's"), (8, "Hello, World! it's"),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_round_trip(spark, library):
    df = spark.createDataFrame([(*r, 4) for r in TEXTS], "doc_id long, text string, start int")
    got = sorted((tuple(r) for r in tokenbits.token_output(df, tokenizer_path()).collect()), key=lambda r: r[1])
    rows, start = [], 0
    for i, text in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library(text), 1]
        rows.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == rows


def test_empty(spark):
    assert tokenbits.token_output(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abZé.,'|<> \t\n 9ßΣİ́")), max_size=30), min_size=1, max_size=4))
def test_words_equal_whole_texts(library, texts):
    import pyarrow as pa

    encoder = test_words_equal_whole_texts.__dict__.setdefault("encoder", tokenbits.WordEncoder(tokenizer_path()))
    ids, lens = encoder.encode(pa.array(texts, pa.string()), 1)
    assert ids.tolist() == [i for t in texts for i in [*library(t), 1]]
    assert encoder.counts(pa.array(texts, pa.string())).tolist() == [n - 1 for n in lens.tolist()]


@pytest.mark.parametrize("text", ["a <|ENDOFTEXT|> b", "a <|endoftext|> B", "X<|StartOfText|>y. <|startoftext|>Z, <|EndOfText|>.", "<|EndOf Text|> A", "J\u030cx J\u0323\u030c", "H\u0331 T\u0308 W\u030a Y\u030a A.", "I\u0307 K\u0331 <|ENDOFTEXT"])
def test_case_is_kept_where_it_counts(library, text):
    import pyarrow as pa

    encoder = test_words_equal_whole_texts.__dict__.setdefault("encoder", tokenbits.WordEncoder(tokenizer_path()))
    texts = ["Plain Words.", text, text.lower(), text.upper(), None]
    ids, lens = encoder.encode(pa.array(texts, pa.string()), 1)
    assert ids.tolist() == [i for t in texts for i in [*library(t), 1]]
    assert encoder.counts(pa.array(texts, pa.string())).tolist() == [n - 1 for n in lens.tolist()]


@pytest.mark.parametrize("width", [1, 3, 8, 15, 16, 17, 31])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1001).astype(np.uint32)
    data = tokenbits.pack(ids, width)
    assert len(data) == -(-1001 * width // 8) and (tokenbits.unpack(data, 1001, width) == ids).all()
    assert tokenbits.width_of(2**width) == width


def test_random_access(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    writer = tokenbits.ShardWriter(f"file://{tmp_path}", 0, 15)
    docs = [rng.integers(0, 2**15, n).astype(np.uint32) for n in (1, 5000, 0, 4096, 70_000, 3)]
    for i, d in enumerate(docs):
        writer.add(pa.array([i]), d, np.array([len(d)]))
    shard = tokenbits.Shard(f"file://{tmp_path}", writer.close()[0])
    assert all((shard.document(i) == d).all() for i, d in enumerate(docs))
    assert [(n, c) for _, n, c, _ in shard.digests()] == [(len(d), zlib.crc32(d.astype("<u4").tobytes())) for d in docs]
    (tmp_path / "bad.bits").write_bytes(b"x" * 40)
    with pytest.raises(ValueError):
        tokenbits.Shard(f"file://{tmp_path}", f"{tmp_path}/bad.bits")


def changes(spark, rows):
    return spark.createDataFrame(rows, "seq long, op string, doc_id long, source string, lang string, text string")


def test_rollup(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, f"file://{tmp_path}/r", {tokencounts.WORDS: ""})
    totals = lambda: {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    assert totals() == {}
    first = changes(spark, [(0, "insert", 1, "a", "en", "x y"), (0, "insert", 2, "a", "en", "x"), (0, "insert", 3, None, "en", None), (0, "insert", None, "b", None, "p q r")])
    assert rollup.commit("one", first) and not rollup.commit("one", first)
    assert totals() == {("a", "en"): (2, 3), (None, "en"): (1, 0), ("b", None): (1, 3)}
    second = changes(spark, [(1, "delete", 2, None, None, None), (1, "revise", 1, "b", None, "x y z z"), (2, "delete", 77, "a", "en", "x"), (3, "insert", 4, "a", "en", "t"), (4, "delete", 4, "a", "en", None)])
    rollup.commit("two", second)
    assert totals() == {(None, "en"): (1, 0), ("b", None): (2, 7)}
    rollup.commit("three", changes(spark, [(9, "insert", 2, "a", "en", "back again")]))
    assert totals()[("a", "en")] == (1, 2) and rollup.batches() == ["one", "two", "three"]
    # what has no commit does not count, nor does a commit without text
    spark.range(1).write.parquet(f"file://{tmp_path}/r/data/lost/delta")
    (tmp_path / "r" / "commits" / "000000000003").touch()
    assert totals()[("a", "en")] == (1, 2)
    assert rollup.commit("four", changes(spark, [(1, "delete", 2, None, None, None)])) and ("a", "en") not in totals()
    before = totals()
    assert rollup.compact() and totals() == before and rollup.batches() == ["one", "two", "three", "four"] and not rollup.commit("two", second)
    rollup.commit("five", changes(spark, [(1, "delete", 1, None, None, None), (1, "insert", 2, "a", "en", "x y")]))
    assert totals() == {(None, "en"): (1, 0), ("b", None): (1, 3), ("a", "en"): (1, 2)}
    assert not rollup._claim(0, "six", "x", None)  # a number is given once


def test_rollup_of_odd_tables(spark, tmp_path):
    """Empty tables, clashing columns, very long texts, and a query whose end totals are a recount."""
    tokenizers = {tokencounts.WORDS: ""}
    table = spark.createDataFrame([(i, "w " * (i if i < 200 else 300_000), "s", "l", "x", 9, True) for i in range(202)] + [(None, "a b", None, None, "x", 9, True)] * 3, "doc_id int, text string, source string, lang string, tokenizer string, n_tokens int, live boolean")
    got = tokencounts.token_totals(table, tokenizers).collect()
    assert sorted((r["source"], r["n_docs"], r["n_tokens"]) for r in got if r["source"]) == [("s", 202, sum(range(200)) + 600_000)]
    assert [(r["n_docs"], r["n_tokens"]) for r in got if not r["source"]] == [(3, 6)]
    assert tokencounts.token_totals(table.limit(0), tokenizers).count() == 0


def test_counts_equal_the_library(spark, library):
    df = spark.createDataFrame([(i, t, "s", None) for i, t in TEXTS], "doc_id long, text string, source string, lang string")
    got = {r["tokenizer"]: (r["n_docs"], r["n_tokens"]) for r in tokencounts.token_totals(df, {"bpe": tokenizer_path(), tokencounts.WORDS: ""}).collect()}
    distinct = [(i, t) for k, (i, t) in enumerate(TEXTS) if (i, t) not in TEXTS[:k]]
    import re

    assert got == {"bpe": (len(distinct), sum(len(library(t)) for _, t in distinct)), tokencounts.WORDS: (len(distinct), sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in distinct))}
