"""Near-dedup against all pairs, and its parts against their definitions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.llm import minhash, shared
from gleaner.llm.arrow_text import Words, shingle_sets

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected(rows):
    sets = {i: set_of(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    rows, n = [(0, ""), (1, None), (2, " \t\n "), (3, "one Two"), (4, "ONE two"), (5, "two one"), (6, "a b c"), (7, "İstanbul x y z w")], 8
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(8, 120))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(copy)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(random.Random(seed))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"component_id": F.lit(1), "p1": F.lit("x"), "registers": F.lit(0)})
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    want = expected(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_repeats_and_null_ids(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (5, text), (None, text), (9, text), (None, None), (7, None)]
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 3, 5, True), (5, 3, 5, True), (None, 3, None, True), (9, 3, 5, False), (None, 0, None, True), (7, 0, 7, True)], key=str)
    kept = minhash.keep_one(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string"))
    assert kept.columns == ["doc_id", "text", "source"]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([5, None, None, 7], key=str)


def test_narrow_ids_and_a_large_group(spark):
    """Ids of another integer type, and a chain of near copies that no one head links."""
    base = [f"w{i}" for i in range(60)]
    rows = [(1000 - k, " ".join(base[:k % 7] + [f"x{k}_{j}" for j in range(1)] + base[k % 7 + 1 :])) for k in range(40)]
    rows += [(k, " ".join([f"c{j}" for j in range(k, k + 60)])) for k in range(0, 600, 3)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {i: c for i, (_, c) in expected(rows).items()}


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text(spark):
    text = "word " * 3 + "x" * 300_000 + " " + " ".join(map(str, range(30_000)))
    rows = [(1, text), (2, text + " tail"), (3, text.upper())]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_words_equal_the_pattern():
    texts = ["", None, "a", " A b\x0bc ", "é x y", "x" * 5000, "\n\n", "B b"]
    w, rows = Words().of(pa.array(texts))
    assert np.diff(rows).tolist() == [len(words_of(t)) for t in texts]
    assert len(set(w.tolist())) == len({x for t in texts for x in words_of(t)})
    assert [len(s) for s in shingle_sets(w, rows)] == [len(set_of(t)) for t in texts]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.75, 0.9):
        both = rng.integers(0, 2**63, 4000).astype(np.uint64)
        n = int(2000 * (1 - share) / (1 + share) * 2)
        a, b = np.unique(np.append(both[:2000], both[2000 : 2000 + n // 2])), np.unique(np.append(both[:2000], both[3000 : 3000 + n // 2]))
        r = minhash.sketch([a, b, np.unique(np.append(a, b))])
        assert (np.maximum(r[0], r[1]) == r[2]).all()  # registers of a union are register maxima
        assert abs((r[0] == r[1]).mean() - 2000 / (2000 + n)) < 0.17
        keep = minhash.plausible(r[:1], r[1:2], np.array([len(a)]), np.array([len(b)]))[0]
        assert keep or share < 0.7


def test_bands_miss_few_links():
    where, rng, missed, n = minhash.band_registers(), np.random.default_rng(3), 0, 400_000
    for _ in range(n // 20_000):
        agree = rng.random((20_000, minhash.M), np.float32) < 0.75
        missed += int((~agree[:, where].all(2).any(1)).sum())
    assert missed <= 12  # 2 expected at 5.2 in 10**6
    assert len(np.unique(where)) == where.size and (1 - 0.75**minhash.R) ** minhash.BANDS < 1e-5


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(2, 3), (3, 4), (9, 4), (7, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(50, 51)]])
def test_components(spark, edges):
    got = {r["id"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}
    for a, b in edges:
        top.setdefault(a, {a}), top.setdefault(b, {b})
        union = top[a] | top[b]
        for i in union:
            top[i] = union
    assert got == {i: min(s) for i, s in top.items()}


def test_rows_without_id_are_not_shuffled(spark):
    """A third of the rows have no id: all stay, and no exchange of the plan deals them out by their id."""
    rows = [(i if i % 3 else None, f"w{i} " * 9 if i % 3 else "same text of several words here", "x") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(6)
    kept = minhash.keep_one(docs)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(rows, key=repr)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "isnull(doc_id" in plan and plan.index("Union") < plan.index("Window")


def test_words_of_regular_patterns_have_different_hashes():
    """Sums of powers modulo 2**64 give the two patterns below one hash for any odd base."""
    flip = str.maketrans("ab", "ba")
    pattern = "a"
    while len(pattern) < 4096:
        pattern += pattern.translate(flip)
    for n in (1024, 2048, 4096):
        x, y = pattern[:n], pattern[:n].translate(flip)
        h, rows = Words().of(pa.array([x, y, x.upper(), "w " + y]))
        assert h[0] == h[2] and h[1] == h[4] and h[0] != h[1]
        assert rows.tolist() == [0, 1, 2, 3, 5]


def test_word_hashes_are_equal_for_equal_words_only():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab\0é" if n % 2 else "ab") for _ in range(n)) for n in range(1, 60) for _ in range(40)]
    words += ["a" * n for n in range(1, 60)] + ["abcdefgh12345678", "12345678abcdefgh", "\0" * 8, "\0" * 9]
    rng.shuffle(words)
    hashes, rows = Words(lower=False).of(pa.array([" ".join(words), None, "", *words[:50]]))
    assert rows[1:4].tolist() == [len(words)] * 3
    seen = {}
    for w, h in zip(words + words[:50], hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert not len(Words().of(pa.array(["", None, " "]))[0])


def test_documents_of_pattern_words_are_not_taken_for_copies(spark):
    pattern = "a"
    while len(pattern) < 1024:
        pattern += pattern.translate(str.maketrans("ab", "ba"))
    x, y = pattern, pattern.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, " ".join([x] * 3 + [y] * 4)), (2, " ".join([y] * 3 + [x] * 4)), (3, f"{x} {y}"), (4, f"{y} {x}"), (5, f"{x.upper()} {y}")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == expected([(r["doc_id"], r["text"]) for r in docs.collect()])
