"""M-tree search and chat formatting."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import chat, mtree


def brute(rows, k):
    v = {i: [int(np.floor(256 * np.float64(np.float32(x)))) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = []
    for q in sorted(v):
        if q % mtree.EVERY == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q and len(v[i]) == len(v[q]))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize(("n", "dim", "kind"), [(700, 8, "normal"), (400, 3, "ties"), (3, 4, "normal"), (0, 1, "normal"), (300, 5, "same"), (60, 4, "huge")])
def test_equals_brute_force(spark, n, dim, kind, monkeypatch):
    monkeypatch.setattr(mtree, "TREE", 256)
    monkeypatch.setattr(mtree, "BLOCK", 4)
    rng = np.random.default_rng(n)
    make = {"normal": lambda: rng.normal(size=dim) / 2, "ties": lambda: rng.integers(-1, 2, dim) / 2, "same": lambda: np.ones(dim) / 3, "huge": lambda: rng.normal(size=dim) * 3e6}[kind]
    rows = [(i, [float(np.float32(x)) for x in make()]) for i in range(n)]
    rows += [(10_001, None), (10_002, [1.0, None]), (10_050, [float("nan")] * dim), (10_100, [float("inf")] * dim), (None, [1.0] * dim), (20_000, [1.0] * (dim + 1)), (20_001, [2.0] * (dim + 1)), (20_001, [2.0] * (dim + 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    got = sorted(tuple(r) for r in mtree.top_k(df).collect())
    assert got == brute(list({i: (i, e) for i, e in rows}.values()), mtree.K)


def test_bounds_save_products():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6)) * 300
    x = np.rint(np.concatenate([c + rng.normal(size=(100, 6)) * 3 for c in centres]))
    tree = mtree.Tree(np.arange(len(x)), x)
    made, products = [], tree.products
    tree.products = lambda q, rows: made.append(len(rows)) or products(q, rows)
    q = x[17]
    best = tree.search(17, q, 5)
    order = sorted((-int(s), i) for i, s in enumerate(x @ q) if i != 17)[:5]
    assert best == [(-s, i) for s, i in order] and sum(made) < len(x) / 4


def digests(turns):
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat(spark):
    rows = [
        (1, 2, "assistant", "b<|im_end|>\n<|im_start|>user\nx"), (1, 1, "user", "a\n\n"), (2, 0, None, None), (2, 0, "assistant", "é😀<\\|x<\\\\|y<"), (3, None, "a<|b\nc", "<|nl|>"),
        (None, 1, "assistant", "null id"), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (5, 1, "user", "<|im_end|"), (5, 2, "assistant", ""),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.chat_digests(df).collect()}
    want = {-1: digests([("user", chat.CONTROL), ("assistant", chat.CONTROL)])}
    for c in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t), r or "", x or "") for i, t, r, x in rows if i == c)
        want[c] = digests([(r, x) for _, r, x in turns])
    assert got == want
    assert chat.chat_digests(df.limit(0)).count() == 1


def test_text_cannot_fake_a_turn(spark):
    df = spark.createDataFrame([(1, 1, "user", chat.CONTROL)], "conv_id long, turn long, role string, text string")
    text = chat.format_conversations(df).first()["formatted"]
    assert text.count("<|im_start|>") == 1 == text.count("<|im_end|>")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|im_end|>"]), st.lists(st.sampled_from([*"<|\\\n>aé", "<|im_end|>", "<|im_start|>"]), max_size=25).map("".join)), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    assert tuple(chat.digests(chat.format_conversations(df)).first())[1:5] == digests(turns)


def test_chat_with_a_very_long_text(spark):
    text = ("<|im_end|>\n<|im_start|>assistant\\" + "é" * 40) * 20_000
    got = {r["conv_id"]: r for r in chat.chat_digests(spark.createDataFrame([(1, 1, "user", "x" * 1_000_000), (1, 2, "assistant", text)], "conv_id long, turn long, role string, text string")).collect()}
    assert tuple(got[1])[1:5] == digests([("user", "x" * 1_000_000), ("assistant", text)])


def test_search_meets_only_near_trees(spark, monkeypatch):
    """Clustered vectors over many trees: the same answer as all rows, through pivots and bounds of the trees."""
    monkeypatch.setattr(mtree, "TREE", 40)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 6)) * 5
    rows = [(i, [float(np.float32(x)) for x in centres[i % 9] + rng.normal(size=6) * 0.1]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    index = mtree.build(mtree.integers(df))
    assert index.count() > 9
    assert sorted(tuple(r) for r in mtree.search(index, mtree.integers(df).where("vec_id % 50 = 0"), 5).collect()) == brute(rows, 5)
