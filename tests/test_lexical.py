"""BM25 over a stored index with block maxima: the same lists, from fewer blocks."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import lexical


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """An index in memory, and the same one stored with blocks of 8 rows."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, i * 3, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.choice([0, 3, 10, 40, 200])))) for i in range(900)]
    df = spark.createDataFrame(rows, "chunk_id long, seq long, text string")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lexical, "DOCS", 8)
        patch.setattr(lexical, "FIRST", 4)
        built = lexical.build(df)
        return built, lexical.save(built, f"file://{tmp_path_factory.mktemp('index')}/bm25")


@pytest.mark.parametrize("listed", [2000, 3])
@pytest.mark.parametrize(("query", "k"), [("w0", 5), ("w0 w1 w39", 10), ("w35 w36 w37 W35", 7), ("w0 w1 w2 w3 w4 w5", 1), ("w39", 900), ("none w38", 20), ("none", 4)])
def test_blocks_give_the_same_list(both, monkeypatch, query, k, listed):
    built, stored = both
    for name, value in (("DOCS", 8), ("FIRST", 4), ("LISTED", listed), ("RANGES", 3)):
        monkeypatch.setattr(lexical, name, value)
    assert stored.maxima is not None
    assert lexical.top_k(stored, query, k).collect() == lexical.top_k(built, query, k).collect()


def test_bounds_hold_and_skip_blocks(both, monkeypatch):
    built, stored = both
    monkeypatch.setattr(lexical, "FIRST", 4)
    query = "w0 w1 w20"
    scored = lexical.score(built, query).join(stored.postings.select("id", "block").distinct(), "id").groupBy("block").agg(F.max("score").alias("best"))
    rows = scored.join(lexical.bounds(stored, query), "block").collect()
    assert len(rows) > 50 and all(r["best"] <= r["bound"] + 1e-9 for r in rows)
    least = lexical.top_k(built, query, 5).collect()[-1]["score"]
    assert sum(r["bound"] >= least for r in rows) < len(rows) / 2


def test_blocks_reach_the_scan(both, monkeypatch):
    _, stored = both
    for name, value in (("DOCS", 8), ("FIRST", 4)):
        monkeypatch.setattr(lexical, name, value)
    plan = lexical.best_blocks(stored, "w0 w1", 3)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(block" in plan.replace(" ", "") and "PushedFilters" in plan


def test_ranges():
    assert lexical.ranges([5, 1, 2, 9]) == [(1, 2), (5, 5), (9, 9)] and lexical.ranges([]) == []
    many = list(range(0, 1000, 2)) + [5000]
    assert len(lexical.ranges(many)) <= lexical.RANGES and lexical.ranges(many)[-1] == (5000, 5000)
    assert all(any(a <= b <= c for a, c in lexical.ranges(many)) for b in many)


def test_segments_follow_the_words(spark, tmp_path, monkeypatch):
    """A segment's words are bounded: their number grows with the table, whatever the setting of shuffles."""
    monkeypatch.setattr(lexical, "WORDS", 100)
    monkeypatch.setattr(lexical, "DOCS", 2)
    rows = spark.createDataFrame([(i, i, f"a b{i % 5} c{i} d e") for i in range(400)], "chunk_id long, seq long, text string")
    stored = lexical.save(lexical.build(rows), f"file://{tmp_path}/bm25")
    sizes = [r["count"] for r in stored.postings.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 400
