"""Numbering in two phases, digests, tables that follow their files, and the order of seeds."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner import storage
from gleaner.functions import text
from gleaner.operators import numbering
from gleaner.plans import catalog, engine
from gleaner.sources import stores


@pytest.mark.parametrize("n", [0, 1, 999])
def test_places_follow_the_order(spark, n):
    rows = [(random.Random(i).randrange(50), i) for i in range(n)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    got = numbering.numbered(df, F.desc("a"), "b", name="at").collect()
    assert {(r["a"], r["b"]): r["at"] for r in got} == {k: i for i, k in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}


def test_no_window_over_the_table(spark):
    """The only window without a partition is over the partitions' counts."""
    plan = numbering.numbered(spark.range(1000).repartition(5), "id")._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert plan.count("Window [") == 1 and "Aggregate [" in window


def test_fingerprint_is_of_ids_in_order(spark):
    one = spark.createDataFrame([(f"c{i}", i * 3) for i in range(100)], "chunk_id string, seq long")
    same, moved, fewer = one.withColumn("seq", F.col("seq") * 7).repartition(5), one.withColumn("seq", -F.col("seq")), one.where("seq > 0")
    assert stores.fingerprint(one) == stores.fingerprint(same) != stores.fingerprint(moved) and stores.fingerprint(fewer) != stores.fingerprint(one)


def test_seeds_keep_their_order_past_65536_documents(spark):
    """A found chunk of position 0 comes before one of position 1, however large its seq."""
    found = spark.createDataFrame([("far", (0, 70_000 << 32)), ("near", (1, 5)), ("seed", (0, 1))], "chunk_id string, ord struct<pos:int, seq:long>")
    seeds = spark.createDataFrame([("seed", 1)], "chunk_id string, ord long")
    assert [r["chunk_id"] for r in engine.joined_seeds(seeds, found).orderBy("ord").collect()] == ["seed", "far", "near"]


def test_session_tables_follow_their_files(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, "old words")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    assert {r["term"] for r in catalog.bm25_idf(spark, folder).collect()} == {"old", "words"}
    spark.createDataFrame([(1, "new words")], "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert {r["term"] for r in catalog.bm25_idf(spark, folder).collect()} == {"new", "words"}


def test_state_of_many_files(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    spark.range(10).repartition(3).write.parquet(path)
    monkeypatch.setattr(storage, "LISTED", 1)
    was = storage.state(spark, path)
    assert was == storage.state(spark, path)
    spark.range(11).write.mode("append").parquet(path)
    assert was != storage.state(spark, path)


def test_every_letter_folds(spark):
    """Of all characters whose lower case is the same here and there, case folding is Python's."""
    letters = [c for c in map(chr, range(0x20, 0x1E944)) if c.isalpha() and c.casefold() != c]
    rows = spark.createDataFrame([(c,) for c in letters], "c string").select("c", F.lower("c").alias("low"), text.folded(F.col("c")).alias("f")).collect()
    wrong = [r["c"] for r in rows if r["low"] == r["c"].lower() and r["f"] != r["c"].casefold()]
    assert not wrong and sum(r["low"] == r["c"].lower() for r in rows) > 0.98 * len(rows)
