"""The extraction cache as a delta log, the pruned index, and the incremental BM25 index."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import dense, lexical, neighbours, pruned
from gleaner.schemas import EXTRACTION
from gleaner.sources import stores
from gleaner.streaming import index


def extraction(spark, **rows):
    return spark.createDataFrame([(c, [], [(v, "t", [])]) for c, v in rows.items()], EXTRACTION)


def held(spark, path):
    return {r["chunk_id"]: r["entities"][0]["name"] for r in stores.load_extractions(spark, path).collect()}


def test_only_new_rows_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    stores.save_extractions(extraction(spark, a="1", b="1"), extraction(spark, b="2"), path)
    stores.save_extractions(stores.load_extractions(spark, path), extraction(spark, c="3", a="3"), path)
    assert [spark.read.parquet(f"{path}/delta={n}").count() for n in range(3)] == [2, 1, 2]
    assert held(spark, path) == {"a": "3", "b": "2", "c": "3"}


def test_merge_writes_touched_buckets(spark, tmp_path):
    path, rng = f"file://{tmp_path}/cache", random.Random(1)
    want = {}
    for step in range(4):
        new = {f"c{i}": f"{step}" for i in rng.sample(range(400), 300 if not step else 3)}
        want |= new
        stores.save_extractions(extraction(spark), extraction(spark, **new), path) if step else stores.save_extractions(extraction(spark, **new), extraction(spark), path)
        if step != 2:
            touched = stores.compact(spark, path)
            assert (touched > 40) if not step else (0 < touched <= 6)
        assert held(spark, path) == want
    assert stores.compact(spark, path) == 0
    stores.save_extractions(extraction(spark), extraction(spark, c1="new"), path)
    assert held(spark, path) == want | {"c1": "new"}


def test_a_failure_loses_one_batch(spark, tmp_path):
    """The model fails in a batch; the next call asks only for the chunks of that batch and later ones."""
    path, log = f"file://{tmp_path}/cache", str(tmp_path / "asked")
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(60)], "chunk_id string, text string").coalesce(1)
    broken = tmp_path / "broken"
    broken.write_text("")

    def model(text):
        import os

        with open(log, "a") as f:
            f.write(text + "\n")
        if os.path.exists(str(broken)) and len(open(log).read().split("\n")) > 35:
            raise RuntimeError("no answer")
        return json.dumps({"events": [], "entities": [{"name": text, "type": "t", "aliases": []}]})

    with pytest.raises(Exception, match="no answer"):
        stores.extract_into(chunks, path, model, batch=10)
    kept = held(spark, path)
    assert 10 <= len(kept) <= 35 and all(v == f"text {c[1:]}" for c, v in kept.items())
    broken.unlink()
    before = set(open(log).read().split("\n"))
    open(log, "w").close()
    got = stores.extract_into(chunks, path, model, batch=10)
    again = open(log).read().split()[1::2]
    assert got.count() == 60 and held(spark, path) == {f"c{i}": f"text {i}" for i in range(60)}
    assert sorted(again) == sorted(str(i) for i in range(60) if f"c{i}" not in kept) and before
    open(log, "w").close()
    stores.extract_into(chunks, path, model)
    assert not open(log).read()


@pytest.mark.parametrize("cell", [4096, 20])
def test_pruned_index_equals_a_scan(spark, tmp_path, monkeypatch, cell):
    for name, value in (("CELL", cell), ("BLOCK", 5)):
        monkeypatch.setattr(neighbours, name, value)
    monkeypatch.setattr(pruned, "FIRST", 1)
    rng = np.random.default_rng(6)
    x = np.concatenate([c + 0.05 * rng.normal(size=(20, 8)) for c in rng.normal(size=(25, 8))] + [np.zeros((2, 8))])
    rows = spark.createDataFrame([(f"v{i}", i, v.tolist()) for i, v in enumerate(x)], "id string, seq long, embedding array<double>")
    found = pruned.save(rows, f"file://{tmp_path}/{cell}")
    flat = dense.normalised(rows)
    for q, k in ((x[3], 7), (-x[50], 502), (x[100] + x[300], 1), (np.zeros(8), 3)):
        got = pruned.top_k(found, q.tolist(), k)
        want = dense.inner_product_top_k(flat, q.tolist(), k).collect()
        assert [(r["id"], r["rank"], round(r["score"], 9)) for r in got.hits.orderBy("rank").collect()] == [(r["id"], r["rank"], round(r["score"], 9)) for r in want]
    got = pruned.top_k(found, x[3].tolist(), 7)
    assert got.cells == 1 if cell > 1000 else got.cells > 12 and got.read < got.cells
    assert pruned.top_k(found, x[3].tolist(), 0).hits.count() == 0


def same(spark, folder, docs):
    got, want = index.load(spark, folder), lexical.build(spark.createDataFrame([(k, s, t) for k, (s, t) in docs.items()], "chunk_id string, seq long, text string"))
    plain = lambda df, *c: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*c).collect()), key=repr)
    assert plain(got.idf, "term", "df", "idf") == plain(want.idf, "term", "df", "idf") and plain(got.totals, "n", "avgdl") == plain(want.totals, "n", "avgdl")
    assert plain(got.postings, "term", "id", "seq", "tf", "dl") == plain(want.postings, "term", "id", "seq", "tf", "dl") and plain(got.lengths, "id", "seq", "dl") == plain(want.lengths, "id", "seq", "dl")
    assert lexical.top_k(got, "w1 w2", 5).collect() == lexical.top_k(want, "w1 w2", 5).collect()


def test_batches_equal_a_rebuild(spark, tmp_path):
    folder, rng, docs, batches = f"file://{tmp_path}/index", random.Random(2), {}, []
    for n in range(3):
        rows = [(f"d{i}", 100 * n + i, rng.choice([None, "", " ".join(rng.choices([f"w{j}" for j in range(9)], k=6))]) if n else f"w{i % 5} w1 w{i % 7}") for i in rng.sample(range(30), 18)]
        batches.append(spark.createDataFrame(rows, "id string, seq long, text string"))
        index.apply_batch(folder, n, batches[-1])
        for i, s, t in rows:
            docs.pop(i, None) if t is None else docs.__setitem__(i, (s, t))
        if n != 1:
            same(spark, folder, docs)
    index.apply_batch(folder, 2, batches[2])  # a replay
    same(spark, folder, docs)
    assert index.load(spark, f"file://{tmp_path}/none").idf.count() == 0


def shuffled(spark):
    """Bytes that the session's tasks have written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    gateway = spark.sparkContext._gateway
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_batch_shuffles_neither_texts_nor_postings(spark, tmp_path):
    """Of 2,000 documents of 1,000 random words, a tenth is replaced: ids and the sums of 200 terms are shuffled."""
    folder = f"file://{tmp_path}/index"
    words = lambda seed: f"array_join(transform(sequence(1, 1000), i -> concat('w', pmod(xxhash64(id, i, {seed}), 200))), ' ')"
    batches = [spark.range(0, n, 1, 4).selectExpr("id", "id seq", f"{words(n)} text") for n in (2000, 200)]
    before = shuffled(spark)
    for n, rows in enumerate(batches):
        index.apply_batch(folder, n, rows)
    assert shuffled(spark) - before < 400_000
    whole = batches[0].where("id >= 200").unionByName(batches[1])
    counts = lambda df: {r["term"]: r["df"] for r in df.collect()}
    assert counts(index.load(spark, folder, "bigint").idf) == counts(lexical.build(whole.withColumnRenamed("id", "chunk_id")).idf)


def test_repeated_and_null_ids(spark, tmp_path):
    """Of an id's rows in a batch the last counts, also where the id is null, and a later batch replaces it."""
    folder, fields = f"file://{tmp_path}/index", "id long, seq long, text string"
    index.apply_batch(folder, 0, spark.createDataFrame([(1, 1, "w1 w1"), (1, 2, "w2 w1 w2"), (None, 3, "w3"), (2, 4, "w1"), (2, 5, None)], fields))
    held = lambda: sorted((r["term"], r["id"], r["tf"], r["dl"]) for r in index.load(spark, folder, "bigint").postings.collect())
    assert held() == [("w1", 1, 1, 3), ("w2", 1, 2, 3), ("w3", None, 1, 1)]
    index.apply_batch(folder, 1, spark.createDataFrame([(None, 6, "w4"), (None, 5, "w5"), (3, 7, "")], fields))
    index.apply_batch(folder, 1, spark.createDataFrame([(None, 6, "w4"), (None, 5, "w5"), (3, 7, "")], fields))
    assert held() == [("w1", 1, 1, 3), ("w2", 1, 2, 3), ("w4", None, 1, 1)]
    found = index.load(spark, folder, "bigint")
    assert {r["term"]: r["df"] for r in found.idf.collect()} == {"w1": 1, "w2": 1, "w4": 1} and found.rows == found.lengths.count() == 3
