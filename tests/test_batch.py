"""Batch retrieval: many queries in one plan give what each gives alone."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import batch, dense, fusion, lexical
from gleaner.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["Đất", "é"]
    texts = [(f"d{i}", 7 * i, " ".join(rng.choices(words, k=rng.choice([0, 2, 9, 30])))) for i in range(150)]
    chunks = spark.createDataFrame(texts, "chunk_id string, seq long, text string")
    x = np.random.default_rng(1).normal(size=(150, 6)).round(1)
    x[3] = 0
    vectors = spark.createDataFrame([(f"d{i}", 7 * i, v.tolist()) for i, v in enumerate(x)], "id string, seq long, embedding array<double>").cache()
    queries = [(i, " ".join(rng.choices([*words, "none"], k=i % 6)), [float(j) for j in rng.choices(range(-3, 4), k=6)] if i % 4 else None) for i in range(40)]
    return lexical.build(chunks), vectors, queries


@pytest.mark.parametrize(("rows", "chunk", "sent"), [(4096, 1024, 16), (20, 7, 16), (20, 7, 2)])
def test_equals_single_queries(spark, tables, monkeypatch, rows, chunk, sent):
    index, vectors, queries = tables
    for name, value in (("ROWS", rows), ("QUERIES", chunk), ("SENT", sent)):
        monkeypatch.setattr(batch, name, value)
    asked = spark.createDataFrame(queries, "query_id long, text string, vector array<double>")
    postings, blocks = batch.packed_postings(index), batch.packed_vectors(vectors)
    words = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 7)) for r in batch.lexical_top_k(postings, index, asked, 9).collect()}
    near = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in batch.cosine_top_k(blocks, asked, 9).collect()}
    for q, text, vector in queries[::7]:
        assert {k: v for k, v in words.items() if k[0] == q} == {(q, r["rank"]): (r["id"], round(r["score"], 7)) for r in lexical.top_k(index, text, 9).collect()}
        if vector:
            assert {k: v for k, v in near.items() if k[0] == q} == {(q, r["rank"]): (r["id"], r["score"]) for r in dense.top_k(vectors, vector, 9).collect()}
    assert {q for q, _ in near} == {q for q, _, v in queries if v} and {q for q, _ in words} == {q for q, t, _ in queries if t}


def test_hybrid_and_rerank(spark, tables):
    index, vectors, queries = tables
    asked = spark.createDataFrame(queries, "query_id long, text string, vector array<double>")
    got = batch.hybrid(batch.packed_postings(index), index, batch.packed_vectors(vectors), asked, 4, 10)
    texts = spark.createDataFrame([(f"d{i}", f"w{i % 30} w1 w2") for i in range(150)], "id string, text string")
    again = batch.rerank_lexical(asked, got, texts, 2).collect()
    rows = got.collect()
    for q, text, vector in [queries[9], queries[23]]:
        alone = fusion.hybrid(index, vectors, text, vector, 4, 10)
        assert [(r["rank"], r["id"]) for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])] == [(r["rank"], r["id"]) for r in alone.orderBy("rank").collect()]
        best = fusion.rerank_lexical(text, alone.select("id", "seq").join(texts, "id"), 2)
        assert [(r["rank"], r["id"]) for r in sorted((r for r in again if r["query_id"] == q), key=lambda r: r["rank"])] == [(r["rank"], r["id"]) for r in best.orderBy("rank").collect()]


def test_no_queries(spark, tables):
    index, vectors, _ = tables
    none = spark.createDataFrame([], "query_id long, text string, vector array<double>")
    assert batch.hybrid(batch.packed_postings(index), index, batch.packed_vectors(vectors), none).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_a_thousand_queries_equal_sql(spark):
    """The first words of a thousand documents as queries, in one plan, against SQL."""
    import duckdb

    docs = catalog.texts(spark, SF)
    asked = docs.select(F.col("chunk_id").alias("query_id"), F.substring("text", 1, 60).alias("text"))
    index = catalog.index(spark, SF)
    got = batch.lexical_top_k(batch.packed_postings(index), index, asked, 5).select("query_id", "id", "rank").collect()
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    sql = rf"""with {catalog.TOKENS}, q as (select doc_id as query_id, unnest(regexp_extract_all(lower(substr(text, 1, 60)), '[\p{{L}}\p{{N}}_]+')) as term from documents),
        w as (select query_id, term, count(*) as times from q group by all),
        s as (select query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s from w join idf using (term) join tf using (term) join dl using (doc_id), tot group by all),
        r as (select a.query_id, d.doc_id, row_number() over (partition by a.query_id order by round(coalesce(s, 0), 12) desc, d.doc_id) as rank from (select distinct query_id from w) a cross join documents d left join s on s.query_id = a.query_id and s.doc_id = d.doc_id)
        select query_id, doc_id, rank from r where rank <= 5"""
    assert sorted(map(tuple, got)) == sorted(duck.execute(sql).fetchall()) and len(got) > 4500


def test_texts_are_packed_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Blocks are written where texts are read, their statistics are those of the index, and chunks never multiply the blocks."""
    monkeypatch.setattr(batch, "WORDS", 30)
    rows = spark.createDataFrame([(i, i, " ".join(["a"] * (i % 3) + [f"w{i % 7}", "é", "a"][: i % 4])) for i in range(60)], "chunk_id long, seq long, text string")
    index = lexical.build(rows)
    blocks = batch.packed_tokens(index.tokens)
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and blocks.count() > 3 and blocks.agg(F.max(F.size("ids"))).first()[0] < 40
    held = batch.save(index.tokens, f"file://{tmp_path}/packed")
    assert sorted((r["term"], r["df"], round(r["idf"], 12)) for r in held.idf.collect()) == sorted((r["term"], r["df"], round(r["idf"], 12)) for r in index.idf.collect())
    assert held.totals.first() == index.totals.first()
    monkeypatch.setattr(batch, "SENT", 1)
    monkeypatch.setattr(batch, "QUERIES", 2)
    asked = spark.createDataFrame([(i, f"w{i} a") for i in range(7)], "query_id long, text string")
    found = batch.lexical_top_k(held.blocks, held, asked, 5)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r["query_id"], r["rank"], r["id"]) for r in found.collect()]
    assert sorted(got) == [(q, r["rank"], r["id"]) for q in range(7) for r in lexical.top_k(index, f"w{q} a", 5).orderBy("rank").collect()]


def test_no_block_is_copied_for_a_chunk(spark, tables, tmp_path, monkeypatch):
    """What meets is a row a block, with all chunks in each task's first row; a scan holds a row group, which is one block."""
    import glob

    import pyarrow.parquet as pq

    for name, value in (("WORDS", 100), ("QUERIES", 7), ("SENT", 3)):
        monkeypatch.setattr(batch, name, value)
    index, _, queries = tables
    held = batch.save(index.tokens, f"file://{tmp_path}/packed")
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/packed/blocks/*.parquet")]
    blocks = held.blocks.count()
    assert blocks > 3 * len(files) and all(f.num_row_groups == f.num_rows for f in files)
    fed, frame = [], type(held.blocks)
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema: fed.append(self) or run(self, f, schema))
    asked = spark.createDataFrame(queries, "query_id long, text string, vector array<double>")
    got = batch.lexical_top_k(held.blocks, held, asked, 9)
    assert len(fed) > 1 and [f.count() for f in fed] == [blocks] * len(fed)  # a pass each
    sent = fed[0].withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum(F.col("asked").isNotNull().cast("int")).alias("n")).collect()
    assert len(sent) > 1 and {r["n"] for r in sent} == {1}
    text = queries[9][1]
    assert [r["id"] for r in got.where("query_id = 9").orderBy("rank").collect()] == [r["id"] for r in lexical.top_k(index, text, 9).orderBy("rank").collect()]


def test_hybrid_in_passes_with_small_batches(spark, tables, monkeypatch):
    """Blocks of words and of vectors go to Python in small batches, pass by pass; what is found is the same."""
    index, vectors, queries = tables
    asked = spark.createDataFrame(queries, "query_id long, text string, vector array<double>")
    found = lambda: sorted(map(tuple, batch.hybrid(batch.packed_postings(index), index, batch.packed_vectors(vectors), asked, 4, 10).select("query_id", "rank", "id").collect()))
    once, key = found(), "spark.sql.execution.arrow.maxBytesPerBatch"
    for name, value in (("ROWS", 20), ("QUERIES", 7), ("SENT", 3)):
        monkeypatch.setattr(batch, name, value)
    before, met, frame = spark.conf.get(key), [], type(asked)
    run = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema: met.append((set(self.columns), spark.conf.get(key))) or run(self, f, schema))
    assert found() == once and spark.conf.get(key) == before
    words, near = ([size for columns, size in met if name in columns] for name in ("docs", "x"))
    assert len(words) > 1 and len(near) > 1 and {*words, *near} == {"8m"}
