"""Retrieval for many queries at once: BM25 and cosine lists by query_id, fused and reranked.

The corpus is packed into blocks of bounded size, postings of some thousand rows by term or a matrix of
vectors, each a row of a written table and a row group of its own, so a scan holds one.  Texts are packed
where they are read, without a shuffle.
Queries are packed into chunks of bounded size, and SENT of them are broadcast in a pass over the blocks.
A task gets the chunks once, with its first block, so no block is copied for a chunk.  It takes blocks one after
another, scores the queries against a block by array operations, and keeps each query's k best so far;
only these leave the task, and a window merges the tasks' lists, whose number a query is that of tasks,
not of blocks.  No pair of a query and a row is ever a row of a table.  Passes run one after another, each
written as it ends, with Arrow batches of a block or two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import scores
from gleaner.functions.text import tokens
from gleaner.storage import batches_of, written

from . import lexical
from .fusion import K_RRF, pool_size
from .lexical import DECIMALS
from .neighbours import matrix, unit

#: Rows of a block; queries of a chunk; terms of a chunk's queries, about, unless one query has more.
ROWS, QUERIES, TERMS = 4096, 1024, 65_536
#: Words of a block of texts, about, unless one text has more.
WORDS = 1_000_000
#: A block, or a chunk, is a row group: a scan holds all rows of a row group at once.
ALONE = {"parquet.block.row.count.limit": "1"}
#: Bytes of texts, and of blocks, that go to Python at once, about: a batch ends with the row that passes them.
TEXTS, BLOCKS = "32m", "8m"
#: Chunks that are broadcast to all tasks in a pass over the blocks, at most; tasks of a pass by core.
SENT, TASKS = 16, 2
#: What a BM25 score is counted in: scores of many terms would tie or not by the order of their summation.
UNIT = 1e-9
FOUND = "query_id {kind}, id {id}, seq long, score double"


# ---- packing ----


def _blocks(rows: int) -> int:
    return max(1, -(-rows // ROWS))


@dataclass
class Packed:
    """Blocks of texts, with the statistics that they add up to: idf (term, df, idf), totals (n, avgdl: one row)."""

    blocks: DataFrame
    idf: DataFrame
    totals: DataFrame


def save(tokens: DataFrame, folder: str) -> Packed:
    """Rows (id, seq, t) as a folder of blocks; the words are read once, and df, n and lengths are those of the blocks."""
    spark = tokens.sparkSession
    with batches_of(spark, TEXTS):
        packed_tokens(tokens).write.options(**ALONE).parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    size = F.size("terms")
    ends = F.arrays_zip(F.col("terms").alias("term"), F.slice("starts", F.lit(1), size).alias("a"), F.slice("starts", F.lit(2), size).alias("b"))
    held = blocks.where(size > 0).select(F.explode(ends).alias("e")).select("e.term", (F.col("e.b") - F.col("e.a")).cast("long").alias("n"))
    held.groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{folder}/df")
    n, words = F.size("ids"), F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    blocks.select(n.alias("n"), words.alias("words")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl")).write.parquet(f"{folder}/totals")
    return load(spark, folder)


def load(spark: SparkSession, folder: str) -> Packed:
    blocks, df, totals = (spark.read.parquet(f"{folder}/{name}") for name in ("blocks", "df", "totals"))
    raw = df.crossJoin(F.broadcast(totals)).select("term", "df", scores.raw_idf(F.col("n"), F.col("df")).alias("raw"))  # totals is one row
    return Packed(blocks.withColumn("mean", F.lit(totals.first()["avgdl"]).cast("double")), scores.smoothed(raw), totals)


def packed_tokens(rows: DataFrame) -> DataFrame:
    """Blocks (ids, seqs, sizes, terms, starts, docs, tfs) of rows (id, seq, t), packed where they are read."""
    kind = dict(rows.dtypes)["id"]
    names = ["ids", "seqs", "sizes", "terms", "starts", "docs", "tfs"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("t")).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < batch.num_rows:
                b = min(a + ROWS, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WORDS, "right"))), batch.num_rows)
                part = batch.slice(a, b - a).take(pa.array(np.argsort(batch.column("seq").slice(a, b - a).to_numpy(), kind="stable")))
                sizes = pc.list_value_length(part.column("t")).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = part.column("t").flatten().dictionary_encode()
                held, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
                starts = np.searchsorted(held, np.arange(len(coded.dictionary) + 1) * len(sizes))
                ids = part.column("id")
                values = [(ids, ids.type), (part.column("seq"), pa.int64()), (sizes.astype(np.int32), pa.int32()), (coded.dictionary, pa.string()), (starts.astype(np.int32), pa.int32()), ((held % len(sizes)).astype(np.int32), pa.int32()), (tf.astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays([one(*v) for v in values], names)
                a = b

    return rows.select("id", F.col("seq").cast("long"), "t").mapInArrow(pack, f"ids array<{kind}>, seqs array<long>, sizes array<int>, terms array<string>, starts array<int>, docs array<int>, tfs array<int>")


def packed_postings(index: lexical.LexicalIndex) -> DataFrame:
    """Blocks (mean, ids, seqs, sizes, terms, starts, docs, tfs) of an index: of each term the rows that hold it, and how often.

    They come from the texts where the index has them, else from stored postings, which are shuffled.
    """
    if index.tokens is not None:
        return packed_tokens(index.tokens).withColumn("mean", F.lit(index.totals.first()["avgdl"]).cast("double"))
    kind = dict(index.lengths.dtypes)["id"]
    blocks = _blocks(index.rows)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    postings = index.postings.select(block, F.col("id").alias("held"), "term", F.col("tf").cast("int"))
    mean = index.totals.first()["avgdl"]

    def pack(rows: pa.Table, held: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq").combine_chunks()
        ids, held = rows["id"].combine_chunks() if rows.num_rows else pa.array([], rows.schema.field("id").type), held.sort_by("term").combine_chunks()
        term = held["term"].combine_chunks() if held.num_rows else pa.array([], pa.string())
        at = np.append(0, np.flatnonzero(pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)) + 1) if len(term) else np.zeros(0, np.int64)
        docs = pc.index_in(held["held"].combine_chunks(), ids) if len(term) else pa.array([], pa.int32())
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        number = (rows if rows.num_rows else held)["block"].combine_chunks().slice(0, 1)
        return pa.table([number, pa.array([mean]), one(ids, ids.type), one(rows["seq"].to_numpy(), pa.int64()), one(rows["dl"].to_numpy(), pa.int32()), one(term.take(pa.array(at)), pa.string()), one(np.append(at, len(term)).astype(np.int32), pa.int32()), one(docs.to_numpy(zero_copy_only=False).astype(np.int32), pa.int32()), one(held["tf"].to_numpy() if len(term) else np.zeros(0, np.int32), pa.int32())], ["block", "mean", "ids", "seqs", "sizes", "terms", "starts", "docs", "tfs"])

    rows = index.lengths.select(block, "id", F.col("seq").cast("long"), F.col("dl").cast("int"))
    return rows.groupBy("block").cogroup(postings.groupBy("block")).applyInArrow(pack, f"block long, mean double, ids array<{kind}>, seqs array<long>, sizes array<int>, terms array<string>, starts array<int>, docs array<int>, tfs array<int>")


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """Blocks (block, ids, seqs, x) of vectors (id, seq, embedding), scaled to one."""
    kind = dict(vectors.dtypes)["id"]
    rows = vectors.where(F.size("embedding") > 0)
    block = F.pmod(F.xxhash64("id"), F.lit(_blocks(rows.count()))).alias("block")

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq").combine_chunks()
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        ids = rows["id"].combine_chunks()
        return pa.table([rows["block"].combine_chunks().slice(0, 1), one(ids, ids.type), one(rows["seq"].to_numpy(), pa.int64()), pa.array([unit(matrix(rows)).tobytes()], pa.binary())], ["block", "ids", "seqs", "x"])

    return rows.select(block, "id", F.col("seq").cast("long"), "embedding").groupBy("block").applyInArrow(pack, f"block long, ids array<{kind}>, seqs array<long>, x binary")


def lexical_chunks(index: lexical.LexicalIndex | Packed, queries: DataFrame) -> tuple[DataFrame, int]:
    """Chunks (chunk, qs, terms, weights, starts) of queries (query_id, text) that have a word, and how many there are."""
    kind = dict(queries.dtypes)["query_id"]
    words = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weighed = words.join(index.idf.select("term", "idf"), "term", "left").select("query_id", "term", F.coalesce(F.col("idf") * F.col("times"), F.lit(0.0)).alias("w"))
    n, terms = words.agg(F.count_distinct("query_id"), F.count("*")).first()
    chunks = max(1, -(-n // QUERIES), -(-terms // TERMS))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("query_id", "ascending"), ("term", "ascending")]).combine_chunks()
        q, one = rows["query_id"].combine_chunks(), lambda values, kind: pa.array([values], pa.list_(kind))
        at = np.append(0, np.flatnonzero(pc.not_equal(q[1:], q[:-1]).to_numpy(zero_copy_only=False)) + 1)
        return pa.table([rows["chunk"].combine_chunks().slice(0, 1), one(q.take(pa.array(at)), q.type), one(rows["term"].combine_chunks(), pa.string()), one(rows["w"].to_numpy(), pa.float64()), one(np.append(at, len(q)).astype(np.int32), pa.int32())], ["chunk", "qs", "terms_", "weights", "starts_"])

    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")
    return weighed.select(chunk, "query_id", "term", "w").groupBy("chunk").applyInArrow(pack, f"chunk long, qs array<{kind}>, terms_ array<string>, weights array<double>, starts_ array<int>"), chunks


def vector_chunks(queries: DataFrame) -> tuple[DataFrame, int]:
    """Chunks (chunk, qs, q) of queries (query_id, vector) that have a vector, and how many there are."""
    kind = dict(queries.dtypes)["query_id"]
    rows = queries.where(F.size("vector") > 0)
    chunks = max(1, -(-rows.count() // QUERIES))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("query_id").combine_chunks()
        q = rows["query_id"].combine_chunks()
        return pa.table([rows["chunk"].combine_chunks().slice(0, 1), pa.array([q], pa.list_(q.type)), pa.array([unit(matrix(rows, "vector")).tobytes()], pa.binary())], ["chunk", "qs", "q"])

    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")
    return rows.select(chunk, "query_id", "vector").groupBy("chunk").applyInArrow(pack, f"chunk long, qs array<{kind}>, q binary"), chunks


# ---- scoring ----


class Best:
    """The k best of each query so far, by score, then the smaller seq."""

    def __init__(self, k: int, queries: pa.Array):
        self.k, self.queries = k, queries
        self.score = [np.zeros(0)] * len(queries)
        self.seq = [np.zeros(0, np.int64)] * len(queries)
        self.ids: list = [None] * len(queries)

    def offer(self, i: int, score: np.ndarray, ids: pa.Array, seqs: np.ndarray) -> None:
        """Rows in order of seq, with their scores, for query i."""
        old = self.score[i]
        at = np.flatnonzero(score >= old[-1]) if len(old) == self.k else np.arange(len(score))
        if len(at) > self.k:  # of equal scores the first by seq stay
            at = at[np.argsort(-score[at], kind="stable")[: self.k]]
        if not len(at):
            return
        s, q = np.append(old, score[at]), np.append(self.seq[i], seqs[at])
        new = ids.take(pa.array(at))
        both = pa.concat_arrays([self.ids[i], new]) if self.ids[i] is not None else new
        order = np.lexsort((q, -s))[: self.k]
        self.score[i], self.seq[i], self.ids[i] = s[order], q[order], both.take(pa.array(order))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.queries), 256):
            own = [i for i in range(a, min(a + 256, len(self.queries))) if self.ids[i] is not None]
            if own:
                query = self.queries.take(pa.array(np.repeat(own, [len(self.score[i]) for i in own])))
                yield pa.RecordBatch.from_arrays([query, pa.concat_arrays([self.ids[i] for i in own]), pa.array(np.concatenate([self.seq[i] for i in own])), pa.array(np.concatenate([self.score[i] for i in own]))], ["query_id", "id", "seq", "score"])


def _own(values: pa.Array) -> pa.Array:
    """A copy: a slice keeps the whole batch that it comes from."""
    return values.take(pa.array(np.arange(len(values))))


class Postings:
    """A pass's queries (chunks qs, terms_, weights, starts_), which meet blocks of postings."""

    def __init__(self, chunks: pa.StructArray):
        coded = chunks.field("terms_").flatten().dictionary_encode()
        self.queries, self.terms, self.codes = _own(chunks.field("qs").flatten()), coded.dictionary, coded.indices.to_numpy()
        self.weights = chunks.field("weights").flatten().to_numpy().copy()
        self.ends = np.cumsum(np.concatenate([[0], *(np.diff(s.values.to_numpy()) for s in chunks.field("starts_"))])).astype(np.int64).tolist()

    def score(self, row: Callable, best: Best) -> None:
        """One block of postings."""
        ids, seqs, starts = row("ids").values, row("seqs").values.to_numpy(), row("starts").values.to_numpy()
        docs, tf, size = row("docs").values.to_numpy(), row("tfs").values.to_numpy(), row("sizes").values.to_numpy()
        parts = tf * (scores.K1 + 1) / (tf + scores.K1 * (1 - scores.B + scores.B * size[docs] / row("mean").as_py()))
        place = pc.index_in(self.terms, row("terms").values).fill_null(-1).to_numpy()
        for i, (a, b) in enumerate(pairwise(self.ends)):
            own = place[self.codes[a:b]]
            have = own >= 0
            own, w = own[have], self.weights[a:b][have]
            size = starts[own + 1] - starts[own]
            at = np.repeat(starts[own] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
            # whole units add up to the same sum in any order, as long as it is under 2 ** 53
            best.offer(i, np.bincount(docs[at], np.rint(np.repeat(w, size) * parts[at] / UNIT), len(ids)) * UNIT, ids, seqs)


class Vectors:
    """A pass's queries (chunks qs, q), which meet blocks of vectors."""

    def __init__(self, chunks: pa.StructArray):
        self.queries = _own(chunks.field("qs").flatten())
        self.q = [np.frombuffer(q).reshape(len(qs), -1) for q, qs in zip(chunks.field("q").to_pylist(), chunks.field("qs"), strict=True)]

    def score(self, row: Callable, best: Best) -> None:
        """One block of vectors."""
        ids, seqs, at = row("ids").values, row("seqs").values.to_numpy(), 0
        x = np.frombuffer(row("x").as_buffer()).reshape(len(ids), -1)
        for q in self.q:
            if x.shape[1] != q.shape[1]:
                raise ValueError(f"a query's vector has {q.shape[1]} components, a row's {x.shape[1]}")
            for a in range(0, len(q), 128):
                for i, s in enumerate(np.round(q[a : a + 128] @ x.T, DECIMALS) + 0.0, at + a):
                    best.offer(i, s, ids, seqs)
            at += len(q)


def _sent(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """blocks, in a few tasks, with ``asked``: all the chunks in each task's first row, null in its others."""
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # a row's place in its task
    few = blocks.coalesce(TASKS * blocks.sparkSession.sparkContext.defaultParallelism).withColumn("first", first)
    one = chunks.agg(F.collect_list(F.struct(*chunks.columns)).alias("chunks"))
    # a row of SENT chunks, which have a bounded size
    return few.crossJoin(F.broadcast(one)).withColumn("asked", F.when(F.col("first"), F.col("chunks"))).drop("first", "chunks")


def _met(blocks: DataFrame, chunks: DataFrame, n: int, k: int, kind: type[Postings] | type[Vectors], kinds: tuple[str, str]) -> DataFrame:
    """Rows (query_id, id, seq, score, rank): the k best of each query, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = best = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = lambda name, i=i, batch=batch: batch.column(name)[i]
                if asked is None:
                    if not row("asked").is_valid:
                        raise ValueError("a task's first block came without the queries")
                    asked = kind(row("asked").values)
                    best = Best(max(k, 1), asked.queries)
                asked.score(row, best)
        if best is not None:
            yield from best.batches()

    sent = written(chunks, **ALONE) if n > SENT else chunks
    passes = [sent.where(F.col("chunk").between(a, a + SENT - 1)) for a in range(0, max(n, 1), SENT)]
    with batches_of(blocks.sparkSession, BLOCKS):  # a query is in one pass
        found = [written(_ranked(_sent(blocks, own).mapInArrow(run, FOUND.format(kind=kinds[0], id=kinds[1])), k)) for own in passes]
    return reduce(DataFrame.unionAll, found)


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _id_kind(blocks: DataFrame) -> str:
    return dict(blocks.dtypes)["ids"].removeprefix("array<").removesuffix(">")


def lexical_top_k(blocks: DataFrame, index: lexical.LexicalIndex | Packed, queries: DataFrame, k: int) -> DataFrame:
    """The k best rows for each query (query_id, text): (query_id, id, seq, score, rank), as ``lexical.top_k`` finds them, in whole UNITs."""
    chunks, n = lexical_chunks(index, queries)
    return _met(blocks, chunks, n, k, Postings, (dict(queries.dtypes)["query_id"], _id_kind(blocks)))


def cosine_top_k(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k rows nearest to each query (query_id, vector): (query_id, id, seq, score, rank), as ``dense.top_k`` finds them."""
    chunks, n = vector_chunks(queries)
    return _met(blocks, chunks, n, k, Vectors, (dict(queries.dtypes)["query_id"], _id_kind(blocks)))


def fuse(a: DataFrame, b: DataFrame, k_rrf: int = K_RRF) -> DataFrame:
    """Full outer join of ranked lists by query, with the sum of their contributions."""
    left = a.select("query_id", "id", F.col("seq").alias("s1"), F.col("rank").alias("lexical_rank"))
    right = b.select("query_id", "id", F.col("seq").alias("s2"), F.col("rank").alias("dense_rank"))
    both = left.join(right, ["query_id", "id"], "full_outer")
    return both.select("query_id", "id", F.coalesce("s1", "s2").alias("seq"), "lexical_rank", "dense_rank", (scores.rrf(F.col("lexical_rank"), k_rrf) + scores.rrf(F.col("dense_rank"), k_rrf)).alias("score"))


def hybrid(postings: DataFrame, index: lexical.LexicalIndex | Packed, vectors: DataFrame, queries: DataFrame, k: int = 5, candidate_pool: int | None = None) -> DataFrame:
    """For each query (query_id, text, vector) its k best by both lists, as ``fusion.hybrid`` finds them.

    A query without a word, or without a vector, has the other list alone.
    """
    pool = pool_size(k, candidate_pool)
    return _ranked(fuse(lexical_top_k(postings, index, queries, pool), cosine_top_k(vectors, queries, pool)), k)


def rerank_lexical(queries: DataFrame, hits: DataFrame, texts: DataFrame, top: int) -> DataFrame:
    """The top hits (query_id, id, seq) of each query by the share of a text's distinct words that the query has."""
    words = hits.join(texts.select("id", "text"), "id").select("query_id", "id", "seq", F.array_distinct(tokens(F.col("text"))).alias("w"))
    asked = words.join(queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("q")), "query_id")
    share = F.size(F.array_intersect("w", "q")) / F.greatest(F.size("w"), F.lit(1))
    return _ranked(asked.select("query_id", "id", "seq", share.alias("score")), top)
