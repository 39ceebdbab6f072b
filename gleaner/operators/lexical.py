"""BM25: statistics tables built once, and top-k search over them.

A stored index is written in segments: rows are dealt out by block, about DOCS rows of like
length, and each task writes the postings of its blocks in order of term, so only texts are
shuffled and a query reads a few pages of each segment.  The number of segments follows the
words, so a task's memory does not grow with the table.  A large index also keeps the
greatest impact of each term in each block.  A query's terms bound the scores of every block; the
best FIRST blocks give a k-th score, and only postings of blocks that can reach it are read,
as the blocks go into the scan as ranges.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import pairwise

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import scores
from gleaner.functions.text import WORD, tokens


#: Decimals of a score that count in a ranking; what differs less is a tie, whatever the order of summation.
DECIMALS = 12

#: Rows of a block, about; blocks whose postings give the first k-th score; ranges of blocks in a scan's filter, at most.
DOCS, FIRST, RANGES = 256, 64, 64
#: Blocks of one band of lengths have numbers from band << BAND on; lengths of a band differ by a tenth.
BAND, RATIO = 32, 1.1
#: Blocks that come to the driver, at most; of more only each band's first and last do.
LISTED = 2000
#: Words of a segment, about: what a task counts and sorts.
WORDS = 1_000_000
#: Postings of a page, the least that a scan can skip.
PAGE_ROWS = 2048
#: Slack of a bound against the order of summation.
SLACK = 1e-9


@dataclass
class LexicalIndex:
    """postings (term, id, seq, tf, dl), lengths (id, seq, dl), idf (term, idf), totals (n, avgdl: one row).

    A stored index has a column ``block`` in postings, and maxima (term, block, top) if it has blocks to leave out.
    """

    postings: DataFrame
    lengths: DataFrame
    idf: DataFrame
    totals: DataFrame
    maxima: DataFrame | None = None
    tokens: DataFrame | None = None

    @cached_property
    def rows(self) -> int:
        return self.totals.first()["n"]


def token_rows(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    return rows.select(F.col(key).alias("id"), "seq", tokens(F.col("text")).alias("t"))


def build(rows: DataFrame, key: str = "chunk_id") -> LexicalIndex:
    """Index rows (key, seq, text); ``seq`` breaks ties."""
    tokenised = token_rows(rows, key)
    lengths = tokenised.select("id", "seq", F.size("t").alias("dl"))
    words = tokenised.select("id", "seq", F.size("t").alias("dl"), F.explode("t").alias("term"))
    postings = words.groupBy("term", "id", "seq", "dl").agg(F.count("*").alias("tf"))
    totals, idf = _weights(postings, lengths)
    return LexicalIndex(postings, lengths, idf, totals, tokens=tokenised)


def _weights(postings: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    totals = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    counted = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = counted.crossJoin(F.broadcast(totals)).select("term", "df", scores.raw_idf(F.col("n"), F.col("df")).alias("raw"))  # totals is one row
    return totals, scores.smoothed(raw)


def save(index: LexicalIndex, folder: str) -> LexicalIndex:
    """A built index as tables: postings in segments in order of term, so a query's filter skips all pages but those of its terms."""
    spark = index.postings.sparkSession
    index.lengths.write.parquet(f"{folder}/lengths")
    lengths = spark.read.parquet(f"{folder}/lengths")
    counted = lengths.groupBy(_band().alias("band")).agg(F.ceil(F.count("*") / DOCS).alias("parts"), F.sum("dl").alias("words")).collect()  # 2 ** 31 lengths have 226 bands
    bands, words = {r["band"]: r["parts"] for r in counted}, sum(r["words"] or 0 for r in counted)
    parts = F.create_map(*(F.lit(x) for pair in bands.items() for x in pair))[_band()] if bands else F.lit(1)
    block = F.shiftleft(_band().cast("long"), BAND) + F.pmod(F.xxhash64("id"), parts)
    segments = max(spark.sparkContext.defaultParallelism, -(-words // WORDS))  # a number, so they are not joined by their compressed size
    # words hold no spaces; as one string they take a third of an array's bytes in the shuffle
    dealt = index.tokens.withColumn("dl", F.size("t")).select(block.alias("block"), "id", "seq", "dl", F.array_join("t", " ").alias("words")).repartition(segments, "block")
    counted = dealt.where("dl > 0").select("block", "id", "seq", "dl", F.explode(F.split("words", " ")).alias("term")).groupBy("term", "block", "id", "seq", "dl").agg(F.count("*").alias("tf"))
    counted.sortWithinPartitions("term", "block", "seq").write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")
    totals, idf = _weights(postings, lengths)
    totals.write.parquet(f"{folder}/totals")
    idf.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/idf")
    if spark.read.parquet(f"{folder}/totals").first()["n"] <= 4 * FIRST * DOCS:
        return load(spark, folder)  # too few blocks to leave any out
    top = F.max(scores.bm25(F.lit(1.0), F.col("tf"), F.col("dl"), F.col("avgdl")))
    maxima = postings.crossJoin(F.broadcast(spark.read.parquet(f"{folder}/totals"))).groupBy("term", "block").agg(top.alias("top"))  # totals is one row
    maxima.sortWithinPartitions("term", "block").write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{folder}/maxima")
    return load(spark, folder)


def _band():
    return F.floor(F.log(F.col("dl") + 1.0) / F.log(F.lit(RATIO))).cast("int")


def load(spark, folder: str) -> LexicalIndex:
    found = LexicalIndex(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "lengths", "idf", "totals")))
    if found.rows > 4 * FIRST * DOCS:
        found.maxima = spark.read.parquet(f"{folder}/maxima")
    return found


def query_terms(query: str) -> dict[str, int]:
    """The query's distinct terms with how often each stands in it; the tokens of texts, found by the same pattern."""
    return Counter(regex.findall(WORD, query.lower()))


def weights(index: LexicalIndex, terms: dict[str, int]) -> DataFrame:
    """Rows (term, w), one a query term that the index has."""
    times = F.create_map(*(F.lit(x) for pair in terms.items() for x in pair))
    return index.idf.where(F.col("term").isin(*terms)).select("term", (F.col("idf") * times[F.col("term")]).alias("w"))


def score(index: LexicalIndex, query: str, blocks: Column | None = None) -> DataFrame:
    """Scores (id, seq, score) of the rows that hold a query term, in some blocks or in all."""
    terms = query_terms(query)
    mine = F.col("term").isin(*terms)  # a literal filter, which reaches the scan of a stored index
    found = index.postings.where(mine if blocks is None else mine & blocks).join(F.broadcast(weights(index, terms)), "term").crossJoin(F.broadcast(index.totals))  # totals is one row
    return found.groupBy("id", "seq").agg(F.sum(scores.bm25(F.col("w"), F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))


def top_k(index: LexicalIndex, query: str, k: int) -> DataFrame:
    """The k best rows (id, seq, score, rank); rows without a query term score 0 and fill the list in order of seq."""
    if k <= 0 or not query_terms(query):
        return index.lengths.select("id", "seq", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    found = (best_blocks(index, query, k) if index.maxima is not None else score(index, query)).withColumn("score", F.round("score", DECIMALS))
    # rows that score 0 are joined only where fewer than k are above them; else a scan of their ids is all
    short = found.agg((F.count_if(F.col("score") > 0) < k).alias("short"))  # a row
    zeros = index.lengths.select("id", "seq").crossJoin(F.broadcast(short)).where("short").join(found.select("id"), "id", "left_anti")
    full = found.unionByName(zeros.select("id", "seq", F.lit(0.0).alias("score")))
    return ranked(full.orderBy(F.desc("score"), "seq").limit(k))


def bounds(index: LexicalIndex, query: str) -> DataFrame:
    """Rows (block, bound): no row of the block scores more."""
    terms = query_terms(query)
    own = index.maxima.where(F.col("term").isin(*terms)).join(F.broadcast(weights(index, terms)), "term")
    return own.groupBy("block").agg(F.sum(F.greatest("w", F.lit(0.0)) * F.col("top")).alias("bound"))


def best_blocks(index: LexicalIndex, query: str, k: int) -> DataFrame:
    """Scores (id, seq, score) of the rows of all blocks that can hold one of the k best."""
    bound = bounds(index, query).cache()
    try:
        first = [r["block"] for r in bound.orderBy(F.desc("bound"), "block").limit(FIRST).collect()]
        tried = score(index, query, within(ranges(first)) & F.col("block").isin(*first) if first else F.lit(False))
        best = tried.orderBy(F.desc("score")).limit(k).collect()  # k rows
        least = best[-1]["score"] if len(best) == k else float("-inf")
        if least <= 0:
            return score(index, query)
        alive = bound.where(F.col("bound") >= least * (1 - SLACK) - SLACK).select("block")
        some = [r["block"] for r in alive.limit(LISTED + 1).collect()]
        if len(some) <= LISTED:
            return score(index, query, within(ranges(some)) & F.col("block").isin(*some))
        edges = alive.groupBy(F.shiftright("block", BAND)).agg(F.min("block").alias("a"), F.max("block").alias("b")).collect()  # a row a band
        rest = index.postings.join(alive, "block", "left_semi")
        return score(LexicalIndex(rest, index.lengths, index.idf, index.totals), query, within([(r["a"], r["b"]) for r in edges]))
    finally:
        bound.unpersist()


def ranges(blocks: list[int]) -> list[tuple[int, int]]:
    """RANGES ranges at most that hold the blocks, parted where the gaps are widest."""
    blocks = sorted(blocks)
    gaps = sorted((b - a, i) for i, (a, b) in enumerate(pairwise(blocks), 1) if b - a > 1)[-(RANGES - 1) :]
    cuts = [0, *sorted(i for _, i in gaps), len(blocks)]
    return [(blocks[a], blocks[b - 1]) for a, b in pairwise(cuts) if b > a]


def within(spans: list[tuple[int, int]]) -> Column:
    """A filter on the block that a scan can skip pages by."""
    return reduce(lambda x, y: x | y, (F.col("block").between(a, b) for a, b in spans), F.lit(False))


def ranked(rows: DataFrame) -> DataFrame:
    """rows, k at most, with a 1-based rank by score, then seq."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "seq")))
