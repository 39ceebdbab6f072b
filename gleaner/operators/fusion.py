"""Hybrid retrieval: reciprocal rank fusion of two ranked lists, and reranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.scores import K_RRF, rrf
from gleaner.functions.text import tokens

from . import dense, lexical

#: Least length of the lists that are fused.
POOL = 200


def fuse(a: DataFrame, b: DataFrame, k_rrf: int = K_RRF) -> DataFrame:
    """Full outer join of ranked lists (id, seq, rank) with the sum of their contributions."""
    left = a.select("id", F.col("seq").alias("s1"), F.col("rank").alias("r1"))
    right = b.select("id", F.col("seq").alias("s2"), F.col("rank").alias("r2"))
    both = left.join(right, "id", "full_outer")
    return both.select("id", F.coalesce("s1", "s2").alias("seq"), F.col("r1").alias("lexical_rank"), F.col("r2").alias("dense_rank"), (rrf(F.col("r1"), k_rrf) + rrf(F.col("r2"), k_rrf)).alias("score"))


def top_k(fused: DataFrame, k: int) -> DataFrame:
    """The k best; ties go to the smaller seq."""
    return lexical.ranked(fused.orderBy(F.desc("score"), "seq").limit(max(0, k)))


def pool_size(k: int, candidate_pool: int | None = None) -> int:
    return max(20 * k, POOL) if candidate_pool is None else max(candidate_pool, k)


def hybrid(index: lexical.LexicalIndex, vectors: DataFrame, query: str, vector: Sequence[float], k: int = 5, candidate_pool: int | None = None) -> DataFrame:
    """BM25 and cosine lists of the pool's length, fused, the k best."""
    pool = pool_size(k, candidate_pool)
    return top_k(fuse(lexical.top_k(index, query, pool), dense.top_k(vectors, list(vector), pool)), k)


#: (query, texts, top_k) -> (index into texts, relevance) pairs, best first.
Reranker = Callable[[str, list[str], int], list[tuple[int, float]]]


def rerank(query: str, hits: DataFrame, top: int, reranker: Reranker) -> DataFrame:
    """The top hits (id, seq, text, ...) by an injected scorer; hits are a list of k rows, never a corpus."""
    if top <= 0:
        return hits.limit(0).select("id", "seq", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    rows = hits.orderBy("rank" if "rank" in hits.columns else "seq").select("id", "seq", "text").collect()
    order = reranker(query, [r["text"] for r in rows], min(top, len(rows))) if rows else []
    kinds = dict(hits.dtypes)
    out = [(rows[i]["id"], rows[i]["seq"], float(s), n) for n, (i, s) in enumerate(order[:top], 1)]
    return hits.sparkSession.createDataFrame(out, f"id {kinds['id']}, seq {kinds['seq']}, score double, rank int")


def rerank_lexical(query: str, hits: DataFrame, top: int) -> DataFrame:
    """A deterministic scorer for tests and offline use: the share of a text's distinct words that the query has."""
    q = F.array_distinct(tokens(F.lit(query)))
    words = F.array_distinct(tokens(F.col("text")))
    scored = hits.select("id", "seq", (F.size(F.array_intersect(words, q)) / F.greatest(F.size(words), F.lit(1))).alias("score"))
    return top_k(scored, top)
