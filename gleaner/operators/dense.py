"""Dense retrieval: exact cosine and inner-product search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import scores

from .lexical import DECIMALS, ranked
from .neighbours import semantic_edges

__all__ = ["inner_product_top_k", "missing", "normalised", "semantic_edges", "top_k"]


def top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows of (id, seq, embedding) nearest to query by cosine: (id, seq, score, rank)."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return ranked(vectors.select("id", "seq", F.round(scores.cosine(F.col("embedding"), q), DECIMALS).alias("score")).orderBy(F.desc("score"), "seq").limit(max(0, k)))


def normalised(vectors: DataFrame) -> DataFrame:
    """An inner-product index: unit vectors; zero vectors stay zero."""
    return vectors.withColumn("embedding", scores.unit(F.col("embedding")))


def inner_product_top_k(index: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows of a normalised index with the largest inner product with the unit query."""
    q = np.array(query, float)
    q = q / (np.linalg.norm(q) or 1.0)
    return ranked(index.select("id", "seq", F.round(scores.dot(F.col("embedding"), F.array(*map(F.lit, q.tolist()))), DECIMALS).alias("score")).orderBy(F.desc("score"), "seq").limit(max(0, k)))


def missing(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids without a vector."""
    return ids.join(vectors, "id", "left_anti")
