"""Numeric expressions: vectors, BM25 and rank fusion; all in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Okapi BM25 parameters; EPSILON scales the mean idf that replaces a negative one.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rank offset of reciprocal rank fusion.
K_RRF = 60


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays zero."""
    n = norm(v)
    # the length is a value beside v, so it is not computed again for each element
    both = F.array(F.struct(v.alias("v"), F.when(n == 0, 1.0).otherwise(n).alias("n")))
    return F.transform(both, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"]))[0]


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def rrf(rank: Column, k: int = K_RRF) -> Column:
    """A list's contribution at a 1-based rank; 0 where the list lacks the row."""
    return F.coalesce(F.lit(1.0) / (F.lit(k) + rank), F.lit(0.0))


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def smoothed(raw: DataFrame) -> DataFrame:
    """Rows (term, df, idf) of rows (term, df, raw): negative ones become a share of the mean."""
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # mean is one row


def bm25(idf: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
