"""Retrieval quality against gold provisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, doc_recall, prov_recall, precision, f1), one for each query with gold.

    ``hits``: (query_id, chunk_id, document_id, rank); ``gold``: (query_id, chunk_id,
    document_id).  Recall of documents and of provisions is the share of the gold ones among
    the first k hits, precision the share of those hits that are gold; f1 joins precision
    and provision recall.  Repeated hits and gold rows count once; without hits all are 0.
    """
    top = hits.where(F.col("rank") <= k).select("query_id", "chunk_id", "document_id").distinct()
    wanted = gold.select("query_id", "chunk_id", "document_id").distinct()
    both = wanted.join(top.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    provisions = both.groupBy("query_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    own = wanted.select("query_id", "document_id").distinct().join(top.select("query_id", "document_id", F.lit(1).alias("seen")).distinct(), ["query_id", "document_id"], "left")
    documents = own.groupBy("query_id").agg((F.coalesce(F.sum("seen"), F.lit(0)) / F.count("*")).alias("doc_recall"))
    size = top.groupBy("query_id").agg(F.count("*").alias("size"))
    j = provisions.join(documents, "query_id").join(size, "query_id", "left")
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    recall, precision = F.col("found") / F.col("n"), share(F.col("found"), F.col("size"))
    return j.select("query_id", "doc_recall", recall.alias("prov_recall"), precision.alias("precision"), share(2 * recall * precision, recall + precision).alias("f1"))


def means(rows: DataFrame) -> DataFrame:
    """One row: the mean of each metric."""
    return rows.agg(*(F.avg(c).alias(c) for c in ("doc_recall", "prov_recall", "precision", "f1")))
