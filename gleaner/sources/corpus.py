"""Corpus sources: JSON dumps, text files and organisation folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import blank, effective_date, strip
from gleaner.operators.chunking import chunk_documents, keep_first, numbered
from gleaner.schemas import RAW

from . import json_array

#: Rows of the dump that can't be used, and the default pack.
SKIP = ("code-2019-bo-luat-lao-dong", "luat-ban-hanh-van-ban-quy-pham-phap-luat")
PACK = (
    "luat-cac-to-chuc-tin-dung",
    "law-2025-luat-cac-to-chuc-tin-dung-sua-doi",
    "luat-ngan-hang-nha-nuoc",
    "luat-ke-toan",
    "law-2025-luat-ke-toan-sua-doi",
    "law-2020-luat-doanh-nghiep",
    "law-2005-luat-thuong-mai",
    "law-2019-luat-chung-khoan",
    "law-2025-luat-chung-khoan-sua-doi",
    "law-2025-luat-bao-ve-du-lieu-ca-nhan",
    "law-2005-luat-so-huu-tri-tue",
    "law-2022-luat-so-huu-tri-tue-sua-doi",
    "bo-luat-lao-dong",
    "law-2012-luat-phong-chong-rua-tien",
)
#: Document types by the dump's type; any other is ``other``.
TYPES = {"law": "luat", "code": "other", "constitution": "other"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The objects of a JSON list, in file order: (seq, id, title, type, content).

    A missing file is a FileNotFoundError, a file that is no JSON or holds no list a
    ValueError; list items that are no objects are ignored.  The file is read in byte ranges.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    items = json_array.items(spark, path).where("is_object")
    return items.select(F.col("seq").cast("long"), F.from_json("item", RAW).alias("r")).select("seq", "r.*")


def usable(rows: DataFrame, skip: Sequence[str] = SKIP) -> DataFrame:
    """Rows with an id that is not skipped and content that is not blank; of an id the first such row."""
    good = rows.where((F.coalesce("id", F.lit("")) != "") & ~blank(F.col("content")))
    if skip:
        good = good.where(~F.col("id").isin(*skip))
    return keep_first(good, "id", "seq")


def keyed_select(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The rows of ids in the ids' order (``pos``); of an id's rows the last. Missing ids are a KeyError."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), "pos long, id string")
    last = rows.groupBy("id").agg(F.max("seq").alias("seq"))
    found = rows.join(last, ["id", "seq"], "left_semi").join(F.broadcast(wanted), "id")  # the caller's list
    missing = [r["id"] for r in wanted.join(found.select("id"), "id", "left_anti").orderBy("pos").collect()]
    if missing:
        raise KeyError(f"documents not in the corpus: {missing}")
    return found


def documents(rows: DataFrame) -> DataFrame:
    """Dump rows as documents; rows without content are dropped."""
    kinds = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    kind = F.coalesce(F.try_element_at(kinds, strip(F.lower(F.coalesce("type", F.lit(""))))), F.lit("other"))
    order = F.col("pos") if "pos" in rows.columns else F.col("seq")
    return rows.where(~blank(F.col("content"))).select(
        order.cast("long").alias("seq"), F.col("id").alias("document_id"), F.coalesce(F.nullif("title", F.lit("")), "id").alias("title"), kind.alias("document_type"),
        effective_date(F.col("content")).alias("effective_date"), F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("source_url"), "content",
    )


def ingest(spark: SparkSession, path: str, ids: Sequence[str] | None = None, all_docs: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents and their chunks: the default pack, the given ids, or every usable row."""
    if all_docs and ids is not None:
        raise ValueError("give ids or all_docs, not both")
    rows = read_corpus(spark, path)
    if all_docs:
        # an id stands where it comes first, with the values of its last row in the dump
        chosen = usable(rows).select("id", F.col("seq").alias("pos")).join(rows.join(rows.groupBy("id").agg(F.max("seq").alias("seq")), ["id", "seq"], "left_semi"), "id")
    else:
        chosen = keyed_select(rows, PACK if ids is None else ids)
    if chosen.where(blank(F.col("content"))).limit(1).count():
        raise ValueError("a chosen document has no content")
    docs = documents(chosen)
    return docs, numbered(chunk_documents(docs))


def read_text(spark: SparkSession, path: str, **fields: str) -> DataFrame:
    """A UTF-8 text file as one document with the given fields."""
    row = spark.read.text(path, wholetext=True).withColumn("seq", F.monotonically_increasing_id())
    return row.select("seq", F.col("value").alias("content"), *(F.lit(v).alias(k) for k, v in fields.items()))


def read_org_docs(spark: SparkSession, root: str, orgs: DataFrame) -> DataFrame:
    """Documents (org_id, doc_type, text) ``root/<org_id>/*.md`` of the organisations that need no clarifying."""
    schema = "org_id string, doc_type string, text string"
    if not _exists(spark, root) or not _has_md(spark, root):
        return spark.createDataFrame([], schema)
    files = spark.read.text(f"{root}/*/*.md", wholetext=True).select(F.split(F.col("_metadata.file_path"), "/").alias("p"), F.col("value").alias("text"))
    named = files.select(F.url_decode(F.element_at("p", -2)).alias("org_id"), F.regexp_replace(F.url_decode(F.element_at("p", -1)), r"\.md$", "").alias("doc_type"), "text")
    return named.join(orgs.where("not needs_clarify").select("org_id").distinct(), "org_id", "left_semi").orderBy("org_id", "doc_type")


def _has_md(spark: SparkSession, root: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/*.md")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0
