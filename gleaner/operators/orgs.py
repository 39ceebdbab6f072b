"""Organisations: catalog, resolution by alias, their documents and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import org_name
from gleaner.schemas import ORG

#: The default catalog.
CATALOG = [
    ("VCC", "Công ty Tài chính Cổ phần Tín Việt", ["VietCredit", "Tín Việt", "VCC"], "financial_company", None, "active"),
    ("WAKA", "Công ty Cổ phần Sách điện tử Waka", ["Waka", "Sách điện tử Waka", "WAKA"], "ebook_company", "0108796796", "active"),
]
#: Fixed value: how a clarifying question starts.
ASK = "Bạn đang hỏi về tổ chức nào: "
#: Organisation chunks that may follow the evidence.
MAX_ORG = 4


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(CATALOG)], f"seq long, {ORG}")


def resolve(queries: DataFrame, orgs: DataFrame) -> DataFrame:
    """Active organisations that a query (query_id, query) names, by canonical name or alias.

    A name of two characters or more matches anywhere in the query, inside words too.
    If a query names several, each needs clarifying and carries the question.
    """
    active = orgs.where(F.coalesce("status", F.lit("active")) == "active")
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    # names and queries are folded once each, before they meet
    active = active.withColumn("__names", F.filter(F.transform(names, org_name), lambda n: F.length(n) >= 2))
    found = queries.withColumn("__query", org_name(F.col("query"))).join(active, F.exists("__names", lambda n: F.col("__query").contains(n)))
    each = Window.partitionBy("query_id")
    several = F.count("*").over(each) > 1
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "canonical_name")).over(each)), lambda s: s["canonical_name"])
    prompt = F.when(several, F.concat(F.lit(ASK), F.array_join(listed, "; "), F.lit("?"))).otherwise("")
    return found.select(
        "query_id", "org_id", "seq", F.col("canonical_name").alias("display_name"), "aliases", F.col("entity_type").alias("org_type"),
        F.col("tax_id").alias("mst"), several.alias("needs_clarify"), prompt.alias("clarify_prompt"),
    )


def org_chunks(docs: DataFrame) -> DataFrame:
    """Organisation documents (org_id, doc_type, text) as chunks, in order of org and type."""
    document = F.concat_ws(":", F.lit("org"), "org_id", "doc_type")
    return docs.select(F.concat(document, F.lit("::body")).alias("chunk_id"), document.alias("document_id"), "text", F.array("org_id").alias("entity_refs"), F.struct("org_id", "doc_type").alias("ord"))


def merge_evidence(statute: DataFrame, organisation: DataFrame, max_org: int = MAX_ORG) -> DataFrame:
    """Statute evidence (chunk_id, ord), then the first max_org organisation chunks: rows (chunk_id, part, ord)."""
    extra = organisation.orderBy("ord").limit(max_org)
    number = F.row_number().over(Window.orderBy("ord"))
    return statute.select("chunk_id", F.lit(0).alias("part"), F.col("ord").cast("long")).unionByName(extra.select("chunk_id", F.lit(1).alias("part"), number.cast("long").alias("ord")))
