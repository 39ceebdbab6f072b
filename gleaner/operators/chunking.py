"""Hierarchical chunking: article, clause, point, with an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import strip

#: How the levels of a legal text are headed.
ARTICLE, CLAUSE, POINT = r"Điều\s+\d+[A-Za-z]?", r"(\d+)\.", r"([a-zđ])\)"
FLAGS = "(?mdU)"


def _parts(text: Column, heading: str) -> Column:
    """text cut before each heading at a line start; stripped, without blank parts."""
    cut = F.split(text, f"{FLAGS}(?=^{heading})", -1)
    return F.filter(F.transform(cut, strip), lambda p: p != "")


def chunk_id(document_id: Column, article: Column, clause: Column, point: Column) -> Column:
    labels = [F.replace(c, F.lit(" "), F.lit("")) for c in (article, clause, point)]
    return F.concat_ws("::", document_id, F.coalesce(F.nullif(F.concat_ws("::", *labels), F.lit("")), F.lit("body")))


def chunk_documents(documents: DataFrame) -> DataFrame:
    """Chunks of documents (seq, document_id, content, ...); ``seq`` of a chunk is its place in the corpus.

    A document without articles is one chunk; text before the first article, an article's
    heading and a clause's stem are chunks of their level; an article without clauses is
    one chunk even if it has points.
    """
    content = strip(F.coalesce("content", F.lit("")))
    found = documents.withColumn("content", content).where("content != ''").withColumn("parts", _parts(F.col("content"), ARTICLE))
    has = F.exists("parts", lambda p: p.rlike(f"(?U)^{ARTICLE}"))
    found = found.select("*", F.posexplode(F.when(has, F.col("parts")).otherwise(F.array("content"))).alias("a", "t"))
    label = F.nullif(F.regexp_extract("t", f"(?U)^({ARTICLE})", 1), F.lit(""))
    found = found.withColumn("article", label).withColumn("parts", F.when(F.col("article").isNull(), F.array("t")).otherwise(_parts(F.col("t"), r"\d+\.\s+")))
    found = found.withColumn("several", F.size("parts") > 1).select("*", F.posexplode("parts").alias("c", "ct"))
    number = F.nullif(F.regexp_extract("ct", f"(?U)^{CLAUSE}", 1), F.lit(""))
    found = found.withColumn("clause", F.when(F.col("several"), F.concat(F.lit("Khoản "), number)))
    found = found.withColumn("parts", F.when(F.col("clause").isNull(), F.array("ct")).otherwise(_parts(F.col("ct"), r"[a-zđ]\)")))
    found = found.withColumn("several", F.size("parts") > 1).select("*", F.posexplode("parts").alias("p", "text"))
    letter = F.nullif(F.regexp_extract("text", f"^{POINT}", 1), F.lit(""))
    found = found.withColumn("point", F.when(F.col("several") & F.col("clause").isNotNull(), F.concat(F.lit("Điểm "), letter)))
    place = F.struct("seq", "a", "c", "p")
    have = set(documents.columns)
    pick = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    return found.select(
        place.alias("place"), chunk_id(F.col("document_id"), F.col("article"), F.col("clause"), F.col("point")).alias("chunk_id"), "document_id", "text",
        F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("section"), "article", "clause", "point",
        pick("effective_date", "date").alias("effective_date"), pick("expiration_date", "date").alias("expiration_date"),
        F.coalesce(pick("status", "string"), F.lit("unknown")).alias("status"), pick("source_url", "string").alias("source_url"),
        F.array().cast("array<string>").alias("entity_refs"),
    )


def keep_first(rows: DataFrame, key: str, order: str = "place") -> DataFrame:
    """The first row of each key in the given order, by a partial minimum before the shuffle."""
    first = rows.groupBy(key).agg(F.min(order).alias("__first"))
    return rows.join(first.withColumnRenamed(key, "__key"), (F.col(key) == F.col("__key")) & (F.col(order) == F.col("__first")), "left_semi")


def numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with ``seq``, dense inside a document and ordered across documents: document seq * 2**32 + position."""
    within = F.row_number().over(Window.partitionBy("document_id", "place.seq").orderBy("place"))
    return chunks.withColumn("seq", F.shiftleft(F.col("place.seq"), 32) + within).drop("place")
