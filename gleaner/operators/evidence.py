"""Evidence for an answer: selection in tiers, formatting, citation cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import citation_path, strip

MAX_EVIDENCE, MAX_CHARS, SNIPPET = 10, 600, 280


def tiers(evidence: DataFrame, seeds: DataFrame) -> DataFrame:
    """evidence (chunk_id, ord, document_id, article, clause, point) with tier and priority.

    Tier 0 is a seed, 1 a chunk of an article of which a seed is a point, 2 another
    chunk of a seed's article, 3 the rest.  Inside tier 1 come chunks of a point seed's
    clause, then headings (first those of articles with other clause chunks), then others.
    """
    e = evidence.withColumn("__art", F.nullif("article", F.lit("")))
    marked = e.join(F.broadcast(seeds.select("chunk_id", F.lit(True).alias("seed")).distinct()), "chunk_id", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    is_set = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("")) != ""
    orphan_clause = F.when(F.col("seed") & is_set("point") & is_set("clause"), F.col("clause"))
    per = marked.where("__art is not null").groupBy("document_id", "__art").agg(
        F.max("seed").alias("has_seed"), F.max(F.col("seed") & is_set("point")).alias("orphan"),
        F.collect_set(orphan_clause).alias("clauses"), F.max(~F.col("seed") & is_set("clause")).alias("repair"),
    )
    per = per.withColumnsRenamed({"document_id": "__d", "__art": "__a"})
    j = marked.join(per, (F.col("document_id") == F.col("__d")) & (F.col("__art") == F.col("__a")), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    tier = F.when(F.col("seed"), 0).when(yes("orphan"), 1).when(yes("has_seed"), 2).otherwise(3)
    heading = F.col("clause").isNull() & F.col("point").isNull()
    order = F.when(F.coalesce(F.array_contains("clauses", F.col("clause")), F.lit(False)), 0).when(heading & yes("repair"), 1).when(heading, 2).otherwise(3)
    return j.withColumn("tier", tier).withColumn("priority", F.when(F.col("tier") == 1, order).otherwise(0)).drop("__art", "__d", "__a", "has_seed", "orphan", "clauses", "repair", "seed")


def select(evidence: DataFrame, seeds: DataFrame | None, max_chunks: int = MAX_EVIDENCE) -> DataFrame:
    """At most max_chunks rows of evidence with ``pick``, their order; all of it as it is if it fits.

    Without seeds rows stay in their order.  One plan decides: whether evidence fits is a
    window count, whether there is a seed a one-row aggregate.
    """
    if max_chunks <= 0:
        return evidence.withColumn("pick", F.lit(1)).limit(0)
    if seeds is None:
        return evidence.withColumn("pick", F.row_number().over(Window.orderBy("ord"))).where(F.col("pick") <= max_chunks)
    any_seed = seeds.agg(F.coalesce(F.max(F.coalesce("chunk_id", F.lit("")) != ""), F.lit(False)).alias("__any"))
    tiered = tiers(evidence, seeds).crossJoin(F.broadcast(any_seed))  # a row
    plain = (F.count("*").over(Window.partitionBy()) <= max_chunks) | ~F.col("__any")  # evidence is a list of tens of chunks
    again = F.row_number().over(Window.partitionBy("chunk_id").orderBy("tier", "priority", "ord"))
    rows = tiered.withColumns({"__plain": plain, "__n": again}).where("__plain or __n = 1")
    by_tier = [F.when(~F.col("__plain"), F.col(c)) for c in ("tier", "priority")]
    picked = rows.withColumn("pick", F.row_number().over(Window.orderBy(*by_tier, "ord")))
    return picked.where(F.col("pick") <= max_chunks).drop("__plain", "__n", "__any")


def blocks(evidence: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """Each row (pick, chunk_id, ...) as a numbered block of a prompt."""
    text = strip(F.col("text"))
    if max_chars > 0:
        text = F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars - 1), F.lit("…"))).otherwise(text)
    day = F.coalesce(F.date_format("effective_date", "yyyy-MM-dd"), F.lit("unknown"))
    block = F.concat(
        F.lit("["), F.col("pick").cast("string"), F.lit("] chunk_id="), "chunk_id", F.lit("\n    document_id="), "document_id", F.lit("\n    citation="),
        citation_path(F.col("article"), F.col("clause"), F.col("point")), F.lit("\n    effective_date="), day, F.lit("\n    text="), text,
    )
    return evidence.select("pick", "chunk_id", block.alias("block"))


def formatted(evidence: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row: the blocks of the evidence in order."""
    listed = F.array_sort(F.collect_list(F.struct("pick", "block")))
    return blocks(evidence, max_chars).agg(F.array_join(F.transform(listed, lambda s: s["block"]), "\n\n").alias("evidence"))


def cards(cited: DataFrame, chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """Citation cards of cited (chunk_id, pos): title (or the document's id), path and the text's beginning."""
    c = chunks.join(F.broadcast(cited), "chunk_id").join(titles.select("document_id", "title"), "document_id", "left")
    path = citation_path(F.col("article"), F.col("clause"), F.col("point"))
    return c.select("pos", "chunk_id", "document_id", F.coalesce("title", "document_id").alias("title"), path.alias("citation"), F.substring("text", 1, SNIPPET).alias("text"))
