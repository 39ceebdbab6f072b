"""The event and entity index: keys, buckets, lookups and seed merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.storage import written

from .chunking import keep_first
from .skew import meet


def entity_keys(document_id: Column, article: Column, clause: Column, extra: Column | None = None) -> Column:
    """Ordered distinct keys of a chunk, coarse to fine: law, article, clause, then the extra ones."""
    art, cls = F.nullif(article, F.lit("")), F.nullif(clause, F.lit(""))
    keys = F.array(
        F.concat(F.lit("law::"), document_id),
        F.concat(F.lit("art::"), document_id, F.lit("::"), art),
        F.concat(F.lit("cls::"), document_id, F.lit("::"), art, F.lit("::"), cls),
    )
    if extra is not None:
        keys = F.concat(keys, F.coalesce(extra, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def events(chunks: DataFrame) -> DataFrame:
    """Chunks with each chunk_id once, the first by seq."""
    return keep_first(chunks, "chunk_id", "seq").dropDuplicates(["chunk_id", "seq"])


def key_rows(chunks: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """Rows (chunk_id, seq, key, key_pos); concepts holds (chunk_id, keys)."""
    rows, extra = chunks, None
    if concepts is not None:
        rows, extra = chunks.join(concepts.select("chunk_id", F.col("keys").alias("__extra")), "chunk_id", "left"), F.col("__extra")
    return rows.select("chunk_id", "seq", F.posexplode(entity_keys(F.col("document_id"), F.col("article"), F.col("clause"), extra)).alias("key_pos", "key"))


def inverted_index(keys: DataFrame) -> DataFrame:
    """Each key with its chunks in order; a report, joins use the flat rows."""
    return keys.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))), lambda s: s["chunk_id"]).alias("chunk_ids"))


def lookup_by_concepts(query_keys: DataFrame, keys: DataFrame) -> DataFrame:
    """Chunks (chunk_id, seq, ord) that hold one of the query's concept keys (key, pos), in order of key, then seq."""
    wanted = query_keys.where(F.col("key").startswith("concept::"))
    found = keys.join(wanted, "key").groupBy("chunk_id").agg(F.min(F.struct("pos", "seq")).alias("ord"))
    return found.select("chunk_id", "ord.seq", F.struct("ord.pos", "ord.seq").alias("ord"))


def merge_seeds(primary: DataFrame, extra: DataFrame) -> DataFrame:
    """Ordered union of (chunk_id, ord): primary rows first, each id once; rows (chunk_id, src, ord)."""
    both = primary.select("chunk_id", F.lit(0).alias("src"), F.col("ord").cast("long")).unionByName(extra.select("chunk_id", F.lit(1).alias("src"), F.col("ord").cast("long")))
    return both.groupBy("chunk_id").agg(F.min(F.struct("src", "ord")).alias("o")).select("chunk_id", "o.src", "o.ord")


def concept_neighbours(keys: DataFrame) -> DataFrame:
    """Rows (src, dst, key_pos, seq): chunks that share a concept with src, by their first shared key."""
    concept = keys.where(F.col("key").startswith("concept::"))
    a, b = concept.select("key", F.col("chunk_id").alias("src"), "key_pos"), concept.select("key", F.col("chunk_id").alias("dst"), "seq")
    first = a.join(b, "key").groupBy("src", "dst").agg(F.min(F.struct("key_pos", "seq")).alias("o"))
    return first.select("src", "dst", "o.key_pos", "o.seq")


def nearest_by_concept(keys: DataFrame, most: int) -> DataFrame:
    """Rows (src, dst, key_pos, seq): the first ``most`` other chunks that share a concept with src, in order of src's keys, then seq.

    Of a key's chunks only the first most + 1 can be among them, so a key meets its chunks as
    one array of these: rows grow with the chunks, whatever a key's share of them.
    """
    concept = keys.where(F.col("key").startswith("concept::"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("seq", "chunk_id"))
    first = concept.select("key", "seq", F.col("chunk_id").alias("dst"), place.alias("p")).where(F.col("p") <= most + 1).groupBy("key").agg(F.collect_list(F.struct("seq", "dst")).alias("found"))
    facts = written(first.join(concept.groupBy("key").agg(F.count("*").alias("n")), "key"))
    met = meet(concept.select("key", F.col("chunk_id").alias("src"), "key_pos"), facts, "key").select("src", "key_pos", F.explode("found").alias("e")).where("src != e.dst")
    best = met.groupBy("src", F.col("e.dst").alias("dst")).agg(F.min(F.struct("key_pos", "e.seq")).alias("o")).select("src", "dst", "o.key_pos", "o.seq")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("key_pos", "seq", "dst"))
    return best.withColumn("__n", rank).where(F.col("__n") <= most).drop("__n")


def query_key_rows(spark, keys: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys) if k], "key string, pos int")
