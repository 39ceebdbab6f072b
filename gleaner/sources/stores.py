"""Stores: vector caches and indexes with an id fingerprint, and the extraction cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.dense import normalised
from gleaner.operators.extract import extract
from gleaner.operators.numbering import digest
from gleaner.schemas import ENTITIES, EVENTS, EXTRACTION
from gleaner.storage import written

from .corpus import _exists

Encode = Callable[[list[str]], list[list[float]]]


def fingerprint(ids: DataFrame) -> str:
    """A digest of (chunk_id, seq): equal only for the same ids in the same order."""
    return digest(ids, "seq", "chunk_id", of="chunk_id")


def encode(chunks: DataFrame, make: Callable[[], Encode]) -> DataFrame:
    """Vectors (chunk_id, seq, embedding) by an injected encoder, made once per task and fed Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for b in batches:
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "seq": b["seq"], "embedding": encoder(b["text"].tolist())})

    return chunks.select("chunk_id", "seq", "text").mapInPandas(run, "chunk_id string, seq long, embedding array<float>")


def cached_vectors(chunks: DataFrame, path: str, make: Callable[[], Encode]) -> DataFrame:
    """Vectors of chunks from the store at path if it holds exactly these ids, else encoded and stored."""
    spark, print_ = chunks.sparkSession, fingerprint(chunks.select("chunk_id", "seq"))
    at = f"{path}/{print_}"
    if not _exists(spark, f"{at}/_SUCCESS"):
        encode(chunks, make).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def save_index(vectors: DataFrame, path: str) -> None:
    """Unit vectors for inner-product search."""
    normalised(vectors).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_or_build_index(vectors: DataFrame, path: str) -> DataFrame:
    """The index at path for exactly these vectors' ids, built and stored if it isn't there."""
    at = f"{path}/{fingerprint(vectors.select('chunk_id', 'seq'))}"
    if not _exists(vectors.sparkSession, f"{at}/_SUCCESS"):
        save_index(vectors, at)
    return load_index(vectors.sparkSession, at)


#: Parts of an extraction cache's base that are merged apart; chunks of a batch that the model sees between two flushes.
BUCKETS, BATCH = 64, 10_000


def load_extractions(spark: SparkSession, path: str) -> DataFrame:
    """Extractions (chunk_id, events, entities) of a cache, at most one event each; empty if there is none.

    A cache is a JSON object keyed by chunk_id, or a folder of a base and deltas, of which the latest row of a chunk counts.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], EXTRACTION)
    log = _log(spark, path)
    if log is not None:
        value = F.struct("events", "entities")
        rows = log.groupBy("chunk_id").agg(F.max_by(value, "number").alias("v")).select("chunk_id", "v.events", "v.entities")
    else:
        whole = spark.read.text(path, wholetext=True)
        value = f"map<string,struct<events:{EVENTS},entities:{ENTITIES}>>"
        rows = whole.select(F.explode(F.from_json("value", value)).alias("chunk_id", "v")).select("chunk_id", "v.events", "v.entities")
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return rows.select("chunk_id", F.slice(empty("events", EVENTS), 1, 1).alias("events"), empty("entities", ENTITIES))


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the complete tables ``<kind>=<number>`` in a cache's folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def _log(spark: SparkSession, path: str, after: int | None = None) -> DataFrame | None:
    """Rows (chunk_id, events, entities, bucket, number) of the base and the deltas after it, or of the deltas alone."""
    bases, deltas = _numbers(spark, path, "base"), _numbers(spark, path, "delta")
    parts = []
    if bases and after is None:
        # a bucket stands in the base that changed it last
        held: dict[int, list[int]] = {}
        for r in spark.read.parquet(f"{path}/base={bases[-1]}/manifest").collect():  # BUCKETS rows
            held.setdefault(r["base"], []).append(r["bucket"])
        parts += [spark.read.parquet(f"{path}/base={n}/rows").where(F.col("bucket").isin(own)).withColumn("number", F.lit(n)) for n, own in held.items()]
    last = after if after is not None else bases[-1] if bases else -1
    parts += [spark.read.parquet(f"{path}/delta={n}").withColumn("number", F.lit(n)) for n in deltas if n > last]
    if not parts:
        return None
    columns = ["chunk_id", "events", "entities", F.col("bucket").cast("int"), "number"]
    return reduce(DataFrame.unionByName, (p.select(*columns) for p in parts))


def _append(rows: DataFrame, path: str) -> None:
    """Write rows as the next delta, over what a failure left of it."""
    spark = rows.sparkSession
    number = max([-1, *_numbers(spark, path, "base"), *_numbers(spark, path, "delta")]) + 1
    bucket = F.pmod(F.xxhash64("chunk_id"), F.lit(BUCKETS)).cast("int")
    rows.select("chunk_id", "events", "entities", bucket.alias("bucket")).write.mode("overwrite").parquet(f"{path}/delta={number}")


def save_extractions(cached: DataFrame, new: DataFrame, path: str) -> None:
    """Add new extractions to the cache in the folder: only they are written.  A folder that is none yet gets what is cached first."""
    if _log(cached.sparkSession, path) is None:
        _append(cached, path)
    _append(new, path)


def compact(spark: SparkSession, path: str) -> int:
    """Merge the deltas into the base; only buckets that they touch are written anew.  The number of these buckets.

    The old base and the deltas stay, so who reads meanwhile is not disturbed.
    """
    bases = _numbers(spark, path, "base")
    last = bases[-1] if bases else -1
    fresh = _log(spark, path, after=last)
    if fresh is None:
        return 0
    number = max(_numbers(spark, path, "delta"))
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS rows at most
    whole = _log(spark, path).where(F.col("bucket").isin(touched))
    value = F.struct("events", "entities")
    merged = whole.groupBy("bucket", "chunk_id").agg(F.max_by(value, "number").alias("v")).select("chunk_id", "v.events", "v.entities", "bucket")
    held = {r["bucket"]: r["base"] for r in spark.read.parquet(f"{path}/base={last}/manifest").collect()} if bases else {}
    held |= dict.fromkeys(touched, number)
    merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/base={number}/rows")
    spark.createDataFrame(sorted(held.items()), "bucket int, base int").coalesce(1).write.parquet(f"{path}/base={number}/manifest")
    # a base counts when its own mark is there
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/base={number}/_SUCCESS")
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path, True).close()
    return len(touched)


def extract_into(chunks: DataFrame, path: str, extract_text: Callable[[str], str], batch: int = BATCH) -> DataFrame:
    """Extractions of chunks from the cache in the folder, after the model has seen the chunks that it lacks.

    The model's answers are added batch by batch, about ``batch`` chunks each, so a failure loses one
    batch and the next call goes on from there.
    """
    spark = chunks.sparkSession
    ids = chunks.select("chunk_id").distinct()
    lacking = ids.join(load_extractions(spark, path).select("chunk_id"), "chunk_id", "left_anti")
    todo = written(chunks.select("chunk_id", "text").join(lacking, "chunk_id", "left_semi").dropDuplicates(["chunk_id"]))
    batches = -(-todo.count() // batch)
    none = spark.createDataFrame([], EXTRACTION)
    for b in range(batches):
        own = todo.where(F.pmod(F.xxhash64("chunk_id", F.lit(7)), F.lit(batches)) == b)
        _append(extract(own, none, extract_text), path)
    return load_extractions(spark, path).join(ids, "chunk_id", "left_semi")
