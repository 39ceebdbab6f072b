"""A BM25 index that batches of documents keep up to date, without a rebuild.

A batch holds documents (id, seq, text); a null text deletes.  It writes its documents, a row each with
its terms and how often they stand in it, and which row of which batch before it each of its ids
replaces.  So neither texts nor postings are shuffled: only ids are, and the replaced
documents' terms where they are many.  Document frequencies, the number of rows and their lengths are sums of
signed deltas, so idf is that of a rebuild.  A batch reads the batches before it and overwrites its own
folder, so a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import scores
from gleaner.functions.text import tokens
from gleaner.operators.lexical import LexicalIndex, build
from gleaner.sources.stores import _numbers
from gleaner.storage import written

TABLES = {"docs": "id {0}, seq long, terms array<struct<term: string, tf: long>>, dl int, batch int", "gone": "gone {0}, was int"}


def _table(spark: SparkSession, folder: str, name: str, kind: str, numbers: list[int]) -> DataFrame:
    if not numbers:
        return spark.createDataFrame([], TABLES[name].format(kind))
    read = spark.read.option("basePath", f"{folder}/docs") if name == "docs" else spark.read  # documents know their batch
    return read.parquet(*(f"{folder}/{name}/batch={n}" for n in numbers))


def _replaced() -> Column:
    return F.col("id").eqNullSafe(F.col("gone")) & (F.col("batch") == F.col("was"))


def _alive(spark: SparkSession, folder: str, kind: str, numbers: list[int]) -> DataFrame:
    """The documents of some batches that none of these replaced."""
    return _table(spark, folder, "docs", kind, numbers).join(_table(spark, folder, "gone", kind, numbers), _replaced(), "left_anti")


def _last(batch: DataFrame, ids: DataFrame) -> DataFrame:
    """The last row by seq of each id; only rows whose id stands more than once in (id, n) are shuffled."""
    several = ids.where("n > 1")
    if several.isEmpty():
        return batch
    several = written(several.select(F.col("id").alias("own")))
    same = F.col("id").eqNullSafe(F.col("own"))
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq"), F.desc_nulls_last("text")))
    picked = batch.join(several, same, "left_semi").withColumn("__n", last).where("__n = 1").drop("__n")
    return batch.join(several, same, "left_anti").unionByName(picked)


def counted(words: Column) -> Column:
    """The distinct words of an array in order, each with how often it stands there: array<struct<term, tf>>."""
    # sorted words are a value bound once; a term is where a word differs from the one before it, up to the next such place
    differ = lambda s: lambda e: (e["at"] == 0) | (e["term"] != F.get(s, e["at"] - 1))
    starts = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x.alias("term"), i.alias("at"))), differ(s))
    tf = lambda s, f, e, j: (F.coalesce(F.get(f, j + 1)["at"], F.size(s)) - e["at"]).cast("long")
    runs = lambda s: F.transform(F.array(starts(s)), lambda f: F.transform(f, lambda e, j: F.struct(e["term"].alias("term"), tf(s, f, e, j).alias("tf"))))[0]
    return F.transform(F.array(F.sort_array(words)), runs)[0]


def apply_batch(folder: str, number: int, batch: DataFrame) -> None:
    """Batch ``number`` of documents (id, seq, text); of an id's rows the last by seq counts.  The batch is read more than once."""
    spark, kind = batch.sparkSession, dict(batch.dtypes)["id"]
    before = [n for n in _numbers(spark, f"{folder}/totals", "batch") if n < number]
    batch = batch.select("id", F.col("seq").cast("long"), "text")
    ids = written(batch.groupBy("id").agg(F.count("*").alias("n")))
    table = lambda name: f"{folder}/{name}/batch={number}"
    fresh = _last(batch, ids).where("text is not null").select("id", "seq", counted(tokens(F.col("text"))).alias("terms"))
    length = F.aggregate("terms", F.lit(0).cast("long"), lambda n, e: n + e["tf"]).cast("int")
    fresh.withColumn("dl", length).write.mode("overwrite").parquet(table("docs"))
    own = ids.select(F.col("id").alias("own"))
    gone = _alive(spark, folder, kind, before).select("id", "batch").join(own, F.col("id").eqNullSafe(F.col("own")), "left_semi")
    gone.select(F.col("id").alias("gone"), F.col("batch").alias("was")).write.mode("overwrite").parquet(table("gone"))
    # what is replaced is a table of known size, so it is broadcast if it is small
    old = _table(spark, folder, "docs", kind, before).join(spark.read.parquet(table("gone")), _replaced(), "left_semi")
    both = spark.read.parquet(table("docs")).select("terms", "dl", F.lit(1).alias("sign")).unionByName(old.select("terms", "dl", F.lit(-1).alias("sign")))
    df = both.select(F.explode("terms.term").alias("term"), "sign").groupBy("term").agg(F.sum("sign").alias("df")).where("df != 0")
    df.write.mode("overwrite").parquet(table("df"))
    sums = both.agg(F.coalesce(F.sum("sign"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("dl")), F.lit(0)).alias("words"))
    sums.write.mode("overwrite").parquet(table("totals"))


def load(spark: SparkSession, folder: str, kind: str = "string") -> LexicalIndex:
    """The index after all batches; idf and totals come from the deltas, not from postings."""
    done = _numbers(spark, f"{folder}/totals", "batch")
    if not done:
        return build(spark.createDataFrame([], f"id {kind}, seq long, text string"), "id")
    table = lambda name: spark.read.parquet(*(f"{folder}/{name}/batch={n}" for n in done))
    totals = table("totals").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))
    df = table("df").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    raw = df.crossJoin(F.broadcast(totals)).select("term", "df", scores.raw_idf(F.col("n"), F.col("df")).alias("raw"))  # totals is one row
    docs = _alive(spark, folder, kind, done)
    postings = docs.select(F.explode("terms").alias("e"), "id", "seq", "dl").select("e.term", "id", "seq", "e.tf", "dl")
    return LexicalIndex(postings, docs.select("id", "seq", "dl"), scores.smoothed(raw), totals)
