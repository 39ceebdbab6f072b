"""A JSON list of any size as rows, read in byte ranges.

The file is read as text whose lines end at ``}``, which Spark splits like any text, so a line is a
piece of an object.  Whether a piece starts inside a string, and how deep, follows from all
pieces before it; a piece's effect is known for either start, so effects are summed up inside each
byte range and then over the ranges, a row each.  An object ends where the depth is back to the list's.
Only an object's own pieces are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import strip
from gleaner.operators.numbering import numbered
from gleaner.storage import written


def _depth(parts: Column, inside: int) -> Column:
    """Brackets opened less those closed in the parts of a piece between quotes that are outside strings."""
    gone = lambda s, which: F.length(s) - F.length(F.translate(s, which, ""))
    deltas = F.transform(parts, lambda s, i: F.when(i % 2 == inside, gone(s, "{[") - gone(s, "}]")).otherwise(0))
    return F.aggregate(deltas, F.lit(0).cast("long"), lambda a, d: a + d)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, range, at, value, last, odd, closed, start, depth): each piece with where it starts and the depth after it."""
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"), "value")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    rows = raw.withColumn("parts", parts).withColumn("odd", (F.size("parts") - 1) % 2)
    rows = rows.withColumns({f"d{h}": _depth(F.col("parts"), h) - F.when(F.col("odd") == h, 1).otherwise(0) for h in (0, 1)}).drop("parts")  # with the } that ends it
    own, here = Window.partitionBy("file", "range").orderBy("at"), Window.partitionBy("file", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("in", F.coalesce(F.sum("odd").over(here), F.lit(0)) % 2)
    # sums within the range if it starts outside a string (0), and inside one (1)
    rows = rows.withColumns({f"c{h}": F.sum(F.when(F.col("in") == h, F.col("d0")).otherwise(F.col("d1"))).over(own) for h in (0, 1)})
    rows = written(rows)
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("file", "range").agg(F.sum("odd").alias("odds"), F.max_by("c0", "at").alias("t0"), F.max_by("c1", "at").alias("t1"), F.max("at").alias("end"))  # a row a range
    ranges = ranges.withColumn("h", F.coalesce(F.sum("odds").over(before), F.lit(0)) % 2)
    ranges = ranges.withColumn("base", F.coalesce(F.sum(F.when(F.col("h") == 0, F.col("t0")).otherwise(F.col("t1"))).over(before), F.lit(0)))
    ends = ranges.groupBy("file").agg(F.max_by("end", "range").alias("end"), F.max("range").alias("final"))
    ranges = ranges.drop("end").join(ends, "file").select("file", "range", "h", "base", F.when(F.col("range") == F.col("final"), F.col("end")).alias("end"))
    found = rows.join(F.broadcast(ranges), ["file", "range"])  # a row a range of 128 MB
    start = (F.col("h") + F.col("in")) % 2
    return found.select("file", "range", "at", "value", F.coalesce(F.col("at") == F.col("end"), F.lit(False)).alias("last"), "odd", start.alias("start"), (F.col("base") + F.when(F.col("h") == 0, F.col("c0")).otherwise(F.col("c1"))).alias("depth"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """The items of the list in a file, as rows (seq, item, is_object) with their JSON text, in file order.

    A file that is no JSON list, or ends before its list does, is a ValueError.
    """
    pieces = _pieces(spark, path)
    outside = (F.col("start") + F.col("odd")) % 2 == 0
    pieces = written(pieces.withColumns({"done": (~F.col("last") & outside & (F.col("depth") == 1)).cast("long"), "outside": outside}))
    counts = pieces.groupBy("file", "range").agg(F.sum("done").alias("n"))
    offset = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("file", "range", F.coalesce(F.sum("n").over(offset), F.lit(0)).alias("offset"))
    here = Window.partitionBy("file", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.join(F.broadcast(counts), ["file", "range"]).withColumn("object", F.col("offset") + F.coalesce(F.sum("done").over(here), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "at", "value"))), lambda p: p["value"]), "}")
    groups = placed.groupBy("file", "object").agg(text.alias("text"), F.max("done").alias("done"), F.max(F.when(F.col("last"), F.col("depth") + F.when(F.col("outside"), 1).otherwise(0))).alias("left"), F.max(F.when(F.col("last"), ~F.col("outside"))).alias("open"))
    body = strip(F.concat("text", F.when(F.col("done") == 1, "}").otherwise("")))
    # what stands before an object's items, and after the last one's
    head = F.when(F.col("object") == 0, "[").otherwise(",")
    rest = F.substr(body, F.lit(2))
    ended = F.when(F.col("done") == 1, F.concat(F.lit("["), rest, F.lit("]"))).when((F.col("object") > 0) & (body == "]"), "[]").otherwise(F.concat(F.lit("["), rest))
    good = F.when((F.col("object") > 0) & (F.col("done") == 0) & (body == "]"), True).otherwise(body.startswith(head) & F.when((F.col("object") > 0), strip(rest) != "]").otherwise(True))
    groups = written(groups.select("file", "object", ended.alias("list"), (good & F.try_parse_json(ended).isNotNull() & (F.coalesce("left", F.lit(0)) == 0) & ~F.coalesce("open", F.lit(False))).alias("good")))
    n, fine = groups.agg(F.count("*"), F.coalesce(F.every(F.coalesce("good", F.lit(False))), F.lit(False))).first()
    if not n or not fine:
        raise ValueError(f"{path} is not a JSON list")
    found = groups.select("file", "object", F.posexplode(F.from_json("list", "array<variant>")).alias("pos", "v"))
    found = found.select("file", "object", "pos", F.to_json("v").alias("item"), F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("is_object"))
    return numbered(found, "file", "object", "pos", name="seq").select("seq", "item", "is_object")
