"""Bounded fair expansion of seeds over the entity index, for one query or many.

Each frontier row has one candidate list: its article's chunks, then those sharing a
concept, then semantic neighbours.  A query's lists are read column by column until its budget
is used up, so one long list can't use it up alone; a chunk is taken at its first place.

Of each part of a list only so many chunks can be reached as the budget and what the query has taken
already, so an article's or a concept's chunks are cut to their first ones before they meet
the frontier: a concept that a million chunks share costs one pass over them, and no
row for each that asks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.storage import written

from .skew import SHARE, meet

#: Frontier rows that may be broadcast; larger ones are joined by shuffles.
FEW = 10_000
#: Buckets of articles; one with more rows than CROWD and than a SHAREth of all holds an article that no single task should.
BUCKETS, CROWD = 65_536, 20_000
#: Chunks of a task, about, that find their kin, so its memory does not grow with the table.
CHUNKS = 250_000


def kinship(clause: Column, point: Column, own_clause: Column) -> Column:
    """How closely a sibling encloses a chunk: 0 heading, 1 its clause's stem, 2 its clause's points, 3 the rest."""
    same = clause.eqNullSafe(own_clause)
    return F.when(clause.isNull() & point.isNull(), 0).when(same & point.isNull(), 1).when(same, 2).otherwise(3)


def first_of(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """Each group's first ``most`` rows by seq; a partial limit keeps as many from each task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "cid"))
    return rows.withColumn("__n", place).where(F.col("__n") <= most).drop("__n")


def nearest_kin(chunks: DataFrame, most: int) -> DataFrame:
    """Rows (src, dst, kin, rank): the ``most`` nearest kin of each chunk in its article, itself among them, in order of degree, then seq.

    An article's chunks meet its first ones of each degree, ``most`` of each and 2 * most of the rest, not each other.
    They meet where one shuffle by article puts them; only chunks in buckets of crowded articles meet by joins.
    A chunk without document or article has no kin.
    """
    rows = chunks.where("document_id is not null and coalesce(article, '') != ''").select("document_id", "article", "chunk_id", "clause", "point", "seq")
    bucket = F.pmod(F.xxhash64("document_id", "article"), F.lit(BUCKETS))
    sizes = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))  # BUCKETS rows at most
    total = sizes.agg(F.sum("n")).first()[0] or 0
    crowded = [r["bucket"] for r in sizes.where(F.col("n") > max(CROWD, total // SHARE)).collect()]  # fewer than SHARE
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-total // CHUNKS))  # a number, so they are not joined by their compressed size
    if not crowded:
        return _kin_in_place(rows, most, tasks)
    apart = bucket.isin(*crowded)
    return _kin_in_place(rows.where(~apart), most, tasks).unionByName(_kin_by_joins(rows.where(apart), most))


def _kin_in_place(rows: DataFrame, most: int, tasks: int) -> DataFrame:
    """nearest_kin by windows over one shuffle by article."""
    art, clause = ["document_id", "article"], ["document_id", "article", "clause"]
    kind = F.when(F.col("point").isNotNull(), 2).when(F.col("clause").isNotNull(), 1).otherwise(0)
    # places in the article, then among those of its kind in its clause; the collections find the second order as it is
    dealt = rows.repartition(tasks, *art).withColumn("kind", kind).withColumn("m", F.row_number().over(Window.partitionBy(*art).orderBy("seq", "chunk_id")))
    dealt = dealt.withColumn("n", F.row_number().over(Window.partitionBy(*clause, "kind").orderBy("seq", "chunk_id")))
    same = Window.partitionBy(*clause, "kind", "seq", "chunk_id")
    dealt = dealt.withColumns({"copies": F.count("*").over(same), "first": F.min("n").over(same)})
    entry = F.struct("seq", F.col("chunk_id").alias("dst"), "clause", "point")
    few = lambda which: F.collect_list(F.when(which, entry))
    head, own, rest = few((F.col("kind") == 0) & (F.col("n") <= most)), few((F.col("kind") > 0) & (F.col("n") <= most)), few(F.col("m") <= 2 * most)
    whole = Window.partitionBy(*art)
    dealt = dealt.withColumns({"head": head.over(whole), "rest": rest.over(whole), "own": own.over(Window.partitionBy(*clause))})
    degree = lambda e: kinship(e["clause"], e["point"], F.col("clause"))
    shown = lambda e: F.struct(degree(e).alias("kin"), e["seq"].alias("seq"), e["dst"].alias("dst"))
    far = F.filter("rest", lambda e: degree(e) == 3)
    near = F.slice(F.array_sort(F.transform(F.concat("head", "own", far), shown)), 1, most)
    # copies of a chunk ask as one chunk, which has each of its kin as often
    near = F.when(F.col("copies") == 1, near).otherwise(F.slice(F.flatten(F.transform(near, lambda e: F.array_repeat(e, F.col("copies").cast("int")))), 1, most))
    found = dealt.where("n = first").select(F.col("chunk_id").alias("src"), F.posexplode(near).alias("rank", "e"))
    return found.select("src", "e.dst", "e.kin", (F.col("rank") + 1).alias("rank"))


def _kin_by_joins(rows: DataFrame, most: int) -> DataFrame:
    """nearest_kin by joins that spread the chunks of one article over tasks."""
    art = ["document_id", "article"]
    c = rows.select(*art, F.col("chunk_id").alias("cid"), "clause", "point", "seq")
    entry = F.struct("seq", F.col("cid").alias("dst"), "clause", "point")

    def lists(own: DataFrame, n: int, name: str, *by: str) -> DataFrame:
        """A row a group: its first n chunks as an array, and how many chunks there are to meet it."""
        first = first_of(own, n, *by).groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias(name))
        sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
        return first.join(sizes, _alike(first, sizes, by)).select(F.struct(*(first[b] for b in by)).alias("group"), name, "n")

    asks = rows.select("chunk_id", F.struct(*art).alias("by_article"), F.struct(*art, "clause").alias("by_clause"), F.col("clause").alias("own"))
    head = lists(c.where("clause is null and point is null"), most, "found", *art)
    stem = lists(c.where("clause is not null and point is null"), most, "found", *art, "clause")
    point = lists(c.where("point is not null"), most, "found", *art, "clause")
    rest = lists(c, 2 * most, "found", *art)
    met = []
    for kin, (facts, key) in enumerate([(head, "by_article"), (stem, "by_clause"), (point, "by_clause"), (rest, "by_article")]):
        got = meet(asks, written(facts.withColumnRenamed("group", key)), key).select("chunk_id", "own", F.explode("found").alias("e"))
        met.append(got.where(kinship(F.col("e.clause"), F.col("e.point"), F.col("own")) == kin).select(F.col("chunk_id").alias("src"), "e.dst", F.lit(kin).alias("kin"), "e.seq"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("kin", "seq", "dst"))
    every = met[0].unionByName(met[1]).unionByName(met[2]).unionByName(met[3])
    return every.withColumn("rank", rank).where(F.col("rank") <= most).select("src", "dst", "kin", "rank")


def _alike(a: DataFrame, b: DataFrame, names: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, (a[n].eqNullSafe(b[n]) for n in names))


def siblings(frontier: DataFrame, chunks: DataFrame, most: int, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (query_id, idx, cid, o1, o2): chunks of the article of each frontier row, nearest kin first, at least ``most`` of each degree if there are."""
    art = ["document_id", "article"]
    f = frontier.where("coalesce(article, '') != ''").select("query_id", "idx", *art, F.col("clause").alias("own"))
    c = chunks.select(*art, F.col("chunk_id").alias("cid"), "clause", "point", "seq")
    near = written(c.join(small(f.select(*art).distinct()), art, "left_semi"))
    head, stem = near.where("clause is null and point is null"), near.where("clause is not null and point is null")
    same = lambda rows: rows.join(small(f), (rows["document_id"] == f["document_id"]) & (rows["article"] == f["article"]) & rows["clause"].eqNullSafe(f["own"]))
    pick = lambda rows, kin: rows.select("query_id", "idx", "cid", F.lit(kin).cast("long").alias("o1"), F.col("seq").cast("long").alias("o2"))
    # where fewer than ``most`` are nearer, as many of the first 2 * most chunks are of the rest, or all
    rest = first_of(near, 2 * most, *art).join(small(f), art).where(kinship(F.col("clause"), F.col("point"), F.col("own")) == 3)
    lists = pick(first_of(head, most, *art).join(small(f), art), 0).unionByName(pick(same(first_of(stem, most, *art, "clause")), 1))
    return lists.unionByName(pick(same(first_of(near.where("point is not null"), most, *art, "clause")), 2)).unionByName(pick(rest, 3))


def concept_list(frontier: DataFrame, keys: DataFrame, most: int, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (query_id, idx, cid, o1, o2): the first ``most`` chunks of each concept of a frontier row, a chunk by its first concept."""
    concept = keys.where(F.col("key").startswith("concept::"))
    own = concept.join(small(frontier.select("query_id", "idx", "chunk_id")), "chunk_id").select("query_id", "idx", "key", "key_pos")
    wanted = concept.select("key", F.col("chunk_id").alias("cid"), "seq").join(small(own.select("key").distinct()), "key", "left_semi")
    found = first_of(wanted, most, "key").join(small(own), "key")
    first = found.groupBy("query_id", "idx", "cid").agg(F.min(F.struct("key_pos", "seq")).alias("o"))
    return first.select("query_id", "idx", "cid", F.col("o.key_pos").cast("long").alias("o1"), F.col("o.seq").cast("long").alias("o2"))


def at_least(edges: DataFrame, min_sim: float) -> DataFrame:
    """Stored edges that count at a query's least similarity."""
    return edges.where(F.col("sim") >= min_sim)


def semantic_list(frontier: DataFrame, edges: DataFrame, min_sim: float, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    found = at_least(edges, min_sim).join(small(frontier.select("query_id", "idx", F.col("chunk_id").alias("src"))), "src")
    return found.select("query_id", "idx", F.col("dst").alias("cid"), F.col("rank").cast("long").alias("o1"), F.lit(0).cast("long").alias("o2"))


def expand_many(seeds: DataFrame, chunks: DataFrame, max_extra: int = 10, hops: int = 1, keys: DataFrame | None = None, edges: DataFrame | None = None, min_sim: float = 0.0) -> DataFrame:
    """Each query's seeds (query_id, chunk_id, ord), then at most max_extra chunks reached in ``hops`` steps: rows (query_id, chunk_id, hop, ord).

    ``chunks`` holds each chunk_id once, ``keys`` are theirs.  Seeds and each hop are written, so a hop's plan
    starts from a table and its size is known: a frontier of at most FEW rows is broadcast.
    """
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "chunk_id"))
    taken = written(seeds.select("query_id", "chunk_id", F.lit(0).alias("hop"), order.cast("long").alias("ord")))
    max_extra = max(max_extra, 0)
    place = Window.partitionBy("query_id", "idx").orderBy("kind", "o1", "o2", "cid")
    for hop in range(1, max(hops, 0) + 1):
        rows, longest = taken.groupBy("query_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
        small = F.broadcast if rows <= FEW else lambda df: df
        most = max_extra + longest
        last = taken.where(F.col("hop") == hop - 1).select("query_id", "chunk_id", F.col("ord").alias("idx"))
        frontier = chunks.join(small(last), "chunk_id").select("query_id", "idx", "chunk_id", "document_id", "article", "clause")
        frontier = written(frontier)
        lists = siblings(frontier, chunks, most, small).withColumn("kind", F.lit(0))
        if keys is not None:
            lists = lists.unionByName(concept_list(frontier, keys, most, small).withColumn("kind", F.lit(1)))
        if edges is not None:
            lists = lists.unionByName(semantic_list(frontier, edges, min_sim, small).withColumn("kind", F.lit(2)))
        placed = lists.select("query_id", "cid", "idx", F.row_number().over(place).alias("pos"))
        first = placed.groupBy("query_id", "cid").agg(F.min(F.struct("pos", "idx")).alias("o"))
        new = first.join(taken.select("query_id", F.col("chunk_id").alias("cid")), ["query_id", "cid"], "left_anti")
        known = chunks.select(F.col("chunk_id").alias("cid"))
        if edges is not None:  # siblings and concepts come from chunks
            new = new.join(known, "cid", "left_semi")
        number = F.row_number().over(Window.partitionBy("query_id").orderBy("o"))
        new = new.withColumn("n", number).where(F.col("n") <= max_extra).select("query_id", F.col("cid").alias("chunk_id"), F.lit(hop).alias("hop"), F.col("n").cast("long").alias("ord"))
        extras = taken.where("hop > 0").unionByName(new)
        extras = extras.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "ord"))).where(F.col("n") <= max_extra).drop("n")
        taken = taken.where("hop = 0").unionByName(extras)
        if hop < hops:
            taken = written(taken)
    return taken


def expand(seeds: DataFrame, chunks: DataFrame, max_extra: int = 10, hops: int = 1, keys: DataFrame | None = None, edges: DataFrame | None = None, min_sim: float = 0.0) -> DataFrame:
    """The expansion of one query's seeds (chunk_id, ord): rows (chunk_id, hop, ord)."""
    return expand_many(seeds.withColumn("query_id", F.lit(0)), chunks, max_extra, hops, keys, edges, min_sim).drop("query_id")
