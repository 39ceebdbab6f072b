"""Work folder, lineage cuts, connected components and clustering of sets that share a bucket."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder in /tmp only where none is set and the master is local, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file:///tmp/gleaner-work"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{work_dir(spark)}/{kind}-{uuid.uuid4().hex}"


#: Setting that removes a query's shuffle files when it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written in the shared folder; ``clear`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame) -> DataFrame:
        self.paths.append(fresh_dir(self.spark, "cut"))
        # once df is written nothing reads its shuffle files again
        was = self.spark.conf.get(FREE, "false")
        self.spark.conf.set(FREE, "true")
        try:
            df.write.parquet(self.paths[-1])
        finally:
            self.spark.conf.set(FREE, was)
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        for name in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: a lineage cut that survives executors."""
    return Scratch(df.sparkSession).cut(df)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, component), component the least id.

    Alternating large-star and small-star contractions.  Each is one shuffle by vertex and a
    window minimum, which spills where a vertex has many edges; the edge table is written
    between rounds.  Ends when a round changes nothing.
    """
    spark = edges.sparkSession
    least = F.expr("min(b) over (partition by a)")
    now, state = Scratch(spark), None
    edges = now.cut(edges.where("a != b").selectExpr("greatest(a, b) a", "least(a, b) b"))
    while True:
        both = edges.unionAll(edges.selectExpr("b a", "a b")).repartition("a").distinct()
        large = both.select("a", "b", F.least("a", least).alias("m")).where("b > a").selectExpr("b a", "m b")
        starred = large.repartition("a").distinct().select("a", "b", least.alias("m"))
        old, now = now, Scratch(spark)
        edges = now.cut(starred.selectExpr("inline(if(b = m, array(struct(a, m b)), array(struct(b a, m b))))"))
        old.clear()
        was, state = state, edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == state or not state[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(edges.selectExpr("b id", "b component")).distinct()


class Joined:
    """Union-find over components that links join; edges give each with the least it is joined with."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, i: int) -> int:
        while (j := self.up.get(i, i)) != i:
            self.up[i] = i = self.up.get(j, j)
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.top(i), self.top(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def edges(self) -> list[tuple[int, int]]:
        return [(i, self.top(i)) for i in self.up]


#: Members and total set size of one block; heads that members of a bucket are tried with first, and of a bucket of at
#: most FEW; total set size compared at once.
BLOCK_ROWS, BLOCK_SIZE, HEADS, FEW, AT_ONCE = 256, 250_000, 3, 16, 500_000
#: Members of a group whose pairs are listed, and pairs whose bounds are computed at once.
SMALL, PAIRS = 64, 100_000
Compare = Callable[[pa.RecordBatch], tuple[Callable[[np.ndarray, np.ndarray], np.ndarray], Callable[[int, int], bool]]]


def cluster(buckets: DataFrame, bodies: Callable[[DataFrame], DataFrame], compare: Compare) -> DataFrame:
    """Components of the links among members that share a bucket: rows (id, component).

    ``buckets``: rows (key, id).  ``bodies`` gives, for rows (id), rows (id, size, ...) with
    what ``compare`` needs to know of members: from a batch of such rows it makes a function
    that tells of many pairs of rows which may be linked, and one that tells it of a pair.

    Two steps find the components without listing a bucket's pairs.  First each member is
    tried with its bucket's heads, those least by HEADS hashes of the id (one in a small
    bucket), so that buckets of one group mostly have the same heads and a large group of near
    copies costs its size a few times.  Then only buckets whose members are still of several components are open:
    their members are taken together by least component, and what differs in component is
    compared in pairs of blocks.  Members reach either comparison in blocks of bounded size,
    sorted and streamed; no pair is a row before it is confirmed, and no pair that could join
    two components is left out, so components equal those of all pairs that share a bucket.
    """
    spark = buckets.sparkSession
    scratch = Scratch(spark)
    # the join's own null filter would make another plan, and a second shuffle, of the same rows
    keyed = buckets.where("key is not null").repartition("key")
    several = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("key", "n")
    shared = keyed.join(several.hint("shuffle_hash"), "key")
    heads = F.array(*(F.expr(f"min_by(id, xxhash64(id, {i})) over (partition by key)") for i in range(HEADS)))
    shared = scratch.cut(shared.select("key", "id", F.array_distinct(F.slice(heads, 1, F.when(F.col("n") <= FEW, 1).otherwise(HEADS))).alias("h")))
    body = scratch.cut(bodies(shared.select("id").distinct()))

    def compared(rows: DataFrame) -> DataFrame:
        """Edges (a, b) that join what links join, from rows (grp, lo, hi, blk, id, c) of the block pairs lo and hi."""
        whole = rows.join(body, "id").repartition("grp", "lo", "hi").sortWithinPartitions("grp", "lo", "hi")
        return whole.mapInArrow(lambda batches: _compared(batches, compare), "a long, b long")

    spokes = scratch.cut(shared.select(F.explode("h").alias("grp"), "id").where("grp != id").distinct())
    parts = _parts(spokes.join(body.select("id", "size"), "id"))
    dealt = spokes.join(parts, "grp").selectExpr("grp", "-1 lo", "cast(pmod(xxhash64(id), parts) as int) hi", "id", "id c")
    hubs = parts.selectExpr("grp", "-1 lo", "explode(sequence(0, parts - 1)) hi", "grp id", "grp c")
    rows = dealt.withColumn("blk", F.col("hi")).unionByName(hubs.withColumn("blk", F.lit(-1)))
    found = scratch.cut(components(compared(rows)))

    member = shared.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    open_ = member.groupBy("key").agg(F.min("c").alias("grp"), F.max("c").alias("hi")).where("grp != hi").select("key", "grp")
    rest = scratch.cut(member.join(open_, "key").select("grp", "id", "c").distinct())
    rows = rest.join(_parts(rest.join(body.select("id", "size"), "id")), "grp").withColumn("blk", F.expr("cast(pmod(xxhash64(id), parts) as int)"))
    rows = rows.withColumn("o", F.explode(F.expr("sequence(0, parts - 1)"))).selectExpr("grp", "least(blk, o) lo", "greatest(blk, o) hi", "blk", "id", "c")
    joined = cut(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(compared(rows))))
    scratch.clear()
    return joined


def _compared(batches: Iterator[pa.RecordBatch], compare) -> Iterator[pa.RecordBatch]:
    """Edges from the block pairs that come one after another in sorted batches."""
    left: list[pa.RecordBatch] = []
    keys = ["grp", "lo", "hi"]
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        if last is not None and any(k[0] != was for k, was in zip(key, last, strict=True)):
            yield from _block_pairs(left, compare)
            left = []
        if len(new):
            yield from _block_pairs([*left, batch.slice(0, int(new[-1]))], compare)
            left, batch = [], batch.slice(int(new[-1]))
        left.append(batch)
        last = [k[-1] for k in key]
    if left:
        yield from _block_pairs(left, compare)


def _block_pairs(rows: list[pa.RecordBatch], compare) -> Iterator[pa.RecordBatch]:
    whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    key = [whole.column(k).to_numpy() for k in ("grp", "lo", "hi")]
    ends = np.append(np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1, whole.num_rows)
    total = np.cumsum(whole.column("size").to_numpy() + 1)[ends - 1]
    first = 0
    while first < len(ends):
        base, start = (total[first - 1], int(ends[first - 1])) if first else (0, 0)
        stop = max(first + 1, int(np.searchsorted(total, base + AT_ONCE, "right")))
        part = whole.slice(start, int(ends[stop - 1]) - start)
        (may, linked), (lo, hi, side) = compare(part), (part.column(k).to_numpy() for k in ("lo", "hi", "blk"))
        ids, c, out = part.column("id").to_numpy(), part.column("c").to_numpy().copy(), []
        bounds = np.append(0, ends[first:stop] - start)
        if lo[0] < 0:  # heads and their members
            hubs = np.flatnonzero(side < 0)
            x = np.repeat(hubs, np.diff(bounds)[np.searchsorted(bounds, hubs, "right") - 1])
            y = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in np.searchsorted(bounds, hubs, "right") - 1])
            x, y = (v[(side[y] >= 0) & (ids[x] != ids[y])] for v in (x, y))
            good = may(x, y)
            out = [(int(ids[i]), int(ids[j])) for i, j in zip(x[good].tolist(), y[good].tolist(), strict=True) if linked(i, j)]
        else:
            joined, x, y = Joined(), [], []
            for a, b in itertools.pairwise(bounds.tolist()):
                if lo[a] == hi[a] and b - a <= SMALL:  # all its pairs at once, with those of other small groups
                    i, j = np.triu_indices(b - a, 1)
                    x.append(a + i)
                    y.append(a + j)
                    continue
                xs, ys = (a + np.flatnonzero(side[a:b] == k[a]) for k in (lo, hi))
                for i in xs.tolist():
                    j = ys[ys > i] if lo[a] == hi[a] else ys
                    j = j[c[j] != c[i]]
                    for k in j[may(np.full(len(j), i), j)].tolist() if len(j) else ():
                        if c[k] != c[i] and linked(i, k):
                            joined.link(int(c[i]), int(c[k]))
                            c[a:b][c[a:b] == c[k]] = c[i]
            if x:
                x, y = np.concatenate(x), np.concatenate(y)
                x, y = (v[c[x] != c[y]] for v in (x, y))
                for k in range(0, len(x), PAIRS):
                    good = np.flatnonzero(may(x[k : k + PAIRS], y[k : k + PAIRS])) + k
                    for i, j in zip(x[good].tolist(), y[good].tolist(), strict=True):
                        if joined.top(int(c[i])) != joined.top(int(c[j])) and linked(i, j):
                            joined.link(int(c[i]), int(c[j]))
            out = joined.edges()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["a", "b"])
        first = stop


def _parts(rows: DataFrame) -> DataFrame:
    """Rows (grp, parts): in how many blocks each group's members (grp, id, size) are dealt."""
    return rows.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_SIZE), F.lit(1)).cast("int").alias("parts"))
