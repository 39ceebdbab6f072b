"""Exact top-k inner products by best-first search in M-trees.

Vectors are integers (floor(256 * x)).  The rows are dealt to sampled pivots, PIVOTS at
most for a vector length, and a pivot's rows into trees of about TREE, so a tree covers a
ball.  A tree's leaves and inner nodes are pages: an entry holds its vector's distance
to the page's pivot, an inner entry also the radius that covers everything below it.
For a query q and an entry x of a page with pivot p::

    <q, x> = <q, p> + <q, x - p> <= <q, p> + |q| * d(x, p)

so stored parent distances bound scores before any product with x is made, and with a
subtree's radius r added, <q, x> + |q| * r bounds everything below.  Search takes pages
in order of their bounds and stops when the best bound left is below the k-th score.
A query is first searched in the tree with the best bound, then in all trees whose bound
reaches the k-th score found there; the k best of both are the answer.  Queries meet a tree
in blocks by (length, tree, block).  Every row is indexed and no candidate is skipped unbounded.

Defined results: vectors that are null, or hold null, NaN or infinite components, take
no part, nor do rows with null vec_id; vectors of different lengths are never compared;
a query's candidates exclude rows of its own vec_id; repeated rows are one; scores
outside 64 bits are at its limits; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

K, EVERY = 5, 50
#: Rows of a tree, about; entries of a page; queries of a block, about; pivots of a vector length at most.
TREE, PAGE, BLOCK, PIVOTS = 16_384, 128, 2048, 256
SEED = 3
LONG = 2**63 - 1


class Tree:
    """Pages of one tree, leaves first: pivots, radii, and the entries of each page with parent distances."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        #: page -> (pivot, rows or child pages, their parent distances, their radii; leaf?)
        self.pages: list[tuple] = []
        rng = np.random.default_rng(SEED)
        self.root = self._build(np.arange(len(ids)), rng) if len(ids) else None
        self.exact = len(ids) == 0 or float(np.abs(vectors).max()) ** 2 * max(1, vectors.shape[1]) < 2**50

    def _build(self, rows: np.ndarray, rng) -> int:
        x = self.vectors[rows]
        pivot = np.rint(x.mean(0))
        if len(rows) <= PAGE:
            order = np.argsort(d := np.sqrt(((x - pivot) ** 2).sum(1)), kind="stable")
            self.pages.append((pivot, rows[order], d[order], None, True, float(d.max())))
            return len(self.pages) - 1
        near = self._split(x, rng)
        children = [self._build(rows[near == i], rng) for i in np.unique(near)]
        centres = np.stack([self.pages[c][0] for c in children])
        d = np.sqrt(((centres - pivot) ** 2).sum(1))
        radii = np.array([self.pages[c][5] for c in children])
        cover = float(np.sqrt(((x - pivot) ** 2).sum(1)).max())
        self.pages.append((pivot, np.array(children), d, radii, False, cover))
        return len(self.pages) - 1

    @staticmethod
    def _split(x: np.ndarray, rng) -> np.ndarray:
        """Deal rows to near sampled pivots; rows that pivots can't tell apart are cut into runs."""
        n = min(PAGE, -(-len(x) * 2 // PAGE))
        pivots = x[rng.choice(len(x), max(2, n), replace=False)]
        for _ in range(2):
            near = ((pivots**2).sum(1)[None] - 2 * x @ pivots.T).argmin(1)
            kinds, near = np.unique(near, return_inverse=True)
            total = np.zeros((len(kinds), x.shape[1]))
            np.add.at(total, near, x)
            pivots = total / np.bincount(near)[:, None]
        if np.bincount(near).max() > 0.9 * len(x):
            return np.argsort(np.argsort(((x - x.mean(0)) ** 2).sum(1), kind="stable")) * 2 // len(x)
        return near

    def products(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self.exact:
            return (self.vectors[rows] @ q).astype(np.int64)
        whole = [int(v) for v in q]
        return np.array([max(-LONG - 1, min(LONG, sum(a * int(b) for a, b in zip(whole, self.vectors[r].tolist(), strict=True)))) for r in rows.tolist()], np.int64)

    def search(self, query_id: int, q: np.ndarray, k: int, least: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, vec_id) for q, by score, then smaller vec_id; scores under least need not be found."""
        if self.root is None:
            return []
        norm = float(np.sqrt(q @ q))
        slack = 1e-9 * (1 + norm)
        best: list[tuple[int, int]] = []  # a heap of (score, -vec_id)
        top = float(self.pages[self.root][0] @ q)
        heap = [(-np.inf, self.root, top)]
        while heap:
            bound, page, middle = heapq.heappop(heap)
            floor = max(least, best[0][0]) if len(best) == k else least
            if -bound + slack * abs(bound) + slack < floor:
                break
            _, entries, d, radii, leaf, _ = self.pages[page]
            limit = middle + norm * (d if leaf else d + radii)
            may = np.flatnonzero(limit * (1 + slack * np.sign(limit)) + 1 >= floor)
            if not len(may):
                continue
            if leaf:
                for score, i in zip(self.products(q, entries[may]).tolist(), self.ids[entries[may]].tolist(), strict=True):
                    if i != query_id and (len(best) < k or (score, -i) > best[0]):
                        (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (score, -i))
            else:
                children = entries[may]
                centres = np.stack([self.pages[c][0] for c in children.tolist()])
                middles = centres @ q
                upper = middles + norm * radii[may]
                for b, c, m in zip(upper.tolist(), children.tolist(), middles.tolist(), strict=True):
                    heapq.heappush(heap, (-b, c, m))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def integers(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, v): the integer vectors that take part, each once."""
    fit = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    return rows.where(fit & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), whole.alias("v")).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _plant(group: pa.Table) -> pa.Table:
    group = group.combine_chunks().sort_by("vec_id").combine_chunks()
    tree = Tree(group["vec_id"].to_numpy(), _matrix(group["v"].combine_chunks()))
    pivot, *_, cover = tree.pages[tree.root]
    return pa.table({"dim": group["dim"].slice(0, 1), "tree": group["tree"].slice(0, 1), "centre": pa.array([pivot], pa.list_(pa.float64())), "cover": pa.array([cover]), "pages": pa.array([pickle.dumps(tree.__dict__)], pa.binary())})


def build(vectors: DataFrame) -> DataFrame:
    """The index: rows (dim, tree, centre, cover, pages), a tree each."""
    vectors = vectors.withColumn("dim", F.size("v"))
    sizes = vectors.groupBy("dim").count().where(F.col("count") > TREE).collect()  # a row a vector length with more than a tree
    pivots = {}
    for dim, n in sizes:
        some = vectors.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id")).limit(min(PIVOTS, -(-n // TREE))).select("v").collect()
        pivots[dim] = np.array([r[0] for r in some])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, pivot = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for dim in np.unique(dims).tolist():
                if dim in pivots:
                    at = np.flatnonzero(dims == dim)
                    x, p = _matrix(batch.column("v").take(pa.array(at))), pivots[dim]
                    pivot[at] = ((p * p).sum(1)[None] - 2 * x @ p.T).argmin(1)
            yield batch.append_column("pivot", pa.array(pivot))

    dealt = vectors.select("dim", "vec_id", "v").mapInArrow(near, "dim int, vec_id long, v array<double>, pivot long")
    parts = dealt.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / TREE).alias("parts"))
    dealt = dealt.join(parts, ["dim", "pivot"]).select("dim", (F.col("pivot") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), "parts")).alias("tree"), "vec_id", "v")
    return cut(dealt.groupBy("dim", "tree").applyInArrow(_plant, "dim int, tree long, centre array<double>, cover double, pages binary"))


def _meet(key, queries: pa.Table, trees: pa.Table) -> pa.Table:
    """The k best of one tree for each query of a block."""
    if not trees.num_rows or not queries.num_rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
    queries = queries.combine_chunks()
    tree = Tree.__new__(Tree)
    tree.__dict__ = pickle.loads(trees["pages"][0].as_py())
    ids, vectors = queries["vec_id"].to_numpy(), _matrix(queries["v"].combine_chunks())
    out = [(q, v, s) for q, x, least, k in zip(ids.tolist(), vectors, queries["least"].to_numpy().tolist(), queries["k"].to_pylist(), strict=True) for s, v in tree.search(q, x, k, least)]
    columns = zip(*out, strict=True) if out else ((), (), ())
    return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(c, pa.int64()) for c in columns), strict=True)))


def _found(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score): the k best of the tree for each row (dim, tree, vec_id, v, least)."""
    blocks = asked.groupBy("dim", "tree").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    trees = index.select("dim", "tree", "pages").join(blocks, ["dim", "tree"]).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    asked = asked.join(blocks, ["dim", "tree"]).withColumns({"block": F.pmod(F.xxhash64("vec_id"), "blocks"), "k": F.lit(k)})
    keys = ["dim", "tree", "block"]
    return asked.select(*keys, "vec_id", "v", "least", "k").groupBy(*keys).cogroup(trees.select(*keys, "pages").groupBy(*keys)).applyInArrow(_meet, "query_id long, vec_id long, score long")


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best rows of each query (vec_id, v)."""
    salts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    balls = index.select("dim", "tree", "centre", "cover").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = queries.withColumns({"dim": F.size("v"), "salt": F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")})
    dot = F.expr("aggregate(zip_with(v, centre, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    norm = F.sqrt(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)"))
    bound = dot + norm * F.col("cover")
    bounds = cut(salted.join(balls, ["dim", "salt"]).select("dim", "vec_id", "tree", (bound + 1 + 1e-9 * F.abs(bound)).alias("bound")))
    best = bounds.groupBy("dim", "vec_id").agg(F.max_by("tree", F.struct("bound", "tree")).alias("tree"))
    vectors = queries.withColumn("dim", F.size("v"))
    first = cut(_found(index, vectors.join(best, ["dim", "vec_id"]).withColumn("least", F.lit(float("-inf"))), k))
    least = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("least"))
    others = bounds.join(best.withColumnRenamed("tree", "t"), ["dim", "vec_id"]).where("tree != t").join(least, "vec_id", "left")
    others = others.withColumn("least", F.coalesce("least", F.lit(float("-inf")))).where("bound >= least").select("dim", "vec_id", "tree", "least")
    found = first.unionByName(_found(index, others.join(vectors, ["dim", "vec_id"]), k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, k: int = K) -> DataFrame:
    """The k best of every row whose vec_id is divisible by EVERY, against all rows."""
    vectors = cut(integers(rows))
    return search(build(vectors), vectors.where(F.col("vec_id") % EVERY == 0), k)


ORACLE = f"""
with v as (
    select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::double) as v from embeddings
    where embedding is not null and vec_id is not null
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
    from v q join v c on q.vec_id != c.vec_id and len(q.v) = len(c.v) where q.vec_id % {EVERY} = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= {K}
"""
