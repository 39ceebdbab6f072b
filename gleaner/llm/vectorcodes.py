"""Vector compression: product codes from codebooks searched by kd-trees.

Vectors are integers (floor(256 * x)), cut into PARTS consecutive parts.  Each part has a
codebook of at most ENTRIES entries, at first the parts of the first vectors by vec_id.  A
round broadcasts a kd-tree for each codebook; tasks find the nearest entry of every part
of their vectors and add the parts up, entry by entry, and Spark adds the tasks' sums up.
An entry becomes the floor of its parts' mean; an entry that no part has stays.

A kd-tree's nodes hold the box of their entries.  The search is branch and bound, for all
rows of a batch together: a row goes into the nearer child first, then into the other one
unless its box is farther than the row's best distance.  A box *as* far is visited too, as it may
hold an entry of the same distance and a lower index, which wins.

Only codebooks pass the driver, ENTRIES rows of a vector's length.  ``rows`` is read once
for the first entries, once a round and once for the codes.

Defined results: vectors that are null, or hold null, NaN or infinite components, are
dropped; all vectors share codebooks, so vectors of another length than most have (the
shorter one, if lengths are as frequent) get null code and error; part p of a vector of
length n holds components p * n // PARTS up to (p + 1) * n // PARTS; a null vec_id comes last; repeated
rows each count; of rows alike in vec_id the lesser vector comes first; integers, errors and
their sums outside 64 bits are at its limits; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.skew import meet

from .shared import cut

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries of a kd-tree's leaf, at most; rows searched at once.
LEAF, ROWS = 8, 4096
LONG = 2**63 - 1


class KdTree:
    """A kd-tree over the entries of a codebook; indexes of a leaf are in order."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray):
        points = self.entries[own]
        lo, hi = points.min(0), points.max(0)
        wide = hi - lo
        if len(own) <= LEAF or not len(wide) or not wide.any():
            return lo, hi, np.sort(own), None, None
        order = own[np.argsort(points[:, int(np.argmax(wide))], kind="stable")]
        half = len(order) // 2
        return lo, hi, None, self._node(order[:half]), self._node(order[half:])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry, of equal ones that with the lowest index, and its squared distance."""
        best = np.full(len(x), len(self.entries), np.int64)
        far = np.full(len(x), np.iinfo(np.int64).max, x.dtype) if x.dtype != object else np.array([float("inf")] * len(x), object)
        self._search(self.root, x, np.arange(len(x)), best, far)
        return best, far

    @staticmethod
    def _gap(node, x: np.ndarray) -> np.ndarray:
        """The squared distance of rows from a node's box."""
        out = np.maximum(np.maximum(node[0] - x, x - node[1]), 0)
        return (out * out).sum(1)

    def _search(self, node, x, rows, best, far) -> None:
        if not len(rows):
            return
        _, _, own, left, right = node
        if own is not None:
            for k in own.tolist():
                d = x[rows] - self.entries[k]
                d = (d * d).sum(1)
                nearer = (d < far[rows]) | ((d == far[rows]) & (k < best[rows]))
                at = rows[nearer.astype(bool)]
                best[at], far[at] = k, d[nearer.astype(bool)]
            return
        a, b = self._gap(left, x[rows]), self._gap(right, x[rows])
        first = (a <= b).astype(bool)
        one, other = rows[first], rows[~first]
        self._search(left, x, one, best, far)
        again = one[(b[first] <= far[one]).astype(bool)]
        self._search(right, x, np.concatenate([other, again]), best, far)
        self._search(left, x, other[(a[~first] <= far[other]).astype(bool)], best, far)


class Codebooks:
    """The codebooks of all parts with their kd-trees; entries are Python integers where 64 bits could overflow."""

    def __init__(self, size: int, entries: list[list[list[int]]]):
        self.size = size
        self.entries = entries  # part -> entry -> components
        self.bounds = [p * size // PARTS for p in range(PARTS + 1)]
        widest = max([1, *(self.bounds[p + 1] - self.bounds[p] for p in range(PARTS))])
        #: Components below this leave squared distances, and their sum over the parts, in 64 bits.
        self.small = int((2**62 / (PARTS * widest)) ** 0.5 / 2)
        flat = [abs(c) for part in entries for e in part for c in e]
        self.plain = max(flat, default=0) < self.small
        self.trees = {kind: self._trees(kind) for kind in ([np.int64, object] if self.plain else [object])}

    def _trees(self, kind) -> list[KdTree]:
        return [KdTree(np.array(part, kind).reshape(len(part), self.bounds[p + 1] - self.bounds[p])) for p, part in enumerate(self.entries)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Of int64 vectors the entry of each part (a row a vector), and the error of each vector."""
        kind = np.int64 if self.plain and (not x.size or (-self.small < x.min() and x.max() < self.small)) else object
        x = x.astype(kind)
        found = [tree.nearest(np.ascontiguousarray(x[:, self.bounds[p] : self.bounds[p + 1]])) for p, tree in enumerate(self.trees[kind])]
        return np.stack([f[0] for f in found], 1), [min(LONG, int(e)) for e in sum(f[1] for f in found)]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(c) for part in self.entries for e in part for c in e).encode()).hexdigest()


def integers(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, label, v): the vectors that take part, as integers."""
    fit = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return rows.where(fit).select("vec_id", "label", whole.alias("v"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ROWS vectors of one length, with their matrix; others are left out."""
    for batch in batches:
        column = batch.column("v")
        fit = batch.filter(pa.array(np.diff(column.offsets.to_numpy()) == size)) if batch.num_rows else batch
        for at in range(0, fit.num_rows, ROWS):
            part = fit.slice(at, ROWS)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, size)


def first_entries(vectors: DataFrame) -> Codebooks | None:
    """Codebooks of the first ENTRIES vectors of the commonest length; None without vectors."""
    lengths = vectors.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if lengths is None:
        return None
    size = lengths["size"]
    first = vectors.where(F.size("v") == size).orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    return Codebooks(size, [[r["v"][p * size // PARTS : (p + 1) * size // PARTS] for r in first] for p in range(PARTS)])


def improved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after a round: each entry the floor of the mean of the parts that are nearest to it."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        n = len(books.entries[0])
        count = np.zeros((PARTS, n), np.int64)
        # halves of 32 bits, so that a task's sums of 2^31 rows and of any components stay in 64 bits
        high, low = np.zeros((n, books.size), np.int64), np.zeros((n, books.size), np.int64)
        for _, x in _blocks(batches, books.size):
            codes, _ = books.assign(x)
            for p in range(PARTS):
                a, b = books.bounds[p], books.bounds[p + 1]
                count[p] += np.bincount(codes[:, p], minlength=n)
                np.add.at(high[:, a:b], codes[:, p], x[:, a:b] >> 32)
                np.add.at(low[:, a:b], codes[:, p], x[:, a:b] & 0xFFFFFFFF)
        part, entry = np.nonzero(count)
        for p, e in zip(part.tolist(), entry.tolist(), strict=True):
            a, b = books.bounds[p], books.bounds[p + 1]
            k = max(1, b - a)
            columns = [np.full(k, p), np.full(k, e), np.arange(k), np.full(k, count[p, e]), high[e, a:b] if b > a else np.zeros(1, np.int64), low[e, a:b] if b > a else np.zeros(1, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "pos", "n", "high", "low"])

    added = vectors.select("v").mapInArrow(sums, "part long, entry long, pos long, n long, high long, low long")
    wide = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")]
    found = added.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), *wide).collect()  # a row a component of an entry
    sent.unpersist()
    entries = [[list(e) for e in part] for part in books.entries]
    for r in found:
        if r["pos"] < len(entries[r["part"]][r["entry"]]):
            entries[r["part"]][r["entry"]][r["pos"]] = ((int(r["high"]) << 32) + int(r["low"])) // r["n"]
    return Codebooks(books.size, entries)


def coded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (vec_id, label, code, error), one for each vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        digits = np.frombuffer(b"0123456789abcdef", np.uint8)
        for part, x in _blocks(batches, books.size):
            codes, error = books.assign(x)
            text = np.stack([digits[codes >> 4], digits[codes & 15]], 2).reshape(len(x), -1)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([t.tobytes().decode() for t in text]), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    odd = vectors.where(F.size("v") != books.size).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return vectors.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long").unionByName(odd)


def bounded(total: Column) -> Column:
    return F.when(total > LONG, F.lit(LONG)).otherwise(total.cast("long"))


def compress(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256) of embeddings (vec_id, embedding, label)."""
    vectors = integers(rows)
    books = first_entries(vectors)
    if books is None:
        return vectors.select("vec_id", *(F.lit(None).cast(kind).alias(c) for c, kind in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    for _ in range(rounds):
        books = improved(vectors, books)
    found = cut(coded(vectors, books))
    sums = cut(found.groupBy("label").agg(F.count("*").alias("n"), bounded(F.sum(F.col("error").cast("decimal(28,0)"))).alias("label_error")))
    return meet(found, sums, "label").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL, for vectors of one length."""
    parts = f"""
v as materialized (
    select row_number() over (order by vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint)) as r, vec_id, label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), x as materialized (select r, p, v[len(v) * p // {PARTS} + 1 : len(v) * (p + 1) // {PARTS}] as x from v, range({PARTS}) t(p)),
b0 as materialized (select p, r - 1 as k, x as c from x where r <= {ENTRIES})"""
    near = lambda i: f"""
a{i} as materialized (
    select r, p, min(d * {ENTRIES} + k) // {ENTRIES} as d, min(d * {ENTRIES} + k) % {ENTRIES} as k from (
        select r, x.p, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from x join b{i} b on x.p = b.p
    ) group by r, p
)"""  # noqa: E731
    step = lambda i: f"""
m{i} as materialized (select p, k, pos, floor(sum(c) / count(*))::bigint as c from (select a.p, k, generate_subscripts(x, 1) as pos, unnest(x) as c from a{i} a join x using (r, p)) group by p, k, pos),
l{i} as materialized (select p, k, list(c order by pos) as c from m{i} group by p, k),
b{i + 1} as materialized (select b.p, b.k, coalesce(l.c, b.c) as c from b{i} b left join l{i} l on b.p = l.p and b.k = l.k)"""  # noqa: E731
    rounds = ",".join(f"{near(i)},{step(i)}" for i in range(ROUNDS))
    return f"""with {parts},{rounds},{near(ROUNDS)},
e as materialized (select r, string_agg(printf('%02x', k::int), '' order by p) as code, sum(d)::bigint as error from a{ROUNDS} group by r),
s as (select sha256(string_agg(c::varchar, ',' order by p, k, pos)) as h from (select p, k, generate_subscripts(c, 1) as pos, unnest(c) as c from b{ROUNDS}))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, (select h from s) as codebooks_sha256 from v join e using (r)"""


ORACLE = _sql()
