"""The k-NN edge graph: each row's nearest others by cosine, exactly, without listing pairs.

Vectors are dealt to cells of about CELL rows by pivots in levels: regions by sampled pivots where
there are more cells than PIVOTS, cells by pivots of their region, and blocks inside a
cell.  Pivots are taken farthest first from a sample, so every cluster tends to have one.
A cell is packed once into a written table, with each block's centre and the angle that covers it.

Each row first meets its own cell; the similarity of its n-th best there is its floor.
Pairs of cells are told apart by the angles between their blocks and by their rows' floors; in a pair that is left
a row meets only blocks whose angles allow its floor.  Pairs are made where the cells' table is
read, a task keeps the best of a cell's rows over all cells it holds, and only these are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.storage import written

#: Rows of a cell and of a block in it, about; regions, and cells of a region, at most about; sampled rows a pivot.
CELL, BLOCK, PIVOTS, SAMPLED = 4096, 128, 256, 16
#: Rows that are dealt to cells at once, a fourth of; rows multiplied at once; cells that a task holds, about.
PORTION, STRIP, HELD = 16_384, 256, 32
#: Slack of bounds and of the least similarity against rounding.
SLACK = 1e-9
#: Slack of an angle between blocks against rounding.
ANGLE = 1e-7


def matrix(rows: pa.RecordBatch | pa.Table, column: str = "embedding") -> np.ndarray:
    """The vectors of a column as a matrix; a ValueError if they differ in length."""
    lists = rows.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if not len(lists):
        return np.zeros((0, 0))
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n == 0, 1.0, n)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """k of the unit vectors x at most, each as far as can be from those before it."""
    if not len(x):
        return x
    picked, near = [0], x @ x[0]
    while len(picked) < k:
        i = int(near.argmin())
        if near[i] > 1 - 1e-12:
            break
        picked.append(i)
        np.maximum(near, x @ x[i], out=near)
    return x[picked]


class Cell:
    """Unit vectors in blocks, with what identifies their rows."""

    def __init__(self, ids: pa.Array, hashes: np.ndarray, seqs: np.ndarray, x: np.ndarray, starts: np.ndarray, centres: np.ndarray, wides: np.ndarray):
        self.ids, self.hashes, self.seqs, self.x, self.starts, self.centres, self.wides = ids, hashes, seqs, x, starts, centres, wides
        self.x4 = x.astype(np.float32)

    @classmethod
    def of(cls, ids: pa.Array, hashes: np.ndarray, seqs: np.ndarray, x: np.ndarray) -> Cell:
        """A cell of rows; rows near the same pivot are a block, in order of seq."""
        pivots = farthest_first(x, -(-len(x) // BLOCK))
        near = (x @ pivots.T).argmax(1)
        order = np.lexsort((seqs, near))
        near, x = near[order], x[order]
        starts = np.append(np.flatnonzero(np.append(True, near[1:] != near[:-1])), len(x))
        centres = unit(np.add.reduceat(x, starts[:-1], 0))
        gap = np.arccos(np.clip((x * np.repeat(centres, np.diff(starts), 0)).sum(1), -1, 1))
        wides = np.maximum.reduceat(gap, starts[:-1]) + SLACK
        whole = np.logical_and.reduceat(x.any(1), starts[:-1]) & centres.any(1)
        return cls(ids.take(pa.array(order)), hashes[order], seqs[order], x, starts, centres, np.where(whole, wides, np.pi))  # a zero vector has no direction

    def best(self, ids: pa.Array, hashes: np.ndarray, x: np.ndarray, floor: np.ndarray, top_n: int, max_sim: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place in the cell, similarity) of each row's top_n best here that reach its floor, by row, then best first."""
        out, slack = [], (x.shape[1] + 4) * 2.0**-23
        for at in range(0, len(x), STRIP):
            q, least = x[at : at + STRIP], floor[at : at + STRIP]
            ask = may(q, least, self.centres, self.wides)
            spans = [(0, len(self.x), np.arange(len(q)))] if ask.mean() > 0.5 else [(self.starts[j], self.starts[j + 1], np.flatnonzero(ask[:, j])) for j in np.flatnonzero(ask.any(0))]
            found, q4 = [], q.astype(np.float32)
            for a, b, rows in spans:
                # products in single precision, whose error is under slack, choose pairs; these are multiplied again
                sims = q4[rows] @ self.x4[a:b].T
                pick = (sims >= (least[rows] - slack).astype(np.float32)[:, None]) & (sims <= max_sim + slack)
                if b - a > top_n and np.count_nonzero(pick) > 4 * top_n * len(rows):
                    sure = np.where(pick & (sims < max_sim - slack), sims, np.float32(-2))
                    if max_sim > 1 - 2 * slack:  # no row takes its own place
                        sure[hashes[at + rows][:, None] == self.hashes[None, a:b]] = -2
                    cut = np.partition(sure, b - a - top_n, 1)[:, b - a - top_n]
                    pick &= sims >= (cut - 2 * slack)[:, None]
                r, c = np.nonzero(pick)
                r, c = rows[r], c + a
                exact = np.einsum("ij,ij->i", q[r], self.x[c])
                good = (exact <= max_sim) & (exact >= least[r])
                for i in np.flatnonzero(good & (hashes[at + r] == self.hashes[c])).tolist():
                    good[i] = ids[int(at + r[i])].as_py() != self.ids[int(c[i])].as_py()  # a row is not its own neighbour
                found.append((r[good], c[good], exact[good]))
            if found:
                r, c, s = (np.concatenate(v) for v in zip(*found, strict=True))
                order = np.lexsort((self.seqs[c], -s, r))
                r, c, s = r[order], c[order], s[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < top_n
                out.append((r[keep] + at, c[keep], s[keep]))
        return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def floors(self, row: np.ndarray, sims: np.ndarray, n: int, top_n: int, min_sim: float) -> np.ndarray:
        """Each row's n-th best similarity, or min_sim if it has fewer."""
        full = np.bincount(row, minlength=n) >= top_n
        floor = np.full(n, min_sim)
        last = np.searchsorted(row, np.arange(n), "right") - 1
        floor[full] = sims[last[full]]
        return floor


def may(x: np.ndarray, floor: np.ndarray, centres: np.ndarray, wides: np.ndarray) -> np.ndarray:
    """Which blocks can hold a vector whose similarity with a row of x reaches the row's floor; a zero row's is 0."""
    gap = np.maximum(angles(x, centres) - wides[None], 0)
    return (np.cos(gap) >= floor[:, None] - SLACK) | ((floor <= 0)[:, None] & ~x.any(1)[:, None])


def _packed(kind: str) -> str:
    return f"region long, cell long, ids array<{kind}>, hashes array<long>, seqs array<long>, unit binary, starts array<int>, centres binary, wides array<double>"


def _opened(pick) -> Cell:
    seqs = pick("seqs").values.to_numpy()
    starts = pick("starts").values.to_numpy()
    dense = lambda name, n: np.frombuffer(pick(name).as_buffer()).reshape(n, -1)
    return Cell(pick("ids").values, pick("hashes").values.to_numpy(), seqs, dense("unit", len(seqs)), starts, dense("centres", len(starts) - 1), pick("wides").values.to_numpy())


def _sketches(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for cell, centres, wides in zip(batch.column("cell").to_pylist(), batch.column("centres"), batch.column("wides"), strict=True):
        w = wides.values.to_numpy()
        yield cell, np.frombuffer(centres.as_buffer()).reshape(len(w), -1), w


def _one(values, kind) -> pa.Array:
    return pa.array([values], pa.list_(kind))


def _looked_up(values: dict[int, int]):
    """The value of a row's region."""
    return F.create_map(*(F.lit(v).cast("long") for pair in values.items() for v in pair))[F.col("region")]


def cells(vectors: DataFrame, n: int) -> tuple[DataFrame, np.ndarray | None]:
    """The packed cells of n rows (id, h, seq, embedding) as a written table, and the pivots of regions, if there are several."""
    kind = dict(vectors.dtypes)["id"]
    need = -(-n // CELL)
    regions = min(PIVOTS, -(-need * 2 // PIVOTS)) if need > PIVOTS else 1
    dealt, pivots, counts = vectors.withColumn("region", F.lit(0).cast("long")), None, {0: n}
    if regions > 1:
        # SAMPLED rows a region reach the driver
        some = vectors.orderBy(F.xxhash64("h")).limit(SAMPLED * regions).select("embedding").toArrow()
        pivots = farthest_first(unit(matrix(some)), regions)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = (unit(matrix(batch)) @ pivots.T).argmax(1) if batch.num_rows else np.zeros(0, np.int64)
                yield batch.append_column("region", pa.array(found.astype(np.int64)))

        dealt = written(vectors.mapInArrow(near, f"id {kind}, h long, seq long, embedding {dict(vectors.dtypes)['embedding']}, region long"))
        counts = {r["region"]: r["count"] for r in dealt.groupBy("region").count().collect()}  # PIVOTS rows at most
    many = _looked_up(counts)
    wanted = F.ceil(many / CELL)
    # about SAMPLED rows a cell, picked by hash, give the pivots of each region
    sampled = dealt.where(F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.floor(many / (wanted * SAMPLED)))) == 0).withColumn("wanted", wanted)

    def choose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("h")
        x = farthest_first(unit(matrix(rows)), rows["wanted"][0].as_py())
        return pa.table([rows["region"].combine_chunks().slice(0, 1), pa.array([x.tobytes()], pa.binary())], ["region", "pivots"])

    chosen = sampled.select("region", "wanted", "h", "embedding").groupBy("region").applyInArrow(choose, "region long, pivots binary")
    salts = F.ceil(many / (PORTION * 4))
    salted = dealt.withColumn("salt", F.pmod(F.xxhash64("h", F.lit(1)), salts))
    chosen = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))

    def deal(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return rows.append_column("pivot", pa.array([], pa.int64()))
        x = unit(matrix(rows))
        p = np.frombuffer(pivots["pivots"][0].as_buffer()).reshape(-1, x.shape[1]) if pivots.num_rows else x[:1]
        return rows.append_column("pivot", pa.array((x @ p.T).argmax(1).astype(np.int64)))

    fields = f"region long, salt long, id {kind}, h long, seq long, embedding {dict(vectors.dtypes)['embedding']}"
    placed = salted.select("region", "salt", "id", "h", "seq", "embedding").groupBy("region", "salt").cogroup(chosen.groupBy("region", "salt")).applyInArrow(deal, f"{fields}, pivot long")
    placed = written(placed.drop("salt"))
    parts = placed.groupBy("region", "pivot").agg(F.ceil(F.count("*") / (2 * CELL)).alias("parts"))
    cell = F.shiftleft("region", 48) + F.shiftleft("pivot", 32) + F.pmod(F.xxhash64("h", F.lit(2)), F.col("parts"))
    placed = placed.join(parts, ["region", "pivot"]).select("region", cell.alias("cell"), "id", "h", "seq", "embedding")

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        c = Cell.of(rows["id"].combine_chunks(), rows["h"].to_numpy(), rows["seq"].to_numpy(), unit(matrix(rows)))
        first = [rows[k].combine_chunks().slice(0, 1) for k in ("region", "cell")]
        return pa.table([*first, _one(c.ids, c.ids.type), _one(c.hashes, pa.int64()), _one(c.seqs, pa.int64()), pa.array([c.x.tobytes()], pa.binary()), _one(c.starts.astype(np.int32), pa.int32()), pa.array([c.centres.tobytes()], pa.binary()), _one(c.wides, pa.float64())], ["region", "cell", "ids", "hashes", "seqs", "unit", "starts", "centres", "wides"])

    return written(placed.groupBy("cell").applyInArrow(pack, _packed(kind))), pivots


def semantic_edges(vectors: DataFrame, top_n: int = 5, min_sim: float = 0.6, max_sim: float = 0.99) -> DataFrame:
    """Each row's top_n nearest others of (id, seq, embedding): (src, dst, sim, rank).

    Pairs above max_sim are near duplicates and are left out before the rank, so they take
    no place.  Equal similarities are in order of seq.  Null and empty vectors take no part;
    vectors of different lengths are a ValueError.
    """
    kind = dict(vectors.dtypes)["id"]
    result = f"src {kind}, dst {kind}, sim double, rank int"
    rows = vectors.where(F.size("embedding") > 0).select("id", F.xxhash64("id").alias("h"), F.col("seq").cast("long"), "embedding")
    n, lo, hi = rows.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first() if top_n > 0 else (0, 0, 0)
    if not n:
        return vectors.sparkSession.createDataFrame([], result)
    if lo != hi:
        raise ValueError(f"vectors have {lo} to {hi} components")

    def ranked(row: np.ndarray) -> pa.Array:
        return pa.array((np.arange(len(row)) - np.searchsorted(row, row) + 1).astype(np.int32))

    if n <= CELL:  # one cell of bounded size: its rows meet in one task

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches)).combine_chunks()
            c = Cell.of(table["id"].combine_chunks(), table["h"].to_numpy(), table["seq"].to_numpy(), unit(matrix(table)))
            row, place, sims = c.best(c.ids, c.hashes, c.x, np.full(len(c.x), min_sim), top_n, max_sim)
            yield pa.RecordBatch.from_arrays([c.ids.take(pa.array(row)), c.ids.take(pa.array(place)), pa.array(sims), ranked(row)], ["src", "dst", "sim", "rank"])

        return rows.repartition(1).mapInArrow(whole, result)

    packed, _ = cells(rows, n)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each cell with the floors of its rows, the least floor of each block, and the best that its rows have in it."""
        for batch in batches:
            for i in range(batch.num_rows):
                c = _opened(lambda name, i=i, batch=batch: batch.column(name)[i])
                row, place, sims = c.best(c.ids, c.hashes, c.x, np.full(len(c.x), min_sim), top_n, max_sim)
                floor = c.floors(row, sims, len(c.x), top_n, min_sim)
                least = np.minimum.reduceat(floor, c.starts[:-1])
                same = [batch.column(name).slice(i, 1) for name in ("cell", "ids", "hashes", "unit", "centres", "wides")]
                yield pa.RecordBatch.from_arrays([*same, _one(floor, pa.float64()), _one(least, pa.float64()), _one(c.ids.take(pa.array(row)), c.ids.type), _one(c.ids.take(pa.array(place)), c.ids.type), _one(c.seqs[place], pa.int64()), _one(sims, pa.float64())], ["home", "srcs", "own", "x", "middles", "spans", "floors", "least", "src", "dst", "seq", "sim"])

    asking = written(packed.mapInArrow(own, f"home long, srcs array<{kind}>, own array<long>, x binary, middles binary, spans array<double>, floors array<double>, least array<double>, src array<{kind}>, dst array<{kind}>, seq array<long>, sim array<double>"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best that the rows of a cell have in the cells that follow it in the task's pairs; a cell's pairs follow each other."""
        now, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                pick = lambda name, i=i, batch=batch: batch.column(name)[i]
                if (home := pick("home").as_py()) != now:
                    if held is not None:
                        yield held.rows()
                    now, held = home, Askers(pick("srcs").values, pick("own").values.to_numpy(), pick("x").as_buffer(), pick("floors").values.to_numpy().copy())
                held.ask(_opened(pick), top_n, max_sim)
        if held is not None:
            yield held.rows()

    need = -(-n // CELL)
    to = asks(asking).groupBy("home").agg(F.collect_list("cell").alias("to"))
    # pairs are made where a cell's file is read again, so neither side is shuffled; a task holds HELD cells
    left = asking.select("home", "srcs", "own", "x", "floors").join(F.broadcast(to), "home")  # a row a cell, with numbers of cells
    right = packed.select("cell", "ids", "hashes", "seqs", "unit", "starts", "centres", "wides").coalesce(-(-need // HELD))
    pairs = left.hint("shuffle_replicate_nl").join(right, F.array_contains("to", F.col("cell"))).drop("to")
    met = pairs.mapInArrow(meet, f"src {kind}, dst {kind}, seq long, sim double")
    near = asking.select(F.explode(F.arrays_zip("src", "dst", "seq", "sim")).alias("e")).select("e.src", "e.dst", "e.seq", "e.sim").unionByName(met)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "seq"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top_n).select("src", "dst", "sim", "rank")


class Askers:
    """The rows of a cell and the best that they have met in others so far."""

    def __init__(self, ids: pa.Array, hashes: np.ndarray, x: pa.Buffer, floor: np.ndarray):
        self.ids, self.hashes, self.floor = ids, hashes, floor
        self.x = np.frombuffer(x).reshape(len(ids), -1)
        self.row, self.seq, self.sim, self.dst = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), ids.slice(0, 0)

    def ask(self, c: Cell, top_n: int, max_sim: float) -> None:
        some = np.flatnonzero(may(self.x, self.floor, c.centres, c.wides).any(1))
        if not len(some):
            return
        row, place, sims = c.best(self.ids.take(pa.array(some)), self.hashes[some], self.x[some], self.floor[some], top_n, max_sim)
        row, seq, sim = np.append(self.row, some[row]), np.append(self.seq, c.seqs[place]), np.append(self.sim, sims)
        order = np.lexsort((seq, -sim, row))
        order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < top_n]
        self.dst = pa.concat_arrays([self.dst, c.ids.take(pa.array(place))]).take(pa.array(order))
        self.row, self.seq, self.sim = row[order], seq[order], sim[order]
        full = np.flatnonzero(np.bincount(self.row, minlength=len(self.x)) >= top_n)
        self.floor[full] = np.maximum(self.floor[full], self.sim[np.searchsorted(self.row, full, "right") - 1])

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(self.row)), self.dst, pa.array(self.seq), pa.array(self.sim)], ["src", "dst", "seq", "sim"])


def asks(asking: DataFrame) -> DataFrame:
    """Rows (home, cell), written: cells beside its own in which a row of home can better its list, by the blocks of both."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                pick = lambda name, i=i, batch=batch: batch.column(name)[i]
                a, b, least = pick("spans").values.to_numpy(), pick("wides").values.to_numpy(), pick("least").values.to_numpy()
                x, y = (np.frombuffer(pick(name).as_buffer()).reshape(k, -1) for name, k in (("middles", len(a)), ("centres", len(b))))
                gap = np.maximum(angles(x, y) - a[:, None] - b[None] - ANGLE, 0)
                keep.append(bool((np.cos(np.minimum(gap, np.pi)) >= least[:, None] - SLACK).any()))
            yield batch.select(["home", "cell"]).filter(pa.array(keep, pa.bool_()))

    left = asking.select("home", "middles", "spans", "least")
    right = asking.select(F.col("home").alias("cell"), F.col("middles").alias("centres"), F.col("spans").alias("wides"))
    return written(left.hint("shuffle_replicate_nl").join(right, F.col("home") != F.col("cell")).mapInArrow(reach, "home long, cell long"))
