"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct five-word shingles (ASCII-lower-cased words).  Sets
are sketched into registers ``floor(1 - log_b(x))`` of truncated exponential minima:
registers of unions are register maxima, and for b near 1 they agree with probability
close to the Jaccard similarity.  Documents that agree on all registers of a band are
candidates; a joint likelihood of the register order statistics drops those that
cannot reach the threshold, and what is left is confirmed on full sets.

Defined results: null or wordless text has no shingles and links with nothing; rows
with null doc_id take no part in links (component_id null, kept true); repeated rows
are copies of each other and share the class; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import Words, shingle_sets, slices
from .shared import Scratch, cluster, cut

WORDS = 5
PERCENT = 75
#: Registers, the base and rate of their exponential spacing, and their largest value.
M, B, A, Q = 128, 1.001, 20.0, 65534
#: Bands of R registers each; no register is in two bands, so bands are independent.  At
#: the threshold a band agrees with probability 0.75**4 = 0.316, so 32 bands miss a link
#: with (1 - 0.75**4)**32 = 5.2 in 10**6.
BANDS, R, SEED = 32, 4, 20240531
#: Drop a candidate when similarities over the threshold are e**-LOG_ODDS as likely as the best estimate.
LOG_ODDS = 14.0


def band_registers() -> np.ndarray:
    return np.arange(BANDS * R).reshape(BANDS, R)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers (len(sets), M) as uint16; an empty set is all zero."""
    out = np.zeros((len(sets), M), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    x = np.concatenate([sets[i] for i in full])
    at = np.cumsum([0] + [len(sets[i]) for i in full][:-1])
    hi, lo = (x >> np.uint64(32)).astype(np.uint32), x.astype(np.uint32)
    odd = np.random.default_rng(SEED + 1).integers(0, 2**31, (3, M), dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    least = np.empty((len(full), M), np.uint32)
    t, u = np.empty_like(hi), np.empty_like(hi)
    for i in range(M):
        np.multiply(hi, odd[0, i], out=t)
        np.multiply(lo, odd[1, i], out=u)
        np.add(t, u, out=t)
        np.bitwise_xor(t, odd[2, i], out=t)
        least[:, i] = np.minimum.reduceat(t, at)
    wait = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / A
    out[full] = np.clip(np.floor(1 - np.log(wait) / np.log(B)), 0, Q + 1).astype(np.uint16)
    return out


def log_likelihood(j: np.ndarray, n1, n2, up, down, same) -> np.ndarray:
    """Joint log likelihood of similarity j given how many registers are larger, smaller and equal."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    a, b = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return up * np.log(a + tiny) + down * np.log(b + tiny) + same * np.log(np.maximum(1 - a - b, tiny))


def plausible(r1: np.ndarray, r2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """False where the registers rule out a similarity of PERCENT or more."""
    up, down = (r1 > r2).sum(1)[:, None], (r1 < r2).sum(1)[:, None]
    same = M - up - down
    n1, n2 = n1.astype(float)[:, None], n2.astype(float)[:, None]
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(n1, n2) / np.maximum(n1, n2)
    score = log_likelihood(grid, n1, n2, up, down, same)
    reach = np.where(grid >= PERCENT / 100 - 0.011, score, -np.inf).max(1)
    return score.max(1) - reach <= LOG_ODDS


def _packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(*words.of(part.column("text")), WORDS)
            prints = np.array([(s.sum(dtype=np.uint64), (s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(prints[:, i].astype(np.int64)) for i in (0, 1)), _packed(list(sketch(sets)))],
                ["doc_id", "n_shingles", "p1", "p2", "registers"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    where = band_registers()
    odd = np.random.default_rng(SEED + 2).integers(0, 2**62, (BANDS, R), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            regs = _registers(part.column("registers")).astype(np.uint64)
            key = (regs[:, where] * odd[None]).sum(2, dtype=np.uint64)
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= (key >> np.uint64(32)) + np.arange(BANDS, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
            ids = np.repeat(part.column("id").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64).ravel()), pa.array(ids)], ["key", "id"])


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of the texts whose set has the fingerprint p1."""
    words = Words()
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(*words.of(part.column("text")), WORDS)
            p1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
            same = pa.array(p1 == part.column("p1").to_numpy())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("size"), part.column("registers"), _packed(sets)], ["id", "size", "registers", "shingles"]).filter(same)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted non-empty sets have a similarity of PERCENT or more, in integers."""
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _compare(rows: pa.RecordBatch):
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.column("shingles")]
    regs, n = _registers(rows.column("registers")), np.array([len(s) for s in sets])

    def may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        good = 100 * np.minimum(n[y], n[x]) >= PERCENT * np.maximum(n[y], n[x])
        at = np.flatnonzero(good)
        for k in range(0, len(at), 2000):
            i = at[k : k + 2000]
            good[i] = plausible(regs[x[i]], regs[y[i]], n[x[i]], n[y[i]])
        return good

    return may, lambda x, y: linked(sets[x], sets[y])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    scratch = Scratch(docs.sparkSession)
    rows = cut(docs.mapInArrow(_sketches, "doc_id long, n_shingles long, p1 long, p2 long, registers binary"))
    full = rows.where("doc_id is not null and n_shingles > 0")
    # all rows of a class have the same set
    nodes = scratch.cut(full.groupBy("p1", "p2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.first("registers").alias("registers")))
    buckets = nodes.mapInArrow(_bands, "key long, id long")

    def bodies(ids: DataFrame) -> DataFrame:
        wanted = nodes.join(ids, "id", "left_semi").drop("p2")
        texts = docs.join(wanted, docs["doc_id"] == wanted["id"]).select("id", "p1", "size", "registers", "text")
        sets = texts.mapInArrow(_full_sets, "id long, size long, registers binary, shingles binary")
        return sets.dropDuplicates(["id", "size", "registers"])

    found = cluster(buckets, bodies, _compare)
    classes = cut(nodes.select("p1", "p2", "id"))
    scratch.clear()
    classes = classes.join(found, "id", "left").select("p1", "p2", F.coalesce("component", "id").alias("c"))
    joined = rows.drop("registers").join(classes, ["p1", "p2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") > 0, F.col("c")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.cast("long").alias("component_id")).withColumn("kept", F.expr("doc_id <=> component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one of each component, every row without words or id."""
    decided = near_duplicates(docs).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("n_shingles") > 0).alias("__one"))
    joined = docs.join(decided, docs["doc_id"] == decided["__id"])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    decided_on = joined.withColumn("__no", number).where("__no = 1 or not __one").select(*docs.columns)
    return decided_on.unionByName(docs.where("doc_id is null"))  # which stay, and need not meet in one task
