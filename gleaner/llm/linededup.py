r"""Line dedup: near-equal lines by MinHash and exact Jaccard similarity.

A line is what stands between line feeds, lower-cased and trimmed.  Its set is its
distinct shingles of K characters (a shorter line is its own only shingle).  Equal lines
are one class, by two 64-bit hashes of the whole line.  A class's signature is, for each
of M odd constants, the least product of the constant with a shingle's hash modulo
2**32: over random hashes any shingle of a union is the least with equal chance, so
signatures agree with probability equal to the Jaccard similarity.  Classes that agree on
all R minima of a band are candidates, links are confirmed by exact Jaccard similarity on
full shingle sets, distributed union-find makes components, and of each component the
line that comes first stays.

BANDS bands of R miss a link at the threshold with probability (1 - 0.75**R)**BANDS,
1.1 in 10**4, and at 0.8 with 3.3 in 10**6; no candidate is dropped before the exact
similarity but by bounds that hold for every pair.

Lines are split, hashed, joined and grouped by DataFrame functions; signatures and the
comparison of a block of candidates are numpy over Arrow batches, as minima that are
columns of a grouped aggregate have to be shuffled once a line.

Defined results: blank lines and lines of documents without id stay and link with
nothing; a null text has no lines, an empty one has one blank line; rows that repeat a
document are one document; two lines that share the first hash but not the second are of
different classes, and only the one with the lesser second hash has links; other columns
are ignored.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import mix, slices
from .shared import Scratch, cluster, cut

K, PERCENT = 7, 75
BANDS, R = 24, 4
M = BANDS * R
SEED = 23
PLACES = np.random.default_rng(SEED).integers(0, 2**62, K, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of the bitmaps whose differing bits bound a symmetric difference from below.
BITMAP = 512
#: White space that lines lose at their ends.
SPACE = " \t\r\x0b\x0c"
#: Classes with at least one in HEAVY of all lines, HEAVY at most, are joined by broadcast.
HEAVY = 1000
#: Characters of lines whose signatures are computed at once.
CHARACTERS = 256 << 10


def _trimmed(line: Column) -> Column:
    """The line without white space at its ends; trim lists each character of a line, so only lines that have such ends get it."""
    ends = functools.reduce(operator.or_, (line.startswith(w) | line.endswith(w) for w in SPACE))
    return F.when(ends, F.trim(line, F.lit(SPACE))).otherwise(line)


def _split() -> Column:
    return F.transform(F.split(F.lower("text"), "\n", -1), _trimmed)


def lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line_no, line, id, h): every line of every document, normalised, and its two hashes."""
    each = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.posexplode(F.split(F.lower("text"), "\n", -1)).alias("line_no", "line"))
    each = each.withColumn("line", _trimmed(F.col("line")))
    return each.withColumns({"id": F.xxhash64("line"), "h": F.xxhash64(F.lit(SEED), "line")})


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of K characters from each position of all lines, and where each line's shingles start and end."""
    # a line feed is in no line, so it fills up short lines and parts lines
    joined = "\n".join(t if len(t) >= K else t.ljust(K, "\n") for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    x = np.zeros(max(0, len(codes) - K + 1), np.uint64)
    for j in range(K):
        x += codes[j : j + len(x)] * PLACES[j]
    length = np.array([max(len(t), K) for t in texts], np.int64)
    start = np.cumsum(length + 1) - length - 1
    return mix(x), start, start + length - K + 1


def signatures(texts: list[str]) -> np.ndarray:
    """Minima (lines, M) of lines."""
    x, start, end = shingles(texts)
    x = np.append((x >> np.uint64(32)).astype(np.uint32), np.uint32(0))
    odd = np.random.default_rng(SEED + 1).integers(0, 2**31, M, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    at = np.stack([start, end], 1).ravel()
    least, t = np.empty((len(texts), M), np.uint32), np.empty_like(x)
    for i in range(M):
        np.multiply(x, odd[i], out=t)
        least[:, i] = np.minimum.reduceat(t, at)[::2]
    return least


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd = np.random.default_rng(SEED + 2).integers(0, 2**62, (BANDS, R), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    salt = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        first = np.sort(np.unique(batch.column("id").to_numpy(), return_index=True)[1])  # a class once a batch
        for part in slices(batch.take(pa.array(first)), "line", CHARACTERS):
            least = signatures(part.column("line").to_pylist()).reshape(-1, BANDS, R)
            key = mix((least * odd[None]).sum(2, dtype=np.uint64) + salt[None])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(part.column("id").to_numpy(), BANDS))], ["key", "id"])


def _compare(rows: pa.RecordBatch):
    x, start, end = shingles(rows.column("line").to_pylist())
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        x[a:b].sort()
    first, inside = np.ones(len(x), bool), np.zeros(len(x), np.int8)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    first[start] = True
    inside[start], inside[end] = 1, -1
    first &= np.cumsum(inside, dtype=np.int8).view(bool)
    x, at = x[first], np.append(0, np.cumsum(first))
    start, end = at[start], at[end]
    n = end - start
    maps = np.zeros(len(n) * BITMAP, bool)
    maps[np.repeat(np.arange(len(n)) * BITMAP, n) + (x % np.uint64(BITMAP)).view(np.int64)] = True
    maps = np.packbits(maps.reshape(-1, BITMAP), axis=1).view(np.uint64)
    sets = [x[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]

    def may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        # each differing bit is of a shingle that only one of the two has; linked sets have (1 - J) / (1 + J) of all such at most
        differ = np.bitwise_count(maps[x] ^ maps[y]).sum(1, dtype=np.int64)
        return (100 * np.minimum(n[y], n[x]) >= PERCENT * np.maximum(n[y], n[x])) & ((100 + PERCENT) * differ <= (100 - PERCENT) * (n[y] + n[x]))

    return may, lambda x, y: linked(sets[x], sets[y])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")  # a merge, as both parts are in order
    return (100 + PERCENT) * int(np.count_nonzero(both[1:] == both[:-1])) >= PERCENT * (len(x) + len(y))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, line_no, first_doc_id, first_line_no, kept): the line that stands for each line's component."""
    docs = docs.select("doc_id", "text")
    full = lines(docs).where("line != ''")
    places = cut(lines(docs).select("doc_id", "line_no", F.when(F.col("line") != "", F.col("id")).alias("id"), "h"))
    blank = places.where("id is null").selectExpr("doc_id", "line_no", "doc_id first_doc_id", "line_no first_line_no")
    spoken = places.where("id is not null")
    classes = cut(spoken.groupBy("id", "h").agg(F.min(F.struct("doc_id", "line_no")).alias("f"), F.count("*").alias("n")))
    scratch = Scratch(docs.sparkSession)
    buckets = full.select("id", "line").mapInArrow(_bands, "key long, id long")

    def bodies(ids: DataFrame) -> DataFrame:
        own = classes.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("h", "f")).alias("m"))
        # the lines of one document, so its text is shuffled once at most and its other lines not at all
        own = scratch.cut(own.groupBy(F.col("m.f.doc_id").alias("d")).agg(F.collect_set(F.struct("id", "m.h")).alias("own")))
        texts = docs.join(own, F.col("doc_id") == F.col("d"))
        found = texts.select("own", *(F.explode(F.transform(_split(), lambda x: F.struct(x.alias("line"), F.xxhash64(x).alias("id"), F.xxhash64(F.lit(SEED), x).alias("h")))).alias("x"),))
        found = found.where(F.array_contains("own", F.struct("x.id", "x.h"))).select("x.id", "x.line")
        return found.groupBy("id").agg(F.min("line").alias("line")).selectExpr("id", "length(line) size", "line")

    found = cluster(buckets, bodies, _compare)
    scratch.clear()
    joined = classes.join(found, "id")
    main = joined.groupBy("id").agg(F.min("h").alias("h"))
    joined = joined.join(main, ["id", "h"], "left_semi")
    first = joined.groupBy("component").agg(F.min("f").alias("g"))
    moved = joined.join(first, "component").select("id", "h", "g")
    classes = cut(classes.join(moved, ["id", "h"], "left").select("id", "h", "n", F.coalesce("g", "f").alias("f")))
    heavy = F.broadcast(classes.where(F.col("n") * HEAVY >= spoken.count()).drop("n"))
    often = spoken.join(heavy, ["id", "h"])
    rest = spoken.join(heavy, ["id", "h"], "left_anti").join(classes.drop("n"), ["id", "h"])
    placed = often.unionByName(rest).selectExpr("doc_id", "line_no", "f.doc_id first_doc_id", "f.line_no first_line_no")
    return placed.unionAll(blank).withColumn("kept", F.expr("doc_id = first_doc_id and line_no = first_line_no"))


def rebuilt(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Documents (doc_id, text) of their kept lines, in order."""
    raw = docs.select(F.col("doc_id").cast("long"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).distinct()
    kept = raw.join(decided.where("kept").select("doc_id", "line_no"), ["doc_id", "line_no"])
    own = F.array_sort(F.collect_list(F.struct("line_no", "line")))  # the lines of one document
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(own, lambda s: s["line"]), "\n").alias("text"))
