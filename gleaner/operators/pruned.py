"""An inner-product index in cells, of which a query reads those that can hold one of its k best.

Unit vectors lie in cells around pivots (see ``neighbours``), written in order of cell in small row
groups, each with its blocks' centres and covering angles.  A query bounds every cell by its
blocks' angles without reading vectors, searches the FIRST best cells, and then only those
whose bound reaches the k-th score found there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexical import DECIMALS, ranked, ranges
from .neighbours import SLACK, _opened, _sketches, angles, cells, unit

#: Cells that are searched first; bytes of a row group, which holds about a cell.
FIRST, GROUP = 4, 1 << 20


@dataclass
class Found:
    """The hits (id, seq, score, rank), how many cells were read for them, and how many there are."""

    hits: DataFrame
    read: int
    cells: int


def save(vectors: DataFrame, folder: str) -> DataFrame:
    """The index of vectors (id, seq, embedding) as a table; a zero vector stays zero."""
    rows = vectors.where(F.size("embedding") > 0).select("id", F.xxhash64("id").alias("h"), F.col("seq").cast("long"), "embedding")
    packed, _ = cells(rows, max(1, rows.count()))
    packed.repartitionByRange("cell").sortWithinPartitions("cell").write.option("parquet.block.size", GROUP).parquet(folder)
    return load(vectors.sparkSession, folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def bounds(index: DataFrame, query: np.ndarray) -> DataFrame:
    """Rows (cell, bound): no vector of the cell has a larger inner product with the unit query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(cell, float(np.cos(np.maximum(angles(query[None], centres)[0] - wides, 0)).max())) for cell, centres, wides in _sketches(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64())], ["cell", "bound"])

    return index.select("cell", "centres", "wides").mapInArrow(run, "cell long, bound double")


def scored(index: DataFrame, query: np.ndarray, k: int, which: Column) -> DataFrame:
    """Rows (id, seq, score): the k best of each of some cells."""
    kind = dict(index.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _opened(lambda name, i=i, batch=batch: batch.column(name)[i])
                s = np.round(c.x @ query, DECIMALS) + 0.0
                best = pa.array(np.lexsort((c.seqs, -s))[:k])
                yield pa.RecordBatch.from_arrays([c.ids.take(best), pa.array(c.seqs).take(best), pa.array(s).take(best)], ["id", "seq", "score"])

    return index.where(which).mapInArrow(run, f"id {kind}, seq long, score double")


def _within(own: list[int]) -> Column:
    spans = reduce(lambda a, b: a | b, (F.col("cell").between(a, b) for a, b in ranges(own)), F.lit(False))
    return spans & F.col("cell").isin(own)


def top_k(index: DataFrame, query: list[float], k: int) -> Found:
    """The k rows with the largest inner product with the unit query, as ``dense.inner_product_top_k`` finds them."""
    q = unit(np.array([query], float))[0]
    all_ = sorted(((r["bound"], r["cell"]) for r in bounds(index, q).collect()), key=lambda b: (-b[0], b[1]))  # a number a cell
    if k <= 0 or not all_:
        return Found(ranked(scored(index, q, 1, F.lit(False))), 0, len(all_))
    first = [cell for _, cell in all_[:FIRST]]
    tried = scored(index, q, k, _within(first)).orderBy(F.desc("score"), "seq").limit(k).collect()
    least = tried[-1]["score"] if len(tried) == k else float("-inf")
    alive = [cell for bound, cell in all_ if bound >= least - SLACK]
    found = scored(index, q, k, _within(alive)).orderBy(F.desc("score"), "seq").limit(k)
    return Found(ranked(found), len(set(alive) | set(first)), len(all_))
