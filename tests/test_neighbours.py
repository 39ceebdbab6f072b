"""The k-NN edge build against all pairs, over one cell, several, and regions of cells; and how little it compares."""

import numpy as np
import pytest

from gleaner.operators import dense, neighbours

SCHEMA = "id string, seq long, embedding array<double>"


def brute(rows, top_n, least, most):
    x = neighbours.unit(np.array([v for *_, v in rows], float))
    sims = x @ x.T
    want = set()
    for i, (a, *_) in enumerate(rows):
        near = [j for j in range(len(rows)) if rows[j][0] != a and least <= sims[i, j] <= most]
        want |= {(a, rows[j][0], n) for n, j in enumerate(sorted(near, key=lambda j: (-sims[i, j], rows[j][1]))[:top_n], 1)}
    return want


def clustered(seed, groups, each, dim=5, noise=0.1):
    rng = np.random.default_rng(seed)
    x = np.concatenate([c + noise * rng.normal(size=(each, dim)) for c in 3 * rng.normal(size=(groups, dim))] + [np.zeros((1, dim))])
    order = rng.permutation(len(x))
    return [(f"v{i}", i, x[j].tolist()) for i, j in enumerate(order)]


@pytest.mark.parametrize(("cell", "block", "pivots", "groups"), [(4096, 128, 256, 6), (12, 4, 256, 6), (12, 4, 4, 20), (9, 3, 3, 30)])
def test_equals_all_pairs(spark, monkeypatch, cell, block, pivots, groups):
    """Cells and regions that angles rule out, zero vectors, and two rows of one id."""
    for name, value in (("CELL", cell), ("BLOCK", block), ("PIVOTS", pivots), ("PORTION", 20)):
        monkeypatch.setattr(neighbours, name, value)
    rows = clustered(groups, groups, 9)
    got = dense.semantic_edges(spark.createDataFrame(rows, SCHEMA), 3, 0.6, 0.999).collect()
    assert {(r["src"], r["dst"], r["rank"]) for r in got} == (want := brute(rows, 3, 0.6, 0.999)) and len(want) > 50 and len(got) == len(want)


def test_ties_go_to_the_lower_seq(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 10)
    rows = [(f"v{i}", 100 - i, [1.0, float(i % 3)]) for i in range(60)]
    got = dense.semantic_edges(spark.createDataFrame(rows, SCHEMA), 4, 0.1, 0.999).collect()
    assert {(r["src"], r["dst"], r["rank"]) for r in got} == brute(rows, 4, 0.1, 0.999)


@pytest.mark.parametrize("cell", [2, 4096])
def test_vectors_of_two_lengths_are_an_error(spark, monkeypatch, cell):
    """Two of 2 and one of 4 components come to 8 numbers, which three rows cannot share out unseen."""
    monkeypatch.setattr(neighbours, "CELL", cell)
    rows = [("a", 1, [1.0, 2.0]), ("b", 2, [1.0, 2.0]), ("c", 3, [1.0, 2.0, 3.0, 4.0]), ("d", 4, [1.0, 2.0, 3.0, 4.0])]
    with pytest.raises(ValueError, match="components"):
        dense.semantic_edges(spark.createDataFrame(rows, SCHEMA), 2).collect()


def test_nothing_to_compare(spark):
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, [])], SCHEMA)
    assert dense.semantic_edges(rows).collect() == [] == dense.semantic_edges(spark.createDataFrame([("a", 1, [1.0])], SCHEMA), 0).collect()


def test_few_blocks_meet():
    """Of 10^5 vectors in 120 clusters, rows meet under a twentieth of the (row, block) pairs, their own cell's included."""
    rng = np.random.default_rng(4)
    x = neighbours.unit(np.concatenate([c + 0.02 * rng.normal(size=(834, 32)) for c in rng.normal(size=(120, 32))]))
    x = x[rng.permutation(len(x))]
    pivots = neighbours.farthest_first(x[: neighbours.SAMPLED * 25], 25)
    home = (x @ pivots.T).argmax(1)
    import pyarrow as pa

    ids = [np.flatnonzero(home == k) for k in range(len(pivots))]
    cells = [neighbours.Cell.of(pa.array(i), i, i, x[i]) for i in ids if len(i)]
    blocks = sum(len(c.wides) for c in cells)
    met = 0
    for c in cells:
        some = np.arange(0, len(c.x), 40)
        row, _, sims = c.best(c.ids.take(pa.array(some)), c.hashes[some], c.x[some], np.full(len(some), 0.6), 5, 0.9999)
        floor = c.floors(row, sims, len(some), 5, 0.6)
        met += sum(int(neighbours.may(c.x[some], floor if d is not c else np.full(len(some), 0.6), d.centres, d.wides).sum()) for d in cells) / len(some) * len(c.x)
    assert met < 0.05 * blocks * len(x)


def test_pairs_of_cells_are_not_shuffled(spark, monkeypatch):
    """Without clusters every cell asks every other; what leaves the tasks are lists, not rows for each cell asked."""
    for name, value in (("CELL", 20), ("BLOCK", 5), ("HELD", 4)):
        monkeypatch.setattr(neighbours, name, value)
    rows = [(f"v{i}", i, v) for i, v in enumerate(np.random.default_rng(2).normal(size=(160, 16)).tolist())]
    found = dense.semantic_edges(spark.createDataFrame(rows, SCHEMA), 3, 0.0, 0.99)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan and "SortMergeJoin" not in plan
    assert {(r["src"], r["dst"], r["rank"]) for r in found.collect()} == brute(rows, 3, 0.0, 0.99)
