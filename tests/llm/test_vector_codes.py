"""Vector codes against brute force, and the kd-tree against a scan."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in e], lab) for i, e, lab in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    if not kept:
        return []
    sizes = [len(v) for _, v, _ in kept]
    size = min(set(sizes), key=lambda n: (-sizes.count(n), n))
    kept = [(i, [max(-vc.LONG - 1, min(vc.LONG, x)) for x in v], lab) for i, v, lab in kept]
    cut = lambda v: [v[p * size // 16 : (p + 1) * size // 16] for p in range(16)]
    fit = [(i, cut(v), lab) for i, v, lab in kept if len(v) == size]
    first = sorted(fit, key=lambda r: (r[0] is None, r[0] or 0, [x for part in r[1] for x in part]))[:64]
    books = [[r[1][p] for r in first] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((far(v[p], e), k) for k, e in enumerate(books[p])) for p in range(16)] for _, v, _ in fit]

    for _ in range(2):
        found = assign()
        for p in range(16):
            for k in range(len(books[p])):
                own = [v[p] for (_, v, _), a in zip(fit, found, strict=True) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for part in books for e in part for c in e).encode()).hexdigest()
    out = [(i, "".join(f"{k:02x}" for _, k in a), min(vc.LONG, sum(d for d, _ in a)), lab) for (i, _, lab), a in zip(fit, assign(), strict=True)]
    out += [(i, None, None, lab) for i, v, lab in kept if len(v) != size]
    total = {lab: [e for *_, e, x in out if x == lab and e is not None] for *_, lab in out}
    return [(i, c, e, min(vc.LONG, sum(total[lab])) if total[lab] else None, digest) for i, c, e, lab in out]


@pytest.mark.parametrize(("n", "dim", "kind"), [(300, 64, "normal"), (200, 32, "ties"), (90, 16, "same"), (40, 20, "normal"), (3, 5, "normal"), (80, 16, "huge"), (0, 16, "normal"), (4, 0, "normal")])
def test_equals_brute_force(spark, n, dim, kind):
    rng = np.random.default_rng(n + dim)
    make = {"normal": lambda: rng.normal(size=dim), "ties": lambda: rng.integers(-1, 2, dim) / 128, "same": lambda: np.ones(dim) / 3, "huge": lambda: rng.normal(size=dim) * 10.0 ** rng.integers(0, 19)}[kind]
    rows = [(i * 3, [float(np.float32(x)) for x in make()], None if i % 7 == 0 else 1 if i % 3 else 2) for i in range(n)]
    rows += [(10_001, None, 1), (10_002, [1.0, None], 1), (10_003, [float("nan")] * dim, None), (10_004, [float("inf")] * dim, 2)] if dim else []
    if n > 50:
        rows += [rows[0], (rows[5][0], rows[6][1], 1), (None, rows[7][1], None), (20_000, [1.0] * (dim + 1), 9), (20_001, [1.0] * (dim + 1), 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    assert sorted(map(repr, (tuple(r) for r in vc.compress(df).collect()))) == sorted(map(repr, brute(rows)))


def test_empty_table(spark):
    found = vc.compress(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not found.collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 64), st.integers(1, 5), st.integers(1, 40), st.sampled_from([np.int64, object]))
def test_kd_tree_keeps_the_lower_index(seed, n, d, spread, kind):
    rng = np.random.default_rng(seed)
    entries, x = (rng.integers(-spread, spread, (m, d)).astype(kind) for m in (n, 50))
    best, far = vc.KdTree(entries).nearest(x)
    all_ = ((x[:, None] - entries[None]) ** 2).sum(2).astype(np.int64)
    assert best.tolist() == all_.argmin(1).tolist() and far.tolist() == all_.min(1).tolist()


def test_search_skips_leaves():
    rng = np.random.default_rng(1)
    tree = vc.KdTree(rng.integers(-10_000, 10_000, (64, 2)))
    seen = []

    class Counted(np.ndarray):
        pass

    search = tree._search
    tree._search = lambda node, x, rows, best, far: (seen.append(len(rows)) if node[2] is not None else None, search(node, x, rows, best, far))[1]
    tree.nearest(rng.integers(-10_000, 10_000, (200, 2)))
    assert sum(seen) < 200 * 8 / 2


def test_hot_label_is_broadcast(spark):
    """Labels of over a thousandth of the rows go by broadcast, the others by a merge join; both give sums of all rows."""
    rows = [(i, [float(i % 9)] * 16, 1 if i % 2 else i) for i in range(1500)]
    df = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    assert {(r["vec_id"], r["error"], r["label_error"]) for r in vc.compress(df).collect()} == {(i, e, t) for i, _, e, t, _ in brute(rows)}
