"""Expansion of many seed sets in one plan, against a plain walk and against single expansions."""

import random

import pytest

from gleaner.operators import entities, expand

HUB = "concept::hub"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    chunks, concepts = [], []
    for d in range(6):
        for a in range(5):
            for n, (clause, point) in enumerate([(None, None), *((f"K{c}", p) for c in range(rng.randint(0, 6)) for p in [None, *"ab"][: rng.randint(1, 3)]), (None, "x")]):
                chunks.append((f"d{d}a{a}n{n}", len(chunks), f"D{d}", f"A{a}" if a else "", clause, point))
                concepts.append((chunks[-1][0], [HUB] * (rng.random() < 0.6) + [f"concept::{rng.randint(0, 9)}" for _ in range(rng.randint(0, 2))]))
    ids = [c[0] for c in chunks]
    edges = [(i, rng.choice([*ids, "gone"]), rng.random(), r) for i in ids for r in range(1, 3)]
    c = spark.createDataFrame(chunks, "chunk_id string, seq long, document_id string, article string, clause string, point string").cache()
    keys = entities.key_rows(c, spark.createDataFrame(concepts, "chunk_id string, keys array<string>")).cache()
    return chunks, keys, {(r["chunk_id"], r["key_pos"]): r["key"] for r in keys.collect()}, edges, c, spark.createDataFrame(edges, "src string, dst string, sim double, rank int").cache()


def walk(world, seeds, most, hops, with_keys, min_sim):
    chunks, _, keys, edges, *_ = world
    at = {c[0]: c for c in chunks}
    own = {}
    for (c, pos), key in sorted(keys.items()):
        if key.startswith("concept::"):
            own.setdefault(c, []).append((pos, key))
    taken, frontier, extras = list(seeds), list(seeds), []
    for hop in range(1, hops + 1):
        lists = []
        for f in frontier:
            _, _, doc, art, clause, _ = at[f]
            kin = lambda c, clause=clause: 0 if c[4] is None and c[5] is None else (1 if c[5] is None else 2) if c[4] == clause else 3
            one = sorted(((0, kin(c), c[1], c[0]) for c in chunks if art and (c[2], c[3]) == (doc, art)))
            if with_keys:
                best = {}
                for pos, key in own.get(f, []):
                    for c in chunks:
                        if key in [k for _, k in own.get(c[0], [])]:
                            best[c[0]] = min(best.get(c[0], (99, 0)), (pos, c[1]))
                one += sorted((1, p, s, c) for c, (p, s) in best.items())
            if min_sim is not None:
                one += sorted((2, r, 0, dst) for src, dst, sim, r in edges if src == f and sim >= min_sim)
            lists.append([c for *_, c in one])
        new = []
        for pos in range(max(map(len, lists), default=0)):
            for one in lists:
                if pos < len(one) and one[pos] in at and one[pos] not in taken and one[pos] not in new and len(new) < most:
                    new.append(one[pos])
        extras += [(c, hop, i) for i, c in enumerate(new, 1)]
        taken, frontier = taken + new, new
        extras = extras[:most]
        kept = [c for c, h, _ in extras]
        taken = list(seeds) + kept
        frontier = [c for c, h, _ in extras if h == hop]
    return {(c, 0, i) for i, c in enumerate(seeds, 1)} | set(extras)


@pytest.mark.parametrize(("few", "most", "hops", "with_keys", "min_sim"), [(10_000, 7, 1, True, None), (0, 7, 2, True, 0.5), (10_000, 40, 2, True, 0.2), (0, 15, 3, False, 0.3), (10_000, 0, 1, True, None)])
def test_many_seed_sets_equal_a_walk(spark, world, monkeypatch, few, most, hops, with_keys, min_sim):
    monkeypatch.setattr(expand, "FEW", few)
    rng = random.Random(most)
    sets = {q: rng.sample([c[0] for c in world[0]], q % 6) for q in range(40)}
    seeds = spark.createDataFrame([(q, c, i) for q, own in sets.items() for i, c in enumerate(own)], "query_id long, chunk_id string, ord long")
    found = {}
    for r in expand.expand_many(seeds, world[4], most, hops, world[1] if with_keys else None, world[5] if min_sim is not None else None, min_sim or 0.0).collect():
        found.setdefault(r["query_id"], set()).add((r["chunk_id"], r["hop"], r["ord"]))
    assert found == {q: walk(world, own, most, hops, with_keys, min_sim) for q, own in sets.items() if own}


def test_a_thousand_seed_sets_equal_single_ones(spark, world):
    rng = random.Random(1)
    ids = [c[0] for c in world[0]]
    sets = {q: rng.sample(ids, 3) for q in range(1000)}
    seeds = spark.createDataFrame([(q, c, i) for q, own in sets.items() for i, c in enumerate(own)], "query_id long, chunk_id string, ord long")
    found = {}
    for r in expand.expand_many(seeds, world[4], 6, 2, world[1], world[5], 0.4).collect():
        found.setdefault(r["query_id"], set()).add((r["chunk_id"], r["hop"], r["ord"]))
    assert len(found) == 1000 and all(found[q] == walk(world, own, 6, 2, True, 0.4) for q, own in list(sets.items())[::10])
    for q in (17, 500):
        one = expand.expand(seeds.where(f"query_id = {q}").select("chunk_id", "ord"), world[4], 6, 2, world[1], world[5], 0.4)
        assert {tuple(r) for r in one.collect()} == found[q]


def test_a_hub_does_not_meet_all_that_ask(spark):
    """A concept of 20,000 chunks, asked by 200: rows that meet are askers times the reachable places, not all pairs."""
    n = 20_000
    chunks = spark.range(n).selectExpr("concat('c', id) chunk_id", "id seq", "concat('D', id) document_id", "cast(null as string) article", "cast(null as string) clause", "cast(null as string) point")
    keys = chunks.selectExpr("chunk_id", "seq", "'concept::hub' key", "1 key_pos")
    seeds = spark.range(200).selectExpr("id query_id", "concat('c', id * 7) chunk_id", "1 ord")
    got = expand.expand_many(seeds, chunks, 3, 1, keys).where("hop > 0").collect()
    want = {q: [c for c in range(n) if c != q * 7][:3] for q in range(200)}
    assert {(r["query_id"], r["chunk_id"], r["ord"]) for r in got} == {(q, f"c{c}", i) for q, own in want.items() for i, c in enumerate(own, 1)}
    frontier = seeds.selectExpr("query_id", "1 idx", "chunk_id")
    assert expand.concept_list(frontier, keys, 4, lambda df: df).count() == 200 * 4


def test_nearest_kin_and_concepts(spark, world):
    chunks, _, keys, *_ = world
    for most in (2, 9):
        want = set()
        for c in chunks:
            if c[3]:
                kin = lambda d, c=c: 0 if d[4] is None and d[5] is None else (1 if d[5] is None else 2) if d[4] == c[4] else 3
                near = sorted((kin(d), d[1], d[0]) for d in chunks if (d[2], d[3]) == (c[2], c[3]))
                want |= {(c[0], i, k, n) for n, (k, _, i) in enumerate(near[:most], 1)}
        assert {tuple(r) for r in expand.nearest_kin(world[4], most).collect()} == want
        held = {}
        for (c, pos), key in keys.items():
            if key.startswith("concept::"):
                held.setdefault(key, []).append(c)
        seq = {c[0]: c[1] for c in chunks}
        want = set()
        for c in seq:
            best = {}
            for (own, pos), key in keys.items():
                if own == c and key.startswith("concept::"):
                    for d in held[key]:
                        if d != c:
                            best[d] = min(best.get(d, (99, 0)), (pos, seq[d]))
            want |= {(c, d, *o) for d, o in sorted(best.items(), key=lambda b: (b[1], b[0]))[:most]}
        assert {tuple(r) for r in entities.nearest_by_concept(world[1], most).collect()} == want


def test_kin_meet_in_one_shuffle_unless_crowded(spark, world, monkeypatch):
    """Chunks are shuffled once, by article; crowded articles meet by joins, with the same rows, and copies are one chunk."""
    near = lambda rows: sorted(tuple(r) for r in expand.nearest_kin(rows, 3).collect())
    plan = expand.nearest_kin(world[4], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    with monkeypatch.context() as m:  # as many tasks as the chunks need
        m.setattr(expand, "CHUNKS", 2)
        parts = -(-world[4].where("article != ''").count() // 2)
        assert f", {parts})" in expand.nearest_kin(world[4], 3)._jdf.queryExecution().executedPlan().toString()
    copied = world[4].unionByName(world[4].where("seq % 3 = 0 or clause is null"))
    lost = copied.limit(5).selectExpr("chunk_id || 'x' chunk_id", "seq", "cast(null as string) document_id", "'A1' article", "clause", "point")
    want = near(world[4]), near(copied)
    assert near(copied.unionByName(lost)) == want[1]
    # an article of a document has about a hundredth of the chunks, so some are crowded and some are not
    for crowd, share in ((0, 10**9), (0, 30), (12, 10**9)):
        monkeypatch.setattr(expand, "CROWD", crowd)
        monkeypatch.setattr(expand, "SHARE", share)
        assert (near(world[4]), near(copied.unionByName(lost))) == want
    with_joins = expand.nearest_kin(world[4], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in with_joins and with_joins.count("Exchange") > 1


def test_a_hub_of_a_million_chunks_gives_linear_rows(spark):
    keys = spark.range(1_000_000).selectExpr("concat('c', lpad(id, 7, '0')) chunk_id", "id seq", "'concept::hub' key", "0 key_pos")
    found = entities.nearest_by_concept(keys, 3)
    assert found.count() == 3_000_000
    assert sorted(r["dst"] for r in found.where("src = 'c0500000'").collect()) == ["c0000000", "c0000001", "c0000002"]
