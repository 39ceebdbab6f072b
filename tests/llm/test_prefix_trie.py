"""The prefix trie against a dictionary of prefixes, with small and large buckets."""

import hashlib
import random
import zlib

import pytest

from gleaner.llm import prefixtrie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, node string"


def words(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def brute(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(members) - 1) * words(path[-1][1]) if path else 0
    sha = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha([c for c in m if len(full[c]) == len(p)])) for p, m in nodes.items()
    )


def made(seed, n, deep):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, n * 3), n):
        for t in range(rng.choice([1, 1, 2, 3, 4, 5, deep])):
            common = rng.random() < 0.7
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", None]) if t and not common else "user", f"hello {t}" if common else rng.choice(["a b", "", None, "x\ty", f"own {c}"])))
    return rows


@pytest.mark.parametrize(("seed", "n", "deep", "local"), [(1, 60, 6, 8192), (2, 200, 9, 8192), (3, 200, 9, 12), (4, 300, 30, 3), (5, 120, 12, 1), (6, 1, 1, 8192)])
def test_equals_brute_force(spark, monkeypatch, seed, n, deep, local):
    monkeypatch.setattr(pt, "LOCAL", local)
    rows = made(seed, n, deep)
    rows += rows[:3] + [(None, 0, "user", "no id")]  # repeated turns
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA)
    assert sorted(map(tuple, pt.prefix_trie(df).collect()), key=lambda r: (r[0], r[1], r)) == sorted(brute(rows), key=lambda r: (r[0], r[1], r))


@pytest.mark.parametrize(("local", "turns"), [(8192, 400), (50, 40)])
def test_copies_long_conversations_and_texts(spark, monkeypatch, local, turns):
    monkeypatch.setattr(pt, "LOCAL", local)
    long = [(20 * i, t, "user", f"turn {t}") for i in range(3) for t in range(turns)]
    copies = [(1000 + 20 * i, t, "user", f"same {t}") for i in range(150) for t in range(3)]
    huge = [(5000, 0, "user", "word " * 200_000), (5020, 0, "user", "word " * 200_000)]
    rows = long + copies + huge
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    assert sorted(map(tuple, pt.prefix_trie(df).collect()), key=repr) == sorted(brute(rows), key=repr)


def test_empty_table(spark):
    assert pt.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_turnless_conversations(spark):
    """Conversations whose own turns are all replaced by none are members of the root alone."""
    rows = [(c, 0, "user", "x") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    got = [tuple(r) for r in pt.prefix_trie(spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA)).collect()]
    assert got == brute(rows) and got[0][4:7] == (0, 1, 0)
