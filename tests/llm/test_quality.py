"""Quality trees: statistics by hand, held-out accuracy, and defined results."""

import glob
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import quality
from gleaner.llm.shared import table

SF = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")


def plain(text):
    """The statistics of a text by Python's own means."""
    data = (text or "").encode()
    out = dict.fromkeys(quality.STATISTICS, 0.0)
    lut = quality._lut()
    space = b" \t\n\v\f\r"
    words, word = [], b""
    for byte in data:
        if byte in space:
            words, word = (words + [word] if word else words), b""
        else:
            word += bytes([byte])
    words = words + [word] if word else words
    lines = data.split(b"\n")
    if data and not lines[-1]:
        lines.pop()
    lines = lines if data else []
    kinds = [quality.CLASSES[lut[b]] for b in data]
    out |= {"log_bytes": np.log1p(len(data)), "log_words": np.log1p(len(words)), "log_lines": np.log1p(len(lines))}
    if data:
        out |= {f"share_{c}": kinds.count(c) / len(data) for c in quality.CLASSES}
        lines_ = [b" ".join(x.split()) if False else x.strip(space) for x in lines]
        full = [x.lower() for x in lines_ if x]
        out |= {"mean_line": len(data) / len(lines), "empty_lines": 1 - len(full) / len(lines), "distinct_lines": len(set(full)) / len(full) if full else 0, "lines_stop_end": sum(x[-1:] in (b".", b"!", b"?") for x in full) / len(lines)}
    if words:
        n, low, size = len(words), [w.lower() for w in words], np.array([len(w) for w in words])
        kind = lambda b: quality.CLASSES[lut[b]]
        pairs = list(zip(low, low[1:], strict=False))
        out |= {
            "mean_word": size.mean(), "deviation_word": size.std(), "longest_word": size.max(), "short_words": (size <= 3).mean(), "long_words": (size > 15).mean(),
            "words_symbol_end": sum(len(w) > 1 and kind(w[-1]) in ("symbol", "mark") for w in words) / n, "words_lone_symbol": sum(len(w) == 1 and kind(w[-1]) in ("symbol", "mark") for w in words) / n,
            "words_capital": sum(kind(w[0]) == "upper" for w in words) / n, "words_all_upper": sum(sum(65 <= b <= 90 for b in w) > 1 and not any(97 <= b <= 122 for b in w) for w in words) / n, "words_digit": sum(any(48 <= b <= 57 for b in w) for w in words) / n,
            "distinct_words": len(set(low)) / n, "repeats_next": sum(a == b for a, b in pairs) / n, "repeats_second": sum(a == b for a, b in zip(low, low[2:], strict=False)) / n,
            "distinct_pairs": len(set(pairs)) / len(pairs) if pairs else 0, "commonest_word": max(low.count(w) for w in set(low)) / n,
            "marks_a_word": sum(k in ("mark", "symbol") for k in kinds) / n, "stops_a_word": kinds.count("stop") / n,
        }
    return [out[name] for name in quality.STATISTICS]


TEXTS = ["Hello, world. Hello again!\nA line\nA line\n\n  \nend", "", None, " \n ", "x", "A A A A b b", "§ ü%%% 12a | B2B | | #\tTHE!! END!!", "\n\nlast\n", "one two one two one two three", "ß" * 40 + " tail."]


def test_statistics():
    got = quality.Statistics().of(pa.array(TEXTS))
    for t, row in zip(TEXTS, got, strict=True):
        assert dict(zip(quality.STATISTICS, row.round(9), strict=True)) == pytest.approx(dict(zip(quality.STATISTICS, plain(t), strict=True)), abs=1e-6), t


def test_pieces_add_up(monkeypatch):
    """A text of many pieces has the statistics that it has as one; lines that a cut parts are as long as their parts."""
    text = "\n".join(f"Line {i % 7} of some words, number {i}!" for i in range(300))
    whole = quality.Statistics().of(pa.array([text, "a b"]))
    monkeypatch.setattr(quality, "PIECE", 600)
    pieces = quality.Statistics().of(pa.array([text, "a b"]))
    names = [i for i, s in enumerate(quality.STATISTICS) if "line" not in s and s not in ("repeats_next", "repeats_second", "distinct_pairs")]
    assert np.allclose(whole[:, names], pieces[:, names])
    assert np.abs(whole - pieces).max(0)[[i for i in range(len(quality.STATISTICS)) if i not in names and quality.STATISTICS[i] != "mean_line"]].max() < 0.1


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = quality.Model(x, y)
    bins = model.binned(x)
    for i in range(0, 600, 37):
        logit = model.base
        for t in range(quality.TREES):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (1 if bins[i, model.feature[t, node]] <= model.bin[t, node] else 2)
            logit += model.value[t, node - (2**quality.DEPTH - 1)]
        assert model.scores(x[i : i + 1])[0] == pytest.approx(1 / (1 + np.exp(-logit)))
    assert ((model.scores(x) > 0.5) == y).mean() > 0.98


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score double, label int")


def test_defined_results(spark):
    docs = frame(spark, [(i, t, 0.0, 1) for i, t in enumerate([*TEXTS, "long word " * 100_000])] + [(0, "again", None, None), (None, "no id", 1.0, 0)])
    none = spark.createDataFrame([(1, None), (None, 1), (2, 5), (999, 1)], "doc_id long, quality int")
    got = quality.classify(docs, none).collect()
    assert len(got) == docs.count() and {r["score"] for r in got} == {0.5}
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in [*range(len(TEXTS) + 1), None]}
    one = spark.createDataFrame([(i, 1) for i in range(11)], "doc_id long, quality int")
    assert {(r["score"], r["predicted"]) for r in quality.classify(docs, one).collect()} == {(1.0, 1)}
    assert quality.classify(docs.limit(0), one).count() == 0


@pytest.mark.skipif(not glob.glob(f"{SF}/documents.parquet"), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = [r["predicted"] == r["quality"] for r in rows]
    low = [r for r in rows if r["quality"] == 0]
    assert len(rows) > 40 and sum(right) / len(rows) > 0.95 and sum(r["predicted"] == 0 for r in low) >= 0.8 * len(low)
    assert all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality.classify(docs, labels).where("predicted = 1").count()
