"""Quality: histogram gradient-boosted trees over statistics of whole documents.

A document is a row of STATISTICS, counted by numpy over its bytes and word hashes: sizes, shares
of character classes, shapes of words and lines, and how much repeats.  Statistics add
up over pieces of PIECE bytes cut at white space, so a long text needs memory for a piece, its distinct word
hashes and its distinct line hashes.

Training reads labelled rows whose crc32(doc_id as text) mod 5 is not 0, of them the SAMPLE
with the smallest hash: a documented bound on what reaches the driver, which gets
their statistics, not their texts.  Statistics are cut into BINS quantile bins; each tree
grows level by level from histograms of gradients and second derivatives, and is stored as
a complete tree in flat arrays (feature, bin, value), so all rows go down all trees
by numpy indexing.  The label, lang, source and doc_id are never inputs of a score.

Defined results: a null text is an empty one, whose statistics are 0; a document with
several label rows trains once for each distinct label; null labels, labels other than 0
and 1 and labels without a document are ignored; of texts with one doc_id the least trains; without usable labels
of both kinds every score is the share of label 1, or 0.5 if there are none; repeated
rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, mix, slices, text_bytes
from .shared import cut

#: Labelled rows that train, at most; bins of a statistic; trees, their depth and their step; least rows' weight of a leaf.
SAMPLE, BINS, TREES, DEPTH, RATE, LEAST = 20_000, 64, 80, 4, 0.15, 5.0
L2 = 1.0
THRESHOLD = 0.3
PIECE = 256 << 10
#: Character classes by byte; bytes over 127 are parts of letters beyond ASCII.
CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "comma", "mark", "symbol", "wide")
SYMBOLS, STOPS, COMMAS = b"#$%&*@^~|\\/<>=+_{}[]`", b".!?", b",;:"
STATISTICS = (
    "log_bytes", "log_words", "log_lines", *(f"share_{c}" for c in CLASSES),
    "mean_word", "deviation_word", "longest_word", "short_words", "long_words",
    "words_symbol_end", "words_lone_symbol", "words_capital", "words_all_upper", "words_digit",
    "distinct_words", "repeats_next", "repeats_second", "distinct_pairs", "commonest_word",
    "mean_line", "distinct_lines", "empty_lines", "lines_stop_end", "marks_a_word", "stops_a_word",
)


def _lut() -> np.ndarray:
    table = np.full(256, CLASSES.index("mark"), np.uint8)
    for name, members in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (9, 11, 12, 13, 32)), ("line", (10,)), ("stop", STOPS), ("comma", COMMAS), ("symbol", SYMBOLS), ("wide", range(128, 256))):
        table[list(members)] = CLASSES.index(name)
    return table


class Statistics:
    """Statistics of texts; one per task, so tables are built once."""

    def __init__(self):
        self.words, self.lut = Words(), _lut()

    def of(self, texts: pa.Array) -> np.ndarray:
        """A row of STATISTICS for each text."""
        data, offsets = text_bytes(texts)
        n = len(offsets) - 1
        out = np.zeros((n, len(STATISTICS)))
        small = np.flatnonzero(np.diff(offsets) <= PIECE)
        if len(small) == n:
            return self._finish([self._piece(data, offsets)], n)
        # a text of more than a piece is alone
        for i in range(n):
            own = data[offsets[i] : offsets[i + 1]]
            out[i] = self._finish([self._piece(own[a:b], np.array([0, b - a])) for a, b in self._cuts(own)], 1)[0]
        return out

    def _cuts(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pieces that end after white space, unless a word is longer than a piece."""
        start = 0
        while start < len(data) or not start:
            stop = min(start + PIECE, len(data))
            if stop < len(data):
                gap = np.flatnonzero(self.words.space[data[start:stop]])
                stop = start + int(gap[-1]) + 1 if len(gap) else stop
            yield start, stop
            if stop == len(data):
                return
            start = stop

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> dict:
        """Sums over rows, and the (row, hash) pairs of words, word pairs and lines with how often each stands there."""
        n = len(offsets) - 1
        kind = self.lut[data]
        of_byte = np.repeat(np.arange(n), np.diff(offsets))
        sums = {"bytes": np.diff(offsets).astype(float), "classes": np.bincount(of_byte * len(CLASSES) + kind, minlength=n * len(CLASSES)).reshape(n, -1).astype(float)}
        starts, ends, first = self.words.spans(data, offsets)
        row = np.repeat(np.arange(n), np.diff(first))
        length = (ends - starts).astype(float)
        add = lambda v: np.bincount(row, v, n)
        begin, end = (kind[starts], kind[ends - 1]) if len(starts) else (np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        odd = [CLASSES.index(c) for c in ("symbol", "mark")]
        symbol = np.isin(end, odd)
        upper = np.append(0, np.cumsum(kind == CLASSES.index("upper")))
        lower = np.append(0, np.cumsum(kind == CLASSES.index("lower")))
        digit = np.append(0, np.cumsum(kind == CLASSES.index("digit")))
        within = lambda c: c[ends] - c[starts]
        h = self.words.hashes(data, starts, ends)
        next_, second = (np.append((h[k:] == h[:-k]) & (row[k:] == row[:-k]), np.zeros(min(k, len(h)), bool)) if len(h) > k else np.zeros(len(h), bool) for k in (1, 2))
        pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[row[1:] == row[:-1]] if len(h) > 1 else np.zeros(0, np.uint64)
        sums |= {
            "words": add(np.ones(len(row))), "length": add(length), "square": add(length**2), "short": add(length <= 3), "long": add(length > 15), "symbol_end": add(symbol & (length > 1)), "lone_symbol": add(symbol & (length == 1)),
            "capital": add(begin == CLASSES.index("upper")), "all_upper": add((within(upper) > 1) & (within(lower) == 0)), "digit": add(within(digit) > 0), "next": add(next_), "second": add(second),
        }
        longest = np.zeros(n)
        np.maximum.at(longest, row, length)
        # lines: runs of bytes between line ends, without white space at their ends
        brk = np.zeros(len(data) + 1, bool)
        brk[offsets] = True
        brk[1:] |= np.append(kind == CLASSES.index("line"), [])[: len(data)].astype(bool)
        edges = np.flatnonzero(brk)
        a, b = edges[:-1], edges[1:]
        of_line = of_byte[a] if len(a) else np.zeros(0, np.int64)
        lines = np.bincount(of_line, minlength=n).astype(float)
        w0, w1 = np.searchsorted(starts, a), np.searchsorted(starts, b)
        full = w1 > w0
        sums |= {"lines": lines, "empty": np.bincount(of_line, ~full, n)}
        stop = np.zeros(len(a), bool)
        stop[full] = end[w1[full] - 1] == CLASSES.index("stop")
        sums["stop_end"] = np.bincount(of_line, stop, n)
        line = self.words.hashes(data, starts[w0[full]], ends[w1[full] - 1]) if full.any() else np.zeros(0, np.uint64)
        pair_row = row[1:][row[1:] == row[:-1]] if len(h) > 1 else np.zeros(0, np.int64)
        return {"sums": sums, "longest": longest, "word": _counts(row, h), "pair": _counts(pair_row, pair), "line": _counts(of_line[full], line)}

    @staticmethod
    def _finish(pieces: list[dict], n: int) -> np.ndarray:
        s = {k: sum(p["sums"][k] for p in pieces) for k in pieces[0]["sums"]}
        longest = np.max([p["longest"] for p in pieces], 0)
        kinds = {}
        for name in ("word", "pair", "line"):
            row, _, count = pieces[0][name] if len(pieces) == 1 else _counts(*(np.concatenate([p[name][i] for p in pieces]) for i in range(3)))
            most = np.zeros(n)
            np.maximum.at(most, row, count)
            kinds[name] = np.bincount(row, minlength=n), np.bincount(row, count, n), most
        of = lambda a, b: np.divide(a, b, out=np.zeros(n), where=np.asarray(b) > 0)
        words, size, lines = s["words"], s["bytes"], s["lines"]
        mean = of(s["length"], words)
        classes = s["classes"]
        marks = classes[:, [CLASSES.index(c) for c in ("mark", "symbol")]].sum(1)
        columns = [
            np.log1p(size), np.log1p(words), np.log1p(lines), *(of(classes[:, i], size) for i in range(len(CLASSES))),
            mean, np.sqrt(np.maximum(of(s["square"], words) - mean**2, 0)), longest, of(s["short"], words), of(s["long"], words),
            of(s["symbol_end"], words), of(s["lone_symbol"], words), of(s["capital"], words), of(s["all_upper"], words), of(s["digit"], words),
            of(kinds["word"][0], kinds["word"][1]), of(s["next"], words), of(s["second"], words), of(kinds["pair"][0], kinds["pair"][1]), of(kinds["word"][2], words),
            of(size, lines), of(kinds["line"][0], kinds["line"][1]), of(s["empty"], lines), of(s["stop_end"], lines), of(marks, words), of(classes[:, CLASSES.index("stop")], words),
        ]
        return np.stack(columns, 1)


def _counts(row: np.ndarray, h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs with how often each stands."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h))).astype(float) if n is None else np.add.reduceat(n[order], at) if len(at) else np.zeros(0)
    return row[at], h[at], count


class Model:
    """Boosted trees in flat arrays: node i of a complete tree has children 2 i + 1 and 2 i + 2."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.flat = None
        if not len(y) or y.min() == y.max():
            self.flat = float(y.mean()) if len(y) else 0.5
            return
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.cuts = cuts
        bins = self.binned(x)
        inner = 2**DEPTH - 1
        self.feature, self.bin = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), BINS, np.int64)
        self.value = np.zeros((TREES, inner + 1))
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(len(y), self.base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-f))
            leaf = self._grow(t, bins, y - p, p * (1 - p))
            f += self.value[t, leaf]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(self.cuts)], 1)

    def _grow(self, t: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Fill tree t level by level; the leaf of each row."""
        n, d = bins.shape
        place = np.zeros(n, np.int64)  # within the level
        for level in range(DEPTH):
            width = 2**level
            gain = np.zeros((d, width, BINS))
            for i in range(d):
                at = place * BINS + bins[:, i]
                gs, hs = (np.cumsum(np.bincount(at, v, width * BINS).reshape(width, BINS), 1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                good = (hs >= LEAST) & (ht - hs >= LEAST)
                gain[i] = np.where(good, gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2), 0)
            best = gain.transpose(1, 0, 2).reshape(width, -1)
            pick = best.argmax(1)
            node = width - 1 + np.arange(width)
            split = best[np.arange(width), pick] > 1e-9
            self.feature[t, node] = np.where(split, pick // BINS, 0)
            self.bin[t, node] = np.where(split, pick % BINS, BINS)  # all rows go left
            own = width - 1 + place
            place = 2 * place + (bins[np.arange(n), self.feature[t, own]] > self.bin[t, own])
        sums = [np.bincount(place, v, 2**DEPTH) for v in (g, h)]
        self.value[t] = RATE * sums[0] / (sums[1] + L2)
        return place

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(x), self.flat)
        bins = self.binned(x)
        logit, rows = np.full(len(x), self.base), np.arange(len(x))[:, None]
        trees = np.arange(TREES)[None]
        node = np.zeros((len(x), TREES), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[rows, self.feature[trees, node]] > self.bin[trees, node])
        logit += self.value[trees, node - (2**DEPTH - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the training rows of labels (doc_id, quality) and their texts in docs."""
    labels = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("y")).distinct()
    labels = labels.where(F.crc32(F.col("__id").cast("string")) % 5 != 0)
    bound = cut(labels.orderBy(F.xxhash64("__id"), "__id", "y").limit(SAMPLE))  # SAMPLE rows at most, so it may be broadcast
    ids = bound.select("__id").distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    texts = texts.groupBy("__id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics = Statistics()
        for batch in batches:
            for part in slices(batch):
                x = statistics.of(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("__id"), lists], ["__id", "x"])

    found = texts.mapInArrow(counted, f"__id {dict(texts.dtypes)['__id']}, x array<double>")
    rows = found.join(bound, "__id").orderBy("__id", "y").select("y", "x").toArrow()  # SAMPLE rows of statistics
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    return Model(x, rows["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # TREES trees of 2 ** DEPTH leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics, model = Statistics(), sent.value
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(statistics.of(part.column("text"))))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(train(docs, labels)), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        statistics, model = Statistics(), sent.value
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.scores(statistics.of(part.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(run, schema)
