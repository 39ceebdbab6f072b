"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised (lower case; every run of ASCII characters
other than letters and digits is one space).  A text holds an item if some substring
is within the item's edit budget, EDITS of its length.  A match with k edits keeps at
least m - q + 1 - k * q of the item's q-grams on diagonals that span at most k, so
shared q-grams are counted in overlapping diagonal bands of 2 * (k + 1), regions that
reach the bound are kept, and each is verified by alignment within its band.  Grams have
LONG_Q bytes for items of LONG bytes or more and SHORT_Q for shorter ones, so the bound is
at least 1 for each item's whole budget.  Items under LEAST bytes have no edits to spare;
they are matched exactly between word bounds.

Hits are taken in portions of HITS: rows together as long as they fit, a row with more by
ranges of items, so a benchmark whose items share their phrases costs memory for one portion.
Many regions are aligned at once, and equal regions of an item once.

Defined results: null or empty texts and items hold and match nothing; repeated items
count once an item_id; null item_ids are not reported but contaminate; repeated rows get
a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, slices, text_bytes

#: Edits as a share of an item's length; bytes of grams, and bytes from which items have the longer ones, or any.
EDITS, LONG_Q, SHORT_Q, LONG, LEAST = 0.1, 8, 4, 48, 8
#: Shared q-grams that are looked at together, and cells of windows that are aligned together.
HITS, CELLS = 1 << 21, 1 << 21
#: Benchmark bytes that are broadcast at once; a larger benchmark takes several passes.
PASS_BYTES = 16 << 20


class Normaliser:
    def __init__(self):
        self.lut = np.arange(256, dtype=np.uint8)
        for i in range(128):
            if not chr(i).isalnum():
                self.lut[i] = 32

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes of all rows and their offsets."""
        data, offsets = text_bytes(pc.utf8_lower(texts))
        data = self.lut[data]
        if not len(data):
            return data, offsets
        keep = data != 32
        keep[1:] |= data[:-1] != 32
        at = np.append(0, np.cumsum(keep))
        return data[keep], at[offsets]


def grams(words: Words, data: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes from each position."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return words.hashes(data, at, at + q)


class Index:
    """The q-grams of items: for each gram its items and positions."""

    def __init__(self, items: list[np.ndarray], numbers: list[int], q: int):
        self.items, self.numbers, self.q = items, numbers, q
        words = Words(lower=False)
        hashes = [grams(words, x, q) for x in items]
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(h, kind="stable")
        count = np.array([len(x) for x in hashes], np.int64)
        self.item = np.repeat(np.arange(len(items)), count)[order]
        self.pos = (np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count))[order]
        self.grams, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h))
        self.gram = np.repeat(np.arange(len(self.grams)), np.diff(self.first))
        self.length = np.array([len(x) for x in items], np.int64)
        self.edits = (EDITS * self.length).astype(np.int64)
        self.least = self.length - q + 1 - self.edits * q
        bits = max(16, int(len(self.grams) * 32).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.grams >> self.shift).astype(np.int64)] = True

    def shared(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, gram number) of every position whose gram some item has."""
        at = np.flatnonzero(self.maybe[(hashes >> self.shift).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        row = np.searchsorted(offsets, at, "right") - 1
        good = (self.grams[k] == hashes[at]) & (at + self.q <= offsets[row + 1])
        return row[good], (at - offsets[row])[good], k[good]

    def regions(self, hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, items, band starts) of the bands whose shared q-grams reach the lemma's bound."""
        row, at, k = self.shared(hashes, offsets)
        n = self.first[k + 1] - self.first[k]
        ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row)) if len(row) else np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(n))[ends]
        start, i = 0, 0
        while i < len(ends):
            base = int(total[i - 1]) if i else 0
            stop = max(i + 1, int(np.searchsorted(total, base + HITS, "right")))
            part = slice(start, int(ends[stop - 1]))
            if total[stop - 1] - base <= HITS:
                where = np.repeat(self.first[k[part]] - np.cumsum(n[part]) + n[part], n[part]) + np.arange(int(n[part].sum()))
                yield from self._bands(*(np.repeat(v[part], n[part]) for v in (row, at)), where)
            else:
                yield from self._by_items(int(row[part][0]), at[part], k[part])
            start, i = part.stop, stop

    def _by_items(self, row: int, at: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for one row with many hits, by ranges of the items that have enough of them."""
        order = np.argsort(k, kind="stable")
        at, k = at[order], k[order]
        count = np.bincount(k, minlength=len(self.grams))
        first = np.cumsum(count) - count
        hits = np.bincount(self.item, count[self.gram], len(self.items)).astype(np.int64)
        entries = np.flatnonzero((hits >= self.least)[self.item] & (count[self.gram] > 0))
        entries = entries[np.argsort(self.item[entries], kind="stable")]
        weight = np.cumsum(count[self.gram[entries]])
        bounds = np.append(np.flatnonzero(np.diff(self.item[entries])) + 1, len(entries))
        a = 0
        while a < len(entries):
            base = int(weight[a - 1]) if a else 0
            fit = bounds[(bounds > a) & (weight[bounds - 1] <= base + HITS)]
            b = int(fit[-1]) if len(fit) else int(bounds[bounds > a][0])
            own = entries[a:b]
            n = count[self.gram[own]]
            where = np.repeat(first[self.gram[own]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            yield from self._bands(np.full(len(where), row), at[where], np.repeat(own, n))
            a = b

    def _bands(self, row: np.ndarray, at: np.ndarray, where: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        # an item can only reach its bound in a row with so many hits of it
        item, pos = self.item[where], self.pos[where]
        kinds, which, n = np.unique(row * len(self.items) + item, return_inverse=True, return_counts=True)
        good = (n >= self.least[kinds % len(self.items)])[which]
        at, item, pos, which = at[good], item[good], pos[good], which[good]
        if not len(at):
            return
        band = (at - pos) // (self.edits[item] + 1)
        low, span = int(band.min()) - 1, int(band.max() - band.min()) + 2
        long = int(self.length.max())
        key = np.append(which * span + (band - low), which * span + (band - 1 - low))
        key = np.unique(key * long + np.tile(pos, 2)) // long
        key, n = np.unique(key, return_counts=True)
        kind, band = kinds[key // span], key % span + low
        item = kind % len(self.items)
        good = n >= self.least[item]
        if good.any():
            yield (kind // len(self.items))[good], item[good], (band * (self.edits[item] + 1))[good]

    def held(self, words: Words, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, item numbers) of the items that rows hold; a pair may come more than once."""
        for row, item, band in self.regions(grams(words, data, self.q), offsets):
            k = self.edits[item]
            # diagonals band .. band + 2k + 1, and k edits to either side
            low, high = offsets[row], offsets[row + 1]
            start = low + band - k
            stop = start + self.length[item] + 4 * k + 1
            a, b = np.clip(start, low, high), np.clip(stop, low, high)
            key = np.stack([item.astype(np.uint64), (a - start).astype(np.uint64), (stop - b).astype(np.uint64), words.hashes(data, a, b)], 1)
            _, first, which = np.unique(key, axis=0, return_index=True, return_inverse=True)
            good = self._aligned(data, start[first], a[first], b[first], item[first])[which.ravel()]
            yield row[good], np.array(self.numbers)[item[good]]

    def _aligned(self, data: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether each item is within its edits of a substring of its window, on the 4k + 2 diagonals from the window's start.

        What lies outside of low to high matches nothing, so a cell there costs as much as a
        character of the item that is left out.
        """
        out = np.zeros(len(item), bool)
        order = np.lexsort((self.length[item], self.edits[item]))
        at = 0
        while at < len(order):
            k = int(self.edits[item[order[at]]])
            width = 4 * k + 2
            same = order[at : at + max(1, CELLS // (int(self.length[item[order[at]]]) + 10 + width))]
            same = same[self.edits[item[same]] == k]
            at += len(same)
            length, slope = self.length[item[same]], np.arange(width, dtype=np.int32)
            most = int(length.max())
            where = start[same, None] + np.arange(most + width - 1)
            text = np.where((where >= low[same, None]) & (where < high[same, None]), data[np.clip(where, 0, len(data) - 1)].astype(np.int16), np.int16(-1))
            want = np.full((len(same), most), -2, np.int16)
            want[np.arange(most) < length[:, None]] = np.concatenate([self.items[i] for i in item[same].tolist()])
            row = np.zeros((len(same), width), np.int32)
            for i in range(most):
                new = row + (text[:, i : i + width] != want[:, i : i + 1])
                np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
                row = np.minimum.accumulate(new - slope, axis=1) + slope
                ended = length == i + 1
                if ended.any() or i % 16 == 15:
                    best = row.min(1)
                    out[same[ended & (best <= k)]] = True
                    on = ~ended & (best <= k)
                    same, length, text, want, row = (v[on] for v in (same, length, text, want, row))
                    if not len(same):
                        break
        return out


class Benchmark:
    """Normalised items: indexes of q-grams, and short items by length."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.norm, self.words = Normaliser(), Words(lower=False)
        data, offsets = self.norm.of(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        long, middle, self.short = [], [], {}
        for k in range(len(items)):
            x = data[offsets[k] : offsets[k + 1]]
            x = x[int(len(x) > 0 and x[0] == 32) : len(x) - int(len(x) > 1 and x[-1] == 32)]
            if len(x) >= LEAST:
                (long if len(x) >= LONG else middle).append((x, k))
            elif len(x):
                self.short.setdefault(len(x), {}).setdefault(x.tobytes(), []).append(k)
        self.indexes = [Index(*map(list, zip(*own, strict=True)), q) for own, q in ((long, LONG_Q), (middle, SHORT_Q)) if own]

    def found(self, texts: pa.Array) -> list[list[int]]:
        """Item numbers that each row holds."""
        out: list[set[int]] = [set() for _ in range(len(texts))]
        data, offsets = self.norm.of(texts)
        for index in self.indexes:
            for rows, numbers in index.held(self.words, data, offsets):
                for row, number in zip(rows.tolist(), numbers.tolist(), strict=True):
                    out[row].add(number)
        if self.short:
            self._short(data, offsets, out)
        return [sorted(s) for s in out]

    def _short(self, data: np.ndarray, offsets: np.ndarray, out: list[set[int]]) -> None:
        """Items between word bounds: spaces and the ends of a text."""
        if not len(data):
            return
        stop = np.zeros(len(data) + 1, bool)
        stop[offsets] = True
        stop[:-1] |= data == 32
        start = np.zeros(len(data) + 1, bool)
        start[offsets] = True
        start[1:] |= data == 32
        at = np.flatnonzero(start[:-1])
        for length, items in self.short.items():
            own = at[at + length <= len(data)]
            own = own[stop[own + length]]
            row = np.searchsorted(offsets, own, "right") - 1
            own, row = (v[own + length <= offsets[row + 1]] for v in (own, row))
            for a, r in zip(own.tolist(), row.tolist(), strict=True):
                out[r].update(items.get(data[a : a + length].tobytes(), ()))


class Items:
    """What is broadcast: the items, and in each worker the index that is built of them once."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.items, self.built = items, None

    def benchmark(self) -> Benchmark:
        if self.built is None:
            self.built = Benchmark(self.items)
        return self.built


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs' rows with __hit (holds an item) and __items (its item_ids, in order)."""
    spark, names = docs.sparkSession, docs.columns
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs.withColumns({"__hit": F.lit(False), "__items": F.array().cast("array<bigint>")})
    for i in range(passes):
        part = benchmark.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i))
        rows = part.select(F.col("item_id").cast("long"), "text").distinct().collect()  # about PASS_BYTES
        sent = spark.sparkContext.broadcast(Items(sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = sent.value.benchmark()
            for batch in batches:
                for part in slices(batch):
                    found = bench.found(part.column("text"))
                    before = zip(part.column("__hit").to_pylist(), part.column("__items").to_pylist(), strict=True)
                    hit, items = [], []
                    for now, (was, have) in zip(found, before, strict=True):
                        hit.append(was or bool(now))
                        items.append(sorted({*have, *(bench.ids[k] for k in now if bench.ids[k] is not None)}))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(hit, pa.bool_()), pa.array(items, pa.list_(pa.int64()))], [*names, "__hit", "__items"])

        out = out.mapInArrow(run, f"{fields}, __hit boolean, __items array<bigint>")
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, contaminated, n_items, item_ids), one for each row of docs."""
    found = find(docs.select(F.col("doc_id").cast("long"), "text"), benchmark.select("item_id", "text"))
    return found.select("doc_id", F.col("__hit").alias("contaminated"), F.size("__items").cast("long").alias("n_items"), F.col("__items").alias("item_ids"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their columns."""
    return find(docs, benchmark.select("item_id", "text")).where("not __hit").select(*docs.columns)
