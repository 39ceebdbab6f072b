"""Toxicity: a logistic classifier on word presence with counterfactual regularisation.

A text is the set of its words, lower-cased and stripped of punctuation at the ends, and
of their beginnings of PREFIXES bytes (insults share stems; identity terms have none, so
a swap changes all that they add), hashed to 64 bits.  Those
that split the training labels significantly become features (at most FEATURES).  Besides log loss and an L2 penalty, training penalises the squared
change of a text's logit when identity terms in it are swapped for others, so a neutral
mention of a group does not move the score.  Whole texts are scored and every row is.

Training reads labelled rows whose crc32(doc_id as text) mod 3 is not 1, of them the
SAMPLE with the smallest hash: a documented bound on what reaches the driver.  The
label, lang, source and doc_id are never inputs of a score.

Defined results: a null or wordless text gets the score of the bias alone; a document
with several label rows trains once for each distinct label; null labels and labels
without a document are ignored; without usable labels of both kinds every score is the
share of toxic labels, or 0 if there are none; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, mix, slices, text_bytes
from .shared import cut

#: Labelled rows that train at most; features at most; rows that must hold a feature; least |z| of a feature.
SAMPLE, FEATURES, LEAST_ROWS, LEAST_Z = 8_000, 4096, 4, 5.0
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.7
#: Weights of the L2 penalty (of all rows) and of the counterfactual penalty, and swaps of each text.
L2, COUNTERFACTUAL, SWAPS = 1e-4, 1.0, 4
SEED = 11
#: Identity terms by kind and language; a term is swapped for others of its kind and language.
IDENTITY = {
    "faith": {
        "en": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"],
        "de": ["christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken"],
        "fr": ["chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée", "catholique"],
        "es": ["cristiano", "musulmán", "judío", "hindú", "budista", "ateo", "católico"],
    },
    "gender": {
        "en": ["woman", "man", "female", "male", "girl", "boy", "transgender", "nonbinary"],
        "de": ["frau", "mann", "weiblich", "männlich", "mädchen", "junge", "transgender"],
        "fr": ["femme", "homme", "féminin", "masculin", "fille", "garçon", "transgenre"],
        "es": ["mujer", "hombre", "femenino", "masculino", "niña", "niño", "transgénero"],
    },
    "orientation": {
        "en": ["gay", "lesbian", "bisexual", "straight", "queer"],
        "de": ["schwul", "lesbisch", "bisexuell", "heterosexuell", "queer"],
        "fr": ["gay", "lesbienne", "bisexuel", "hétérosexuel", "queer"],
        "es": ["gay", "lesbiana", "bisexual", "heterosexual", "queer"],
    },
    "origin": {
        "en": ["black", "white", "asian", "african", "european", "latino", "arab", "immigrant", "refugee"],
        "de": ["schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber", "einwanderer", "flüchtling"],
        "fr": ["noir", "blanc", "asiatique", "africain", "européen", "arabe", "immigré", "réfugié"],
        "es": ["negro", "blanco", "asiático", "africano", "europeo", "árabe", "inmigrante", "refugiado"],
    },
    "age": {
        "en": ["old", "young", "elderly", "teenage"],
        "de": ["alt", "jung", "senioren", "jugendliche"],
        "fr": ["vieux", "jeune", "âgé", "adolescent"],
        "es": ["viejo", "joven", "anciano", "adolescente"],
    },
    "ability": {
        "en": ["disabled", "blind", "deaf", "autistic"],
        "de": ["behindert", "blind", "taub", "autistisch"],
        "fr": ["handicapé", "aveugle", "sourd", "autiste"],
        "es": ["discapacitado", "ciego", "sordo", "autista"],
    },
}


class Tokens:
    """Hashes of the words of texts; a word's punctuation at its ends is left out."""

    def __init__(self):
        self.words = Words()
        self.edge = np.zeros(256, bool)
        self.edge[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
        self.terms = np.array([h for kind in IDENTITY.values() for terms in kind.values() for h in self.whole(terms)], np.uint64)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all rows' words, word by word with their beginnings, and each hash's row."""
        data, offsets = text_bytes(texts)
        starts, ends, rows = self.words.spans(data, offsets)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        if not len(starts):
            return np.zeros(0, np.uint64), row
        # the next byte, and the one before, that is no punctuation; a word of nothing else keeps one byte
        place, kept = np.arange(len(data)), ~self.edge[data]
        after = np.minimum.accumulate(np.where(kept, place, len(data))[::-1])[::-1]
        before = np.maximum.accumulate(np.where(kept, place, -1))
        starts = np.minimum(after[starts], ends - 1)
        ends = np.maximum(before[ends - 1] + 1, starts + 1)
        hashes, of = [self.words.hashes(data, starts, ends)], [row]
        stem = ~np.isin(hashes[0], self.terms)
        for k in PREFIXES:
            long = np.flatnonzero((ends - starts > k) & stem)
            hashes.append(mix(self.words.hashes(data, starts[long], starts[long] + k) ^ np.uint64(k)))
            of.append(row[long])
        return np.concatenate(hashes), np.concatenate(of)

    def whole(self, words: list[str]) -> list[int]:
        data, offsets = text_bytes(pa.array(words))
        return self.words.hashes(data, offsets[:-1], offsets[1:]).tolist()


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def identity_hashes() -> list[list[int]]:
    tokens = Tokens()
    return [tokens.whole(terms) for kind in IDENTITY.values() for terms in kind.values()]


class Model:
    """Sorted feature hashes, their weights, and the bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float, flat: float | None = None):
        self.features, self.weights, self.bias, self.flat = features, weights, bias, flat
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(features & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def presence(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature number) of each feature that a row has, once."""
        if not len(self.features) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        few = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
        hashes, row = hashes[few], row[few]
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        hit = np.flatnonzero(self.features[at] == hashes)
        both = np.unique(row[hit] * len(self.features) + at[hit])
        return both // len(self.features), both % len(self.features)

    def scores(self, tokens: Tokens, texts: pa.Array) -> np.ndarray:
        n = len(texts)
        if self.flat is not None:
            return np.full(n, self.flat)
        row, feature = self.presence(*tokens.of(texts))
        logit = self.bias + np.bincount(row, self.weights[feature], n)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def class_counts(tokens: Tokens, texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct hash with how many rows and how many toxic rows hold it."""
    hashes, row = tokens.of(texts)
    order = np.lexsort((row, hashes))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    words, first = np.unique(hashes, return_index=True)
    if not len(words):
        return words, first, first
    return words, np.diff(np.append(first, len(hashes))), np.add.reduceat(y[row].astype(np.int64), first)


def with_identity(words: np.ndarray) -> np.ndarray:
    """Feature hashes in order, with all identity terms."""
    return np.unique(np.concatenate([words.astype(np.uint64), np.array([t for kind in identity_hashes() for t in kind], np.uint64)]))


def fit_texts(texts: list[str | None], labels: list[int], counterfactual: float = COUNTERFACTUAL) -> Model:
    """Train on texts in memory."""
    y, column = np.array(labels, float), pa.array(texts, pa.string())
    tokens = Tokens()
    features = np.zeros(0, np.uint64)
    if len(y) and y.min() < y.max():
        words, n, toxic = class_counts(tokens, column, y)
        z = (toxic - n * y.mean()) / np.sqrt(n * y.mean() * (1 - y.mean()))
        good = np.flatnonzero((np.abs(z) >= LEAST_Z) & (n >= LEAST_ROWS))
        features = words[good[np.argsort(-np.abs(z[good]), kind="stable")[:FEATURES]]]
    features = with_identity(features)
    return fit(features, *Model(features, np.zeros(0), 0.0).presence(*tokens.of(column)), y, counterfactual)


def fit(features: np.ndarray, row: np.ndarray, feature: np.ndarray, y: np.ndarray, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Weights by Newton steps with conjugate gradients, from the (row, feature) pairs of 0/1 labels y."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0, float(y.mean()) if len(y) else 0.0)
    model = Model(features, np.zeros(0), 0.0)
    d, n = len(features), len(y)
    swaps = swapped(model, row, feature, n)

    def times(r, c, w):
        return np.bincount(r, w[c], n)

    def back(r, c, v):
        return np.bincount(c, v[r], d)

    def change(w):
        return np.bincount(swaps[0], swaps[2] * w[swaps[1]], swaps[3]) if swaps[3] else np.zeros(0)

    def change_back(v):
        return np.bincount(swaps[1], swaps[2] * v[swaps[0]], d) if swaps[3] else np.zeros(d)

    w, b = np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(times(row, feature, w) + b, -40, 40)))
        gw = back(row, feature, p - y) + L2 * n * w + counterfactual * change_back(change(w))
        gb = float((p - y).sum())
        s = p * (1 - p) + 1e-6

        def hessian(v, s=s):
            t = s * (times(row, feature, v[:d]) + v[d])
            return np.append(back(row, feature, t) + L2 * n * v[:d] + counterfactual * change_back(change(v[:d])), t.sum())

        g = np.append(gw, gb)
        x, r = np.zeros(d + 1), g.copy()
        q, rr = r.copy(), float(g @ g)
        for _ in range(60):
            if rr < 1e-10:
                break
            hq = hessian(q)
            a = rr / float(q @ hq)
            x, r = x + a * q, r - a * hq
            rr, old = float(r @ r), rr
            q = r + rr / old * q
        w, b = w - x[:d], b - float(x[d])
        if np.abs(x).max() < 1e-4:
            break
    return Model(model.features, w, b)


def swapped(model: Model, row: np.ndarray, feature: np.ndarray, n: int):
    """Sparse rows of feature changes (row, feature, +1 or -1, rows) for swaps of the identity terms in the texts."""
    rng = np.random.default_rng(SEED)
    kinds = [np.searchsorted(model.features, np.array(kind, np.uint64)) for kind in identity_hashes()]
    # a term of two languages is swapped in the first
    of = {int(f): kind for kind in reversed(kinds) for f in kind}
    have = np.isin(feature, list(of))
    r, c, v, k = [], [], [], 0
    for at in np.flatnonzero(have).tolist():
        f = int(feature[at])
        others = [int(x) for x in of[f] if x != f]
        for other in rng.permutation(others)[:SWAPS].tolist():
            r += [k, k]
            c += [f, other]
            v += [-1.0, 1.0]
            k += 1
    return np.array(r, np.int64), np.array(c, np.int64), np.array(v), k


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the training rows of labels (doc_id, toxic) and their texts in docs."""
    labels = labels.where("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y")).distinct()
    labels = labels.where(F.crc32(F.col("__id").cast("string")) % 3 != 1)
    bound = cut(labels.orderBy(F.xxhash64("__id"), "__id", "y").limit(SAMPLE))  # SAMPLE rows at most, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(bound), F.col("doc_id") == F.col("__id"))
    rows = cut(texts.groupBy("__id", "y").agg(F.min("text").alias("text")))
    n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or toxic in (0, n):
        return fit(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, np.full(n, toxic or 0, float) / (n or 1))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for part in slices(batch):
                w, rows, t = class_counts(tokens, part.column("text"), part.column("y").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (w, rows, t)], ["w", "n", "t"])

    share = toxic / n
    z = F.abs(F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    split = rows.mapInArrow(counts, "w long, n long, t long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).withColumn("z", z)
    best = split.where(F.col("n") >= LEAST_ROWS).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "w").limit(FEATURES).collect()
    features = with_identity(np.array([r["w"] for r in best], np.int64).view(np.uint64))
    probe = Model(features, np.zeros(0), 0.0)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            for part in slices(batch):
                row, feature = probe.presence(*tokens.of(part.column("text")))
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("y"), lists], ["__id", "y", "f"])

    found = rows.mapInArrow(present, "__id long, y int, f array<int>").orderBy("__id", "y").collect()  # SAMPLE rows of feature numbers
    y = np.array([r["y"] for r in found], float)
    row = np.repeat(np.arange(len(found)), [len(r["f"]) for r in found])
    return fit(features, row, np.array([f for r in found for f in r["f"]], np.int64), y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES and the identity terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, model = Tokens(), sent.value
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(tokens, part.column("text")))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns."""
    model = train(docs, labels)
    sent, names, schema = docs.sparkSession.sparkContext.broadcast(model), docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, model = Tokens(), sent.value
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(model.scores(tokens, part.column("text")) < THRESHOLD))

    return docs.mapInArrow(run, schema).select(*names)
