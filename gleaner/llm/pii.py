"""Personal data: base patterns and boosted candidates.

The base kinds are found by their patterns and checks and always stay.  Loose
generators propose further, overlapping spans (spelled-out addresses, numbers in every
grouping, IPv6, secrets such as tokens and passwords); boosted regression trees score
each by its format and its context, scores are calibrated on held-out examples, and spans
above the threshold of their kind are added where they overlap nothing already chosen,
best first.  A kind's threshold is the least calibrated score from which on held-out
examples are right with PRECISION, but not under FLOOR.

The trees are trained on examples made by rule with a fixed seed, not on the corpus, so
they are the same for every input.  Patterns are run so that no text makes them
backtrack more than a few times over.

Defined results: null and empty texts hold nothing; counts are of base spans, and
``spans`` lists base and added ones; a row is returned for each row; other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow_text import slices

KINDS = ("email", "ip", "card", "phone")
#: Kinds of candidates; secrets have no base pattern.
ADDED = (*KINDS, "secret")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is taken whole, so a match starts at its first digit.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

NUMBER = re.compile(r"(?<![0-9])[+(]?[0-9](?:[0-9 ()\[\]./_-]*[0-9])?")
AT = re.compile(r"\(at\)|\[at\]|\bat\b", re.I)
#: A domain after AT: two labels, all that are not parted by a full stop and a space, or all.
SPELLED = tuple(re.compile(rf" ?[\w-]++(?:(?:{dot}) ?[\w-]++){many}", re.I) for dot, many in ((r" ?(?:\.|\(dot\)|\[dot\]|\bdot\b)", ""), (r"\.(?! )| ?(?:\(dot\)|\[dot\]|\bdot\b)", "++"), (r" ?(?:\.|\(dot\)|\[dot\]|\bdot\b)", "++")))
GROUP = re.compile(r"[0-9]+")
IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
#: A named value, and a run without spaces that mixes digits and letters.
NAMED = re.compile(r"\b(?:token|secret|passwords?|passwd|passwort|pwd|contraseña|mot de passe|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer|auth)\b[\"']?(?:\s?[:=]\s?|\s(?=[\"'])|\s(?=\S*[0-9]))[\"']?([^\s\"']++)", re.I)
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*?[0-9])[A-Za-z0-9+/_=-]{16,}+")
OCTET = re.compile(r"[0-9]{1,3}")
#: Characters of context to either side, and the most digits of a number that is a candidate.
CONTEXT, MOST = 32, 19
#: Context words by what they speak for.
WORDS = {
    "email": ("mail", "email", "write", "contact", "reach", "schreiben", "kontakt", "courriel", "écrire", "correo", "escribir"),
    "ip": ("ip", "host", "server", "node", "ping", "adresse", "serveur", "servidor", "rechner"),
    "card": ("card", "visa", "credit", "pay", "debit", "karte", "kreditkarte", "carte", "tarjeta", "mastercard"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "dial", "telefon", "anruf", "handy", "tél", "téléphone", "appel", "teléfono", "llame", "móvil", "telephone"),
    "secret": ("token", "secret", "password", "passwd", "passwort", "pwd", "contraseña", "passe", "key", "bearer", "auth", "api"),
    "other": ("order", "invoice", "version", "isbn", "page", "total", "serial", "chapter", "section", "commit", "checksum", "sha", "file"),
}
ROUNDS, DEPTH, RATE, BINS = 50, 4, 0.3, 16
EXAMPLES, SEED = 6000, 17
#: Candidates scored at once.
SCORED = 20_000
#: Precision that a kind's threshold reaches on held-out examples.
PRECISION = 0.995
#: Calibrated score under which no span is added.
FLOOR = 0.9
DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: before each @ the longest run of local characters not yet used, after it a dotted domain."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            last = found.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(last, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in DIGITS for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def windows(text: str, a: int, b: int) -> list[tuple[str, int, int]]:
    """Every window of whole digit groups in a run whose count of digits fits a kind, with a + or ( that stands before it.

    A window has at most MOST digits, so at most MOST groups: a run costs its length.
    """
    groups, out = [g.span() for g in GROUP.finditer(text, a, b)], []
    for i, (x, _) in enumerate(groups):
        if x > a and text[x - 1] in "+(":
            x -= 1
        n = 0
        for p, q in groups[i:]:
            n += q - p
            if n > MOST:
                break
            if n < 4 or q - x < 7:
                continue
            if 7 <= n <= 15:
                out.append(("phone", x, q))
            if 13 <= n:
                out.append(("card", x, q))
            if n <= 12 and text.count(".", x, q) >= 3:
                out.append(("ip", x, q))
    return out


def spelled(text: str) -> list[tuple[str, int, int]]:
    """Spelled-out addresses: before each AT the run of local characters not yet used, after it domains of several lengths."""
    out, last = [], 0
    for m in AT.finditer(text):
        end = m.start() - (m.start() > last and text[m.start() - 1] == " ")
        start = end
        while start > last and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        if start < end:
            ends = {d.end() for p in SPELLED if (d := p.match(text, m.end()))}
            out += [("email", start, e) for e in sorted(ends)]
            last = max([m.end(), *ends])
        else:
            last = max(last, m.end())
    return out


def short_ipv6(s: str) -> bool:
    try:
        return ipaddress.ip_address(s).version == 6
    except ValueError:
        return False


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals; a number is proposed as each kind that its digits allow."""
    out = spelled(text)
    if ":" in text:
        out += [("ip", *m.span()) for m in IPV6.finditer(text) if short_ipv6(m.group())]
    out += [("secret", *m.span(1)) for m in NAMED.finditer(text)]
    out += [("secret", *m.span()) for m in RUN.finditer(text)]
    for m in NUMBER.finditer(text):
        if m.end() - m.start() >= 7:
            out += windows(text, *m.span())
    return list(dict.fromkeys(out))


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    low = s.lower()
    digits = [c for c in s if c in DIGITS]
    letters = sum(c.isalpha() for c in s)
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g] or [0]
    before, after = text[max(0, a - CONTEXT) : a].lower(), text[b : b + CONTEXT].lower()
    near = re.split(r"[\W_0-9]+", f"{before} {after}")
    marks = {c for c in s if not c.isalnum()}
    parts = re.split(r"[.\[\]]+", s)
    return [
        len(s), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1], len(marks), float("+" in s), float("(" in s and ")" in s),
        float(len(digits) >= 13 and luhn("".join(digits))), float(len(parts) == 4 and all(OCTET.fullmatch(p) and int(p) <= 255 for p in parts)),
        float(bool(re.fullmatch(r"(?:19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}|[0-9]{1,2}[-/. ][0-9]{1,2}[-/. ](?:19|20)?[0-9]{2}", s))), float(s.count(":")),
        float(bool(re.search(r"\b(?:com|org|net|edu|info|io|de|fr|es|vn)$", low))), float("at" in low and "dot" in low), float("(at)" in low or "[at]" in low),
        float(bool(before) and (before[-1].isalnum() or before[-1] in "-_#=/")), float(bool(after) and (after[0].isalnum() or after[0] in "-_%=/")),
        float(bool(re.search(r"\.\s", s))), float(bool(re.search(r"[0-9] [0-9]", s))), letters, float(0 < letters and bool(digits)), float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s))),
        float(any(c.isupper() for c in s) and any(c.islower() for c in s)), float(bool(re.search(r"[:=]\s?[\"']?$", before))), float("." in s), float("/" in s),
        float(s[0] == "("), float(digits[:1] == ["0"]), float(digits[:2] == ["0", "0"]), groups[1] if len(groups) > 1 else 0,
        len(re.match(r"[ (]?([0-9]*)", after).group(1)), len(re.search(r"([0-9]*)[ )]?$", before).group(1)),
        *(float(kind == k) for k in ADDED), *(float(sum(w in near for w in words)) for words in WORDS.values()),
    ]


class Trees:
    """Gradient-boosted regression trees for a 0/1 target, on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
        bins = self.binned(x)
        self.base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
        f, self.trees = np.full(len(y), self.base), []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(bins, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            f += self._apply(tree, bins)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(self.cuts)], 1)

    def _grow(self, bins, g, h, rows, depth):
        leaf = RATE * g[rows].sum() / (h[rows].sum() + 1.0)
        if not depth or len(rows) < 20:
            return leaf
        best = (1e-6, 0, 0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for i in range(bins.shape[1]):
            gs, hs = (np.cumsum(np.bincount(bins[rows, i], v[rows], BINS)) for v in (g, h))
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            k = int(gain[:-1].argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), i, k)
        if best[0] <= 1e-6:
            return leaf
        _, i, k = best
        left = bins[rows, i] <= k
        if left.all() or not left.any():
            return leaf
        return i, k, self._grow(bins, g, h, rows[left], depth - 1), self._grow(bins, g, h, rows[~left], depth - 1)

    def _apply(self, tree, bins) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(bins), tree)
        i, k, a, b = tree
        return np.where(bins[:, i] <= k, self._apply(a, bins), self._apply(b, bins))

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return self.base + sum(self._apply(t, bins) for t in self.trees)


class Model:
    """Trees with a logistic calibration, and the calibrated threshold of each kind."""

    def __init__(self):
        rows = examples(np.random.default_rng(SEED))
        x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows])
        y, kind = np.array([r[4] for r in rows], float), np.array([ADDED.index(r[1]) for r in rows])
        half = np.arange(len(rows)) % 2 == 0
        self.trees = Trees(x[half], y[half])
        raw, target = self.trees.raw(x[~half]), y[~half]
        self.slope, self.shift = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(self.slope * raw + self.shift)))
            w = p * (1 - p) + 1e-6
            design = np.stack([raw, np.ones_like(raw)], 1)
            step = np.linalg.solve((design * w[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (target - p) - 1e-3 * np.array([self.slope - 1, self.shift]))
            self.slope, self.shift = self.slope + step[0], self.shift + step[1]
        p = 1 / (1 + np.exp(-(self.slope * raw + self.shift)))
        self.least = []
        for k in range(len(ADDED)):
            own, good = p[kind[~half] == k], target[kind[~half] == k]
            order = np.argsort(-own, kind="stable")
            right = np.cumsum(good[order]) / np.arange(1, len(order) + 1)
            ok = np.flatnonzero(right >= PRECISION)
            self.least.append(max(FLOOR, float(own[order][ok[-1]])) if len(ok) else 2.0)

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.raw(np.array(rows)) + self.shift)))


@functools.cache
def trained() -> Model:
    """The model, fitted once a process: its examples are the same for every input."""
    return Model()


def examples(rng) -> list[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): personal data in formats beyond the base, and look-alikes."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abdeghilmnorstu"), int(rng.integers(2, 9))))
    pick = lambda seq: seq[int(rng.integers(len(seq)))]

    def card() -> str:
        d = digits(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def grouped(d: str, by: str) -> str:
        return by.join(d[i : i + 4] for i in range(0, len(d), 4))

    def bad_card() -> str:
        return next(d for d in iter(lambda: digits(16), None) if not luhn(d))

    def octets() -> tuple:
        return tuple(int(rng.integers(0, pick([2, 10, 256]))) for _ in range(4))

    def short_v6() -> str:
        return ":".join([*(f"{v:x}" for v in rng.integers(1, 65535, int(rng.integers(1, 5)))), "", *(f"{v:x}" for v in rng.integers(1, 65535, int(rng.integers(1, 3))))])

    def run(n: int, of: str) -> str:
        return "".join(rng.choice(list(of), n))

    def mixed(n: int) -> str:
        return run(n - 2, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") + "a7"

    small, tops = "abcdefghijkmnpqrstuvwxyz", ["com", "org", "net", "de", "fr", "es", "io", "info"]
    named = ["token = \"{}\"", "token: {}", "password = {}", "password: \"{}\"", "secret={}", "api_key = '{}'", "API key: {}", "pwd={}", "Passwort: {}", "contraseña: {}", "Bearer {}", "auth={}"]
    make = {
        ("email", 1): lambda: pick(["{} (at) {} dot {}", "{}(at){}.{}", "{}[at]{}[dot]{}", "{} at {} dot {}", "{} [at] {} [dot] {}", "{} (AT) {} DOT {}", "{} AT {} DOT {}", "{}(at){}(dot){}", "{} at {} [dot] {}", "{} (at) {}.{}", "{} at {}.{}"]).format(word(), word(), pick(tops)),
        ("email", 0): lambda: pick(["{} at {} dot {}", "{} at {}. {}", "{} at {}. {}com", "{} at {}. {}es", "{} at {}. {}de", "{} AT {}. {}IO", "{} at {}.{}"]).format(word(), word(), word()),
        ("ip", 1): lambda: pick([lambda: "{}[.]{}[.]{}[.]{}".format(*octets()), lambda: "{}[.]{}.{}.{}".format(*octets()), lambda: ":".join(f"{v:x}" for v in rng.integers(1, 65535, 8)), short_v6])(),
        ("ip", 0): lambda: pick([".".join(map(str, rng.integers(300, 999, 4))), ".".join(map(str, rng.integers(0, 20, 5))), f"{digits(2)}.{digits(2)}.{digits(4)}.{digits(3)}"]),
        ("card", 1): lambda: grouped(card(), pick([".", "_", "/", " - "])),
        ("card", 0): lambda: pick([bad_card, lambda: grouped(bad_card(), pick([" ", "-", ".", "/"])), lambda: digits(int(rng.integers(13, 20)))])(),
        ("phone", 1): lambda: pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"00{digits(2)} {digits(3)} {digits(7)}", f"(0{digits(2)}) {digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(3)}/{digits(6)}", f"(0{digits(3)}) {digits(6)}"]),
        ("phone", 0): lambda: pick([f"20{digits(2)}-{pick(['01', '11', '07'])}-{digits(2)}", digits(int(rng.integers(7, 16))), f"{digits(3)}.{digits(5)}", f"{digits(1)}.{digits(2)}.{digits(4)}", f"{digits(4)} {digits(4)}"]),
        ("secret", 1): lambda: pick(named).format(pick([lambda: run(40, "0123456789abcdef"), lambda: run(32, "0123456789abcdef"), lambda: mixed(int(rng.integers(20, 48))), lambda: mixed(int(rng.integers(8, 20))), lambda: "ghp_" + mixed(36), lambda: "sk-" + mixed(40), lambda: "AKIA" + run(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")])()),
        ("secret", 0): lambda: pick([lambda: f"token {word()}", lambda: f"password: {word()}", lambda: f"a secret = {word()}", lambda: f"commit {run(40, '0123456789abcdef')}", lambda: f"sha {run(64, '0123456789abcdef')}", lambda: f"{run(12, small)}-{digits(4)}-{run(6, small)}", lambda: f"{run(8, small)}/{run(6, small)}/{digits(4)}/{run(8, small)}", lambda: f"{run(18, small)}{digits(1)}", lambda: "=" * 20 + digits(1), lambda: digits(int(rng.integers(16, 24)))])(),
    }
    out = []
    for _ in range(EXAMPLES):
        kind, label = pick(list(make))
        s = make[kind, label]()
        # a number in an unmarked format is personal only where the context says so
        context = pick(WORDS[kind]) if label and (kind == "phone" or rng.random() < 0.5) else pick([word(), word(), pick(WORDS["other"]), pick(WORDS[kind]) if kind not in ("phone", "secret") else word()])
        left = f"{word()} {context} {word() + ' ' if rng.random() < 0.3 else ''}"
        if rng.random() < 0.3 and kind in ("phone", "card"):
            left += pick([f"20{digits(2)}-0{1 + int(rng.integers(9))}-1{digits(1)} ", f"{digits(3)} ", f"{digits(3)}-{digits(3)}-{digits(4)} "])
        after = pick(["", "", f"0{1 + int(rng.integers(9))}/{digits(2)} {digits(3)} ", f"{digits(1)} ", f"{digits(2)} ", f"({digits(3)}) {digits(3)}-{digits(4)} ", f"{digits(3)}-{digits(3)}-{digits(4)} "]) if kind in ("phone", "card") else ""
        text = f"{left}{s} {after}{word()} {word()}"
        start, end = len(left), len(left) + len(s)
        for k, a, b in candidates(text):
            if k == "phone" and re.fullmatch(r"\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}", text[a:b]) and not start <= a < end:
                continue  # a neighbour in a list, personal as well or not as the context says
            whole = start <= a and end - 1 <= b <= end and s[-1] in "\"'" + text[b - 1] if kind == "secret" else start - 1 <= a <= start and end <= b <= end + 1
            out.append((text, k, a, b, int(bool(label) and whole and k == kind)))
    return out


def all_spans(texts: list[str | None], model: Model) -> list[tuple[list, list]]:
    """For each text its base spans and its added spans (kind, start, end), each by kind and start."""
    out, rows, where, good = [], [], [], []

    def score() -> None:
        p = model.scores(rows) if rows else []
        good.extend((-p[j], w) for j, w in enumerate(where) if p[j] >= model.least[ADDED.index(w[1])])
        rows.clear()
        where.clear()

    for i, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        out.append((sorted(base, key=lambda s: (KINDS.index(s[0]), s[1])), []))
        used = bytearray(len(text))
        for _, a, b in base:
            used[a:b] = b"\x01" * (b - a)
        for kind, a, b in candidates(text):
            if used.find(1, a, b) < 0:
                rows.append(features(text, kind, a, b))
                where.append((i, kind, a, b))
                if len(rows) >= SCORED:
                    score()
    score()
    taken: dict[int, bytearray] = {}
    for _, (i, kind, a, b) in sorted(good):
        used = taken.setdefault(i, bytearray(len(texts[i])))
        if used.find(1, a, b) < 0:
            out[i][1].append((kind, a, b))
            used[a:b] = b"\x01" * (b - a)
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ADDED.index(s[0]), s[1], s[2])))


def find(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans), one for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for part in slices(batch):
                found = all_spans(part.column("text").to_pylist(), model)
                counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
                digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found])
                spans = pa.array([listed(base + more) for base, more in found])
                n = pa.array([len(base) + len(more) for base, more in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, digest, spans, n], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(text: str | None, model: Model) -> str | None:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first, then the longest, is replaced."""
    if text is None:
        return None
    base, more = all_spans([text], model)[0]
    out, last = [], 0
    for kind, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join(out) + text[last:]
