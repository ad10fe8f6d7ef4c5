"""Personal data in texts: strict rules, loose candidates, and boosted trees that choose among the candidates.

Spans that a rule accepts are always found. Beside them, generators propose overlapping spans that look at all like
an address or a number; gradient-boosted trees judge them by their form and by the words around them, and those above
a threshold that was calibrated on held-out candidates are added. The trees are trained on a bounded sample, with
what the rules accept as examples.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeskein.llm._words import column, pieces

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000
SAMPLE_CANDIDATES = 30_000
PRECISION = 0.98
LEAST_POSITIVE = 20
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 32
SPAN = "array<struct<kind: string, start: int, end: int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, each found from its `@`: the run before it, the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Dotted digit groups, four at a time."""
    for run in _DOTTED.finditer(text):
        groups = [m.span() for m in re.finditer("[0-9]+", run.group())]
        for i in range(0, len(groups) - 3, 4):
            yield run.start() + groups[i][0], run.start() + groups[i + 3][1]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the rules accept, by start, then kind in the order of KINDS."""
    out = [("email", a, b) for a, b in emails(text)]
    for a, b in addresses(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text[a:b].split(".")):
            out.append(("ip", a, b))
    for m in _DIGITS.finditer(text):
        if len(m.group()) >= 14 and 14 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PLUS.finditer(text):
        if 10 <= len(only_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


#: High-recall generators; what they propose may overlap.
_GENERATORS = (
    ("email", re.compile(r"[\w.%+-]{1,64}(?: ?@ ?| ?[\[(]at[\])] ?| at )[\w-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?| dot )[\w-]{1,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9.:])[0-9]{1,5}(?:[.:][0-9]{1,5}){3,7}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{2,6}(?:[ ./-]?[0-9]{2,6}){2,8}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+(])(?:\+|00|\()?[0-9]{1,4}(?:[ ().\/-]{0,2}[0-9]{2,5}){2,5}(?![0-9])")),
)
_ANY = r"[0-9@]|[\[( ](?:at|dot)[\]) ]"
_CUES = {
    "email": ("mail", "email", "e-mail", "write", "contact", "address"),
    "ip": ("ip", "host", "server", "address", "from", "client"),
    "card": ("card", "visa", "credit", "payment", "account", "number"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact", "number"),
}


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, finder in _GENERATORS for m in finder.finditer(text)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Form and surroundings of a candidate."""
    span = text[start:end]
    digits = only_digits(span)
    groups = re.findall("[0-9]+", span)
    left, right = text[max(0, start - 40) : start], text[end : end + 20]
    words = left.lower().split()[-4:]
    cues = sum(w.strip(":;,.#()") in _CUES[kind] for w in words)
    letters = sum(c.isalpha() for c in span)
    return [
        float(KINDS.index(kind)),
        len(span),
        len(digits),
        letters,
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(groups[-1]) if groups else 0,
        max((int(g) for g in groups if len(g) < 6), default=99999) if groups else 0,
        span.count("."),
        span.count("-"),
        span.count(" "),
        span.count("(") + span.count(")"),
        float(span.startswith("+")),
        span.count("@"),
        span.count(":"),
        float(luhn(digits)) if digits else 0.0,
        float(left[-1:].isalnum()),
        float(right[:1].isalnum()),
        float(left[-1:] in "+@.-_/#%" and left != ""),
        float(right[:1] in "@-_/%" and right != ""),
        cues,
        len(words[-1]) if words else 0,
        float(left[-1:].isspace() or not left),
    ]


class Boosted:
    """Gradient-boosted regression trees on binned features, for log odds."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.n_trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(col, np.linspace(0, 1, self.bins + 1)[1:-1])) for col in x.T]
        binned = self._binned(x)
        self.base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        score = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._of(tree, binned)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, col, "right") for c, col in zip(self.cuts, x.T)])

    def _tree(self, binned, grad, hess):
        """Arrays in heap order: feature (-1: leaf), last bin that goes left, value."""
        size = 2 ** (self.depth + 1) - 1
        feature, bin_, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        rows = {0: np.arange(len(grad))}
        for node in range(size):
            own = rows.pop(node, None)
            if own is None:
                continue
            g, h = grad[own].sum(), hess[own].sum()
            value[node] = self.rate * g / (h + 1)
            if node >= size // 2 or len(own) < 10:
                continue
            best = (1e-6, -1, 0)
            for f in range(binned.shape[1]):
                gs = np.bincount(binned[own, f], grad[own], self.bins + 1).cumsum()[:-1]
                hs = np.bincount(binned[own, f], hess[own], self.bins + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
            if best[1] >= 0:
                feature[node], bin_[node] = best[1], best[2]
                left = binned[own, best[1]] <= best[2]
                rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return feature, bin_, value

    def _of(self, tree, binned) -> np.ndarray:
        feature, bin_, value = tree
        node = np.zeros(len(binned), int)
        for _ in range(self.depth):
            f = feature[node]
            go = 2 * node + 1 + (binned[np.arange(len(binned)), np.maximum(f, 0)] > bin_[node])
            node = np.where(f >= 0, go, node)
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return sum((self._of(t, binned) for t in self.trees), np.full(len(binned), self.base))


class CandidateModel:
    """Trees, the scale that turns margins into probabilities, and a threshold per kind (none: nothing is added)."""

    def __init__(self, trees: Boosted | None, scale: tuple[float, float] = (1.0, 0.0), thresholds: dict[str, float] | None = None):
        self.trees, self.scale, self.thresholds = trees, scale, thresholds or {}

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.trees.margin(x) + b, -500, 500)))


def calibrated(trees: Boosted, x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> CandidateModel:
    """Scale margins by logistic regression on held-out rows; then the least threshold of each kind with the wanted precision."""
    margin, a, b = trees.margin(x), 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, w = y - p, p * (1 - p) + 1e-9
        hess = np.array([[(w * margin**2).sum() + 1, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1]])
        step = np.linalg.solve(hess, [(r * margin).sum() - (a - 1), r.sum() - b])
        a, b = a + step[0], b + step[1]
    model = CandidateModel(trees, (a, b))
    p = model.probability(x)
    for k, kind in enumerate(KINDS):
        own = x[:, 0] == k
        order = np.argsort(-p[own])
        hit = np.cumsum(y[own][order])
        good = np.flatnonzero((hit / np.arange(1, len(hit) + 1) >= precision) & (hit >= LEAST_POSITIVE))
        if len(good):
            model.thresholds[kind] = max(0.5, float(p[own][order][good[-1]]))
    return model


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        xs, ys, hs = [], [], []
        draws = batch.column(batch.schema.get_field_index("draw")).to_pylist()
        for text, draw in zip(column(batch, "text").to_pylist(), draws):
            base = set(base_spans(text))
            for c in candidates(text):
                xs.append(features(text, *c))
                ys.append(c in base)
                hs.append(hash((draw, c[1], c[2], KINDS.index(c[0]))))  # numbers only: the same in every process
        arr = pa.array(xs, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([arr, pa.array(ys, pa.bool_()), pa.array(hs, pa.int64())], names=["x", "y", "h"])


def fit_candidates(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES) -> CandidateModel:
    """Train on the candidates of about `sample_docs` texts, at most `sample_candidates` of them, both taken by hash."""
    draw = F.xxhash64("doc_id", "text")
    n = docs.count()
    share = min(1.0, sample_docs / max(1, n))
    rows = docs.select("text", draw.alias("draw")).where((F.pmod(draw, F.lit(1 << 30)) < share * (1 << 30)) & F.col("text").rlike(_ANY))
    got = rows.mapInArrow(_sample_rows, "x array<double>, y boolean, h long").orderBy("h").limit(sample_candidates).toArrow()
    y = np.array(got.column(1).to_pylist(), float)
    if len(y) < 100 or not 0 < y.sum() < len(y):
        return CandidateModel(None)
    x = np.array(got.column(0).to_pylist())
    held = got.column(2).to_numpy() % 3 == 0
    if not 0 < y[~held].sum() < (~held).sum() or not held.any():
        return CandidateModel(None)
    return calibrated(Boosted().fit(x[~held], y[~held]), x[held], y[held])


def chosen(text: str, base: list[tuple[str, int, int]], model: CandidateModel) -> list[tuple[str, int, int]]:
    """Base spans and the likeliest candidates above their thresholds that overlap nothing kept before."""
    if model.trees is None or not model.thresholds:
        return base
    found = [c for c in candidates(text) if c[0] in model.thresholds]
    found = [c for c in found if not any(a < c[2] and c[1] < b for _, a, b in base)]
    if not found:
        return base
    p = model.probability(np.array([features(text, *c) for c in found]))
    kept = list(base)
    for i in np.argsort(-p, kind="stable"):
        c = found[i]
        if p[i] >= model.thresholds[c[0]] and not any(a < c[2] and c[1] < b for _, a, b in kept):
            kept.append(c)
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0])))


def personal_data(docs: DataFrame, model: CandidateModel | None = None) -> DataFrame:
    """`docs` with `base_spans` and `spans`: kind, start and end in code points, end exclusive, by start, then kind.

    Rules work on each kind alone, so spans of two kinds may overlap. A null or empty text has no spans. Columns of
    `docs` named base_spans or spans are replaced, others pass.
    """
    model = model or fit_candidates(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    passed = docs.select(*[c for c in docs.columns if c not in ("base_spans", "spans")])

    def spans(rows: list[list[tuple]]) -> pa.Array:
        flat = [s for row in rows for s in row]
        off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        kind, start, end = (list(c) for c in zip(*flat)) if flat else ([], [], [])
        items = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(off), items)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in pieces(batches):
            texts = column(batch, "text")
            some = np.flatnonzero(np.array(pc.match_substring_regex(texts, _ANY), bool))
            base, full = [[]] * len(texts), [[]] * len(texts)
            for i, text in zip(some.tolist(), texts.take(pa.array(some)).to_pylist()):
                base[i] = base_spans(text)
                full[i] = chosen(text, base[i], model)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans(base), spans(full)], names=[*batch.schema.names, "base_spans", "spans"])

    empty = F.from_json(F.lit("[]"), SPAN)
    return passed.mapInArrow(rows, passed.withColumns({"base_spans": empty, "spans": empty}).schema)


def span_text(spans: str) -> Column:
    """`kind:start:end` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redacted(found: DataFrame) -> DataFrame:
    """Rows of `personal_data` with each span, or run of overlapping spans, of `text` replaced by its kind in brackets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            k = batch.schema.get_field_index("text")
            spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
            texts = [t if t is None else _redact(t, [(s["kind"], s["start"], s["end"]) for s in own]) for t, own in zip(batch.column(k).to_pylist(), spans)]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return found.mapInArrow(rows, found.schema)
