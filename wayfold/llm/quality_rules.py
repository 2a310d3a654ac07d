"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on a bounded labelled sample (binned statistics, logistic loss) and flattened
into numpy node arrays, which score all rows of a slice at once, level by level. MONOTONE names
statistics whose growth may only lower (-1) or raise (+1) the score; a split that would break
this is not taken, and the leaves below a split stay on their side of its middle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayfold.llm.common import annotated, labelled_sample, per_row, string_bytes, word_codes

#: Labelled texts of each class that trees are grown on (documented bound).
SAMPLE_PER_CLASS = 3000
TREES, DEPTH, BINS, RATE, LEAST_ROWS = 40, 3, 32, 0.3, 20
#: Kept if the score is at least this.
THRESHOLD = 0.3
MIN_WORDS, REPEAT_PERCENT = 50, 50

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "word_chars_mean", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punctuation_share", "same_as_previous_share", "distinct_share", "line_words"]
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "same_as_previous_share": -1}

FIELDS = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())]

_SPACE = " \t\n\x0b\x0c\r"


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(characters.encode())] = 1
    return out


_SYMBOLS = _class("#*$%&|<>")
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _class("0123456789")
_PUNCTUATION = _class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _repeated(codes: np.ndarray, row: np.ndarray, distinct: int, rows: int) -> np.ndarray:
    """Whether each word lies in a window of three words that its text has twice or more."""
    inside = np.zeros(len(codes), bool)
    if len(codes) < 3:
        return inside
    whole = row[2:] == row[:-2]
    at = np.flatnonzero(whole)
    first, last = codes[:-2][at], codes[2:][at]
    if rows * distinct**3 < 1 << 62:
        key = ((row[at] * distinct + first) * distinct + codes[1:-1][at]) * distinct + last
    else:  # number pairs first, so that keys can't overflow
        _, head = np.unique(row[at] * distinct + first, return_inverse=True)
        _, tail = np.unique(codes[1:-1][at] * distinct + last, return_inverse=True)
        key = head * (int(tail.max(initial=0)) + 1) + tail
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[counts[inverse] > 1]
    for k in range(3):
        inside[twice + k] = True
    return inside


def _duplicate_lines(text: str | None) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in (text or "").split("\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines)), len(lines)


def statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (long) and FEATURES (double), a row for each text; null is as empty, whose row is all zero."""
    texts = pc.fill_null(texts, "")
    vocabulary, codes, bounds = word_codes(texts)
    rows = len(texts)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    n_words = np.diff(bounds)
    lengths = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = per_row(lengths[codes], bounds)
    raw, at = string_bytes(texts)
    symbols, upper, lower, digit, punctuation = (per_row(x[raw], at) for x in (_SYMBOLS, _UPPER, _LOWER, _DIGIT, _PUNCTUATION))
    lines = np.array([_duplicate_lines(t) for t in texts.to_pylist()], np.int64).reshape(rows, 2)
    distinct = max(1, len(vocabulary))
    repeated = per_row(_repeated(codes, row, distinct, rows).astype(np.int64), bounds)
    same = np.zeros(len(codes), np.int64)
    same[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    kinds = np.bincount(np.unique(row * distinct + codes) // distinct, minlength=rows)
    size, words = np.maximum(1, np.diff(at)), np.maximum(1, n_words)
    features = [n_words, chars / words, symbols / size, lines[:, 0] / np.maximum(1, lines[:, 1]), repeated / words, upper / np.maximum(1, upper + lower), digit / size, punctuation / size, per_row(same, bounds) / words, kinds / words, n_words / np.maximum(1, lines[:, 1])]
    return np.stack([n_words, chars, symbols, lines[:, 0], repeated], axis=1), np.stack(features, axis=1).astype(np.float64)


@dataclass
class FlatTrees:
    """All trees' nodes in one set of arrays; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int = DEPTH

    def score(self, features: np.ndarray) -> np.ndarray:
        if not len(features):
            return np.zeros(0)
        row = np.arange(len(features))[:, None]
        node = np.repeat(self.roots[None, :], len(features), axis=0)
        for _ in range(self.depth):
            node = np.where(features[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


class _Grower:
    """Adds one regression tree of gradients at a time to the node lists."""

    def __init__(self, binned: np.ndarray, edges: list[np.ndarray], signs: np.ndarray):
        self.binned, self.edges, self.signs = binned, edges, signs
        self.nodes: list[list[float]] = []
        self.roots: list[int] = []

    def grow(self, gradient: np.ndarray, hessian: np.ndarray, at: np.ndarray, depth: int, low: float = -np.inf, high: float = np.inf) -> int:
        me = len(self.nodes)
        g, h = gradient[at].sum(), hessian[at].sum()
        self.nodes.append([0, np.inf, me, me, RATE * float(np.clip(-g / (h + 1), low, high))])
        split = self._best(gradient, hessian, at, g, h, low, high) if depth and len(at) >= 2 * LEAST_ROWS else None
        if split:
            feature, border, middle = split
            goes = self.binned[at, feature] <= border
            sign = self.signs[feature]
            lows, highs = [low, low], [high, high]
            if sign:  # the side with larger values lies beyond the middle
                (highs if sign > 0 else lows)[0] = middle
                (lows if sign > 0 else highs)[1] = middle
            left = self.grow(gradient, hessian, at[goes], depth - 1, lows[0], highs[0])
            right = self.grow(gradient, hessian, at[~goes], depth - 1, lows[1], highs[1])
            self.nodes[me][:4] = [feature, float(self.edges[feature][border]), left, right]
        return me

    def _best(self, gradient, hessian, at, g, h, low, high):
        best, least_gain = None, 1e-3
        for feature in range(self.binned.shape[1]):
            bins = len(self.edges[feature]) + 1
            own = self.binned[at, feature]
            gl, hl, nl = (np.cumsum(np.bincount(own, w, bins))[:-1] for w in (gradient[at], hessian[at], None))
            if not len(gl):
                continue
            a, b = np.clip(-gl / (hl + 1), low, high), np.clip(-(g - gl) / (h - hl + 1), low, high)
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(nl < LEAST_ROWS) | (len(at) - nl < LEAST_ROWS) | (self.signs[feature] * (b - a) < 0)] = -np.inf
            k = int(gain.argmax())
            if gain[k] > least_gain:
                best, least_gain = (feature, k, (a[k] + b[k]) / 2), gain[k]
        return best


def grow(features: np.ndarray, labels: np.ndarray, monotone: dict[int, int], trees: int = TREES, depth: int = DEPTH) -> FlatTrees:
    """Boosted trees for labels 0/1; without both classes, the only class's score."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    base = float(np.log(share / (1 - share)))
    signs = np.array([monotone.get(i, 0) for i in range(features.shape[1])])
    edges = [np.unique(np.quantile(x, np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for x in features.T]
    binned = np.stack([np.searchsorted(e, x, side="left") for e, x in zip(edges, features.T, strict=True)], axis=1)
    grower, margin = _Grower(binned, edges, signs), np.full(len(labels), base)
    for _ in range(trees if 0 < labels.sum() < len(labels) else 0):
        p = 1 / (1 + np.exp(-margin))
        grower.roots.append(grower.grow(p - labels, p * (1 - p), np.arange(len(labels)), depth))
        one = _flat(grower.nodes, grower.roots[-1:], 0.0, depth)
        made = one.score(features)
        margin += np.log(made / (1 - made))
    return _flat(grower.nodes, grower.roots, base, depth)


def _flat(nodes: list[list[float]], roots: list[int], base: float, depth: int) -> FlatTrees:
    columns = np.array(nodes, np.float64).reshape(-1, 5).T
    return FlatTrees(columns[0].astype(np.int64), columns[1], columns[2].astype(np.int64), columns[3].astype(np.int64), columns[4], np.array(roots, np.int64), base, depth)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> FlatTrees:
    """Grow trees on at most per_class labelled texts of each class (see labelled_sample); the driver gets their statistics only."""
    sample = labelled_sample(docs, labels, label, per_class)

    def run(batches):
        for batch in batches:
            made = statistics(batch.column("text"))[1]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(x) for x in made.T)], names=["label", *FEATURES])

    table = sample.select("text", "label").mapInArrow(run, ", ".join(["label int", *(f"{c} double" for c in FEATURES)])).toArrow()
    values = np.stack([table[c].to_numpy() for c in ["label", *FEATURES]], axis=1).astype(np.float64)
    values = values[np.lexsort(values.T)]  # the same trees however rows arrive
    return grow(values[:, 1:], values[:, 0], {FEATURES.index(c): s for c, s in MONOTONE.items()})


def judge(docs: DataFrame, trees: FlatTrees, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with COUNTS, base_failed, quality_score and kept, for every row and its whole text.

    base_failed: fewer than MIN_WORDS words, or over REPEAT_PERCENT percent of them in repeated
    three-word windows. kept is false if base_failed, else whether quality_score >= threshold.
    Null texts count as empty, so they fail. No shuffle; clashing columns of docs are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(texts: pa.Array) -> list:
        counts, features = statistics(texts)
        failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])
        score = shared.value.score(features)
        return [*counts.T, failed, score, ~failed & (score >= threshold)]

    return annotated(docs, text, FIELDS, run)
