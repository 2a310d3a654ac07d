"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's terms are hashed words, hashed word shapes (runs of upper case, lower case, digits
and each punctuation mark, collapsed) and two repetition terms. Square roots of term shares,
weighted by inverse document frequency, are projected on the leading singular directions of
a bounded labelled sample. Unit vectors are rounded to multiples of 1 / GRID, so that products
are whole numbers below 2^24, which float32 holds exactly however a block is cut. The sample's
vectors are broadcast; every document's exact cosine with all of them is computed in blocks, and
its NEIGHBOURS nearest (equal cosines: the smaller doc_id) vote by similarity, each class
weighted so that both would count the same over the whole sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import annotated, labelled_sample, per_row, string_bytes, word_codes

#: Labelled texts of each class that are learned from; also bounds what is broadcast.
SAMPLE_PER_CLASS = 3000
DIMENSIONS = 48
#: Steps of a unit vector's components.
GRID = 4000
NEIGHBOURS = 9
WORD_BUCKETS, SHAPE_BUCKETS, EXTRA = 768, 384, 2
TERMS = WORD_BUCKETS + SHAPE_BUCKETS + EXTRA
#: Shapes tell more about a text's form than words do.
SHAPE_WEIGHT = 3.0
#: Documents in one block of cosines.
BLOCK = 512
THRESHOLD = 0.3

FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """An order-sensitive 64-bit hash of each segment."""
    place = (np.arange(len(values)) - np.repeat(bounds[:-1], np.diff(bounds))).astype(np.uint64)
    return _mix(per_row(_mix((values + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + place * np.uint64(0xA5A3564E27F8862B)), bounds))


def _terms(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word bucket and shape bucket of each word."""
    lowered, bounds = string_bytes(pc.ascii_lower(words))
    word = _hashes(lowered.astype(np.uint64), bounds) % np.uint64(WORD_BUCKETS)
    raw, bounds = string_bytes(words)
    shape = _CLASS[raw]
    first = np.zeros(len(raw), bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    kept = first | (np.concatenate((np.zeros(1, np.uint64), shape[:-1])) != shape)
    kept_bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
    return word.astype(np.int64), (_hashes(shape[kept], kept_bounds) % np.uint64(SHAPE_BUCKETS)).astype(np.int64)


def term_shares(texts: pa.Array) -> np.ndarray:
    """A row of square roots of term shares for each text; all zero for a text without words."""
    vocabulary, codes, bounds = word_codes(texts)
    n = len(texts)
    out = np.zeros((n, TERMS), np.float32)
    if not len(codes):
        return out
    word, shape = _terms(vocabulary)
    row = np.repeat(np.arange(n), np.diff(bounds))
    flat = np.bincount(row * TERMS + word[codes], minlength=n * TERMS) + np.bincount(row * TERMS + WORD_BUCKETS + shape[codes], minlength=n * TERMS)
    out[:] = flat.reshape(n, TERMS)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    out[:, -2] = per_row(same.astype(np.int64), bounds)
    distinct = np.bincount(np.unique(row * len(vocabulary) + codes) // len(vocabulary), minlength=n)
    out[:, -1] = np.diff(bounds) - distinct
    return np.sqrt(out / np.maximum(1, np.diff(bounds))[:, None])


@dataclass
class Voters:
    """The projection and the labelled vectors; all bounded by the sample's parameters."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    @property
    def weights(self) -> np.ndarray:
        """Of each labelled vector: what makes its class count as much as the other."""
        share = np.clip(self.labels.mean(), 1e-9, 1 - 1e-9) if len(self.labels) else 0.5
        return np.where(self.labels == 1, 0.5 / share, 0.5 / (1 - share))

    @classmethod
    def learn(cls, shares: np.ndarray, labels: np.ndarray, prior: float, dimensions: int = DIMENSIONS) -> Voters:
        n = len(shares)
        if not n:
            return cls(np.zeros((TERMS, 1)), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), prior)
        weight = np.log((1 + n) / (1 + (shares > 0).sum(axis=0))) + 1
        weight[WORD_BUCKETS:] *= SHAPE_WEIGHT
        weighted = shares * weight.astype(np.float32)
        _, directions = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
        projection = weight[:, None] * directions[:, ::-1][:, : min(dimensions, n)]
        return cls(projection, _unit(shares @ projection), labels.astype(np.float32), prior)

    def score(self, texts: pa.Array, neighbours: int = NEIGHBOURS) -> np.ndarray:
        out, weights = np.full(len(texts), self.prior), self.weights
        for start in range(0, len(texts), BLOCK):
            own = _unit(term_shares(texts.slice(start, BLOCK)) @ self.projection)
            if not len(self.labels):
                continue
            cosines = own @ self.vectors.T
            k = min(neighbours, cosines.shape[1])
            near = nearest(cosines, k)
            votes = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) * weights[near]
            total = votes.sum(axis=1)
            some = total > 0
            out[start : start + len(own)][some] = np.clip((votes * self.labels[near]).sum(axis=1)[some] / total[some], 0, 1)
        return out


def nearest(products: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest products, equal ones from the left."""
    near = np.argpartition(-products, k - 1, axis=1)[:, :k]
    own = np.take_along_axis(products, near, axis=1)
    last = own.min(axis=1, keepdims=True)
    tied = np.flatnonzero((products == last).sum(axis=1) > (own == last).sum(axis=1))
    if len(tied):
        near[tied] = np.argsort(-products[tied], axis=1, kind="stable")[:, :k]
    return np.sort(near, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Whole-numbered rows of length GRID, nearly; zero rows stay zero."""
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.rint(GRID * x / np.where(length > 0, length, 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS, dimensions: int = DIMENSIONS) -> Voters:
    """Learn from at most per_class labelled texts of each class (see labelled_sample); whole texts, null ones as empty.

    The driver gets the sample's term shares (2 * per_class rows of TERMS floats).
    """

    def shares(batches):
        for batch in batches:
            made = term_shares(batch.column("text"))
            rows, cols = np.nonzero(made)
            bounds = np.searchsorted(rows, np.arange(len(made) + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(cols, pa.int32()))
            values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(made[rows, cols], pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), lists, values], names=["doc_id", "label", "terms", "shares"])

    sample = labelled_sample(docs, labels, label, per_class)
    kind = dict(sample.dtypes)["doc_id"]
    table = sample.mapInArrow(shares, f"doc_id {kind}, label int, terms array<int>, shares array<float>").toArrow().sort_by("doc_id").combine_chunks()
    dense = np.zeros((len(table), TERMS), np.float32)
    if len(table):
        lists, values = table["terms"].combine_chunks(), table["shares"].combine_chunks()
        dense[np.repeat(np.arange(len(table)), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()] = values.flatten().to_numpy()
    y = table["label"].to_numpy() if len(table) else np.zeros(0)
    usual = labels.filter(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return Voters.learn(dense, y, 0.5 if usual is None else float(usual), dimensions)


def classify(docs: DataFrame, voters: Voters, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold), for every row and its whole text.

    Null and empty texts get the share of label 1 among all labels (0.5 without labels). Of equal
    cosines the voter with the smaller doc_id counts; repeated rows get the same score, whatever
    block they fall in. A long text is one row of term shares, whatever its length. No shuffle;
    columns of docs named score or predicted are replaced, all others stay. No rows in: no rows out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(texts: pa.Array) -> list:
        score = shared.value.score(texts)
        return [score, (score >= threshold).astype(np.int32)]

    return annotated(docs, text, FIELDS, run)


def held_out(column: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether crc32 of the id as text falls in the fold that learning never sees; null ids do not."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == fold, F.lit(False))
