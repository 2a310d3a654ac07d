"""Exact top-k inner products by pivot-table elimination.

Distances of every vector to PIVOTS pivots are computed once and stored with it. For a query q
and a candidate x, the largest |d(q,p) - d(x,p)| over the pivots bounds d(q,x) from below, and
with it the inner product (|q|^2 + |x|^2 - d^2) / 2 from above. A query's start threshold is
its k-th score among a bounded sample of real candidates; candidates are evaluated in the order
of their bounds until the next bound is below the k-th score so far, which is exact.

Candidates are packed in blocks by their nearest pivot, and blocks form cells of at most
MAX_CELLS, whose intervals of pivot distances are known to all tasks. A query is sent only to
cells that it can gain from; there it meets the blocks by an equi-join on the cell's number.
Rounding never decides: bounds leave room for it, and scores are whole numbers of any size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import small_batches, stored

SCALE, K, PIVOTS = 1024, 10, 32
#: Sampled vectors that pivots and start thresholds come from; vectors in a candidate and in a query block.
SAMPLE, BLOCK, QUERY_BLOCK = 2048, 2048, 512
#: Cells at most (their intervals are broadcast: 16 bytes for each pivot and cell), and blocks in one cell at least.
MAX_CELLS, CELL_BLOCKS = 2048, 2
#: Candidates evaluated between two looks at the threshold; cells that a query block is held against at once.
STEP, CELLS_AT_ONCE = 256, 64
#: Whole numbers up to here, and their sums, are exact in doubles.
EXACT = 2.0**53
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component x as double, as a whole-numbered double, for rows that take part.

    Null keys, null vectors and vectors with null, NaN or infinite components take no part; all
    others do, however large. (A double whose product with scale is beyond the doubles' range
    counts as the largest double; floats never are.)
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    infinite, largest = F.lit(float("inf")), F.lit(1.7976931348623157e308)
    finite = F.forall("x", lambda c: F.coalesce((F.abs(c) < infinite) & ~F.isnan(c), F.lit(False)))

    def floored(c):
        y = F.greatest(F.least(c * F.lit(float(scale)), largest), -largest)
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    return rows.filter("id is not null and x is not null").filter(finite).select("id", F.transform("x", floored).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of doubles, shorter ones filled with zeros (which leaves inner products as they are)."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0))


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of one vector with rows: longs, or Python integers where doubles don't hold a partial sum."""
    with np.errstate(all="ignore"):
        safe = len(q) * np.abs(q).max(initial=0) * np.abs(c).max(axis=1, initial=0) < EXACT
    if safe.all():
        return (c @ q).astype(np.int64)
    out, exact = np.empty(len(c), object), list(map(int, q.tolist()))
    out[safe] = (c[safe] @ q).astype(np.int64).tolist()
    out[~safe] = [sum(a * int(b) for a, b in zip(exact, row, strict=True)) for row in c[~safe].tolist()]
    return out


def below(score: int) -> float:
    """The largest double that is not above a score."""
    try:
        near = float(score)
    except OverflowError:
        return -math.inf if score < 0 else float(np.finfo(float).max)
    return near if near <= score else math.nextafter(near, -math.inf)


def far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots: each farthest from those before it, starting farthest from the mean."""
    if not len(sample):
        return sample
    nearest = distances(sample, sample.mean(axis=0, keepdims=True))[:, 0]
    chosen = [int(nearest.argmax())]
    nearest = distances(sample, sample[chosen])[:, 0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def upper(square_q: np.ndarray, square_c: np.ndarray, gap: np.ndarray, far: float) -> np.ndarray:
    """No less than the inner product of two vectors, by squared lengths and a gap between their distances to pivots.

    far is the longest pivot's length. The gap gives way by what rounding may have added; bounds beyond
    the doubles' range are infinite.
    """
    with np.errstate(all="ignore"):
        total, reach = square_q + square_c, np.sqrt(square_q) + np.sqrt(square_c) + 2 * far
        slack = np.where(reach * reach < EXACT / 64, 1e-11, 1e-6)
        gap = np.maximum(gap - slack * reach, 0)
        bound = (total - gap * gap) / 2 + slack * (total + 1)
    return np.where(np.isfinite(bound), bound, np.inf)


@dataclass
class Block:
    """Ids, vectors, squared lengths, and distances to the pivots."""

    ids: np.ndarray
    v: np.ndarray
    square: np.ndarray
    table: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray) -> Block:
        with np.errstate(all="ignore"):
            return cls(ids, v, (v * v).sum(axis=1), distances(v, pivots))

    def at(self, rows: np.ndarray) -> Block:
        return Block(self.ids[rows], self.v[rows], self.square[rows], self.table[rows])

    def packed(self) -> list:
        """n, ids, the vectors' number type, vectors and distances: small whole numbers in few bytes."""
        top = np.abs(self.v).max(initial=0)
        kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
        return [len(self.ids), self.ids.astype("<i8").tobytes(), kind, self.v.astype(kind).tobytes(), self.table.astype("<f8").tobytes()]

    @classmethod
    def unpacked(cls, n: int, ids: bytes, kind: str, v: bytes, table: bytes) -> Block:
        own = np.frombuffer(v, kind).reshape(n, -1).astype(np.float64)
        with np.errstate(all="ignore"):
            return cls(np.frombuffer(ids, "<i8"), own, (own * own).sum(axis=1), np.frombuffer(table, "<f8").reshape(n, -1))


NAMES, KINDS = ["n", "ids", "kind", "v", "dist"], [pa.int64(), pa.binary(), pa.string(), pa.binary(), pa.binary()]
SCHEMA = "n long, ids binary, kind string, v binary, dist binary"


def best_first(ids: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, equal ones by id."""
    if found.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-found[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -found))[:k]


def search(query: int, qid: int, q: Block, c: Block, floor: float, k: int, far: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of up to k best candidates of a block with at least the floor's score, found in bound order."""
    with np.errstate(all="ignore"):
        gap = np.abs(c.table - q.table[query]).max(axis=1, initial=0)
    bound = upper(q.square[query], c.square, gap, far)
    at = np.flatnonzero((bound >= floor) & (c.ids != qid))
    at = at[np.argsort(-bound[at], kind="stable")]
    kept, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(at), STEP):
        if len(best) >= k:
            floor = max(floor, below(int(best[-1])))
        part = at[start : start + STEP]
        if bound[part[0]] < floor:
            break
        found = scores(q.v[query], c.v[part])
        good = (found >= floor).astype(bool)
        kept, best = np.concatenate((kept, part[good])), np.concatenate((best, found[good]))
        order = best_first(c.ids[kept], best, k)
        kept, best = kept[order], best[order]
    return kept, best


def exported(best: np.ndarray) -> tuple[list[int], list[bytes | None]]:
    """Scores as longs, and for those beyond them bytes that sort like the exact ones."""

    def order(x: int) -> bytes:
        size = abs(x).to_bytes((x.bit_length() + 8) // 8, "big")
        whole = len(size).to_bytes(4, "big") + size
        return whole if x > 0 else bytes(255 - b for b in whole)

    exact = best.tolist()
    return [min(MOST, max(LEAST, x)) for x in exact], [None if LEAST < x < MOST else order(x) for x in exact]


def reachable(q: Block, low: np.ndarray, high: np.ndarray, square: np.ndarray, floors: np.ndarray, far: float) -> np.ndarray:
    """Whether each query (row) can gain from each cell (column), by the cells' intervals and largest squared lengths."""
    out = np.zeros((len(q.ids), len(low)), bool)
    for a in range(0, len(low), CELLS_AT_ONCE):
        cells = slice(a, a + CELLS_AT_ONCE)
        with np.errstate(all="ignore"):
            gap = np.maximum(np.maximum(low[None, cells] - q.table[:, None], q.table[:, None] - high[None, cells]), 0).max(axis=2, initial=0)
        out[:, cells] = upper(q.square[:, None], square[None, cells], gap, far) >= floors[:, None]
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = 100, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, key, score): for each vector whose key is divisible by `every`, its k best other rows.

    Score: integer inner product of quantised vectors, computed exactly; ranks go by the exact
    scores, and one beyond 64 bits is returned as the nearest long. Ties go to the smaller key; all, if
    there are fewer than k. Rows that share a query's key are its own and no candidates;
    a repeated query counts once (its least vector), a repeated candidate as often as it is
    there. Vectors of unlike length are filled with zeros. No rows in, or no queries: no rows out.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stored(quantised(vectors, key, vector, scale), "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    draw = F.pmod(F.xxhash64(F.lit(13), "id", "v"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.filter(draw < min(1.0, SAMPLE / max(1, n))).groupBy("id", "v").agg(F.lit(1)).toArrow().combine_chunks()  # a repeated row counts once
    sample = matrix(drawn["v"].combine_chunks(), width) if len(drawn) else np.zeros((0, width))
    order = np.lexsort((*sample.T, drawn["id"].to_numpy())) if len(drawn) else np.zeros(0, np.int64)
    sample = sample[order]
    anchor = far_apart(sample, pivots)
    with np.errstate(all="ignore"):
        far = float(np.sqrt((anchor * anchor).sum(axis=1)).max(initial=0))
    shared = spark.sparkContext.broadcast((anchor, Block.of(drawn["id"].to_numpy()[order] if len(drawn) else order, sample, anchor)))

    def candidate_blocks(batches):
        """Blocks of one nearest pivot each; what is left at the end is cut in the pivots' order, as pivot -1."""
        anchors, _ = shared.value
        held: dict[int, list[Block]] = {}

        def row(near: int, block: Block):
            low, high = (block.table.min(axis=0), block.table.max(axis=0)) if block.table.size else (np.zeros(0), np.zeros(0))
            columns = [*block.packed(), near, int(block.ids.min()), low.tolist(), high.tolist(), float(block.square.max())]
            kinds = [*KINDS, pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, kinds, strict=True)], names=[*NAMES, "near", "mark", "low", "high", "top"])

        def whole(parts: list[Block]) -> Block:
            return Block(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "v", "square", "table")))

        for batch in batches:
            block = Block.of(batch.column("id").to_numpy(), matrix(batch.column("v"), width), anchors)
            near = np.nan_to_num(block.table, nan=np.inf).argmin(axis=1) if block.table.size else np.zeros(len(block.ids), np.int64)
            for p in np.unique(near).tolist():
                held.setdefault(p, []).append(block.at(np.flatnonzero(near == p)))
                if sum(len(b.ids) for b in held[p]) >= BLOCK:
                    full = whole(held[p])
                    for a in range(0, len(full.ids) - BLOCK + 1, BLOCK):
                        yield row(p, full.at(np.arange(a, a + BLOCK)))
                    rest = full.at(np.arange(len(full.ids) // BLOCK * BLOCK, len(full.ids)))
                    held[p] = [rest] if len(rest.ids) else []
        left = [b for p in sorted(held) for b in held[p]]
        if left:
            full = whole(left)
            for a in range(0, len(full.ids), BLOCK):
                yield row(-1, full.at(np.arange(a, min(a + BLOCK, len(full.ids)))))

    made = rows.mapInArrow(candidate_blocks, f"{SCHEMA}, near int, mark long, low array<double>, high array<double>, top double")
    blocks = stored(made, "candidate-blocks")
    counts = {r["near"]: r["n"] for r in blocks.groupBy("near").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each pivot
    each = max(CELL_BLOCKS, -(-2 * sum(counts.values()) // MAX_CELLS))
    first, parts, cells = [0] * (len(anchor) + 1), [1] * (len(anchor) + 1), 0
    for near, count in sorted(counts.items()):
        first[near + 1], parts[near + 1] = cells, -(-count // each)
        cells += parts[near + 1]
    place = F.col("near") + 2
    start, share = (F.element_at(F.array(*[F.lit(x) for x in own]), place) for own in (first, parts))
    celled = blocks.withColumn("cell", (start + F.pmod(F.xxhash64("mark", "n", "top"), share)).cast("int"))
    sides = [F.min(F.element_at("low", i + 1)).alias(f"l{i}") for i in range(len(anchor))] + [F.max(F.element_at("high", i + 1)).alias(f"h{i}") for i in range(len(anchor))]
    known = celled.groupBy("cell").agg(F.max("top").alias("top"), *sides).toArrow().sort_by("cell")  # MAX_CELLS rows and one for each pivot at most
    bounds = [np.stack([known[f"{s}{i}"].to_numpy() for i in range(len(anchor))], axis=1) if len(anchor) else np.zeros((len(known), 0)) for s in "lh"]
    intervals = spark.sparkContext.broadcast((known["cell"].to_numpy(), *bounds, known["top"].to_numpy()))

    def query_blocks(batches):
        anchors, start = shared.value
        numbers, low, high, square = intervals.value
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(a, QUERY_BLOCK)
                q = Block.of(part.column("id").to_numpy(), matrix(part.column("v"), width), anchors)
                floors = np.array([_floor(i, q, start, k, far) for i in range(len(q.ids))])
                gains = reachable(q, low, high, square, floors, far)
                for cell in np.flatnonzero(gains.any(axis=0)).tolist():
                    own = np.flatnonzero(gains[:, cell])
                    columns = [*q.at(own).packed(), floors[own].astype("<f8").tobytes(), int(numbers[cell])]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, [*KINDS, pa.binary(), pa.int32()], strict=True)], names=[*(f"q{c}" for c in NAMES), "floors", "cell"])

    wanted = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).select("id", "v")
    asked = wanted.mapInArrow(query_blocks, ", ".join(f"q{c}" for c in SCHEMA.split(", ")) + ", floors binary, cell int")
    # a task for each cell: what a cell costs to evaluate is far more than its bytes tell
    sides = (df.repartition(max(1, cells), "cell") for df in (asked, celled.select(*NAMES, "cell")))
    met = next(sides).join(next(sides), "cell").select(*NAMES, *(f"q{c}" for c in NAMES), "floors")

    def evaluate(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                c, q = Block.unpacked(*(row[x] for x in NAMES)), Block.unpacked(*(row[f"q{x}"] for x in NAMES))
                floors = np.frombuffer(row["floors"], "<f8")
                low, high = (c.table.min(axis=0), c.table.max(axis=0)) if c.table.size else (np.zeros(0), np.zeros(0))
                hit = reachable(q, low[None], high[None], c.square.max(keepdims=True), floors, far)[:, 0]
                ids, other, score, over = [], [], [], []
                for x in np.flatnonzero(hit).tolist():
                    at, best = search(x, int(q.ids[x]), q, c, float(floors[x]), k, far)
                    longs, order = exported(best)
                    ids += [int(q.ids[x])] * len(at)
                    other += c.ids[at].tolist()
                    score += longs
                    over += order
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(other, pa.int64()), pa.array(score, pa.int64()), pa.array(over, pa.binary())], names=["query_id", "id", "score", "over"])

    found = met.mapInArrow(evaluate, "query_id long, id long, score long, over binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("over"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def _floor(query: int, q: Block, sample: Block, k: int, far: float) -> float:
    """A score that the query's k-th best candidate reaches for sure: its k-th in the sample."""
    _, best = search(query, int(q.ids[query]), q, sample, -math.inf, k, far)
    return below(int(best[-1])) if len(best) == k else -math.inf
