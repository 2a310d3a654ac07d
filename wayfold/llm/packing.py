"""Bin packing of token pieces into sequences, planned on the histogram of lengths.

Lengths are integers from 1 to the capacity, so all that a plan needs is how many pieces
there are of each: at most `capacity` numbers, whatever the size of the data. A plan is a
list of runs (length, first rank, first sequence, pieces per sequence, offset): the pieces
of one length are ranked, and a run places a range of ranks by arithmetic. Both the planning
time and the size of the broadcast plan depend on the capacity alone. A piece's rank is its number
among its task's pieces of like length, and how many earlier tasks have: pieces are never sorted
or brought together, so a length that most pieces share is like any other.

Two planners: linear_grouping() and best_fit_decreasing().
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import stored

CAPACITY = 4096
#: Groups of equal cardinality; pieces of at most SMALL * capacity are small; pivots of the configuration program at most.
GROUPS, SMALL, PIVOTS = 128, 1 / 3, 4000
#: Bytes of a broadcast count of pieces by task and length, and of all counts that are broadcast at most; more are joined by shuffle.
COUNT_BYTES, BROADCAST_BYTES = 130, 32 << 20


class SegmentTree:
    """Least stored capacity that is at least a wanted one, in logarithmic time; capacities 0..top."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.some = np.zeros(2 * self.size, bool)

    def put(self, capacity: int, present: bool) -> None:
        at = self.size + capacity
        self.some[at] = present
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def least(self, wanted: int) -> int | None:
        at = self.size + wanted
        if self.some[at]:
            return wanted
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


@dataclass
class Plan:
    """Runs of placed pieces, and the open sequences by what room they have left."""

    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def __post_init__(self):
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.tree = SegmentTree(self.capacity)

    def _leave(self, first: int, count: int, room: int) -> None:
        if count and room:
            if not self.open[room]:
                self.tree.put(room, True)
            self.open[room].append((first, count))

    def bins(self, slots: list[list[tuple[int, int, int]]], count: int) -> None:
        """Open count sequences; each slot lists (length, first rank, pieces), count pieces in all, one to a sequence."""
        borders = sorted({0, count, *(int(b) for s in slots for b in np.cumsum([r[2] for r in s]))})
        for a, b in zip(borders, borders[1:]):
            offset = 0
            for slot in slots:
                at = 0
                for length, rank, n in slot:
                    if at <= a < at + n:
                        self.runs.append((length, rank + a - at, self.sequences + a, 1, offset))
                        offset += length
                        break
                    at += n
            self._leave(self.sequences + a, b - a, self.capacity - offset)
        self.sequences += count

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Each piece to the fullest sequence that has room for it, or to a new one."""
        while count:
            room = self.tree.least(length)
            if room is None:
                first, bins, room = self.sequences, -(-count // (self.capacity // length)), self.capacity
                self.sequences += bins
            else:
                first, bins = self.open[room].pop()
                if not self.open[room]:
                    self.tree.put(room, False)
            each = room // length
            full = min(bins, count // each)
            rest = min(count - full * each, each) if full < bins else 0
            self.runs.append((length, rank, first, each, self.capacity - room))
            self._leave(first, full, room - each * length)
            self._leave(first + full, int(rest > 0), room - rest * length)
            used = full + (rest > 0)
            if room < self.capacity or bins > used:
                self._leave(first + used, bins - used, room)
            rank, count = rank + full * each + rest, count - full * each - rest

    def arrays(self) -> dict[str, np.ndarray]:
        """Runs by (length, first rank), for searching."""
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return dict(zip(("length", "rank", "sequence", "each", "offset"), runs.T, strict=True))


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Lengths from the longest on, each piece where it fits most tightly; room is found by a segment tree."""
    plan = Plan(capacity)
    for length in sorted(histogram, reverse=True):
        plan.best_fit(length, 0, histogram[length])
    return plan


def _configurations(sizes: list[int], demand: list[int], capacity: int, pivots: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and their (fractional) numbers that cover demand with few sequences: column generation."""
    k = len(sizes)
    columns = np.diag([capacity // s for s in sizes]).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ np.array(demand, float)
    for _ in range(pivots):
        price = inverse.sum(axis=0)
        value, take = _knapsack(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ take
        ratio = np.where(direction > 1e-9, amount / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        amount = amount - ratio[out] * direction
        amount[out] = ratio[out]
        inverse[out] /= direction[out]
        for i in np.flatnonzero(np.abs(direction) > 1e-12):
            if i != out:
                inverse[i] -= direction[i] * inverse[out]
        columns[:, out] = take
    return [(columns[:, i].astype(int), max(0.0, amount[i])) for i in range(k)]


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration, each size any number of times."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for i, s in enumerate(sizes):
        if price[i] <= 0:
            continue
        for low in range(s, capacity + 1, s):  # cells low..low+s-1 depend only on the cells before them
            own = best[low - s : min(capacity + 1 - s, low)] + price[i]
            cells = slice(low, low + len(own))
            better = own > best[cells] + 1e-12
            last[cells][better] = i
            best[cells] = np.where(better, own, best[cells])
    take, at = np.zeros(len(sizes)), int(best.argmax())
    value = best[at]
    while at > 0 and last[at] >= 0:
        take[last[at]] += 1
        at -= sizes[last[at]]
    return float(value), take


def linear_grouping(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL, pivots: int = PIVOTS) -> Plan:
    """Round large lengths up in groups of equal cardinality, optimise configurations of the few sizes left,
    put actual pieces in the places, then best-fit what is left and the small ones, longest first.
    """
    plan = Plan(capacity)
    lengths = sorted((x for x in histogram if x > small * capacity and histogram[x]), reverse=True)
    total = sum(histogram[x] for x in lengths)
    pieces: list[list[list[int]]] = []  # by rounded size: [length, first rank, count]
    sizes: list[int] = []
    at = 0
    for length in lengths:
        rank = 0
        while rank < histogram[length]:
            group = at * groups // total
            border = -(-(group + 1) * total // groups)
            n = min(histogram[length] - rank, border - at)
            if not sizes or sizes[-1] != length and group != last_group:
                sizes.append(length)
                pieces.append([])
            pieces[-1].append([length, rank, n])
            last_group = group
            rank, at = rank + n, at + n
    if sizes:
        demand = [sum(p[2] for p in own) for own in pieces]
        for configuration, amount in sorted(_configurations(sizes, demand, capacity, pivots), key=lambda x: -x[1]):
            used = np.flatnonzero(configuration)
            count = min([int(amount + 1e-6), *(demand[i] // configuration[i] for i in used)]) if len(used) else 0
            if not count:
                continue
            slots = []
            for i in used:
                demand[i] -= count * int(configuration[i])
                for _ in range(int(configuration[i])):
                    slots.append(_taken(pieces[i], count))
            plan.bins(slots, count)
    rest: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for own in pieces:
        for length, rank, n in own:
            if n:
                rest[length].append((rank, n))
    for length in histogram:
        if length <= small * capacity and histogram[length]:
            rest[length].append((0, histogram[length]))
    for length in sorted(rest, reverse=True):
        for rank, n in rest[length]:
            plan.best_fit(length, rank, n)
    return plan


def _taken(own: list[list[int]], count: int) -> list[tuple[int, int, int]]:
    """The next count pieces of a group, longest first."""
    out = []
    while count:
        length, rank, n = own[0]
        got = min(n, count)
        out.append((length, rank, got))
        own[0] = [length, rank + got, n - got]
        if got == n:
            own.pop(0)
        count -= got
    return out


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces with _part and _ordinal: the task's number, and the place among the task's pieces of that length.

    They hold once the rows are written.
    """
    names = [*pieces.columns, "_part", "_ordinal"]

    def run(batches):
        task, seen = TaskContext.get(), {}
        for batch in batches:
            ordinal = ordinals(batch.column("length").to_pylist(), seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task.partitionId()] * batch.num_rows, pa.int32()), pa.array(ordinal, pa.int64())], names=names)

    return pieces.mapInArrow(run, T.StructType([*pieces.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_ordinal", T.LongType())]))


def ordinals(lengths: list[int], seen: dict[int, int]) -> list[int]:
    """The number of earlier pieces of each one's length; seen holds those of the task so far."""
    out = []
    for n in lengths:
        seen[n] = at = seen.get(n, -1) + 1
        out.append(at)
    return out


def ranked(made: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """made (written, with _part and _ordinal) with _rank, the place among all pieces of a length, in their place; and the histogram of lengths."""
    counts = stored(made.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")), "piece-counts")
    histogram, rows = {}, 0
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("parts")).collect():  # a row for each length
        histogram[int(r["length"])], rows = int(r["n"]), rows + r["parts"]
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each task
    bases = counts.select(F.col("_part").alias("_p"), F.col("length").alias("_l"), F.coalesce(before, F.lit(0)).alias("_base"))
    bases = F.broadcast(bases) if rows * COUNT_BYTES <= broadcast_bytes else bases
    own = made.join(bases, (F.col("_part") == F.col("_p")) & (F.col("length") == F.col("_l"))).withColumn("_rank", F.col("_base") + F.col("_ordinal"))
    return own.drop("_part", "_ordinal", "_p", "_l", "_base"), histogram


def packed(pieces: DataFrame, planner=linear_grouping, capacity: int = CAPACITY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pieces (with a column length from 1 to capacity) with sequence_id and offset.

    Sequences are numbered from 0; in each, pieces lie gapless from offset 0. An empty table
    stays empty. Every row is placed, repeated ones and those with nulls in other columns too;
    pieces of one length are interchangeable. Written pieces that numbered() or tokens.pieces() has given
    _part and _ordinal are taken as they are, others are numbered and written first. A column of
    pieces named sequence_id or offset is replaced.
    """
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    made = pieces if {"_part", "_ordinal"} <= set(pieces.columns) else stored(numbered(pieces), "numbered-pieces")
    own, histogram = ranked(made, broadcast_bytes)
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError(f"lengths must be from 1 to {capacity}")
    return placed(own, planner(histogram, capacity))


def placed(ranked: DataFrame, plan: Plan) -> DataFrame:
    """ranked without _rank (the place among pieces of its length), with sequence_id and offset by the plan."""
    runs = plan.arrays()
    last = np.append(runs["length"][1:] != runs["length"][:-1], True) if len(runs["length"]) else np.zeros(0, bool)
    stop = np.where(last, np.int64(1) << np.int64(62), np.append(runs["rank"][1:], 0)[: len(last)])
    table = pa.table({"_l": runs["length"], "_first": runs["rank"], "_stop": stop, "_sequence": runs["sequence"], "_each": runs["each"], "_at": runs["offset"]})
    side = F.broadcast(ranked.sparkSession.createDataFrame(table.to_pandas(), "_l long, _first long, _stop long, _sequence long, _each long, _at long"))  # a plan's runs: bounded by the capacity
    placed_ = ranked.join(side, (F.col("length") == F.col("_l")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_stop")))
    over = F.col("_rank") - F.col("_first")
    sequence = F.col("_sequence") + F.expr("(_rank - _first) div _each")
    offset = F.col("_at") + over % F.col("_each") * F.col("length")
    return placed_.select(*[F.col(f"`{c}`") for c in ranked.columns if c != "_rank"], sequence.alias("sequence_id"), offset.alias("offset"))
