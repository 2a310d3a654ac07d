"""SimHash near-duplicates: fingerprints of word shingles, linked through vantage-point trees.

Links are pairs of fingerprints at RADIUS or fewer differing bits. The 64 bits are cut into
blocks, and the blocks' search radii sum to RADIUS - blocks + 1: were a pair farther apart
than its radius in every block, it would differ in more than RADIUS bits. So each block gets
one vantage-point tree over the Hamming distance inside the block, searched with that small
radius, for which the triangle bound prunes well (over all 64 bits random fingerprints lie
32 +- 4 apart, and a radius of 4 would visit most branches).

A tree is built from a bounded sample on the driver and broadcast; its leaves are shards. A
fingerprint goes to its own leaf, and to each leaf whose border it is within reach of: at a
node with threshold t a point at distance d <= t goes inside, one at d > t outside, and one
inside with d > t - radius outside too. By the triangle inequality every pair within the
radius meets in some leaf. Each leaf is split further in the same way where it lies and
compared exactly; a leaf too dense for its block's tree is cut by trees over RADIUS + 1 blocks of
the bits in which its points differ, since points within RADIUS bits agree in one of them.
Only a spanning star of each leaf's links leaves the task, never all pairs. Stars are merged by
alternating large-star and small-star steps over written tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import annotated, discard, spread_join, stored

SHINGLE, SEED, RADIUS = 4, 42, 4
#: (bits of the block, search radius in it); see the module's docstring for the sum of radii.
BLOCKS = ((22, 1), (21, 1), (21, 0))
#: Fingerprints that trees are built from, and those wanted in one leaf.
SAMPLE, LEAF, MAX_LEAVES = 16_384, 6_000, 2_048
#: Fingerprints compared as one matrix; those that one task may hold (8 bytes each).
SMALL, HELD = 384, 4_000_000
#: Removed ids that deduplicated() broadcasts at most (about 24 bytes each).
BROADCAST_IDS = 1_000_000
#: Shingles unpacked to bits at once.
UNPACKED = 65_536


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text; 0 for null and for a text without words.

    Words are runs between ASCII white space, A-Z lower-cased; shingles are `width` words
    joined by a space, repeats included, or all words if there are fewer.
    """
    joined = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(joined)]))
    n = max(1, len(starts) - width + 1)
    hashed, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.array([hashed(view[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, UNPACKED):
        ones += np.unpackbits(hashes[at : at + UNPACKED].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", column: str = "fp") -> DataFrame:
    """docs with the fingerprint of each whole text as a signed long; no shuffle."""

    def run(texts: pa.Array) -> list:
        return [np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64)]

    return annotated(docs, text, [T.StructField(column, T.LongType())], run)


def masks(blocks=BLOCKS) -> list[tuple[np.uint64, int]]:
    """Bit mask and radius of each block."""
    out, low = [], 0
    for bits, radius in blocks:
        out.append((np.uint64(((1 << bits) - 1) << low), radius))
        low += bits
    if low != 64 or sum(r for _, r in out) != RADIUS - len(out) + 1:
        raise ValueError("blocks must cover 64 bits and their radii sum to RADIUS - blocks + 1")
    return out


@dataclass
class VantageTree:
    """A vantage-point tree over the bits of mask, as node arrays; child < 0 is leaf -1 - child."""

    mask: np.uint64
    radius: int
    vantage: list[int]
    threshold: list[int]
    inner: list[int]
    outer: list[int]
    root: int
    leaves: int

    @classmethod
    def build(cls, points: np.ndarray, mask: np.uint64, radius: int, leaf: int) -> VantageTree:
        """Split while a node has over `leaf` points and a split pays."""
        tree = cls(mask, radius, [], [], [], [], 0, 0)
        tree.root = tree._grow(points, leaf, np.random.default_rng(7))
        return tree

    def _grow(self, points: np.ndarray, leaf: int, rng) -> int:
        best = None
        if len(points) > leaf:
            for vantage in points[rng.integers(0, len(points), 3)]:
                counts = np.bincount(np.bitwise_count((points ^ vantage) & self.mask), minlength=65)
                inside = np.cumsum(counts)
                for t in np.flatnonzero(counts)[:-1]:
                    near = inside[t] - (inside[t - self.radius] if t >= self.radius else 0)
                    worst = max(inside[t], len(points) - inside[t] + near)
                    if worst < 0.9 * len(points) and (best is None or worst < best[0]):
                        best = (worst, vantage, int(t))
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, vantage, t = best
        distance = np.bitwise_count((points ^ vantage) & self.mask)
        node = len(self.vantage)
        for column, value in ((self.vantage, int(vantage)), (self.threshold, t), (self.inner, 0), (self.outer, 0)):
            column.append(value)
        self.inner[node] = self._grow(points[distance <= t], leaf, rng)
        self.outer[node] = self._grow(points[distance > t - self.radius], leaf, rng)
        return node

    def shards(self, points: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, positions of the points in it): each point's own leaf and those it is within reach of."""
        out, todo = [], [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((-1 - node, at))
                continue
            distance = np.bitwise_count((points[at] ^ np.uint64(self.vantage[node])) & self.mask).astype(np.int64)
            t = self.threshold[node]
            todo += [(self.inner[node], at[distance <= t]), (self.outer[node], at[distance > t - self.radius])]
        return out


def _merged(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum labels after joining a with b: repeated hooking and pointer jumping."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped


def linked(points: np.ndarray, mask: np.uint64, block_radius: int, radius: int = RADIUS) -> np.ndarray:
    """For distinct points of one shard: the position of the least member of each one's component.

    All links between points within block_radius of each other under mask are found; others may be.
    """
    tree, edges = VantageTree.build(points, mask, block_radius, SMALL), []
    for _, at in tree.shards(points):
        _star(points, at, radius, edges)
    a, b = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 2
    return _merged(np.arange(len(points)), a, b)


def _star(points: np.ndarray, at: np.ndarray, radius: int, edges: list) -> None:
    """Adds to edges pairs of positions whose components are those of all links among the distinct points at `at`."""
    own = points[at]
    if len(at) <= 4 * SMALL:
        a, b = np.nonzero(np.triu(np.bitwise_count(own[:, None] ^ own[None, :]) <= radius, 1))
        if len(a):
            root = _merged(np.arange(len(at)), a, b)
            far = np.flatnonzero(root != np.arange(len(at)))
            edges.append((at[far], at[root[far]]))
        return
    differing = int(np.bitwise_or.reduce(own ^ own[0]))
    bits = [np.uint64(1 << i) for i in range(64) if differing >> i & 1]
    if len(bits) <= radius:
        edges.append((at[1:], np.full(len(at) - 1, at[0])))
        return
    for k in range(radius + 1):
        block = np.bitwise_or.reduce(np.array(bits[k :: radius + 1], np.uint64))
        for _, inner in VantageTree.build(own, block, 0, SMALL).shards(own):
            order = inner[np.argsort(own[inner] & block, kind="stable")]
            value = own[order] & block
            for same in np.split(order, np.flatnonzero(value[1:] != value[:-1]) + 1):
                if len(same) > 1:
                    _star(points, at[same], radius, edges)


def links(fps: DataFrame, blocks=BLOCKS, leaf: int = LEAF, held: int = HELD) -> DataFrame:
    """(a, b): edges whose components are those of all pairs within RADIUS bits; fps has distinct, non-null fp."""
    spark = fps.sparkSession
    n = fps.count()
    draw = F.pmod(F.xxhash64(F.lit(3), F.col("fp")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = fps.filter(draw < min(1.0, SAMPLE / max(1, n))).toArrow()["fp"].to_numpy().view(np.uint64)
    per_leaf = max(8, int(max(leaf, n / MAX_LEAVES) * len(sample) / max(1, n)))
    trees = [VantageTree.build(np.sort(sample), mask, radius, per_leaf) for mask, radius in masks(blocks)]
    shared = spark.sparkContext.broadcast(trees)

    def route(batches):
        for batch in batches:
            points = batch.column("fp").to_numpy().view(np.uint64)
            for k, tree in enumerate(shared.value):
                for shard, at in tree.shards(points):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), shard, np.int32)), pa.array(points[at].view(np.int64))], names=["tree", "leaf", "fp"])

    routed = fps.select("fp").mapInArrow(route, "tree int, leaf int, fp long")
    routed = routed.withColumn("cell", F.lit(0)) if n <= held else _cells(routed, held)

    def solve(key, table):
        points = np.unique(table.column("fp").to_numpy().view(np.uint64))
        tree = shared.value[key[0].as_py()]
        parent = linked(points, tree.mask, tree.radius)
        far = np.flatnonzero(parent != np.arange(len(points)))
        signed = points.view(np.int64)
        return pa.table({"a": pa.array(signed[far]), "b": pa.array(signed[parent[far]])})

    return routed.groupBy("tree", "leaf", "cell").applyInArrow(solve, "a long, b long")


def _cells(routed: DataFrame, held: int) -> DataFrame:
    """Split leaves of over `held` points: points fall in g parts, and each two parts meet in a cell of their own."""
    sizes = routed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("size"))
    parts = sizes.select("tree", "leaf", F.ceil(2 * F.col("size") / held).cast("int").alias("g"))  # a cell holds two parts
    part = F.pmod(F.xxhash64(F.lit(5), F.col("fp")), F.col("g")).cast("int")
    split = routed.join(F.broadcast(parts), ["tree", "leaf"]).withColumn("part", part)  # MAX_LEAVES rows a tree at most
    cells = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.least(x, F.col("part")) * F.col("g") + F.greatest(x, F.col("part")))
    return split.select("tree", "leaf", "fp", F.explode(cells).alias("cell"))


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(a, root) for every node of edges (a, b) but each component's least, which is the root.

    Alternating large-star and small-star steps; each round is written to the shared folder.
    Minima are partial aggregates and the joins that use them deal a hub's edges over several
    tasks, so a hub with most edges makes no hot task.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    kept = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    known = state(kept)
    while True:
        turned = kept.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = kept.unionByName(turned).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("_n"))
        large = spread_join(turned, least, "a", known[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = stored(large, label)
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = spread_join(large, least, "a", known[0])
        small = small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = stored(small.filter("a != b").distinct(), label)
        discard(large)
        discard(kept)
        kept, before, known = new, known, state(new)
        if known == before:
            return kept.select("a", F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of every row of docs.

    component_id is the least non-null key in the component of the row's fingerprint. Null and
    empty texts have fingerprint zero and link like any other; rows with a null key are
    fingerprinted and link too, and get the component's least key, or null if it has none.
    Repeated rows each come back; one fingerprint or component may hold most rows. A text of any
    length is one fingerprint. Other columns of docs are not read. No rows in: no rows out.
    """
    own = stored(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("key", "fp"), "fingerprints")
    fps = stored(own.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("_n")), "distinct-fingerprints")
    distinct, rows = fps.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    roots = components(links(fps.select("fp")))
    rooted = stored(fps.join(roots, F.col("fp") == F.col("a"), "left").select("fp", "least", F.col("_n").alias("_rows"), F.coalesce("root", "fp").alias("root")), "roots")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    by_fp = stored(spread_join(rooted, firsts, "root", distinct).select("fp", "component_id", F.col("_rows").alias("_n")), "components")
    return spread_join(own, by_fp, "fp", rows).select(F.col("key").alias(key), "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def deduplicated(docs: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs without all but one document of each component: that with the least doc_id stays.

    Rows with a null doc_id can't be told apart and stay. Where a doc_id is repeated, of its rows in
    the component that it leads one stays: that with the least hash of its columns; its rows in
    other components go, as those keep a smaller doc_id. Up to broadcast_ids removed ids are broadcast,
    so texts stay where they lie; beyond that, both sides are dealt by id. Columns of docs keep
    their names, whatever they are. No rows in: no rows out.
    """
    found = stored(near_duplicates(docs).filter("doc_id is not null"), "found")
    told = stored(found.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("stays"), F.count(F.lit(1)).alias("n")), "told")
    gone, repeated = told.agg(F.count_if(~F.col("stays") | (F.col("n") > 1)), F.count_if(F.col("stays") & (F.col("n") > 1))).first()
    names = _unused(docs, ["removed", "salt"])
    # null ids get salts that nothing meets, so they don't come together in one task
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1024))).otherwise(F.lit(0))
    removed = told.filter("not stays or n > 1").select(F.col("doc_id").alias(names[0]), F.lit(0).cast("long").alias(names[1] + "_"))
    removed = F.broadcast(removed) if gone <= broadcast_ids else removed.hint("shuffle_hash")
    zero = F.lit(0).cast(dict(docs.dtypes)["doc_id"])
    met = docs.withColumn(names[1], salt.cast("long"))
    out = met.join(removed, (F.coalesce(F.col("doc_id"), zero) == F.col(names[0])) & (F.col(names[1]) == F.col(names[1] + "_")), "left_anti").drop(names[1])
    if not repeated:
        return out
    several = told.filter("stays and n > 1").select(F.col("doc_id").alias(names[0]))
    leads = found.filter("component_id = doc_id").select(F.col("doc_id").alias(names[0]), F.col("fp").alias(names[1])).distinct()
    rows = docs.join(several.hint("shuffle_hash") if repeated > broadcast_ids else F.broadcast(several), F.col("doc_id") == F.col(names[0]), "left_semi")
    fp = _unused(docs, ["fp"])[0]
    rows = fingerprints(rows, column=fp).join(F.broadcast(leads) if repeated <= broadcast_ids else leads, (F.col("doc_id") == F.col(names[0])) & (F.col(fp) == F.col(names[1])), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(fp))
    return out.unionByName(one.select(*[F.col(f"`{fp}`.`{c}`").alias(c) for c in docs.columns]))


def _unused(docs: DataFrame, names: list[str]) -> list[str]:
    """Names like these that no column of docs has."""
    tail = "_" * (1 + max(map(len, docs.columns)))
    return [f"_{n}{tail}" for n in names]


__all__ = ["VantageTree", "components", "deduplicated", "fingerprint", "fingerprints", "hex_fingerprint", "linked", "links", "masks", "near_duplicates"]
