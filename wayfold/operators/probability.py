"""Stick-breaking, multinomial and multi-step transition algebra on long tables (origin, dest, slot, p)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.numeric import clipped


def _before(keys: list[str]):
    return Window.partitionBy(*keys, "slot").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)


def stick_to_multinomial(sticks: DataFrame, keys: list[str], value: str = "p") -> DataFrame:
    """p of each row becomes p times the product of (1 - p) over earlier ranks; a null makes all that follow null."""
    w = _before(keys)
    kept = F.coalesce(F.product(1 - F.col(value)).over(w), F.lit(1.0))
    poisoned = F.coalesce(F.max(F.col(value).isNull()).over(w), F.lit(False))
    return sticks.withColumn("_k", kept).withColumn("_x", poisoned).withColumn(value, F.when(~F.col("_x"), F.col(value) * F.col("_k"))).drop("_k", "_x")


def leftover(multinomial: DataFrame, keys: list[str], value: str = "p") -> DataFrame:
    """(keys, slot, rest): what a slot's probabilities leave of 1."""
    return multinomial.groupBy(*keys, "slot").agg((1 - F.sum(value)).alias("rest"))


def multinomial_to_cascade(multinomial: DataFrame, keys: list[str], value: str = "p", eps: float = 1e-12) -> DataFrame:
    """p becomes p / (1 - sum of p over earlier ranks), within [0, 1]; null stays null."""
    left = 1 - F.coalesce(F.sum(value).over(_before(keys)), F.lit(0.0))
    own = multinomial.withColumn("_l", F.greatest(left, F.lit(eps)))
    return own.withColumn(value, F.when(F.col(value).isNotNull(), clipped(F.col(value) / F.col("_l"), 0.0, 1.0))).drop("_l")


def full_transition(partial: DataFrame, zones: DataFrame, eps: float = 1e-12) -> DataFrame:
    """(origin, dest, slot, p): what a row leaves of 1 is shared by its cells of eps or less, so each row sums to 1.

    partial has the given cells; zones(zone) the cells of a row. Rows are made for the
    (origin, slot) that partial has. Only zones, a dimension, is repeated for each row.
    """
    given = partial.withColumn("p", F.when(F.col("p") > eps, F.col("p")))
    rows = given.groupBy("origin", "slot").agg((1 - F.coalesce(F.sum("p"), F.lit(0.0))).alias("_rest"), F.count("p").alias("_some"))
    size = zones.agg(F.collect_list("zone").alias("_all"))
    cells = rows.withColumn("_one", F.lit(1)).join(F.broadcast(size.withColumn("_one", F.lit(1))), "_one").drop("_one")
    fill = F.col("_rest") / F.nullif(F.size("_all") - F.col("_some"), F.lit(0))
    cells = cells.select("origin", "slot", fill.alias("_fill"), F.explode("_all").alias("dest"))
    return cells.join(given.select("origin", "dest", "slot", "p"), ["origin", "dest", "slot"], "left").select("origin", "dest", "slot", F.coalesce("p", "_fill", F.lit(0.0)).alias("p"))


def chained(left: DataFrame, right: DataFrame, steps: int) -> DataFrame:
    """(origin, dest, slot, p): left at slot times right at slot + steps; both are sparse cells."""
    a = left.select("origin", F.col("dest").alias("_mid"), "slot", F.col("p").alias("_a"))
    b = right.select(F.col("origin").alias("_mid"), "dest", (F.col("slot") - steps).alias("slot"), F.col("p").alias("_b"))
    return a.join(b, ["_mid", "slot"]).groupBy("origin", "dest", "slot").agg(F.sum(F.col("_a") * F.col("_b")).alias("p"))


def sparse_cube(partial: DataFrame, zones: int, eps: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """full_transition() kept sparse: the cells above eps, and (origin, slot, fill), the value of all other cells of a row.

    zones is their number. Nothing is made for the other cells.
    """
    cells = partial.filter(F.col("p") > eps).select("origin", "dest", "slot", "p")
    rows = partial.groupBy("origin", "slot").agg((1 - F.coalesce(F.sum(F.when(F.col("p") > eps, F.col("p"))), F.lit(0.0))).alias("_rest"), F.count_if(F.col("p") > eps).alias("_some"))
    return cells, rows.select("origin", "slot", F.coalesce(F.try_divide(F.col("_rest"), zones - F.col("_some")), F.lit(0.0)).alias("fill"))


def sparse_two_step(cells: DataFrame, fills: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (origin, dest, slot, ...) and p: the probability of dest at slot + 1 from origin before slot, of a sparse_cube().

    With P = f + D, where f is a row's fill and D what its cells are above it, row o of P(t) P(t + 1) is
    f_o (sum of all fills + column sums of D) + D_o fills + D_o D: sparse joins and sums, no N by N by T rows.
    Rows that the cube lacks count as zeros.
    """
    above = cells.join(fills, ["origin", "slot"]).select("origin", "dest", "slot", (F.col("p") - F.col("fill")).alias("_d"))
    after = above.select(F.col("origin").alias("_mid"), "dest", (F.col("slot") - 1).alias("slot"), F.col("_d").alias("_e"))
    filled = fills.select(F.col("origin").alias("_mid"), (F.col("slot") - 1).alias("slot"), F.col("fill").alias("_g"))
    all_fills = filled.groupBy("slot").agg(F.sum("_g").alias("_all"))
    columns = after.groupBy("dest", "slot").agg(F.sum("_e").alias("_column"))
    own = above.withColumnRenamed("dest", "_mid")
    through = own.join(filled, ["_mid", "slot"]).groupBy("origin", "slot").agg(F.sum(F.col("_d") * F.col("_g")).alias("_row"))
    wanted = asked.select("origin", "dest", "slot").distinct()
    product = own.join(after, ["_mid", "slot"]).join(wanted, ["origin", "dest", "slot"], "left_semi").groupBy("origin", "dest", "slot").agg(F.sum(F.col("_d") * F.col("_e")).alias("_product"))
    made = asked.join(fills, ["origin", "slot"], "left").join(all_fills, "slot", "left").join(columns, ["dest", "slot"], "left")
    made = made.join(through, ["origin", "slot"], "left").join(product, ["origin", "dest", "slot"], "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("fill", "_all", "_column", "_row", "_product")}
    p = zero["fill"] * (zero["_all"] + zero["_column"]) + zero["_row"] + zero["_product"]
    return made.select(*asked.columns, p.alias("p"))


def multistep(cube: DataFrame, steps: int) -> dict[int, DataFrame]:
    """k -> cells of P(slot) ... P(slot + k - 1), for k from 1 to steps."""
    out = {1: cube}
    for k in range(2, steps + 1):
        out[k] = chained(out[k - 1], cube, k - 1)
    return out


def packed_cube(cube: DataFrame, zones: list[int]) -> DataFrame:
    """(slot, m): each slot's matrix over the given zones as little-endian doubles, row by row; absent cells are 0.

    For dense cubes, where a row for each cell would cost more than the product.
    """
    place = {z: i for i, z in enumerate(zones)}
    n = len(zones)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((n, n))
        m[frame["origin"].map(place), frame["dest"].map(place)] = frame["p"]
        return pd.DataFrame({"slot": frame["slot"].iloc[:1], "m": [m.astype("<f8").tobytes()]})

    return cube.groupBy("slot").applyInPandas(lambda f: pack(f), "slot long, m binary")


def chained_packed(left: DataFrame, right: DataFrame, steps: int, block: int = 32) -> DataFrame:
    """(slot, m): left at slot times right at slot + steps, for packed cubes.

    Slots go to blocks of consecutive ones; both sides of a product meet in the block of the
    left slot, so each matrix is moved once and multiplied by one BLAS call.
    """
    a = left.select("slot", F.lit(0).alias("side"), "m", F.floor(F.col("slot") / block).alias("_b"))
    b = right.select((F.col("slot") - steps).alias("slot"), F.lit(1).alias("side"), "m", F.floor((F.col("slot") - steps) / block).alias("_b"))

    def multiply(table: pa.Table) -> pa.Table:
        held: dict[int, list] = {}
        for slot, side, m in zip(*(table.column(c) for c in ("slot", "side", "m")), strict=True):
            held.setdefault(slot.as_py(), [None, None])[side.as_py()] = np.frombuffer(m.as_buffer(), "<f8")
        out = []
        for slot, (x, y) in sorted(held.items()):
            if x is not None and y is not None:
                n = int(round(len(x) ** 0.5))
                out.append((slot, (x.reshape(n, n) @ y.reshape(n, n)).astype("<f8").tobytes()))
        return pa.table({"slot": pa.array([s for s, _ in out], pa.int64()), "m": pa.array([m for _, m in out], pa.binary())})

    return a.unionByName(b).groupBy("_b").applyInArrow(lambda t: multiply(t), "slot long, m binary")


def unpacked_cube(packed: DataFrame, zones: list[int]) -> DataFrame:
    """(origin, dest, slot, p) of a packed cube."""

    def unpack(batches):
        n = len(zones)
        for batch in batches:
            for slot, m in zip(batch.column("slot").to_pylist(), batch.column("m"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(zones, n)), pa.array(np.tile(zones, n)), pa.array(np.full(n * n, slot)), pa.array(np.frombuffer(m.as_buffer(), "<f8"))], names=["origin", "dest", "slot", "p"])

    return packed.mapInArrow(unpack, "origin long, dest long, slot long, p double")


def row_sums_off(cube: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(origin, slot, total): rows whose probabilities don't sum to 1; empty for a valid cube."""
    return cube.groupBy("origin", "slot").agg(F.sum("p").alias("total")).filter(F.abs(F.col("total") - 1) > tolerance)


def kstep_feature(cells: DataFrame, panel: DataFrame, cube_k: DataFrame, lag: int, compat: bool = False) -> DataFrame:
    """cells and feature: the lag-step probability of each cell's own destination from where the agent was lag slots ago.

    compat takes the destination that the agent really reached for all cells of a slot, as the
    original method does; that lets the target into the feature.
    """
    was = panel.select("agent", (F.col("slot") + lag).alias("slot"), F.col("zone").alias("_from"))
    own = cells.join(was, ["agent", "slot"], "left")
    if compat:
        own = own.join(panel.select("agent", "slot", F.col("zone").alias("_to")), ["agent", "slot"], "left")
    else:
        own = own.withColumn("_to", F.col("dest"))
    cube = cube_k.select(F.col("origin").alias("_from"), F.col("dest").alias("_to"), (F.col("slot") + lag - 1).alias("slot"), F.col("p").alias("feature"))
    return own.join(cube, ["_from", "_to", "slot"], "left").withColumn("feature", F.coalesce("feature", F.lit(0.0))).drop("_from", "_to")


def sparsified(cube: DataFrame, least: float = 1e-5) -> DataFrame:
    """Cells below least are 0."""
    return cube.withColumn("p", F.when(F.col("p") < least, 0.0).otherwise(F.col("p")))


def with_rare(modelled: DataFrame, rare: DataFrame, keys: list[str]) -> DataFrame:
    """Cascade cells as multinomial ones, and the origin's rare pairs with equal shares of what is left.

    modelled (keys, origin, dest, slot, rank, p), rare (keys, origin, dest). What is left is taken in
    slots where all of an origin's modelled pairs have a probability; else rare pairs get null.
    """
    own = [*keys, "origin"]
    made = stick_to_multinomial(modelled, own)
    pairs = modelled.select(*own, "dest").distinct().groupBy(*own).agg(F.count(F.lit(1)).alias("_all"))
    slots = made.groupBy(*own, "slot").agg(F.sum("p").alias("_sum"), F.count("p").alias("_have")).join(pairs, own)
    slots = slots.withColumn("_rest", F.when(F.col("_have") == F.col("_all"), 1 - F.col("_sum")))
    few = rare.select(*own, "dest").distinct().withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*own)))
    shared = few.join(slots, own).select(*own, "dest", "slot", (F.col("_rest") / F.col("_n")).alias("p"))
    return made.select(*own, "dest", "slot", "p").unionByName(shared)


def append_unmodelled(fitted: DataFrame, rare_cells: DataFrame, cube: DataFrame, keys: list[str], period: int) -> DataFrame:
    """fitted and the rare cells of origins that it has none of, with the group cube's probability at slot mod period."""
    new = rare_cells.join(fitted.select(*keys, "origin").distinct(), [*keys, "origin"], "left_anti")
    group = cube.select("origin", "dest", F.col("slot").alias("_s"), "p")
    filled = new.drop("p").withColumn("_s", F.pmod("slot", F.lit(period))).join(group, ["origin", "dest", "_s"], "left")
    names = [*keys, "origin", "dest", "slot", "p"]
    return fitted.select(*names).unionByName(filled.select(*names))


def filled_forward(cells: DataFrame, forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, p): forecasts on the cells' grid, each pair's last one carried forward."""
    own = cells.select(*keys, "slot").join(forecasts.select(*keys, "slot", "p"), [*keys, "slot"], "left")
    w = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("p", F.last("p", ignorenulls=True).over(w))


def occupancy_change(occupied: DataFrame, smoothed: DataFrame, multinomial: DataFrame) -> DataFrame:
    """(origin, dest, slot, value): log1p of occupancy over the smoothed one a slot earlier, times the pair's probability."""
    ratio_ = occupied.join(smoothed.select("zone", (F.col("slot") + 1).alias("slot"), "value"), ["zone", "slot"])
    ratio_ = ratio_.select(F.col("zone").alias("origin"), "slot", F.try_divide(F.col("n").cast("double"), F.col("value")).alias("_r"))
    return multinomial.join(ratio_, ["origin", "slot"]).select("origin", "dest", "slot", F.log1p(F.col("_r") * F.col("p")).alias("value"))
