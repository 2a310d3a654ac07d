"""From one panel of many agents to each agent's detection verdict, and its seeded calibration.

Agents are partition keys throughout: all agents, repetitions and candidates run in the same
jobs. Steps that feed several others are checkpointed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.numeric import logit
from wayfold.operators import counts, detect, dglm, inject, kernel, probability, sequence
from wayfold.operators import repetitions as runs
from wayfold.session import kept

FEATURES = ["kernel_prob", "lag1", "lag2", "gate"]
GROUP_FEATURES = ["x", "crowd", "day", "weekday"]
#: Cells of a cube that are sent to all tasks at most (32 bytes each, hashed about three times that); beyond, a shuffle join.
BROADCAST_CELLS = 100_000


@dataclass(frozen=True)
class Setup:
    """Slots a day, the last training slot, the axis' length, and the methods' parameters."""

    per_day: int = 24
    slots: int = 720
    test_days: int = 7
    min_stay: int = 6
    min_taken: int = 5
    max_streak: int = 1000
    decay: float = 0.8
    gate_threshold: float = 18.0

    @property
    def end_of_training(self) -> int:
        return self.slots - self.test_days * self.per_day - 1


def group_cube(panel: DataFrame) -> DataFrame:
    """Full one-step transition cells of the whole population: shares of each origin and slot, with one move spread evenly over all zones.

    They count the slot's own moves: something to compare forecast_cube() with, not for features or verdicts.
    """
    zones = panel.select("zone").distinct()
    od = counts.od_counts(panel)
    share = (F.col("n") + F.lit(1.0 / max(1, zones.count()))) / (F.sum("n").over(Window.partitionBy("origin", "slot")) + 1)
    return probability.full_transition(od.withColumn("p", share).select("origin", "dest", "slot", "p"), zones)


def group_rows(panel: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """(origin, dest, rank, slot, y, n, x, crowd, day, weekday): rows of the group model, whose features at a slot know nothing of it.

    Pairs and ranks are those of the training slots, and x is smoothed for slots with n = 0 too, as
    n tells what earlier ranks took in the slot. crowd is the occupancy change of the slot before, as
    occupancy at a slot counts the slot's own moves.
    """
    pair = ["origin", "dest"]
    od = kept(counts.od_counts(panel))
    ranked = counts.od_ranked(od.filter(F.col("slot") <= setup.end_of_training))
    sizes = counts.cascade_sizes(od, ranked, counts.occupancy(panel), 1, setup.slots - 1)
    series = sizes.join(od, [*pair, "slot"], "left").select(*pair, "slot", F.coalesce("n", F.lit(0)).alias("y"), F.col("size").alias("n"))
    series = kept(series.join(ranked.select(*pair, "rank"), pair))
    smooth = kernel.binomial_forecast(series, pair, setup.per_day, 120, 240, every=True)
    own = kept(series.join(smooth, [*pair, "slot"]))
    return with_features(own, panel, setup, 1).drop("value")


def with_features(own: DataFrame, panel: DataFrame, setup: Setup, before: int) -> DataFrame:
    """own (origin, dest, rank, slot, value) and GROUP_FEATURES: the smoothed probability's logit, occupancy change `before` slots ago, day and weekday."""
    occupied = counts.dense(counts.occupancy(panel), ["zone"], 0, setup.slots - 1)
    smooth = kernel.count_forecast(occupied, ["zone"], setup.per_day, 120, 240)
    shares = probability.stick_to_multinomial(own.select("origin", "dest", "rank", "slot", F.col("value").alias("p")), ["origin"])
    crowd = probability.occupancy_change(occupied, smooth, shares).select("origin", "dest", (F.col("slot") + before).alias("slot"), F.col("value").alias("crowd"))
    made = own.join(crowd, ["origin", "dest", "slot"], "left").withColumn("crowd", F.coalesce("crowd", F.lit(0.0))).withColumn("x", logit(F.col("value")))
    day = (F.pmod("slot", F.lit(setup.per_day)) * 24 >= 11 * setup.per_day).cast("double")
    weekday = (F.pmod(F.floor(F.col("slot") / setup.per_day), F.lit(7)) < 5).cast("double")  # the axis begins on a Monday
    return made.withColumn("day", day).withColumn("weekday", weekday)


def forecast_cube(panel: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """Full one-step transition cells of the whole population: the group model's one-step-ahead forecasts, made multinomial and filled up.

    The last destination of an origin that has all zones takes what is left; an origin without a
    model has equal shares.
    """
    panel = kept(panel)
    zones = panel.select("zone").distinct()
    rows = kept(group_rows(panel, setup))
    sticks = dglm.group_models(rows, ["origin", "dest"], GROUP_FEATURES, setup.per_day).select("origin", "dest", "slot", F.col("p_hat").alias("p"))
    sure = F.col("rank") == zones.count()
    sticks = sticks.join(rows.select("origin", "dest", "slot", "rank"), ["origin", "dest", "slot"]).withColumn("p", F.when(sure, 1.0).otherwise(F.col("p")))
    made = probability.stick_to_multinomial(sticks, ["origin"]).select("origin", "dest", "slot", "p")
    bare = zones.select(F.col("zone").alias("origin")).join(rows.select("origin").distinct(), "origin", "left_anti")
    slots = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(setup.slots - 1).cast("long")))
    bare = bare.select("origin", F.col("origin").alias("dest"), slots.alias("slot"), F.lit(None).cast("double").alias("p"))
    return probability.full_transition(made.unionByName(bare), zones)


def asked_rows(panel: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """(agent, origin, dest, slot, y, rank, kind): valid pairs' asked cells."""
    types = sequence.classify_zones(panel.filter(F.col("slot") <= setup.end_of_training), ["agent"], setup.min_stay)
    return counts.asked_cells(counts.transitions(panel), setup.end_of_training, setup.min_taken, types)


def with_empirical(own: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """own with gate and kernel_prob, which know nothing of the slot's answer. Rows are dealt by agent once, for all steps."""
    pair = ["agent", "origin", "dest"]
    own = kept(own, dealt=True).repartition("agent")
    stays = sequence.signed_leave_gate(own.filter("kind = 'staying_to_self'").select(*pair, "slot", "y"), ["agent"], setup.decay, setup.gate_threshold)
    before = F.lag("gate").over(Window.partitionBy(*pair).orderBy("slot"))  # the gate of a slot must not know the slot's answer
    made = own.join(stays.select(*pair, "slot", before.alias("gate")), [*pair, "slot"], "left").withColumn("gate", F.coalesce("gate", F.lit(0.0)))
    smooth = kernel.empirical_probability(own.select(*pair, "kind", "slot", "y"), pair, setup.per_day).select(*pair, "slot", F.col("value").alias("kernel_prob"))
    return made.join(smooth, [*pair, "slot"], "left").withColumn("kernel_prob", F.coalesce("kernel_prob", F.lit(0.5)))


def numbered_rows(own: DataFrame, features: list[str], setup: Setup = Setup()) -> DataFrame:
    """xy_rows() of own's features and their frozen forms pm_...: after training, those of the last training day's slot."""
    end, pair = setup.end_of_training, ["agent", "origin", "dest"]
    last_day = (F.col("slot") > end - setup.per_day) & (F.col("slot") <= end)
    same = Window.partitionBy(*pair, "_s")  # a pair has one row a slot
    own = own.withColumn("_s", F.pmod("slot", F.lit(setup.per_day)))
    default = {"kernel_prob": 0.5, "lag1": 0.5, "lag2": 0.5, "gate": 0.0}
    frozen = {c: F.coalesce(F.max(F.when(last_day, F.col(c))).over(same), F.lit(default[c])) for c in features}
    own = own.select("*", *(F.when(F.col("slot") > end, x).otherwise(F.col(c)).alias(f"pm_{c}") for c, x in frozen.items()))
    own = own.withColumn("od", F.dense_rank().over(Window.partitionBy("agent", "kind").orderBy("origin", "dest")).cast("long"))
    names = [*features, *(f"pm_{c}" for c in features)]
    return counts.xy_rows(own, [*pair, "kind"], names, [c for c in names if not c.endswith("gate")], setup.max_streak)


def model_rows(panel: DataFrame, cube: DataFrame, setup: Setup = Setup()) -> tuple[DataFrame, DataFrame]:
    """(rows, cells): valid pairs' asked cells with kind, features and their frozen forms; and all cells of the indicator."""
    panel, cube = kept(panel), kept(cube)
    dealt = panel.repartition("agent")  # once, for all steps up to with_empirical()
    own, cells = asked_rows(dealt, setup), counts.indicator(counts.transitions(panel))
    for k, steps in probability.multistep(cube, 2).items():
        steps = kept(steps) if k > 1 else steps
        steps = F.broadcast(steps) if steps.count() <= BROADCAST_CELLS else steps
        own = probability.kstep_feature(own, dealt, steps, k).withColumnRenamed("feature", f"lag{k}")
    for k in (1, 2):
        own = probability.multinomial_to_cascade(own, ["agent", "origin"], f"lag{k}")
    return kept(numbered_rows(with_empirical(own, setup), FEATURES, setup), dealt=True), cells


def forecasts(rows: DataFrame, setup: Setup = Setup(), bare: bool = False) -> DataFrame:
    """(agent, kind, origin, dest, slot, y, p_pm, p_oam, t) of every model row; bare: without t. Models take a row's pair along."""
    frozen = [f"pm_{c}" for c in FEATURES]
    return dglm.oam_and_pm(rows, ["agent", "kind"], frozen, FEATURES, setup.end_of_training, carried=("origin", "dest"), bare=bare).drop("od")


def assembled(cells: DataFrame, made: DataFrame, cube: DataFrame, column: str) -> DataFrame:
    """(agent, origin, dest, slot, p): forecasts carried forward, made multinomial, rare and unmodelled pairs filled in."""
    pair = ["agent", "origin", "dest"]
    modelled = made.select(*pair).distinct()
    grid = cells.join(modelled, pair, "left_semi")
    filled = probability.filled_forward(grid, made.select(*pair, "slot", F.col(column).alias("p")), pair)
    ranked = filled.join(grid.select(*pair, "slot", "rank"), [*pair, "slot"])
    rare = cells.select(*pair).distinct().join(modelled, pair, "left_anti")
    whole = probability.with_rare(ranked, rare, ["agent"])
    return probability.append_unmodelled(whole, cells.select(*pair, "slot"), cube, ["agent"], 1 << 30)


def by_move(cells: DataFrame, made: DataFrame, cube: DataFrame, first_slot: int) -> DataFrame:
    """(agent, origin, slot, p_pm, p_oam, real_dest, best): what verdicts take of both assembled() tables, a row a move.

    p_pm and p_oam are those of the move made; best (dest, p) is p_oam's likeliest destination from
    first_slot on, ties to the smaller number. Cells are dealt by agent and sorted once by pair and
    once by origin and slot; there is no table of all cells.
    """
    pair, here, names = ["agent", "origin", "dest"], ["agent", "origin", "slot"], ["p_pm", "p_oam"]
    known = made.select(*pair, "slot", *names, F.lit(True).alias("_in")).repartition("agent")
    by_pair = Window.partitionBy(*pair).orderBy("slot")
    up_to, whole = by_pair.rowsBetween(Window.unboundedPreceding, 0), by_pair.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = cells.join(known, [*pair, "slot"], "left")
    own = own.select(*pair, "slot", "y", "rank", *(F.last(c, ignorenulls=True).over(up_to).alias(c) for c in names), F.coalesce(F.max("_in").over(whole), F.lit(False)).alias("_in"))
    ranked = Window.partitionBy(*here).orderBy("rank")
    before, all_ = ranked.rowsBetween(Window.unboundedPreceding, -1), ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    modelled = F.col("_in")
    for c in names:
        left = F.coalesce(F.product(F.when(modelled, 1 - F.col(c))).over(before), F.lit(1.0))
        unknown = F.coalesce(F.max(modelled & F.col(c).isNull()).over(before), F.lit(False))
        own = own.withColumn(f"_k_{c}", left).withColumn(f"_x_{c}", unknown)
    own = own.withColumns({c: F.when(modelled & ~F.col(f"_x_{c}"), F.col(c) * F.col(f"_k_{c}")) for c in names})
    own = own.withColumn("_all", F.count_if(modelled).over(all_)).withColumn("_rare", F.count_if(~modelled).over(all_))
    own = own.withColumns({f"_{f}_{c}": x.over(all_) for c in names for f, x in (("sum", F.sum(c)), ("have", F.count(c)))})
    group = cube.select("origin", "dest", "slot", F.col("p").alias("_p"))
    group = F.broadcast(group) if group.count() <= BROADCAST_CELLS else group
    own = own.join(group, ["origin", "dest", "slot"], "left")
    for c in names:
        rest = F.when(F.col(f"_have_{c}") == F.col("_all"), (1 - F.col(f"_sum_{c}")) / F.col("_rare"))
        own = own.withColumn(c, F.when(modelled, F.col(c)).when(F.col("_all") > 0, rest).otherwise(F.col("_p")))
    taken = F.col("y") == 1
    best = F.max_by(F.struct("dest", F.col("p_oam").alias("p")), F.when((F.col("slot") >= first_slot) & F.col("p_oam").isNotNull(), F.struct(F.col("p_oam"), (-F.col("dest")).alias("_d"))))
    return own.groupBy(*here).agg(*(F.max(F.when(taken, F.col(c))).alias(c) for c in names), F.max(F.when(taken, F.col("dest"))).alias("real_dest"), best.alias("best"))


def verdicts(panel: DataFrame, cube: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """(agent, log_l, run_len, accuracy, move_accuracy): the factor at the end of the axis, and path accuracy in the test window."""
    panel, cube = kept(panel), kept(cube)
    rows, cells = model_rows(panel, cube, setup)
    moves = kept(by_move(cells, forecasts(rows, setup, bare=True), cube, setup.end_of_training + 1), dealt=True)
    steps = moves.select("agent", "slot", detect.log_factor(F.col("p_pm"), F.col("p_oam")).alias("h"))
    factors = detect.cumulative_bayes_factor(steps, ["agent"])
    last = factors.groupBy("agent").agg(F.max_by(F.struct("log_l", "run_len"), F.col("slot")).alias("_l")).select("agent", "_l.log_l", "_l.run_len")
    best = moves.filter("best is not null").select("agent", "origin", "best.dest", "real_dest")
    return last.join(detect.accuracies(best, ["agent"]).select("agent", "accuracy", "move_accuracy"), "agent", "left")


def calibrated(panel: DataFrame, cube: DataFrame, setup: Setup = Setup(), repetitions: int = 50, max_fpr: float = 0.1, seed: int = 0, **injection) -> tuple[DataFrame, DataFrame]:
    """(scores, thresholds): regular and injected verdicts of each repetition, and each agent's threshold of most recall.

    Repetitions but the first swap validation days with earlier ones. A repetition whose injection
    fails has no scores. Each agent's repetitions are made where its panel is; by_verdicts() serves
    what that does not take: cubes of many cells, days with gaps, other options of the injection.
    """
    panel, cube = kept(panel), kept(cube)
    plain = set(injection) <= {"threshold", "tries", "min_stay", "max_shift"} and setup.slots % setup.per_day == 0 and setup.max_streak >= setup.slots
    plain = plain and cube.count() <= BROADCAST_CELLS and not _uneven(panel, setup)
    scores = kept((by_agent if plain else by_verdicts)(panel, cube, setup, repetitions, seed, **injection))
    curves = detect.threshold_curves(scores.select("agent", "score", "positive"), ["agent"])
    return scores, detect.threshold_by_recall(curves, ["agent"], max_fpr)


def _uneven(panel: DataFrame, setup: Setup) -> bool:
    """Whether the panel has nulls, slots beside the axis, or a day without some slot after its first."""
    day = F.floor(F.col("slot") / setup.per_day).cast("long")
    days = panel.groupBy("agent", day.alias("day")).agg(F.min("slot").alias("_a"), F.max("slot").alias("_b"), F.count(F.lit(1)).alias("_n"), F.count("zone").alias("_z"))
    whole = (F.col("_b") % setup.per_day == setup.per_day - 1) & (F.col("_b") - F.col("_a") + 1 == F.col("_n")) & (F.col("_z") == F.col("_n")) & (F.col("_a") >= 0) & (F.col("_b") < setup.slots)
    return not days.filter(~F.coalesce(whole & F.col("agent").isNotNull(), F.lit(False))).isEmpty()


def by_agent(panel: DataFrame, cube: DataFrame, setup: Setup, repetitions: int, seed: int, **injection) -> DataFrame:
    """by_verdicts() with all repetitions of an agent made in one task, which gets its zones and the cube's cells (BROADCAST_CELLS at most)."""
    cells = cube.select("origin", "dest", "slot", "p").toArrow().to_pandas()
    zones = np.unique(np.concatenate((cells["origin"], cells["dest"], [r["zone"] for r in panel.select("zone").distinct().collect()])))
    table = np.full((setup.slots, len(zones), len(zones)), np.nan)
    cells = cells[(cells["slot"] >= 0) & (cells["slot"] < setup.slots)]
    table[cells["slot"], np.searchsorted(zones, cells["origin"]), np.searchsorted(zones, cells["dest"])] = cells["p"]
    how = runs.Injection(**injection)

    def fit(frames: list[pd.DataFrame]) -> list[pd.DataFrame]:
        own = np.full((len(frames), setup.slots), -1, np.int16)
        for i, frame in enumerate(frames):
            own[i, frame["slot"]] = np.searchsorted(zones, frame["zone"])
        made = runs.scores([int(f["agent"].iloc[0]) for f in frames], own, table, setup, how, repetitions, seed)
        return [pd.DataFrame(made, columns=["agent", "rep", "positive", "score"])]

    context = panel.sparkSession.sparkContext
    tasks = max(4 * context.defaultParallelism, int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dglm.by_series(panel.select("agent", "slot", "zone"), ["agent"], ["slot"], "agent long, rep long, positive boolean, score double", lambda f: fit(f), tasks)


def by_verdicts(panel: DataFrame, cube: DataFrame, setup: Setup, repetitions: int, seed: int, **injection) -> DataFrame:
    """(agent, rep, positive, score): the (agent, repetition, injected) runs are agents of one panel, so all go through verdicts() together."""
    window = setup.test_days * setup.per_day
    first, last = setup.slots - window, setup.slots
    numbered = panel.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))))
    keys = ["agent", "rep"]
    swaps = inject.day_swaps(numbered, keys, setup.per_day, first, last, seed).filter("rep > 0")
    regular = inject.swapped(numbered.select(*keys, "slot", "zone"), swaps, keys, setup.per_day)
    changed, log = inject.inject_until(regular, keys, setup.per_day, first, last, seed=seed, **injection)
    good = log.filter("success").select(*keys)
    both = regular.withColumn("kind", F.lit(0)).unionByName(changed.withColumn("kind", F.lit(1))).join(good, keys, "left_semi")
    number = (F.col("agent") * repetitions + F.col("rep")) * 2 + F.col("kind")
    made = verdicts(kept(both.select(number.alias("agent"), "slot", "zone")), cube, setup)
    return made.select(F.floor(F.col("agent") / (2 * repetitions)).cast("long").alias("agent"), F.pmod(F.floor(F.col("agent") / 2), F.lit(repetitions)).cast("long").alias("rep"), (F.pmod("agent", F.lit(2)) == 1).alias("positive"), F.col("log_l").alias("score"))


def result_table(made: DataFrame, thresholds: DataFrame) -> DataFrame:
    """verdicts() with each agent's threshold (null without one) and whether its factor is at or below it: files.write_results() keeps such tables."""
    own = made.join(thresholds.select("agent", "tau", "recall", "fpr"), "agent", "left")
    return own.withColumn("flagged", F.coalesce(F.col("log_l") <= F.col("tau"), F.lit(False)))
