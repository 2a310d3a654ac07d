"""Bayes-factor monitoring, predictions and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.numeric import ratio


def step_log_factor(moves: DataFrame, p_null: DataFrame, p_open: DataFrame, keys: list[str], floor: float = 1e-12) -> DataFrame:
    """(keys, slot, h): ln p_null - ln p_open of the pair that was really taken; 0 where either is missing.

    Missing values would otherwise stop or reset the running factor; probabilities under floor count as floor.
    A table of probabilities without some of the keys, or without slot, holds for all of them.
    """
    names = [*keys, "origin", "dest", "slot"]
    own = moves.select(*names)
    for table, name in ((p_null, "_n"), (p_open, "_o")):
        on = [c for c in names if c in table.columns]
        own = own.join(table.select(*on, F.col("p").alias(name)), on, "left")
    return own.select(*keys, "slot", log_factor(F.col("_n"), F.col("_o"), floor).alias("h"))


def log_factor(null: Column, open_: Column, floor: float = 1e-12) -> Column:
    """ln null - ln open_, both floor at least; 0 where either is missing."""
    h = F.ln(F.greatest(null, F.lit(floor))) - F.ln(F.greatest(open_, F.lit(floor)))
    return F.when(null.isNotNull() & open_.isNotNull(), h).otherwise(0.0)


def cumulative_bayes_factor(steps: DataFrame, keys: list[str]) -> DataFrame:
    """steps (keys, slot, h) with log_l and run_len, where log_l = h + min(0, log_l before) and runs grow while log_l is below 0.

    Closed form: with running sums S, log_l = S - max(0, earlier S), and the run counts from the
    latest row that attains this maximum. Two windows, no loop.
    """
    w = Window.partitionBy(*keys).orderBy("slot")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    own = steps.withColumn("_s", F.sum("h").over(upto)).withColumn("_t", F.row_number().over(w))
    top = F.max(F.struct(F.col("_s"), F.col("_t"))).over(before)
    own = own.withColumn("_top", top)
    reset = F.col("_top").isNull() | (F.col("_top._s") < 0)
    base, at = F.when(reset, 0.0).otherwise(F.col("_top._s")), F.when(reset, 0).otherwise(F.col("_top._t"))
    return own.withColumn("log_l", F.col("_s") - base).withColumn("run_len", (F.col("_t") - at).cast("long")).drop("_s", "_t", "_top")


def argmax_destination(probabilities: DataFrame, moves: DataFrame, keys: list[str], first_slot: int = 0) -> DataFrame:
    """(keys, slot, origin, dest, p, real_dest): the likeliest destination from where the agent is; ties to the smaller number.

    It is found once for an origin and slot, and for each of the keys that probabilities has; then the moves are joined.
    """
    on = [c for c in [*keys, "origin", "slot"] if c in probabilities.columns]
    best = F.max_by(F.struct("dest", "p"), F.struct(F.col("p"), (-F.col("dest")).alias("_d")))
    likeliest = probabilities.filter("p is not null").filter(F.col("slot") >= first_slot).groupBy(*on).agg(best.alias("_b"))
    own = moves.filter(F.col("slot") >= first_slot).select(*keys, "origin", "slot", F.col("dest").alias("real_dest")).join(likeliest, on)
    return own.select(*keys, "slot", "origin", F.col("_b.dest").alias("dest"), F.col("_b.p").alias("p"), "real_dest")


def accuracies(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, accuracy, moves, move_accuracy): overall, and where the agent really moved."""
    hit, moved = (F.col("dest") == F.col("real_dest")).cast("double"), F.col("origin") != F.col("real_dest")
    own = predicted.groupBy(*keys) if keys else predicted.groupBy()
    return own.agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.count_if(moved).alias("moves"), F.avg(F.when(moved, hit)).alias("move_accuracy"))


def binary_summary(forecasts: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Confusion counts and scores of p_hat >= threshold against y; scores with nothing to divide by are 0."""
    hit, y = F.col("p_hat") >= threshold, F.col("y") == 1
    grouped = forecasts.groupBy(*keys) if keys else forecasts.groupBy()
    own = grouped.agg(F.count_if(~hit & ~y).alias("tn"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(hit & y).alias("tp"))

    def share(a, b):
        return F.coalesce(ratio(a, b), F.lit(0.0))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    own = own.withColumn("accuracy", share(tn + tp, tn + fp + fn + tp)).withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn))
    own = own.withColumn("f1", share(2 * tp, 2 * tp + fp + fn))
    sides = F.array_compact(F.array(ratio(tp, tp + fn), ratio(tn, tn + fp)))
    own = own.withColumn("balanced_accuracy", share(F.aggregate(sides, F.lit(0.0), lambda a, x: a + x), F.size(sides)))
    spread = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return own.withColumn("mcc", share(tp.cast("double") * tn - fp.cast("double") * fn, spread))


def threshold_curves(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tau, tp, fp, n_pos, n_neg, precision, recall, fpr, accuracy): a row for each distinct score and for both infinities.

    scores (keys, score, positive); a score of tau or less counts as positive. Counts are running
    sums over distinct scores, not a comparison of each with each.
    """
    own = scores.groupBy(*keys, "score").agg(F.count_if("positive").alias("_p"), F.count_if(~F.col("positive")).alias("_n"))
    w = Window.partitionBy(*keys)
    o = w.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    sums = own.select(*keys, F.col("score").cast("double").alias("tau"), F.sum("_p").over(o).alias("tp"), F.sum("_n").over(o).alias("fp"), F.sum("_p").over(w).alias("_P"), F.sum("_n").over(w).alias("_N"))
    totals = sums.select(*keys, "_P", "_N").distinct()
    ends = [totals.select(*keys, F.lit(tau).alias("tau"), tp.alias("tp"), fp.alias("fp"), "_P", "_N") for tau, tp, fp in ((float("inf"), F.col("_P"), F.col("_N")), (float("-inf"), F.lit(0).cast("long"), F.lit(0).cast("long")))]
    full = sums.unionByName(ends[0]).unionByName(ends[1])

    def share(a, b):
        return F.coalesce(ratio(a, b), F.lit(0.0))

    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "_P", "_N"))
    return full.select(*keys, "tau", "tp", "fp", p.alias("n_pos"), n.alias("n_neg"), share(tp, tp + fp).alias("precision"), share(tp, p).alias("recall"), share(fp, n).alias("fpr"), share(tp + n - fp, p + n).alias("accuracy"))


def _best(curves: DataFrame, keys: list[str], max_fpr: float | None, order: list) -> DataFrame:
    """The first row under the cap, or where none is the one with least fpr; feasible tells which."""
    own = curves.withColumn("feasible", F.lit(True) if max_fpr is None else F.col("fpr") <= max_fpr)
    within = [F.desc("feasible"), F.when(~F.col("feasible"), F.col("fpr")), *order]
    return own.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*within))).filter("_r = 1").drop("_r")


def threshold_by_fbeta(curves: DataFrame, keys: list[str], max_fpr: float | None = None, beta: float = 0.5) -> DataFrame:
    """The row of the largest F-beta with fpr up to max_fpr, and feasible; ties to the larger tau."""
    b2 = beta * beta
    score = F.coalesce(ratio((1 + b2) * F.col("precision") * F.col("recall"), b2 * F.col("precision") + F.col("recall")), F.lit(0.0))
    return _best(curves.withColumn("fbeta", score), keys, max_fpr, [F.desc(F.round("fbeta", 12)), F.desc("tau")])


def threshold_by_recall(curves: DataFrame, keys: list[str], max_fpr: float | None = 0.1) -> DataFrame:
    """The row of the largest recall with fpr up to max_fpr, and feasible; ties to the lower fpr, the higher precision, the larger tau."""
    return _best(curves, keys, max_fpr, [F.desc(F.round("recall", 12)), F.round("fpr", 12), F.desc(F.round("precision", 12)), F.desc("tau")])


def changed_share(new: DataFrame, old: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """(keys, changed): share of slots in [first, last) whose zone differs; slots that only one has count as changed."""
    a = new.filter(F.col("slot").between(first, last - 1)).select(*keys, "slot", F.col("zone").alias("_a"))
    b = old.filter(F.col("slot").between(first, last - 1)).select(*keys, "slot", F.col("zone").alias("_b"))
    both = a.join(b, [*keys, "slot"], "full_outer")
    return both.groupBy(*keys).agg(F.avg((~F.col("_a").eqNullSafe(F.col("_b"))).cast("double")).alias("changed"))


def capture_ratio(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(moves, kept, ratio): moves between fine zones, and those of them that are moves between coarse zones too."""
    own = fine.filter("origin != dest").select("agent", "slot").join(coarse.select("agent", "slot", "origin", "dest"), ["agent", "slot"])
    kept = F.count_if(F.col("origin") != F.col("dest"))
    return own.agg(F.count(F.lit(1)).alias("moves"), kept.alias("kept"), ratio(kept, F.count(F.lit(1))).alias("ratio"))
