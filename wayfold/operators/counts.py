"""Origin-destination counts, occupancy, cascades and indicators on long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.numeric import logit, ratio


def transitions(panel: DataFrame, lag: int = 1, include_self: bool = True) -> DataFrame:
    """(agent, slot, origin, dest): each agent's move into slot, over lag slots of a gapless panel."""
    moved = panel.select("agent", "slot", F.lag("zone", lag).over(Window.partitionBy("agent").orderBy("slot")).alias("origin"), F.col("zone").alias("dest"))
    moved = moved.filter("origin is not null")
    return moved if include_self else moved.filter("origin != dest")


def od_counts(panel: DataFrame, lag: int = 1, include_self: bool = True) -> DataFrame:
    """(origin, dest, slot, n): agents that move from origin to dest into slot."""
    return transitions(panel, lag, include_self).groupBy("origin", "dest", "slot").agg(F.count(F.lit(1)).alias("n"))


def od_ranked(counts: DataFrame) -> DataFrame:
    """(origin, dest, total, first_slot, rank): destinations of each origin by total, then first slot, then number."""
    own = counts.groupBy("origin", "dest").agg(F.sum("n").alias("total"), F.min("slot").alias("first_slot"))
    rank = F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("total"), "first_slot", "dest"))
    return own.withColumn("rank", rank.cast("long"))


def occupancy(panel: DataFrame) -> DataFrame:
    """(zone, slot, n): agents in each zone and slot; empty cells are absent."""
    return panel.groupBy("zone", "slot").agg(F.count(F.lit(1)).alias("n"))


def dense(cells: DataFrame, keys: list[str], first: int, last: int, value: str = "n") -> DataFrame:
    """cells with a row for every slot from first to last of each key, value 0 where there was none."""
    grid = cells.select(*keys).distinct().withColumn("slot", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    return grid.join(cells, [*keys, "slot"], "left").select(*keys, "slot", F.coalesce(value, F.lit(0)).cast("long").alias(value))


def cascade_sizes(counts: DataFrame, ranked: DataFrame, occupied: DataFrame, first: int, last: int) -> DataFrame:
    """(origin, dest, slot, size): agents of the origin a slot earlier that no earlier-ranked destination took, 0 at least.

    Pairs are those of ranked, so a prefix of each origin's ranks (prefix_pairs) keeps the grid small.
    """
    pairs = ranked.select("origin", "dest", "rank")
    grid = dense(counts.join(pairs, ["origin", "dest"], "left_semi"), ["origin", "dest"], first, last).join(pairs, ["origin", "dest"])
    earlier = F.sum("n").over(Window.partitionBy("origin", "slot").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    taken = grid.withColumn("_e", F.coalesce(earlier, F.lit(0)))
    before = occupied.select(F.col("zone").alias("origin"), (F.col("slot") + 1).alias("slot"), F.col("n").alias("_occ"))
    own = taken.join(before, ["origin", "slot"], "left")
    return own.select("origin", "dest", "slot", F.greatest(F.lit(0), F.coalesce("_occ", F.lit(0)) - F.col("_e")).cast("long").alias("size"))


def prefix_pairs(ranked: DataFrame, occupied: DataFrame, threshold: float = 0.99) -> DataFrame:
    """(origin, dest, rank, cum_frac): each origin's destinations up to the first that covers threshold of its occupancy.

    Origins with fewer than two destinations, or that never reach it, stay whole; occupancy 0 counts as 1.
    """
    total = occupied.groupBy(F.col("zone").alias("origin")).agg(F.sum("n").alias("_occ"))
    w = Window.partitionBy("origin")
    up_to = F.sum("total").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    own = ranked.join(total, "origin", "left").withColumn("_d", F.greatest(F.coalesce("_occ", F.lit(0)), F.lit(1)))
    own = own.withColumn("cum_frac", up_to / F.col("_d")).withColumn("_before", (up_to - F.col("total")) / F.col("_d")).withColumn("_k", F.count(F.lit(1)).over(w))
    return own.filter((F.col("_k") < 2) | (F.col("_before") < threshold)).select("origin", "dest", "rank", "cum_frac")


def conservation(counts: DataFrame, occupied: DataFrame) -> DataFrame:
    """(origin, slot, diff): moves out of an origin into slot less its occupancy a slot earlier."""
    out = counts.groupBy("origin", "slot").agg(F.sum("n").alias("_out"))
    before = occupied.select(F.col("zone").alias("origin"), (F.col("slot") + 1).alias("slot"), "n")
    return out.join(before, ["origin", "slot"], "left").select("origin", "slot", (F.col("_out") - F.coalesce("n", F.lit(0))).alias("diff"))


def pooled_probability(counts: DataFrame, ignore_zone: int | None = None, include_self: bool = True) -> DataFrame:
    """(origin, dest, p): shares of each origin's moves over all slots; pairs that touch ignore_zone are left out."""
    own = counts if ignore_zone is None else counts.filter((F.col("origin") != ignore_zone) & (F.col("dest") != ignore_zone))
    own = own if include_self else own.filter("origin != dest")
    total = own.groupBy("origin", "dest").agg(F.sum("n").alias("n"))
    return total.select("origin", "dest", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("origin"))).alias("p"))


def agent_prefix_pairs(moves: DataFrame, min_origin: int = 2, mass: float = 0.95) -> DataFrame:
    """(agent, origin, dest, total, rank): per agent, the smallest ranked prefix of an origin's moves with the mass.

    Self moves are out, and origins with fewer than min_origin moves.
    """
    total = moves.filter("origin != dest").groupBy("agent", "origin", "dest").agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("agent", "origin")
    o = w.orderBy(F.desc("total"), "dest")
    own = total.withColumn("_all", F.sum("total").over(w)).withColumn("rank", F.row_number().over(o).cast("long"))
    own = own.withColumn("_before", F.sum("total").over(o.rowsBetween(Window.unboundedPreceding, 0)) - F.col("total"))
    return own.filter((F.col("_all") >= min_origin) & (F.col("_before") < mass * F.col("_all"))).select("agent", "origin", "dest", "total", "rank")


def indicator(moves: DataFrame) -> DataFrame:
    """(agent, origin, dest, slot, y, rank): 1 for the move made, 0 for the agent's other destinations of that origin.

    rank orders an origin's destinations by first use; a pair whose origin the agent isn't at has no row.
    """
    pairs = moves.groupBy("agent", "origin", "dest").agg(F.min("slot").alias("_first"))
    rank = F.row_number().over(Window.partitionBy("agent", "origin").orderBy("_first"))
    pairs = pairs.select("agent", "origin", F.col("dest").alias("_d"), rank.cast("long").alias("rank"))
    own = moves.join(pairs, ["agent", "origin"])
    return own.select("agent", "origin", F.col("_d").alias("dest"), "slot", (F.col("dest") == F.col("_d")).cast("int").alias("y"), "rank")


def onehot_to_cascade(cells: DataFrame) -> DataFrame:
    """cells of an indicator up to the rank of the move made: later ones are never asked."""
    chosen = F.max(F.when(F.col("y") == 1, F.col("rank"))).over(Window.partitionBy("agent", "origin", "slot"))
    return cells.withColumn("_r", chosen).filter(F.col("_r").isNull() | (F.col("rank") <= F.col("_r"))).drop("_r")


def asked_cells(moves: DataFrame, end_of_training: int, threshold: int, classified: DataFrame) -> DataFrame:
    """(agent, origin, dest, slot, y, rank, kind): onehot_to_cascade() of the moves' indicator(), of the valid_pairs() that have a kind only.

    Each move meets its origin's pairs in one row, and only its asked cells are made. All steps are dealt by agent.
    """
    taken = F.count_if(F.col("slot") < end_of_training)
    pairs = moves.groupBy("agent", "origin", "dest").agg(F.min("slot").alias("_first"), taken.alias("n"))
    rank = F.row_number().over(Window.partitionBy("agent", "origin").orderBy("_first")).cast("long")
    pairs = pairs.select("agent", "origin", "dest", rank.alias("rank"), (F.col("n") > threshold).alias("valid"))
    known = by_zone_type(pairs, classified).withColumn("kind", F.when(F.col("valid"), F.col("kind")))
    origins = known.groupBy("agent", "origin").agg(F.collect_list(F.struct("dest", "rank", "kind")).alias("_all")).filter(F.exists("_all", lambda x: x["kind"].isNotNull()))
    own = moves.join(origins, ["agent", "origin"])
    made = F.filter("_all", lambda x: x["dest"] == F.col("dest"))[0]["rank"]
    own = own.withColumn("_made", made)
    own = own.select("agent", "origin", F.col("dest").alias("_to"), "slot", F.explode(F.filter("_all", lambda x: x["kind"].isNotNull() & (x["rank"] <= F.col("_made")))).alias("_x"))
    return own.select("agent", "origin", "_x.dest", "slot", (F.col("_to") == F.col("_x.dest")).cast("int").alias("y"), "_x.rank", "_x.kind")


def valid_pairs(cells: DataFrame, end_of_training: int, threshold: int = 10) -> DataFrame:
    """(agent, origin, dest, n, valid): valid if the pair was taken more than threshold times before end_of_training."""
    n = F.coalesce(F.sum(F.when(F.col("slot") < end_of_training, F.col("y"))), F.lit(0))
    return cells.groupBy("agent", "origin", "dest").agg(n.alias("n")).withColumn("valid", F.col("n") > threshold)


def by_zone_type(pairs: DataFrame, classified: DataFrame) -> DataFrame:
    """pairs and kind: staying_to_self, staying_to_other or passing_to_any; origins of no known type are left out."""
    types = classified.select("agent", F.col("zone").alias("origin"), "staying")
    kind = F.when(~F.col("staying"), "passing_to_any").when(F.col("origin") == F.col("dest"), "staying_to_self").otherwise("staying_to_other")
    return pairs.join(types, ["agent", "origin"]).withColumn("kind", kind).drop("staying")


def frozen(cells: DataFrame, per_day: int, days: int, end: int) -> DataFrame:
    """Cells for the days from slot end on: the last day before end, over and over."""
    last = cells.filter((F.col("slot") >= end - per_day) & (F.col("slot") < end))
    return last.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(days)))).withColumn("slot", (F.col("slot") + F.col("_k") * per_day).cast("long")).drop("_k")


def recoded(panel: DataFrame, mapping: DataFrame, staying: DataFrame | None = None) -> DataFrame:
    """(agent, slot, cluster): mapping(zone, cluster_id) applied; unmapped zones keep their number, zones not in staying(zone) become -1."""
    own = panel.join(mapping.select("zone", "cluster_id"), "zone", "left").withColumn("cluster", F.coalesce("cluster_id", "zone"))
    if staying is not None:
        known = staying.select("zone").distinct().withColumn("_s", F.lit(True))
        own = own.join(known, "zone", "left").withColumn("cluster", F.when(F.col("_s"), F.col("cluster")).otherwise(-1))
    return own.select("agent", "slot", F.col("cluster").cast("long").alias("cluster"))


def by_mean_probability(counts: DataFrame, occupied: DataFrame, slots: int, floor: float = 0.1) -> DataFrame:
    """(origin, dest, mean_p, rank): destinations by the mean over all slots of n / occupancy; occupancy 0 counts as floor."""
    before = occupied.select(F.col("zone").alias("origin"), (F.col("slot") + 1).alias("slot"), F.col("n").alias("_occ"))
    share = F.col("n") / F.coalesce(F.col("_occ").cast("double"), F.lit(floor))
    own = counts.join(before, ["origin", "slot"], "left").groupBy("origin", "dest").agg((F.sum(share) / slots).alias("mean_p"))
    rank = F.row_number().over(Window.partitionBy("origin").orderBy(F.desc(F.round("mean_p", 9)), "dest"))
    return own.withColumn("rank", rank.cast("long"))


def share_prefix(occupied: DataFrame, clusters: DataFrame, most: float = 0.98) -> DataFrame:
    """(cluster_id, zone, share, cum): a cluster's zones by mean share of its occupancy, until the sum is over most."""
    own = occupied.join(clusters.select("zone", "cluster_id"), "zone").groupBy("cluster_id", "zone").agg(F.sum("n").alias("_n"))
    w = Window.partitionBy("cluster_id")
    o = w.orderBy(F.desc("_n"), "zone").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_all", F.sum("_n").over(w)).withColumn("_cum", F.sum("_n").over(o))
    return own.filter((F.col("_cum") - F.col("_n")) / F.col("_all") <= most).select("cluster_id", "zone", (F.col("_n") / F.col("_all")).alias("share"), (F.col("_cum") / F.col("_all")).alias("cum"))


def xy_rows(cells: DataFrame, keys: list[str], features: list[str], logit_features: list[str], max_streak: int, bound: float = 10.0) -> DataFrame:
    """Model rows of an indicator: features (logits clipped), streaks pruned, and weight by the running mean of y.

    cells has keys, od (the pair's number), slot, y and features. The running mean is over all
    kept rows of the keys in the order of (slot, od); weight is that of the row before, null
    where the mean was 0 or there is none.
    """
    from wayfold.operators.sequence import drop_beyond_streak

    own = cells.select(*keys, "od", "slot", "y", *[logit(F.col(c), bound=bound).alias(c) if c in logit_features else F.col(c) for c in features])
    kept = drop_beyond_streak(own, [*keys, "od"], ["slot"], max_streak)
    w = Window.partitionBy(*keys).orderBy("slot", "od")
    mean = F.avg(F.col("y").cast("double")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("_m", mean).withColumn("weight", ratio(1 - F.col("_m"), F.col("_m"))).drop("_m")
