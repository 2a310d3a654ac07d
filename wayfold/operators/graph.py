"""Zone proximity graphs, components and capacity-bound clusters.

Pairs and components are DataFrame plans. The greedy steps are sequential by nature; each runs
over one component (or over the zone dimension, whose size the grid bounds) in numpy, with
ties broken by the smallest zone number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geo import EARTH_RADIUS_M, haversine_m
from wayfold.session import ensure_checkpoint

#: Metres in a degree of latitude.
DEGREE_M = EARTH_RADIUS_M * np.pi / 180


def radius_edges(zones: DataFrame, radius_m: float, self_loops: bool = False) -> DataFrame:
    """(src, dst, dist_m): ordered pairs of zones(zone, lat, lon) within radius_m.

    A range join as an equi-join: cells at least radius_m wide in both directions, each point
    met with its own and the eight neighbouring cells, then filtered by true distance.
    """
    top = zones.agg(F.max(F.abs("lat")).alias("_top"))
    high = F.least(F.lit(89.0), F.col("_top"))
    own = zones.select("zone", "lat", "lon").join(F.broadcast(top)).withColumn("_r", F.floor(F.col("lat") / F.lit(radius_m / DEGREE_M)))
    own = own.withColumn("_c", F.floor(F.col("lon") * F.cos(F.radians(high)) / F.lit(radius_m / DEGREE_M))).drop("_top")
    steps = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    near = own.select(F.col("zone").alias("src"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"), "_r", "_c", F.explode(steps).alias("_dr"))
    near = near.select("src", "_la", "_lo", (F.col("_r") + F.col("_dr")).alias("_r"), "_c", F.explode(steps).alias("_dc"))
    near = near.select("src", "_la", "_lo", "_r", (F.col("_c") + F.col("_dc")).alias("_c"))
    met = near.join(own.withColumnRenamed("zone", "dst"), ["_r", "_c"])
    out = met.select("src", "dst", haversine_m(F.col("_la"), F.col("_lo"), F.col("lat"), F.col("lon")).alias("dist_m")).filter(F.col("dist_m") <= radius_m)
    return out if self_loops else out.filter("src != dst")


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(zone, label): least zone of each connected component; edges(src, dst) hold both directions.

    Least-label propagation with label jumping, written to the checkpoint folder every round.
    """
    spark = nodes.sparkSession
    ensure_checkpoint(spark)
    links = edges.select("src", "dst").checkpoint()
    labels = nodes.select("zone", F.col("zone").alias("label")).checkpoint()
    for _ in range(most_rounds):
        told = links.join(labels, F.col("dst") == F.col("zone")).groupBy(F.col("src").alias("zone")).agg(F.min("label").alias("_m"))
        new = labels.join(told, "zone", "left").select("zone", F.least("label", F.coalesce("_m", "label")).alias("_l"))
        jump = labels.select(F.col("zone").alias("_l"), F.col("label").alias("_j"))
        new = new.join(jump, "_l", "left").select("zone", F.least("_l", F.coalesce("_j", "_l")).alias("label")).checkpoint()
        if not new.join(labels.withColumnRenamed("label", "_b"), "zone").filter("label != _b").limit(1).count():
            return new
        labels = new
    raise RuntimeError("components did not settle")


def distance_matrix(zones: DataFrame) -> DataFrame:
    """(src, dst, dist_m) for all pairs of a zone dimension (the grid bounds it); the right side is broadcast."""
    other = zones.select(F.col("zone").alias("dst"), F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    packed = other.agg(F.collect_list(F.struct("dst", "_la", "_lo")).alias("_all"))
    own = zones.select(F.col("zone").alias("src"), "lat", "lon").withColumn("_one", F.lit(1)).join(F.broadcast(packed.withColumn("_one", F.lit(1))), "_one")
    pairs = own.select("src", "lat", "lon", F.explode("_all").alias("_x"))
    return pairs.select("src", F.col("_x.dst").alias("dst"), haversine_m(F.col("lat"), F.col("lon"), F.col("_x._la"), F.col("_x._lo")).alias("dist_m"))


def capped_components(labels: DataFrame, edges: DataFrame, most: int = 15) -> DataFrame:
    """(zone, label): components of more than `most` zones cut into connected pieces of at most that.

    In each component: seed at the free zone with most free neighbours (ties: least zone), fill
    breadth first. Labels are each piece's seed. One task for each component.
    """
    links = edges.select(F.col("src").alias("zone"), "dst").groupBy("zone").agg(F.sort_array(F.collect_set("dst")).alias("near"))
    own = labels.join(links, "zone", "left")

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("zone")
        zones = frame["zone"].tolist()
        if len(zones) <= most:
            return pd.DataFrame({"zone": zones, "label": min(zones)})
        inside = set(zones)
        near = {z: [x for x in (n if n is not None else []) if x in inside] for z, n in zip(zones, frame["near"], strict=True)}
        free, out = dict.fromkeys(zones), {}
        while free:
            seed = max(free, key=lambda z: (sum(x in free for x in near[z]), -z))
            queue, at = [seed], 0
            del free[seed]
            while at < len(queue) and len(queue) < most:
                for x in near[queue[at]]:
                    if x in free and len(queue) < most:
                        del free[x]
                        queue.append(x)
                at += 1
            out.update(dict.fromkeys(queue, seed))
        return pd.DataFrame({"zone": list(out), "label": list(out.values())})

    return own.groupBy("label").applyInPandas(lambda f: cut(f), "zone long, label long")


def _haversine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.radians(a), np.radians(b)
    h = np.sin((b[None, :, 0] - a[:, None, 0]) / 2) ** 2 + np.cos(a[:, None, 0]) * np.cos(b[None, :, 0]) * np.sin((b[None, :, 1] - a[:, None, 1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1, np.sqrt(h)))


def _on_dimension(labelled: DataFrame, fn) -> DataFrame:
    """(zone, label, was, gap_m): fn over the whole labelled zone dimension (zone, lat, lon, label), which the grid bounds, in one task.

    fn gives the labels, and what each cluster that joined another had as its distance: the merge plan.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("zone").reset_index(drop=True)
        labels, gaps = fn(frame)
        return pd.DataFrame({"zone": frame["zone"], "label": labels, "was": frame["label"], "gap_m": [gaps.get(x) for x in frame["label"]]})

    return labelled.select("zone", "lat", "lon", "label").groupBy().applyInPandas(run, "zone long, label long, was long, gap_m double")


def _cluster_gap(frame: pd.DataFrame, labels: np.ndarray, a, b) -> float:
    points = frame[["lat", "lon"]].to_numpy()
    return float(_haversine(points[labels == a], points[labels == b]).min())


def merge_small(labelled: DataFrame, least: int = 3) -> DataFrame:
    """(zone, label, was, gap_m): each cluster of fewer than `least` zones joins the nearest large one, in order of label.

    A cluster that grew counts with its new zones for those that follow. Without a large one the
    largest (ties: least label) is taken for one. There is no cap on size.
    """

    def merge(frame: pd.DataFrame) -> tuple[np.ndarray, dict]:
        labels, joined = frame["label"].to_numpy().copy(), {}
        names, counts = np.unique(labels, return_counts=True)
        large = names[counts >= least]
        small = names[counts < least]
        if not len(large) and len(names):
            large = names[[counts.argmax()]]
            small = names[names != large[0]]
        for s in small:
            gaps = [_cluster_gap(frame, labels, s, x) for x in large]
            joined[s] = min(gaps)
            labels[labels == s] = large[int(np.argmin(gaps))]
        return labels, joined

    return _on_dimension(labelled, merge)


def two_stage_merge(labelled: DataFrame, most: int = 15, least: int = 3, far_m: float | None = None, small_far_m: float | None = None, by_size: bool = False) -> DataFrame:
    """(zone, label, was, gap_m): small clusters join their one nearest large cluster if it has room, else merge with each other.

    Distances are those before any merge. Stage 1 goes by distance, then size (by_size: the other
    way round); a cluster whose nearest is full has no second choice. Stage 2 takes the nearest
    pairs of what is left while they fit in `most`. Labels are each cluster's least zone.
    """

    def merge(frame: pd.DataFrame) -> tuple[np.ndarray, dict]:
        start, joined = frame["label"].to_numpy(), {}
        labels = start.copy()
        names, counts = np.unique(start, return_counts=True)
        size = dict(zip(names.tolist(), counts.tolist(), strict=True))
        large = [x for x in size if size[x] >= least]
        room = {x: most - size[x] for x in large if size[x] < most}
        small = [x for x in size if size[x] < least]
        found = []
        for s in small:
            gaps = sorted((_cluster_gap(frame, start, s, x), x) for x in room)
            found.append((s, *(gaps[0] if gaps else (np.inf, None))))
        found.sort(key=(lambda t: (-size[t[0]], t[1], t[0])) if by_size else (lambda t: (t[1], -size[t[0]], t[0])))
        left = []
        for s, gap, to in found:
            if to is not None and (far_m is None or gap <= far_m) and room[to] >= size[s]:
                labels[labels == s] = to
                room[to] -= size[s]
                joined[s] = gap
            else:
                left.append(s)
        pairs = sorted((_cluster_gap(frame, start, a, b), a, b) for i, a in enumerate(left) for b in left[i + 1 :])
        alive, grown = set(left), {x: size[x] for x in left}
        for gap, a, b in pairs:
            if a in alive and b in alive and grown[a] + grown[b] <= most and (small_far_m is None or gap <= small_far_m):
                labels[labels == b] = a
                joined[b] = gap
                grown[a] += grown[b]
                alive.discard(b)
        zones = frame["zone"].to_numpy()
        firsts = {x: zones[labels == x].min() for x in np.unique(labels)}
        return np.array([firsts[x] for x in labels.tolist()], np.int64), joined

    return _on_dimension(labelled, merge)


def dbscan(zones: DataFrame, eps_m: float, least: int = 5) -> DataFrame:
    """(zone, label, core): density clusters of zones(zone, lat, lon); label is the least core zone, -1 for noise.

    Core: at least `least` zones, itself included, within eps_m. Border zones take the least
    label among their core neighbours.
    """
    ensure_checkpoint(zones.sparkSession)
    edges = radius_edges(zones, eps_m).checkpoint()
    degree = zones.select("zone").join(edges.groupBy(F.col("src").alias("zone")).agg(F.count(F.lit(1)).alias("_d")), "zone", "left")
    told = degree.select("zone", (F.coalesce("_d", F.lit(0)) + 1 >= least).alias("core"))
    cores = told.filter("core").select("zone")
    inner = edges.join(cores.withColumnRenamed("zone", "src"), "src", "left_semi").join(cores.withColumnRenamed("zone", "dst"), "dst", "left_semi").select("src", "dst")
    labels = components(cores, inner)
    border = edges.join(labels, F.col("dst") == F.col("zone")).groupBy(F.col("src").alias("zone")).agg(F.min("label").alias("_b"))
    own = told.join(labels, "zone", "left").join(border, "zone", "left")
    return own.select("zone", F.when(F.col("core"), F.col("label")).otherwise(F.coalesce("_b", F.lit(-1))).cast("long").alias("label"), "core")


def adjacency_costs(edges: DataFrame, probability: DataFrame, keep: bool = False, eps: float = 1e-9) -> DataFrame:
    """(src, dst, cost) for src < dst: pooled transition probability (of both ways the larger), or 1 / (p + eps) to keep flows together."""
    p = probability.select(F.least("origin", "dest").alias("src"), F.greatest("origin", "dest").alias("dst"), "p").groupBy("src", "dst").agg(F.max("p").alias("p"))
    own = edges.filter("src < dst").select("src", "dst").join(p, ["src", "dst"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    return own.select("src", "dst", (1 / (F.col("p") + eps) if keep else F.col("p")).alias("cost"))


def _roots(parent: dict) -> dict:
    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    return {x: root(x) for x in parent}


def skater(nodes: DataFrame, costs: DataFrame, clusters: int | None = None, most: int | None = None) -> DataFrame:
    """(zone, label): minimum spanning forest of the costs with heavy edges cut.

    First the heaviest edge of each component over `most` zones, again and again; then the
    heaviest of all until there are `clusters`. Zero costs are no edges. The grid bounds the
    zone dimension, so the forest is made in one task.
    """
    rows = nodes.select(F.col("zone").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("cost")).unionByName(costs.select("src", "dst", "cost"))

    def cut(frame: pd.DataFrame) -> pd.DataFrame:
        zones = sorted(frame["src"][frame["dst"].isna()].tolist())
        edges = frame[frame["dst"].notna() & (frame["cost"] > 0)].sort_values(["cost", "src", "dst"])
        parent, tree = {z: z for z in zones}, []
        for a, b, c in zip(edges["src"], edges["dst"].astype("int64"), edges["cost"], strict=True):
            ra, rb = a, b
            while parent[ra] != ra:
                ra = parent[ra]
            while parent[rb] != rb:
                rb = parent[rb]
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                tree.append((c, a, b))

        def labels() -> dict:
            up = {z: z for z in zones}
            for _, a, b in tree:
                ra, rb = a, b
                while up[ra] != ra:
                    ra = up[ra]
                while up[rb] != rb:
                    rb = up[rb]
                up[max(ra, rb)] = min(ra, rb)
            return _roots(up)

        while most:
            own = labels()
            sizes = pd.Series(own).value_counts()
            big = [e for e in sorted(tree, reverse=True) if sizes[own[e[1]]] > most]
            if not big:
                break
            seen = set()
            for e in big:
                if own[e[1]] not in seen:
                    seen.add(own[e[1]])
                    tree.remove(e)
        while clusters and tree and len(set(labels().values())) < clusters:
            tree.remove(max(tree))
        own = labels()
        return pd.DataFrame({"zone": list(own), "label": list(own.values())})

    return rows.groupBy().applyInPandas(lambda f: cut(f), "zone long, label long")


def agglomerated(distance: np.ndarray, cut: float | None = None, clusters: int | None = None, method: str = "average") -> np.ndarray:
    """Labels of hierarchical clustering (average, single or ward) of a distance matrix, cut at a distance or a number of clusters."""
    n = len(distance)
    d = distance.astype(float) ** (2 if method == "ward" else 1)
    np.fill_diagonal(d, np.inf)
    size, labels, left = np.ones(n), np.arange(n), n
    limit = np.inf if cut is None else cut ** (2 if method == "ward" else 1)
    while left > max(1, clusters or 1):
        i, j = divmod(int(d.argmin()), n)
        if not d[i, j] <= limit:
            break
        i, j = min(i, j), max(i, j)
        if method == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        elif method == "single":
            new = np.minimum(d[i], d[j])
        else:
            with np.errstate(invalid="ignore"):
                new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / (size[i] + size[j] + size)
        new[[i, j]] = np.inf
        new[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        d[i, :], d[:, i] = new, new
        d[j, :], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        labels[labels == j] = i
        left -= 1
    return np.unique(labels, return_inverse=True)[1]


def position_clusters(positions: DataFrame, keys: list[str], cut_m: float = 50.0, method: str = "average", most_points: int = 8_000) -> DataFrame:
    """positions (keys, lat, lon, ...) and cluster_id, by hierarchical clustering of each key's distinct points.

    Only an agent's distinct points come together in a task, as a matrix; with more than most_points it
    raises. 'single' at a cut is the same as components under it, so such agents should use radius_edges()
    and components().
    """
    points = positions.select(*keys, "lat", "lon").distinct()
    kinds = ", ".join(f"{k} {dict(positions.dtypes)[k]}" for k in keys)

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["lat", "lon"]).reset_index(drop=True)
        xy = frame[["lat", "lon"]].to_numpy()
        if len(xy) > most_points:
            raise ValueError(f"{len(xy)} distinct points of one key; a matrix of at most {most_points} is made")
        return frame.assign(cluster_id=agglomerated(_haversine(xy, xy), cut_m, None, method).astype("int64"))

    made = points.groupBy(*keys).applyInPandas(lambda f: cluster(f), f"{kinds}, lat double, lon double, cluster_id long")
    return positions.join(made, [*keys, "lat", "lon"])


def centred(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """clustered with lat_adj, lon_adj: each cluster's mean over all its rows, so long dwells weigh more."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "cluster_id")
    return clustered.withColumn("lat_adj", F.avg("lat").over(w)).withColumn("lon_adj", F.avg("lon").over(w))


def flow_clusters(flows: DataFrame, distances: DataFrame, far_m: float, clusters: int = 100) -> DataFrame:
    """(zone, label): Ward clustering of the symmetrised pooled flow, pairs farther than far_m at twice the largest.

    Flow is taken as a distance, as the original method does. The zone dimension is bounded by the grid.
    """
    near = flows.select(F.col("origin").alias("src"), F.col("dest").alias("dst"), F.col("n").cast("double").alias("n"))
    rows = distances.join(near, ["src", "dst"], "left").select("src", "dst", "dist_m", F.coalesce("n", F.lit(0.0)).alias("n"))

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        zones = np.sort(frame["src"].unique())
        a, b = np.searchsorted(zones, frame["src"]), np.searchsorted(zones, frame["dst"])
        flow, gap = np.zeros((2, len(zones), len(zones)))
        flow[a, b], gap[a, b] = frame["n"], frame["dist_m"]
        flow = np.maximum(flow, flow.T)
        flow[gap > far_m] = 2 * flow.max(initial=0)
        return pd.DataFrame({"zone": zones, "label": agglomerated(flow, None, clusters, "ward")})

    return rows.groupBy().applyInPandas(lambda f: cluster(f), "zone long, label long")


def passing_zones(visited: DataFrame, staying: DataFrame) -> DataFrame:
    """(zone): visited zones that are no staying zones."""
    return visited.select("zone").distinct().join(staying.select("zone").distinct(), "zone", "left_anti")


def passing_ids(labels: DataFrame, compat: bool = False) -> DataFrame:
    """Labels of passing clusters as negative numbers from -2 on, so that -1 stays the mark of 'none'; compat: from -1 on."""
    return labels.withColumn("label", -(F.col("label") + (1 if compat else 2)))
