"""Tracking: frame linking, gap closing, track numbers, Kalman and memoryless trackers, tracklets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.solver import match_pairs
from weftline.operators.assignment import Objective, match
from weftline.operators.graph import components
from weftline.operators.joins import radius_join
from weftline.operators.ranks import number_rows
from weftline.plans.storage import materialize
from weftline.schema import SCALE, require_columns


def number_nodes(detections: DataFrame, order: str) -> DataFrame:
    """node_id from 1 in each volume, by frame and then by ``order``."""
    return number_rows(detections, ["volume"], ["t"], [order], "node_id")


def link_frames(nodes: DataFrame, gate: float = 8.0, own_gate: str | None = None) -> DataFrame:
    """Optimal links between frames t and t + 1: volume, source_id, target_id, distance_um. An empty frame breaks chains.
    ``own_gate``: a column with each volume's gate, none above ``gate``."""
    pairs = radius_join(nodes, nodes, gate, [1], ["volume", "t", "node_id", *([own_gate] if own_gate else [])], ["node_id"])
    pairs = pairs.where(F.col("distance_um") <= F.col(f"{own_gate}_a")) if own_gate else pairs
    pairs = pairs.select(F.col("volume_a").alias("volume"), F.col("t_a").alias("t"), F.col("node_id_a").alias("a_id"), F.col("node_id_b").alias("b_id"), "distance_um")
    return match(pairs, gate).select("volume", F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"), "distance_um")


def close_gaps(nodes: DataFrame, edges: DataFrame, max_gap: int = 1, gap_distance: float = 6.0) -> tuple[DataFrame, DataFrame]:
    """Links chain ends to chain starts over 1 to ``max_gap`` missing frames and interpolates nodes of score 0.

    A volume without edges stays as it is. New nodes get ids after the volume's greatest, by gap, frame and ends.
    Ends are used once over all gaps; starts once per gap, so with several gaps a start may gain two parents.
    """
    linked = edges.select("volume").distinct()
    own = nodes.join(linked, "volume", "left_semi")
    ends = own.join(edges.select("volume", F.col("source_id").alias("node_id")), ["volume", "node_id"], "left_anti")
    starts = own.join(edges.select("volume", F.col("target_id").alias("node_id")), ["volume", "node_id"], "left_anti")
    found = None
    for gap in range(1, max_gap + 1):
        gate = gap_distance * (gap + 1)
        pairs = radius_join(ends, starts, gate, [gap + 1], ["volume", "t", "node_id", "z", "y", "x"], ["node_id", "z", "y", "x"])
        pairs = pairs.select(F.col("volume_a").alias("volume"), F.col("t_a").alias("t"), F.col("node_id_a").alias("a_id"), F.col("node_id_b").alias("b_id"), "distance_um")
        bridges = materialize(match(pairs, gate).withColumn("gap", F.lit(gap).cast("long")), "bridges")
        found = bridges if found is None else found.unionByName(bridges)
        ends = ends.join(bridges.select("volume", F.col("a_id").alias("node_id")), ["volume", "node_id"], "left_anti")
    if found is None:
        return nodes, edges.select("volume", "source_id", "target_id")
    top = nodes.groupBy("volume").agg(F.max("node_id").alias("top"))
    before = F.coalesce(F.sum("gap").over(Window.partitionBy("volume").orderBy("gap", "t", "a_id", "b_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.withColumn("before", before).join(top, "volume")
    for side in ("a", "b"):
        placed = placed.join(nodes.select("volume", F.col("node_id").alias(f"{side}_id"), *[F.col(k).alias(f"{side}{k}") for k in "zyx"]), ["volume", f"{side}_id"])
    steps = placed.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("gap"))))
    share = F.col("k") / (F.col("gap") + 1)
    new_nodes = steps.select(
        "volume", (F.col("t") + F.col("k")).alias("t"), *[(F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * share).alias(k) for k in "zyx"], F.lit(0.0).alias("score"), (F.col("top") + F.col("before") + F.col("k")).alias("node_id")
    )
    hops = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gap"))))
    made = F.col("top") + F.col("before") + F.col("k")
    new_edges = hops.select("volume", F.when(F.col("k") == 0, F.col("a_id")).otherwise(made).alias("source_id"), F.when(F.col("k") == F.col("gap"), F.col("b_id")).otherwise(made + 1).alias("target_id"))
    same = ["volume", "t", "z", "y", "x", "score", "node_id"]
    return nodes.select(*same).unionByName(new_nodes.select(*same)), edges.select("volume", "source_id", "target_id").unionByName(new_edges)


def assign_tracks(nodes: DataFrame, edges: DataFrame, min_length: int = 2) -> DataFrame:
    """Nodes of components of at least ``min_length`` nodes, numbered per volume by first frame, then first node."""
    placed = nodes.join(components(edges), ["volume", "node_id"])
    sizes = placed.groupBy("volume", "component").agg(F.count("*").alias("_n"), F.min("t").alias("_t")).where(F.col("_n") >= min_length)
    numbered = number_rows(sizes, ["volume"], ["_t"], ["component"], "track_id").select("volume", "component", "track_id")
    return placed.join(numbered, ["volume", "component"]).drop("component")


def track(detections: DataFrame, gate: float = 8.0, min_length: int = 2, gaps: bool = True, max_gap: int = 1, gap_distance: float = 6.0, order: str | None = None) -> DataFrame:
    """Detections with track_id; the defaults are those of the loose linker (strict: 4.0, 5, False, 1, 4.0)."""
    require_columns(detections, ["volume", "t", "z", "y", "x", "score"], "detections")
    nodes = number_nodes(detections, order or "score") if "node_id" not in detections.columns else detections
    nodes = nodes.select("volume", "t", "z", "y", "x", "score", "node_id")
    edges = materialize(link_frames(nodes, gate).select("volume", "source_id", "target_id"), "links")
    if gaps:
        nodes, edges = close_gaps(nodes, edges, max_gap, gap_distance)
    return assign_tracks(nodes, edges, min_length)


def drop_short(tracks: DataFrame, least: int) -> DataFrame:
    """Tracks of at least ``least`` points."""
    n = F.count("*").over(Window.partitionBy("volume", "track_id"))
    return tracks.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def track_previous_present(detections: DataFrame, gate: float, min_length: int = 1, own_gate: str | None = None) -> DataFrame:
    """The memoryless tracker: each frame links to the last frame that has points, however long ago. ``own_gate`` as in ``link_frames``."""
    frames = detections.select("volume", "t").distinct().withColumn("step", F.row_number().over(Window.partitionBy("volume").orderBy("t")).cast("long"))
    stepped = detections.join(frames, ["volume", "t"]).withColumnRenamed("t", "_t").withColumnRenamed("step", "t")
    edges = materialize(link_frames(stepped, gate, own_gate).select("volume", "source_id", "target_id"), "links")
    grouped = components(edges)
    placed = detections.join(grouped, ["volume", "node_id"], "left").withColumn("component", F.coalesce("component", "node_id"))
    first = placed.groupBy("volume", "component").agg(F.min("t").alias("_t"))
    numbered = number_rows(first, ["volume"], ["_t"], ["component"], "track_id").drop("_t")
    return drop_short(placed.join(numbered, ["volume", "component"]).drop("component"), min_length)


#: Frames whose points one task links in a row. Peaks are far sparser than voxels: so many frames of points are less than one of voxels.
BLOCK = 128
#: Pairs of points of two frames that are compared without cells, at most.
DENSE = 65536


def link_blocks(detections: DataFrame, gate: float, own_gate: str | None = None, block: int = BLOCK) -> DataFrame:
    """Detections with ``head``, the first node of their track: the links of ``track_previous_present``, for frames of few
    points. Node ids ascend with the frames.

    A task follows the tracks through ``block`` frames and to the frame behind them, so that links and tracks take one
    pass. Pieces of tracks that reach into a further block are joined as components, one row a piece.
    """
    frames = detections.select("volume", "t").distinct().withColumn("_step", F.row_number().over(Window.partitionBy("volume").orderBy("t")).cast("long") - 1)
    own, first = F.floor(F.col("_step") / block), (F.col("_step") % block == 0) & (F.col("_step") > 0)
    stepped = detections.join(frames, ["volume", "t"]).withColumn("_block", F.explode(F.when(first, F.array(own, own - 1)).otherwise(F.array(own))))
    scale, cost = np.array(list(SCALE.values())), Objective.CARDINALITY.infeasible(gate)
    columns = [*detections.columns, "head", "_ahead"]

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_step", "node_id"], ignore_index=True)
        at, step = pdf[["z", "y", "x"]].to_numpy(float), pdf["_step"].to_numpy()
        most = np.minimum(pdf[own_gate].to_numpy(float), gate) if own_gate else np.full(len(pdf), gate)
        head = pdf.node_id.to_numpy(np.int64, copy=True)
        begin = np.flatnonzero(np.r_[True, np.diff(step) != 0]).tolist()
        for a, b, end in zip(begin, begin[1:], [*begin[2:], len(pdf)], strict=False):
            if (b - a) * (end - b) <= DENSE:
                i, j = np.indices((b - a, end - b)).reshape(2, -1)
            else:
                i, j, _ = pairs_within(at[a:b] * scale, at[b:end] * scale, gate * (1 + 1e-9))
            z, y, x = ((at[a + i] - at[b + j]) * scale).T
            d = np.sqrt(z * z + y * y + x * x)  # to the last bit as in SQL
            near = d <= most[a + i]
            i, j, d = i[near], j[near], d[near]
            take = match_pairs(i, j, d, cost)
            head[b + j[take]] = head[a + i[take]]
        pdf = pdf.assign(head=head, _ahead=step // block != pdf["_block"].to_numpy())
        return pdf[~pdf["_ahead"] | (pdf["head"] != pdf["node_id"])][columns]

    # a number of parts that stays: points are few, but not their pairs
    dealt = stepped.repartition(int(detections.sparkSession.conf.get("spark.sql.shuffle.partitions")), "volume", "_block").groupBy("volume", "_block")
    kinds = ", ".join(f"{c} {kind}" for c, kind in detections.dtypes)
    made = materialize(dealt.applyInPandas(follow, f"{kinds}, head long, _ahead boolean"), "pieces")
    ahead, pieces = made.where("_ahead").select("volume", F.col("head").alias("source_id"), F.col("node_id").alias("target_id")), made.where("not _ahead").drop("_ahead")
    if ahead.isEmpty():
        return pieces
    whole = components(ahead).select("volume", F.col("node_id").alias("head"), "component")
    return pieces.join(whole, ["volume", "head"], "left").withColumn("head", F.coalesce("component", "head")).select(*columns[:-1])


# ---------------------------------------------------------------- Kalman tracker


def pairs_within(a: np.ndarray, b: np.ndarray, gate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a and b nearer than the gate, and their distances: only points of neighbouring cells are compared."""
    cell = lambda p: np.floor(p / gate).astype(np.int64)
    base = np.array([1 << 42, 1 << 21, 1])
    own = (cell(b) + (1 << 19)) @ base
    order = np.argsort(own, kind="stable")
    own, rows, columns = own[order], [], []
    for step in np.ndindex(3, 3, 3):
        key = (cell(a) + (1 << 19) + np.array(step) - 1) @ base
        low, high = np.searchsorted(own, key, side="left"), np.searchsorted(own, key, side="right")
        n = high - low
        rows.append(np.repeat(np.arange(len(a)), n))
        columns.append(order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
    i, j = np.concatenate(rows), np.concatenate(columns)
    d = np.sqrt(((a[i] - b[j]) ** 2).sum(axis=1))
    near = np.flatnonzero(d < gate)
    near = near[np.lexsort((j[near], i[near]))]
    return i[near], j[near], d[near]


class KalmanBank:
    """Constant-velocity filters of all live tracks of a volume.

    Noise is isotropic and independent of the data, so each track's gain depends on its age alone: position and
    velocity move by the same share of the innovation.
    """

    def __init__(self, gate: float, process: float = 1.0, measure: float = 1.0):
        self.gate, self.process, self.measure = gate, process, measure
        self.ids = np.zeros(0, dtype=np.int64)
        self.at, self.speed = np.zeros((0, 3)), np.zeros((0, 3))
        self.spread = np.zeros(0)
        self.next = 0

    def step(self, points: np.ndarray) -> np.ndarray:
        """Track number of each point of the next frame; unmatched tracks end, unmatched points start tracks."""
        guess = self.at + self.speed
        spread = self.spread + self.process
        out = np.full(len(points), -1, dtype=np.int64)
        if len(guess) and len(points):
            i, j, d = pairs_within(guess, points, self.gate)
            take = match_pairs(i, j, d, 1e6)
            i, j = i[take], j[take]
        else:
            i = j = np.zeros(0, dtype=int)
        gain = (spread[i] / (spread[i] + self.measure))[:, None]
        moved = points[j] - guess[i]
        at, speed, left = guess[i] + gain * moved, self.speed[i] + gain * moved, (1 - gain[:, 0]) * spread[i]
        out[j] = self.ids[i]
        fresh = np.flatnonzero(out < 0)
        out[fresh] = self.next + np.arange(fresh.size)
        self.next += fresh.size
        self.ids = np.concatenate([self.ids[i], out[fresh]])
        self.at = np.concatenate([at, points[fresh]])
        self.speed = np.concatenate([speed, np.zeros((fresh.size, 3))])
        self.spread = np.concatenate([left, np.full(fresh.size, 1.0)])
        return out


def kalman_track(detections: DataFrame, max_distance: float = 50.0) -> DataFrame:
    """Tracks by predicted positions in voxels over the frames present; adds track_id, unique over all volumes.

    A volume streams through one task in the order of its frames; only the live tracks are held.
    """
    columns = detections.columns
    schema = detections.schema.simpleString()[len("struct<") : -1] + ",track_no:bigint"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bank, volume, held = None, None, None

        def flush(frame: pd.DataFrame) -> pd.DataFrame:
            return frame.assign(track_no=bank.step(frame[["z", "y", "x"]].to_numpy(float)))

        for pdf in frames:
            for (v, _), part in pdf.groupby(["volume", "t"], sort=False):
                if held is not None and held.volume.iloc[0] == v and held.t.iloc[0] == part.t.iloc[0]:
                    held = pd.concat([held, part])
                    continue
                if held is not None:
                    yield flush(held)
                if v != volume:
                    bank, volume = KalmanBank(max_distance), v
                held = part
        if held is not None:
            yield flush(held)

    order = ["volume", "t", "node_id"] if "node_id" in columns else ["volume", "t", "z", "y", "x"]
    dealt = detections.repartition("volume").sortWithinPartitions(*order)
    numbered = materialize(dealt.mapInPandas(run, schema), "kalman")
    before = numbered.groupBy("volume").agg((F.max("track_no") + 1).alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("volume").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = before.withColumn("_o", offset).drop("_n")  # one row per volume
    return numbered.join(before, "volume").withColumn("track_id", F.col("track_no") + F.col("_o") + 1).select(*columns, "track_id")


# ---------------------------------------------------------------- tracklets and statistics


def tracklets(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unbranched pieces of a lineage: (volume, label, begin, end, parent) and (volume, node_id, label).

    A piece starts where there is no parent or where the parent divides, and goes on while a node has one child and
    the child one parent. Nodes behind merges belong to no piece; their label is null. Labels ascend by first frame.
    """
    out_ = edges.groupBy("volume", F.col("source_id").alias("node_id")).agg(F.count("*").alias("children"))
    in_ = edges.groupBy("volume", F.col("target_id").alias("node_id")).agg(F.count("*").alias("parents"))
    known = nodes.select("volume", "node_id", "t").join(out_, ["volume", "node_id"], "left").join(in_, ["volume", "node_id"], "left").fillna(0, ["children", "parents"])
    a = known.select("volume", F.col("node_id").alias("source_id"), "children")
    b = known.select("volume", F.col("node_id").alias("target_id"), "parents")
    joined = edges.select("volume", "source_id", "target_id").join(a, ["volume", "source_id"]).join(b, ["volume", "target_id"])
    inner = joined.where("children = 1 and parents = 1").select("volume", "source_id", "target_id")
    pieces = known.join(components(inner), ["volume", "node_id"], "left").withColumn("component", F.coalesce("component", "node_id"))
    divided = joined.where("children >= 2").groupBy("volume", F.col("target_id").alias("node_id")).agg(F.min("source_id").alias("parent_node"))
    starts = known.join(divided, ["volume", "node_id"], "left").where("parents = 0 or parent_node is not null").select("volume", "node_id", "t", "parent_node")
    begun = pieces.select("volume", "node_id", "component").join(starts, ["volume", "node_id"])
    labelled = number_rows(begun, ["volume"], ["t"], ["node_id"], "label")
    of_node = pieces.join(labelled.select("volume", "component", "label"), ["volume", "component"], "left").select("volume", "node_id", "t", "label")
    spans = of_node.where("label is not null").groupBy("volume", "label").agg(F.min("t").alias("begin"), F.max("t").alias("end"))
    parents = labelled.select("volume", "label", F.col("parent_node").alias("node_id")).join(of_node.select("volume", "node_id", F.col("label").alias("parent")), ["volume", "node_id"], "left").select("volume", "label", "parent")
    table = spans.join(parents, ["volume", "label"], "left").withColumn("parent", F.coalesce("parent", F.lit(0).cast("long")))
    return table.select("volume", "label", "begin", "end", "parent"), of_node.select("volume", "node_id", "label")


def track_statistics(tracks: DataFrame) -> DataFrame:
    """Per volume: tracks, points, and median, mean, greatest and least length."""
    sizes = tracks.groupBy("volume", "track_id").agg(F.count("*").alias("n"))
    return sizes.groupBy("volume").agg(F.count("*").alias("n_tracks"), F.sum("n").alias("n_points"), F.expr("percentile(n, 0.5)").alias("median_length"), F.avg("n").alias("mean_length"), F.max("n").alias("max_length"), F.min("n").alias("min_length"))
