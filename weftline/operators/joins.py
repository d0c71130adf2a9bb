"""Spatial joins: radius, nearest, gap and pair joins keyed by volume and frame.

Radius joins are equi-joins on (volume, frame, grid cell). Cells are four gates
wide; one side goes to each cell that its reach touches, mostly one or two per
axis, so no frame is ever joined with itself as a whole, hot frames spread over
their cells, and the exploded side grows by about 3.4. Spark guesses the size of
an exploded side as that before it and would broadcast it: these joins merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.geometry import distance_um
from weftline.schema import SCALE


#: Width of a grid cell, in gates.
CELL = 4.0


def _cells(gate: float, reach: float) -> list[Column]:
    """Per axis the cell of the point moved by ``reach`` micrometres."""
    return [F.floor((F.col(k) * F.lit(v) + F.lit(reach)) / F.lit(CELL * gate)).cast("long") for k, v in SCALE.items()]


def radius_join(a: DataFrame, b: DataFrame, gate: float, gaps: range | list[int] = (0,), keep_a: list[str] | None = None, keep_b: list[str] | None = None) -> DataFrame:
    """Pairs of points of one volume, frames t and t + gap, at most ``gate`` micrometres apart.

    Columns come back with the suffixes _a and _b, beside gap and distance_um.
    """
    keep_a, keep_b = keep_a or a.columns, keep_b or b.columns
    names = ("cz", "cy", "cx")
    left = a.select(*dict.fromkeys([*keep_a, "volume", "t", "z", "y", "x"])).withColumn("gap", F.explode(F.array(*[F.lit(int(g)) for g in gaps])))
    left = left.withColumn("jt", F.col("t") + F.col("gap"))
    slack = gate * (1 + 1e-9)  # for the last bit of a place at the gate itself
    for name, low, high in zip(names, _cells(gate, -slack), _cells(gate, slack), strict=True):
        left = left.withColumn(name, F.explode(F.sequence(low, high)))
    right = b.select(*dict.fromkeys([*keep_b, "volume", "t", "z", "y", "x"])).withColumns(dict(zip(names, _cells(gate, 0.0), strict=True)))
    p, q = left.alias("p"), right.alias("q")
    on = (F.col("p.volume") == F.col("q.volume")) & (F.col("p.jt") == F.col("q.t"))
    for c in names:
        on = on & (F.col(f"p.{c}") == F.col(f"q.{c}"))
    d = distance_um("p", "q")
    return p.hint("merge").join(q, on).where(d <= F.lit(float(gate))).select(
        *[F.col(f"p.{c}").alias(f"{c}_a") for c in keep_a], *[F.col(f"q.{c}").alias(f"{c}_b") for c in keep_b], F.col("p.gap").alias("gap"), d.alias("distance_um")
    )


def nearest_join(a: DataFrame, b: DataFrame, gate: float, gap: int = 0) -> DataFrame:
    """Each point of a with the id of its nearest point of b within the gate, or -1: columns node_id, match_id, distance_um."""
    pairs = radius_join(a, b, gate, [gap], ["volume", "node_id"], ["node_id"])
    best = pairs.groupBy("volume_a", "node_id_a").agg(F.min(F.struct("distance_um", "node_id_b")).alias("m"))
    found = best.select(F.col("volume_a").alias("volume"), F.col("node_id_a").alias("node_id"), F.col("m.node_id_b").alias("match_id"), F.col("m.distance_um").alias("distance_um"))
    return a.select("volume", "node_id").join(found, ["volume", "node_id"], "left").withColumn("match_id", F.coalesce("match_id", F.lit(-1).cast("long")))


def track_successor(tracks: DataFrame) -> DataFrame:
    """Each track point with the smallest node of its track in the next frame: node_id, next_id."""
    following = tracks.groupBy("volume", "track_id", "t").agg(F.min("node_id").alias("next_id")).withColumn("t", F.col("t") - 1)
    return tracks.join(following, ["volume", "track_id", "t"]).select("volume", "track_id", "t", "node_id", "next_id")


def lookup_nodes(tracks: DataFrame, keys: DataFrame) -> DataFrame:
    """(volume, track_id, t) keys with the node there, the largest where there are several; null if none."""
    nodes = tracks.groupBy("volume", "track_id", "t").agg(F.max("node_id").alias("node_id"))
    return keys.join(nodes, ["volume", "track_id", "t"], "left")


def pairs_within(df: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Pairs of rows of a small group, the one of lower rank first (suffixes _a and _b)."""
    a = df.select(*keys, *[F.col(c).alias(f"{c}_a") for c in df.columns if c not in keys])
    b = df.select(*keys, *[F.col(c).alias(f"{c}_b") for c in df.columns if c not in keys])
    return a.join(b, keys).where(F.col(f"{rank}_a") < F.col(f"{rank}_b"))


#: Beyond this level a cell spans half of all places.
_WIDEST = 30


def nodes_in_box(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """Nodes within the half-open boxes (volume, t, box_id, z0, z1, y0, y1, x0, x1).

    A hierarchy of cells, four times as wide at every level, axis by axis: a box goes to the at most two cells per axis of
    the level whose cells are as wide as the box, and a node to its one cell of each combination of levels that boxes of
    its frame have. Boxes of any size take eight cells at most. Bounds may be infinite; a box without extent holds nothing.
    """
    axes = ("z", "y", "x")
    wide = lambda k: F.col(f"{k}1") - F.col(f"{k}0")
    side = lambda k: F.pow(F.lit(4.0), F.col(f"_l{k}"))
    level = lambda k: F.when(F.isnan(wide(k)) | (wide(k) > 4.0 ** (_WIDEST - 1)), _WIDEST).otherwise(F.greatest(F.ceil(F.log2(wide(k)) / 2), F.lit(-_WIDEST))).cast("int")
    cell = lambda k, place: F.when(F.col(f"_l{k}") == _WIDEST, F.when(place < 0, -1).otherwise(0)).otherwise(F.floor(place / side(k))).cast("long")
    low = lambda k: F.when(F.col(f"_l{k}") == _WIDEST, -1).otherwise(cell(k, F.col(f"{k}0"))).cast("long")
    high = lambda k: F.when(F.col(f"_l{k}") == _WIDEST, 0).otherwise(cell(k, F.col(f"{k}1"))).cast("long")
    some = [(F.col(f"{k}0") < F.col(f"{k}1")) for k in axes]
    levels, cells = [f"_l{k}" for k in axes], [f"_c{k}" for k in axes]
    covered = boxes.where(some[0] & some[1] & some[2]).withColumns({f"_l{k}": level(k) for k in axes})
    in_use = covered.select("volume", "t", *levels).distinct()
    for k in axes:
        covered = covered.withColumn(f"_c{k}", F.explode(F.sequence(low(k), high(k))))
    placed = nodes.join(in_use, ["volume", "t"]).withColumns({f"_c{k}": cell(k, F.col(k)) for k in axes})
    inside = [(F.col(k) >= F.col(f"{k}0")) & (F.col(k) < F.col(f"{k}1")) for k in axes]
    return placed.join(covered.hint("merge"), ["volume", "t", *levels, *cells]).where(inside[0] & inside[1] & inside[2]).drop(*levels, *cells)


def existing_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist, once each."""
    own = nodes.select("volume", "node_id")
    kept = edges.join(own.withColumnRenamed("node_id", "source_id"), ["volume", "source_id"], "left_semi")
    return kept.join(own.withColumnRenamed("node_id", "target_id"), ["volume", "target_id"], "left_semi").select("volume", "source_id", "target_id").distinct()


def missing_volumes(have: DataFrame, want: DataFrame) -> DataFrame:
    """Volumes without a counterpart."""
    return have.select("volume").distinct().join(want.select("volume"), "volume", "left_anti")


def map_edges(edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Predicted edges whose both ends are matched, as ground-truth pairs."""
    m = matches.select("volume", "pred_id", "gt_id")
    s = m.select("volume", F.col("pred_id").alias("source_id"), F.col("gt_id").alias("gt_source"))
    t = m.select("volume", F.col("pred_id").alias("target_id"), F.col("gt_id").alias("gt_target"))
    return edges.join(s, ["volume", "source_id"]).join(t, ["volume", "target_id"])


def ranked(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Adds rank, from 1 in each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
