"""Division operators: edges from track starts, scored events, ground-truth statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.geometry import prefix_of
from weftline.operators.graph import lineage_extent
from weftline.operators.joins import pairs_within, radius_join
from weftline.plans.storage import materialize
from weftline.schema import SCALE, require_columns

#: Fixed values of the pair score: mean daughter separation (micrometres) and median parent age (frames).
SEPARATION_UM, AGE_FRAMES = 10.53, 16


def track_meta(tracks: DataFrame) -> DataFrame:
    """volume, track_id, start_t, end_t, length."""
    return tracks.groupBy("volume", "track_id").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("length"))


def persistence(tracks: DataFrame, frames: int) -> DataFrame:
    """Each track frame with the number of different frames of its track in [t, t + frames)."""
    own = tracks.select("volume", "track_id", "t").distinct()
    w = Window.partitionBy("volume", "track_id").orderBy("t").rangeBetween(0, frames - 1)
    return own.withColumn("persistence", F.count("*").over(w))


def _candidates(tracks: DataFrame, max_gap: int, distance: float) -> DataFrame:
    require_columns(tracks, ["volume", "track_id", "t", "z", "y", "x"], "tracks")
    columns = ["volume", "track_id", "t", "z", "y", "x"]
    found = radius_join(tracks, tracks, distance, range(1, max_gap + 1), columns, columns)
    start = track_meta(tracks).select("volume", F.col("track_id").alias("track_id_b"), "start_t")
    return found.withColumnRenamed("volume_a", "volume").drop("volume_b").join(start, ["volume", "track_id_b"])


def division_edges(tracks: DataFrame, max_gap: int = 1, distance: float = 8.0, max_children: int = 2, require_new: bool = True) -> DataFrame:
    """Parents with two children nearby of which one starts a track; the nearest continuation comes first."""
    kind = F.when(F.col("track_id_b") == F.col("track_id_a"), "continuation").when(F.col("start_t") == F.col("t_b"), "new_track").otherwise("existing_track")
    found = _candidates(tracks, max_gap, distance).withColumn("child_kind", kind)
    if require_new:
        found = found.where("child_kind <> 'existing_track'")
    parent = ["volume", "track_id_a", "t_a"]
    w = Window.partitionBy(*parent)
    order = [F.col("distance_um"), F.col("t_b"), F.col("track_id_b")]
    is_new, is_continuation = F.col("child_kind") == "new_track", F.col("child_kind") == "continuation"
    found = found.withColumns({"_n": F.count("*").over(w), "_new": F.sum(is_new.cast("int")).over(w)}).where("_n >= 2")
    if require_new:
        found = found.where("_new >= 1")
    kind_rank = F.row_number().over(Window.partitionBy(*parent, "child_kind").orderBy(*order))
    all_rank = F.row_number().over(w.orderBy(*order))
    found = found.withColumns({"_kr": kind_rank, "_ar": all_rank})
    chosen = (is_continuation & (F.col("_kr") == 1)) | is_new
    found = found.withColumns({"_chosen": chosen, "_picks": F.sum(chosen.cast("int")).over(w)})
    place = F.when(F.col("_picks") < 2, F.col("_ar")).when(chosen, F.row_number().over(Window.partitionBy(*parent, "_chosen").orderBy(F.when(is_continuation, 0).otherwise(1), *order)))
    found = found.withColumn("_place", place).where(F.col("_place") <= max_children)
    found = found.withColumn("_targets", F.size(F.collect_set("track_id_b").over(w))).where("_targets >= 2")
    edges = found.select("volume", F.col("track_id_a").alias("source_track_id"), F.col("t_a").alias("source_t"), F.col("track_id_b").alias("target_track_id"), F.col("t_b").alias("target_t"), "distance_um", "child_kind", "_place")
    first = F.row_number().over(Window.partitionBy("volume", "source_track_id", "source_t", "target_track_id", "target_t").orderBy("_place"))
    return edges.withColumn("_first", first).where("_first = 1").drop("_first", "_place").withColumn("edge_type", F.lit("division"))


@dataclass(frozen=True)
class EventRules:
    """Thresholds of division events; ages and persistence in frames, distances in micrometres."""

    distance: float = 8.0
    separation: float = 8.0
    parent_age: int = 10
    daughter_persistence: int = 2
    max_gap: int = 1
    require_new: bool = True


def pair_score(distance_a: Column, distance_b: Column, separation: Column, age: Column, least_persistence: Column, rules: EventRules) -> Column:
    """Closeness, separation near the usual one, age and persistence, weighted .35, .30, .20 and .15."""
    near = 1 - F.least((distance_a + distance_b) / 2 / F.lit(rules.distance), F.lit(1.0))
    apart = 1 - F.least(F.abs(separation - SEPARATION_UM) / F.lit(SEPARATION_UM), F.lit(1.0))
    old = F.least(age / F.lit(float(AGE_FRAMES)), F.lit(1.0))
    lasts = F.least(least_persistence / F.lit(float(max(rules.daughter_persistence, 1))), F.lit(1.0))
    return 0.35 * near + 0.30 * apart + 0.20 * old + 0.15 * lasts


def division_events(tracks: DataFrame, rules: EventRules | None = None) -> DataFrame:
    """The best pair of daughters of each parent point old enough: 23 columns, one event per volume, track and frame."""
    r = rules or EventRules()
    age = F.row_number().over(Window.partitionBy("volume", "track_id").orderBy("t"))
    parents = tracks.withColumn("age", age).where(F.col("age") >= r.parent_age).select("volume", F.col("track_id").alias("track_id_a"), F.col("t").alias("t_a"), "age")
    lasting = persistence(tracks, r.daughter_persistence).where(F.col("persistence") >= r.daughter_persistence)
    lasting = lasting.select("volume", F.col("track_id").alias("track_id_b"), F.col("t").alias("t_b"), "persistence")
    found = _candidates(tracks, r.max_gap, r.distance).join(parents, ["volume", "track_id_a", "t_a"]).join(lasting, ["volume", "track_id_b", "t_b"])
    found = found.select(
        "volume", F.col("track_id_a").alias("parent_track_id"), F.col("t_a").alias("parent_t"), *[F.col(f"{k}_a").alias(f"parent_{k}") for k in "zyx"], F.col("age").alias("parent_age_frames"),
        F.col("track_id_b").alias("track"), F.col("t_b").alias("t"), *[F.col(f"{k}_b").alias(k) for k in "zyx"], "distance_um", "persistence", (F.col("start_t") == F.col("t_b")).alias("new"),
    )
    parent = ["volume", "parent_track_id", "parent_t"]
    nearest = F.row_number().over(Window.partitionBy(*parent, "track").orderBy("distance_um", "t"))
    ordered = found.withColumn("_k", nearest).where("_k = 1").drop("_k")
    ordered = ordered.withColumn("rank", F.row_number().over(Window.partitionBy(*parent).orderBy("distance_um", "track")))
    pairs = pairs_within(ordered, [*parent, "parent_z", "parent_y", "parent_x", "parent_age_frames"], "rank")
    if r.require_new:
        pairs = pairs.where("new_a or new_b")
    d = [(F.col(f"{k}_a") - F.col(f"{k}_b")) * F.lit(v) for k, v in SCALE.items()]
    pairs = pairs.withColumn("separation", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where(F.col("separation") >= r.separation)
    score = pair_score(F.col("distance_um_a"), F.col("distance_um_b"), F.col("separation"), F.col("parent_age_frames"), F.least("persistence_a", "persistence_b"), r)
    # equal scores, but for the noise of summing: the first pair in the order of distances wins
    best = F.row_number().over(Window.partitionBy(*parent).orderBy(F.round("confidence", 9).desc(), "rank_a", "rank_b"))
    pairs = pairs.withColumn("confidence", score).withColumn("_best", best).where("_best = 1")
    one = [f"{c}_{{}}" for c in ("t", "track", "z", "y", "x", "distance_um", "persistence")]
    first, second = (F.struct(*[F.col(c.format(s)).alias(c[:-3]) for c in one]) for s in ("a", "b"))
    sorted_ = pairs.withColumns({"d1": F.least(first, second), "d2": F.greatest(first, second)})
    daughter = lambda n: [
        F.col(f"d{n}.track").alias(f"daughter_{n}_track_id"), F.col(f"d{n}.t").alias(f"daughter_{n}_t"), *[F.col(f"d{n}.{k}").alias(f"daughter_{n}_{k}") for k in "zyx"]
    ]
    return sorted_.select(
        *parent, "parent_z", "parent_y", "parent_x", *daughter(1), *daughter(2), "confidence",
        ((F.col("distance_um_a") + F.col("distance_um_b")) / 2).alias("parent_child_dist_um_mean"), F.greatest("distance_um_a", "distance_um_b").alias("parent_child_dist_um_max"),
        F.col("separation").alias("daughter_separation_um"), "parent_age_frames", F.col("d1.persistence").alias("daughter_1_persistence_frames"), F.col("d2.persistence").alias("daughter_2_persistence_frames"),
    )


def events_to_edges(events: DataFrame) -> DataFrame:
    """Two edges of each event; both carry the mean distance."""
    ends = F.explode(F.array(*[F.struct(F.col(f"daughter_{n}_track_id").alias("target_track_id"), F.col(f"daughter_{n}_t").alias("target_t")) for n in (1, 2)]))
    return events.select("volume", F.col("parent_track_id").alias("source_track_id"), F.col("parent_t").alias("source_t"), ends.alias("e"), F.col("parent_child_dist_um_mean").alias("distance_um"), "confidence").select(
        "volume", "source_track_id", "source_t", "e.target_track_id", "e.target_t", "distance_um", F.lit("division").alias("edge_type"), "confidence"
    )


def truth_divisions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per node with two or more children: distances, step from the smallest predecessor, lineage age and span."""
    extent = materialize(lineage_extent(nodes, edges), "extent")
    place = lambda s: nodes.select("volume", F.col("node_id").alias(s), F.struct("z", "y", "x").alias(f"{s}_p"))
    full = edges.join(place("source_id"), ["volume", "source_id"]).join(place("target_id"), ["volume", "target_id"])
    span = extent.select("volume", F.col("node_id").alias("target_id"), "span")
    child = full.withColumn("d", _apart("source_id_p", "target_id_p")).join(span, ["volume", "target_id"])
    per = child.groupBy("volume", F.col("source_id").alias("parent_id")).agg(
        F.count("*").alias("n_children"), F.array_join(F.sort_array(F.collect_list("target_id")), ";").alias("children_ids"),
        F.avg("d").alias("parent_child_um_mean"), F.min("d").alias("parent_child_um_min"), F.max("d").alias("parent_child_um_max"),
        F.avg("span").alias("child_span_mean"), F.min("span").alias("child_span_min"), F.max("span").alias("child_span_max"),
    ).where("n_children >= 2")
    kids = child.join(per.select("volume", F.col("parent_id").alias("source_id")), ["volume", "source_id"]).select("volume", "source_id", "target_id", F.col("target_id_p").alias("p"))
    between = pairs_within(kids, ["volume", "source_id"], "target_id").groupBy("volume", F.col("source_id").alias("parent_id")).agg(F.avg(_apart("p_a", "p_b")).alias("child_child_um_mean"))
    step = full.groupBy("volume", F.col("target_id").alias("parent_id")).agg(F.min_by(_apart("source_id_p", "target_id_p"), "source_id").alias("parent_step_um"))
    own = nodes.select("volume", F.col("node_id").alias("parent_id"), F.col("t").alias("parent_t"), *[F.col(k).alias(f"parent_{k}") for k in "zyx"])
    age = extent.select("volume", F.col("node_id").alias("parent_id"), F.col("age").alias("lineage_age"))
    key = ["volume", "parent_id"]
    return per.join(own, key).join(between, key, "left").join(step, key, "left").join(age, key).withColumn("prefix", prefix_of("volume"))


def _apart(a: str, b: str) -> Column:
    d = [(F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) * F.lit(v) for k, v in SCALE.items()]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
