"""Calibration of detection and linking: trials of parameters, sampled by a tree-structured Parzen estimator.

A trial detects points in every frame, links them by the memoryless tracker, drops
short tracks, rounds the points and scores the graph against the truth. Frames are
read once for all trials: a frame's response does not depend on the parameters, so
each candidate point is kept with its score and with the distance to the nearest
greater response, and a trial's detections are a filter of that table.

Trials run in batches, all of a batch in one job, a trial being part of the
tracker's volume key; truth is never copied. The sampler lives on the driver and
knows at most 30 trials.
"""

from __future__ import annotations

import math
import random
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.geometry import half_even
from weftline.functions.solver import match_pairs
from weftline.operators import evaluation
from weftline.operators.assignment import Objective
from weftline.operators.detection import candidate_frames
from weftline.operators.joins import radius_join
from weftline.operators.tracking import link_blocks
from weftline.plans.storage import materialize, release

#: Ranges of the sampled parameters: relative threshold, suppression radius and link gate in micrometres.
RANGES = {"rel_threshold": (0.03, 0.06), "min_distance_um": (2.5, 4.0), "max_link_um": (6.0, 10.0)}
MOST_TRIALS = 30
_PARAMS = "trial long, rel_threshold double, min_distance_um double, max_link_um double"


class ParzenSampler:
    """Asks for parameters that are likely among good trials and unlikely among the others.

    The first ``startup`` trials are uniform. Then the best tenth of all trials is set against the rest: each parameter
    has two mixtures of normals at its values, cut to the range, beside a wide one over the whole range; of 24 draws from
    the good mixture that of the greatest ratio is taken. Trials asked for but not yet told count as bad, so that a
    batch spreads.
    """

    def __init__(self, ranges: dict[str, tuple[float, float]], seed: int, startup: int = 10, draws: int = 24):
        self.ranges, self.rng, self.startup, self.draws = ranges, random.Random(seed), startup, draws
        self.told: list[tuple[dict, float]] = []
        self.asked = 0

    def tell(self, parameters: dict, score: float) -> None:
        self.told.append((parameters, score))

    def ask(self, n: int) -> list[dict]:
        out: list[dict] = []
        for _ in range(n):
            if self.asked < self.startup or not self.told:
                new = {k: self.rng.uniform(*r) for k, r in self.ranges.items()}
            else:
                ordered = [p for p, _ in sorted(self.told, key=lambda x: -x[1])]
                n_good = max(1, math.ceil(0.1 * len(ordered)))
                good, bad = ordered[:n_good], ordered[n_good:] + out
                new = {k: self._best([p[k] for p in good], [p[k] for p in bad], *r) for k, r in self.ranges.items()}
            self.asked += 1
            out.append(new)
        return out

    def _best(self, good: list[float], bad: list[float], low: float, high: float) -> float:
        likely, other = mixture(good, low, high), mixture(bad, low, high)
        draws = [self._draw(likely, low, high) for _ in range(self.draws)]
        return max(draws, key=lambda x: log_density(likely, x, low, high) - log_density(other, x, low, high))

    def _draw(self, parts: list[NormalDist], low: float, high: float) -> float:
        d = self.rng.choice(parts)
        a, b = d.cdf(low), d.cdf(high)
        p = min(max(a + self.rng.random() * (b - a), 1e-12), 1 - 1e-12)
        return min(max(d.inv_cdf(p), low), high)


def mixture(values: list[float], low: float, high: float) -> list[NormalDist]:
    """A normal at each value, as wide as the gap to its farther neighbour, and one over the whole range."""
    at = [low, *sorted(values), high]
    narrow = (high - low) / min(100, len(values) + 2)
    own = [NormalDist(m, min(max(m - at[i], at[i + 2] - m, narrow), high - low)) for i, m in enumerate(at[1:-1])]
    return [*own, NormalDist((low + high) / 2, high - low)]


def log_density(parts: list[NormalDist], x: float, low: float, high: float) -> float:
    return math.log(sum(d.pdf(x) / (d.cdf(high) - d.cdf(low)) for d in parts) / len(parts))


def candidates(frames: DataFrame) -> DataFrame:
    """Points that some trial may find."""
    return candidate_frames(frames, RANGES["rel_threshold"][0], RANGES["min_distance_um"])


def near_truth(found: DataFrame, gt_nodes: DataFrame) -> DataFrame:
    """Candidates (volume, t, place) with the annotated nodes near their rounded points, for all trials.

    Of each candidate the nearest nodes are kept, as many as a frame has candidates: an optimal matching needs no other,
    as one of those is always free. So what the trials read does not grow with the truth.
    """
    own = found.select("volume", "t", *[half_even(F.col(k)).cast("double").alias(k) for k in "zyx"], "place")
    most = found.groupBy("volume", "t").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1  # one row
    near = radius_join(own, gt_nodes, evaluation.MATCH_UM, [0], ["volume", "t", "place"], ["node_id"])
    near = near.select(F.col("volume_a").alias("volume"), F.col("t_a").alias("t"), F.col("place_a").alias("place"), F.col("node_id_b").alias("b_id"), "distance_um")
    rank = F.row_number().over(Window.partitionBy("volume", "t", "place").orderBy("distance_um", "b_id"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def truth_counts(gt_nodes: DataFrame, gt_edges: DataFrame, meta: DataFrame) -> DataFrame:
    """One row per volume: estimated nodes, true edges and divisions."""
    children = gt_edges.select("volume", "source_id", "target_id").distinct().groupBy("volume", "source_id").agg(F.count("*").alias("_n"))
    edges = children.groupBy("volume").agg(F.sum("_n").alias("n_edges"), F.count_if(F.col("_n") >= 2).alias("n_divisions"))
    return evaluation.estimated_nodes(gt_nodes.select("volume").distinct(), gt_nodes, meta, False).join(edges, "volume", "left")


def near_edges(gt_edges: DataFrame, near: DataFrame) -> DataFrame:
    """True edges, once each, both of whose ends are near a candidate: no trial finds another."""
    ends = near.select("volume", "b_id").distinct()
    out = gt_edges.select("volume", "source_id", "target_id").distinct()
    for k in ("source_id", "target_id"):
        out = out.join(ends.withColumnRenamed("b_id", k), ["volume", k], "left_semi")
    return out.select("volume", "source_id", "target_id")


def match_trials(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Nodes (trial, volume, t, place, head) with ``b_id``, the true node that each is matched with, or null.

    A task holds the pairs of one frame, once for all trials. Trials that have the same nodes in it share the solution.
    """
    cost = Objective.GAIN.infeasible(evaluation.MATCH_UM)

    def solve(own: pa.Table, pairs: pa.Table) -> pa.Table:
        own = own.sort_by([("trial", "ascending"), ("head", "ascending")])
        place, b, d = (pairs.column(c).to_numpy() for c in ("place", "b_id", "distance_um"))
        trial, points = own.column("trial").to_numpy(), own.column("place").to_numpy()
        top = int(max(place.max(initial=0), points.max(initial=0))) + 1
        found, none = np.zeros(len(points), np.int64), np.ones(len(points), bool)
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for number in np.unique(trial):
            first, last = np.searchsorted(trial, (number, number + 1))
            key = points[first:last].tobytes()
            if key not in known:
                order = np.full(top, -1)
                order[points[first:last]] = np.arange(last - first)
                a = order[place]
                held = a >= 0
                take = match_pairs(a[held], b[held], d[held], cost)
                known[key] = a[held][take], b[held][take]
            at, to = known[key]
            found[first + at], none[first + at] = to, False
        return own.append_column("b_id", pa.array(found, mask=none))

    # a number of parts that stays: pairs are few bytes but much work
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_frame = lambda df, *columns: df.select("volume", "t", *columns).repartition(parts, "volume", "t").groupBy("volume", "t")
    both = by_frame(nodes, "trial", "place", "head").cogroup(by_frame(near, "place", "b_id", "distance_um"))
    return both.applyInArrow(solve, "volume string, t long, trial long, place long, head long, b_id long")


def run_trials(
    found: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame, meta: DataFrame, trials: list[tuple[int, dict]], most: int = 500, min_track_length: int = 2, near: DataFrame | None = None, of_volume: DataFrame | None = None
) -> DataFrame:
    """One row per trial with its parameters, numbers of detections and tracks, pooled counts and scores.

    ``found``: ``candidates``; ``most``: points kept per frame, by score; ``near`` and ``of_volume``: what ``near_truth`` and
    ``truth_counts`` make, where it is there already; ``gt_edges`` may then be ``near_edges``. Volumes in which a trial has no
    track do not count for it, as its graph does not name them.
    """
    spark = found.sparkSession
    near = near_truth(found, gt_nodes) if near is None else near
    of_volume = truth_counts(gt_nodes, gt_edges, meta) if of_volume is None else of_volume
    numbers = {"trial": pa.array([i for i, _ in trials], pa.int64()), **{k: pa.array([p[k] for _, p in trials], pa.float64()) for k in RANGES}}
    params = spark.createDataFrame(pa.table(numbers), _PARAMS)
    held = found.join(F.broadcast(params), (F.col("score") >= F.col("rel_threshold")) & (F.col("clear_um") > F.col("min_distance_um")))  # at most 30 rows
    rank = F.row_number().over(Window.partitionBy("trial", "volume", "t").orderBy("place"))
    held = held.withColumn("_rank", rank).where(F.col("_rank") <= most) if most and most > 0 else held
    name = F.concat_ws("/", F.col("trial").cast("string"), "volume").alias("volume")
    node = (F.shiftleft(F.col("t"), 24) + F.col("place")).alias("node_id")
    points = held.select("trial", F.col("volume").alias("_own"), name, "t", "z", "y", "x", "max_link_um", node, "place")
    linked = link_blocks(points, RANGES["max_link_um"][1], "max_link_um").select("trial", F.col("_own").alias("volume"), "t", "place", "head")
    # heads are in the order of track numbers, by first frame and then first node
    n = F.count("*").over(Window.partitionBy("trial", "volume", "head"))
    nodes = linked.withColumn("_n", n).where(F.col("_n") >= min_track_length).drop("_n")
    matches = materialize(match_trials(nodes, near), "trial_matches")
    along = Window.partitionBy("trial", "volume", "head").orderBy("t")
    steps = matches.withColumns({"next_id": F.lead("b_id").over(along), "_at": F.row_number().over(along)})
    # one row for all nodes with the same pair of true nodes, so that a mapped edge counts once
    pairs = steps.groupBy("trial", "volume", F.when(F.col("next_id").isNotNull(), F.col("b_id")).alias("source_id"), F.when(F.col("b_id").isNotNull(), F.col("next_id")).alias("target_id"))
    pairs = pairs.agg(F.count("*").alias("_nodes"), F.count("b_id").alias("_matched"), F.count_if(F.col("_at") == 1).alias("_tracks"))
    truth = gt_edges.select("volume", "source_id", "target_id", F.lit(True).alias("_true")).distinct()
    of_trial = pairs.join(truth, ["volume", "source_id", "target_id"], "left").groupBy("trial", "volume").agg(
        F.sum("_nodes").alias("pred_nodes"), F.sum("_matched").alias("matched_nodes"), F.sum("_tracks").alias("tracks"), F.count("source_id").alias("n_mapped"), F.count("_true").alias("edge_tp")
    )
    rows = of_trial.join(of_volume, "volume").fillna(0).withColumns({
        "edge_fp": F.col("n_mapped") - F.col("edge_tp"), "edge_fn": F.col("n_edges") - F.col("edge_tp"),
        # tracks do not fork
        "div_tp": F.lit(0).cast("long"), "div_fp": F.lit(0).cast("long"), "div_fn": F.col("n_divisions"),
    })
    sums = rows.groupBy("trial").agg(*[F.sum(c).alias(c) for c in ("tracks", *evaluation.COUNTS)])
    n_points = linked.groupBy("trial").agg(F.count("*").alias("detections"))
    whole = params.join(n_points, "trial", "left").join(sums, "trial", "left").fillna(0)
    n, est = F.col("pred_nodes"), F.col("est_nodes")
    edge = evaluation.jaccard(F.col("edge_tp"), F.col("edge_fp"), F.col("edge_fn"))
    division = evaluation.jaccard(F.col("div_tp"), F.col("div_fp"), F.col("div_fn"))
    scored = whole.withColumns({"edge_jaccard": edge, "division_jaccard": division, "penalty": evaluation.penalty(n, est)})
    adjusted = F.col("edge_jaccard") * F.col("penalty")
    out = materialize(scored.withColumn("combined_score", 0.5 * adjusted + 0.5 * F.col("division_jaccard")), "trials")
    release(matches)
    return out


def calibrate(frames: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame, meta: DataFrame, trials: int = MOST_TRIALS, seed: int = 20260702, batch: int = 5, **options) -> DataFrame:
    """One row per trial with its parameters and scores, best first. ``batch``: trials asked for at once after the first ten."""
    sampler = ParzenSampler(RANGES, seed)
    found = materialize(candidates(frames), "candidates")
    whole = [materialize(df, "truth") for df in (gt_nodes.select("volume", "t", "z", "y", "x", "node_id"), gt_edges.select("volume", "source_id", "target_id"))]
    near, of_volume = materialize(near_truth(found, whole[0]), "near"), materialize(truth_counts(*whole, meta), "truth_counts")
    edges = materialize(near_edges(whole[1], near), "near_edges")
    release(*whole)
    rows: DataFrame | None = None
    number = 0
    while number < min(trials, MOST_TRIALS):
        asked = sampler.ask(min(sampler.startup if number == 0 else batch, min(trials, MOST_TRIALS) - number))
        numbered = list(enumerate(asked, number))
        done = run_trials(found, gt_nodes, edges, meta, numbered, near=near, of_volume=of_volume, **options)
        score = {r.trial: r.combined_score for r in done.select("trial", "combined_score").collect()}  # at most 30 rows
        for i, p in numbered:
            sampler.tell(p, score[i])
        rows = done if rows is None else rows.unionByName(done)
        number += len(asked)
    release(found, near, of_volume, edges)
    return rows.orderBy(F.col("combined_score").desc(), "trial")
