"""Golden cases, brute force and metamorphic checks of the lineage operators."""

from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions import geometry, solver
from weftline.operators import assignment, detection, divisions, evaluation, formatting, graph, joins, pairs, text_analysis, tracking
from weftline.plans.views import Views

POINTS = "volume string, t long, z double, y double, x double, score double, node_id long"
EDGES = "volume string, source_id long, target_id long"
DATA = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def at(um):
    """x in voxels of a place in micrometres."""
    return um / 0.40625


# ---------------------------------------------------------------- solver and matching


def best_by_enumeration(a, b, d, infeasible, gate):
    """Cardinality and cost of the best matching under the padded cost."""
    left, right = sorted(set(a)), sorted(set(b))
    cost = {(x, y): infeasible for x in left for y in right} | dict(zip(zip(a, b, strict=True), d, strict=True))
    if len(left) > len(right):
        left, right, cost = right, left, {(y, x): v for (x, y), v in cost.items()}
    plans = [list(zip(left, p, strict=True)) for p in permutations(right, len(left))]
    return min(sum(cost[q] for q in plan) for plan in plans), plans, cost


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4)), st.integers(0, 7).map(float), min_size=1, max_size=12))
def test_matching_is_optimal_for_both_objectives(pairs_):
    a, b = np.array([k[0] for k in pairs_]), np.array([k[1] for k in pairs_])
    d = np.array(list(pairs_.values()))
    for objective in assignment.Objective:
        infeasible = objective.infeasible(7.0)
        take = solver.match_pairs(a, b, d, infeasible)
        assert len(set(a[take])) == len(set(b[take])) == take.sum()
        least, _, _ = best_by_enumeration(a.tolist(), b.tolist(), d.tolist(), infeasible, 7.0)
        short = min(len(set(a)), len(set(b)))
        if objective is assignment.Objective.GAIN:
            assert d[take].sum() + infeasible * (short - take.sum()) == pytest.approx(least)
        else:
            assert take.sum() == short - round((least - least % 1) // infeasible) or d[take].sum() + infeasible * (short - take.sum()) == pytest.approx(least)


def test_objectives_differ(spark):
    c = spark.createDataFrame([("v", 0, 1, 10, 0.0), ("v", 0, 1, 11, 7.0), ("v", 0, 2, 10, 7.0), ("w", 0, 1, 1, 3.0)], "volume string, t long, a_id long, b_id long, distance_um double")
    assert rows(assignment.match(c, 7.0), "volume", "a_id", "b_id") == [("v", 1, 11), ("v", 2, 10), ("w", 1, 1)]
    assert rows(assignment.match(c, 7.0, assignment.Objective.GAIN), "volume", "a_id", "b_id") == [("v", 1, 10), ("w", 1, 1)]
    assert rows(assignment.match(c, 7.0, strict=True), "volume", "a_id", "b_id") == [("v", 1, 10), ("w", 1, 1)]


@pytest.mark.parametrize("gate", [4.0, 8.0, 12.0])
def test_match_equals_solver_on_whole_frames(spark, gate):
    v = Views(spark, DATA)
    j = joins.radius_join(v.det, v.det, gate, [1], ["volume", "t", "node_id"], ["node_id"])
    c = j.select(F.col("volume_a").alias("volume"), F.col("t_a").alias("t"), F.col("node_id_a").alias("a_id"), F.col("node_id_b").alias("b_id"), "distance_um")
    got = assignment.match(c, gate).agg(F.count("*"), F.sum("distance_um")).first()
    n = total = 0
    for _, p in c.toPandas().groupby(["volume", "t"]):
        left, right = np.unique(p.a_id), np.unique(p.b_id)
        cost = np.full((left.size, right.size), 1000 * gate + 1)
        cost[np.searchsorted(left, p.a_id), np.searchsorted(right, p.b_id)] = p.distance_um
        for r, k in solver.assign(cost):
            if cost[r, k] <= gate:
                n, total = n + 1, total + cost[r, k]
    assert got[0] == n and got[1] == pytest.approx(total)


# ---------------------------------------------------------------- geometry, joins


def test_half_even_and_prefix(spark):
    got = spark.createDataFrame([(2.5, "ab_c_d"), (3.5, "x"), (-0.5, "_y")], "v double, s string").select(geometry.half_even(F.col("v")).alias("r"), geometry.prefix_of("s").alias("p")).collect()
    assert [tuple(r) for r in got] == [(2, "ab"), (4, "x"), (0, "")]


@pytest.mark.parametrize("gaps", [[0], [1], [1, 2, 3]])
def test_radius_join_equals_brute_force(spark, gaps):
    rng = np.random.RandomState(5)
    pts = [("v" if i % 3 else "w", int(rng.randint(4)), float(rng.randint(-9, 9)), float(rng.randint(-30, 30)), float(rng.randint(-30, 30)), 0.5, i) for i in range(90)]
    df = spark.createDataFrame(pts, POINTS)
    got = rows(joins.radius_join(df, df, 7.0, gaps, ["node_id"], ["node_id"]), "node_id_a", "node_id_b")
    um = lambda p: np.array([p[2] * 1.625, p[3] * 0.40625, p[4] * 0.40625])
    assert got == sorted((p[6], q[6]) for p in pts for q in pts if p[0] == q[0] and q[1] - p[1] in gaps and np.linalg.norm(um(p) - um(q)) <= 7.0)


def test_required_columns(spark):
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        schema.require_columns(spark.createDataFrame([(1,)], "a long"), ["c", "a", "b"])


# ---------------------------------------------------------------- tracking


def gap_nodes(spark):
    return spark.createDataFrame([("v", 0, 0.0, 0.0, 0.0, 1.0, 1), ("v", 1, 0.0, 0.0, 2.0, 1.0, 2), ("v", 3, 2.0, 4.0, 6.0, 1.0, 3)], POINTS)


def test_gap_is_filled_with_the_midpoint(spark):
    nodes, edges = tracking.close_gaps(gap_nodes(spark), spark.createDataFrame([("v", 1, 2)], EDGES), 1, 6.0)
    assert rows(nodes.where("node_id = 4"), "t", "z", "y", "x", "score") == [(2, 1.0, 2.0, 4.0, 0.0)]
    assert rows(edges) == [("v", 1, 2), ("v", 2, 4), ("v", 4, 3)]


def test_no_edges_no_gap_closing(spark):
    nodes, edges = tracking.close_gaps(gap_nodes(spark), spark.createDataFrame([], EDGES), 1, 6.0)
    assert nodes.count() == 3 and edges.count() == 0


def test_longer_gaps(spark):
    nodes = spark.createDataFrame([("v", 0, 0.0, 0.0, 0.0, 1.0, 1), ("v", 1, 0.0, 0.0, 0.0, 1.0, 2), ("v", 4, 0.0, 0.0, 9.0, 1.0, 3)], POINTS)
    out, edges = tracking.close_gaps(nodes, spark.createDataFrame([("v", 1, 2)], EDGES), 2, 6.0)
    assert rows(out.where("node_id > 3"), "t", "x") == [(2, 3.0), (3, 6.0)] and edges.count() == 4


def test_tracks_are_components(spark):
    v = Views(spark, DATA)
    tracks = tracking.track(v.det, 8.0, 2, True)
    edges = tracking.link_frames(v.det.select("volume", "t", "z", "y", "x", "score", "node_id"), 8.0)
    same = edges.join(tracks.select("volume", F.col("node_id").alias("source_id"), F.col("track_id").alias("a")), ["volume", "source_id"]).join(tracks.select("volume", F.col("node_id").alias("target_id"), F.col("track_id").alias("b")), ["volume", "target_id"])
    assert same.count() == edges.count() and same.where("a <> b").count() == 0
    assert tracks.groupBy("volume", "track_id", "t").count().where("count > 1").count() == 0
    assert tracks.groupBy("volume").agg(F.max("track_id") == F.count_distinct("track_id")).collect()[0][1]


def test_partitions_do_not_matter(spark):
    v = Views(spark, DATA)
    one = rows(tracking.track(v.det.coalesce(1), 8.0, 2, True).select("volume", "node_id", "track_id"))
    assert one == rows(tracking.track(v.det.repartition(7), 8.0, 2, True).select("volume", "node_id", "track_id"))


def test_empty_detections(spark):
    empty = spark.createDataFrame([], POINTS)
    assert tracking.track(empty).count() == tracking.kalman_track(empty).count() == tracking.track_previous_present(empty, 8.0).count() == 0
    tracks = spark.createDataFrame([], "volume string, track_id long, t long, z double, y double, x double")
    assert formatting.graph_table(tracks).columns == schema.GRAPH_TABLE.fieldNames() and formatting.graph_table(tracks).count() == 0
    assert divisions.division_edges(tracks).count() == divisions.division_events(tracks).count() == 0


def test_kalman_follows_straight_paths(spark):
    """Five points per frame, steady motion and a little noise: five tracks."""
    rng = np.random.RandomState(42)
    pts = [("v", t, 40.0 * c + t * 1.0 + rng.normal(0, 0.5), 30.0 * c + rng.normal(0, 0.5), 2.0 * t + rng.normal(0, 0.5), 1.0, 5 * t + c) for t in range(40) for c in range(5)]
    pts += [("w", *p[1:6], p[6] + 1000) for p in pts if p[1] != 7]
    out = tracking.kalman_track(spark.createDataFrame(pts, POINTS).repartition(5), 15.0)
    assert out.groupBy("volume").agg(F.count_distinct("track_id")).select(F.sum("count(DISTINCT track_id)")).first()[0] == 10
    assert out.select(F.count_distinct("track_id")).first()[0] == 10
    assert out.select("track_id", (F.col("node_id") % 5).alias("c"), "volume").distinct().count() == 10


def test_kalman_matches_a_single_filter():
    bank, p, v, s = tracking.KalmanBank(50.0), np.zeros(3), np.zeros(3), 1.0
    bank.step(np.zeros((1, 3)))
    for z in np.random.RandomState(1).randn(6, 1, 3):
        bank.step(z)
        s += 1
        gain, moved = s / (s + 1), z[0] - (p + v)
        p, v, s = p + v + gain * moved, v + gain * moved, (1 - gain) * s
        assert np.allclose(bank.at[0], p) and np.allclose(bank.speed[0], v)


def test_memoryless_tracker_spans_missing_frames(spark):
    pts = [("v", t, 0.0, 0.0, float(t), 1.0, t) for t in (0, 1, 5, 6)]
    assert rows(tracking.track_previous_present(spark.createDataFrame(pts, POINTS), 8.0), "node_id", "track_id") == [(0, 1), (1, 1), (5, 1), (6, 1)]


def test_tracklets(spark):
    nodes = spark.createDataFrame([("v", t, 0.0, 0.0, 0.0, 1.0, n) for n, t in ((1, 0), (2, 1), (3, 2), (4, 2), (5, 3), (6, 0), (7, 0), (8, 1))], POINTS)
    edges = spark.createDataFrame([("v", 1, 2), ("v", 2, 3), ("v", 2, 4), ("v", 4, 5), ("v", 6, 8), ("v", 7, 8)], EDGES)
    table, labels = tracking.tracklets(nodes, edges)
    assert rows(table) == [("v", 1, 0, 1, 0), ("v", 2, 0, 0, 0), ("v", 3, 0, 0, 0), ("v", 4, 2, 2, 1), ("v", 5, 2, 3, 1)]
    assert {r.node_id: r.label for r in labels.collect()} == {1: 1, 2: 1, 3: 4, 4: 5, 5: 5, 6: 2, 7: 3, 8: None}


# ---------------------------------------------------------------- graphs and divisions


def test_components_and_closure_equal_brute_force(spark):
    rng = np.random.RandomState(3)
    e = {(str(rng.randint(2)), *sorted(rng.choice(40, 2, replace=False).tolist())) for _ in range(45)}
    edges = spark.createDataFrame([(v, a, b) for v, a, b in e], EDGES)
    for v in "01":
        parent = {n: n for x, a, b in e if x == v for n in (a, b)}
        for _ in parent:
            for x, a, b in e:
                if x == v:
                    parent[a] = parent[b] = min(parent[a], parent[b])
        assert rows(graph.components(edges).where(F.col("volume") == v), "node_id", "component") == sorted(parent.items())
        reach = {(a, b) for x, a, b in e if x == v}
        for _ in range(40):
            reach |= {(a, d) for a, b in reach for c, d in reach if b == c}
        assert rows(graph.closure(edges).where(F.col("volume") == v), "node_id", "reach_id") == sorted(reach)
        values = {n: n * 7 % 40 for n in range(0, 40, 3)}
        given = spark.createDataFrame([(x, n, value) for x in "01" for n, value in values.items()], "volume string, node_id long, value long")
        want = []
        for n in range(40):
            if below := [values[m] for m in {n} | {b for a, b in reach if a == n} if m in values]:
                want.append((n, min(below), max(below)))
        assert rows(graph.range_below(given, edges).where(F.col("volume") == v), "node_id", "low", "high") == want
    circle = spark.createDataFrame([("v", 1, 2), ("v", 2, 3), ("v", 3, 1)], EDGES)
    got = graph.range_below(spark.createDataFrame([("v", 1, 4), ("v", 3, 9)], "volume string, node_id long, value long"), circle, rounds=4)
    assert rows(got, "node_id", "low", "high") == [(1, 4, 9), (2, 4, 9), (3, 4, 9)]


def test_long_chain_extent(spark):
    nodes = spark.createDataFrame([("v", t, 0.0, 0.0, 0.0, 1.0, t) for t in range(120)], POINTS)
    edges = spark.createDataFrame([("v", t, t + 1) for t in range(119)], EDGES)
    assert rows(graph.lineage_extent(nodes, edges), "node_id", "age", "span") == [(t, t + 1, 120 - t) for t in range(120)]


def division_tracks(spark, age=12):
    """A parent of the given age that divides into two tracks 10 micrometres apart, each lasting three frames."""
    pts = [("v", 1, t, 0.0, 0.0, 0.0) for t in range(age)] + [("v", k, age + i, 0.0, 0.0, at(s)) for k, s in ((2, 5.0), (3, -5.0)) for i in range(3)]
    return spark.createDataFrame(pts, "volume string, track_id long, t long, z double, y double, x double")


def test_division_events_at_the_defaults(spark):
    events = divisions.division_events(division_tracks(spark)).collect()
    assert len(events) == 1 and len(events[0]) == 23
    e = events[0]
    assert (e.parent_t, e.daughter_1_track_id, e.daughter_2_track_id, e.parent_age_frames) == (11, 2, 3, 12)
    assert e.confidence == pytest.approx(0.35 * (1 - 5 / 8) + 0.3 * (1 - 0.53 / 10.53) + 0.2 * 12 / 16 + 0.15)
    assert divisions.division_events(division_tracks(spark, 9)).count() == 0
    edges = divisions.events_to_edges(divisions.division_events(division_tracks(spark)))
    assert rows(edges, "target_track_id", "distance_um") == [(2, 5.0), (3, 5.0)]


def test_division_edges_prefer_the_continuation(spark):
    pts = [("v", 1, 0, 0.0, 0.0, 0.0), ("v", 1, 1, 0.0, 0.0, at(6)), ("v", 2, 1, 0.0, 0.0, at(1)), ("v", 3, 1, 0.0, 0.0, at(2)), ("v", 4, 0, 0.0, 0.0, at(3)), ("v", 4, 1, 0.0, 0.0, at(3))]
    tracks = spark.createDataFrame(pts, "volume string, track_id long, t long, z double, y double, x double")
    got = rows(divisions.division_edges(tracks).where("source_track_id = 1"), "target_track_id", "child_kind")
    assert got == [(1, "continuation"), (2, "new_track")]
    assert rows(divisions.division_edges(tracks, require_new=False).where("source_track_id = 1"), "target_track_id") == [(1,), (2,)]


def test_persistence(spark):
    t = spark.createDataFrame([("v", 1, 0), ("v", 1, 1), ("v", 1, 3), ("v", 1, 3)], "volume string, track_id long, t long")
    assert rows(divisions.persistence(t, 2), "t", "persistence") == [(0, 2), (1, 1), (3, 1)]


# ---------------------------------------------------------------- formatting


def test_graph_table(spark):
    tracks = spark.createDataFrame([("b", 1, 4, 2.5, 3.5, -0.5), ("b", 1, 7, 0.0, 0.0, 0.0), ("a", 9, 0, 1.0, 1.0, 1.0), ("b", 2, 7, 9.0, 9.0, 9.0)], "volume string, track_id long, t long, z double, y double, x double")
    cut = spark.createDataFrame([("b", 1, 4, 2, 7, 0), ("b", 1, 4, 2, 7, 1), ("b", 1, 4, 1, 7, 2), ("b", 1, 4, 8, 7, 3)], "volume string, source_track_id long, source_t long, target_track_id long, target_t long, ordinal long")
    got = [tuple(r) for r in formatting.graph_table(tracks, cut).orderBy("id").collect()]
    assert got == [
        (0, "a", "node", 1, 0, 1, 1, 1, -1, -1), (1, "b", "node", 1, 4, 2, 4, 0, -1, -1), (2, "b", "node", 2, 7, 0, 0, 0, -1, -1), (3, "b", "edge", -1, -1, -1, -1, -1, 1, 2), (4, "b", "node", 3, 7, 9, 9, 9, -1, -1), (5, "b", "edge", -1, -1, -1, -1, -1, 1, 3),
    ]
    assert rows(formatting.division_node_edges(formatting.number_track_nodes(tracks), cut)[1]) == [("b", 1)]


# ---------------------------------------------------------------- evaluation


def points(spark, *nodes):
    return spark.createDataFrame([("v", t, 0.0, 0.0, float(n), 1.0, n) for n, t in nodes], POINTS)


def links(spark, *pairs_):
    return spark.createDataFrame([("v", a, b) for a, b in pairs_], EDGES)


def matched(spark, *pairs_):
    return spark.createDataFrame([("v", p, g) for p, g in pairs_], "volume string, pred_id long, gt_id long")


def counts(df):
    return tuple(df.drop("volume").first())


def test_one_matched_end_counts_in_version_1_only(spark):
    vol = spark.createDataFrame([("v",)], "volume string")
    gt, pred, m = links(spark, (1, 2)), links(spark, (10, 20)), matched(spark, (20, 2))
    assert counts(evaluation.edge_counts_v1(pred, gt, m, vol)) == (0, 1, 1) and counts(evaluation.edge_counts_v2(pred, gt, m, vol)) == (0, 0, 1)


def test_unannotated_and_triple_divisions(spark):
    vol = spark.createDataFrame([("v",)], "volume string")
    pred, m = links(spark, (10, 11), (10, 12), (10, 13)), matched(spark)
    assert counts(evaluation.division_counts_v2(pred, links(spark, (1, 2)), m, vol)) == (0, 1, 0)
    assert counts(evaluation.division_counts_v1(pred, links(spark, (1, 2)), m, vol)) == (0, 0, 0)


def test_division_version_1_pairs_lineages(spark):
    vol = spark.createDataFrame([("v",)], "volume string")
    gt = links(spark, (0, 1), (1, 2), (1, 3), (2, 4), (3, 5))
    # the fork is one frame late and the daughters are matched further on
    pred = links(spark, (10, 11), (11, 12), (11, 13), (12, 14), (13, 15))
    m = matched(spark, (10, 0), (14, 4), (15, 5))
    assert counts(evaluation.division_counts_v1(pred, gt, m, vol)) == (1, 0, 0)
    apart = links(spark, (10, 11), (11, 12), (11, 13), (12, 14), (16, 15))
    assert counts(evaluation.division_counts_v1(apart, gt, m, vol)) == (0, 0, 1)
    wrong = matched(spark, (11, 0), (14, 4))
    assert counts(evaluation.division_counts_v1(apart, gt, wrong, vol)) == (0, 1, 1)


def test_adjustments(spark):
    one = spark.range(1).select(F.lit(0.5).alias("j"), F.lit(80).alias("few"), F.lit(120).alias("many"), F.lit(100).alias("e"), F.lit(0).alias("zero"))
    c = F.col
    got = one.select(evaluation.adjusted(c("j"), c("few"), c("e")), evaluation.adjusted(c("j"), c("many"), c("zero")), evaluation.penalty(c("few"), c("e")), evaluation.penalty(c("many"), c("zero")), evaluation.requested(c("j"), c("many"), c("e")), evaluation.penalty(c("many"), c("e"))).first()
    assert [round(x, 6) for x in got] == [0.51, 0.5, 1.0, 0.0, round(0.5 / 1.2, 6), round(1 / 1.2, 6)]


def test_estimates(spark):
    gt = points(spark, (1, 0), (2, 0), (3, 1))
    meta = lambda e: spark.createDataFrame([("v", e)], "volume string, estimated_number_of_nodes long")
    got = [evaluation.estimated_nodes(gt, gt, meta(e), z).first().est_nodes for e, z in ((0, True), (0, False), (None, False), (7, True))]
    assert got == [3, 0, 3, 7]


def test_perfect_prediction_scores_one(spark):
    v = Views(spark, DATA)
    meta = v.gt_nodes.groupBy("volume").agg(F.count("*").alias("estimated_number_of_nodes"))
    for version, score in ((1, "requested_combined_score"), (2, "combined_score")):
        got = evaluation.evaluate(v.gt_nodes, v.gt_edges, v.gt_nodes, v.gt_edges, meta, version)
        total = evaluation.aggregate(got, version).first()
        assert total.edge_jaccard == 1.0 and total.edge_fp == total.edge_fn == 0
        assert {r["edge_jaccard"] for r in got.where("edge_tp > 0").collect()} == {1.0} and score in got.columns


def test_relabelled_nodes_score_the_same(spark):
    v = Views(spark, DATA)
    a = evaluation.evaluate(v.det, v.pred_edges, v.gt_nodes, v.gt_edges, v.gt_meta, 2)
    moved = v.det.withColumn("node_id", F.col("node_id") * 7 + 3).repartition(5)
    edges = v.pred_edges.withColumns({c: F.col(c) * 7 + 3 for c in ("source_id", "target_id")})
    b = evaluation.evaluate(moved, edges, v.gt_nodes, v.gt_edges, v.gt_meta, 2)
    assert rows(a, "volume", "matched_nodes", "pred_nodes") == rows(b, "volume", "matched_nodes", "pred_nodes")


def test_folds(spark):
    assert rows(evaluation.folds(spark)) == [(0, 0, 80, 80, 100)]
    assert evaluation.folds(spark, 100, 60, 20, 10).count() == 3
    assert rows(evaluation.folds(spark, 50, 60, 20, 10)) == [(0, 0, 30, 30, 50)]


def test_auc_and_average_precision(spark):
    scored = spark.createDataFrame([("a", 0.1, 0), ("a", 0.4, 0), ("a", 0.35, 1), ("a", 0.8, 1), ("b", 0.5, 1)], "g string, s double, y int")
    assert rows(evaluation.roc_auc(scored, "s", "y", ["g"]), "g", "auc") == [("a", 0.75), ("b", 0.5)]
    assert {r.g: round(r.average_precision, 6) for r in evaluation.average_precision(scored, "s", "y", ["g"]).collect()} == {"a": round(0.5 + 0.5 * 2 / 3, 6), "b": 1.0}


# ---------------------------------------------------------------- voxels


def blob(shape=(12, 40, 40), centres=((5, 12, 12), (6, 28, 24))):
    grid = np.stack(np.meshgrid(*[np.arange(n) for n in shape], indexing="ij"), axis=-1).astype(float)
    scale = np.array([1.625, 0.40625, 0.40625])
    out = sum(900 * np.exp(-(((grid - np.array(c)) * scale) ** 2).sum(axis=-1) / (2 * 2.0**2)) for c in centres)
    return (out + 20 + np.random.RandomState(0).rand(*shape) * 5).astype("<u2")


def test_detectors_find_blobs(spark):
    frame = blob()
    frames = spark.createDataFrame([("v", 0, list(frame.shape), bytearray(frame.tobytes()))], schema.FRAMES)
    found = detection.detect_frames(frames, detection.detect_v2, k=2, scales=((1.5, 4.0),), rel=0.1).orderBy(F.col("score").desc()).limit(2).collect()
    assert sorted((round(r.z), round(r.y), round(r.x)) for r in found) == [(5, 12, 12), (6, 28, 24)]
    first = detection.detect_frames(frames, detection.detect_v1, k=2, sigmas=(3.0, 4.0), least=1, most=2).collect()
    assert sorted((abs(r.z - 5) < 3, r.t) for r in first) == [(True, 0)] * 2
    assert detection.detect_frames(frames, detection.detect_v1, least=40, most=50).count() <= 50


def test_filters():
    a = np.random.RandomState(1).rand(6, 9, 8)
    by_hand = np.array([[[a[max(0, z - 1) : z + 2, max(0, y - 3) : y + 4, max(0, x - 3) : x + 4].max() for x in range(8)] for y in range(9)] for z in range(6)])
    assert (detection.maximum_filter(a, detection.box_offsets()) == by_hand).all()
    flat = np.full((5, 6, 7), 3.0)
    assert np.allclose(detection.gaussian_filter(flat, (1.0, 2.0, 0.5)), 3.0) and np.allclose(detection.gaussian_filter(flat, (9.0, 9.0, 9.0), "nearest"), 3.0)
    impulse = np.zeros(41)
    impulse[20] = 1
    out = detection.gaussian_filter(impulse, (2.0,))
    assert out.sum() == pytest.approx(1) and out[22] / out[20] == pytest.approx(np.exp(-0.5))
    assert len(detection.ball_offsets(3.2, (1.625, 1.625, 1.625))) == 27


def test_centroids_agree_in_both_forms(spark):
    v = Views(spark, DATA)
    dense = detection.to_dense(v.voxels, (8, 16, 16)).where("volume = 'v0' and t = 0").first()
    frame = np.frombuffer(dense.data, "<u2").reshape(dense.shape)
    points_ = np.array([[0.0, 0.0, 0.0], [4.0, 8.0, 8.0], [7.0, 15.0, 3.0]])
    df = spark.createDataFrame([("v0", 0, *p, 1.0, i) for i, p in enumerate(points_.tolist())], POINTS)
    got = np.array(rows(detection.refine_centroids(df, v.voxels), "node_id", "z", "y", "x"))[:, 1:]
    assert np.allclose(got, detection.centroids(frame, points_))


def test_flat_frames_normalize_to_zero(spark):
    flat = spark.createDataFrame([("v", 0, 0, 0, x, 5) for x in range(9)], "volume string, t long, z long, y long, x long, v long")
    for kind in ("unit", "z", "clip", "below"):
        assert {r.n for r in detection.normalize(flat, kind).collect()} == {0.0}
    assert (detection.normalize_unit(np.full((2, 2, 2), 7.0)) == 0).all()


def test_patch_grid_rejects_bad_sizes(spark):
    for shape, patch in (((64, 256, 256), (10, 10, 10)), ((10, 256, 256), (32, 128, 128))):
        with pytest.raises(ValueError):
            detection.patch_grid(spark, shape, patch)


def test_negatives_keep_their_distance(spark):
    v = Views(spark, DATA)
    c = v.det.select("volume", "t", F.col("node_id").alias("candidate_id"), *[(F.col(k) + 40).alias(k) for k in "zyx"])
    got = detection.negative_patches(c, v.det, 3, 32)
    near = got.join(v.det.select("volume", "t", *[F.col(k).alias(f"g{k}") for k in "zyx"]), ["volume", "t"]).where("abs(z - gz) + abs(y - gy) + abs(x - gx) < 32")
    assert got.count() > 0 and near.count() == 0 and got.groupBy("volume", "t").count().where("count > 3").count() == 0


# ---------------------------------------------------------------- text and statistics


def test_lines_and_paragraphs(spark):
    text = "Head\r\nsecond\r\rthird=1\nimport x\n\n\nlast?"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n"), (5, "a\n")], "doc_id long, text string")
    lines = text_analysis.lines(docs)
    body = text.replace("\r\n", "\n").replace("\r", "\n")
    for r in lines.where("doc_id = 1").collect():
        assert body[r.char_start : r.char_end] == r.line
    assert rows(lines.groupBy("doc_id").count()) == [(1, 8), (4, 1), (5, 1)]
    p = text_analysis.paragraphs(lines)
    assert rows(p.where("doc_id = 1"), "line_start", "line_end", "text") == [(1, 2, "Head\nsecond"), (4, 5, "third=1\nimport x"), (8, 8, "last?")]
    s = text_analysis.segments(text_analysis.classify(p.withColumn("section_type", F.lit("notebook_1"))))
    assert rows(s.where("doc_id = 1"), "segment_id", "paragraph_type") == [("seg_0001", "notebook_runtime_output"), ("seg_0002", "notebook_code_paste"), ("seg_0003", "notebook_runtime_output")]
    assert rows(text_analysis.section_blocks(s).where("doc_id = 1"), "line_start", "line_end", "n_segments") == [(1, 2, 1), (4, 5, 1), (8, 8, 1)]


def test_markers(spark):
    lines = text_analysis.lines(spark.createDataFrame([(1, "x\nA\nB\nA\nC\nx")], "doc_id long, text string"))
    markers = [{"name": "seq", "match": "sequence", "value": ["A", "C"]}, {"name": "first", "match": "exact", "value": "A"}, {"name": "after", "match": "exact", "value": "x", "after": "first"}, {"name": "ahead", "match": "lookahead", "value": "A", "next_prefix": "C"}]
    assert rows(text_analysis.find_markers(lines, markers), "seq", "first", "after", "ahead") == [(4, 2, 6, 4)]
    with pytest.raises(ValueError):
        text_analysis.find_markers(lines, [{"name": "no", "match": "exact", "value": "?"}], required=True)


def test_lines_in_sections(spark):
    docs = [(1, "x\nA\nB\nA\nC\nx"), (2, "A\nA"), (3, "x\ny\n"), (None, "A\nC"), (4, ""), (5, None)]
    lines = text_analysis.lines(spark.createDataFrame(docs, "doc_id long, text string"))
    markers = [{"name": "a", "match": "exact", "value": "A", "type": "a"}, {"name": "also", "match": "exact", "value": "A", "type": "lost"}, {"name": "x", "match": "exact", "value": "x", "after": "a", "type": "end"}]
    want = [(1, 1, "preamble", 1, 1), (1, 2, "a", 2, 5), (1, 3, "end", 6, 6), (2, 1, "a", 1, 2), (3, 1, "preamble", 1, 2)]
    columns = ("doc_id", "section_no", "section_type", "line_start", "line_end")
    placed = text_analysis.in_sections(lines, markers)
    assert rows(text_analysis.sections(lines, markers), *columns) == want
    assert rows(placed.groupBy(*columns[:3]).agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end")), *columns) == want
    keys = ("doc_id", "section_no", "section_type", "line_start", "line_end", "char_start", "char_end", "text")
    blank = F.col("line") == "B"
    assert rows(text_analysis.paragraphs(placed, blank=blank), *keys) == rows(text_analysis.paragraphs(lines, text_analysis.sections(lines, markers), blank=blank), *keys)
    found = {r.doc_id: (r.a, r.x) for r in text_analysis.find_markers(lines, markers).collect()}
    assert found == {1: (2, 6), 2: (1, None), 3: (None, None), None: (None, None)}
    # documents are shuffled, not their lines, and neither by a later step
    plan = text_analysis.paragraphs(placed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate") < plan.index("Exchange ")


def test_lexical_metrics_of_odd_runs(spark):
    import re

    texts = ["no no NO,no\tNo", "x1all 12all all12 all_ _no no1 1no", "\U0001d400no no\U0001d400 \U0001d7d8no \U0001d7d8\U0001d7d9", "İno can\u0130 no\u0301", "12 34 a 5 b6 _ __ _a \u3000 7\u00a08", "a  b \n c ?a? ¿ \U0001f600\U0001f600 …", "needs need needed requireds required", "ann aill", "1" * 30000 + " 2" + "_" * 30000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in text_analysis.lexical_metrics(docs).collect():
        t = re.findall(r"\w+|[^\w\s]", r.text)
        low = [x.lower() for x in t]
        cues = [sum(x in c for x in low) for c in (text_analysis.ABSOLUTE_CUES, text_analysis.NEGATION_CUES, text_analysis.MODAL_CUES)]
        kinds = [len(t), sum(any(c.isalpha() for c in x) for x in t), sum(x.isdecimal() for x in t), sum(not any(c.isalnum() for c in x) for x in t)]
        assert list(r)[2:] == [*kinds, r.text.count("?") + r.text.count("¿"), *cues], r.text[:40]


def test_tokens_equal_pythons(spark):
    import re

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("text")
    for r in docs.select("text", text_analysis.tokens(F.col("text")).alias("t")).collect():
        assert r.t == re.findall(r"\w+|[^\w\s]", r.text)


def test_lexical_metrics_equal_token_lists(spark):
    import re

    texts = ["", None, "All of IT, never; can't! no_no __ 12 ١٢ 3a ½ ¿qué? Every-day must\nNEED needs", "é ü_ _1 x" * 3, "don't dont NOT not1 any ANY"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in text_analysis.lexical_metrics(docs).collect():
        t = re.findall(r"\w+|[^\w\s]", r.text or "")
        low = [x.lower() for x in t]
        cues = [sum(x in c for x in low) for c in (text_analysis.ABSOLUTE_CUES, text_analysis.NEGATION_CUES, text_analysis.MODAL_CUES)]
        kinds = [len(t), sum(any(c.isalpha() for c in x) for x in t), sum(x.isdigit() for x in t), sum(not any(c.isalnum() for c in x) for x in t)]
        assert list(r)[2:] == [*kinds, (r.text or "").count("?") + (r.text or "").count("¿"), *cues]


def test_describe_and_names(spark):
    got = text_analysis.describe(spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,)], "v double"), "v").first()
    assert (got["count"], got["median"], round(got["p10"], 9), got["max"]) == (3, 2.0, 1.2, 4.0)
    assert text_analysis.describe(spark.createDataFrame([], "v double"), "v").first()["count"] == 0
    assert text_analysis.run_id("a" * 64, "b" * 64) == "trace_aaaaaaaaaaaa_bbbbbbbbbbbb"


def test_validation_subset(spark):
    v = lambda *names: spark.createDataFrame([(n,) for n in names], "volume string")
    assert [r.volume for r in pairs.validation_subset(v(*[f"a_{i}" for i in range(7)]), 3).orderBy("volume").collect()] == ["a_0", "a_3", "a_6"]
    two = v(*[f"a_{i}" for i in range(5)], *[f"b_{i}" for i in range(5)], "c_1")
    assert [r.volume for r in pairs.validation_subset(two, 5).orderBy("volume").collect()] == ["a_0", "a_2", "a_4", "b_0", "b_4"]
    assert pairs.validation_subset(v("a_1", "b_1"), 15).count() == 2
    assert rows(pairs.split_volumes(v("x", "y", "z"), mode="last_two"), "volume", "is_val") == [("x", False), ("y", True), ("z", True)]
