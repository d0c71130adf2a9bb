"""Calibration: trials against a plain rebuild of each, candidates against detection, the sampler."""

import random

import numpy as np
import pandas as pd
import pytest

from weftline.functions.solver import match_pairs
from weftline.operators import detection, tracking
from weftline.plans import calibration

DATA = "/root/testdata/sf0.001"
SCALE = np.array([1.625, 0.40625, 0.40625])
FRAMES = "volume string, t int, shape array<int>, data binary"
NODES = "volume string, t long, z double, y double, x double, node_id long"
CANDIDATES = "volume string, t long, z double, y double, x double, score double, clear_um double, place long"
EDGES = "volume string, source_id long, target_id long"


def painted(rng, points, shape=(8, 48, 48)):
    grid = np.stack(np.meshgrid(*[np.arange(n) for n in shape], indexing="ij"), axis=-1)
    frame = rng.uniform(90, 110, shape)
    for p in points:
        frame += rng.uniform(400, 900) * np.exp(-((((grid - p) * SCALE) ** 2).sum(axis=-1)) / (2 * 1.6**2))
    return frame.astype("<u2")


@pytest.fixture(scope="module")
def movie():
    """Two volumes of moving cells, a frame missing in one; frames, true nodes and edges."""
    rng = np.random.default_rng(11)
    frames, nodes, edges = [], [], []
    for volume in ("a_1", "b/2"):
        cells = rng.uniform((1, 6, 6), (7, 42, 42), (7, 3))
        for t in range(5):
            cells = cells + rng.normal(0, (0.4, 2.5, 2.5), cells.shape)
            if not (volume == "a_1" and t == 2):
                frames.append((volume, t, [8, 48, 48], painted(rng, cells).tobytes()))
            nodes += [(volume, t, float(round(p[0])), float(round(p[1])), float(round(p[2])), t * 100 + i) for i, p in enumerate(cells)]
            edges += [(volume, (t - 1) * 100 + i, t * 100 + i) for i in range(len(cells)) if t]
        edges.append((volume, 0, 101))  # a division
    return frames, nodes, edges


def graph_of(found, max_link, least):
    """Tracks of one volume: nodes (t, rounded place) and edges between consecutive points. ``found``: by frame."""
    tracks, active = [], []
    for t in sorted(found):
        points = found[t]
        pairs = [(i, j, float(np.sqrt((((tracks[k][-1][1] - p) * SCALE) ** 2).sum()))) for i, k in enumerate(active) for j, p in enumerate(points)]
        pairs = [q for q in pairs if q[2] <= max_link]
        take = match_pairs(*[np.array(c) for c in zip(*pairs, strict=True)], 1e6) if pairs else []
        own = {pairs[n][1]: active[pairs[n][0]] for n in np.flatnonzero(take)}
        now = []
        for j, p in enumerate(points):
            if j in own:
                tracks[own[j]].append((t, p))
                now.append(own[j])
            else:
                tracks.append([(t, p)])
                now.append(len(tracks) - 1)
        active = now
    kept = [k for k in tracks if len(k) >= least]
    nodes = [(t, np.rint(p)) for k in kept for t, p in k]
    at = np.cumsum([0, *map(len, kept)])
    edges = [(a + i, a + i + 1) for a, k in zip(at, kept, strict=False) for i in range(len(k) - 1)]
    return nodes, edges, len(kept)


def plain_trial(points, nodes, edges, estimates, max_link, least=2):
    """Counts and score of a trial. ``points``: volume -> frame -> places."""
    sums = dict.fromkeys(("detections", "tracks", "pred_nodes", "matched_nodes", "edge_tp", "edge_fp", "edge_fn", "div_fn", "est_nodes"), 0)
    for volume, found in points.items():
        pred, links, n_tracks = graph_of({t: p for t, p in found.items() if len(p)}, max_link, least)
        sums["detections"] += sum(map(len, found.values()))
        if not pred:
            continue
        truth = {i: (t, np.array([z, y, x])) for v, t, z, y, x, i in nodes if v == volume}
        pairs = [(i, j, float(np.sqrt((((p - q) * SCALE) ** 2).sum()))) for i, (t, p) in enumerate(pred) for j, (s, q) in truth.items() if s == t]
        to = {}
        for t in {t for t, _ in pred}:
            near = [q for q in pairs if pred[q[0]][0] == t and q[2] <= 7]
            take = match_pairs(*[np.array(c) for c in zip(*near, strict=True)], 8.0) if near else []
            to |= {near[n][0]: near[n][1] for n in np.flatnonzero(take)}
        own = {(a, b) for v, a, b in edges if v == volume}
        mapped = {(to[a], to[b]) for a, b in links if a in to and b in to}
        children = pd.Series([a for a, _ in own]).value_counts()
        for k, n in (("tracks", n_tracks), ("pred_nodes", len(pred)), ("matched_nodes", len(to)), ("edge_tp", len(mapped & own)), ("edge_fp", len(mapped - own)), ("edge_fn", len(own - mapped)), ("div_fn", int((children >= 2).sum())), ("est_nodes", estimates.get(volume, len(truth)))):
            sums[k] += n
    total = sums["edge_tp"] + sums["edge_fp"] + sums["edge_fn"]
    penalty = sums["est_nodes"] / sums["pred_nodes"] if sums["pred_nodes"] > sums["est_nodes"] else 1.0
    return sums | {"combined_score": 0.5 * penalty * (sums["edge_tp"] / total if total else 0)}


def test_candidates_hold_what_any_trial_detects(movie):
    rng = np.random.default_rng(2)
    noise = [rng.integers(0, 1000, (10, 120, 120)).astype("<u2"), rng.integers(0, 4, (6, 80, 84)).astype("<u2"), np.full((5, 40, 40), 7, "<u2")]
    for frame in [np.frombuffer(data, "<u2").reshape(shape) for _, _, shape, data in movie[0][:3]] + noise:
        points, scores, clear = detection.candidates_v2(frame, 0.03, (2.5, 4.0))
        seen = set()
        for rel in (0.03, 0.041, 0.06, 0.2):
            for radius in (2.5, 2.8, 3.3, 3.63, 4.0):
                want, want_scores = detection.detect_v2(frame, rel=rel, radius_um=radius)
                keep = (scores >= rel) & (clear > radius)
                assert np.array_equal(points[keep], want) and np.array_equal(scores[keep], want_scores)
                seen.add(len(want))
        assert frame is not noise[0] or len(seen) > 6


def test_trials_equal_a_plain_rebuild(spark, movie):
    frames, nodes, edges = movie
    table = spark.createDataFrame(frames, FRAMES)
    meta = spark.createDataFrame([("a_1", 12)], "volume string, estimated_number_of_nodes long")
    trials = [(i, {"rel_threshold": r, "min_distance_um": d, "max_link_um": g}) for i, (r, d, g) in enumerate([(0.03, 2.5, 6.0), (0.06, 4.0, 10.0), (0.045, 3.2, 8.0), (0.05, 3.7, 6.5)])]
    for most in (500, 4):
        got = {r.trial: r for r in calibration.run_trials(calibration.candidates(table), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), meta, trials, most).collect()}
        assert len(got) == len(trials)
        for i, p in trials:
            points = {}
            for volume, t, shape, data in frames:
                points.setdefault(volume, {})[t] = detection.detect_v2(np.frombuffer(data, "<u2").reshape(shape), rel=p["rel_threshold"], radius_um=p["min_distance_um"], most=most)[0]
            want = plain_trial(points, nodes, edges, {"a_1": 12}, p["max_link_um"])
            assert {k: getattr(got[i], k) for k in want if k != "combined_score"} == {k: v for k, v in want.items() if k != "combined_score"}, (i, most)
            assert got[i].combined_score == pytest.approx(want["combined_score"]) and want["edge_tp"] > 0


def test_links_span_absent_frames_and_single_points_go(spark):
    found = spark.createDataFrame([("v", 0, 1.0, 1.0, 1.0, 1.0, 9.0, 1), ("v", 2, 1.0, 1.0, 2.0, 1.0, 9.0, 1), ("v", 2, 5.0, 90.0, 90.0, 0.9, 9.0, 2)], CANDIDATES)
    nodes = spark.createDataFrame([("v", 0, 1.0, 1.0, 1.0, 10), ("v", 2, 1.0, 1.0, 2.0, 11), ("w", 0, 1.0, 1.0, 1.0, 12)], NODES)
    meta = spark.createDataFrame([("v", 5)], "volume string, estimated_number_of_nodes long")
    trials = [(3, {"rel_threshold": 0.03, "min_distance_um": 3.0, "max_link_um": 8.0}), (4, {"rel_threshold": 2.0, "min_distance_um": 3.0, "max_link_um": 8.0})]
    some, none = sorted(calibration.run_trials(found, nodes, spark.createDataFrame([("v", 10, 11)], EDGES), meta, trials).collect())
    assert (some.detections, some.tracks, some.pred_nodes, some.edge_tp, some.edge_fn, some.est_nodes, some.combined_score) == (3, 1, 2, 1, 0, 5, 0.5)
    assert (none.trial, none.detections, none.tracks, none.pred_nodes, none.combined_score) == (4, 0, 0, 0, 0.0)


def test_sampler_closes_in_on_the_best():
    best = {"rel_threshold": 0.041, "min_distance_um": 3.1, "max_link_um": 9.0}
    width = {k: b - a for k, (a, b) in calibration.RANGES.items()}
    off = lambda p: sum(((p[k] - best[k]) / width[k]) ** 2 for k in best)
    late, early = [], []
    for seed in range(8):
        s = calibration.ParzenSampler(calibration.RANGES, seed)
        for n in (10, 5, 5, 5, 5):
            asked = s.ask(n)
            assert all(a <= p[k] <= b for p in asked for k, (a, b) in calibration.RANGES.items())
            for p in asked:
                s.tell(p, -off(p))
        early += [off(p) for p, _ in s.told[:10]]
        late += [off(p) for p, _ in s.told[20:]]
    assert np.mean(late) < 0.6 * np.mean(early)
    a, b = (calibration.ParzenSampler(calibration.RANGES, 7) for _ in range(2))
    assert a.ask(3) == b.ask(3)


def test_mixture_is_a_density():
    rng = random.Random(1)
    parts = calibration.mixture([rng.uniform(2, 5) for _ in range(6)], 2.0, 5.0)
    x = np.linspace(2, 5, 2001)
    y = np.exp([calibration.log_density(parts, v, 2.0, 5.0) for v in x])
    assert np.trapezoid(y, x) == pytest.approx(1.0, abs=1e-3)


def test_query_searches_all_trials(spark):
    from weftline.plans import queries

    rows = queries.QUERIES["x3_calibration"](spark, DATA).collect()
    assert sorted(r.trial for r in rows) == list(range(30))
    assert [r.combined_score for r in rows] == sorted((r.combined_score for r in rows), reverse=True) and rows[0].edge_tp > 0


@pytest.mark.parametrize("block", (1, 2, 3, 128))
def test_links_by_blocks_equal_the_tracker(spark, block):
    """Tracks through several blocks, over absent frames, with a gate for each volume."""
    rng = np.random.default_rng(5)
    rows = []
    for volume, gate in (("u", 4.0), ("v", 9.0)):
        cells = rng.uniform(0, 40, (9, 3)) / SCALE
        for t in range(11):
            cells = cells + rng.normal(0, 1.5, cells.shape) / SCALE
            if t not in (4, 5, 8):
                rows += [(volume, t, *p, 1.0, (t << 24) + i, gate) for i, p in enumerate(cells[rng.random(9) < 0.8].tolist())]
    points = spark.createDataFrame(rows, "volume string, t long, z double, y double, x double, score double, node_id long, own double")
    tracks = tracking.track_previous_present(points.drop("own").join(points.select("volume", "own").distinct(), "volume"), 10.0, 1, "own").toPandas()
    want = tracks.assign(head=tracks.groupby(["volume", "track_id"]).node_id.transform("min")).set_index(["volume", "node_id"])["head"].to_dict()
    got = tracking.link_blocks(points, 10.0, "own", block).toPandas()
    assert got.set_index(["volume", "node_id"])["head"].to_dict() == want and len(got) == len(rows)
    assert 2 < len(set(want.values())) < len(rows) / 2 and sorted(got.columns) == sorted([*points.columns, "head"])


def test_a_batch_of_trials_takes_few_jobs(spark):
    """Jobs of a batch wait for each other: tracks within a block take no rounds, and frames no job of their own."""
    points = [("v", t, 4.0, 8.0 + 30 * i, 8.0 + t, 1.0, 9.0, i + 1) for t in range(12) for i in range(3)]
    found = spark.createDataFrame(points, CANDIDATES)
    nodes = spark.createDataFrame([("v", t, 4.0, 8.0 + 30 * i, 8.0 + t, 100 * t + i) for t in range(12) for i in range(3)], NODES)
    edges = spark.createDataFrame([("v", 100 * t + i, 100 * t + 100 + i) for t in range(11) for i in range(3)], EDGES)
    meta = spark.createDataFrame([("v", 36)], "volume string, estimated_number_of_nodes long")
    near, of_volume = calibration.near_truth(found, nodes).cache(), calibration.truth_counts(nodes, edges, meta).cache()
    near.count(), of_volume.count()
    trials = [(i, {"rel_threshold": 0.04, "min_distance_um": 3.0, "max_link_um": 6.0 + i}) for i in range(3)]
    spark.sparkContext.setJobGroup("few", "a batch")
    try:
        rows = calibration.run_trials(found, nodes, edges, meta, trials, near=near, of_volume=of_volume).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        near.unpersist(), of_volume.unpersist()
    assert [(r.detections, r.tracks, r.edge_tp, r.edge_fp, r.edge_fn, r.combined_score) for r in rows] == [(36, 3, 33, 0, 0, 0.5)] * 3
    assert 0 < jobs < 40, jobs
