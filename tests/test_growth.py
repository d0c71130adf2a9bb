"""Small tables that grow inside a query: what grows is neither broadcast nor left in one task."""

import numpy as np

from jobs import edge_dataset
from jobs._command import configuration
from weftline.functions.geometry import half_even
from weftline.operators import detection, pairs
from weftline.operators.assignment import Objective, match
from weftline.operators.joins import radius_join
from weftline.plans import calibration, views
from weftline.plans.queries import QUERIES
from weftline.plans.views import Views
from weftline.sources import chunked

DATA = "/root/testdata/sf0.001"
POINTS = "volume string, t long, z double, y double, x double, score double, node_id long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_points_exploded_to_cells_are_not_broadcast(spark):
    assert "Broadcast" not in plan(QUERIES["j5_frame_gaps"](spark, DATA))


def test_edge_pairs_do_not_broadcast_exploded_points(spark):
    v = Views(spark, DATA)
    points = v.det.select("volume", "t", "z", "y", "x", "score", "node_id")
    found = pairs.edge_pairs(points, v.gt_nodes.drop("user_id"), v.gt_edges)
    assert not [line for line in plan(found).splitlines() if "Broadcast" in line and "SQRT" in line]


def test_voxels_are_not_broadcast(spark):
    for name in ("v1_normalize_unit", "v2_normalize_z", "v3_normalize_clip", "v4_normalize_below", "v12_refine_centroids"):
        assert "Broadcast" not in plan(QUERIES[name](spark, DATA)), name


def test_frames_are_dealt_before_they_grow(spark):
    v = Views(spark, DATA)
    assert v.voxels.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (detection.box_maximum(v.voxels), detection.to_dense(v.voxels, (8, 16, 16)), detection.stitch(v.voxels)):
        assert plan(df).count("Exchange") == 1  # of suppliers


def test_tasks_hold_a_bounded_number_of_frames(spark, monkeypatch):
    monkeypatch.setattr(views, "FRAMES", 1)
    v = Views(spark, DATA)
    assert v.voxels.rdd.getNumPartitions() == max(int(spark.conf.get("spark.sql.shuffle.partitions")), v.table("supplier").count()) > 4
    assert plan(detection.stitch(v.voxels)).count("Exchange") == 1


def test_many_small_frames_share_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunked, "MOST_SINGLE", 3)
    frames = np.arange(2 * 7 * 12, dtype="<u2").reshape(2, 7, 1, 3, 4)
    for name, a in zip("ab", frames, strict=True):
        chunked.write_volume(tmp_path / f"{name}.zarr", a)
    parts = lambda **options: chunked.FrameReader({"path": str(tmp_path), **options}).partitions()
    assert [(p.volume, *p.frames) for p in parts()] == [("a", 0, 1, 2, 3, 4), ("a", 5, 6), ("b", 0, 1, 2, 3, 4), ("b", 5, 6)]
    assert [(p.volume, *p.frames) for p in parts(first_t="2", last_t="4")] == [("a", 2, 3), ("a", 4), ("b", 2, 3), ("b", 4)]
    reader = chunked.FrameReader({"path": str(tmp_path)})
    got = {(v, t): data for p in reader.partitions() for b in reader.read(p) for v, t, data in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True)}
    assert got == {(v, t): frames[i, t].tobytes() for i, v in enumerate("ab") for t in range(7)}
    monkeypatch.setattr(chunked, "PARTITION_BYTES", 2 * 24)
    assert {len(p.frames) for p in parts()} == {2, 1}


def test_centres_at_the_ends_of_runs(spark):
    rng = np.random.default_rng(5)
    frame = rng.integers(0, 9, (2, 5, 40))
    voxels = spark.createDataFrame([("v", 0, z, y, x, int(frame[z, y, x])) for z, y, x in np.ndindex(frame.shape)], "volume string, t long, z long, y long, x long, v long")
    points = np.array([[1.0, 2.0, float(x)] for x in (-1, 0, 12, 13, 15, 16, 18, 19, 31, 39, 90)])
    df = spark.createDataFrame([("v", 0, *p, 1.0, i) for i, p in enumerate(points.tolist())], POINTS)
    got = np.array([tuple(r) for r in detection.refine_centroids(df, voxels).orderBy("node_id").select("z", "y", "x").collect()])
    assert np.allclose(got, detection.centroids(frame, points))


def test_painting_equals_brute_force(spark):
    """Boxes over the edges of tiles, below 0 and beyond the shape; a later order wins, null orders lose."""
    rng = np.random.default_rng(3)
    places = [(float(z), float(y), float(x)) for z, y, x in rng.integers((-9, 245, 500), (70, 265, 520), (60, 3))]
    orders = [None if i % 9 == 0 else int(k) for i, k in enumerate(rng.permutation(60))]
    nodes = [("v", i % 2, *p, i + 100, o) for i, (p, o) in enumerate(zip(places, orders, strict=True))]
    df = spark.createDataFrame(nodes, "volume string, t long, z double, y double, x double, label long, ord long")
    for shape in (None, (60, 258, 516)):
        seen = {}
        for _, t, z, y, x, label, o in nodes:
            ranges = [range(max(0, int(c) - r), min(int(c) + r, s - 1 if shape else 10**6) + 1) for c, r, s in zip((z, y, x), (2, 4, 4), shape or (0, 0, 0), strict=True)]
            for at in np.stack(np.meshgrid(*ranges, indexing="ij"), axis=-1).reshape(-1, 3).tolist():
                key, mine = (t, *at), (-1 if o is None else o, None if o is None else label)
                seen[key] = max(seen.get(key, (-2, None)), mine, key=lambda m: m[0])
        got = {tuple(r[:4]): r[4] for r in detection.paint_labels(df, shape=shape).select("t", "z", "y", "x", "label").collect()}
        assert got == {k: m[1] for k, m in seen.items()}
        sums = {(r.t, r.label): (r.n, r.z, r.y, r.x) for r in detection.painted_sums(df, shape=shape).collect()}
        assert {k: tuple(int(c) for c in np.array([(1, *at) for (t, *at), m in seen.items() if (t, m[1]) == k]).sum(axis=0)) for k in sums} == sums
        assert set(sums) == {(k[0], m[1]) for k, m in seen.items()}


def test_edge_dataset_reads_its_pairs_from_what_is_held(spark):
    config = configuration("edge_dataset")
    tables = [edge_dataset._mapped(spark.read.parquet(f"{DATA}/events.parquet"), config[k], config) for k in ("points", "truth")]
    held = []
    rows = edge_dataset.dataset(*tables, config, held)
    try:
        # the joins of pairs are in the held plans only
        assert len(held) == 2 and "SQRT" not in rows._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert sorted(rows.collect()) == sorted(edge_dataset.dataset(*tables, config).collect())
    finally:
        for df in held:
            df.unpersist()


def test_calibration_keeps_as_many_true_nodes_as_matter(spark):
    """Truth far denser than candidates: few pairs are kept, and the matching is that of all pairs."""
    rng = np.random.default_rng(8)
    points = [("v", t, *p, 1.0, 9.0, i + 1) for t in range(3) for i, p in enumerate(rng.uniform(0, 20, (6, 3)).tolist())]
    nodes = [("v", t, *p, t * 1000 + i) for t in range(3) for i, p in enumerate(rng.uniform(0, 20, (300, 3)).tolist())]
    found = spark.createDataFrame(points, "volume string, t long, z double, y double, x double, score double, clear_um double, place long")
    truth = spark.createDataFrame(nodes, "volume string, t long, z double, y double, x double, node_id long")
    near = calibration.near_truth(found, truth)
    counts = [r[0] for r in near.groupBy("t", "place").agg({"*": "count"}).select("count(1)").collect()]
    assert max(counts) == 6
    own = found.select("volume", "t", *[half_even(found[k]).cast("double").alias(k) for k in "zyx"], "place")
    pairs_ = radius_join(own, truth, 7.0, [0], ["volume", "t", "place"], ["node_id"]).selectExpr("volume_a as volume", "t_a as t", "place_a as a_id", "node_id_b as b_id", "distance_um")
    assert pairs_.count() > 2 * near.count()
    solved = lambda df: sorted(tuple(r) for r in match(df, 7.0, Objective.GAIN).select("t", "a_id", "b_id").collect())
    assert solved(near.withColumnRenamed("place", "a_id")) == solved(pairs_)
