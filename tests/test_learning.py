"""Pair model, augmented views and the box join, against plain forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import augment, evaluation, joins, pair_model, pairs
from weftline.plans.views import Views
from weftline.sources import chunked

DATA = "/root/testdata/sf0.001"


def plain_fit(x, y, weight, ridge):
    """Newton steps on arrays."""
    x = np.column_stack([np.ones(len(y)), (x - x.mean(0)) / x.std(0)])
    w, b, penalty = np.where(y == 1, weight, 1.0), np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (w * (y - p)) - penalty @ b)
    return b


def noisy_pairs(n=900, seed=3):
    rng = np.random.RandomState(seed)
    x = rng.normal(size=(n, 3)) * [5, 0.1, 900] + [3, 0, -40]
    y = (rng.rand(n) < 1 / (1 + np.exp(-(x[:, 0] - 3) / 3 + 8 * x[:, 1] + 1))).astype(int)
    return x, y


@pytest.mark.parametrize("weight,ridge", [(5.0, 1e-3), (1.0, 2.0)])
def test_weights_equal_a_plain_fit(spark, weight, ridge):
    x, y = noisy_pairs()
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "same": 7.0, "label": y})).repartition(5)
    odd = spark.createDataFrame([(None, 1.0, 1.0, 7.0, 1), (math.nan, 1.0, 1.0, 7.0, 0), (1.0, math.inf, 1.0, 7.0, 1), (1.0, 1.0, 1.0, 7.0, 2), (1.0, 1.0, 1.0, 7.0, None)], rows.schema)
    model = pair_model.fit(rows.unionByName(odd), ("a", "b", "c", "same"), positive_weight=weight, ridge=ridge)
    np.testing.assert_allclose([*model.weights[:4]], plain_fit(x, y, weight, ridge), rtol=1e-6, atol=1e-8)
    assert model.weights[4] == 0
    scored = odd.withColumn("score", model.probability()).collect()
    assert [r.score is None for r in scored] == [True, True, True, False, False]


def test_separable_pairs_settle_and_one_label_raises(spark):
    rows = spark.createDataFrame([(float(i), int(i >= 5)) for i in range(10)], "a double, label int")
    model = pair_model.fit(rows, ("a",))
    found = [r.p for r in rows.select("a", model.probability().alias("p")).orderBy("a").collect()]
    assert found == sorted(found) and found[4] < 0.5 < found[5]
    for bad in (rows.where("label = 1"), rows.limit(0)):
        with pytest.raises(ValueError, match="both labels"):
            pair_model.fit(bad, ("a",))


def test_held_out_pairs_are_ranked_as_by_their_source(spark):
    """Pairs with a known chance of being true; few of one volume of the given tables are, so these are drawn."""
    x, y = noisy_pairs(4000)
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y, "held": np.arange(len(y)) % 5 == 0, "volume": "v"}))
    model = pair_model.fit(rows.where("not held"), ("a", "b", "c"))
    held = rows.where("held").withColumns({"s": model.probability(), "best": -F.col("a") / 3 + 8 * F.col("b")})
    auc = [evaluation.roc_auc(held, c, "label", ["volume"]).first().auc for c in ("s", "best", "c")]
    assert auc[0] > 0.7 and auc[0] > auc[1] - 0.02 and auc[0] > auc[2] + 0.1


def test_query_fits_the_given_pairs(spark):
    from weftline.plans.queries import QUERIES

    v = Views(spark, DATA)
    scores = QUERIES["n4_pair_model"](spark, DATA).toPandas()
    rows = pairs.edge_pairs(v.det, v.gt_nodes, v.gt_edges).toPandas().merge(scores, on=["volume", "t", "i", "j", "label"])
    assert len(rows) == len(scores) and rows.is_val.any() and not rows.is_val.all()
    x, train = rows[[*pair_model.FEATURES]].to_numpy(dtype=float), ~rows.is_val.to_numpy()
    b = plain_fit(x[train], rows.label.to_numpy()[train], 5.0, 1e-3)
    z = np.column_stack([np.ones(len(x)), (x - x[train].mean(0)) / x[train].std(0)]) @ b
    np.testing.assert_allclose(rows.score, 1 / (1 + np.exp(-z)), atol=1e-6)


# ---------------------------------------------------------------- views of frames


def frames_of(spark, arrays):
    return spark.createDataFrame([(f"v{i}", i, list(a.shape), a.astype("<u2").tobytes()) for i, a in enumerate(arrays)], "volume string, t int, shape array<int>, data binary")


def arrays(n=12, shape=(2, 3, 5)):
    return [np.random.RandomState(i).randint(0, 1000, shape) for i in range(n)]


def test_views_are_turned_frames_and_come_back(spark):
    made = arrays()
    drawn = augment.draw(frames_of(spark, made), seed=4, views=3)
    views = augment.augment(drawn, scale=1000.0, noise=0.0, dtype="<f8").collect()
    assert len(views) == 36 and {r.turns for r in views} == {0, 1, 2, 3}
    for r in views:
        a = made[r.t] / 1000
        for axis, flip in enumerate((r.flip_z, r.flip_y, r.flip_x)):
            a = a[tuple(slice(None, None, -1) if flip and i == axis else slice(None) for i in range(3))]
        for _ in range(r.turns):
            a = a.transpose(0, 2, 1)[:, ::-1, :]
        assert list(a.shape) == r["shape"] and 0.7 <= r.gain <= 1.3 and abs(r.offset) <= 0.1
        np.testing.assert_allclose(np.frombuffer(r.data, "<f8").reshape(r["shape"]), np.clip(a * r.gain + r.offset, 0, 1), atol=1e-12)
    still = augment.draw(frames_of(spark, made), seed=4, views=3, gain=0.0, offset=0.0)
    for r in augment.undo(augment.augment(still, scale=1000.0, noise=0.0)).collect():
        assert (np.round(np.frombuffer(r.data, "<f4").reshape(r["shape"]) * 1000) == made[r.t]).all()
    middle = [a // 4 + 400 for a in made]
    for r in augment.undo(augment.augment(augment.draw(frames_of(spark, middle), 4), 1000.0, 0.0, "<f8"), "<f8", values=True).collect():
        np.testing.assert_allclose(np.frombuffer(r.data, "<f8").reshape(r["shape"]), middle[r.t] / 1000, atol=1e-12)


def test_draws_depend_on_no_partition_and_are_even(spark):
    frames = spark.range(4000).selectExpr("'v' volume", "cast(id as int) t")
    drawn = augment.draw(frames, seed=1)
    again = augment.draw(frames.repartition(7), seed=1)
    assert drawn.exceptAll(again).isEmpty() and not drawn.exceptAll(augment.draw(frames, seed=2)).isEmpty()
    shares = drawn.selectExpr("avg(int(flip_z)) z", "avg(int(flip_y)) y", "avg(int(flip_x)) x", "avg(int(turns > 0)) k", "avg(gain) g", "avg(offset) o", "count(distinct noise_seed) n").first()
    assert all(abs(shares[c] - 0.5) < 0.03 for c in "zyxk") and abs(shares.g - 1) < 0.02 and abs(shares.o) < 0.01 and shares.n > 3990
    assert augment.draw(frames, turn=False).where("turns <> 0").isEmpty()


def test_noise_is_seeded_and_clipped(spark):
    made = [np.full((4, 30, 30), 500)] * 2 + [np.zeros((4, 30, 30))]
    drawn = augment.draw(frames_of(spark, made), gain=0.0, offset=0.0)
    run = lambda df: {r.t: np.frombuffer(r.data, "<f4") for r in augment.augment(df, 1000.0, 0.02).collect()}
    a, b = run(drawn), run(drawn.repartition(3))
    assert all((a[t] == b[t]).all() for t in a) and (a[0] != a[1]).any()
    assert abs(a[0].std() - 0.02) < 0.002 and abs(a[0].mean() - 0.5) < 0.002 and a[2].min() == 0


def test_labels_follow_their_frames(spark):
    made = arrays(shape=(2, 5, 5))
    drawn = augment.draw(frames_of(spark, made), seed=9, views=2, gain=0.0, offset=0.0)
    points = chunked.frame_voxels(frames_of(spark, made)).where("v > 900")
    moved = augment.place(drawn.select("volume", "t", *augment.DRAWN), points, (2, 5, 5))
    seen = chunked.frame_voxels(augment.augment(drawn, 1.0, 0.0, "<f8").withColumn("data", F.col("data")), "<f8", ("view",)).where("v > 0")
    assert moved.count() == 2 * points.count()
    assert moved.join(seen, ["volume", "t", "view", "z", "y", "x"], "left_anti").isEmpty()
    assert moved.select("volume", "t", "view", "z", "y", "x").distinct().count() == moved.count()


# ---------------------------------------------------------------- boxes


def test_boxes_of_any_size_equal_brute_force(spark):
    rng = np.random.RandomState(8)
    nodes = [(f"v{rng.randint(2)}", int(rng.randint(2)), i, *(float(c) for c in rng.randint(-9, 9, 3) * 1.5)) for i in range(1500)]
    boxes = []
    for i in range(120):
        low = rng.randint(-11, 8, 3) * 1.5
        extent = np.exp(rng.uniform(-1, 4, 3)) if i % 3 else np.array([1.5, 4.0 ** rng.randint(-2, 4), 16.0])
        boxes.append((f"v{rng.randint(2)}", int(rng.randint(2)), i, *(float(b) for a, e in zip(low, extent, strict=True) for b in (a, a + e))))
    inf = math.inf
    boxes += [("v0", 0, 200, -inf, inf, -inf, inf, -inf, inf), ("v1", 1, 201, -inf, 0.0, -1e300, 1e300, 0.0, inf), ("v0", 1, 202, 0.0, 0.0, -9.0, 9.0, -9.0, 9.0), ("v0", 1, 203, 5.0, -5.0, -9.0, 9.0, -9.0, 9.0)]
    n = spark.createDataFrame(nodes, "volume string, t int, node_id int, z double, y double, x double")
    b = spark.createDataFrame(boxes, "volume string, t int, box_id int, z0 double, z1 double, y0 double, y1 double, x0 double, x1 double")
    expected = sorted((p[2], q[2]) for p in nodes for q in boxes if p[:2] == q[:2] and all(q[3 + 2 * k] <= p[3 + k] < q[4 + 2 * k] for k in range(3)))
    found = joins.nodes_in_box(n, b)
    assert sorted((r.node_id, r.box_id) for r in found.collect()) == expected and sum(i < 200 for _, i in expected) > 500
    assert found.columns == ["volume", "t", "node_id", "z", "y", "x", "box_id", "z0", "z1", "y0", "y1", "x0", "x1"]


def test_no_frame_meets_its_boxes_as_a_whole(spark):
    """5,000 unit boxes over 5,000 nodes of one frame: candidates stay near the results."""
    places = spark.range(5000).selectExpr("'v' volume", "0 t", "id node_id", "double(id % 17) z", "double(id div 17 % 17) y", "double(id div 289) x")
    boxes = places.selectExpr("volume", "t", "node_id box_id", *[s for k in "zyx" for s in (f"{k} - 0.4 {k}0", f"{k} + 0.4 {k}1")])
    found = joins.nodes_in_box(places, boxes)
    assert found.count() == 5000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"_c{k}" in line for line in plan.splitlines() if "z0" in line and "Join" in line for k in "zyx")
