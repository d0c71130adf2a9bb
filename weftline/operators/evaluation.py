"""Graph evaluation: node matching, edge and division counts in two versions, scores, folds, ranking metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.assignment import Objective, match
from weftline.operators.graph import components, degrees, range_below
from weftline.operators.joins import map_edges, radius_join
from weftline.plans.storage import materialize

MATCH_UM = 7.0
#: Weight of the over-prediction adjustment and of divisions in the official-like score.
ADJUSTMENT, DIVISION_WEIGHT = 0.1, 0.1


def match_nodes(pred: DataFrame, truth: DataFrame, gate: float = MATCH_UM) -> DataFrame:
    """volume, t, pred_id, gt_id, distance_um: one-to-one per frame, greatest sum of (gate + 1 - distance)."""
    pairs = radius_join(pred, truth, gate, [0], ["volume", "t", "node_id"], ["node_id"])
    pairs = pairs.select(F.col("volume_a").alias("volume"), F.col("t_a").alias("t"), F.col("node_id_a").alias("a_id"), F.col("node_id_b").alias("b_id"), "distance_um")
    return match(pairs, gate, Objective.GAIN).select("volume", "t", F.col("a_id").alias("pred_id"), F.col("b_id").alias("gt_id"), "distance_um")


def _counted(volumes: DataFrame, **counts: DataFrame) -> DataFrame:
    """One row per volume with each count, 0 where there is nothing to count."""
    out = volumes.select("volume").distinct()
    for name, rows in counts.items():
        out = out.join(rows.groupBy("volume").agg(F.count("*").alias(name)), "volume", "left")
    return out.fillna(0, list(counts))


def edge_counts_v2(pred_edges: DataFrame, gt_edges: DataFrame, matches: DataFrame, volumes: DataFrame) -> DataFrame:
    """tp, fp, fn over the set of predicted edges mapped to ground truth; edges with an unmatched end do not count."""
    mapped = map_edges(pred_edges, matches).select("volume", F.col("gt_source").alias("source_id"), F.col("gt_target").alias("target_id")).distinct()
    truth = gt_edges.select("volume", "source_id", "target_id").distinct()
    key = ["volume", "source_id", "target_id"]
    return _counted(volumes, edge_tp=mapped.join(truth, key, "left_semi"), edge_fp=mapped.join(truth, key, "left_anti"), edge_fn=truth.join(mapped, key, "left_anti"))


def edge_counts_v1(pred_edges: DataFrame, gt_edges: DataFrame, matches: DataFrame, volumes: DataFrame) -> DataFrame:
    """As v2 for hits; a miss is false where the matched target (source) has known predecessors (successors)."""
    m = matches.select("volume", "pred_id", "gt_id")
    e = pred_edges.select("volume", "source_id", "target_id").distinct()
    e = e.join(m.select("volume", F.col("pred_id").alias("source_id"), F.col("gt_id").alias("gs")), ["volume", "source_id"], "left")
    e = e.join(m.select("volume", F.col("pred_id").alias("target_id"), F.col("gt_id").alias("gt")), ["volume", "target_id"], "left")
    truth = gt_edges.select("volume", "source_id", "target_id").distinct()
    hit = truth.select("volume", F.col("source_id").alias("gs"), F.col("target_id").alias("gt"), F.lit(True).alias("hit"))
    has_in = truth.select("volume", F.col("target_id").alias("gt"), F.lit(True).alias("has_in")).distinct()
    has_out = truth.select("volume", F.col("source_id").alias("gs"), F.lit(True).alias("has_out")).distinct()
    e = e.join(hit, ["volume", "gs", "gt"], "left").join(has_in, ["volume", "gt"], "left").join(has_out, ["volume", "gs"], "left")
    hits = e.where("hit").select("volume", "gs", "gt").distinct()
    # a mapped pair that is no true edge differs from each known predecessor and successor
    wrong = e.where("hit is null and (has_in or has_out)")
    missed = truth.join(hits.select("volume", F.col("gs").alias("source_id"), F.col("gt").alias("target_id")), ["volume", "source_id", "target_id"], "left_anti")
    return _counted(volumes, edge_tp=hits, edge_fp=wrong, edge_fn=missed)


def division_counts_v2(pred_edges: DataFrame, gt_edges: DataFrame, matches: DataFrame, volumes: DataFrame) -> DataFrame:
    """Divisions are nodes with two or more children; every unmatched predicted one is false."""
    pred = degrees(pred_edges.distinct()).where("out_degree >= 2").select("volume", F.col("node_id").alias("pred_id"))
    truth = degrees(gt_edges.distinct()).where("out_degree >= 2").select("volume", F.col("node_id").alias("gt_id"))
    hits = truth.join(matches.select("volume", "gt_id", "pred_id"), ["volume", "gt_id"]).join(pred, ["volume", "pred_id"], "left_semi")
    return _counted(volumes, div_tp=hits, div_fp=pred.join(hits, ["volume", "pred_id"], "left_anti"), div_fn=truth.join(hits, ["volume", "gt_id"], "left_anti"))


def division_counts_v1(pred_edges: DataFrame, gt_edges: DataFrame, matches: DataFrame, volumes: DataFrame) -> DataFrame:
    """Divisions have exactly two children. A true one is found if it or a predecessor is matched, each daughter's lineage
    is matched, and all those predicted nodes lie in one component with a fork, whose first fork is then paired."""
    pred_edges, gt_edges = pred_edges.select("volume", "source_id", "target_id").distinct(), gt_edges.select("volume", "source_id", "target_id").distinct()
    forks = degrees(pred_edges).where("out_degree = 2").select("volume", F.col("node_id").alias("pred_id"))
    truth = degrees(gt_edges).where("out_degree = 2").select("volume", F.col("node_id").alias("d"))
    comp = components(pred_edges).select("volume", F.col("node_id").alias("pred_id"), "component")
    first_fork = forks.join(comp, ["volume", "pred_id"]).groupBy("volume", "component").agg(F.min("pred_id").alias("first"))
    child = truth.join(gt_edges.select("volume", F.col("source_id").alias("d"), F.col("target_id").alias("child")), ["volume", "d"])
    # a matched node without predicted edges is a component of its own
    m = matches.select("volume", "gt_id", "pred_id").join(comp, ["volume", "pred_id"], "left").select("volume", "gt_id", F.coalesce("component", "pred_id").alias("value"))
    # what lies below a daughter matters by its first and last component alone, so no pairs of ancestors are listed
    below = range_below(m.withColumnRenamed("gt_id", "node_id"), gt_edges).withColumnRenamed("node_id", "child")
    before = truth.join(gt_edges.select("volume", F.col("target_id").alias("d"), F.col("source_id").alias("gt_id")), ["volume", "d"])
    at_or_before = truth.withColumn("gt_id", F.col("d")).unionByName(before).join(m, ["volume", "gt_id"])
    got = child.join(below, ["volume", "child"]).unionByName(at_or_before.select("volume", "d", F.lit(None).cast("long").alias("child"), F.col("value").alias("low"), F.col("value").alias("high")))
    per = got.groupBy("volume", "d").agg(F.count_distinct("child").alias("children"), F.max(F.col("child").isNull()).alias("pre"), F.min("low").alias("component"), F.max("high").alias("other"))
    found = per.where("children = 2 and pre and component = other").join(first_fork, ["volume", "component"])
    paired = found.select("volume", F.col("first").alias("pred_id")).distinct()
    has_out = gt_edges.select("volume", F.col("source_id").alias("gt_id")).distinct()
    wrong = forks.join(matches.select("volume", "pred_id", "gt_id"), ["volume", "pred_id"]).join(has_out, ["volume", "gt_id"], "left_semi").join(paired, ["volume", "pred_id"], "left_anti")
    return _counted(volumes, div_tp=found, div_fp=wrong, div_fn=truth.join(found.select("volume", "d"), ["volume", "d"], "left_anti"))


def jaccard(tp: Column, fp: Column, fn: Column) -> Column:
    """tp / (tp + fp + fn), 0 when there is nothing."""
    return F.coalesce(F.try_divide(tp.cast("double"), (tp + fp + fn).cast("double")), F.lit(0.0))


def adjusted(j: Column, n: Column, estimate: Column) -> Column:
    """v1: less by a tenth of the relative over-prediction, more when too few; at least 0, unchanged without estimate."""
    return F.when(estimate <= 0, j).otherwise(F.greatest(F.lit(0.0), j * (1 - ADJUSTMENT * F.coalesce(F.try_divide((n - estimate).cast("double"), estimate.cast("double")), F.lit(0.0)))))


def penalty(n: Column, estimate: Column) -> Column:
    """v2: the estimate over the number of nodes where that is greater, else 1."""
    return F.when(n > estimate, F.try_divide(estimate.cast("double"), n.cast("double"))).otherwise(F.lit(1.0))


def requested(j: Column, n: Column, estimate: Column) -> Column:
    """v1's other adjustment: as the penalty, but unchanged without nodes or estimate."""
    return F.when((n <= 0) | (estimate <= 0) | (n <= estimate), j).otherwise(j * F.try_divide(estimate.cast("double"), n.cast("double")))


def estimated_nodes(volumes: DataFrame, gt_nodes: DataFrame, meta: DataFrame, zero_falls_back: bool) -> DataFrame:
    """The metadata's estimate, or the count of ground-truth nodes without one (v1: also for 0)."""
    counts = _counted(volumes, gt_nodes=gt_nodes)
    e = counts.join(meta.select("volume", "estimated_number_of_nodes"), "volume", "left")
    own = F.expr("nullif(estimated_number_of_nodes, 0)") if zero_falls_back else F.col("estimated_number_of_nodes")
    return e.select("volume", "gt_nodes", F.coalesce(own, "gt_nodes").cast("long").alias("est_nodes"))


def evaluate(pred_nodes: DataFrame, pred_edges: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame, meta: DataFrame, version: int = 2, matches: DataFrame | None = None) -> DataFrame:
    """One row per ground-truth volume with all counts and scores of the version (1 or 2)."""
    volumes = gt_nodes.select("volume").distinct()
    matches = materialize(match_nodes(pred_nodes, gt_nodes), "matches") if matches is None else matches  # read by every count
    edges = (edge_counts_v1 if version == 1 else edge_counts_v2)(pred_edges, gt_edges, matches, volumes)
    divisions = (division_counts_v1 if version == 1 else division_counts_v2)(pred_edges, gt_edges, matches, volumes)
    sizes = _counted(volumes, pred_nodes=pred_nodes, matched_nodes=matches)
    rows = sizes.join(estimated_nodes(volumes, gt_nodes, meta, version == 1), "volume").join(edges, "volume").join(divisions, "volume")
    rows = rows.withColumns({"edge_jaccard": jaccard(F.col("edge_tp"), F.col("edge_fp"), F.col("edge_fn")), "division_jaccard": jaccard(F.col("div_tp"), F.col("div_fp"), F.col("div_fn"))})
    n, est, j, d = F.col("pred_nodes"), F.col("est_nodes"), F.col("edge_jaccard"), F.col("division_jaccard")
    if version == 2:
        rows = rows.withColumn("penalty", penalty(n, est)).withColumn("adjusted_edge_jaccard", j * F.col("penalty"))
        return rows.withColumn("combined_score", 0.5 * F.col("adjusted_edge_jaccard") + 0.5 * d)
    rows = rows.withColumns({"adjusted_edge_jaccard": adjusted(j, n, est), "requested_adjusted_edge_jaccard": requested(j, n, est)})
    return rows.withColumns({"official_like_score": F.col("adjusted_edge_jaccard") + DIVISION_WEIGHT * d, "requested_combined_score": 0.5 * F.col("requested_adjusted_edge_jaccard") + 0.5 * d})


COUNTS = ["pred_nodes", "gt_nodes", "est_nodes", "matched_nodes", "edge_tp", "edge_fp", "edge_fn", "div_tp", "div_fp", "div_fn"]


def aggregate(rows: DataFrame, version: int = 2) -> DataFrame:
    """One row: counts pooled; v1 weights adjusted edge values by their denominators, v2 adjusts the pooled value."""
    weight = F.col("edge_tp") + F.col("edge_fp") + F.col("edge_fn")
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * weight), F.sum(weight).cast("double")), F.lit(0.0)).alias(c)
    sums = [F.count("*").alias("datasets"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]]
    if version == 1:
        sums += [weighted("adjusted_edge_jaccard"), weighted("requested_adjusted_edge_jaccard")]
    out = rows.agg(*sums)
    out = out.withColumns({"edge_jaccard": jaccard(F.col("edge_tp"), F.col("edge_fp"), F.col("edge_fn")), "division_jaccard": jaccard(F.col("div_tp"), F.col("div_fp"), F.col("div_fn"))})
    d = F.col("division_jaccard")
    if version == 1:
        return out.withColumns({"official_like_score": F.col("adjusted_edge_jaccard") + DIVISION_WEIGHT * d, "requested_combined_score": 0.5 * F.col("requested_adjusted_edge_jaccard") + 0.5 * d})
    out = out.withColumn("penalty", penalty(F.col("pred_nodes"), F.col("est_nodes"))).withColumn("adjusted_edge_jaccard", F.col("edge_jaccard") * F.col("penalty"))
    return out.withColumn("combined_score", 0.5 * F.col("adjusted_edge_jaccard") + 0.5 * d)


def detector_recall(peaks: DataFrame, truth: DataFrame, gate: float = MATCH_UM) -> DataFrame:
    """Per volume the share of ground-truth nodes with a peak within the gate."""
    hit = radius_join(truth, peaks, gate, [0], ["volume", "node_id"], ["node_id"]).select(F.col("volume_a").alias("volume"), F.col("node_id_a").alias("node_id")).distinct()
    all_ = truth.groupBy("volume").agg(F.count("*").alias("gt_nodes"))
    hits = hit.groupBy("volume").agg(F.count("*").alias("hits"))
    return all_.join(hits, "volume", "left").fillna(0, ["hits"]).withColumn("recall", F.col("hits") / F.greatest("gt_nodes", F.lit(1)))


# ---------------------------------------------------------------- walk-forward folds


def folds_of(frames: DataFrame, train: int = 80, val: int = 20, stride: int = 10) -> DataFrame:
    """Per volume of ``frames`` (volume, total): fold, train and validation frames [start, end); a single fold over all
    frames where no window fits."""
    total, zero = F.col("total").cast("long"), F.lit(0).cast("long")
    start = F.explode(F.sequence(zero, F.greatest(total - train - val, zero), F.lit(stride).cast("long")))
    begun = frames.select("volume", total.alias("total"), start.alias("train_start"))
    fits = F.col("total") >= train + val
    cut = F.when(fits, F.col("train_start") + train).otherwise(F.greatest(zero, F.col("total") - val))
    end = F.when(fits, F.col("train_start") + train + val).otherwise(F.col("total"))
    return begun.select("volume", (F.col("train_start") / stride).cast("long").alias("fold"), "train_start", cut.alias("train_end"), cut.alias("val_start"), end.alias("val_end"))


def folds(spark, total: int = 100, train: int = 80, val: int = 20, stride: int = 10) -> DataFrame:
    """The folds of a given number of frames."""
    return folds_of(spark.createDataFrame([("", total)], "volume string, total long"), train, val, stride).drop("volume")


def fold_node_scores(folds_: DataFrame, pred: DataFrame, truth: DataFrame, gate: float = MATCH_UM) -> DataFrame:
    """Precision, recall and F1 of nodes per fold and volume. Points of all validation frames are matched in one pool,
    whatever their frames."""
    inside = lambda df: df.join(F.broadcast(folds_), (F.col("t") >= F.col("val_start")) & (F.col("t") < F.col("val_end"))).select("fold", "volume", "node_id", "z", "y", "x")
    p, g = inside(pred), inside(truth)
    # frames play no part: the fold takes their place in the join
    pool = lambda df: df.withColumn("t", F.col("fold"))
    pairs = radius_join(pool(p), pool(g), gate, [0], ["volume", "t", "node_id"], ["node_id"]).select(F.col("volume_a").alias("volume"), F.col("t_a").alias("t"), F.col("node_id_a").alias("a_id"), F.col("node_id_b").alias("b_id"), "distance_um")
    tp = match(pairs, gate, by_component=True).groupBy("volume", F.col("t").alias("fold")).agg(F.count("*").alias("tp"))
    n_p, n_g = (df.groupBy("volume", "fold").agg(F.count("*").alias(c)) for df, c in ((p, "n_pred"), (g, "n_gt")))
    rows = n_p.join(n_g, ["volume", "fold"], "full").join(tp, ["volume", "fold"], "left").fillna(0, ["n_pred", "n_gt", "tp"])
    rows = rows.withColumns({"precision": F.col("tp") / F.greatest("n_pred", F.lit(1)), "recall": F.col("tp") / F.greatest("n_gt", F.lit(1))})
    return rows.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def fold_edge_scores(folds_: DataFrame, pred_nodes: DataFrame, pred_edges: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Edge F1 per fold: edges mapped through the matches, whose source lies in the validation frames."""
    at = lambda edges, nodes, s: edges.join(nodes.select("volume", F.col("node_id").alias(s), "t"), ["volume", s]).join(F.broadcast(folds_), (F.col("t") >= F.col("val_start")) & (F.col("t") < F.col("val_end")))
    p = map_edges(at(pred_edges, pred_nodes, "source_id"), matches).select("fold", "volume", F.col("gt_source").alias("source_id"), F.col("gt_target").alias("target_id")).distinct()
    g = at(gt_edges, gt_nodes, "source_id").select("fold", "volume", "source_id", "target_id").distinct()
    tp = p.join(g, ["fold", "volume", "source_id", "target_id"], "left_semi")
    count = lambda df, c: df.groupBy("fold", "volume").agg(F.count("*").alias(c))
    rows = count(p, "n_pred").join(count(g, "n_gt"), ["fold", "volume"], "full").join(count(tp, "tp"), ["fold", "volume"], "left").fillna(0, ["n_pred", "n_gt", "tp"])
    rows = rows.withColumns({"precision": F.col("tp") / F.greatest("n_pred", F.lit(1)), "recall": F.col("tp") / F.greatest("n_gt", F.lit(1))})
    return rows.withColumn("edge_f1", _f1(F.col("precision"), F.col("recall")))


def summarize_folds(rows: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation and the central 95 % of a score over folds."""
    return rows.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.expr(f"percentile({value}, 0.025)").alias("low"), F.expr(f"percentile({value}, 0.975)").alias("high"))


# ---------------------------------------------------------------- ranking metrics


def _running(counts: DataFrame, keys: list[str], columns: list[str], descending: bool = False) -> DataFrame:
    """Per group the sums of columns over the rows before, by score ``s`` (one row per group and score), as ``_before_*``.

    Scores are dealt into ranges by quantiles: each range sums its own rows, and what the ranges before it hold, one row
    per range, is added. So no task sees all scores, also without keys.
    """
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.col("s").cast("double")
    bounds = sorted(set(counts.select(number.alias("s")).approxQuantile("s", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < number)) if bounds else F.lit(0)
    placed = counts.withColumn("_part", F.when(F.col("s").isNull(), -1).otherwise(part))
    order = F.col("s").desc_nulls_last() if descending else F.col("s").asc_nulls_first()
    inner = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(F.col("_part").desc() if descending else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    totals = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in columns])
    names = {k: f"_t_{k}" for k in [*keys, "_part"]}
    totals = totals.select(*[F.col(k).alias(t) for k, t in names.items()], *[F.coalesce(F.sum(c).over(outer), none).alias(f"_t_{c}") for c in columns])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(t)) for k, t in names.items()])
    sums = {f"_before_{c}": F.coalesce(F.sum(c).over(inner), none) + F.col(f"_t_{c}") for c in columns}
    return placed.join(totals, same).withColumns(sums).drop(*names.values(), *[f"_t_{c}" for c in columns], "_part")


def roc_auc(rows: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by mid-ranks per group; 0.5 with a single class. Equal scores are counted together first."""
    keys = keys or []
    counts = materialize(rows.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n")), "counts")
    ranked = _running(counts, keys, ["n"]).withColumn("mid", F.col("_before_n") + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy(*keys).agg(F.sum(F.col("mid") * F.col("p")).alias("r"), F.sum("p").alias("n_pos"), F.sum("n").alias("n"))
    pos, neg = F.col("n_pos").cast("double"), (F.col("n") - F.col("n_pos")).cast("double")
    return sums.select(*keys, F.col("n").alias("n_pairs"), "n_pos", F.coalesce(F.try_divide(F.col("r") - pos * (pos + 1) / 2, pos * neg), F.lit(0.5)).alias("auc"))


def average_precision(rows: DataFrame, score: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """Sum over distinct scores, descending, of precision times the gain in recall; 0 without positives."""
    keys = keys or []
    counts = materialize(rows.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n")), "counts")
    steps = _running(counts, keys, ["p", "n"], descending=True).withColumns({"tp": F.col("_before_p") + F.col("p"), "seen": F.col("_before_n") + F.col("n")})
    sums = steps.groupBy(*keys).agg(F.sum(F.col("tp") / F.col("seen") * F.col("p")).alias("a"), F.sum("p").alias("n_pos"))
    return sums.select(*keys, "n_pos", F.coalesce(F.try_divide(F.col("a"), F.col("n_pos").cast("double")), F.lit(0.0)).alias("average_precision"))


def cosine(a: str, b: str) -> Column:
    """Cosine of two float arrays, in doubles; 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def contrastive_loss(views: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Normalised cross-entropy over batches. ``views``: batch, i, pair (both views of one thing), embedding.

    Each view's partner competes with all other views of its batch; a batch joins itself, so its size bounds the pairs.
    Returns batch, n (views that have a partner) and their mean loss.
    """
    a, b = (views.select("batch", F.col("i").alias(f"{k}_i"), F.col("pair").alias(f"{k}_pair"), F.col("embedding").alias(f"{k}_e")) for k in "ab")
    s = a.join(b, "batch").where("a_i <> b_i").select("batch", "a_i", (F.col("a_pair") == F.col("b_pair")).alias("pos"), (cosine("a_e", "b_e") / temperature).alias("s"))
    most = F.max("s")  # taken out of the exponentials, so that no temperature overflows
    per = s.groupBy("batch", "a_i").agg(most.alias("m"), F.max(F.when(F.col("pos"), F.col("s"))).alias("p"), F.collect_list("s").alias("all"))
    total = F.aggregate(F.transform("all", lambda x: F.exp(x - F.col("m"))), F.lit(0.0), lambda x, y: x + y)
    return per.select("batch", (F.col("m") + F.log(total) - F.col("p")).alias("loss")).groupBy("batch").agg(F.count("loss").alias("n"), F.avg("loss").alias("loss"))
