"""Training pairs: labelled candidate pairs, samples, splits and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.geometry import prefix_of
from weftline.operators.joins import nearest_join, radius_join, track_successor
from weftline.operators.ranks import hash_ranked, number_rows
from weftline.schema import SCALE

PAIR_GATE, MATCH_GATE = 12.0, 7.0


def edge_pairs(detections: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame, gate: float = PAIR_GATE, match_gate: float = MATCH_GATE) -> DataFrame:
    """Next-frame pairs with features d, dz, dy, dx (micrometres, first minus second), both scores and the label."""
    columns = ["volume", "t", "node_id", "z", "y", "x", "score"]
    pairs = radius_join(detections, detections, gate, [1], columns, columns)
    m = nearest_join(detections, gt_nodes, match_gate).select("volume", "node_id", F.col("match_id"))
    for s in "ab":
        pairs = pairs.join(m.select(F.col("volume").alias("volume_a"), F.col("node_id").alias(f"node_id_{s}"), F.col("match_id").alias(f"gt_{s}")), ["volume_a", f"node_id_{s}"])
    truth = gt_edges.select(F.col("volume").alias("volume_a"), F.col("source_id").alias("gt_a"), F.col("target_id").alias("gt_b"), F.lit(1).alias("label")).distinct()
    pairs = pairs.join(truth, ["volume_a", "gt_a", "gt_b"], "left")
    delta = [((F.col(f"{k}_a") - F.col(f"{k}_b")) * F.lit(v)).alias(f"d{k}") for k, v in SCALE.items()]
    return pairs.select(F.col("volume_a").alias("volume"), F.col("t_a").alias("t"), F.col("node_id_a").alias("i"), F.col("node_id_b").alias("j"), F.col("distance_um").alias("d"), *delta, F.col("score_a").alias("score_i"), F.col("score_b").alias("score_j"), F.coalesce("label", F.lit(0)).alias("label"))


def hash_rank(keys: list[Column], group: list[str], seed: int) -> Column:
    """Rank in the group by an md5 of the keys, so that other engines can repeat it."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary"))
    return F.row_number().over(Window.partitionBy(*group).orderBy(h))


def sample_negatives(pairs: DataFrame, ratio: int = 5, seed: int = 0) -> DataFrame:
    """All positives and at most ``ratio`` negatives per positive of a volume; volumes without positives go."""
    keys = [F.col("volume"), F.col("i").cast("string"), F.col("j").cast("string")]
    n_pos = pairs.groupBy(F.col("volume").alias("_v")).agg(F.sum("label").alias("_pos")).where("_pos > 0")  # one row per volume
    negatives = hash_ranked(pairs.where("label = 0"), keys, ["volume"], seed, "_rank")
    rows = pairs.where("label = 1").withColumn("_rank", F.lit(0).cast("long")).unionByName(negatives)
    return rows.join(n_pos, F.col("volume").eqNullSafe(F.col("_v"))).where(f"_rank <= {ratio} * _pos").drop("_v", "_pos", "_rank")


def patch_index(pairs: DataFrame) -> DataFrame:
    """Each endpoint once per volume, with its patch number from 0."""
    ends = pairs.select("volume", F.explode(F.array("i", "j")).alias("node_id")).distinct()
    numbered = number_rows(ends.withColumn("_part", F.shiftright("node_id", 16)), ["volume"], ["_part"], ["node_id"], "patch_id")
    return numbered.select("volume", "node_id", (F.col("patch_id") - 1).alias("patch_id"))


def pseudo_pairs(tracks: DataFrame, gate: float = PAIR_GATE, negatives: int = 5, seed: int = 0) -> DataFrame:
    """The track's own successor as positive and, for sources that have one, a few nearby points of other tracks."""
    pos = track_successor(tracks).groupBy("volume", F.col("node_id").alias("i")).agg(F.min("next_id").alias("j")).withColumn("label", F.lit(1))
    columns = ["volume", "node_id", "track_id"]
    near = radius_join(tracks, tracks, gate, [1], columns, columns).where("track_id_a <> track_id_b").select(F.col("volume_a").alias("volume"), F.col("node_id_a").alias("i"), F.col("node_id_b").alias("j"))
    near = near.join(pos.select("volume", "i"), ["volume", "i"], "left_semi")
    rank = hash_rank([F.col("volume"), F.col("i").cast("string"), F.col("j").cast("string")], ["volume", "i"], seed)
    neg = near.withColumn("_rank", rank).where(F.col("_rank") <= negatives).select("volume", "i", "j", F.lit(0).alias("label"))
    return pos.select("volume", "i", "j", "label").unionByName(neg)


def contrarian_pairs(tracks: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame, gate: float = MATCH_GATE) -> DataFrame:
    """True edges as pseudo nodes (positive), and the pseudo track's differing successor of the source (negative)."""
    near = nearest_join(gt_nodes, tracks, gate).where("match_id >= 0")
    m = lambda s: near.select("volume", F.col("node_id").alias(f"{s}_id"), F.col("match_id").alias(s[0]))
    mapped = gt_edges.select("volume", "source_id", "target_id").distinct().join(m("source"), ["volume", "source_id"]).join(m("target"), ["volume", "target_id"])
    pos = mapped.select("volume", F.col("s").alias("i"), F.col("t").alias("j"), F.lit(1).alias("label"))
    nxt = track_successor(tracks).groupBy("volume", F.col("node_id").alias("s")).agg(F.min("next_id").alias("k"))
    neg = mapped.join(nxt, ["volume", "s"]).where("k <> t").select("volume", F.col("s").alias("i"), F.col("k").alias("j"), F.lit(0).alias("label"))
    return pos.unionByName(neg)


def sample_shard(patches: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """All patches whose greatest heat exceeds .5, and negatives by hash up to the budget of each shard."""
    p = patches.withColumn("positive", F.coalesce(F.col("max_heat") > 0.5, F.lit(False)))
    n_pos = p.groupBy(F.col("shard").alias("_s")).agg(F.count_if("positive").alias("_pos"))
    negatives = hash_ranked(p.where("not positive"), [F.col("shard").cast("string"), F.col("patch_id").cast("string")], ["shard"], seed, "_rank")
    kept = negatives.join(n_pos, F.col("shard").eqNullSafe(F.col("_s"))).where(F.col("_rank") <= F.greatest(F.lit(budget) - F.col("_pos"), F.lit(0)))
    return p.where("positive").unionByName(kept.drop("_s", "_pos", "_rank"))


def sample_ratio(rows: DataFrame, key: str, label: str, n: int, seed: int = 0) -> DataFrame:
    """About n rows in the class ratio of the table: floor(n · share) of each class by hash, all if there are fewer."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_k"))
    total = sizes.agg(F.sum("_k").alias("_all"))
    quota = sizes.join(F.broadcast(total)).select(F.col(label).alias("_l"), F.floor(F.lit(float(n)) * F.col("_k") / F.col("_all")).alias("_quota"))
    ranked = hash_ranked(rows, [F.col(key).cast("string")], [label], seed, "_rank")
    return ranked.join(quota, F.col(label).eqNullSafe(F.col("_l"))).where(F.col("_rank") <= F.col("_quota")).drop("_rank", "_l", "_quota")


def split_volumes(volumes: DataFrame, fraction: float = 0.2, mode: str = "first") -> DataFrame:
    """volume, is_val: the first max(1, floor(n · fraction)) sorted volumes, or the last two (``last_two``)."""
    v = volumes.select("volume").distinct()
    n = v.agg(F.count("*").alias("_n"))
    ranked = v.withColumn("_rank", F.row_number().over(Window.orderBy("volume"))).join(F.broadcast(n))  # one row per volume
    held = F.col("_rank") > F.col("_n") - 2 if mode == "last_two" else F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))
    return ranked.select("volume", held.alias("is_val"))


def temporal_split(rows: DataFrame, train_end: int = 80, total: int = 100) -> DataFrame:
    """Adds split: train before ``train_end``, val up to ``total``; later frames go."""
    if not 0 < train_end < total:
        raise ValueError("train_end must lie between 0 and total")
    return rows.where((F.col("t") >= 0) & (F.col("t") < total)).withColumn("split", F.when(F.col("t") < train_end, "train").otherwise("val"))


def standardize(rows: DataFrame, features: list[str], train: Column) -> DataFrame:
    """Features less the training mean, over the training population deviation plus 1e-6."""
    stats = rows.where(train).agg(*[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in features])
    joined = rows.join(F.broadcast(stats))  # one row
    return joined.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-6) for c in features}).drop(*[f"_{k}_{c}" for c in features for k in "ms"])


def global_patch_ids(patches: DataFrame) -> DataFrame:
    """Patch numbers shifted by the sizes of the shards before."""
    sizes = patches.groupBy("shard").agg((F.max("patch_id") + 1).alias("_n"))
    offset = sizes.withColumn("_o", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row per shard
    return patches.join(offset, "shard").withColumn("global_id", F.col("patch_id") + F.col("_o")).drop("_o")


def validation_subset(volumes: DataFrame, n: int = 15) -> DataFrame:
    """Evenly spaced volumes: over all with one prefix, else half rounded up of the first prefix and the rest of the second."""
    v = volumes.select("volume").distinct().withColumn("prefix", prefix_of("volume"))
    kinds = v.select("prefix").distinct().withColumn("_p", F.row_number().over(Window.orderBy("prefix")))
    many = kinds.agg((F.count("*") >= 2).alias("_many"))
    v = v.join(F.broadcast(kinds), "prefix").join(F.broadcast(many))
    group = F.when(F.col("_many"), F.col("_p")).otherwise(F.lit(1))
    quota = F.when(~F.col("_many"), F.lit(n)).when(F.col("_p") == 1, F.lit((n + 1) // 2)).when(F.col("_p") == 2, F.lit(n // 2)).otherwise(F.lit(0))
    v = v.withColumns({"_g": group, "_q": quota})
    w = Window.partitionBy("_g")
    v = v.withColumns({"_r": F.row_number().over(w.orderBy("volume")) - 1, "_n": F.count("*").over(w)})
    # ranks floor(k · (N - 1) / (q - 1)); they are distinct as q <= N
    step = F.col("_q") - 1
    spaced = F.when(F.col("_q") >= F.col("_n"), F.lit(True)).when(F.col("_q") <= 0, F.lit(False)).when(F.col("_q") == 1, F.col("_r") == 0)
    at = F.exists(F.transform(F.sequence(F.lit(0), F.greatest(step, F.lit(0))), lambda k: F.floor(k * (F.col("_n") - 1) / F.greatest(step, F.lit(1)))), lambda i: i == F.col("_r"))
    return v.where(spaced | (spaced.isNull() & at)).select("volume", "prefix")
