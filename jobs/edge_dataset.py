"""Training set of edges: labelled pairs of detections in consecutive frames.

Reads detections and annotated cells, pairs points of next frames within a gate,
labels a pair by whether both ends are nearest to annotated nodes that one true
edge joins, keeps all positives and a fixed ratio of negatives per volume, numbers
the endpoints' patches, splits by frame, and writes the rows partitioned by volume
and split.

``points`` and ``truth`` of the configuration say in SQL how the columns of the
detections and annotations are made from those of the tables; true edges join a
``cell`` with itself in the next frame. Volumes are independent, and samples and
patch numbers depend on hashes and ids alone, so a run gives the same rows each
time. Without ``volumes`` all output is replaced; with it only those volumes are
read, and of the output only their partitions are replaced.

Rows without a volume, frame, place or id are left out. A volume without a
positive has no rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs._command import command, configuration, written
from weftline.operators import pairs

LOG = logging.getLogger("jobs.edge_dataset")
SCHEMA = "t long, i long, j long, d double, dz double, dy double, dx double, score_i double, score_j double, label int, patch_i long, patch_j long, volume string, split string"


def _mapped(table: DataFrame, columns: dict[str, str], config: dict) -> DataFrame:
    df = table.selectExpr(*[f"{how} as {name}" for name, how in columns.items()]).dropna(subset=["volume", "t", "z", "y", "x", "node_id"])
    return df.where(F.col("volume").isin(config["volumes"])) if config["volumes"] else df


def true_edges(nodes: DataFrame) -> DataFrame:
    """Edges from a cell's nodes to its nodes in the next frame."""
    a = nodes.select("volume", "cell", "t", F.col("node_id").alias("source_id"))
    b = nodes.select("volume", "cell", (F.col("t") - 1).alias("t"), F.col("node_id").alias("target_id"))
    return a.join(b, ["volume", "cell", "t"]).select("volume", "source_id", "target_id")


def dataset(points: DataFrame, truth: DataFrame, config: dict, held: list[DataFrame] | None = None) -> DataFrame:
    """The rows of the training set. Pairs are read by several steps, and would be joined anew for each: with ``held`` they
    and the sample are persisted, and listed there for the caller to unpersist."""

    def kept_once(df: DataFrame) -> DataFrame:
        if held is not None:
            held.append(df.persist())
        return df

    found = kept_once(pairs.edge_pairs(points, truth.drop("cell"), true_edges(truth), config["gate_um"], config["match_um"]))
    kept = kept_once(pairs.sample_negatives(found, config["negatives"], config["seed"]))
    patches = pairs.patch_index(kept)
    for end in "ij":
        kept = kept.join(patches.select("volume", F.col("node_id").alias(end), F.col("patch_id").alias(f"patch_{end}")), ["volume", end])
    rows = pairs.temporal_split(kept, config["train_end"], config["total"])
    return rows.select([F.col(c).cast(kind) for c, kind in (field.split() for field in SCHEMA.split(", "))])


def run(spark: SparkSession, points: str, truth: str, output: str, config: dict | None = None) -> dict:
    """Builds the training set, or that of some volumes. Returns how many rows were read and written."""
    config = config or configuration("edge_dataset")
    detections = _mapped(spark.read.parquet(points), config["points"], config)
    nodes = _mapped(spark.read.parquet(truth).where(config["truth_where"] or "true"), config["truth"], config)
    done = {"points": detections.count(), "truth": nodes.count()}
    LOG.info("read %d detections of %s and %d annotated nodes of %s", done["points"], points, done["truth"], truth)
    mode = "dynamic" if config["volumes"] else "static"
    held: list[DataFrame] = []
    try:
        rows = dataset(detections, nodes, config, held).hint("rebalance", "volume", "split")
        rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("volume", "split").parquet(output)
    finally:
        for df in held:
            df.unpersist()
    back = written(spark, output, SCHEMA)
    back = back.where(F.col("volume").isin(config["volumes"])) if config["volumes"] else back
    for r in back.groupBy("volume", "split").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).orderBy("volume", "split").collect():  # a row per partition
        LOG.info("wrote %d rows, %d positive: volume %s, %s", r.n, r.pos, r.volume, r.split)
        done[f"{r.volume}/{r.split}"] = r.n
    return done


def output(spark: SparkSession, path: str) -> DataFrame:
    """The training set as it stands."""
    return written(spark, path, SCHEMA)


if __name__ == "__main__":
    command("edge_dataset", run, {"points": "Parquet table of detections", "truth": "Parquet table of annotations", "output": "folder of the training set"})
