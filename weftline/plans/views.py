"""Deterministic point, track and graph views over the driver's tables, in Spark and in SQL.

Each SQL text is the body of a common table expression; ``with_views`` puts the
needed ones, in order, before a query.
"""

from __future__ import annotations

import math
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Voxels of a painted frame along z, y and x.
FRAME_SHAPE = (16, 64, 64)
#: Frames of ``voxels`` that one task holds on average, at most.
FRAMES = 1024

SQL = {
    "det": """SELECT event_type AS volume, CAST(date_diff('second', TIMESTAMP '2024-01-01', ts) // 25920 AS BIGINT) AS t,
  CAST((user_id % 5) * 12 + event_id % 5 AS DOUBLE) AS z, CAST((user_id // 5 % 6) * 40 + event_id % 23 AS DOUBLE) AS y,
  CAST((user_id // 30) * 48 + event_id % 17 AS DOUBLE) AS x, value AS score, event_id AS node_id, user_id FROM events""",
    "gt_nodes": "SELECT volume, t, z - node_id % 5 AS z, y - node_id % 23 AS y, x - node_id % 17 AS x, node_id, user_id FROM det WHERE node_id % 3 <> 0",
    "gt_edges": "SELECT a.volume, a.node_id AS source_id, b.node_id AS target_id FROM gt_nodes a JOIN gt_nodes b ON a.volume = b.volume AND a.user_id = b.user_id AND b.t = a.t + 1",
    "pred_edges": "SELECT a.volume, a.node_id AS source_id, min(b.node_id) AS target_id FROM det a JOIN det b ON a.volume = b.volume AND a.user_id = b.user_id AND b.t = a.t + 1 GROUP BY a.volume, a.node_id",
    "tracks": "SELECT volume, user_id AS track_id, t, min(node_id) AS node_id, min_by(z, node_id) AS z, min_by(y, node_id) AS y, min_by(x, node_id) AS x, min_by(score, node_id) AS score FROM det GROUP BY volume, user_id, t",
    "near7": """SELECT p.volume, p.t, p.node_id AS pred_id, g.node_id AS gt_id, sqrt(pow((p.z - g.z) * 1.625, 2) + pow((p.y - g.y) * 0.40625, 2) + pow((p.x - g.x) * 0.40625, 2)) AS d
  FROM det p JOIN gt_nodes g ON p.volume = g.volume AND p.t = g.t
  WHERE sqrt(pow((p.z - g.z) * 1.625, 2) + pow((p.y - g.y) * 0.40625, 2) + pow((p.x - g.x) * 0.40625, 2)) <= 7""",
    "matches": """SELECT volume, t, pred_id, gt_id, d AS distance_um FROM (SELECT *, row_number() OVER (PARTITION BY volume, pred_id ORDER BY d, gt_id) AS rp,
  row_number() OVER (PARTITION BY volume, gt_id ORDER BY d, pred_id) AS rg FROM near7) WHERE rp = 1 AND rg = 1""",
    "gt_meta": "SELECT volume, CAST(count(*) // 2 AS BIGINT) AS estimated_number_of_nodes FROM det GROUP BY volume",
    "det2": """SELECT event_type AS volume, CAST(date_diff('second', TIMESTAMP '2024-01-01', ts) // 129600 AS BIGINT) AS t, user_id, event_id, value AS score,
  CAST((user_id % 5) * 4 + event_id % 3 AS DOUBLE) AS z, CAST((user_id // 5 % 6) * 16 + event_id % 11 AS DOUBLE) AS y, CAST((user_id // 30) * 16 + event_id % 9 AS DOUBLE) AS x FROM events""",
    "dtracks": """SELECT volume, user_id * 1000 + min(t) OVER (PARTITION BY volume, user_id, g) AS track_id, t, z, y, x, score, node_id FROM
  (SELECT *, t - row_number() OVER (PARTITION BY volume, user_id ORDER BY t) AS g FROM
  (SELECT volume, user_id, t, min(event_id) AS node_id, min_by(z, event_id) AS z, min_by(y, event_id) AS y, min_by(x, event_id) AS x, min_by(score, event_id) AS score FROM det2 GROUP BY volume, user_id, t))""",
    "voxels": """SELECT 'v' || (s_suppkey % 2) AS volume, s_suppkey // 2 AS t, n // 256 AS z, n // 16 % 16 AS y, n % 16 AS x,
  ((n + s_suppkey * 2048) * 7919 + (n // 16) * 104729 + (n // 256) * 1299709) % 1009 + CASE WHEN n // 256 = 4 AND n // 16 % 16 = 8 AND n % 16 = 8 THEN 2000 + CAST(floor(abs(s_acctbal)) AS BIGINT) % 500 ELSE 0 END AS v
  FROM supplier, range(0, 2048) r(n)""",
}
#: Which views a view reads.
NEEDS = {name: [k for k in SQL if k != name and re.search(rf"\b{k}\b", text)] for name, text in SQL.items()}


def with_views(query: str) -> str:
    """The query behind the views that it names."""
    order: list[str] = []

    def add(name: str) -> None:
        for k in NEEDS[name]:
            add(k)
        if name not in order:
            order.append(name)

    for name in SQL:
        if re.search(rf"\b{name}\b", query):
            add(name)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    query = query.strip()
    if not head:
        return query
    if not (m := re.match(r"WITH (RECURSIVE )?", query)):
        return f"WITH {head} {query}"
    return f"WITH {m[1] or ''}{head}, {query[m.end() :]}"


class Views:
    """The same views as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def det(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_type AS volume", "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 25920 AS t", "cast((user_id % 5) * 12 + event_id % 5 AS double) AS z",
            "cast((user_id div 5 % 6) * 40 + event_id % 23 AS double) AS y", "cast((user_id div 30) * 48 + event_id % 17 AS double) AS x", "value AS score", "event_id AS node_id", "user_id",
        )

    @cached_property
    def gt_nodes(self) -> DataFrame:
        return self.det.where("node_id % 3 <> 0").selectExpr("volume", "t", "z - node_id % 5 AS z", "y - node_id % 23 AS y", "x - node_id % 17 AS x", "node_id", "user_id")

    def _next(self, nodes: DataFrame) -> DataFrame:
        a = nodes.select("volume", "user_id", "t", F.col("node_id").alias("source_id"))
        b = nodes.select("volume", "user_id", (F.col("t") - 1).alias("t"), F.col("node_id").alias("target_id"))
        return a.join(b, ["volume", "user_id", "t"]).select("volume", "source_id", "target_id")

    @cached_property
    def gt_edges(self) -> DataFrame:
        return self._next(self.gt_nodes)

    @cached_property
    def pred_edges(self) -> DataFrame:
        return self._next(self.det).groupBy("volume", "source_id").agg(F.min("target_id").alias("target_id"))

    @cached_property
    def tracks(self) -> DataFrame:
        first = F.min(F.struct("node_id", "z", "y", "x", "score")).alias("f")
        return self.det.groupBy("volume", F.col("user_id").alias("track_id"), "t").agg(first).select("volume", "track_id", "t", "f.*")

    @cached_property
    def matches(self) -> DataFrame:
        """Mutual nearest neighbours within 7 micrometres: a matching that needs no solver."""
        from weftline.operators.joins import radius_join

        near = radius_join(self.det, self.gt_nodes, 7.0, [0], ["volume", "t", "node_id"], ["node_id"])
        near = near.select(F.col("volume_a").alias("volume"), F.col("t_a").alias("t"), F.col("node_id_a").alias("pred_id"), F.col("node_id_b").alias("gt_id"), "distance_um")
        rank = lambda own, other: F.row_number().over(Window.partitionBy("volume", own).orderBy("distance_um", other))
        return near.withColumns({"rp": rank("pred_id", "gt_id"), "rg": rank("gt_id", "pred_id")}).where("rp = 1 and rg = 1").drop("rp", "rg")

    @cached_property
    def gt_meta(self) -> DataFrame:
        return self.det.groupBy("volume").agg(F.expr("count(*) div 2").alias("estimated_number_of_nodes"))

    @cached_property
    def dtracks(self) -> DataFrame:
        d = self.table("events").selectExpr(
            "event_type AS volume", "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 129600 AS t", "user_id", "event_id AS node_id", "value AS score", "cast((user_id % 5) * 4 + event_id % 3 AS double) AS z",
            "cast((user_id div 5 % 6) * 16 + event_id % 11 AS double) AS y", "cast((user_id div 30) * 16 + event_id % 9 AS double) AS x",
        )
        d = d.groupBy("volume", "user_id", "t").agg(F.min(F.struct("node_id", "z", "y", "x", "score")).alias("f")).select("volume", "user_id", "t", "f.*")
        d = d.withColumn("g", F.col("t") - F.row_number().over(Window.partitionBy("volume", "user_id").orderBy("t")))
        return d.withColumn("track_id", F.col("user_id") * 1000 + F.min("t").over(Window.partitionBy("volume", "user_id", "g"))).select("volume", "track_id", "t", "z", "y", "x", "score", "node_id")

    @cached_property
    def voxels(self) -> DataFrame:
        """One frame of 8 x 16 x 16 voxels per supplier, with a peak in its middle. Frames are dealt before they grow, as
        the table is one small file; what groups voxels by frame then needs no shuffle of them. There are as many parts as
        shuffles have, or more where a part would get over ``FRAMES`` frames: a task's memory does not grow with the table."""
        suppliers = self.table("supplier")
        deal = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(suppliers.count() / FRAMES))
        frames = suppliers.selectExpr("concat('v', s_suppkey % 2) AS volume", "s_suppkey div 2 AS t", "s_suppkey", "s_acctbal").repartition(deal, "volume", "t")
        grid = frames.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2047).cast("long"))).alias("n"))
        return grid.selectExpr(
            "volume", "t", "n div 256 AS z", "n div 16 % 16 AS y", "n % 16 AS x",
            "((n + s_suppkey * 2048) * 7919 + (n div 16) * 104729 + (n div 256) * 1299709) % 1009 + CASE WHEN n div 256 = 4 AND n div 16 % 16 = 8 AND n % 16 = 8 THEN 2000 + cast(floor(abs(s_acctbal)) AS long) % 500 ELSE 0 END AS v",
        )

    @cached_property
    def frames(self) -> DataFrame:
        """Dense frames of 16 x 64 x 64 voxels, in which every detection is a blob on a noisy ground."""
        import numpy as np
        import pandas as pd

        shape, widths = FRAME_SHAPE, (1, 4, 4)
        axes = np.meshgrid(*[np.arange(n) for n in shape], indexing="ij", sparse=True)
        # of each place along an axis the reach of a blob there and its bell; a frame has many blobs and few places
        reach = [[slice(max(0, c - 3 * w), min(n, c + 3 * w + 1)) for c in range(n)] for n, w in zip(shape, widths, strict=True)]
        bells = [[np.exp(-(((np.arange(n)[b] - c) / w) ** 2) / 2) for c, b in enumerate(boxes)] for n, w, boxes in zip(shape, widths, reach, strict=True)]

        def paint(pdf: pd.DataFrame) -> pd.DataFrame:
            volume, t = pdf.volume.iloc[0], int(pdf.t.iloc[0])
            frame = (7919 * axes[0] + 104729 * axes[1] + 1299709 * axes[2]) * (t + 1) % 97 + 100.0
            pdf = pdf.sort_values("node_id")
            at = (pdf[["z", "y", "x"]].to_numpy() % shape).astype(np.int64).tolist()
            for (z, y, x), height in zip(at, (800 + pdf.node_id % 400).tolist(), strict=True):
                blob = np.multiply.outer(np.multiply.outer(bells[0][z], bells[1][y]), bells[2][x])
                frame[reach[0][z], reach[1][y], reach[2][x]] += height * blob
            return pd.DataFrame({"volume": [volume], "t": [t], "shape": [list(shape)], "data": [np.minimum(frame, 65535).astype("<u2").tobytes()]})

        # a number of parts that stays, as painting is more work than its rows tell
        dealt = self.det.select("volume", "t", "node_id", "z", "y", "x").repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "volume", "t")
        return dealt.groupBy("volume", "t").applyInPandas(paint, "volume string, t int, shape array<int>, data binary")

    @cached_property
    def lines(self) -> DataFrame:
        from weftline.operators.text_analysis import lines

        return lines(self.table("documents"))
