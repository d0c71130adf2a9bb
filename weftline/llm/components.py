"""Connected components of a link table, by the engine's own operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.graph import components


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links``: columns u, v (long, no nulls). Returns node, root: the smallest node that links reach; nodes without
    links to others are absent."""
    edges = links.select(F.lit("").alias("volume"), F.col("u").alias("source_id"), F.col("v").alias("target_id"))
    return components(edges, rounds).select(F.col("node_id").alias("node"), F.col("component").alias("root"))
