"""The graph table: node and edge rows of tracks and divisions in one normalized table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.geometry import half_even
from weftline.operators.joins import lookup_nodes
from weftline.operators.ranks import number_rows
from weftline.schema import require_columns


def number_track_nodes(tracks: DataFrame) -> DataFrame:
    """node_id from 1 in each volume by track and frame."""
    return number_rows(tracks, ["volume"], ["track_id"], ["t"], "node_id")


def track_edges(numbered: DataFrame) -> DataFrame:
    """Edges between consecutive points of a track, whatever frames lie between."""
    w = Window.partitionBy("volume", "track_id").orderBy("t", "node_id")
    return numbered.withColumn("target_id", F.lead("node_id").over(w)).where("target_id is not null").select("volume", "track_id", "t", F.col("node_id").alias("source_id"), "target_id")


def division_node_edges(numbered: DataFrame, divisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Division edges as node edges not emitted before, with the ordinal of the first, and per volume the number skipped."""
    rows = divisions.select("volume", "source_track_id", "source_t", "target_track_id", "target_t", "ordinal")
    s = lookup_nodes(numbered, rows.select("volume", F.col("source_track_id").alias("track_id"), F.col("source_t").alias("t"), "target_track_id", "target_t", "ordinal")).withColumnRenamed("node_id", "source_id")
    both = lookup_nodes(numbered, s.select("volume", F.col("target_track_id").alias("track_id"), F.col("target_t").alias("t"), "source_id", "ordinal")).withColumnRenamed("node_id", "target_id")
    found = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    skipped = both.where(~found).groupBy("volume").agg(F.count("*").alias("skipped"))
    fresh = both.where(found).join(track_edges(numbered).select("volume", "source_id", "target_id"), ["volume", "source_id", "target_id"], "left_anti")
    return fresh.groupBy("volume", "source_id", "target_id").agg(F.min("ordinal").alias("ordinal")), skipped


def graph_table(tracks: DataFrame, divisions: DataFrame | None = None) -> DataFrame:
    """Rows in order: volumes, their tracks (nodes, then edges), their divisions; ``id`` counts from 0.

    ``divisions`` has an ``ordinal`` that orders it. The running id is a sum of counts per volume, plus counts of the
    tracks before, plus the place in the track, so no task sorts the rows of a volume; its division edges are one part.
    """
    require_columns(tracks, ["volume", "track_id", "t", "z", "y", "x"], "tracks")
    n = number_track_nodes(tracks)
    none = F.lit(-1).cast("long")
    nodes = n.select("volume", F.lit(0).alias("section"), "track_id", F.lit(0).alias("kind"), F.col("node_id").alias("place"), F.lit("node").alias("row_type"), "node_id", "t", *[half_even(F.col(k)).alias(k) for k in "zyx"], none.alias("source_id"), none.alias("target_id"))
    edge = lambda df, section, track, place: df.select("volume", F.lit(section).alias("section"), track.alias("track_id"), F.lit(1).alias("kind"), place.alias("place"), F.lit("edge").alias("row_type"), none.alias("node_id"), none.alias("t"), none.alias("z"), none.alias("y"), none.alias("x"), "source_id", "target_id")
    rows = nodes.unionByName(edge(track_edges(n), 0, F.col("track_id"), F.col("source_id")))
    if divisions is not None:
        rows = rows.unionByName(edge(division_node_edges(n, divisions)[0], 1, F.lit(0).cast("long"), F.col("ordinal").cast("long")))
    counts = rows.groupBy("volume").agg(F.count("*").alias("_n"))
    start = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("volume").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row per volume
    placed = number_rows(rows, ["volume"], ["section", "track_id", "kind"], ["place"], "_rank")
    return placed.join(start, "volume").select((F.col("_start") + F.col("_rank") - 1).cast("long").alias("id"), F.col("volume").alias("dataset"), "row_type", "node_id", "t", "z", "y", "x", "source_id", "target_id")


def split_graph(table: DataFrame, datasets: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the graph table, typed; edges are those listed, once each."""
    require_columns(table, ["dataset", "row_type", "node_id", "t", "z", "y", "x", "source_id", "target_id"], "graph table")
    t = table.withColumns({"volume": F.col("dataset").cast("string"), "row_type": F.col("row_type").cast("string")})
    if datasets is not None:
        t = t.where(F.col("volume").isin(datasets))
    nodes = t.where("row_type = 'node'").select("volume", F.col("node_id").cast("long"), F.col("t").cast("long"), *[F.col(k).cast("double") for k in "zyx"]).dropDuplicates(["volume", "node_id"])
    edges = t.where("row_type = 'edge'").select("volume", F.col("source_id").cast("long"), F.col("target_id").cast("long")).distinct()
    return nodes, edges
