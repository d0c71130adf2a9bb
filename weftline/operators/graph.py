"""Graph operators on edge tables: degrees, components, ancestors and descendants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.storage import materialize, release


def degrees(edges: DataFrame) -> DataFrame:
    """volume, node_id, out_degree, in_degree of the nodes that edges touch."""
    ends = edges.select("volume", F.explode(F.array(F.struct(F.col("source_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("volume", F.col("e.node_id").alias("node_id")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """volume, node_id, component: the smallest node of the weakly connected component; nodes without edges are absent.

    Large-star and small-star rounds on (volume, node) keys; minima are taken map-side, no component is gathered.
    """
    now = edges.select("volume", F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v")).where("u <> v").distinct()
    now = materialize(now, "components")
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select("volume", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("volume", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, ["volume", "u"]).select("volume", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("volume", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["volume", "u"]).select("volume", F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, now = now, materialize(small.select("volume", F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u <> v").distinct(), "components")
        release(before)
        hashed = F.xxhash64("volume", "u", "v")
        after = now.agg(F.count("*"), F.sum(hashed.cast("decimal(38,0)")), F.bit_xor(hashed)).first()  # both whole: 128 bits
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("volume", F.col("v").alias("node_id"), F.col("v").alias("component")).distinct()
    return now.select("volume", F.col("u").alias("node_id"), F.col("v").alias("component")).unionByName(roots)


def closure(edges: DataFrame, rounds: int = 62) -> DataFrame:
    """volume, node_id, reach_id: every node that a directed path leads to, by doubling path lengths."""
    paths = materialize(edges.select("volume", F.col("source_id").alias("node_id"), F.col("target_id").alias("reach_id")).distinct(), "closure")
    count = paths.count()
    for _ in range(rounds):
        step = paths.alias("p").join(paths.alias("q"), (F.col("p.volume") == F.col("q.volume")) & (F.col("p.reach_id") == F.col("q.node_id"))).select("p.volume", "p.node_id", "q.reach_id")
        before, paths = paths, materialize(paths.unionByName(step).distinct(), "closure")
        release(before)
        after = paths.count()
        if after == count:
            return paths
        count = after
    raise RuntimeError("closure did not settle")


def _spread(best: DataFrame, hop: DataFrame, picks: dict[str, Callable], rounds: int) -> tuple[DataFrame, bool]:
    """``best`` (volume, node_id, values) after each node has learnt, by ``picks``, from all nodes that a path of ``hop``
    (volume, node_id, via) leads to, and whether all paths end. Reach doubles: a node learns from the nodes 1, 2, 4, ...
    steps away, so no closure is kept. The picks must not mind repeats, as least and greatest do not."""
    hop, best = materialize(hop.distinct(), "hops"), materialize(best, "extent")
    for _ in range(rounds):
        via = hop.join(best.withColumnRenamed("node_id", "via"), ["volume", "via"]).select("volume", "node_id", *picks)
        earlier, best = best, materialize(best.unionByName(via).groupBy("volume", "node_id").agg(*[pick(c).alias(c) for c, pick in picks.items()]), "extent")
        known = hop
        hop = materialize(hop.alias("p").join(hop.alias("q"), (F.col("p.volume") == F.col("q.volume")) & (F.col("p.via") == F.col("q.node_id"))).select("p.volume", "p.node_id", "q.via").distinct(), "hops")
        release(known, earlier)
        if hop.isEmpty():
            return best, True
    return best, False


def lineage_extent(nodes: DataFrame, edges: DataFrame, rounds: int = 62) -> DataFrame:
    """volume, node_id, t, age (frames since the first ancestor, from 1) and span (frames to the last descendant, from 1).
    Earliest ancestor and latest descendant times spread along edges."""
    out = nodes.select("volume", "node_id", "t")
    for name, source, target, pick in (("age", "source_id", "target_id", F.min), ("span", "target_id", "source_id", F.max)):
        hop = edges.select("volume", F.col(target).alias("node_id"), F.col(source).alias("via"))
        best, ended = _spread(out.select("volume", "node_id", F.col("t").alias("best")), hop, {"best": pick}, rounds)
        if not ended:
            raise RuntimeError("edges lead in a circle")
        out = out.join(best.withColumnRenamed("best", f"_{name}"), ["volume", "node_id"], "left")
    return out.select("volume", "node_id", "t", (F.col("t") - F.coalesce("_age", "t") + 1).alias("age"), (F.coalesce("_span", "t") - F.col("t") + 1).alias("span"))


def range_below(values: DataFrame, edges: DataFrame, rounds: int = 62) -> DataFrame:
    """volume, node_id, low, high: the least and greatest of ``value`` (volume, node_id, value) over a node and all its
    descendants, for nodes that have any. One row a node at all times; edges may merge, and may lead in a circle."""
    own = values.groupBy("volume", "node_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    hop = edges.select("volume", F.col("source_id").alias("node_id"), F.col("target_id").alias("via"))
    return _spread(own, hop, {"low": F.min, "high": F.max}, rounds)[0]
