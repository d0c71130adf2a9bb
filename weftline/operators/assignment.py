"""One-to-one matching of candidate pairs within groups.

A pair that is the only one for both of its ends is taken in SQL; only contested
pairs reach the solver, one group (volume, frame) at a time, or one connected
component at a time where groups pool many frames.
"""

from __future__ import annotations

from enum import Enum

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.solver import match_pairs
from weftline.operators.graph import components


class Objective(Enum):
    """Cost of leaving a pair out, given the gate."""

    #: most pairs first, then least total distance (linkers, gap closing, trackers)
    CARDINALITY = "cardinality"
    #: greatest sum of (gate + 1 - distance): may leave a feasible pair out (evaluation)
    GAIN = "gain"

    def infeasible(self, gate: float) -> float:
        return 1000.0 * gate + 1 if self is Objective.CARDINALITY else gate + 1


#: Groups that components are dealt to, as a group each would cost more than its solution.
DEALT = 4096


def match(candidates: DataFrame, gate: float, objective: Objective = Objective.CARDINALITY, keys: tuple[str, ...] = ("volume", "t"), strict: bool = False, by_component: bool = False) -> DataFrame:
    """``candidates``: keys, a_id, b_id, distance_um. The pairs of an optimal matching; ``strict`` drops pairs at the gate itself.
    ``by_component``: groups may be large, so their connected components are found first and are solved apart."""
    near = F.col("distance_um") < gate if strict else F.col("distance_um") <= gate
    candidates = candidates.where(near).select(*keys, "a_id", "b_id", "distance_um")
    count = lambda c: F.count("*").over(Window.partitionBy(*keys, c))
    counted = candidates.withColumns({"_na": count("a_id"), "_nb": count("b_id")})
    alone = (F.col("_na") == 1) & (F.col("_nb") == 1)
    sure = counted.where(alone).drop("_na", "_nb")
    cost = objective.infeasible(gate)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        take = match_pairs(pdf.a_id.to_numpy(), pdf.b_id.to_numpy(), pdf.distance_um.to_numpy(), cost)
        return pdf[take]

    contested = counted.where(~alone).drop("_na", "_nb")
    if by_component:
        group = F.struct(*keys).alias("volume")
        edges = contested.select(group, (2 * F.col("a_id")).alias("source_id"), (2 * F.col("b_id") + 1).alias("target_id"))
        of_a = components(edges).where("node_id % 2 = 0").select(*[F.col(f"volume.{k}").alias(k) for k in keys], (F.col("node_id") / 2).cast("long").alias("a_id"), "component")
        columns = contested.columns

        def solve_each(pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf.groupby([*keys, "component"], sort=False, dropna=False).ngroup().to_numpy()
            return pdf[match_pairs(pdf.a_id.to_numpy(), pdf.b_id.to_numpy(), pdf.distance_um.to_numpy(), cost, own)][columns]

        dealt = contested.join(of_a, [*keys, "a_id"]).withColumn("_deal", F.pmod(F.xxhash64(*keys, "component"), F.lit(DEALT)))
        return sure.unionByName(dealt.groupBy("_deal").applyInPandas(solve_each, contested.schema))
    return sure.unionByName(contested.groupBy(*keys).applyInPandas(solve, contested.schema))
