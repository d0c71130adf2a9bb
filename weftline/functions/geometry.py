"""Column expressions of space: micrometres, distances, rounding, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.schema import SCALE


def physical(df: DataFrame) -> DataFrame:
    """Adds zu, yu and xu: coordinates in micrometres."""
    return df.withColumns({f"{k}u": F.col(k) * F.lit(v) for k, v in SCALE.items()})


def distance_um(a: str, b: str) -> Column:
    """Distance of two voxel positions under the aliases a and b."""
    d = [(F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) * F.lit(v) for k, v in SCALE.items()]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def half_even(column: Column) -> Column:
    """Nearest integer, ties to even, without negative zero."""
    return F.rint(column).cast("long")


def prefix_of(column: str | Column, mark: str = "_") -> Column:
    """Text before the first mark."""
    return F.substring_index(column, mark, 1)
