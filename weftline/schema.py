"""Data model: physical scale, table schemas, column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Micrometres per voxel along z, y and x.
SCALE = {"z": 1.625, "y": 0.40625, "x": 0.40625}


def _schema(text: str) -> T.StructType:
    """Fields ``name type``, without a session."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType(), "array<int>": T.ArrayType(T.IntegerType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split() for f in text.split(", "))])


DETECTIONS = _schema("volume string, t long, z double, y double, x double, score double")
TRACKS = _schema("volume string, t long, z double, y double, x double, score double, track_id long")
DIVISION_EDGES = _schema("volume string, source_track_id long, source_t long, target_track_id long, target_t long, distance_um double, child_kind string, edge_type string")
GRAPH_TABLE = _schema("id long, dataset string, row_type string, node_id long, t long, z long, y long, x long, source_id long, target_id long")
FRAMES = _schema("volume string, t int, shape array<int>, data binary")


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...], what: str = "table") -> DataFrame:
    """The frame itself, or ValueError with the sorted names that are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")
    return df
