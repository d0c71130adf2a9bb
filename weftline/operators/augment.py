"""Augmented views of dense frames: mirrors, quarter turns, gain, offset, noise and clipping.

What a view gets is drawn in columns from an md5 of seed, volume, frame and view,
so it depends on no partition, and any engine can repeat it. Frames are then
turned where they are: no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that ``draw`` adds.
DRAWN = ("view", "flip_z", "flip_y", "flip_x", "turns", "gain", "offset", "noise_seed")


def _bits(seed: int, name: str) -> Column:
    """A whole number below 2^32."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce("volume", F.lit("")), F.coalesce(F.col("t").cast("string"), F.lit("")), F.col("view").cast("string"), F.lit(name))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def draw(frames: DataFrame, seed: int = 0, views: int = 1, turn: bool = True, gain: float = 0.6, offset: float = 0.2) -> DataFrame:
    """Each frame once per view, with its mirrors (each by one half), quarter turns in y and x (1 to 3 by one half, if
    ``turn``), gain within 1 ± gain / 2 and offset within ± offset / 2. A null volume or frame draws as an empty text."""
    u = lambda name: _bits(seed, name) / F.lit(2.0**32)
    turns = F.when(u("turn") < 0.5, (1 + F.floor(3 * u("turns"))).cast("int")).otherwise(F.lit(0)) if turn else F.lit(0)
    out = frames.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(views - 1))))
    flips = {f"flip_{k}": u(f"flip_{k}") < 0.5 for k in "zyx"}
    return out.withColumns({**flips, "turns": turns, "gain": 1 + (u("gain") - 0.5) * gain, "offset": (u("offset") - 0.5) * offset, "noise_seed": _bits(seed, "noise")})


def _mirrors(row: dict) -> list[int]:
    return [i for i, k in enumerate("zyx") if row[f"flip_{k}"]]


def _mapped(frames: DataFrame, dtype: str, turned) -> DataFrame:
    """Frames with new shapes and data, batch by batch; other columns stay."""
    schema = frames.schema

    def run(batches):
        for batch in batches:
            made = [turned(row) for row in batch.to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["shape"] = pa.array([list(a.shape) for a in made], batch.schema.field("shape").type)
            columns["data"] = pa.array([np.ascontiguousarray(a, dtype=dtype).tobytes() for a in made], batch.schema.field("data").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return frames.mapInArrow(run, schema)


def augment(drawn: DataFrame, scale: float = 1.0, noise: float = 0.01, dtype: str = "<f4", source: str = "<u2") -> DataFrame:
    """Drawn frames (shape, data of ``source`` numbers, in units of ``scale``) as their views, numbers of ``dtype`` within 0
    and 1: mirrored, turned, times gain plus offset, plus normal noise of the deviation ``noise``, and clipped."""

    def turned(row: dict) -> np.ndarray:
        a = np.frombuffer(row["data"], source).reshape(row["shape"]) / scale
        a = np.rot90(np.flip(a, _mirrors(row)), row["turns"], axes=(1, 2))
        a = a * row["gain"] + row["offset"]
        if noise:
            a = a + np.random.default_rng(row["noise_seed"]).standard_normal(a.shape) * noise
        return np.clip(a, 0, 1)

    return _mapped(drawn, dtype, turned)


def undo(views: DataFrame, dtype: str = "<f4", values: bool = False) -> DataFrame:
    """Views back in the place of their frames, exactly; with ``values`` gain and offset are undone too, which is exact up
    to rounding where nothing was clipped and no noise was added."""

    def turned(row: dict) -> np.ndarray:
        a = np.frombuffer(row["data"], dtype).reshape(row["shape"])
        a = (a - row["offset"]) / row["gain"] if values else a
        return np.flip(np.rot90(a, -row["turns"], axes=(1, 2)), _mirrors(row))

    return _mapped(views, dtype, turned)


def place(drawn: DataFrame, points: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Voxel places (volume, t, z, y, x, ...) of frames of one shape, moved as the drawn views move them: labels follow
    their frames. One row per view."""
    moves = drawn.select("volume", "t", *DRAWN[:5])
    z, y, x = (F.when(F.col(f"flip_{k}"), F.lit(n - 1) - F.col(k)).otherwise(F.col(k)) for k, n in zip("zyx", shape, strict=True))
    j = points.join(moves.hint("merge"), ["volume", "t"]).withColumns({"_z": z, "_y": y, "_x": x})
    ny, nx, k = shape[1] - 1, shape[2] - 1, F.col("turns")
    new_y = F.when(k == 1, nx - F.col("_x")).when(k == 2, ny - F.col("_y")).when(k == 3, F.col("_x")).otherwise(F.col("_y"))
    new_x = F.when(k == 1, F.col("_y")).when(k == 2, nx - F.col("_x")).when(k == 3, ny - F.col("_y")).otherwise(F.col("_x"))
    return j.withColumns({"z": F.col("_z"), "y": new_y, "x": new_x}).drop("_z", "_y", "_x", *DRAWN[1:5])
