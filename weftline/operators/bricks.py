"""Detection in frames larger than a task: bricks with halos.

A brick is a box of a frame's regular grid: volume, t, shape (of the frame),
brick (the grid's box), origin, size and data (little-endian uint16). No row
holds a frame. Levels of a frame are exact order statistics of its histogram, at
most 65,536 rows; each brick is sent the rims of its neighbours that the filters
reach, so its peaks are those of the whole frame, bit for bit; quantiles of
responses come from counts of their bits, sixteen at a time.

Defined cases: bricks must cover their frames; origins that are no multiples of
the downsampling raise ValueError; frames without a peak give no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.detection import POINTS, ball_offsets, box_offsets, centroids, dog_v1, dog_v2, maximum_filter
from weftline.plans.storage import materialize, release
from weftline.schema import SCALE

BRICKS = "volume string, t int, shape array<int>, brick array<int>, origin array<int>, size array<int>, data binary"
#: Frames whose targets may be broadcast to the bricks, a narrow row each.
FRAMES_BROADCAST = 1_000_000
#: Voxels around a point that its centre is weighed from.
WINDOW = (1, 3, 3)

Box = tuple[list[int], list[int]]


def cut_frames(frames: DataFrame, brick: tuple[int, int, int]) -> DataFrame:
    """Dense frames (volume, t, shape, data) as bricks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                frame = np.frombuffer(r.data, dtype="<u2").reshape(tuple(r.shape))
                for at in itertools.product(*[range(0, n, b) for n, b in zip(frame.shape, brick, strict=True)]):
                    part = frame[tuple(slice(o, o + b) for o, b in zip(at, brick, strict=True))]
                    yield pd.DataFrame({"volume": [r.volume], "t": [r.t], "shape": [list(frame.shape)], "brick": [list(brick)], "origin": [list(at)], "size": [list(part.shape)], "data": [part.tobytes()]})

    return frames.select("volume", "t", "shape", "data").mapInPandas(run, BRICKS)


def _array(r) -> np.ndarray:
    return np.frombuffer(r.data, dtype="<u2").reshape(tuple(r.size))


def _scaled(values, k: int) -> list[int]:
    """Sizes or corners along z, y, x in voxels of the downsampled frame."""
    return [int(values[0]), *[math.ceil(int(n) / k) for n in values[1:]]]


# ---------------------------------------------------------------- order statistics


def _interpolated(low: Column, high: Column, part: Column) -> Column:
    """Between two neighbours of an order, in the very steps of the array library's own percentiles."""
    return F.when(part >= 0.5, high - (high - low) * (1 - part)).otherwise(low + (high - low) * part)


def _place(n: Column, q: float) -> tuple[Column, Column, Column]:
    """Places of both neighbours of a quantile, from 0, and the part between them."""
    at = (n - 1).cast("double") * F.lit(q)
    return F.floor(at), F.least(F.floor(at) + 1, n - 1), at - F.floor(at)


def frame_order(bricks: DataFrame, k: int, quantiles: dict[str, float]) -> DataFrame:
    """volume, t, the number of bricks along each axis (gz, gy, gx) and per quantile NAME_low, NAME_high and NAME_part: the voxels around it in the order of the frame
    downsampled along y and x, and where it lies between them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if any(o % k for o in r.origin[1:]):
                    raise ValueError(f"origin {list(r.origin)} is no multiple of {k}")
                v, n = np.unique(_array(r)[:, ::k, ::k], return_counts=True)
                grid = [(n + b - 1) // b for n, b in zip(r.shape, r.brick, strict=True)]
                yield pd.DataFrame({"volume": r.volume, "t": r.t, "v": v.astype(np.int32), "n": n, "gz": grid[0], "gy": grid[1], "gx": grid[2]})

    found = bricks.mapInPandas(count, "volume string, t int, v int, n long, gz int, gy int, gx int")
    counts = found.groupBy("volume", "t", "v").agg(F.sum("n").alias("n"), *[F.max(f"g{a}").alias(f"g{a}") for a in "zyx"])
    frame = Window.partitionBy("volume", "t")
    summed = counts.withColumns({"upto": F.sum("n").over(frame.orderBy("v")), "all": F.sum("n").over(frame)})
    first_beyond = lambda place: F.min(F.when(F.col("upto") > place, F.col("v"))).cast("double")
    out = [F.max(f"g{a}").alias(f"g{a}") for a in "zyx"]
    for name, q in quantiles.items():
        low, high, part = _place(F.col("all"), q)
        out += [first_beyond(low).alias(f"{name}_low"), first_beyond(high).alias(f"{name}_high"), F.first(part).alias(f"{name}_part")]
    return summed.groupBy("volume", "t").agg(*out)


def _level(name: str, through: Callable[[Column], Column] = lambda c: c) -> Column:
    """The quantile itself, or that of the voxels mapped by a function that keeps their order."""
    return _interpolated(through(F.col(f"{name}_low")), through(F.col(f"{name}_high")), F.col(f"{name}_part"))


def exact_quantile(parts: DataFrame, q: float) -> DataFrame:
    """volume, t, quantile of non-negative doubles (``response``, binary, many rows a frame).

    Bits of such numbers order as they do. Four passes count sixteen bits each among the numbers that share the bits
    found before; a task sends at most 65,536 counts per row of ``parts`` and place.
    """
    n = parts.groupBy("volume", "t").agg(F.sum(F.length("response") / 8).cast("long").alias("n"))
    low, high, part = _place(F.col("n"), q)
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), low.alias("rank")), F.struct(F.lit(1).alias("side"), high.alias("rank")))).alias("s")
    targets = materialize(n.select("volume", "t", part.alias("part"), both).select("volume", "t", "part", "s.side", "s.rank", F.lit(0).cast("long").alias("prefix")), "targets")
    few = targets.count() <= 2 * FRAMES_BROADCAST
    for shift in (48, 32, 16, 0):

        def count(batches: Iterator[pd.DataFrame], shift: int = shift) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    bits = np.frombuffer(r.response, dtype="<u8")
                    for s in r.sides:
                        same = bits if shift == 48 else bits[bits >> np.uint64(shift + 16) == np.uint64(s["prefix"])]
                        digit, n = np.unique((same >> np.uint64(shift)) & np.uint64(0xFFFF), return_counts=True)
                        yield pd.DataFrame({"volume": r.volume, "t": r.t, "side": s["side"], "digit": digit.astype(np.int64), "n": n}, columns=["volume", "t", "side", "digit", "n"])

        sides = targets.groupBy("volume", "t").agg(F.collect_list(F.struct("side", "prefix")).alias("sides"))  # two a frame
        joined = parts.select("volume", "t", "response").join(F.broadcast(sides) if few else sides, ["volume", "t"])
        counts = joined.mapInPandas(count, "volume string, t int, side int, digit long, n long").groupBy("volume", "t", "side", "digit").agg(F.sum("n").alias("n"))
        summed = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("volume", "t", "side").orderBy("digit")))
        found = summed.join(targets, ["volume", "t", "side"]).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        step = found.select("volume", "t", "part", "side", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), (F.shiftleft("prefix", 16) + F.col("digit")).alias("prefix"))
        before, targets = targets, materialize(step, "targets")
        release(before)

    @F.pandas_udf("double")
    def number(bits: pd.Series) -> pd.Series:
        return pd.Series(bits.to_numpy(np.int64).view(np.float64))

    ends = targets.withColumn("value", number("prefix")).groupBy("volume", "t").agg(F.min("part").alias("part"), F.min("value").alias("low"), F.max("value").alias("high"))
    return ends.select("volume", "t", _interpolated(F.col("low"), F.col("high"), F.col("part")).alias("quantile"))


# ---------------------------------------------------------------- rims


def _bounds(at, brick, halo, shape) -> Box:
    """Corners of the brick at a place of the grid, with a halo, within the frame."""
    return [max(0, j * b - h) for j, b, h in zip(at, brick, halo, strict=True)], [min(n, (j + 1) * b + h) for j, b, h, n in zip(at, brick, halo, shape, strict=True)]


def _pieces(array: np.ndarray, origin, brick, halo, shape) -> Iterator[tuple[tuple[int, ...], list[int], np.ndarray]]:
    """Places of the grid whose bricks with halos meet the array, and what they take of it, with its corner."""
    end = [o + n for o, n in zip(origin, array.shape, strict=True)]
    near = [range(max(0, (o - h) // b), min(-(-n // b), -(-(e + h) // b))) for o, e, h, b, n in zip(origin, end, halo, brick, shape, strict=True)]
    for at in itertools.product(*near):
        low, high = _bounds(at, brick, halo, shape)
        low, high = [max(a, o) for a, o in zip(low, origin, strict=True)], [min(a, e) for a, e in zip(high, end, strict=True)]
        if all(a < b for a, b in zip(low, high, strict=True)):
            yield at, low, array[tuple(slice(a - o, b - o) for a, b, o in zip(low, high, origin, strict=True))]


PIECES = "volume string, t int, jz int, jy int, jx int, level int, shape array<int>, brick array<int>, origin array<int>, size array<int>, data binary"


def _gather(bricks: DataFrame, levels: DataFrame, k: int, halo: tuple[int, ...], full: bool, kernel: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """Calls ``kernel(at, shape, brick, region, corner, full, full_corner, levels)`` once a brick: the downsampled brick with
    its halo, where asked the brick at full resolution with the window of centres, and its frame's levels. Voxels of a halo
    cross the network downsampled, so a frame is sent about once."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                array = _array(r)
                kinds = [(0, array[:, ::k, ::k], _scaled(r.origin, k), _scaled(r.brick, k), halo, _scaled(r.shape, k))]
                if full:
                    kinds.append((1, array, list(r.origin), list(r.brick), WINDOW, list(r.shape)))
                found = [
                    (r.volume, r.t, *at, level, shape, brick, corner, list(piece.shape), piece.tobytes())
                    for level, part, origin, brick, reach, shape in kinds for at, corner, piece in _pieces(part, origin, brick, reach, shape)
                ]
                yield pd.DataFrame(found, columns=[f.split()[0] for f in PIECES.split(", ")])

    pieces = bricks.mapInPandas(cut, PIECES)
    numbers = [c for c in levels.columns if c not in ("volume", "t", "gz", "gy", "gx")]
    told = levels
    for a in "zyx":
        told = told.withColumn(f"j{a}", F.explode(F.sequence(F.lit(0), F.col(f"g{a}") - 1)))
    told = told.select("volume", "t", "jz", "jy", "jx", F.struct(*numbers).alias("levels"))
    rows = pieces.withColumn("levels", F.lit(None).cast(told.schema["levels"].dataType)).unionByName(told, allowMissingColumns=True)

    def assembled(pdf: pd.DataFrame, at, reach) -> tuple[np.ndarray, list[int]]:
        low, high = _bounds(at, pdf.brick.iloc[0], reach, pdf["shape"].iloc[0])
        out = np.zeros([b - a for a, b in zip(low, high, strict=True)], dtype="<u2")
        filled = 0
        for r in pdf.itertuples(index=False):
            out[tuple(slice(o - a, o - a + n) for o, a, n in zip(r.origin, low, r.size, strict=True))] = _array(r)
            filled += math.prod(r.size)
        if filled != out.size:
            raise ValueError(f"bricks do not cover the frame {pdf.volume.iloc[0]}, {pdf.t.iloc[0]} once")
        return out, low

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        volume, t, at = key[0], key[1], key[2:]
        found = pdf[pdf.level == 0]
        if found.empty:
            raise ValueError(f"bricks do not cover the frame {volume}, {t} once")
        region, corner = assembled(found, at, halo)
        whole = assembled(pdf[pdf.level == 1], at, WINDOW) if full else (None, None)
        levels_ = pdf.levels.dropna().iloc[0]
        out = kernel(at, found["shape"].iloc[0], found.brick.iloc[0], region, corner, *whole, levels_)
        return out.assign(volume=volume, t=t)

    # kernels take far longer than their bytes tell, so partitions are not merged by size
    place = ["volume", "t", "jz", "jy", "jx"]
    tasks = int(bricks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *place).groupBy(*place).applyInPandas(solve, schema)


def _peaks(response: np.ndarray, corner, at, brick, offsets: np.ndarray, shape) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Response of the brick alone, which of its voxels are greatest around, and its corner; ``response`` is right wherever
    the offsets reach from the brick."""
    reach = np.abs(offsets).max(axis=0).tolist()
    low, high = _bounds(at, brick, reach, shape)
    near = response[tuple(slice(a - c, b - c) for a, b, c in zip(low, high, corner, strict=True))]
    greatest = maximum_filter(near, offsets)
    start, end = _bounds(at, brick, (0, 0, 0), shape)
    own = tuple(slice(a - c, b - c) for a, b, c in zip(start, end, low, strict=True))
    return near[own], near[own] == greatest[own], start


def _gaussian_reach(sigmas: list[tuple[float, ...]], truncate: float) -> list[int]:
    return [max(int(truncate * s[i] + 0.5) for s in sigmas) for i in range(3)]


def _strongest(peaks: DataFrame, most: int | None) -> DataFrame:
    if most is None:
        return peaks
    rank = F.row_number().over(Window.partitionBy("volume", "t").orderBy(F.col("score").desc(), "pz", "py", "px"))
    return peaks.withColumn("_rank", rank).where(F.col("_rank") <= most)


_PEAK = "volume string, t int, pz int, py int, px int, score double"


# ---------------------------------------------------------------- detectors


def detect_bricks_v1(bricks: DataFrame, sigmas=(1.0, 1.5, 2.0, 2.5, 3.0), quantile: float = 0.9995, min_score: float = 0.015, most: int | None = 350, least: int = 40, k: int = 4) -> DataFrame:
    """The points of ``detect_v1``, brick by brick."""
    sigmas = tuple(max(0.5, s / k) for s in sigmas) if k > 1 else tuple(sigmas)
    offsets = box_offsets()
    halo = tuple(g + m for g, m in zip(_gaussian_reach([(1.6 * max(0.6, 0.35 * s), 1.6 * s, 1.6 * s) for s in sigmas], 2.5), (1, 3, 3), strict=True))
    levels = frame_order(bricks, k, {"lo": 1.0 / 100, "hi": 99.9 / 100}).select("volume", "t", "gz", "gy", "gx", _level("lo").alias("lo"), _level("hi").alias("hi"))

    def kernel(at, shape, brick, region, corner, full, full_corner, level) -> pd.DataFrame:
        lo, hi = level["lo"], level["hi"]
        n = np.zeros(region.shape) if hi <= lo else (np.clip(region.astype(np.float64), lo, hi) - lo) / (hi - lo)
        response, peak, start = _peaks(dog_v1(n, sigmas), corner, at, brick, offsets, shape)
        places = np.argwhere(peak & ((response > 0) | (min_score <= 0)))
        scores = response[tuple(places.T)]
        places = places + start
        row = {"pz": None, "py": None, "px": None, "score": None, "response": [(response + 0.0).astype("<f8").tobytes()]}  # no negative zeros
        peaks = pd.DataFrame({"pz": places[:, 0], "py": places[:, 1], "px": places[:, 2], "score": scores, "response": None}).astype(object)
        return pd.concat([pd.DataFrame(row).astype(object), peaks], ignore_index=True) if len(peaks) else pd.DataFrame(row)

    found = materialize(_gather(bricks, levels, k, halo, False, kernel, f"{_PEAK}, response binary"), "responses")
    threshold = exact_quantile(found.where("response is not null"), quantile).withColumn("least_score", F.greatest("quantile", F.lit(float(min_score))))
    peaks = found.where("response is null").drop("response").join(threshold, ["volume", "t"])
    enough = peaks.groupBy("volume", "t").agg(F.count_if(F.col("score") >= F.col("least_score")).alias("n"))
    kept = peaks.join(enough, ["volume", "t"]).where(F.when(F.col("n") < least, F.col("score") > 0).otherwise(F.col("score") >= F.col("least_score")))
    out = _strongest(kept, most)
    return out.select("volume", F.col("t").cast("long").alias("t"), *[(F.col(f"p{a}") * (1 if a == "z" else k)).cast("double").alias(a) for a in "zyx"], "score")


def detect_bricks_v2(bricks: DataFrame, k: int = 4, scales=((1.5, 4.0), (2.2, 5.5)), rel: float = 0.045, percentile: float = 50.0, radius_um: float = 3.2, most: int | None = 40000, refine: bool = True) -> DataFrame:
    """The points of ``detect_v2``, brick by brick."""
    spacing = (SCALE["z"], SCALE["y"] * k, SCALE["x"] * k)
    offsets = ball_offsets(radius_um, spacing)
    reach = np.abs(offsets).max(axis=0).tolist()
    halo = tuple(g + m for g, m in zip(_gaussian_reach([tuple(s / n for n in spacing) for pair in scales for s in pair], 4.0), reach, strict=True))
    order = frame_order(bricks, k, {"lo": 1.0 / 100, "hi": 99.7 / 100, "bright": percentile / 100})
    ends = order.withColumns({"lo": _level("lo"), "hi": _level("hi")}).withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1.0).otherwise(F.col("hi")))
    levels = ends.select("volume", "t", "gz", "gy", "gx", "lo", "hi", _level("bright", lambda v: F.greatest((v - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0))).alias("bright"))

    def kernel(at, shape, brick, region, corner, full, full_corner, level) -> pd.DataFrame:
        n = np.clip((region.astype(np.float64) - level["lo"]) / (level["hi"] - level["lo"]), 0, None)
        response, peak, start = _peaks(dog_v2(n, spacing, tuple(scales)), corner, at, brick, offsets, shape)
        own = n[tuple(slice(a - c, a - c + s) for a, c, s in zip(start, corner, response.shape, strict=True))]
        places = np.argwhere(peak & (response >= max(rel, 0.0)) & (own >= level["bright"]))
        scores = response[tuple(places.T)]
        places = places + start
        points = places * np.array([1, k, k], dtype=np.float64)
        if refine and len(points):
            points = centroids(full, points - full_corner, WINDOW, full_corner)
        return pd.DataFrame({"pz": places[:, 0], "py": places[:, 1], "px": places[:, 2], "score": scores, "z": points[:, 0], "y": points[:, 1], "x": points[:, 2]})

    found = _gather(bricks, levels, k, halo, refine, kernel, f"{_PEAK}, z double, y double, x double")
    return _strongest(found, most).select(*[F.col(c).cast("long").alias(c) if c == "t" else c for c in (f.split()[0] for f in POINTS.split(", "))])
