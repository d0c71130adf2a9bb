"""Detection: voxel frames to points.

Frame operators work in two forms. The long form (volume, t, z, y, x, v) is
relational: percentiles, windows and joins, good for small grids and checks. The
dense form (volume, t, shape, data) has one frame a row and runs array kernels
in Arrow batches, one task per frame or more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.geometry import half_even
from weftline.schema import SCALE

# ---------------------------------------------------------------- long form


def downsample(voxels: DataFrame, k: int) -> DataFrame:
    """Every k-th voxel along y and x, with new indices."""
    return voxels.where((F.col("y") % k == 0) & (F.col("x") % k == 0)).withColumns({"y": (F.col("y") / k).cast("long"), "x": (F.col("x") / k).cast("long")})


def _levels(voxels: DataFrame, low: float, high: float) -> DataFrame:
    """Voxels with the percentiles lo and hi (linear, exact) of their frame."""
    p = voxels.groupBy("volume", "t").agg(F.expr(f"percentile(v, array({low}, {high}))").alias("p"))
    return _of_frame(voxels, p.select("volume", "t", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi")))


def _of_frame(voxels: DataFrame, frames: DataFrame) -> DataFrame:
    """Voxels with the columns of their frame. Spark takes the size of voxels that were exploded from a small table for
    that of the table and would broadcast them, hence the hint: a task holds the rows of its frames."""
    return voxels.join(frames.hint("shuffle_hash"), ["volume", "t"])


def normalize(voxels: DataFrame, kind: str) -> DataFrame:
    """Adds ``n``: ``unit`` (p1 to p99.9 onto 0..1, 0 where flat), ``z`` (clipped likewise, zero mean, unit population
    deviation, or deviation 1 under 1e-6), ``clip`` (p1 to p99.7 onto 0..1), ``below`` (as clip, without upper bound)."""
    v = F.col("v").cast("double")
    if kind in ("unit", "z"):
        levels = _levels(voxels, 0.01, 0.999)
        clipped = F.least(F.greatest(v, "lo"), "hi")
        if kind == "unit":
            return levels.withColumn("n", F.when(F.col("hi") > F.col("lo"), (clipped - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).drop("lo", "hi")
        c = levels.withColumn("c", clipped)
        stats = c.groupBy("volume", "t").agg(F.avg("c").alias("m"), F.stddev_pop("c").alias("s"))
        return _of_frame(c, stats).withColumn("n", (F.col("c") - F.col("m")) / F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s"))).drop("lo", "hi", "c", "m", "s")
    levels = _levels(voxels, 0.01, 0.997).withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1.0).otherwise(F.col("hi")))
    n = F.greatest((v - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0))
    return levels.withColumn("n", n if kind == "below" else F.least(n, F.lit(1.0))).drop("lo", "hi")


def box_maximum(voxels: DataFrame, value: str = "v", size: tuple[int, int, int] = (3, 7, 7)) -> DataFrame:
    """Adds ``mx``: the greatest value in the box around each voxel of a full grid, by one window per axis."""
    out = voxels.withColumn("mx", F.col(value))
    for axis, n in zip("zyx", size, strict=True):
        others = [a for a in "zyx" if a != axis]
        out = out.withColumn("mx", F.max("mx").over(Window.partitionBy("volume", "t", *others).orderBy(axis).rowsBetween(-(n // 2), n // 2)))
    return out


def threshold_peaks(voxels: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    """Local maxima of the 3 x 7 x 7 box that exceed the threshold."""
    return box_maximum(voxels, value).where((F.col(value) == F.col("mx")) & (F.col(value) > threshold)).drop("mx")


def top_per_frame(detections: DataFrame, k: int | None, order: str = "node_id") -> DataFrame:
    """The k highest scores of each frame; equal scores keep the earlier row; None or k <= 0 keeps everything."""
    if k is None or k <= 0:
        return detections
    rank = F.row_number().over(Window.partitionBy("volume", "t").orderBy(F.col("score").desc(), order))
    return detections.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def dedup_voxels(detections: DataFrame, order: str = "node_id") -> DataFrame:
    """The highest score on each rounded voxel of a frame."""
    cell = [half_even(F.col(k)) for k in "zyx"]
    rank = F.row_number().over(Window.partitionBy("volume", "t", *cell).orderBy(F.col("score").desc(), order))
    return detections.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


#: Voxels along x that one row of a join holds.
RUN = 16


def refine_centroids(points: DataFrame, voxels: DataFrame, window: tuple[int, int, int] = (1, 3, 3)) -> DataFrame:
    """Intensity-weighted centres in the box around each point; points in dark boxes stay.

    Boxes and voxels meet by runs of ``RUN`` voxels along x, so that the join has equal keys only and few rows. Its sizes
    are guessed as before the explosion, so it merges and never broadcasts.
    """
    c = points.withColumns({f"c{k}": half_even(F.col(k)) for k in "zyx"})
    for k, w in zip("zy", window, strict=False):
        c = c.withColumn(f"b{k}", F.explode(F.sequence(F.col(f"c{k}") - w, F.col(f"c{k}") + w)))
    c = c.withColumns({"x0": F.col("cx") - window[2], "x1": F.col("cx") + window[2]})
    c = c.withColumn("run", F.explode(F.sequence(F.floor(F.col("x0") / RUN), F.floor(F.col("x1") / RUN)))).select("volume", "t", "node_id", "bz", "by", "x0", "x1", "run")
    v = voxels.select("volume", "t", *[F.col(k).cast("long").alias(f"b{k}") for k in "zyx"], F.col("v").cast("double").alias("v"))
    runs = v.groupBy("volume", "t", "bz", "by", F.floor(F.col("bx") / RUN).alias("run")).agg(F.collect_list(F.struct("bx", "v")).alias("held"))
    joined = c.hint("merge").join(runs, ["volume", "t", "bz", "by", "run"]).select("volume", "t", "node_id", "bz", "by", "x0", "x1", F.inline("held")).where("bx between x0 and x1")
    sums = joined.groupBy("volume", "t", "node_id").agg(F.sum("v").alias("s"), *[(F.sum(F.col("v") * F.col(f"b{k}"))).alias(f"s{k}") for k in "zyx"])
    out = points.join(sums.hint("merge"), ["volume", "t", "node_id"], "left")
    return out.withColumns({k: F.when(F.col("s") > 0, F.col(f"s{k}") / F.col("s")).otherwise(F.col(k)) for k in "zyx"}).drop("s", "sz", "sy", "sx")


# ---------------------------------------------------------------- patch grids

#: The patch sizes that the loader accepts.
PATCHES = ((64, 64, 64), (32, 128, 128))


def axis_starts(size: Column | int, patch: int) -> Column:
    """Multiples of the patch that fit, and a last start flush with the end."""
    last = (F.lit(size) - patch).cast("long") if isinstance(size, int) else (size - patch).cast("long")
    zero = F.lit(0).cast("long")
    return F.array_sort(F.array_distinct(F.concat(F.sequence(zero, last, F.lit(patch).cast("long")), F.array(last))))


def patch_grids(shapes: DataFrame, patch: tuple[int, int, int]) -> DataFrame:
    """volume, patch_no, z0, y0, x0 of the patches that cover each volume of ``shapes`` (volume, nz, ny, nx), z first. A
    patch's number follows from its places along the axes, so no task numbers a grid."""
    if tuple(patch) not in PATCHES:
        raise ValueError(f"patch must be one of {PATCHES}")
    if not (small := shapes.where(" or ".join(f"n{k} < {p}" for k, p in zip("zyx", patch, strict=True))).limit(1)).isEmpty():
        raise ValueError(f"patch exceeds the volume {small.first().volume}")
    grid = shapes.select("volume", "nz", "ny", "nx").withColumn("patch_no", F.lit(0).cast("long"))
    for k, p in zip("zyx", patch, strict=True):
        grid = grid.withColumn("_s", axis_starts(F.col(f"n{k}"), p)).select("*", F.posexplode("_s").alias("_i", f"{k}0"))
        grid = grid.withColumn("patch_no", F.col("patch_no") * F.size("_s") + F.col("_i")).drop("_s", "_i")
    return grid.select("volume", "patch_no", "z0", "y0", "x0")


def _one(spark: SparkSession, shape: tuple[int, int, int]) -> DataFrame:
    return spark.createDataFrame([("", *shape)], "volume string, nz long, ny long, nx long")


def patch_grid(spark: SparkSession, shape: tuple[int, int, int], patch: tuple[int, int, int]) -> DataFrame:
    """The grid of one volume of a given shape."""
    return patch_grids(_one(spark, shape), patch).drop("volume")


def decode_index(index: Column, frames: int, patches: int) -> dict[str, Column]:
    """Volume number, frame and patch number of a flat index over volumes, frames and patches."""
    return {"volume_no": F.floor(index / (frames * patches)), "t": F.floor(index / patches) % frames, "patch_no": index % patches}


def half_overlap_windows(shapes: DataFrame, patch: tuple[int, int, int]) -> DataFrame:
    """Window starts of each volume of ``shapes`` (volume, nz, ny, nx) at half patches up to the end of each axis, and the
    zero padding that each needs."""
    grid = shapes.select("volume", "nz", "ny", "nx")
    for k, p in zip("zyx", patch, strict=True):
        n = F.col(f"n{k}").cast("long")
        grid = grid.withColumn(f"{k}0", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(max(1, p // 2)).cast("long"))))
        grid = grid.withColumn(f"pad_{k}", F.greatest(F.lit(0), F.col(f"{k}0") + p - n).cast("long"))
    return grid.drop("nz", "ny", "nx")


def stitch(patches: DataFrame) -> DataFrame:
    """Mean of overlapping outputs (volume, t, z, y, x, v) per voxel."""
    return patches.groupBy("volume", "t", "z", "y", "x").agg((F.sum("v") / F.greatest(F.count("*"), F.lit(1))).alias("v"), F.count("*").alias("n"))


def crop_starts(points: DataFrame, patch: int, shape: tuple[int, int, int]) -> DataFrame:
    """Starts z0, y0, x0 of the centred crop of each point, clamped into the volume."""
    starts = {f"{k}0": F.least(F.greatest(half_even(F.col(k)) - patch // 2, F.lit(0).cast("long")), F.lit(s - patch).cast("long")) for k, s in zip("zyx", shape, strict=True)}
    return points.withColumns(starts)


def gaussian_targets(cells: DataFrame, patch: int, sigma: float = 2.0) -> DataFrame:
    """Long-form heatmap exp(-d² / 2σ²) around the offsets (oz, oy, ox) of one cell per patch."""
    for k in "zyx":
        cells = cells.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(patch - 1))))
    d2 = sum(((F.col(k) - F.col(f"o{k}")) * (F.col(k) - F.col(f"o{k}")) for k in "zyx"), F.lit(0.0))
    return cells.withColumn("v", F.exp(-d2 / (2 * sigma * sigma)))


def multi_cell_targets(cells: DataFrame, patch: tuple[int, int, int], sigma: float = 2.0) -> DataFrame:
    """Greatest Gaussian of the cells in a patch per voxel; offsets are cut to integers, reach is 3 σ along each axis."""
    reach = int(3 * sigma)
    inside = cells.withColumns({f"o{k}": F.col(f"o{k}").cast("long") for k in "zyx"})
    for k, p in zip("zyx", patch, strict=True):
        inside = inside.where((F.col(f"o{k}") >= 0) & (F.col(f"o{k}") < p))
    for k, p in zip("zyx", patch, strict=True):
        inside = inside.withColumn(k, F.explode(F.sequence(F.greatest(F.col(f"o{k}") - reach, F.lit(0)), F.least(F.col(f"o{k}") + reach, F.lit(p - 1)))))
    d2 = sum(((F.col(k) - F.col(f"o{k}")) * (F.col(k) - F.col(f"o{k}")) for k in "zyx"), F.lit(0))
    return inside.groupBy("patch_id", "z", "y", "x").agg(F.max(F.exp(-d2 / (2 * sigma * sigma))).alias("v"))


def negative_patches(candidates: DataFrame, cells: DataFrame, n: int, patch: int, seed: str = "negatives") -> DataFrame:
    """At most n candidate centres per volume and frame with no cell within the L1 distance, the smallest hashes first."""
    # an equi-join on grid cells four patches wide; a candidate goes to each cell within its reach
    cell = lambda k, move: F.floor((F.col(k) + move) / (4.0 * patch)).cast("long")
    c, g = candidates, cells.select("volume", "t", "z", "y", "x", *[cell(k, 0).alias(f"c{k}") for k in "zyx"])
    for k in "zyx":
        c = c.withColumn(f"c{k}", F.explode(F.sequence(cell(k, -patch), cell(k, patch))))
    same = [F.col(f"c.{n}") == F.col(f"g.{n}") for n in ("volume", "t", "cz", "cy", "cx")]
    apart = sum((F.abs(F.col(f"c.{k}") - F.col(f"g.{k}")) for k in "zyx"), F.lit(0))
    near = c.alias("c").hint("merge").join(g.alias("g"), [*same, apart < patch]).select("c.volume", "c.t", "c.candidate_id").distinct()
    free = candidates.join(near, ["volume", "t", "candidate_id"], "left_anti")
    hashed = F.md5(F.concat_ws("|", F.lit(seed), "volume", F.col("t").cast("string"), F.col("candidate_id").cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy("volume", "t").orderBy(hashed))
    return free.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


#: Voxels along z, y and x that are painted at once.
TILE = (64, 256, 256)


def _painted(nodes: DataFrame, radii: tuple[int, int, int], shape: tuple[int, int, int] | None, fields: dict[str, str], row: Callable[..., list]) -> DataFrame:
    """Boxes around nodes, painted tile by tile in the order of ``ord``: only nodes are shuffled, each to the tiles that its
    box touches. ``row`` makes the columns ``fields`` of the places that a node keeps."""
    n = nodes.select("volume", "t", "label", "ord", *[half_even(F.col(k)).alias(f"c{k}") for k in "zyx"])
    for i, (k, r) in enumerate(zip("zyx", radii, strict=True)):
        top = F.col(f"c{k}") + r
        n = n.withColumns({f"a{k}": F.greatest(F.col(f"c{k}") - r, F.lit(0).cast("long")), f"b{k}": top if shape is None else F.least(top, F.lit(shape[i] - 1).cast("long"))})
    n = n.drop("cz", "cy", "cx").where("az <= bz and ay <= by and ax <= bx")
    for k, size in zip("zyx", TILE, strict=True):
        n = n.withColumn(f"i{k}", F.explode(F.sequence(F.floor(F.col(f"a{k}") / size), F.floor(F.col(f"b{k}") / size))))
    kinds = {c: nodes.schema[c].dataType.simpleString() for c in ("volume", "t", "label")}

    def paint(tile: pa.Table) -> pa.Table:
        tile = tile.take(pc.sort_indices(tile, sort_keys=[("ord", "ascending")], null_placement="at_start"))
        column = lambda names: np.stack([tile.column(c).to_numpy() for c in names], axis=1)
        corner = column(("iz", "iy", "ix"))[0] * TILE
        low, high = np.maximum(column(("az", "ay", "ax")), corner), np.minimum(column(("bz", "by", "bx")), corner + TILE - 1)
        first = low.min(axis=0)
        canvas = np.zeros(high.max(axis=0) + 1 - first, np.int32)
        boxes = [tuple(slice(a, b) for a, b in zip(*ends, strict=True)) for ends in zip((low - first).tolist(), (high - first + 1).tolist(), strict=True)]
        for i, box in enumerate(boxes):
            canvas[box] = i + 1
        seen, made = [], []
        for i, box in enumerate(boxes):
            places = (canvas[box] == i + 1).nonzero()
            if len(places[0]):
                made.append(row(*[p + o for p, o in zip(places, low[i].tolist(), strict=True)]))
                seen.append((i, len(made[-1][0])))
        at = np.repeat(*np.array(seen).T)
        own = tile.select(["volume", "t"]).take(at)
        # of places without an order the label is null
        label = pc.if_else(pc.is_valid(tile.column("ord")), tile.column("label"), None).take(at)
        return pa.table({"volume": own.column("volume"), "t": own.column("t"), "label": label, **{c: np.concatenate(part) for c, part in zip(fields, zip(*made, strict=True), strict=True)}})

    return n.groupBy("volume", "t", "iz", "iy", "ix").applyInArrow(paint, ", ".join(f"{c} {kind}" for c, kind in (kinds | fields).items()))


def paint_labels(nodes: DataFrame, radii: tuple[int, int, int] = (2, 4, 4), shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Label per voxel of the boxes around nodes; the later node (greater ``ord``) wins."""
    return _painted(nodes, radii, shape, dict.fromkeys("zyx", "long"), lambda *places: places).select("volume", "t", "z", "y", "x", "label")


def painted_sums(nodes: DataFrame, radii: tuple[int, int, int] = (2, 4, 4), shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Of each label that ``paint_labels`` leaves in a frame the number of voxels, and the sums of their places."""
    parts = _painted(nodes, radii, shape, dict.fromkeys(("n", "z", "y", "x"), "long"), lambda *places: [[len(places[0])], *[[int(p.sum())] for p in places]])
    return parts.groupBy("volume", "t", "label").agg(*[F.sum(k).alias(k) for k in ("n", "z", "y", "x")])


# ---------------------------------------------------------------- array kernels


def gaussian_filter(a: np.ndarray, sigma: tuple[float, ...], mode: str = "reflect", truncate: float = 4.0) -> np.ndarray:
    """Separable Gaussian; ``reflect`` repeats the edge when mirroring, ``nearest`` extends it."""
    out = a.astype(np.float64)
    for axis, s in enumerate(sigma):
        if s <= 1e-15:
            continue
        r = int(truncate * s + 0.5)
        x = np.arange(-r, r + 1)
        w = np.exp(-0.5 * (x / s) ** 2)
        w /= w.sum()
        pad = [(r, r) if k == axis else (0, 0) for k in range(out.ndim)]
        wide = np.pad(out, pad, mode="symmetric" if mode == "reflect" else "edge")
        n = out.shape[axis]
        out = np.zeros(out.shape)
        for k, wk in enumerate(w):
            out += wk * wide[tuple(slice(k, k + n) if i == axis else slice(None) for i in range(wide.ndim))]
    return out


def maximum_filter(a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Greatest value over the (dz, dy, dx) offsets, edges extended."""
    r = np.abs(offsets).max(axis=0)
    if len(offsets) == np.prod(2 * r + 1):  # a whole box: axis by axis
        for axis, k in enumerate(r):
            wide = np.pad(a, [(k, k) if i == axis else (0, 0) for i in range(a.ndim)], mode="edge")
            a = np.max(np.lib.stride_tricks.sliding_window_view(wide, 2 * k + 1, axis=axis), axis=-1)
        return a
    wide = np.pad(a, [(k, k) for k in r], mode="edge")
    out = np.full(a.shape, -np.inf)
    for o in offsets:
        at = tuple(slice(k + d, k + d + n) for k, d, n in zip(r, o, a.shape, strict=True))
        np.maximum(out, wide[at], out=out)
    return out


def box_offsets(size: tuple[int, int, int] = (3, 7, 7)) -> np.ndarray:
    return np.stack(np.meshgrid(*[np.arange(-(n // 2), n // 2 + 1) for n in size], indexing="ij"), axis=-1).reshape(-1, 3)


def ball_offsets(radius_um: float, spacing: tuple[float, float, float]) -> np.ndarray:
    """Offsets within the physical radius; each axis reaches at least one voxel."""
    reach = [max(1, int(np.round(radius_um / s))) for s in spacing]
    grid = np.stack(np.meshgrid(*[np.arange(-n, n + 1) for n in reach], indexing="ij"), axis=-1).reshape(-1, 3)
    return grid[((grid * np.array(spacing)) ** 2).sum(axis=1) <= radius_um**2]


def dog_v1(normalized: np.ndarray, sigmas: tuple[float, ...]) -> np.ndarray:
    """Greatest difference of Gaussians over scales in voxels, floored at 0."""
    out = np.zeros(normalized.shape)
    for s in sigmas:
        small = (max(0.6, 0.35 * s), s, s)
        response = gaussian_filter(normalized, small, "nearest", 2.5) - gaussian_filter(normalized, tuple(1.6 * k for k in small), "nearest", 2.5)
        np.maximum(out, response, out=out)
    return out


def dog_v2(normalized: np.ndarray, spacing: tuple[float, float, float], scales: tuple[tuple[float, float], ...]) -> np.ndarray:
    """Greatest difference of Gaussians over (small, large) pairs in micrometres."""
    return np.max([gaussian_filter(normalized, tuple(a / s for s in spacing)) - gaussian_filter(normalized, tuple(b / s for s in spacing)) for a, b in scales], axis=0)


def normalize_unit(frame: np.ndarray) -> np.ndarray:
    lo, hi = np.percentile(frame, [1.0, 99.9])
    return np.zeros(frame.shape) if hi <= lo else (np.clip(frame, lo, hi) - lo) / (hi - lo)


def _ordered(points: np.ndarray, scores: np.ndarray, most: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By score, descending; equal scores by position."""
    order = np.lexsort((*points.T[::-1], -scores))[:most]
    points = points[order].astype(np.float64)
    points[:, 1:] *= k
    return points, scores[order]


def detect_v1(frame: np.ndarray, sigmas=(1.0, 1.5, 2.0, 2.5, 3.0), quantile: float = 0.9995, min_score: float = 0.015, most: int = 350, least: int = 40, k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Peaks above the greater of a score and a quantile of the response, or all positive peaks where those are few."""
    if k > 1:
        frame, sigmas = frame[:, ::k, ::k], tuple(max(0.5, s / k) for s in sigmas)
    response = dog_v1(normalize_unit(frame.astype(np.float64)), tuple(sigmas))
    peak = response == maximum_filter(response, box_offsets())
    found = np.argwhere(peak & (response >= max(min_score, float(np.quantile(response, quantile)))))
    if len(found) < least:
        found = np.argwhere(peak & (response > 0))
    return _ordered(found, response[tuple(found.T)], most, k)


def _response_v2(frame: np.ndarray, k: int, scales: tuple[tuple[float, float], ...]) -> tuple[np.ndarray, np.ndarray, tuple[float, float, float]]:
    """Response and normalized intensity of the downsampled frame, and its spacing."""
    ds = frame[:, ::k, ::k].astype(np.float64)
    spacing = (SCALE["z"], SCALE["y"] * k, SCALE["x"] * k)
    lo, hi = np.percentile(ds, [1.0, 99.7])
    hi = lo + 1.0 if hi <= lo else hi
    n = np.clip((ds - lo) / (hi - lo), 0, None)
    return dog_v2(n, spacing, tuple(scales)), n, spacing


def detect_v2(frame: np.ndarray, k: int = 4, scales=((1.5, 4.0), (2.2, 5.5)), rel: float = 0.045, percentile: float = 50.0, radius_um: float = 3.2, most: int | None = 40000, refine: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Peaks of the micrometre response within an ellipsoid, bright enough in the normalized frame; optionally refined."""
    response, n, spacing = _response_v2(frame, k, scales)
    peak = (response == maximum_filter(response, ball_offsets(radius_um, spacing))) & (response >= max(rel, 0.0)) & (n >= np.percentile(n, percentile))
    found = np.argwhere(peak)
    points, scores = _ordered(found, response[tuple(found.T)], most, k)
    return (centroids(frame, points) if refine else points), scores


def candidates_v2(frame: np.ndarray, least_rel: float, radii_um: tuple[float, float], k: int = 4, scales=((1.5, 4.0), (2.2, 5.5)), percentile: float = 50.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``detect_v2`` finds for any threshold from ``least_rel`` on and any radius in a range: refined points by score,
    scores, and how far off the nearest greater response is (infinite beyond the range).

    A point is found at a threshold and radius if its score reaches the one and its distance exceeds the other.
    """
    response, n, spacing = _response_v2(frame, k, scales)
    low, high = radii_um
    peak = (response == maximum_filter(response, ball_offsets(low, spacing))) & (response >= max(least_rel, 0.0)) & (n >= np.percentile(n, percentile))
    found = np.argwhere(peak)
    points, scores = _ordered(found, response[tuple(found.T)], None, k)
    at = np.rint(points / (1, k, k)).astype(np.int64)
    offsets = ball_offsets(high, spacing)
    reach = np.abs(offsets).max(axis=0)
    wide = np.pad(response, [(r, r) for r in reach], constant_values=-np.inf)
    clear = np.full(len(at), np.inf)
    for o in offsets:
        far = float(np.sqrt(((o * np.array(spacing)) ** 2).sum()))
        greater = wide[tuple((at + reach + o).T)] > scores
        clear[greater] = np.minimum(clear[greater], far)
    return centroids(frame, points), scores, clear


def centroids(frame: np.ndarray, points: np.ndarray, window: tuple[int, int, int] = (1, 3, 3), corner=(0, 0, 0)) -> np.ndarray:
    """Intensity-weighted centres of boxes cut at the frame's edges; dark boxes keep the point. One step per place in the
    box, for all points at once. Points are relative to ``corner``, the place of the array in a larger frame; centres are not."""
    at = np.rint(points).astype(np.int64)
    total, sums = np.zeros(len(at)), np.zeros((len(at), 3))
    for o in box_offsets(tuple(2 * w + 1 for w in window)):
        place = at + o
        inside = ((place >= 0) & (place < frame.shape)).all(axis=1)
        v = np.where(inside, frame[tuple(np.where(inside[:, None], place, 0).T)].astype(np.float64), 0.0)
        total += v
        sums += v[:, None] * (place + np.array(corner))
    bright = total > 0
    return np.where(bright[:, None], sums / np.where(bright, total, 1.0)[:, None], points.astype(np.float64) + np.array(corner))


POINTS = "volume string, t long, z double, y double, x double, score double"


def detect_frames(frames: DataFrame, detector: Callable[..., tuple[np.ndarray, np.ndarray]] = detect_v2, **options) -> DataFrame:
    """Detections of dense frames (volume, t, shape, data: little-endian uint16), frame by frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                points, scores = detector(np.frombuffer(r.data, dtype="<u2").reshape(tuple(r.shape)), **options)
                yield pd.DataFrame({"volume": r.volume, "t": np.int64(r.t), "z": points[:, 0], "y": points[:, 1], "x": points[:, 2], "score": scores.astype(np.float64)}, columns=["volume", "t", "z", "y", "x", "score"])

    return frames.select("volume", "t", "shape", "data").mapInPandas(run, POINTS)


def candidate_frames(frames: DataFrame, least_rel: float, radii_um: tuple[float, float], **options) -> DataFrame:
    """``candidates_v2`` of dense frames, frame by frame: beside the point ``clear_um`` and ``place``, its number by score from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                points, scores, clear = candidates_v2(np.frombuffer(r.data, dtype="<u2").reshape(tuple(r.shape)), least_rel, radii_um, **options)
                yield pd.DataFrame({"volume": r.volume, "t": np.int64(r.t), "z": points[:, 0], "y": points[:, 1], "x": points[:, 2], "score": scores, "clear_um": clear, "place": np.arange(1, len(scores) + 1)})

    return frames.select("volume", "t", "shape", "data").mapInPandas(run, f"{POINTS}, clear_um double, place long")


def detect_by_scorer(frames: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], patch: tuple[int, int, int] = (32, 64, 64), threshold: float = 0.1) -> DataFrame:
    """Every voxel whose score exceeds the threshold, over half-overlapping zero-padded windows; the highest score stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                frame = np.frombuffer(r.data, dtype="<u2").reshape(tuple(r.shape)).astype(np.float64)
                best = np.full(frame.shape, -np.inf)
                lo, hi = np.percentile(frame, [1.0, 99.9])
                c = np.clip(frame, lo, hi)
                sd = c.std()
                c = (c - c.mean()) / (sd if sd >= 1e-6 else 1.0)
                for at in np.ndindex(*[math.ceil(n / max(1, p // 2)) for n, p in zip(frame.shape, patch, strict=True)]):
                    start = [i * max(1, p // 2) for i, p in zip(at, patch, strict=True)]
                    box = tuple(slice(s, min(n, s + p)) for s, p, n in zip(start, patch, frame.shape, strict=True))
                    part = c[box]
                    wide = np.pad(part, [(0, p - n) for p, n in zip(patch, part.shape, strict=True)])
                    np.maximum(best[box], scorer(wide)[tuple(slice(0, n) for n in part.shape)], out=best[box])
                z, y, x = np.nonzero(best > threshold)
                yield pd.DataFrame({"volume": r.volume, "t": np.int64(r.t), "z": z.astype(float), "y": y.astype(float), "x": x.astype(float), "score": best[z, y, x]}, columns=["volume", "t", "z", "y", "x", "score"])

    return frames.select("volume", "t", "shape", "data").mapInPandas(run, POINTS)


def to_dense(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Long-form voxels as dense frames: a frame's voxels are put in their places batch by batch, so a task holds one dense
    frame. Voxels that are not there are 0; positions outside of the shape and values beyond 16 bits raise ValueError."""

    def packed(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        volume, t = (k.as_py() for k in key)
        out = np.zeros(shape, dtype="<u2")
        for batch in batches:
            held = [batch.column(batch.schema.get_field_index(c)) for c in ("z", "y", "x", "v")]
            values = [c.to_numpy(zero_copy_only=False) for c in held]
            if any(c.null_count for c in held) or not all(((0 <= a) & (a < n)).all() for a, n in zip(values, (*shape, 65535 + 1), strict=True)):
                raise ValueError(f"voxels outside of {shape} or of 16 bits: {volume}, frame {t}")
            out[tuple(a.astype(np.int64) for a in values[:3])] = values[3]
        made = {"volume": pa.array([volume], pa.string()), "t": pa.array([t], pa.int32()), "shape": pa.array([list(shape)], pa.list_(pa.int32())), "data": pa.array([out.tobytes()], pa.binary())}
        yield pa.RecordBatch.from_arrays(list(made.values()), list(made))

    return voxels.select("volume", "t", "z", "y", "x", "v").groupBy("volume", "t").applyInArrow(packed, "volume string, t int, shape array<int>, data binary")
