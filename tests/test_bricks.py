"""Detection in bricks equals the kernels on whole frames, bit for bit."""

from __future__ import annotations

import gzip
import itertools
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import cli, schema
from weftline.operators import bricks, detection
from weftline.sources import chunked


def _frames(spark, shape, seed=5):
    rng = np.random.default_rng(seed)
    kinds = [rng.integers(0, 900, shape), np.full(shape, 7), rng.integers(0, 3, shape) * 20000, rng.gamma(0.4, 400, shape).astype(int).clip(0, 65535)]
    z, y, x = np.meshgrid(*[np.arange(n) for n in shape], indexing="ij")
    for _ in range(12):
        c = [rng.integers(0, n) for n in shape]
        kinds[0] = kinds[0] + 9000 * np.exp(-((z - c[0]) ** 2 + (y - c[1]) ** 2 / 16 + (x - c[2]) ** 2 / 16) / 2)
    data = [("v", t, list(shape), bytearray(k.astype("<u2").tobytes())) for t, k in enumerate(kinds)]
    return spark.createDataFrame(data, schema.FRAMES)


def _rows(df):
    return sorted(tuple(r) for r in df.select("volume", "t", "z", "y", "x", "score").collect())


CASES = [((9, 45, 38), (4, 16, 12), {"k": 2}), ((9, 45, 38), (16, 64, 64), {"k": 4}), ((6, 20, 30), (3, 6, 28), {"k": 1, "most": 30})]


@pytest.mark.parametrize(("shape", "brick", "options"), CASES)
def test_bricks_equal_whole_frames_v2(spark, shape, brick, options):
    frames = _frames(spark, shape).cache()
    whole = _rows(detection.detect_frames(frames, detection.detect_v2, rel=0.01, **options))
    assert whole and whole == _rows(bricks.detect_bricks_v2(bricks.cut_frames(frames, brick), rel=0.01, **options))
    if options["k"] != 4:
        return
    loose = dict(options, refine=False, percentile=73.0)
    assert _rows(detection.detect_frames(frames, detection.detect_v2, **loose)) == _rows(bricks.detect_bricks_v2(bricks.cut_frames(frames, brick), **loose))


@pytest.mark.parametrize(("shape", "brick", "options"), CASES)
def test_bricks_equal_whole_frames_v1(spark, shape, brick, options):
    frames = _frames(spark, shape).cache()
    more = {"least": 400} if options["k"] == 4 else {"least": 2, "quantile": 0.98}
    whole = _rows(detection.detect_frames(frames, detection.detect_v1, **options, **more))
    assert whole and whole == _rows(bricks.detect_bricks_v1(bricks.cut_frames(frames, brick), **options, **more))


def test_quantiles_of_responses_and_frames(spark):
    rng = np.random.default_rng(3)
    parts, want = [], {}
    for t, values in enumerate([rng.random(1001), np.zeros(50), np.array([0.0, 5e-324, 1e300]), np.array([2.5]), np.repeat([0.25, 0.5], 40)]):
        want[t] = np.quantile(values, 0.9)
        parts += [("v", t, bytearray(p.astype("<f8").tobytes())) for p in np.array_split(values, 3)]
    df = spark.createDataFrame(parts, "volume string, t int, response binary")
    assert {r.t: r["quantile"] for r in bricks.exact_quantile(df, 0.9).collect()} == want
    frames = _frames(spark, (5, 9, 7))
    got = bricks.frame_order(bricks.cut_frames(frames, (2, 4, 4)), 2, {"q": 0.37}).select("t", bricks._level("q").alias("q"))
    arrays = {r.t: np.frombuffer(r.data, "<u2").reshape(r.shape)[:, ::2, ::2].astype(float) for r in frames.collect()}
    assert dict(tuple(r) for r in got.collect()) == {t: np.quantile(a, 0.37) for t, a in arrays.items()}


def test_bricks_must_cover_and_fit(spark):
    cut = bricks.cut_frames(_frames(spark, (4, 16, 16)), (4, 8, 8))
    with pytest.raises(Exception, match="cover"):
        bricks.detect_bricks_v2(cut.where("origin[2] = 0 or origin[1] = 0"), k=2).count()
    with pytest.raises(Exception, match="multiple"):
        bricks.detect_bricks_v2(cut, k=3).count()
    assert bricks.detect_bricks_v1(cut.where(F.lit(False))).count() == 0 and bricks.detect_bricks_v2(cut.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("version", [2, 3])
def test_chunks_are_bricks(spark, tmp_path, version):
    """A volume stored in several chunks a frame, one of them absent, gives the frames' own points."""
    shape, chunk = (9, 45, 38), (4, 16, 20)
    frames = _frames(spark, shape).where("t in (0, 3)").collect()
    stack = np.stack([np.frombuffer(r.data, "<u2").reshape(shape) for r in frames]).copy()
    stack[1, 4:8, 16:32, 20:38] = 0
    folder = tmp_path / "a_1.zarr"
    folder.mkdir()
    if version == 2:
        meta, name = {"zarr_format": 2, "shape": stack.shape, "chunks": [1, *chunk], "dtype": "<u2", "compressor": {"id": "zlib"}, "fill_value": 0, "order": "C", "filters": None}, ".zarray"
    else:
        meta = {"zarr_format": 3, "node_type": "array", "shape": stack.shape, "data_type": "uint16", "chunk_grid": {"configuration": {"chunk_shape": [1, *chunk]}}, "codecs": [{"name": "bytes"}, {"name": "gzip"}], "chunk_key_encoding": {"configuration": {"separator": "/"}}}
        name = "zarr.json"
    (folder / name).write_text(json.dumps(meta))
    for t, at in itertools.product(range(2), np.ndindex(3, 3, 2)):
        low = [j * c for j, c in zip(at, chunk, strict=True)]
        held = np.zeros(chunk, "<u2")
        part = stack[t][tuple(slice(a, a + c) for a, c in zip(low, chunk, strict=True))]
        held[tuple(slice(n) for n in part.shape)] = part
        if (t, at) == (1, (1, 1, 1)):
            assert not held.any()
            continue
        key = [str(k) for k in (t, *at)]
        f = folder / (".".join(key) if version == 2 else "/".join(["c", *key]))
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes((zlib if version == 2 else gzip).compress(held.tobytes()))
    chunked.register(spark)
    stored = spark.read.format("chunked_bricks").load(str(tmp_path))
    assert stored.schema.simpleString() == spark.createDataFrame([], bricks.BRICKS).schema.simpleString()
    assert stored.count() == 36 and spark.read.format("chunked_bricks").option("first_t", 1).load(str(tmp_path)).rdd.getNumPartitions() == 3
    dense = spark.createDataFrame([("a_1", t, list(shape), bytearray(stack[t].tobytes())) for t in range(2)], schema.FRAMES)
    assert _rows(bricks.detect_bricks_v2(stored, rel=0.01)) == _rows(detection.detect_frames(dense, detection.detect_v2, rel=0.01))
    if version == 2:
        out = tmp_path / "out"
        cli.main(["detect", "--test-dir", str(tmp_path), "--output", str(out), "--bricks"])
        assert out.exists()
