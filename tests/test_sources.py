import json
import struct
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline import cli, schema
from weftline.plans.views import Views
from weftline.sources import blosc, chunked, lineage_store, tables

DATA = "/root/testdata/sf0.001"


def volume(tmp_path, name="a_1", codec="zlib", shape=(3, 4, 6, 5)):
    data = np.random.RandomState(0).randint(0, 60000, size=shape).astype("<u2")
    chunked.write_volume(tmp_path / f"{name}.zarr", data, codec)
    return data


@pytest.mark.parametrize("codec", ["zlib", "raw", "blosc"])
def test_chunked_frames(spark, tmp_path, codec):
    data = volume(tmp_path, codec=codec)
    volume(tmp_path, "b_2", codec)
    chunked.register(spark)
    df = spark.read.format("chunked_frames").load(str(tmp_path))
    assert df.schema.simpleString() == schema.FRAMES.simpleString() and df.count() == 6
    r = df.where("volume = 'a_1' and t = 2").first()
    assert (np.frombuffer(r.data, "<u2").reshape(r.shape) == data[2]).all()
    (tmp_path / "a_1.zarr" / "1.0.0.0").unlink()
    assert set(spark.read.format("chunked_frames").load(str(tmp_path / "a_1.zarr")).where("t = 1").first().data) == {0}


def test_group_member_and_version_3(tmp_path):
    folder = tmp_path / "g.zarr" / "0"
    (folder / "c/0/0/0").mkdir(parents=True)
    meta = {"zarr_format": 3, "node_type": "array", "shape": [1, 1, 2, 2], "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1, 1, 2, 2]}}, "codecs": [{"name": "bytes"}], "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}}
    (folder / "zarr.json").write_text(json.dumps(meta))
    (folder / "c/0/0/0/0").write_bytes(np.arange(4, dtype="<u2").tobytes())
    assert np.frombuffer(chunked.read_frame(chunked.array_info(tmp_path / "g.zarr"), 0)[1], "<u2").tolist() == [0, 1, 2, 3]


def test_bad_volumes(tmp_path):
    volume(tmp_path)
    with pytest.raises(ValueError, match="nothing"):
        chunked.find_volumes([tmp_path / "a_1.zarr", tmp_path / "nothing"])
    meta = json.loads((tmp_path / "a_1.zarr/.zarray").read_text())
    (tmp_path / "a_1.zarr/.zarray").write_text(json.dumps(meta | {"chunks": [2, 4, 6, 5]}))
    with pytest.raises(ValueError, match="one frame"):
        chunked.read_frame(chunked.array_info(tmp_path / "a_1.zarr"), 0)
    with pytest.raises(NotImplementedError, match="lzma"):
        chunked.decompress(b"", "lzma")


def frame_by_hand(data, size, codec, flags, block):
    """A Blosc frame built element by element and bit by bit."""
    import zlib

    import zstandard

    press = zlib.compress if codec == 3 else zstandard.ZstdCompressor().compress
    starts, body, at = [], b"", 16 + 4 * -(-len(data) // block)
    for k in range(0, len(data), block):
        part = data[k : k + block]
        n = len(part) // size
        items = [part[i * size : (i + 1) * size] for i in range(n)]
        if flags & 4 and n % 8 == 0:
            rows = []
            for byte in range(size):
                for bit in range(8):
                    rows += [sum((items[i + j][byte] >> bit & 1) << j for j in range(8)) for i in range(0, n, 8)]
            part = bytes(rows) + part[n * size :]
        elif flags & 1:
            part = bytes(items[i][byte] for byte in range(size) for i in range(n)) + part[n * size :]
        streams = size if not flags & 16 and len(part) == block and block // size >= 128 else 1
        starts.append(at)
        for q in range(streams):
            own = part[q * len(part) // streams : (q + 1) * len(part) // streams]
            made = press(own)
            made = made if len(made) < len(own) else own
            body += struct.pack("<I", len(made)) + made
            at += 4 + len(made)
    return struct.pack("<4B3I", 2, 1, flags | codec << 5, size, len(data), block, 16 + 4 * len(starts) + len(body)) + struct.pack(f"<{len(starts)}I", *starts) + body


@pytest.mark.parametrize("codec", [3, 4])
@pytest.mark.parametrize("flags", [0, 1, 4, 16, 17, 20])
@pytest.mark.parametrize("size", [1, 2, 8])
def test_blosc_frames_made_by_hand(codec, flags, size):
    rng = np.random.RandomState(flags + size)
    for n in (0, 5, 64, 3000, 5003):
        data = np.repeat(rng.randint(0, 256, n // 3 + 1), 3).astype(np.uint8).tobytes()[:n]
        assert blosc.decode(frame_by_hand(data, size, codec, flags, 1024)) == data


def test_blosc_round_trips_and_errors():
    rng = np.random.RandomState(1)
    data = np.sort(rng.randint(0, 60000, 100_003)).astype("<u2").tobytes()
    for shuffle in ("bits", "bytes", "none"):
        frame = blosc.encode(data, 2, shuffle)
        assert blosc.decode(frame) == data
    assert len(blosc.encode(data, 2)) < len(data) / 2 and blosc.decode(blosc.encode(b"", 2)) == b""
    stored = struct.pack("<4B3I", 2, 1, 2, 2, 6, 6, 22) + b"abcdef"
    assert blosc.decode(stored) == b"abcdef"
    with pytest.raises(ValueError):
        blosc.decode(frame[:-1])
    with pytest.raises(NotImplementedError, match="5"):
        blosc.decode(whole_frame(b"xx", 64, 5))
    for codec in range(5):
        with pytest.raises(ValueError):
            blosc.decode(whole_frame(b"\xff\xfe\xff", 64, codec))


def whole_frame(stream, n, codec):
    """A frame of one unshuffled block of one stream."""
    return struct.pack("<4B3I", 2, 1, 16 | codec << 5, 1, n, n, 24 + len(stream)) + struct.pack("<2I", 20, len(stream)) + stream


@pytest.mark.parametrize("codec,name", [(1, "lz4_raw"), (2, "snappy")])
def test_blosc_over_other_codecs(codec, name):
    data = np.repeat(np.random.RandomState(5).randint(0, 300, 900), 9).astype("<u2").tobytes()
    assert blosc.decode(whole_frame(pa.compress(data, name, asbytes=True), len(data), codec)) == data


def test_blosclz_streams_made_by_hand():
    far = bytes(range(256)) * 40
    literals = b"".join(bytes([31]) + far[k : k + 32] for k in range(0, len(far), 32))
    cases = [
        (b"\x04hello", b"hello"),
        (b"\x02abc" + bytes([1 << 5 | 0, 2]), b"abcabc"),  # three bytes from three back
        (b"\x00a" + bytes([7 << 5, 255, 4, 0]) + b"\x00z", b"a" * (1 + 6 + 255 + 4 + 3) + b"z"),  # a long run of one byte
        (literals + bytes([2 << 5 | 31, 255, 3, 0]), far + far[len(far) - 8192 - 768 :][:4]),  # a far match
        (literals + bytes([2 << 5 | 31, 254]), far + far[len(far) - 8191 :][:4]),  # the farthest of the short ones
    ]
    for stream, data in cases:
        assert blosc._blosclz(stream, len(data)) == data
    stream, data = cases[2]
    assert blosc.decode(whole_frame(stream, len(data), 0)) == data
    with pytest.raises(ValueError):
        blosc._blosclz(b"\x02abc" + bytes([1 << 5, 3]), 6)


def write_array(folder, a, chunk, version, codec="raw"):
    """Numbers as a chunked array."""
    folder.mkdir(parents=True)
    grid = [-(-s // c) for s, c in zip(a.shape, chunk, strict=True)]
    if version == 3:
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}, *([{"name": codec}] if codec != "raw" else [])]
        meta = {"zarr_format": 3, "node_type": "array", "shape": a.shape, "data_type": a.dtype.name, "chunk_grid": {"configuration": {"chunk_shape": chunk}}, "codecs": codecs, "chunk_key_encoding": {"configuration": {"separator": "/"}}, "fill_value": 0}
        (folder / "zarr.json").write_text(json.dumps(meta))
    else:
        (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": chunk, "dtype": a.dtype.str, "compressor": {"id": codec} if codec != "raw" else None, "fill_value": 0, "order": "C", "filters": None}))
    for at in np.ndindex(*grid):
        part = np.zeros(chunk, a.dtype)
        own = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunk, strict=True))]
        part[tuple(slice(0, n) for n in own.shape)] = own
        data = blosc.encode(part.tobytes(), a.dtype.itemsize) if codec == "blosc" else part.tobytes()
        f = folder / ("c/" + "/".join(map(str, at)) if version == 3 else ".".join(map(str, at)))
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)


@pytest.mark.parametrize("version,codec,kind", [(2, "raw", "attrs"), (3, "blosc", "props"), (2, "blosc", "props")])
def test_lineage_stores(spark, tmp_path, version, codec, kind):
    rng = np.random.RandomState(7)
    nodes = {}
    for name, n in (("v1", 25), ("v2", 3)):
        store = tmp_path / f"{name}.geff"
        nodes[name] = [np.arange(n, dtype=np.uint64) * 3, rng.randint(0, 9, n).astype("<i4"), *(rng.rand(n).astype(d) for d in ("<f8", "<f4", "<f8"))]
        write_array(store / "nodes" / "ids", nodes[name][0], (10,), version, codec)
        for c, values in zip("tzyx", nodes[name][1:], strict=True):
            write_array(store / "nodes" / kind / c / "values", values, (7,), version, codec)
        write_array(store / "edges" / "ids", np.stack([nodes[name][0][:-1], nodes[name][0][1:]], axis=1), (6, 1 if n > 5 else 2), version, codec)
        about = {"geff": {"version": "1", "extra": {"estimated_number_of_nodes": 4 * n} if n > 5 else None}}
        (store / ("zarr.json" if version == 3 else ".zattrs")).write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": about} if version == 3 else about))
    n, e, m = lineage_store.read_lineage_stores(spark, str(tmp_path))
    expected = sorted((v, *(x.item() for x in row)) for v, columns in nodes.items() for row in zip(*columns, strict=True))
    assert sorted(map(tuple, n.collect())) == expected and n.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, e.collect())) == sorted((v, int(a), int(b)) for v, c in nodes.items() for a, b in zip(c[0], c[0][1:], strict=False))
    assert {r.volume: r.estimated_number_of_nodes for r in m.collect()} == {"v1": 100, "v2": None}
    assert {r.volume for r in lineage_store.read_lineage_stores(spark, str(tmp_path), ["v2"])[0].collect()} == {"v2"}
    with pytest.raises(FileNotFoundError, match="v9"):
        lineage_store.read_lineage_stores(spark, str(tmp_path), ["v1", "v9"])


def test_options_decide_which_frames_are_read(spark, tmp_path):
    for name in ("a_1", "b_2"):
        volume(tmp_path, name)
    (tmp_path / "c_3.zarr").mkdir()  # without an array: reading it would raise
    chunked.register(spark)
    load = lambda **options: spark.read.format("chunked_frames").options(**options).load(str(tmp_path))
    both = json.dumps(["a_1", "b_2"])
    cases = [({"volumes": '["a_1"]', "first_t": 2, "last_t": 2}, 1), ({"volumes": both, "first_t": 1}, 4), ({"volumes": '["b_2"]', "last_t": 1}, 2), ({"volumes": both, "first_t": 0, "last_t": 0}, 2)]
    for options, n in cases:
        found = load(**options)
        assert found.rdd.getNumPartitions() == n and found.count() == n
    assert load(volumes='["nothing"]').count() == 0 and load(volumes=both, first_t=9).count() == 0


def test_filters_of_one_loaded_table_do_not_meet(spark, tmp_path):
    """A filter on a loaded table leaves what other uses of it read."""
    for name in ("a_1", "b_2"):
        volume(tmp_path, name)
    chunked.register(spark)
    df = spark.read.format("chunked_frames").load(str(tmp_path))
    assert [df.where(c).count() for c in ("t = 1", "true", "volume = 'a_1' and t < 2", "volume is not null")] == [2, 6, 2, 6]
    assert df.where("t = 1").unionByName(df).count() == 8 and df.unionByName(df.where("t = 1")).count() == 8
    assert df.where("t = 0").unionByName(df.where("t = 2")).select("t").distinct().count() == 2
    assert df.where("t = 1").alias("a").join(df.alias("b"), ["volume"]).count() == 6


def test_names_decide_which_stores_are_opened(spark, tmp_path):
    frame = spark.createDataFrame([(v, i, 0, 1.0, 2.0, 3.0) for v in ("a", "b", "c") for i in range(3)], "volume string, node_id long, t long, z double, y double, x double")
    lineage_store.write_lineage_stores(frame, frame.selectExpr("volume", "node_id source_id", "node_id target_id").limit(0), frame.selectExpr("volume", "1 estimated_number_of_nodes").limit(0), str(tmp_path))
    for array in (tmp_path / "c.geff").rglob(".zarray"):
        array.unlink()
    nodes, edges, _ = lineage_store.read_lineage_stores(spark, str(tmp_path), ["a", "b"])
    assert nodes.count() == 6 and nodes.rdd.getNumPartitions() == 2 and edges.count() == 0


def test_stores_appear_whole(spark, tmp_path, monkeypatch):
    """Several chunks per array over several tasks; ids beyond doubles; a job that fails leaves what was there."""
    schema_ = "volume string, node_id long, t long, z double, y double, x double"
    big = 2**60 + 1
    rows = [("v", big + i, i % 5, i / 7, float(i), None if i == 3 else 0.5) for i in range(150_000)] + [("w", 1, 0, 0.0, 0.0, 0.0)]
    nodes = spark.createDataFrame(rows, schema_)
    edges = spark.createDataFrame([("v", big + i + 1, big + i) for i in range(70_000)], "volume string, source_id long, target_id long")
    meta = spark.createDataFrame([("v", 5), ("v", 9), ("w", None), ("x", 2)], "volume string, estimated_number_of_nodes long")
    lineage_store.write_lineage_stores(nodes, edges, meta, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v.geff", "w.geff", "x.geff"]
    assert len(list((tmp_path / "v.geff/nodes/ids").glob("[0-9]*"))) == 3
    n, e, m = lineage_store.read_lineage_stores(spark, str(tmp_path))
    total = "count(*)", "sum(cast(node_id as decimal(38,0)) * (t + 1))", "count_if(isnan(x) or x is null)"
    assert n.selectExpr(*total).first() == nodes.selectExpr(*total).first()
    assert e.exceptAll(edges).count() == 0 and e.count() == 70_000
    assert {r.volume: r.estimated_number_of_nodes for r in m.collect()} == {"v": 9, "w": None, "x": 2}
    lost = nodes.where("node_id < 5").unionByName(spark.createDataFrame([("w", None, 0, 0.0, 0.0, 0.0)], schema_))
    with pytest.raises(Exception, match="(?i)cannot convert"):
        lineage_store.write_lineage_stores(lost, edges.limit(0), meta.limit(0), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["v.geff", "w.geff", "x.geff"]
    assert lineage_store.read_lineage_stores(spark, str(tmp_path))[0].count() == 150_001


def test_volumes_appear_whole(spark, tmp_path):
    rows = [("a", t, [1, 2, 2], bytes([t] * 8)) for t in (0, 2)] + [("b", 0, [1, 1, 1], b"xy")]
    frames = spark.createDataFrame(rows, schema.FRAMES).repartition(3)
    chunked.write_frames(frames, str(tmp_path), "raw")
    chunked.register(spark)
    load = lambda: {(r.volume, r.t): bytes(r.data) for r in spark.read.format("chunked_frames").load(str(tmp_path)).collect()}
    expected = {("a", 0): bytes(8), ("a", 1): bytes(8), ("a", 2): bytes([2] * 8), ("b", 0): b"xy"}
    assert load() == expected
    save = lambda rows, mode: spark.createDataFrame(rows, schema.FRAMES).repartition(2).write.format("chunked_frames").mode(mode).save(str(tmp_path))
    for bad in ([("a", 0, [1, 2, 2], bytes(8)), ("a", 1, [1, 1, 2], bytes(4))], [("a", 0, [1, 2, 2], bytes(7))]):
        with pytest.raises(Exception, match="shape"):
            save(bad, "overwrite")
    with pytest.raises(Exception, match="a.zarr"):
        save([("a", 0, [1, 1, 1], b"no"), ("c", 0, [1, 1, 1], b"no")], "append")
    assert load() == expected and sorted(p.name for p in tmp_path.iterdir()) == ["a.zarr", "b.zarr"]
    save([("c", 0, [1, 1, 1], b"cc")], "append")
    save([("a", 0, [1, 1, 1], b"aa")], "overwrite")
    assert load() == {("a", 0): b"aa", ("b", 0): b"xy", ("c", 0): b"cc"}


def test_csv_round_trip(spark, tmp_path):
    det = Views(spark, DATA).det.select(*schema.DETECTIONS.fieldNames())
    tables.write_csv(det, f"{tmp_path}/d", ["volume", "t"])
    back = tables.read_csv(spark, f"{tmp_path}/d", schema.DETECTIONS)
    assert back.schema == schema.DETECTIONS and sorted(map(tuple, back.collect())) == sorted(map(tuple, det.collect()))
    with pytest.raises(ValueError, match="track_id"):
        tables.read_csv(spark, f"{tmp_path}/d", schema.TRACKS)


def lineage(spark, path):
    v = Views(spark, DATA)
    for name in ("gt_nodes", "gt_edges", "gt_meta"):
        getattr(v, name).write.parquet(f"{path}/{name}")
    return v


def test_lineage_tables(spark, tmp_path):
    v = lineage(spark, tmp_path)
    name = v.gt_meta.first().volume
    nodes, edges, meta = tables.read_lineage(spark, str(tmp_path), [name])
    assert meta.count() == 1 and {r.volume for r in nodes.select("volume").distinct().collect()} == {name}
    with pytest.raises(FileNotFoundError, match="lost"):
        tables.read_lineage(spark, str(tmp_path), ["lost"])


def test_shards_tracklets_and_frames(spark, tmp_path):
    t = spark.createDataFrame([("v", 2, 3, 4, 1), ("v", 1, 0, 2, 0)], "volume string, label long, begin long, end long, parent long")
    tables.write_tracklet_table(t, f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t/volume=v").collect()] == ["1 0 2 0", "2 3 4 1"]
    tables.write_shards(t, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 2
    painted = spark.createDataFrame([("v", 0, 1, 1, 1, 7)], "volume string, t long, z long, y long, x long, label long")
    r = tables.label_frames(painted, (2, 2, 3)).first()
    assert r.name == "mask000.tif" and r.content[:4] == b"II*\0" and struct.unpack("<H", r.content[-4:-2])[0] == 7
    count, at, pages = 0, struct.unpack("<I", r.content[4:8])[0], []
    while at and count < 9:
        n = struct.unpack_from("<H", r.content, at)[0]
        tags = {struct.unpack_from("<H", r.content, at + 2 + 12 * k)[0]: struct.unpack_from("<I", r.content, at + 10 + 12 * k)[0] for k in range(n)}
        pages.append(np.frombuffer(r.content, "<u2", 6, tags[273]).reshape(2, 3))
        at = struct.unpack_from("<I", r.content, at + 2 + 12 * n)[0]
        count += 1
    assert len(pages) == 2 and pages[1][1, 1] == 7 and pages[0].sum() == 0


def test_artifacts(tmp_path):
    data = tables.canonical_json({"b": 1, "a": "é"})
    assert data == '{\n  "a": "é",\n  "b": 1\n}\n'.encode() and len(tables.write_artifact(tmp_path / "x/y.json", data)) == 64


def test_command_line(spark, tmp_path, capsys):
    v = lineage(spark, tmp_path / "truth")
    v.det.select(*schema.DETECTIONS.fieldNames()).write.csv(f"{tmp_path}/det", header=True)
    cli.main(["link", "--predictions", f"{tmp_path}/det", "--output", f"{tmp_path}/tracks"])
    cli.main(["link-strict", "--predictions", f"{tmp_path}/det", "--output", f"{tmp_path}/strict.parquet"])
    cli.main(["kalman", "--predictions", f"{tmp_path}/det", "--output", f"{tmp_path}/kalman.parquet"])
    cli.main(["divisions", "--input-tracks", f"{tmp_path}/tracks", "--output", f"{tmp_path}/t2", "--division-edges", f"{tmp_path}/edges"])
    cli.main(["division-events", "--tracks", f"{tmp_path}/tracks", "--output", f"{tmp_path}/events.parquet"])
    cli.main(["graph-table", "--tracks", f"{tmp_path}/tracks", "--division-edges", f"{tmp_path}/edges", "--output", f"{tmp_path}/graph"])
    for version in "12":
        cli.main(["evaluate", "--submission", f"{tmp_path}/graph", "--train-dir", f"{tmp_path}/truth", "--version", version])
        out = json.loads(capsys.readouterr().out)
        assert len(out["volumes"]) == 5 and out["all"]["datasets"] == 5
    cli.main(["truth-statistics", "--train-dir", f"{tmp_path}/truth", "--output", f"{tmp_path}/stats.parquet"])
    cli.main(["edge-pairs", "--train-dir", f"{tmp_path}/truth", "--dets", f"{tmp_path}/det", "--output-dir", f"{tmp_path}/pairs"])
    with pytest.raises(SystemExit):
        cli.main(["divisions", "--output", "x", "--division-edges", "y"])
    data = np.zeros((2, 8, 32, 32), dtype="<u2")
    chunked.write_volume(tmp_path / "vols" / "a_1.zarr", data)
    cli.main(["detect", "--test-dir", f"{tmp_path}/vols", "--output", f"{tmp_path}/found.parquet"])
    assert spark.read.parquet(f"{tmp_path}/found.parquet").columns == schema.DETECTIONS.fieldNames()


def test_stream_equals_batch(spark, tmp_path):
    from weftline.operators.tracking import kalman_track
    from weftline.streaming.tracker import track_stream

    pts = [("v", t, float(9 * c), float(t), 0.0, 1.0, 4 * t + c) for t in range(6) for c in range(4)]
    df = spark.createDataFrame(pts, "volume string, t long, z double, y double, x double, score double, node_id long")
    schema_ = df.schema
    (tmp_path / "in").mkdir()
    q = track_stream(spark.readStream.schema(schema_).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), 5.0).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        for k, part in enumerate(("t < 2", "t >= 2 and t < 4", "t >= 4", "t = 1")):
            df.where(part).coalesce(1).write.parquet(f"{tmp_path}/w{k}")
            f = next((tmp_path / f"w{k}").glob("part-*.parquet"))
            f.rename(tmp_path / "in" / f"{k}.parquet")
            q.processAllAvailable()
            time.sleep(0.1)
    finally:
        q.stop()
    got = spark.table("tracked")
    assert got.where("late").count() == 4 and got.where("not late").count() == 24
    batch = kalman_track(df, 5.0)
    key = ["volume", "t", "z", "y", "x"]
    both = got.where("not late").join(batch.select(*key, F.col("track_id").alias("b")), key)
    assert both.select("track_id", "b").distinct().count() == 4


def test_text_runs_are_deterministic(spark, tmp_path):
    import hashlib

    from weftline.plans.trace import analyze

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("Head?\r\nall of it\n\nMARK\nx = 1\n".encode() + b"\xff\n")
    (tmp_path / "in/b.txt").write_bytes(b"never\n")
    markers = [{"name": "mark", "match": "exact", "value": "MARK", "type": "notebook_1"}]
    one, two = (analyze(spark, f"{tmp_path}/in", f"{tmp_path}/{k}", markers) for k in "xy")
    assert one == two and [m["segments"] for m in one] == [2, 1]
    folder = tmp_path / "x" / one[0]["run_id"]
    for name, sha in one[0]["artifacts"].items():
        assert hashlib.sha256((folder / name).read_bytes()).hexdigest() == sha == hashlib.sha256((tmp_path / "y" / one[0]["run_id"] / name).read_bytes()).hexdigest()
    kinds = [json.loads(x)["paragraph_type"] for x in (folder / "segments.jsonl").read_text().splitlines()]
    assert kinds == ["preamble_instruction", "notebook_runtime_output"] and json.loads((folder / "metrics.json").read_text())["absolute_cue_count"] == 1
