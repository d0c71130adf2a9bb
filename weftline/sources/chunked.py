"""Chunked arrays on disk as a Spark data source, one partition per volume and run of frames.

A volume is a folder ``name.zarr`` with an array (or a member ``0``) of
little-endian uint16, axes t, z, y, x, one frame per chunk. Metadata is read from
the array's JSON (version 2 ``.zarray`` or 3 ``zarr.json``). Chunks may be raw,
zlib, gzip, zstd or Blosc compressed; other codecs raise a clear error. Spark reads through ``spark.read.format("chunked_frames").load(path)``:
the options ``volumes``, ``first_t`` and ``last_t`` decide which partitions there are. Arrays whose frames take several chunks are read as bricks, a
chunk a row, by the format ``chunked_bricks``. Spark writes by
``df.write.format("chunked_frames").mode(...).save(path)``: volumes appear whole.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, InputPartition, WriterCommitMessage

from weftline.sources import blosc, pruning
from weftline.sources.staged import StagedFolders


def find_volumes(path: str | Path | list) -> list[Path]:
    """The volume itself, or the sorted volumes of a folder; a list is checked and its bad paths are named."""
    if isinstance(path, list | tuple):
        bad = [str(p) for p in path if not (Path(p).is_dir() and Path(p).suffix == ".zarr")]
        if bad:
            raise ValueError(f"not array folders: {bad}")
        return [Path(p) for p in path]
    p = Path(path)
    return [p] if p.suffix == ".zarr" and p.is_dir() else sorted(c for c in p.iterdir() if c.suffix == ".zarr" and c.is_dir())


@dataclass(frozen=True)
class ArrayInfo:
    """Where an array's chunks are and how they are stored."""

    folder: str
    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    codec: str
    version: int
    separator: str


def array_info(volume: str | Path) -> ArrayInfo:
    """Metadata of the root array or of the group member 0."""
    for folder in (Path(volume), Path(volume) / "0"):
        if (f := folder / ".zarray").exists():
            m = json.loads(f.read_text())
            if m["dtype"] != "<u2":
                raise ValueError(f"{volume}: expected little-endian uint16, found {m['dtype']}")
            return ArrayInfo(str(folder), tuple(m["shape"]), tuple(m["chunks"]), (m.get("compressor") or {}).get("id", "raw"), 2, m.get("dimension_separator", "."))
        if (f := folder / "zarr.json").exists() and (m := json.loads(f.read_text())).get("node_type") == "array":
            if m["data_type"] != "uint16":
                raise ValueError(f"{volume}: expected uint16, found {m['data_type']}")
            names = [c["name"] for c in m["codecs"] if c["name"] != "bytes"]
            key = m.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
            return ArrayInfo(str(folder), tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), names[0] if names else "raw", 3, key)
    raise FileNotFoundError(f"no array in {volume}")


def decompress(data: bytes, codec: str) -> bytes:
    if codec == "raw":
        return data
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "gzip":
        return gzip.decompress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "blosc":
        return blosc.decode(data)
    raise NotImplementedError(f"codec {codec!r}: recode the chunks as raw, zlib, gzip, zstd or blosc")


def read_frame(info: ArrayInfo, t: int) -> tuple[list[int], bytes]:
    """Shape and bytes of one frame; every chunk must hold a single frame and the whole of its other axes."""
    if info.chunk[0] != 1 or info.chunk[1:] != info.shape[1:]:
        raise ValueError("a chunk must hold exactly one frame")
    parts = [str(t), *["0"] * (len(info.shape) - 1)]
    f = Path(info.folder) / ("c" + info.separator + info.separator.join(parts) if info.version == 3 else info.separator.join(parts))
    size = 2 * math.prod(info.shape[1:])
    data = decompress(f.read_bytes(), info.codec) if f.exists() else bytes(size)
    if len(data) != size:
        raise ValueError(f"{f}: {len(data)} bytes instead of {size}")
    return list(info.shape[1:]), data


#: From this many frames on small ones share a partition, up to this many bytes of a partition's frames.
MOST_SINGLE, PARTITION_BYTES = 256, 1 << 25


@dataclass
class FramePartition(InputPartition):
    volume: str
    path: str
    frames: range


FRAME_FIELDS = (("volume", pa.string()), ("t", pa.int32()), ("shape", pa.list_(pa.int32())), ("data", pa.binary()))


class FrameReader(pruning.PrunedReader):
    """A partition per frame, or per run of small frames where there are many; each frame is a batch."""

    def kept(self) -> Iterator[tuple[Path, ArrayInfo, range]]:
        """Volumes with their array and the frames that are read."""
        for v in find_volumes(self.path):
            if self.keeps_volume(v.stem):
                info = array_info(v)
                first, last = self.first_t or 0, info.shape[0] - 1 if self.last_t is None else self.last_t
                yield v, info, range(max(0, first), min(info.shape[0], last + 1))

    def partitions(self) -> list[FramePartition]:
        kept = list(self.kept())
        share = -(-sum(len(frames) for _, _, frames in kept) // MOST_SINGLE)
        out = []
        for v, info, frames in kept:
            step = max(1, min(share, PARTITION_BYTES // max(1, 2 * math.prod(info.shape[1:]))))
            out += [FramePartition(v.stem, str(v), frames[k : k + step]) for k in range(0, len(frames), step)]
        return out

    def read(self, partition: FramePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no frame is left
            return
        info = array_info(partition.path)
        for t in partition.frames:
            yield _row(FRAME_FIELDS, (partition.volume, t, *read_frame(info, t)))


def _row(fields: tuple[tuple[str, pa.DataType], ...], values: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(values, fields, strict=True)], [name for name, _ in fields])


@dataclass
class SlabPartition(InputPartition):
    volume: str
    path: str
    t: int
    row: int


BRICK_FIELDS = (("volume", pa.string()), ("t", pa.int32()), *((name, pa.list_(pa.int32())) for name in ("shape", "brick", "origin", "size")), ("data", pa.binary()))


def read_bricks(info: ArrayInfo, t: int, row: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """Origin, size and bytes of the chunks of one frame whose number along z is ``row``; what chunks hold beyond the
    array's end is cut off, and chunks that are not there are 0."""
    import numpy as np

    if info.chunk[0] != 1 or len(info.shape) != 4:
        raise ValueError("a chunk must lie within one frame")
    shape, brick = info.shape[1:], info.chunk[1:]
    for at in itertools.product([row], *[range(-(-n // b)) for n, b in zip(shape[1:], brick[1:], strict=True)]):
        key = info.separator.join(str(k) for k in (t, *at))
        f = Path(info.folder) / ("c" + info.separator + key if info.version == 3 else key)
        data = decompress(f.read_bytes(), info.codec) if f.exists() else bytes(2 * math.prod(brick))
        if len(data) != 2 * math.prod(brick):
            raise ValueError(f"{f}: {len(data)} bytes instead of {2 * math.prod(brick)}")
        origin = [j * b for j, b in zip(at, brick, strict=True)]
        size = [min(b, n - o) for b, n, o in zip(brick, shape, origin, strict=True)]
        held = np.frombuffer(data, "<u2").reshape(brick)
        yield origin, size, held[tuple(slice(n) for n in size)].tobytes()


class BrickReader(FrameReader):
    """A partition per frame and row of chunks along z; each chunk is a batch, so a task holds one at a time."""

    def partitions(self) -> list[SlabPartition]:
        return [SlabPartition(v.stem, str(v), t, row) for v, info, frames in self.kept() for t in frames for row in range(-(-info.shape[1] // info.chunk[1]))]

    def read(self, partition: SlabPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        info = array_info(partition.path)
        for origin, size, data in read_bricks(info, partition.t, partition.row):
            yield _row(BRICK_FIELDS, (partition.volume, partition.t, list(info.shape[1:]), list(info.chunk[1:]), origin, size, data))


@dataclass
class FramesWritten(WriterCommitMessage):
    """Last frame and shape of each volume that a task met."""

    volumes: dict[str, tuple[int, list[int]]]


class FrameWriter(StagedFolders):
    """Rows (volume, t, shape, data) as chunks; frames that are not there read as 0."""

    def __init__(self, path: str, overwrite: bool, codec: str):
        super().__init__(path, overwrite)
        self.codec = codec

    def write(self, iterator: Iterator[pa.RecordBatch]) -> FramesWritten:
        met: dict[str, tuple[int, list[int]]] = {}
        for batch in iterator:
            for volume, t, shape, data in zip(*(batch.column(c).to_pylist() for c in ("volume", "t", "shape", "data")), strict=True):
                if len(data) != 2 * math.prod(shape):
                    raise ValueError(f"{volume}, frame {t}: {len(data)} bytes for shape {shape}")
                self.put(f"{volume}.zarr/{_chunk_name(t, shape)}", _stored(data, self.codec))
                _widen(met, volume, t, shape)
        return FramesWritten(met)

    def commit(self, messages: list[FramesWritten | None]) -> None:
        met: dict[str, tuple[int, list[int]]] = {}
        for m in messages:
            for volume, (last, shape) in (m.volumes if m else {}).items():
                _widen(met, volume, last, shape)
        for volume, (last, shape) in met.items():
            _describe(self.staging / f"{volume}.zarr", [last + 1, *shape], self.codec)
        self.publish([f"{volume}.zarr" for volume in sorted(met)])


def _widen(met: dict[str, tuple[int, list[int]]], volume: str, t: int, shape: list[int]) -> None:
    last, own = met.get(volume, (t, shape))
    if own != shape:
        raise ValueError(f"{volume}: frames of different shapes")
    met[volume] = max(last, t), shape


class ChunkedFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunked_frames"

    def schema(self) -> str:
        return "volume string, t int, shape array<int>, data binary"

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"], overwrite, self.options.get("codec", "blosc"))


class ChunkedBricks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunked_bricks"

    def schema(self) -> str:
        return "volume string, t int, shape array<int>, brick array<int>, origin array<int>, size array<int>, data binary"

    def reader(self, schema) -> BrickReader:
        return BrickReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkedFrames)
    spark.dataSource.register(ChunkedBricks)


def _describe(folder: Path, shape: list[int], codec: str) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    meta = {"zarr_format": 2, "shape": shape, "chunks": [1, *shape[1:]], "dtype": "<u2", "compressor": None if codec == "raw" else {"id": codec}, "fill_value": 0, "order": "C", "filters": None}
    (folder / ".zarray").write_text(json.dumps(meta))


def _chunk_name(t: int, shape: list[int]) -> str:
    return ".".join([str(t), *["0"] * len(shape)])


def _stored(data: bytes, codec: str) -> bytes:
    return {"zlib": zlib.compress, "blosc": lambda x: blosc.encode(x, 2), "raw": bytes}[codec](data)


def write_volume(path: str | Path, frames, codec: str = "zlib") -> None:
    """A version 2 array of (t, z, y, x) uint16, one frame per chunk."""
    import numpy as np

    a = np.asarray(frames, dtype="<u2")
    _describe(Path(path), list(a.shape), codec)
    for t in range(a.shape[0]):
        (Path(path) / _chunk_name(t, list(a.shape[1:]))).write_bytes(_stored(a[t].tobytes(), codec))


def write_frames(frames: DataFrame, path: str, codec: str = "blosc") -> None:
    """Frames (volume, t, shape, data) as one array per volume under ``path``, a folder that all machines mount; a volume
    that is there is replaced."""
    register(frames.sparkSession)
    frames.select("volume", "t", "shape", "data").write.format("chunked_frames").option("codec", codec).mode("overwrite").save(path)


def frame_voxels(frames: DataFrame, dtype: str = "<u2", keys: tuple[str, ...] = ()) -> DataFrame:
    """Frames as rows (volume, t, further ``keys``, z, y, x, v); v is a double where ``dtype`` is a float."""
    kind, number = ("double", "float64") if dtype[1] == "f" else ("long", "int64")
    own = frames.select("volume", "t", *keys, "shape", "data")
    schema = ", ".join(["volume string", "t long", *[f"{k} {own.schema[k].dataType.simpleString()}" for k in keys], "z long", "y long", "x long", f"v {kind}"])

    def run(batches):
        import numpy as np

        for batch in batches:
            for volume, t, *extra, shape, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(data, dtype=dtype).astype(number)
                places = [pa.array(x.ravel().astype(np.int64)) for x in np.indices(shape)]
                further = [pa.repeat(pa.scalar(e, batch.schema.field(k).type), values.size) for k, e in zip(keys, extra, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([volume] * values.size, pa.string()), pa.array(np.full(values.size, t, dtype=np.int64)), *further, *places, pa.array(values)], ["volume", "t", *keys, "z", "y", "x", "v"])

    return own.mapInArrow(run, schema)


# ---------------------------------------------------------------- arrays of any number type


@dataclass(frozen=True)
class StoredArray(ArrayInfo):
    dtype: str
    fill: float


def attributes(group: str | Path) -> dict:
    """Attributes of a group, version 2 or 3."""
    if (f := Path(group) / "zarr.json").exists():
        return json.loads(f.read_text()).get("attributes") or {}
    f = Path(group) / ".zattrs"
    return json.loads(f.read_text()) if f.exists() else {}


def stored_array(folder: str | Path) -> StoredArray:
    """Metadata of one array of numbers in C order."""
    if (f := Path(folder) / "zarr.json").exists():
        m = json.loads(f.read_text())
        names = [c["name"] for c in m["codecs"] if c["name"] != "bytes"]
        if any((c.get("configuration") or {}).get("endian", "little") != "little" for c in m["codecs"] if c["name"] == "bytes") or len(names) > 1:
            raise NotImplementedError(f"{folder}: codecs {[c['name'] for c in m['codecs']]}")
        separator = m.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
        return StoredArray(str(folder), tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), names[0] if names else "raw", 3, separator, m["data_type"], m.get("fill_value") or 0)
    m = json.loads((Path(folder) / ".zarray").read_text())
    if m.get("order", "C") != "C" or m.get("filters"):
        raise NotImplementedError(f"{folder}: order {m.get('order')!r}, filters {m.get('filters')!r}")
    return StoredArray(str(folder), tuple(m["shape"]), tuple(m["chunks"]), (m.get("compressor") or {}).get("id", "raw"), 2, m.get("dimension_separator", "."), m["dtype"], m.get("fill_value") or 0)


def read_rows(a: StoredArray, step: int | None = None) -> Iterator:
    """An array of one or two axes as pieces of ``step`` rows (its chunks' rows without one), the last one shorter."""
    import numpy as np

    held, n, step = [], 0, step or a.chunk[0]
    dtype = np.dtype(a.dtype)
    for i in range(-(-a.shape[0] // a.chunk[0])):
        across = [range(-(-s // c)) for s, c in zip(a.shape[1:], a.chunk[1:], strict=True)]
        parts = []
        for j in across[0] if across else [None]:
            key = a.separator.join(str(k) for k in (i, j) if k is not None)
            f = Path(a.folder) / ("c" + a.separator + key if a.version == 3 else key)
            data = np.frombuffer(decompress(f.read_bytes(), a.codec), dtype) if f.exists() else np.full(math.prod(a.chunk), a.fill, dtype)
            parts.append(data.reshape(a.chunk))
        rows = np.concatenate(parts, axis=1)[:, : a.shape[1]] if across else parts[0]
        held.append(rows[: a.shape[0] - i * a.chunk[0]])
        n += len(held[-1])
        while n >= step:
            whole = np.concatenate(held)
            yield whole[:step]
            held, n = [whole[step:]], n - step
    if n:
        yield np.concatenate(held)


def array_metadata(shape: list[int], dtype, rows: int, codec: str) -> str:
    """The description of a version 2 array of ``rows`` rows a chunk."""
    compressor = None if codec == "raw" else {"id": codec}
    return json.dumps({"zarr_format": 2, "shape": shape, "chunks": [rows, *shape[1:]], "dtype": dtype.str, "compressor": compressor, "fill_value": 0, "order": "C", "filters": None})


def array_chunk(part, rows: int, codec: str) -> bytes:
    """Stored bytes of at most ``rows`` rows, filled up with 0."""
    import numpy as np

    whole = np.zeros([rows, *part.shape[1:]], part.dtype)
    whole[: part.shape[0]] = part
    return blosc.encode(whole.tobytes(), part.dtype.itemsize) if codec == "blosc" else whole.tobytes()


def write_array(folder: str | Path, a, rows: int = 1 << 16, codec: str = "blosc") -> None:
    """Numbers of one or two axes as a version 2 array of ``rows`` rows a chunk."""
    import numpy as np

    a = np.ascontiguousarray(a)
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / ".zarray").write_text(array_metadata(list(a.shape), a.dtype, rows, codec))
    for i in range(0, a.shape[0], rows):
        (folder / ".".join([str(i // rows), *["0"] * (a.ndim - 1)])).write_bytes(array_chunk(a[i : i + rows], rows, codec))
