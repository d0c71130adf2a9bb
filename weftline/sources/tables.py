"""Files: CSV, tracklet exports, label frames, JSON and canonical text, inventories."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.schema import require_columns


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with a header; the columns that the schema names must be there."""
    df = spark.read.csv(path, header=True, schema=None, inferSchema=False)
    require_columns(df, schema.fieldNames(), "CSV")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV with a header; files are in order where one is asked for."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True)


def write_shards(df: DataFrame, path: str, key: str = "volume") -> None:
    """Compressed Parquet shards, one folder per key."""
    df.write.mode("overwrite").partitionBy(key).option("compression", "zstd").parquet(path)


def read_lineage(spark: SparkSession, path: str, volumes: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ground-truth nodes, edges and metadata from Parquet tables under a folder; a named volume that is missing raises."""
    nodes, edges, meta = (spark.read.parquet(f"{path}/{n}") for n in ("gt_nodes", "gt_edges", "gt_meta"))
    if volumes is not None:
        there = {r.volume for r in meta.where(F.col("volume").isin(volumes)).select("volume").distinct().collect()}
        if lost := sorted(set(volumes) - there):
            raise FileNotFoundError(f"no ground truth for {lost}")
        nodes, edges, meta = (df.where(F.col("volume").isin(volumes)) for df in (nodes, edges, meta))
    return nodes, edges, meta


def write_tracklet_table(tracklets: DataFrame, path: str) -> None:
    """Text lines ``L B E P`` per volume, in the order of labels."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("label", "begin", "end", "parent")])
    tracklets.select("volume", "label", line.alias("value")).repartition("volume").sortWithinPartitions("volume", "label").drop("label").write.mode("overwrite").partitionBy("volume").text(path)


def tiff(frame) -> bytes:
    """A minimal little-endian TIFF of (pages, rows, columns) uint16, one strip per page."""
    import struct

    import numpy as np

    frame = np.asarray(frame, dtype="<u2")
    if frame.ndim == 2:
        frame = frame[None]
    pages, rows, columns = frame.shape
    out = bytearray(b"II*\0" + struct.pack("<I", 8))
    for p in range(pages):
        entries = [(256, 4, columns), (257, 4, rows), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 0), (277, 3, 1), (278, 4, rows), (279, 4, rows * columns * 2)]
        at = len(out)
        strip = at + 2 + 12 * len(entries) + 4
        following = strip + rows * columns * 2 if p < pages - 1 else 0
        out += struct.pack("<H", len(entries))
        for tag, kind, value in entries:
            out += struct.pack("<HHII", tag, kind, 1, strip if tag == 273 else value)
        out += struct.pack("<I", following) + frame[p].tobytes()
    return bytes(out)


def read_tiff(data: bytes):
    """(pages, rows, columns) of an uncompressed little-endian TIFF of 16-bit samples, a strip or more per page."""
    import struct

    import numpy as np

    if data[:4] != b"II*\0":
        raise ValueError("not a little-endian TIFF")
    pages, at = [], struct.unpack_from("<I", data, 4)[0]
    while at:
        tags = {}
        for k in range(struct.unpack_from("<H", data, at)[0]):
            tag, kind, count = struct.unpack_from("<HHI", data, at + 2 + 12 * k)
            width = {3: 2, 4: 4}.get(kind)
            if width is not None:
                place = at + 10 + 12 * k
                place = struct.unpack_from("<I", data, place)[0] if width * count > 4 else place
                tags[tag] = struct.unpack_from(f"<{count}{'H' if width == 2 else 'I'}", data, place)
        if tags.get(258, (1,)) != (16,) or tags.get(259, (1,)) != (1,):
            raise ValueError("expected uncompressed 16-bit samples")
        strips = b"".join(data[a : a + n] for a, n in zip(tags[273], tags[279], strict=True))
        pages.append(np.frombuffer(strips, "<u2").reshape(tags[257][0], tags[256][0]))
        at = struct.unpack_from("<I", data, at + 2 + 12 * struct.unpack_from("<H", data, at)[0])[0]
    return np.stack(pages)


def label_frames(painted: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Painted voxels (volume, t, z, y, x, label) as TIFF files: volume, t, name, content."""
    import numpy as np
    import pandas as pd

    def paint(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = np.zeros(shape, dtype="<u2")
        frame[pdf.z, pdf.y, pdf.x] = pdf.label
        t = int(pdf.t.iloc[0])
        return pd.DataFrame({"volume": [pdf.volume.iloc[0]], "t": [t], "name": [f"mask{t:03d}.tif"], "content": [tiff(frame)]})

    return painted.groupBy("volume", "t").applyInPandas(paint, "volume string, t long, name string, content binary")


def canonical_json(payload: dict | list) -> bytes:
    """UTF-8, sorted keys, two blanks of indentation, a newline at the end."""
    return (json.dumps(payload, ensure_ascii=False, indent=2, sort_keys=True) + "\n").encode()


def write_artifact(path: str | Path, data: bytes) -> str:
    """Writes driver-side bytes and returns their SHA-256."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(data)
    return hashlib.sha256(data).hexdigest()


def json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON with their SHA-256: columns value and sha256."""
    value = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return df.select(value.alias("value")).withColumn("sha256", F.sha2(F.col("value").cast("binary"), 256))


def inventory(volumes: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: numbers of volumes and of ground-truth graphs, and the volumes without one."""
    lost = volumes.select("volume").distinct().join(truth.select("volume"), "volume", "left_anti")
    n = volumes.select("volume").distinct().agg(F.count("*").alias("n_volumes")).join(truth.select("volume").distinct().agg(F.count("*").alias("n_truth")))
    return n.join(lost.agg(F.array_sort(F.collect_list("volume")).alias("missing")))
