"""Ground-truth lineage graphs stored as groups of chunked arrays, as a Spark data source.

A store is a folder ``name.geff``: ``nodes/ids``, a values array per node
property (``nodes/props/t/values``, or ``nodes/attrs`` in older stores),
``edges/ids`` of two columns, and group attributes whose ``geff.extra`` may hold
the estimated number of nodes. One task reads one store; node and edge arrays are
read chunk by chunk and handed on as Arrow batches. Filters on the volume decide
which stores are opened. Writing spreads a store's chunks over tasks, and a store
appears only when all of its chunks are there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition, WriterCommitMessage

from weftline.operators.ranks import number_rows
from weftline.sources import pruning
from weftline.sources.chunked import array_chunk, array_metadata, attributes, read_rows, stored_array
from weftline.sources.staged import StagedFolders

SCHEMAS = {
    "nodes": "volume string, node_id long, t long, z double, y double, x double",
    "edges": "volume string, source_id long, target_id long",
    "meta": "volume string, estimated_number_of_nodes long",
}
#: Rows of a chunk that is written.
ROWS = 1 << 16
_TYPES = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}


def find_stores(path: str | Path) -> list[Path]:
    p = Path(path)
    return [p] if p.suffix == ".geff" else sorted(c for c in p.iterdir() if c.suffix == ".geff" and c.is_dir())


def _values(store: Path, name: str) -> Path:
    for kind in ("props", "attrs"):
        if (folder := store / "nodes" / kind / name / "values").is_dir():
            return folder
    raise FileNotFoundError(f"{store}: no node property {name!r}")


@dataclass
class StorePartition(InputPartition):
    path: str


class StoreReader(pruning.PrunedReader):
    def __init__(self, options, kind: str):
        super().__init__(options)
        self.kind = kind

    def partitions(self) -> list[StorePartition]:
        return [StorePartition(str(p)) for p in find_stores(self.path) if self.keeps_volume(p.stem)]

    def read(self, partition: StorePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no store is left
            return
        store = Path(partition.path)
        names, kinds = zip(*(f.split() for f in SCHEMAS[self.kind].split(", ")), strict=True)

        def batch(columns: list) -> pa.RecordBatch:
            arrays = [pa.array([store.stem] * len(columns[0]), pa.string()), *(pa.array(c.tolist(), _TYPES[k]) for c, k in zip(columns, kinds[1:], strict=True))]
            return pa.RecordBatch.from_arrays(arrays, list(names))

        if self.kind == "meta":
            extra = (attributes(store).get("geff") or {}).get("extra") or {}
            n = extra.get("estimated_number_of_nodes")
            yield pa.RecordBatch.from_arrays([pa.array([store.stem]), pa.array([None if n is None else int(n)], pa.int64())], list(names))
        elif self.kind == "edges":
            for rows in read_rows(stored_array(store / "edges" / "ids")):
                yield batch([rows[:, 0], rows[:, 1]])
        else:
            arrays = [stored_array(f) for f in (store / "nodes" / "ids", *(_values(store, c) for c in ("t", "z", "y", "x")))]
            if len({a.shape[0] for a in arrays}) > 1:
                raise ValueError(f"{store}: node arrays differ in length")
            step = arrays[0].chunk[0]
            for columns in zip(*(read_rows(a, step) for a in arrays), strict=True):
                yield batch(list(columns))


#: Columns of the rows that make up stores: a chunk's node, edge or estimate rows stand together, in order.
_KEYS = ["volume", "kind", "chunk"]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Consecutive rows of the same keys, whole: at most ``ROWS`` at a time."""
    at, held = None, []
    for batch in batches:
        df = batch.to_pandas()
        for _, part in df.groupby((df[_KEYS] != df[_KEYS].shift()).any(axis=1).cumsum(), sort=False):
            key = tuple(part[_KEYS].iloc[0])
            if key != at and held:
                yield at, pd.concat(held)
                held = []
            at = key
            held.append(part)
    if held:
        yield at, pd.concat(held)


@dataclass
class ChunksWritten(WriterCommitMessage):
    """Per volume and kind the rows that a task wrote, or the estimates that it met."""

    counts: dict[tuple[str, str], int]


class StoreWriter(StagedFolders):
    """Rows of ``_KEYS``, a, b, z, y, x as chunks of the arrays of stores."""

    arrays = {"nodes/ids": "node", **{f"nodes/props/{c}/values": "node" for c in "tzyx"}, "edges/ids": "edge"}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> ChunksWritten:
        counts: dict[tuple[str, str], int] = {}
        for (volume, kind, chunk), rows in _runs(iterator):
            if kind == "meta":
                counts[volume, kind] = int(rows.a.max())
                continue
            for name, part in self.columns(kind, rows).items():
                tail = ".0" if part.ndim == 2 else ""
                self.put(f"{volume}.geff/{name}/{chunk}{tail}", array_chunk(part, ROWS, "blosc"))
            counts[volume, kind] = counts.get((volume, kind), 0) + len(rows)
        return ChunksWritten(counts)

    @staticmethod
    def columns(kind: str, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        a, b = rows.a.astype("int64").to_numpy(), rows.b.astype("int64").to_numpy()
        if kind == "edge":
            return {"edges/ids": np.stack([a, b], axis=1).astype(np.uint64)}
        return {"nodes/ids": a.astype(np.uint64), "nodes/props/t/values": b} | {f"nodes/props/{c}/values": rows[c].to_numpy(dtype=np.float64) for c in "zyx"}

    def commit(self, messages: list[ChunksWritten | None]) -> None:
        counts: dict[tuple[str, str], int] = {}
        for m in messages:
            for (volume, kind), n in (m.counts if m else {}).items():
                counts[volume, kind] = n if kind == "meta" else counts.get((volume, kind), 0) + n
        none = pd.DataFrame({c: [] for c in ("a", "b", *"zyx")})
        volumes = sorted({volume for volume, _ in counts})
        for volume in volumes:
            for name, kind in self.arrays.items():
                empty = self.columns(kind, none)[name]
                self.put(f"{volume}.geff/{name}/.zarray", array_metadata([counts.get((volume, kind), 0), *empty.shape[1:]], empty.dtype, ROWS, "blosc").encode())
            estimate = counts.get((volume, "meta"), -1)
            extra = {"estimated_number_of_nodes": estimate} if estimate >= 0 else {}
            self.put(f"{volume}.geff/.zattrs", json.dumps({"geff": {"version": "1", "directed": True, "extra": extra}}).encode())
        self.publish([f"{volume}.geff" for volume in volumes])


class LineageStores(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lineage_stores"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "nodes")]

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options, self.options.get("table", "nodes"))

    def writer(self, schema, overwrite: bool) -> StoreWriter:
        return StoreWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LineageStores)


def read_lineage_stores(spark: SparkSession, path: str, volumes: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and metadata of the stores in a folder; a named volume that is missing raises."""
    if volumes is not None and (lost := sorted(set(volumes) - {p.stem for p in find_stores(path)})):
        raise FileNotFoundError(f"no ground truth for {lost}")
    register(spark)
    named = {} if volumes is None else {"volumes": json.dumps(volumes)}
    return tuple(spark.read.format("lineage_stores").options(table=k, **named).load(path) for k in SCHEMAS)


def write_lineage_stores(nodes: DataFrame, edges: DataFrame, meta: DataFrame, path: str) -> None:
    """One store per volume under ``path``, a folder that all machines mount; a store that is there is replaced. Nodes are
    in order of (node_id, t), edges of their ends. Nodes and edges without ids or frames raise; of several estimates the
    largest counts."""
    long, double = (lambda c: F.col(c).cast("long")), (lambda c: F.col(c).cast("double").alias(c))
    graph = [("node", nodes, "node_id", "t", [double(c) for c in "zyx"]), ("edge", edges, "source_id", "target_id", [F.lit(None).cast("double").alias(c) for c in "zyx"])]
    parts = []
    for kind, df, a, b, places in graph:
        own = df.select("volume", long(a).alias("a"), long(b).alias("b"), *places).withColumn("_part", F.shiftright("a", 16))
        numbered = number_rows(own, ["volume"], ["_part"], ["a", "b"], "n")
        parts.append(numbered.select("volume", F.lit(kind).alias("kind"), F.expr(f"(n - 1) div {ROWS}").alias("chunk"), "n", "a", "b", *"zyx"))
    estimates = meta.groupBy("volume").agg(F.coalesce(F.max(long("estimated_number_of_nodes")), F.lit(-1)).alias("a"))
    zero, no = F.lit(0).cast("long"), F.lit(None).cast("double")
    parts.append(estimates.select("volume", F.lit("meta").alias("kind"), zero.alias("chunk"), zero.alias("n"), "a", zero.alias("b"), *[no.alias(c) for c in "zyx"]))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "n")
    register(nodes.sparkSession)
    rows.write.format("lineage_stores").mode("overwrite").save(path)
