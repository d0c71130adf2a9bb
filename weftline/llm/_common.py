"""What the operators of this subpackage share: table reading, Arrow row mapping, and written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftline.plans.storage import materialize, release, shared_dir

__all__ = ["DOC_COLUMNS", "as_bytes", "filter_rows", "map_batches", "materialize", "release", "shared_dir", "slices", "table"]

#: The columns of the ``documents`` table, in order; pipeline stages but the last return these.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 1000, mb: int = 16) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows and about ``mb`` MB, so that memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, mb):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, make: Callable[[], Callable[[list], list[bool]]], column: str = "text", rows: int = 1000, mb: int = 8) -> DataFrame:
    """Rows for whose ``column`` the decision holds; all columns stay as they are. ``make`` builds the decision once a task."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = make()
        for batch in batches:
            for part in slices(batch, rows, mb):
                yield part.filter(pa.array(decide(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def slices(batch: pa.RecordBatch, rows: int, mb: int) -> Iterator[pa.RecordBatch]:
    each = max(1, batch.nbytes // max(1, batch.num_rows))
    step = max(1, min(rows, (mb << 20) // each))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
