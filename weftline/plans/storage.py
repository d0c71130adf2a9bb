"""Intermediate tables in the folder that the cluster shares.

Tables are removed when the application ends, and earlier where a caller knows
that nothing reads them any more.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may go without that setting: on a cluster a
    machine's own folder would lose rows, so it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="weftline-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in that folder, removed when the application ends."""
    path = f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def mounted(path: str) -> str:
    """The plain path of a folder that Python's own files reach: all machines must mount it. Other stores raise."""
    if m := re.match(r"file:(?://)?(?=/)", path):
        return path[m.end() :]
    if re.match(r"[a-z0-9+.-]+:", path, re.IGNORECASE):
        raise ValueError(f"{path}: plain files need a folder that all machines mount")
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write as Parquet and read again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote. Nothing derived from them may be run afterwards."""
    for df in tables:
        fs, at = _file_system(df.sparkSession, df.stored_at)
        fs.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
