"""What the jobs share: configuration, the command line's session, reading back."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).parent


def configuration(name: str, path: str | None = None) -> dict:
    """The job's own defaults, or a file's values over them; a name that the defaults lack is an error."""
    own = json.loads((HERE / f"{name}.json").read_text())
    given = json.loads(Path(path).read_text()) if path else {}
    if unknown := sorted(set(given) - set(own)):
        raise ValueError(f"unknown settings: {unknown}")
    return own | given


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A job's output, or no rows where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def command(name: str, run: Callable[..., dict], paths: dict[str, str]) -> None:
    """Runs a job on a session of its own. ``paths``: option -> what it is."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for option, what in paths.items():
        p.add_argument(f"--{option.replace('_', '-')}", required=True, help=what)
    p.add_argument("--config", help=f"JSON with settings in place of those of {name}.json")
    a = vars(p.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = configuration(name, a.pop("config"))
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, config=config, **a)
    finally:
        spark.stop()
