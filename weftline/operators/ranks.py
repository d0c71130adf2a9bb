"""Row numbers of large groups: counts of what comes before, and numbers within small parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, keys: list[str], parts: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the number of each row, from 1, in its group of equal ``keys`` by ``parts`` and then ``order``; nulls come first.

    A task sorts one part of a group; the rows of the parts before are added from a table of one row per part.
    """
    own = [f"_{name}_{k}" for k in (*keys, *parts)]
    counts = df.groupBy(*keys, *parts).agg(F.count("*").alias("_n")).withColumnsRenamed(dict(zip((*keys, *parts), own, strict=True)))
    earlier = Window.partitionBy(*own[: len(keys)]).orderBy(*own[len(keys) :]).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*keys, *parts).orderBy(*order))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(o)) for k, o in zip((*keys, *parts), own, strict=True)])
    return df.withColumn("_within", within).join(before, same).withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).drop("_within", "_before", *own)


def hash_ranked(df: DataFrame, keys: list[Column], group: list[str], seed: int, name: str) -> DataFrame:
    """Adds the rank in the group by an md5 of seed and keys, so that other engines can repeat it. Parts are the 256
    beginnings of hashes, alike in size."""
    hashed = df.withColumn("_md5", F.md5(F.concat_ws("|", F.lit(str(seed)), *keys).cast("binary"))).withColumn("_part", F.substring("_md5", 1, 2))
    return number_rows(hashed, group, ["_part"], ["_md5"], name).drop("_md5", "_part")
