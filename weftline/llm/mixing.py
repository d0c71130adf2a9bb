"""Mixing sources to target weights: Poisson replication.

A source's mean repetition rate is its target share of the output over its share
of the input. Each document's count inverts a Poisson distribution of that rate
at a uniform number seeded by a hash of its id; the document is exploded by its
count, and all copies are dealt out and sorted by a hash of id and copy number,
which shuffles them globally. Built from DataFrame functions alone.

Parameters: ``targets`` (source -> weight; sources not named get weight 0), or
without it weights that grow as the source's size to the power ``flatten``;
``max_rate`` (none unless given, then at most 8) caps the mean number of epochs of
a source, whose share then falls short of its target.

Defined cases: a null source is a source of its own; rows without an id take the
md5 of their text in its place; rows with equal ids get equal counts; empty, null
and very long texts are replicated like others; rows with equal shuffle keys
(copies of rows with equal ids) may stand in any order; an empty table gives no
rows; columns of the input that are named like those added (rate, n_copies, copy,
shuffle_key) are replaced.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm._common import DOC_COLUMNS, table

SEED = "mix-1"
#: Terms of all sources' distributions that may be broadcast.
TERMS_BROADCAST = 500_000


def uniform(key: Column, salt: str, digits: int = 13) -> Column:
    """A number in [0, 1) from the first hexadecimal digits of md5(key|salt)."""
    return _digits(key, salt, digits).cast("double") / float(16**digits)


def _digits(key: Column, salt: str, digits: int) -> Column:
    text = F.concat_ws("|", key, F.lit(salt))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def _key() -> Column:
    """What a row's random numbers are drawn from."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def rates(docs: DataFrame, targets: dict[str, float] | None = None, flatten: float = 0.5, max_rate: float | None = None) -> DataFrame:
    """source, rate, and the counts (first, last) outside of which a Poisson distribution of that rate has less than
    the random number's resolution: one row per source."""
    if max_rate is not None and not 0 < max_rate <= 8:
        raise ValueError("max_rate must be above 0 and at most 8")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(flatten))
    else:
        named = F.create_map(*[F.lit(x) for x in chain(*sorted(targets.items()))]) if targets else F.lit(None)
        weight = F.coalesce(named[F.col("source")], F.lit(0.0)) if targets else F.lit(0.0)
    weighted = sizes.withColumn("w", weight.cast("double"))
    total = weighted.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    rate = F.coalesce(F.try_divide(F.col("w") * F.col("all_n"), F.col("all_w") * F.col("n")), F.lit(0.0))
    if max_rate is not None:
        rate = F.least(F.lit(float(max_rate)), rate)
    joined = weighted.join(F.broadcast(total), how="cross").select("source", rate.alias("rate"))  # the total is one row
    reach = F.when(F.col("rate") > 0, 10 * F.sqrt("rate") + 30).otherwise(0.0)
    return joined.withColumns({"first": F.greatest(F.lit(0), F.floor(F.col("rate") - reach)).cast("long"), "last": F.ceil(F.col("rate") + reach).cast("long")})


def distributions(rates_: DataFrame) -> DataFrame:
    """Adds ``below``, the cumulative distribution of counts from ``first`` on. Terms are relative to the first one and
    summed as logarithms, so that no rate underflows."""
    terms = rates_.withColumn("k", F.explode(F.sequence("first", "last")))
    ordered = Window.partitionBy("source").orderBy("k")
    step = F.when(F.col("k") == F.col("first"), 0.0).otherwise(F.ln(F.col("rate") / F.col("k")))
    summed = terms.withColumn("log", F.sum(step).over(ordered)).withColumn("sum", F.sum(F.exp("log")).over(ordered))
    found = summed.groupBy("source", "rate", "first").agg(F.array_sort(F.collect_list("sum")).alias("sums"))
    return found.select("source", "rate", "first", F.transform("sums", lambda x: x / F.element_at("sums", -1)).alias("below"))


def replicate(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """Documents repeated and shuffled; adds rate, n_copies, copy (from 0) and shuffle_key."""
    docs = docs.drop("rate", "n_copies", "copy", "shuffle_key")
    found = rates(docs, **options)
    few = (found.agg(F.sum(F.col("last") - F.col("first") + 1).alias("n")).first().n or 0) <= TERMS_BROADCAST
    table_ = distributions(found).withColumnsRenamed({"source": "_source", "first": "_first", "below": "_below"})
    joined = docs.join(F.broadcast(table_) if few else table_, F.col("source").eqNullSafe(F.col("_source")))
    # the random number sits in the state, so that it is computed once a row
    state = F.struct(uniform(_key(), seed).alias("u"), F.col("_first").alias("n"))
    passed = F.aggregate("_below", state, lambda s, c: F.struct(s["u"].alias("u"), (s["n"] + (c <= s["u"]).cast("long")).alias("n")), lambda s: s["n"])
    counted = joined.withColumn("n_copies", passed).where("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1))).drop("_below", "_first", "_source")
    key = _digits(F.concat_ws("|", _key(), F.col("copy")), f"{seed}|shuffle", 15)
    return copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated to square-root-flattened source weights."""
    return replicate(table(spark, sf_dir, "documents").select(*DOC_COLUMNS))


#: Distributions reach so far beyond the mean that what is left is below the random number's resolution.
OP5_SQL = f"""
WITH s AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS w FROM documents GROUP BY source),
r AS (SELECT source, w * (SELECT sum(n) FROM s) / ((SELECT sum(w) FROM s) * n) AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 10 * sqrt(rate) + 30) AS BIGINT))) AS k FROM r),
t AS (SELECT source, rate, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below FROM k),
d AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key FROM documents),
u AS (SELECT *, CAST(('0x' || substr(md5(key || '|{SEED}'), 1, 13)) AS BIGINT) / {float(16**13)} AS u FROM d),
b AS (SELECT source, any_value(rate) AS rate, list(below ORDER BY k) AS below FROM t GROUP BY source),
e AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, u.key, b.rate, len(list_filter(b.below, lambda x: x <= u.u)) AS n_copies
  FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source),
c AS (SELECT *, unnest(range(0, n_copies)) AS copy FROM e)
SELECT doc_id, text, lang, source, n_chars, rate, n_copies, copy,
  CAST(('0x' || substr(md5(key || '|' || CAST(copy AS VARCHAR) || '|{SEED}|shuffle'), 1, 15)) AS BIGINT) AS shuffle_key
FROM c
"""
