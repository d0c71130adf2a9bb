"""Document fingerprints: quartile bucket digests.

Six kinds of byte triplets within windows of five bytes are hashed into 128
buckets. The digest holds, for each bucket, the quartile of its count (two bits)
and a header with the length on a logarithmic scale and the ratios of the
quartiles. Two digests differ by a bounded score: buckets count 0, 1, 2 or 6
for quartiles that lie 0 to 3 apart, the header at most 3 x 12; likeness is one
minus the share of the greatest difference.

``edited_pairs`` needs each document's follower by descending id. Rows are dealt
into ranges, one to a partition, whose bounds come from quantiles of the ids; an
id (or the null id) that many rows have is split further by the hash of the text.
The first row of a range is also sent to the range before it, so each range is
streamed alone, one row held at a time.

Defined cases: null text is empty and has the digest of no triplets; texts under
three bytes have no triplets; null ids come after all others; rows with equal
ids are ordered by a hash of their text, then the text, so that ties give the
same rows in any layout; repeated rows follow each other; a single row is its own
follower; very long texts are held one at a time; other columns are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import slices, table

BUCKETS = 128
#: (salt, second byte, third byte) of the triplets in a window
TRIPLETS = ((2, 1, 2), (3, 1, 3), (5, 2, 3), (7, 2, 4), (11, 1, 4), (13, 3, 4))
_MOST = BUCKETS * 6 + 3 * 12
_STEP = np.array([0, 1, 2, 6])


_PERMUTATION = np.random.RandomState(20250101).permutation(256)


def _tables() -> tuple[list[np.ndarray], np.ndarray]:
    """For each salt a table of byte pairs, and the last table that leads to buckets."""
    t = _PERMUTATION.astype(np.uint8)
    high, low = np.divmod(np.arange(65536), 256)
    return [t[t[t[salt] ^ high.astype(np.uint8)] ^ low.astype(np.uint8)] for salt, _, _ in TRIPLETS], (t & (BUCKETS - 1)).astype(np.int64)


_PAIRS, _LAST = _tables()


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of hashed triplets; also of those that a window cut short at the end still holds."""
    b = np.frombuffer(data, dtype=np.uint8)
    n = b.size
    total = np.zeros(256, dtype=np.int64)
    wide = b.astype(np.uint16) << 8
    pairs = {}
    for table_, (_, i, j) in zip(_PAIRS, TRIPLETS, strict=True):
        if n <= j:
            continue
        if i not in pairs:
            pairs[i] = wide[: n - i] | b[i:]
        total += np.bincount(table_[pairs[i][: n - j]] ^ b[j:], minlength=256)
    return np.bincount(_LAST, weights=total, minlength=BUCKETS).astype(np.int64)


def fingerprint(data: bytes) -> str:
    """Header (length, quartile ratios) and 128 two-bit quartiles, as 70 hexadecimal digits."""
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = (codes.reshape(-1, 4) << np.array([6, 4, 2, 0], dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    length = min(255, round(12 * math.log2(len(data) + 1)))
    ratios = (int(15 * q1 // q3), int(15 * q2 // q3)) if q3 else (0, 0)
    return bytes([length, *ratios]).hex() + packed.tobytes().hex()


def _fields(digest: str) -> tuple[bytes, np.ndarray]:
    raw = bytes.fromhex(digest)
    packed = np.frombuffer(raw[3:], dtype=np.uint8)
    return raw[:3], (packed[:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8)) & 3


def difference(a: str, b: str) -> int:
    """0 (equal) to 804."""
    (ha, ca), (hb, cb) = _fields(a), _fields(b)
    return int(_STEP[np.abs(ca.astype(np.int8) - cb.astype(np.int8))].sum()) + sum(min(12, abs(x - y)) for x, y in zip(ha, hb, strict=True))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / _MOST


def edit(text: str, follower: str) -> str:
    """The last floor(n / 2) code points replaced by the follower's first as many."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


@dataclass(frozen=True)
class Ranges:
    """Where the ranges of the order begin. A row's place is (descending id as an ascending number, hash of its text);
    rows with null ids are ranges of their own, after all others. ``first``: the place of each range's first row."""

    bounds: np.ndarray  # (n, 2) places, ascending: a row lies behind as many bounds as its range's number
    null_bounds: np.ndarray  # hashes
    needed_by: dict  # (null, place, hash) of a range's first row -> the range before it

    def of(self, null: np.ndarray, place: np.ndarray, text_hash: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(self.bounds[:, 0], place, side=side) for side in ("left", "right"))
        out = high.copy()
        split = np.flatnonzero(low != high)  # bounds at this very id: the hash decides
        for at, end in set(zip(low[split].tolist(), high[split].tolist(), strict=True)):
            here = split[(low[split] == at) & (high[split] == end)]
            out[here] = at + np.searchsorted(self.bounds[at:end, 1], text_hash[here], side="right")
        return np.where(null, len(self.bounds) + 1 + np.searchsorted(self.null_bounds, text_hash, side="right"), out).astype(np.int32)

    @property
    def count(self) -> int:
        return len(self.bounds) + len(self.null_bounds) + 2


_LEAST = -(1 << 63)


def _hash_bounds(n: int, size: int) -> list[int]:
    """Hashes that deal n rows into pieces of about ``size``."""
    pieces = -(-n // size)
    return [_LEAST + (k << 64) // pieces for k in range(1, pieces)]


def _keys(column: pa.Array, hashes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """null, place and hash as integers: ids never pass through floating point."""
    null = column.is_null().to_numpy(zero_copy_only=False)
    return null, ~column.fill_null(0).to_numpy(), hashes.to_numpy()


def _range_numbers(ranges: Ranges):
    @F.arrow_udf("int")
    def r(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(ranges.of(*_keys(ids, hashes)))

    return r


def _ranges(keyed: DataFrame, rows: int, size: int) -> Ranges:
    """Ranges of about ``size`` rows: by quantiles of the ids, and by the hash of the text within ids (or the null id)
    that more rows have. The driver receives some numbers per range."""
    parts = -(-rows // size)
    place = keyed.where("doc_id is not null").select(F.bitwise_not("doc_id").alias("place"))
    marks = place.approxQuantile("place", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    bounds = {(min(max(int(q), _LEAST), -_LEAST - 1), _LEAST) for q in marks}
    nulls: list[int] = []
    if parts > 1:
        for r in keyed.groupBy("doc_id").count().where(F.col("count") > size).collect():  # at most ``parts`` rows
            if r.doc_id is None:
                nulls = _hash_bounds(r["count"], size)
            else:
                bounds |= {(~r.doc_id, h) for h in [_LEAST, *_hash_bounds(r["count"], size)]}
                bounds |= {(~r.doc_id + 1, _LEAST)} if r.doc_id > _LEAST else set()
    found = Ranges(np.array(sorted(bounds), dtype=np.int64).reshape(-1, 2), np.array(nulls, dtype=np.int64), {})
    first = keyed.groupBy(_range_numbers(found)("doc_id", "h").alias("r")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("place"), "h")).alias("first"))
    order = sorted((x.r, tuple(x.first)) for x in first.collect())  # one row per range
    return replace(found, needed_by={order[(k + 1) % len(order)][1]: order[k][0] for k in range(len(order))})


PAIRS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_pairs(docs: DataFrame, rows_per_range: int = 20_000, most_ranges: int = 100_000) -> DataFrame:
    """Fingerprints of each document, of its edited text, and how like they and the follower's are.

    Ranges hold about ``rows_per_range`` rows; where that would take more than ``most_ranges``, so that the driver's list
    of ranges stays bounded, they hold more (a range is streamed, its sort spills).
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = keyed.count()
    size = max(1, min(rows_per_range, -(-rows // int(spark.conf.get("spark.sql.shuffle.partitions")))), -(-rows // most_ranges))
    ranges = _ranges(keyed.select("doc_id", "h"), rows, size)
    needed = ranges.needed_by

    @F.arrow_udf("array<int>")
    def goals(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """Twice the own range; for a first row also twice the range that needs it, plus one."""
        null, place, h = _keys(ids, hashes)
        own = ranges.of(null, place, h).tolist()
        keys = zip(null.tolist(), place.tolist(), h.tolist(), strict=True)
        return pa.array([[2 * r, 2 * needed[k] + 1] if k in needed else [2 * r] for r, k in zip(own, keys, strict=True)], pa.list_(pa.int32()))

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in PAIRS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # range, id, text, fingerprint: waits for its follower
        done_with = None
        for batch in batches:
            for part in slices(batch, 1000, 16):
                out = []
                for goal, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    r, guest = divmod(goal, 2)
                    if guest and r == done_with:
                        continue  # rows that tie for the first: one is the follower
                    own = fingerprint(text.encode())
                    if held is not None and held[0] == r:
                        changed = edit(held[2], text).encode()
                        other = fingerprint(changed)
                        out.append((held[1], len(held[2]), hashlib.sha256(changed).hexdigest(), held[3], other, likeness(held[3], other), likeness(held[3], own)))
                    held = None if guest else (r, key, text, own)
                    done_with = r if guest else None
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if held is not None:
            raise RuntimeError("a range ended without the row that follows its last")

    dealt = keyed.withColumn("goal", F.explode(goals("doc_id", "h"))).select("goal", "doc_id", "text", "h", F.expr("goal div 2").cast("int").alias("r"))
    ordered = dealt.repartitionById(ranges.count, "r").sortWithinPartitions("goal", F.col("doc_id").desc_nulls_last(), "h", "text")
    return ordered.select("goal", "doc_id", "text").mapInArrow(run, PAIRS)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and followers."""
    return edited_pairs(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in SQL: bytes as rows, their triplets' buckets, and digests as strings."""
    look = lambda x: f"t[{x} + 1]"
    triplet = lambda salt, i, j: look(f"xor({look(f'xor({look(f"xor({_PERMUTATION[salt]}, b0)")}, b{i})')}, b{j})")
    buckets = ", ".join(f"CASE WHEN b{j} IS NOT NULL THEN {triplet(salt, i, j)} & {BUCKETS - 1} END" for salt, i, j in TRIPLETS)
    q1, q2, q3 = (f"s[{k * BUCKETS // 4}]" for k in (1, 2, 3))
    ratio = lambda q: f"CASE WHEN {q3} > 0 THEN 15 * {q} // {q3} ELSE 0 END"

    def near(k: str) -> str:
        steps = f"list_sum(list_transform(range(1, {BUCKETS + 1}), lambda i: ({_STEP.tolist()})[abs(a.codes[i] - {k}.codes[i]) + 1]))"
        return f"1.0 - ({steps} + list_sum(list_transform([1, 2, 3], lambda i: least(12, abs(a.head[i] - {k}.head[i]))))) / CAST({_MOST} AS DOUBLE)"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following, length(text) AS n_chars FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST)),
e AS (SELECT doc_id, n_chars, text, following, substr(text, 1, n_chars - n_chars // 2) || substr(following, 1, n_chars // 2) AS edited FROM f),
x AS (SELECT *, row_number() OVER () AS id FROM (SELECT text FROM e UNION SELECT edited FROM e)),
b AS (SELECT id, unnest(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS INTEGER))) AS b0, unnest(range(0, strlen(text))) AS pos FROM x),
n AS (SELECT id, b0, {", ".join(f"lead(b0, {k}) OVER w AS b{k}" for k in range(1, 5))} FROM b WINDOW w AS (PARTITION BY id ORDER BY pos)),
k AS (SELECT id, unnest([{buckets}]) AS bucket FROM (SELECT *, {_PERMUTATION.tolist()} AS t FROM n)),
c AS (SELECT id, bucket, count(*) AS c FROM k WHERE bucket IS NOT NULL GROUP BY ALL),
g AS (SELECT x.id, x.text, list(coalesce(c.c, 0) ORDER BY r.bucket) AS counts FROM x CROSS JOIN (SELECT unnest(range(0, {BUCKETS})) AS bucket) r LEFT JOIN c ON c.id = x.id AND c.bucket = r.bucket GROUP BY x.id, x.text),
q AS (SELECT *, list_sort(counts) AS s FROM g),
h AS (SELECT text, list_transform(counts, lambda v: CAST(v > {q1} AS INTEGER) + CAST(v > {q2} AS INTEGER) + CAST(v > {q3} AS INTEGER)) AS codes,
  [least(255, CAST(round_even(12 * log2(strlen(text) + 1), 0) AS INTEGER)), {ratio(q1)}, {ratio(q2)}] AS head FROM q),
p AS (SELECT *, array_to_string(list_transform(head, lambda v: format('{{:02x}}', v)), '') || array_to_string(list_transform(range(0, {BUCKETS // 2}), lambda i: format('{{:x}}', 4 * codes[2 * i + 1] + codes[2 * i + 2])), '') AS digest FROM h)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.digest AS fingerprint, o.digest AS edited_fingerprint, {near("o")} AS near_edited, {near("w")} AS near_next
FROM e JOIN p a ON a.text = e.text JOIN p o ON o.text = e.edited JOIN p w ON w.text = e.following
"""


OP9_SQL = _sql()
