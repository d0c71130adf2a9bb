"""WARC: revisit resolution.

Headers alone are shuffled by payload digest: of equal payloads of at least
``min_bytes`` bytes the smallest page id keeps its response, the others become
revisit records without a payload. What this decides, a row per digest that
several pages share, goes back to the pages by a broadcast, so payloads never
leave the task that read them. Where that table is larger than ``few`` rows the
revisits are listed by input file instead, and the files are written in waves
whose lists are small enough: pages are still read and written once.

Each task writes archives of about ``blob_mb`` compressed MB: a warcinfo record
and one gzip member per record, with fresh headers and ids of their own; every
file ends with an empty member. Reading back walks the members, checks lengths
and digests, and joins revisit records to the responses that they refer to.

Defined cases: null html is an empty payload, null url an empty target; a null
page id is written as none and read back as null, and never wins over an id; rows
with the smallest id of equal payloads are all responses, so a repeated row stays
whole; record ids differ even then, and revisits of such a tie name the page, but
no single record; an empty table gives no records; payloads may hold any text,
also WARC headers; very long payloads take one member, held one at a time; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import materialize, shared_dir, slices, table

VERSION, CRLF = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


#: Ends each file: what Spark's text writer puts after a row.
END = _member(b"")


# ---------------------------------------------------------------- planning


def _with_digests(pages: DataFrame) -> DataFrame:
    payload = F.coalesce("html", F.lit(""))
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"), *[c for c in pages.columns if c == "_file"])
    return narrow.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.unhex(F.sha2(F.col("html").cast("binary"), 256))})


def shared_payloads(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """digest, first (the smallest page id) and whether one row alone has it, of payloads that several rows share.

    Only digests and ids are shuffled, after sums per task."""
    heads = _with_digests(pages).where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("digest"), "page_id").agg(F.count("*").alias("n"))
    # a null id is never the smallest: min() of the struct comes from the others, if there are any
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n")))
    found = heads.groupBy("digest").agg(least.alias("least"), F.sum("n").alias("rows")).where("rows > 1 and least is not null")
    return found.select("digest", F.col("least.page_id").alias("first"), (F.col("least.n") == 1).alias("sole"))


def _decided(joined: DataFrame) -> DataFrame:
    later = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return joined.select(
        "page_id", "url", F.when(~later, F.col("html")).alias("html"), "payload_bytes", F.lower(F.hex("payload_digest")).alias("payload_digest"),
        F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("first")).alias("refers_to"), F.coalesce("sole", F.lit(False)).alias("sole"),
    )


def plan_records(pages: DataFrame, min_bytes: int = 100, few: int = 1_000_000) -> Iterator[DataFrame]:
    """page_id, url, html (null in revisits), payload_bytes, payload_digest, record_type, refers_to, and sole (one record
    is the response of that payload): all pages in one table, or in waves where more than ``few`` payloads are shared."""
    shared = materialize(shared_payloads(pages, min_bytes), "shared_payloads")
    if shared.count() <= few:
        rows = _with_digests(pages)
        yield _decided(rows.join(F.broadcast(shared), rows.payload_digest == shared.digest, "left"))
        return
    try:
        located = pages.withColumn("_file", F.col("_metadata.file_path"))
    except AnalysisException:  # no files behind these rows: write them once
        pages = materialize(pages.select("page_id", "url", "html"), "pages")
        located = pages.withColumn("_file", F.col("_metadata.file_path"))
    heads = _with_digests(located).where(F.col("payload_bytes") >= min_bytes).select("_file", "page_id", "payload_digest").distinct()
    listed = materialize(heads.join(shared, heads.payload_digest == shared.digest).select("_file", F.col("page_id").alias("own"), "digest", "first", "sole"), "listed")
    waves = -(-listed.count() // few)
    for k in range(waves):
        mine = F.pmod(F.xxhash64("_file"), F.lit(waves)) == k  # prunes files
        rows, known = _with_digests(located.where(mine)).drop("_file"), F.broadcast(listed.where(mine).drop("_file").distinct())
        yield _decided(rows.join(known, (rows.payload_digest == known.digest) & rows.page_id.eqNullSafe(known.own), "left"))


# ---------------------------------------------------------------- writing


def _record(kind: str, record_id: str, info_id: str, date: str, fields: list[tuple[str, str]], content_type: str, block: bytes) -> bytes:
    named = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *([("WARC-Warcinfo-ID", f"<{info_id}>")] if kind != "warcinfo" else []), *fields, ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return VERSION.encode() + b"\r\n" + "".join(f"{k}: {v}{CRLF}" for k, v in named).encode() + b"\r\n" + block + b"\r\n\r\n"


def _urn(*parts: object) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}"


def page_record(page_id: int | None, url: str, html: bytes | None, size: int, digest: str, refers_to: int | None, sole: bool, run: str, place: str, info_id: str, date: str) -> bytes:
    """One record. ``place`` is unique within the run; the response of a payload that one row alone has is named by page
    and digest instead, so that revisits can refer to it."""
    own = _urn(run, "page", page_id, digest) if sole and refers_to is None else _urn(run, "place", place)
    fields = [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page", str(refers_to)), *([("WARC-Refers-To", f"<{_urn(run, 'page', refers_to, digest)}>")] if sole else [])]
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {size}{CRLF}{CRLF}".encode()
    return _record("response" if refers_to is None else "revisit", own, info_id, date, fields, "application/http; msgtype=response", http + (html or b""))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 100, few: int = 1_000_000, blob_mb: int = 32, date: str | None = None) -> None:
    """WARC files of all pages at ``path``: one gzip member per record, a warcinfo record first in each file."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    run = str(uuid.uuid4())
    for wave, records in enumerate(plan_records(pages, min_bytes, few)):

        def files(batches: Iterator[pa.RecordBatch], wave: int = wave) -> Iterator[pa.RecordBatch]:
            task, blob, info, n = TaskContext.get().partitionId(), bytearray(), "", 0
            for batch in batches:
                for part in slices(batch, 500, 8):
                    page, url, _, size, digest, _, refers, sole = (part.column(i).to_pylist() if i != 2 else None for i in range(8))
                    html = [None if x is None else x.as_py() for x in part.column(2).cast(pa.binary())]
                    for i in range(part.num_rows):
                        n += 1
                        if not blob:
                            info = _urn(run, "info", wave, task, n)
                            blob += _member(_record("warcinfo", info, info, date, [], "application/warc-fields", f"software: weftline{CRLF}format: WARC File Format 1.1{CRLF}".encode()))
                        blob += _member(page_record(page[i], url[i], html[i], size[i], digest[i], refers[i], sole[i], run, f"{wave}/{task}/{n}", info, date))
                        if len(blob) >= blob_mb << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([bytes(blob)], pa.binary())], ["value"])
                            blob.clear()
            if blob:
                yield pa.RecordBatch.from_arrays([pa.array([bytes(blob)], pa.binary())], ["value"])

        made = records.mapInArrow(files, "value binary").select(F.col("value").cast("string").alias("value"))
        # one row is one file; its bytes are no text, and what the writer puts after a row is a gzip member of nothing
        made.write.mode("append").option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", END.decode("ISO-8859-1")).text(path)


# ---------------------------------------------------------------- reading


def members_of(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The contents of gzip members, one after the other."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("archive ends within a record")
            out.append(d.decompress(view[at : at + step]))
            at += min(step, len(view) - at) - len(d.unused_data)
        yield b"".join(out)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    end = data.find(b"\r\n\r\n")
    lines = data[: max(0, end)].decode().split(CRLF)
    if end < 0 or lines[0] != VERSION:
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) != n or data[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError(f"record length differs: {head.get('WARC-Record-ID')}")
    return head, block


ROWS = "record_type string, record_id string, page_id long, url string, payload_digest string, refers_to long, refers_to_id string, block_bytes long, payload_bytes long, http string, payload string"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Response and revisit records. ``payload_bytes``: of responses as read; without ``payloads`` these are checked, but
    not returned."""
    names = [f.split()[0] for f in ROWS.split(", ")]
    longs = {f.split()[0] for f in ROWS.split(", ") if f.endswith(" long")}

    def row(head: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
        response = head["WARC-Type"] == "response"
        if response and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload digest differs: {head['WARC-Record-ID']}")
        number = lambda k: int(head[k]) if k in head else None
        name = lambda k: head[k][1:-1] if k in head else None
        return (
            head["WARC-Type"], name("WARC-Record-ID"), number("X-Page-ID"), head["WARC-Target-URI"], digest, number("X-Refers-To-Page"), name("WARC-Refers-To"),
            len(block), len(payload) if response else None, http.decode(), payload.decode() if payloads and response else None,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for data in members_of(content.as_py()):
                    if not data or (record := parse_record(data))[0]["WARC-Type"] == "warcinfo":
                        continue
                    rows.append(row(*record))
                    held += len(data) if payloads else 200
                    if held > 8 << 20:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in longs else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ROWS)


def resolve_revisits(records: DataFrame, few: int = 1_000_000) -> DataFrame:
    """Digest and length of each page's full payload: responses from their bytes, revisits from the response they refer to."""
    own = F.col("record_type") == "response"
    wanted = records.where(~own).select(F.col("payload_digest").alias("_digest"), F.col("refers_to").alias("_to")).distinct()
    originals = (
        records.where(own).join(wanted, (F.col("payload_digest") == F.col("_digest")) & (F.col("page_id") == F.col("_to")))
        .groupBy("_digest", "_to").agg(F.first("payload_bytes").alias("_bytes"))
    )
    originals = materialize(originals, "originals")
    if originals.limit(few + 1).count() <= few:
        originals = F.broadcast(originals)
    found = records.join(originals, (F.col("payload_digest") == F.col("_digest")) & (F.col("refers_to") == F.col("_to")), "left")
    size = F.when(own, F.col("payload_bytes")).otherwise(F.coalesce(F.col("_bytes"), F.raise_error(F.lit("revisit without response")).cast("long")))
    return found.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages in the shared folder, read back and resolved."""
    path = shared_dir(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    columns = ["record_type", "page_id", "payload_digest", "refers_to", "payload_bytes"]
    return resolve_revisits(materialize(read_archives(spark, path, payloads=False).select(*columns), "records"))


OP6_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
