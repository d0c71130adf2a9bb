"""Media columns: payloads stored as lossless WebP and read back into pixel arrays.

A payload of whole 64-byte rows becomes images of at most ``MAX_SIDE`` rows, each
either of 64 grey samples to a row or of 16 pixels of four samples (blue, green,
red, alpha); larger payloads take several files one after the other. The codec is
``webp_lossless``.

The encoder takes, by its entropy, the shortest grey form: a palette that packs
samples, back-references to repeated lines, or a predictor with uniform mode. It also
weighs pixels with a colour cache, which holds the groups of four bytes that recur,
and takes them where they save ``WORTH`` of the grey form: their codes take more time
to write and read. ``pixels_from`` spares small payloads that: ``store`` alone has such
a bound by default, the media column and the query weigh every payload. Code groups and transforms across colours do not shorten text; they
are decoded wherever other encoders used them.

Defined cases: null text is the empty payload, which is padded to one row of
zeros; repeated rows give equal files; very long texts take several images, so
that a decoder holds one MiB of samples at a time; of equally short grey forms the
one without a predictor, then the left neighbour is taken, so that equal texts give
equal bytes; other columns are not read, whatever their names (``read_features``
replaces those that it adds); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import webp_lossless
from weftline.llm._common import as_bytes, map_batches, table

ROW = 64
#: Payload bytes from which ``store`` weighs pixels unless told otherwise, and the share of the grey form that they have to save.
PIXELS_FROM, WORTH = 4096, 1 / 16


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def store(payload: bytes, pixels_from: int = PIXELS_FROM) -> bytes:
    """WebP files, one after the other, of a payload of whole rows."""
    most = ROW * webp_lossless.MAX_SIDE
    return b"".join(_image(payload[i : i + most], pixels_from) for i in range(0, len(payload), most))


def _image(part: bytes, pixels_from: int) -> bytes:
    grey = webp_lossless.encode_grey(part, ROW)
    if len(part) < pixels_from:
        return grey
    most = len(grey) * (1 - WORTH)
    pixels = webp_lossless.encode_cached(part, ROW // 4, most)  # none where its entropy says no
    return pixels if pixels is not None and len(pixels) < most else grey


def files_of(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        n = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + n])
        at += n
    return out


def pixels_of(media: bytes) -> list[np.ndarray]:
    """Pixel arrays (rows, columns) of 0xAARRGGBB."""
    return [webp_lossless.decode(f) for f in files_of(media)]


def samples_of(media: bytes) -> bytes:
    """The samples of images that ``store`` wrote: their width tells how many a pixel holds."""
    return b"".join(p.astype("<u4").tobytes() if p.shape[1] == ROW // 4 else (p >> 8 & 255).astype(np.uint8).tobytes() for p in pixels_of(media))


def feature(samples: bytes) -> str:
    """Mean, entropy in bits and a 16-bin histogram in thousandths of the samples."""
    counts = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256)
    share = counts[counts > 0] / len(samples)
    bins = 1000 * counts.reshape(16, 16).sum(axis=1) // len(samples)
    return f"{(counts * np.arange(256)).sum() / len(samples):.4f}|{-(share * np.log2(share)).sum():.4f}|{','.join(map(str, bins))}"


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pixels_from: int = 0) -> DataFrame:
    """Id, length of the UTF-8 text, and the media column."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = as_bytes(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([store(padded(t), pixels_from) for t in texts], pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, n_bytes long, media binary")


READ = {
    "payload_bytes": ("long", lambda media, samples: len(samples)),
    "payload_sha256": ("string", lambda media, samples: hashlib.sha256(samples).hexdigest()),
    "tail_crc32": ("long", lambda media, samples: zlib.crc32(samples[-ROW:])),
    "media_bytes": ("long", lambda media, samples: len(media)),
    "media_sha256": ("string", lambda media, samples: hashlib.sha256(media).hexdigest()),
    "feature": ("string", lambda media, samples: feature(samples)),
}


def read_features(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """Decodes the media column and replaces it by what was computed from its samples."""
    kept = [c for c in rows.columns if c != media_col and c not in READ]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stored = batch.column(len(kept)).to_pylist()
        read = [samples_of(m) for m in stored]
        made = [pa.array([f(m, s) for m, s in zip(stored, read, strict=True)], pa.int64() if kind == "long" else pa.string()) for kind, f in READ.values()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*kept, *READ])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), *(f"{n} {kind}" for n, (kind, _) in READ.items())])
    return map_batches(rows.select(*kept, media_col), run, schema)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as lossless WebP, read back."""
    return read_features(with_media(table(spark, sf_dir, "documents")))
