"""Blosc 1 frames: header, blocks, splits, and byte or bit shuffling, over any of the format's codecs.

A frame begins with 16 bytes: version, codec version, flags, bytes per element,
then as 32-bit numbers the length of the data, of a block and of the frame. The
places of the blocks follow. A block is one stream, or one per byte of the
elements; a stream as long as its data is stored as it is.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

BYTES_SHUFFLED, STORED, BITS_SHUFFLED, WHOLE_BLOCKS = 1, 2, 4, 16
#: Fixed values of the format: codecs by number.
CODECS = ("blosclz", "lz4", "snappy", "zlib", "zstd")
#: Fixed values of the format: blocks are split only up to this element size, and into streams of at least this length.
MOST_SPLITS, LEAST_STREAM = 16, 128
#: Fixed values of the codec ``blosclz``: shortest match, its longest length in the control byte, farthest short distance.
LEAST_MATCH, LONG_MATCH, NEAR = 3, 6, 8191


def decode(frame: bytes) -> bytes:
    """The data of one frame. An unknown codec raises NotImplementedError, a damaged frame ValueError."""
    if len(frame) < 16:
        raise ValueError("a frame has at least 16 bytes")
    _, _, flags, size = frame[:4]
    total, block, length = struct.unpack_from("<3I", frame, 4)
    if length != len(frame) or not size or (total and not block):
        raise ValueError("damaged frame header")
    if flags & STORED:
        out = frame[16 : 16 + total]
    else:
        number = flags >> 5
        codec = CODECS[number] if number < len(CODECS) else str(number)
        count = -(-total // block) if total else 0
        starts = struct.unpack_from(f"<{count}I", frame, 16)
        pieces = [_block(frame, at, min(block, total - k * block), block, flags, size, codec) for k, at in enumerate(starts)]
        out = b"".join(pieces)
    if len(out) != total:
        raise ValueError("frame is shorter than it says")
    return out


def _block(frame: bytes, at: int, n: int, block: int, flags: int, size: int, codec: str) -> bytes:
    split = not flags & WHOLE_BLOCKS and n == block and size <= MOST_SPLITS and block // size >= LEAST_STREAM
    streams = size if split else 1
    out = []
    for _ in range(streams):
        (length,) = struct.unpack_from("<I", frame, at)
        out.append(_inflate(frame[at + 4 : at + 4 + length], n // streams, codec))
        at += 4 + length
    data = b"".join(out)
    if len(data) != n:
        raise ValueError("block is shorter than it says")
    if flags & BITS_SHUFFLED:
        return _unshuffle_bits(data, size)
    return _unshuffle_bytes(data, size) if flags & BYTES_SHUFFLED and size > 1 else data


def _inflate(stream: bytes, n: int, codec: str) -> bytes:
    if len(stream) == n:
        return stream
    if codec not in CODECS:
        raise NotImplementedError(f"Blosc codec {codec!r}: recode the chunks with one of {', '.join(CODECS)}")
    try:
        if codec == "zlib":
            return zlib.decompress(stream)
        if codec == "blosclz":
            return _blosclz(stream, n)
        return pa.decompress(stream, n, "lz4_raw" if codec == "lz4" else codec, asbytes=True)
    except (IndexError, OSError, zlib.error) as e:
        raise ValueError(f"damaged {codec} stream") from e


def _blosclz(stream: bytes, n: int) -> bytes:
    """Runs of literals, and matches that may reach into what they write themselves."""
    out, at, control = bytearray(), 1, stream[0] & 31
    while True:
        if control < 32:
            out += stream[at : at + control + 1]
            at += control + 1
        else:
            length, high = (control >> 5) - 1, (control & 31) << 8
            if length == LONG_MATCH:
                while stream[at] == 255:
                    length, at = length + 255, at + 1
                length, at = length + stream[at], at + 1
            distance, at = high + stream[at] + 1, at + 1
            if distance == NEAR + 1:
                distance, at = NEAR + 1 + (stream[at] << 8 | stream[at + 1]), at + 2
            length += LEAST_MATCH
            if distance > len(out) or len(out) + length > n:
                raise ValueError("match outside of the block")
            seen = bytes(out[-distance:])
            out += (seen * -(-length // distance))[:length]
        if at >= len(stream):
            return bytes(out)
        control, at = stream[at], at + 1


def _unshuffle_bytes(data: bytes, size: int) -> bytes:
    n = len(data) // size
    return np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.tobytes() + data[n * size :]


def _unshuffle_bits(data: bytes, size: int) -> bytes:
    """Rows of bits, least byte and bit first; only where elements fill whole bytes of a row."""
    n = len(data) // size
    if n % 8:
        return data
    rows = np.unpackbits(np.frombuffer(data, np.uint8, n * size).reshape(8 * size, n // 8), axis=1, bitorder="little")
    return np.packbits(rows.T, axis=1, bitorder="little").tobytes() + data[n * size :]


def encode(data: bytes, size: int, shuffle: str = "bits", block: int = 1 << 16, level: int = 1) -> bytes:
    """A frame of whole blocks over zstd; ``shuffle``: bits, bytes or none."""
    import zstandard

    flags = WHOLE_BLOCKS | 4 << 5 | {"bits": BITS_SHUFFLED, "bytes": BYTES_SHUFFLED, "none": 0}[shuffle]
    block = max(size, min(block // (8 * size) * 8 * size, max(1, len(data))))
    pieces, at = [], 16 + 4 * -(-len(data) // block)
    starts = []
    for k in range(0, len(data), block):
        part = _shuffled(data[k : k + block], size, shuffle)
        made = zstandard.ZstdCompressor(level=level).compress(part)
        made = part if len(made) >= len(part) else made
        starts.append(at)
        pieces.append(struct.pack("<I", len(made)) + made)
        at += len(pieces[-1])
    return struct.pack("<4B3I", 2, 1, flags, size, len(data), block, at) + struct.pack(f"<{len(starts)}I", *starts) + b"".join(pieces)


def _shuffled(data: bytes, size: int, shuffle: str) -> bytes:
    n = len(data) // size
    cells = np.frombuffer(data, np.uint8, n * size).reshape(n, size)
    if shuffle == "bits" and n % 8 == 0:
        return np.packbits(np.unpackbits(cells, axis=1, bitorder="little").T, axis=1, bitorder="little").tobytes() + data[n * size :]
    return cells.T.tobytes() + data[n * size :] if shuffle == "bytes" else data
