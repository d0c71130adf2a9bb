"""Packing: order-preserving dynamic programming.

Tokens of a partition's documents form one stream in reading order. Windows of
at most ``size`` tokens are cut at candidate positions: document ends are free,
sentence ends cost a little, cuts inside a sentence (offered only where no other
candidate is near) cost more. With f(j) the least cost of a stream that ends at
candidate j,

    f(j) = penalty(j) + size - j + min { f(i) + i : j - size <= i < j },

so a monotone queue of f(i) + i gives each transition in constant amortised
time. Only the rest of a partition's stream can need much padding; it is split
into lengths that are powers of two, which need none, where that costs less.

No shuffle: each task streams its own partition and keeps one block of tokens.
Sequence ids hold the partition's number in the upper bits.

Token ids are those of the ``tokenizers`` library for the vocabulary file. A
rank file of the same vocabulary, four times as fast, encodes the texts whose
characters are all below U+0250 and printable; any other text goes through
``tokenizers`` itself.

Defined cases: null or empty text is the closing id alone; null ids stay null;
repeated rows are packed as often as they occur; an empty table gives no rows;
a document of any length is tokenised whole and cut by the same program; of plans
of equal cost that whose last window begins earliest is taken; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import slices, table

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Printable characters on whose classes both tokenizer libraries agree.
_UNUSUAL = re.compile("[^\n\t -~¡-ɏ]")


class Encoder:
    """Ids of a text by a vocabulary file of the ``tokenizers`` library; ``ranks``: the same vocabulary for the fast path."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        from tokenizers import Tokenizer

        if vocabulary is None:
            import public_tokenizers

            vocabulary, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
        self.slow = Tokenizer.from_file(vocabulary)
        self.fast = self._ranked(ranks) if ranks else None
        n = self.slow.get_vocab_size()
        #: ids whose text ends a sentence or a line
        self.ends = np.array([bool(re.search(r"[.!?\n]$", self.slow.decode([i]))) for i in range(n)])
        self.special = [t for t in self.slow.get_added_tokens_decoder().values()]

    @staticmethod
    def _ranked(path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not _UNUSUAL.search(text) and not any(t.content in text for t in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def plan_cuts(at: list[int], penalty: list[float], size: int, rest: Callable[[int], float] | None = None) -> list[int]:
    """Positions of the least-cost cuts of a stream whose candidates ``at`` ascend by at most ``size`` and end at its end.

    The last cut is that end. With ``rest``, what follows the last cut stays open, at most ``size`` tokens, at that cost.
    """
    pos = [0, *at]
    cost = [0.0] * len(pos)
    came = [0] * len(pos)
    queue: list[int] = []
    keys: list[float] = []
    head = 0
    for j in range(1, len(pos)):
        p = pos[j]
        key = cost[j - 1] + pos[j - 1]
        while len(keys) > head and keys[-1] > key:
            keys.pop()
            queue.pop()
        queue.append(j - 1)
        keys.append(key)
        while pos[queue[head]] < p - size:
            head += 1
        cost[j] = penalty[j - 1] + size - p + keys[head]
        came[j] = queue[head]
        if head > 4096:
            del queue[:head], keys[:head]
            head = 0
    j = len(pos) - 1
    if rest is not None:
        first = bisect_left(pos, pos[-1] - size)
        j = min(range(len(pos) - 1, first - 1, -1), key=lambda k: cost[k] + rest(pos[-1] - pos[k]))
    cuts = []
    while j:
        cuts.append(pos[j])
        j = came[j]
    return cuts[::-1]


def split_rest(length: int, size: int, penalty: float) -> list[int]:
    """Lengths for the rest of a stream: one padded sequence, or powers of two where their cuts cost less."""
    if length == 0:
        return []
    parts = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return parts if len(parts) == 1 or penalty * (len(parts) - 1) < size - length else [length]


def rest_cost(length: int, size: int, penalty: float) -> float:
    """What ``split_rest`` costs: the lesser of the cuts and the padding."""
    return min(penalty * max(0, length.bit_count() - 1), float(size - length)) if length else 0.0


class Packer:
    """Packs a stream of (id, tokens). ``sentence_penalty`` and ``hard_penalty`` are in tokens of padding; ``grid``:
    distance of cuts offered where a sentence is longer; ``block``: tokens planned at once."""

    def __init__(self, ends: np.ndarray, size: int = 2048, sentence_penalty: float = 2.0, hard_penalty: float = 8.0, grid: int = 16, block: int = 1 << 20):
        self.ends, self.size, self.sentence, self.hard, self.grid, self.block = ends, size, sentence_penalty, hard_penalty, min(grid, size), block
        self.parts: list[tuple] = []  # (id, tokens of the whole document, start, tokens here)
        self.held = 0

    def add(self, key, ids: np.ndarray) -> list[tuple]:
        self.parts.append((key, len(ids), 0, ids))
        self.held += len(ids)
        return self._flush(False) if self.held >= self.block else []

    def close(self) -> list[tuple]:
        return self._flush(True) if self.held else []

    def _candidates(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[list[int], list[float]]:
        inner = np.flatnonzero(self.ends[ids]) + 1
        at = np.union1d(inner, bounds)
        gap = np.diff(at, prepend=0)
        if (wide := np.flatnonzero(gap > self.grid)).size:
            more = np.concatenate([np.arange(at[k] - gap[k] + self.grid, at[k], self.grid) for k in wide])
            at = np.union1d(at, more)
        else:
            more = at[:0]
        cost = np.full(at.size, self.sentence)
        cost[np.searchsorted(at, more)] = self.hard
        cost[np.searchsorted(at, bounds)] = 0.0
        return at.tolist(), cost.tolist()

    def _flush(self, last: bool) -> list[tuple]:
        """Pieces of all planned sequences: (id, start, tokens, document's tokens, number of sequence here, offset, length of sequence)."""
        ids = np.concatenate([p[3] for p in self.parts])
        bounds = np.cumsum([len(p[3]) for p in self.parts])
        plan = self._candidates(ids, bounds)
        if last:
            cuts = plan_cuts(*plan, self.size, lambda n: rest_cost(n, self.size, self.hard))
            before = cuts[-1] if cuts else 0
            cuts += (before + np.cumsum(split_rest(int(bounds[-1]) - before, self.size, self.hard))).astype(int).tolist()
        else:
            cuts = plan_cuts(*plan, self.size, lambda n: 0.0)  # the next block goes on with the rest
        end = cuts[-1] if cuts else 0
        edges = np.union1d(np.concatenate([[0], bounds[bounds < end]]), cuts).astype(np.int64)
        a, b = edges[:-1], edges[1:]
        doc = np.searchsorted(bounds, a, side="right")
        begins = np.concatenate([[0], bounds[:-1]])
        first = np.concatenate([[0], cuts]).astype(np.int64)
        seq = np.searchsorted(first, a, side="right") - 1
        lengths = np.diff(first)
        out = []
        for s, e, d, q in zip(a.tolist(), b.tolist(), doc.tolist(), seq.tolist(), strict=True):
            key, total, start, _ = self.parts[d]
            out.append((key, start + s - int(begins[d]), ids[s:e], total, q, s - int(first[q]), int(lengths[q])))
        d = int(np.searchsorted(bounds, end, side="right"))
        if d < len(self.parts):
            key, total, start, own = self.parts[d]
            skip = end - int(begins[d])
            self.parts = [(key, total, start + skip, own[skip:]), *self.parts[d + 1 :]]
        else:
            self.parts = []
        self.held = int(bounds[-1]) - end
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, vocabulary: str | None = None, ranks: str | None = None, **options) -> DataFrame:
    """A row per piece of a document in a sequence, see the module's docstring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, ranks)
        packer = Packer(encoder.ends, **options)
        number = TaskContext.get().partitionId() << 40

        def emit(pieces: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            pieces = list(pieces)
            if not pieces:
                return
            rows = [(k, s, len(t), zlib.crc32(np.ascontiguousarray(t, dtype="<u4")), total, number + q, o, n) for k, s, t, total, q, o, n in pieces]
            number += pieces[-1][4] + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], _NAMES)

        for batch in batches:
            for part in slices(batch, 1000, 8):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    yield from emit(packer.add(key, np.append(encoder.ids(text or ""), np.uint32(end_id))))
        yield from emit(packer.close())

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
