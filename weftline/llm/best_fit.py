"""Best-fit packing: matching of large items, best fit of small ones.

Documents become pieces of at most ``size`` tokens; only longer documents are
cut. Pieces above a third of the capacity stand at most two in a sequence: from
the largest down, each is matched with the largest unmatched one that still fits,
which leaves the least number of sequences for them. Smaller pieces follow in
descending order, each into the fullest sequence that holds it.

Pieces of equal length are alike, so the plan is made from the number of pieces
of each length alone: sequences that are equally full are one group, and a step
fills whole groups. Its size is bounded by the capacity, not by the number of
documents, so it is made once for all documents on the driver. Each piece then
finds its place by its length and its number among the pieces of that length.

Tokenising numbers pieces by task and length; what the tasks before hold is
added by a window over one row per task and length. Pieces are shuffled without
texts, at most once, where the table of those rows is too large to broadcast.

Ids are those of the ``tokenizers`` library for the vocabulary file. Its splitting
of a text into words is followed by a pattern where all characters are printable
and below U+0250, and the library's model encodes each distinct one about once a
task; all other texts, and texts with special tokens, go through the library whole.

Defined cases: null or empty text is the closing id alone; null ids stay null;
repeated rows are packed as often as they occur; a document of any length is
tokenised whole; pieces of equal length take their places in the order of tasks
and rows, which changes no length; an empty table gives no rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm._common import materialize, slices, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_PIECE_NAMES = [f.split()[0] for f in PIECES.split(", ")]
_PIECE_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
#: All but printable characters below U+0250, and U+0130, which alone of these lowers to two characters.
_UNUSUAL = re.compile("[^\n\t -~¡-įı-ɏ]")


def _class(kind: str) -> str:
    """Characters of a Unicode category that lower-cased text without unusual characters may hold."""
    lowered = sorted({chr(c).lower() for c in range(0x250) if c != 0x130})
    return "".join(re.escape(c) for c in lowered if unicodedata.category(c)[0] == kind)


_L, _N = _class("L"), _class("N")
#: The vocabulary's rule for words, on lower-cased text; white space is dropped.
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")


def _byte_letters() -> dict[int, str]:
    """The vocabulary spells bytes that are not printable in Latin-1 by the characters from U+0100 on."""
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD)]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


class WordEncoder(dict):
    """Ids of a text by a vocabulary whose words are encoded apart. Holds those of at most ``most`` short strings between
    white space, as bytes of 32-bit numbers."""

    def __init__(self, vocabulary: str | None = None, most: int = 500_000):
        from tokenizers import Tokenizer

        if vocabulary is None:
            import public_tokenizers

            vocabulary = public_tokenizers.path("word_bpe_49k.json")
        self.whole = Tokenizer.from_file(vocabulary)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.most = most

    def __missing__(self, string: str) -> bytes:
        if string.isalpha() or len(string) == 1:
            out = self._word(string)
        elif string[:-1].isalpha():
            out = self[string[:-1]] + self[string[-1]]
        else:
            out = b"".join(map(self._word, _WORD.findall(string)))
        if len(string) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[string] = out
        return out

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if _UNUSUAL.search(text) or any(t in text for t in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), dtype=np.uint32)


def pieces(docs: DataFrame, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, and its task (``part``) and number there among pieces of its length (``nth``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary)
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for part in slices(batch, 1000, 8):
                rows = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
                    for n, start in enumerate(range(0, len(ids), size)):
                        own = ids[start : start + size]
                        rows.append((key, n, start, len(own), zlib.crc32(own), task, seen[len(own)]))
                        seen[len(own)] += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _PIECE_KINDS, strict=True)], _PIECE_NAMES)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, PIECES)


class Flow(NamedTuple):
    """``n`` pieces of one length, from the ``first``-th on, go to as many sequences in a row, all at one offset."""

    length: int
    first: int
    n: int
    sequence: int
    offset: int


class _Bins:
    """Sequences in groups of equal room."""

    def __init__(self, size: int):
        self.size, self.count = size, 0
        self.rooms: list[int] = []  # ascending, those that some sequence has
        self.at: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, number)
        self.flows: list[Flow] = []
        self.placed: dict[int, int] = defaultdict(int)  # by length: pieces that have a place

    def open(self, n: int) -> tuple[int, int]:
        self.count += n
        return self.count - n, n

    def keep(self, room: int, run: tuple[int, int]) -> None:
        if room and run[1]:
            if room not in self.at:
                self.at[room] = []
                insort(self.rooms, room)
            self.at[room].append(run)

    def take(self, room: int) -> tuple[int, int]:
        run = self.at[room].pop()
        if not self.at[room]:
            del self.at[room]
            self.rooms.remove(room)
        return run

    def place(self, length: int, run: tuple[int, int], room: int) -> int:
        """One piece into each sequence of the run; returns the room that is left there."""
        self.flows.append(Flow(length, self.placed[length], run[1], run[0], self.size - room))
        self.placed[length] += run[1]
        return room - length

    def fill(self, length: int, n: int) -> None:
        """n pieces by best fit. A sequence that takes one is the fullest that holds the next, while it holds it."""
        while n:
            k = bisect_left(self.rooms, length)
            room = self.rooms[k] if k < len(self.rooms) else self.size
            each = room // length
            first, there = self.take(room) if k < len(self.rooms) else self.open(-(-n // each))
            whole = min(there, n // each)
            left = room
            for _ in range(each if whole else 0):
                left = self.place(length, (first, whole), left)
            n -= whole * each
            self.keep(left, (first, whole))
            first, there, left = first + whole, there - whole, room
            if there and n:  # fewer than ``each`` are left, or none at all
                for _ in range(n):
                    left = self.place(length, (first, 1), left)
                n = 0
                self.keep(left, (first, 1))
                first, there = first + 1, there - 1
            self.keep(room, (first, there))


def plan(counts: dict[int, int], size: int = 2048) -> tuple[list[Flow], int]:
    """Places of all pieces by length and number, and how many sequences there are. ``counts``: pieces by length, 1 to ``size``."""
    bins = _Bins(size)
    free = {k: n for k, n in counts.items() if n and 3 * k > size}
    lengths = sorted(free)
    while lengths:
        large = lengths[-1]
        n = free[large]
        k = bisect_left(lengths, min(large, size - large) + 1) - 1
        partner = lengths[k] if k >= 0 else None
        if partner is None or partner == large and n == 1:
            # a single one of half the capacity or less may still meet a shorter one
            partner = lengths[k - 1] if partner is not None and k > 0 else None
        if partner is None:
            m, took = n, {large: n}
        elif partner == large:
            m, took = n // 2, {large: n - n % 2}
        else:
            m = min(n, free[partner])
            took = {large: m, partner: m}
        run = bins.open(m)
        room = bins.place(large, run, size)
        if partner is not None:
            room = bins.place(partner, run, room)
        bins.keep(room, run)
        for length, used in took.items():
            free[length] -= used
            if not free[length]:
                lengths.remove(length)
    for length in sorted((k for k in counts if 3 * k <= size), reverse=True):
        bins.fill(length, counts[length])
    return bins.flows, bins.count


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """A row per piece with its sequence and place, see the module's docstring."""
    cut = materialize(pieces(docs, size, end_id, **options), "pieces")
    held = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    flows, _ = plan(counts, size)
    if sum(f.n for f in flows) != sum(counts.values()):
        raise RuntimeError("the plan does not hold every piece once")
    flows.sort()
    lengths, firsts, _, sequences, offsets = (np.array(c, dtype=np.int64) for c in (zip(*flows, strict=True) if flows else [()] * 5))
    of_length = {int(k): (a, b) for k in np.unique(lengths) for a, b in [np.searchsorted(lengths, [k, k + 1])]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            length, nth = part.column("length").to_numpy(), part.column("nth").to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            for k in np.unique(length).tolist():
                a, b = of_length[k]
                own = length == k
                at[own] = a + np.searchsorted(firsts[a:b], nth[own], side="right") - 1
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sequences[at] + nth - firsts[at]), pa.array(offsets[at])], [*_PIECE_NAMES[:5], "sequence_id", "offset"])

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.join(before, ["part", "length"]).select(*_PIECE_NAMES[:5], (F.col("nth") + F.col("before")).alias("nth"))
    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
