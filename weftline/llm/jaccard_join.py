"""N-gram Jaccard join: a token-group matrix.

Documents become sets of hashed five-word shingles; two sets link when their
Jaccard similarity is at least 0.8. The join is exact and runs in these steps.

1. Sets. One pass writes each set once per task: 64-bit identity, size, sorted
   48-bit tokens. Equal sets share their identity, so copies cost nothing later.
2. Token statistics. Of each set the prefix that any link must touch (the first
   n - ceil(0.8 n) + 1 tokens in hash order) is dealt out by token; tokens that
   many sets hold are marked in a bitmap of fixed size. Any bitmap keeps the join
   exact: it only orders tokens, frequent ones last.
3. Token-group matrix. Prefixes in that order are dealt out by token again. The
   sets that share a prefix token form a run; runs with the same sets are one. A
   set's place in the order bounds the size of its partners: where the token is
   the first that two sets share, both must still have enough tokens after it.
4. Groups. In each run the sets of one size class and the class below belong to
   the group of the smallest identity among them, its leader. So two sets that
   may link share a group. Large groups are salted; the leader is in each part.
5. Opening. A part is cut into blocks of at most ``block`` sets of similar size,
   each with its union of tokens. A set queries the blocks before it: parity
   sketches bound the differences of set pairs from below, the union bounds the
   overlap from above, and only blocks that pass both are opened. Sets already
   known to be of one class are not compared again.
6. Parts of a salted group: sets of different classes that share a run query
   each other's blocks in the same way; sets that are alone in their class share
   one block per part, so a set asks a part once, not once per set.
7. Components of all links, by large and small stars, give the classes.

Token lists move as binary columns. A part holds at most ``part_sets`` sets and
about ``part_tokens`` tokens; a token that more than ``hot`` sets hold is dealt by
token and set, and its run is completed by sums; so nothing larger is held
together. The identity of a set has 64 bits: a false copy is expected from some
billions of sets on. A group of n different texts that all miss the similarity
narrowly is compared in n x parts / 2 queries: no exact method avoids that.

Defined cases: null, empty and blank texts have an empty set, link with nothing
and are their own component; texts under five words have one shingle, the whole
sequence; very long texts have sets as long, none is cut; repeated rows and rows
with equal sets are copies; different texts under one id are different documents;
a null id gets its class's smallest id, or null if there is none; ties do not
matter, as classes do not depend on any order; other columns, whatever their
names, are not read by the join and stay as they are in ``keep_one``; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm._common import as_bytes, materialize, release, shared_dir, slices, table
from weftline.llm._text import mix, words
from weftline.llm.components import connected_components

TOKEN_BYTES = 6
_MASK = np.uint64((1 << 8 * TOKEN_BYTES) - 1)
_FACTORS = np.random.RandomState(11).randint(1, 1 << 62, size=64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Settings:
    """``numerator`` / ``denominator``: the similarity; ``frequent``: sets that share a token of ordinary frequency at
    most; ``slots``: least size of the bitmap of frequent tokens, ``most_slots``: its greatest; ``block``, ``part_sets``,
    ``part_tokens``: see the module; ``per_bucket``: tokens that a bucket holds, ``most_buckets``: buckets of one pass, ``hot``: sets that
    share a token at most where one task holds them together;
    ``few``: narrow rows (at most 40 bytes each) that may be broadcast; ``cells``: bits of a sketch."""

    words: int = 5
    numerator: int = 80
    denominator: int = 100
    frequent: int = 8
    slots: int = 1 << 22
    most_slots: int = 1 << 28
    block: int = 64
    part_sets: int = 4096
    part_tokens: int = 2_000_000
    cells: int = 1024
    per_bucket: int = 1 << 20
    most_buckets: int = 1 << 16
    hot: int = 1 << 20
    few: int = 1_000_000

    def needed(self, n: np.ndarray) -> np.ndarray:
        """Overlap that a set of n tokens has with any set it links with."""
        return -(-self.numerator * n // self.denominator)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - self.needed(n) + 1

    def most(self, n: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The greatest size of a partner whose first shared token is at this place (from 0)."""
        return (n - place) * (self.numerator + self.denominator) // self.numerator - n

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Tokens at most that are in one of two linked sets only."""
        return a + b - 2 * -(-self.numerator * (a + b) // (self.numerator + self.denominator))

    def links(self, overlap: int, a: int, b: int) -> bool:
        return self.denominator * overlap >= self.numerator * (a + b - overlap)


def shingles(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z are lower-cased, words end at ASCII white space."""
    joined = b"\n".join(t.lower() for t in texts) + b"\n"
    starts, _, h = words(np.frombuffer(joined, dtype=np.uint8))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(starts, np.concatenate([[0], ends]))
    m = h.size - k + 1
    all_ = np.zeros(0, dtype=np.uint64)
    if m > 0:
        all_ = h[:m] * _FACTORS[0]
        for i in range(1, k):
            all_ = all_ + h[i : m + i] * _FACTORS[i]
        all_ = mix(all_)
    out = []
    for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        if b - a >= k:
            out.append(np.unique(all_[a : b - k + 1]))
        elif b > a:
            short = h[a:b] * _FACTORS[: b - a] + np.uint64(b - a)  # the length keeps it apart from whole shingles
            out.append(mix(short.sum(keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def pack_tokens(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def unpack_tokens(data: bytes) -> np.ndarray:
    n = len(data) // TOKEN_BYTES
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(data, dtype=np.uint8).reshape(n, TOKEN_BYTES)
    return out.view("<u8").ravel()


SETS = "doc_id long, key long, sid long, n long, tokens binary, task int"


def text_key() -> Column:
    """Tells the rows of one id apart; null is empty."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def write_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, hash of the text, identity of the set (null if empty), its size, and its tokens where this task meets it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch, 500, 1):
                sids, sizes, tokens = [], [], []
                for own in shingles(as_bytes(part.column(2)), s.words):
                    sizes.append(own.size)
                    sid = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) if own.size else None
                    sids.append(sid)
                    tokens.append(None if sid is None or sid in seen else pack_tokens(np.sort(own & _MASK)))
                    if sid is not None:
                        seen.add(sid)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary()), pa.array([task] * len(sids), pa.int32())], [f.split()[0] for f in SETS.split(", ")])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text")).mapInArrow(run, SETS)
    path = shared_dir(docs.sparkSession, "sets")
    made.write.option("parquet.block.size", 16 << 20).parquet(path)  # tokens don't compress: small row groups bound what writers hold
    return docs.sparkSession.read.schema(made.schema).parquet(path)


# ---------------------------------------------------------------- prefixes, dealt out by token


def _high(tokens: np.ndarray) -> np.ndarray:
    """What a bucket keeps of a token: its upper 32 bits."""
    return (tokens >> np.uint64(8 * TOKEN_BYTES - 32)).astype(np.uint32)


def _slot(high: np.ndarray, per: int) -> np.ndarray:
    return (high * np.uint32(2654435761) >> np.uint32(32 - (per.bit_length() - 1))).astype(np.int64) if per > 1 else np.zeros(high.size, dtype=np.int64)


def _turn(tokens: np.ndarray, turns: int) -> np.ndarray:
    """The turn that deals a token; turns and buckets take different bits."""
    return (tokens >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64) * turns >> 16


def _ident(high: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """All that buckets know of a token, as one number."""
    return high.astype(np.uint64) << np.uint64(16) | bucket.astype(np.uint64)


def _deal(sets: DataFrame, s: Settings, buckets: int, found: Frequent | None, schema: str, turn: int = 0, turns: int = 1) -> DataFrame:
    """Per batch and bucket the prefix tokens: without ``found`` each once with its count, with it in that order and with
    their sets. Tokens that too many sets hold are dealt by token and set, to buckets above the others. Where one pass
    has too few buckets, each of several turns deals a share of all tokens."""
    per = s.slots // buckets
    shared = sets.sparkSession.sparkContext.broadcast(found) if found is not None else None  # slots / 8 bytes, and 8 per hot token
    names = schema.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(shared.value.bits, dtype=np.uint8) if shared is not None else None
        for batch in batches:
            for part in slices(batch, 2000, 4):
                chosen, owners, sizes = [], [], []
                for sid, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    t = unpack_tokens(data)
                    p = int(s.prefix(np.int64(t.size)))
                    if often is not None:
                        slot = (t & np.uint64(buckets - 1)).astype(np.int64) * per + _slot(_high(t), per)
                        late = (often[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
                        t = np.concatenate([t[~late], t[late]])
                        sizes.append(len(data) // TOKEN_BYTES)
                        owners.append(sid)
                    chosen.append(t[:p])
                if not chosen:
                    continue
                # places in 256ths of the prefix, rounded down
                place = np.concatenate([np.arange(c.size) * 256 // c.size for c in chosen]).astype(np.uint8)
                doc = np.repeat(np.arange(len(chosen)), [c.size for c in chosen])
                t = np.concatenate(chosen)
                if turns > 1:
                    mine = _turn(t, turns) == turn
                    t, doc, place = t[mine], doc[mine], place[mine]
                bucket, high = (t & np.uint64(buckets - 1)).astype(np.int64), _high(t)
                if often is None:
                    yield pa.RecordBatch.from_arrays(counted(bucket, high), names)
                    continue
                ids, ns = np.array(owners, dtype=np.int64), np.array(sizes, dtype=np.uint32)
                many = shared.value.holds(_ident(high, bucket))
                yield pa.RecordBatch.from_arrays(owned(bucket[~many], high[~many], doc[~many], place[~many], ids, ns), names)
                if many.any():
                    whole = _ident(high[many], bucket[many])
                    above = buckets + (mix(whole ^ ids[doc[many]].view(np.uint64)) & np.uint64(buckets - 1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(owned(above, whole, doc[many], place[many], ids, ns), names)

    def cut(values: np.ndarray, edges: np.ndarray) -> pa.Array:
        return pa.array([values[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())

    def counted(bucket: np.ndarray, high: np.ndarray) -> list[pa.Array]:
        """bucket, tokens met once, tokens met more often, and how often."""
        key, n = np.unique(bucket.astype(np.uint64) << np.uint64(32) | high, return_counts=True)
        own, once = (key >> np.uint64(32)).astype(np.int64), n == 1
        at = np.unique(own)
        edge = lambda x: np.append(np.searchsorted(x, at), x.size)
        more = edge(own[~once])
        return [pa.array(at.astype(np.int32)), cut(key[once].astype(np.uint32), edge(own[once])), cut(key[~once].astype(np.uint32), more), cut(n[~once].astype(np.uint32), more)]

    def owned(bucket: np.ndarray, token: np.ndarray, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, ns: np.ndarray) -> list[pa.Array]:
        """bucket, tokens set by set, how many each set has, the sets, their sizes, and the tokens' places."""
        order = np.argsort(bucket, kind="stable")
        b, d = bucket[order], doc[order]
        first = np.flatnonzero(_firsts(b, d))
        count = np.diff(np.append(first, b.size)).astype(np.uint32)
        at = np.unique(b)
        each, per_set = np.append(np.searchsorted(b, at), b.size), np.append(np.searchsorted(b[first], at), first.size)
        who = d[first]
        return [pa.array(at.astype(np.int32)), cut(token[order], each), cut(count, per_set), cut(ids[who], per_set), cut(ns[who], per_set), cut(place[order], each)]

    rows = sets.where("tokens is not null").select("sid", "tokens").mapInArrow(run, schema)
    return rows.repartitionById(buckets, F.col("bucket"))


def _by_bucket(batches: Iterator[pa.RecordBatch], columns: int) -> dict[int, list[list[bytes]]]:
    out: dict[int, list[list[bytes]]] = {}
    for batch in batches:
        lists = [batch.column(i).to_pylist() for i in range(1, columns)]
        for i, b in enumerate(batch.column(0).to_pylist()):
            held = out.setdefault(b, [[] for _ in lists])
            for h, values in zip(held, lists, strict=True):
                h.append(values[i])
    return out


@dataclass(frozen=True)
class Frequent:
    """A bitmap of frequent tokens, and those that too many sets hold for one task, ascending."""

    bits: bytes
    hot: np.ndarray

    def holds(self, ident: np.ndarray) -> np.ndarray:
        if not self.hot.size:
            return np.zeros(ident.size, dtype=bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, ident), self.hot.size - 1)] == ident


def frequent_tokens(sets: DataFrame, s: Settings, buckets: int, turns: int = 1) -> Frequent:
    """The bitmap of tokens that more than ``frequent`` prefixes hold: of each bucket the most frequent ones, until a
    quarter of its bits are set, so that the order means something however many tokens there are. And the tokens that
    more than ``hot`` prefixes hold."""
    per = s.slots // buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (once, more, counts) in _by_bucket(batches, 4).items():
            t = np.frombuffer(b"".join([*once, *more]), dtype=np.uint32)
            n = np.ones(t.size, dtype=np.int64)
            repeated = np.frombuffer(b"".join(counts), dtype=np.uint32)
            n[t.size - repeated.size :] = repeated
            if not t.size:
                continue
            order = np.argsort(t, kind="stable")
            first = np.flatnonzero(_firsts(t[order]))
            t, n = t[order][first], np.add.reduceat(n[order], first)
            hot = _ident(t[n > s.hot], np.full(int((n > s.hot).sum()), b))
            t, n = t[n > s.frequent], n[n > s.frequent]
            bits = np.zeros(per, dtype=bool)
            bits[_slot(t[np.argsort(-n, kind="stable")[: max(1, per // (4 * turns))]], per)] = True
            if bits.any() or hot.size:
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary()), pa.array([hot.tobytes()], pa.binary())], ["bucket", "bits", "hot"])

    out, hot = np.zeros(s.slots // 8, dtype=np.uint8), [np.zeros(0, dtype=np.uint64)]
    size = per // 8
    for turn in range(turns):
        dealt = _deal(sets, s, buckets, None, "bucket int, once binary, more binary, counts binary", turn, turns)
        for r in dealt.mapInArrow(run, "bucket int, bits binary, hot binary").collect():  # slots / 8 bytes in all, and one number for each ``hot`` tokens
            out[r.bucket * size : (r.bucket + 1) * size] |= np.frombuffer(r.bits, dtype=np.uint8)
            hot.append(np.frombuffer(r.hot, dtype=np.uint64))
    return Frequent(out.tobytes(), np.sort(np.concatenate(hot)))


RUNS = "run long, sid long, n long, most long, leader long, own boolean"


def shared_runs(sets: DataFrame, s: Settings, buckets: int, found: Frequent, turns: int = 1) -> DataFrame:
    """The token-group matrix's shared rows: the sets of one run, of a size class and the class below, with the greatest
    size of a partner and the smallest identity among them. Equal rows once."""
    names = [f.split()[0] for f in RUNS.split(", ")]

    def sorted_holders(tokens: list, counts: list, sids: list, sizes: list, places: list, kind: type) -> tuple:
        """token, set, size and greatest partner, each set once per token."""
        t = np.frombuffer(b"".join(tokens), dtype=kind)
        c = np.frombuffer(b"".join(counts), dtype=np.uint32)
        # a batch lists a bucket's tokens set by set, so the repeated owners line up with the tokens
        sid, n = (np.repeat(np.frombuffer(b"".join(x), dtype=k), c) for x, k in ((sids, np.int64), (sizes, np.uint32)))
        place = np.frombuffer(b"".join(places), dtype=np.uint8)
        order = np.lexsort((place, sid, t))
        t, sid, n, place = t[order], sid[order], n[order].astype(np.int64), place[order].astype(np.int64)
        new = _firsts(t, sid)
        t, sid, n, place = t[new], sid[new], n[new], place[new]
        return t, sid, n, s.most(n, place * s.prefix(n) >> 8)

    def by_class(name: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the runs of a set's own size class and, as the class below, of the next one."""
        size_class = np.floor(np.log(n) / np.log(s.denominator / s.numerator) + 1e-9).astype(np.int64)
        return tuple(mix(name + (size_class + k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in (0, 1))

    def batches_of(*columns: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for a in range(0, columns[0].size, 1 << 18):
            cut = [None if x is None else x[a : a + (1 << 18)] for x in columns]
            yield pa.RecordBatch.from_arrays([pa.nulls(cut[0].size, pa.int64()) if x is None else pa.array(x) for x in cut], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches, 6).items():
            if bucket >= buckets:  # a share of the sets that hold a hot token: what takes all of them comes later
                t, sid, n, most = sorted_holders(*held, np.uint64)
                own, above = by_class(mix(t), n)
                both = lambda x: np.concatenate([x, x])
                yield from batches_of(np.concatenate([own, above]).view(np.int64), both(sid), both(n), both(most), None, np.arange(2 * n.size) < n.size)
                continue
            t, sid, n, most = sorted_holders(*held, np.uint32)
            if not t.size:
                continue
            start = np.flatnonzero(_firsts(t))
            length = np.diff(np.append(start, t.size))
            name = np.repeat(np.add.reduceat(mix(sid.view(np.uint64)), start), length)
            # a set stays if some set of its run could be its partner by sizes
            fits = (np.repeat(np.minimum.reduceat(n, start), length) <= most) & (np.repeat(np.maximum.reduceat(most, start), length) >= n)
            two = np.flatnonzero(length == 2)
            i = start[two]
            fits[i] = fits[i + 1] = (n[i] <= most[i + 1]) & (n[i + 1] <= most[i])
            keep = fits & np.repeat(length > 1, length)
            sid, n, most, name = sid[keep], n[keep], most[keep], name[keep]
            if not sid.size:
                continue
            # equal runs once; then each size class with the class below, where the class itself has sets
            order = np.lexsort((-most, sid, name))
            sid, n, most, name = sid[order], n[order], most[order], name[order]
            new = _firsts(name, sid)
            sid, n, most, name = sid[new], n[new], most[new], name[new]
            own, above = by_class(name, n)
            extra = np.isin(above, own)
            sid, n, most = (np.concatenate([x, x[extra]]) for x in (sid, n, most))
            name = np.concatenate([own, above[extra]])
            order = np.lexsort((sid, name))
            sid, n, most, name = sid[order], n[order], most[order], name[order]
            first = np.flatnonzero(_firsts(name))
            length = np.diff(np.append(first, name.size))
            leader, keep = np.repeat(sid[first], length), np.repeat(length > 1, length)
            yield from batches_of(*(x[keep] for x in (name.view(np.int64), sid, n, most, leader)), np.ones(int(keep.sum()), dtype=bool))

    schema = "bucket int, tokens binary, counts binary, sids binary, sizes binary, places binary"
    made = [_deal(sets, s, buckets, found, schema, turn, turns).mapInArrow(run, RUNS) for turn in range(turns)]
    several = turns > 1 or found.hot.size > 0
    if several:
        made = [materialize(x, "turn") for x in made]  # one pass at a time
    rows = reduce(DataFrame.unionByName, made)
    if found.hot.size:
        open_ = rows.where("leader is null")
        led = materialize(open_.groupBy("run").agg(F.min("sid").alias("first"), F.count("*").alias("k"), F.max("own").alias("any")).where("k > 1 and any").select("run", "first"), "led")
        rows = rows.where("leader is not null").unionByName(open_.drop("leader").join(_few(led, s), "run").withColumnRenamed("first", "leader"))
    runs = materialize(rows.groupBy("run", "sid", "n", "leader").agg(F.max("most").alias("most")), "runs")
    if several:
        release(*made)
    return runs


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted row differs from the one before."""
    out = np.zeros(keys[0].size, dtype=bool)
    out[:1] = True
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


# ---------------------------------------------------------------- opening groups


def _with_tokens(rows: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Rows with a ``sid``, and its tokens. Each set's tokens are taken from one of the tasks that wrote them."""
    stored = sets.where("tokens is not null").select("sid", "task", "tokens")
    one = sets.where("tokens is not null").groupBy("sid").agg(F.min("task").alias("task"))
    rows = materialize(rows.join(one, "sid"), "asked")
    few = rows.count() <= s.few
    return stored.join(F.broadcast(rows) if few else rows, ["sid", "task"]).drop("task")


LINKS = "u long, v long"


def sketches(tokens: list[np.ndarray], cells: int) -> np.ndarray:
    """Parities of the tokens in each cell: two sketches differ in no more bits than their sets in tokens."""
    owner = np.repeat(np.arange(len(tokens)), [t.size for t in tokens])
    cell = (np.concatenate(tokens) % np.uint64(cells)).astype(np.int64)
    odd = np.bincount(owner * cells + cell, minlength=len(tokens) * cells).reshape(len(tokens), cells) & 1
    return np.packbits(odd.astype(bool), axis=1).view(np.uint64)


def resolve(sids: list[int], tokens: list[np.ndarray], s: Settings, asks: list[bool] | None = None, team: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect all linked sets of a part. With ``asks`` and ``team``, sets that ask query those that don't,
    and sets of one team count as connected."""
    order = sorted(range(len(sids)), key=lambda i: (tokens[i].size, sids[i]))
    n = np.array([tokens[i].size for i in order])
    sketch = sketches([tokens[i] for i in order], s.cells)
    root = np.arange(len(order)) if team is None else np.unique([team[i] for i in order], return_inverse=True)[1]
    role = None if asks is None else np.array([asks[i] for i in order])
    unions: dict[int, np.ndarray] = {}
    out = []
    for i in range(1 if role is None else 0, len(order)):
        if role is not None and not role[i]:
            continue
        low = int(np.searchsorted(n, -(-s.numerator * n[i] // s.denominator)))
        high = i if role is None else int(np.searchsorted(n, n[i] * s.denominator // s.numerator, side="right"))
        if low >= high:
            continue
        bits = np.bitwise_count(sketch[low:high] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        may = (bits <= s.apart(n[low:high], n[i])) & (root[low:high] != root[i])
        if role is not None:
            may &= ~role[low:high]
        found = low + np.flatnonzero(may)
        if not found.size:
            continue
        own = tokens[order[i]]
        found = found[np.argsort(bits[found - low], kind="stable")]  # the likest first
        closed: dict[int, np.ndarray | None] = {}
        for j in found.tolist():
            if root[j] == root[i]:
                continue
            k = j // s.block
            if k not in closed:
                if k not in unions:
                    unions[k] = np.unique(np.concatenate([tokens[x] for x in order[k * s.block : (k + 1) * s.block]]))
                inside = own[_within(own, unions[k])]
                closed[k] = inside if inside.size >= s.needed(n[i]) else None
            inside = closed[k]
            if inside is None:
                continue
            other = tokens[order[j]]
            if s.links(int(np.count_nonzero(_within(inside, other))), own.size, other.size):
                out.append((sids[order[i]], sids[order[j]]))
                root[root == root[j]] = root[i]
    return out


def open_groups(rows: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links among the sets of each part. ``rows``: gid, salt, sid, and asks and team (null within a group's own part)."""
    full = _with_tokens(rows, sets, s).select("gid", "salt", "sid", "tokens", "asks", "team")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [], [], [])

        def links() -> pa.RecordBatch | None:
            sids, tokens, asks, team = held
            found = resolve(sids, tokens, s) if asks[0] is None else resolve(sids, tokens, s, asks, team)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["u", "v"]) if found else None

        for part in (p for batch in batches for p in slices(batch, 2000, 4)):
            for gid, salt, sid, data, asks, team in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                if (gid, salt) != key:
                    if held[0] and (out := links()) is not None:
                        yield out
                    key, held = (gid, salt), ([], [], [], [])
                for column, value in zip(held, (sid, unpack_tokens(data), asks, team), strict=True):
                    column.append(value)
        if held[0] and (out := links()) is not None:
            yield out

    return full.repartition("gid", "salt").sortWithinPartitions("gid", "salt", "sid").mapInArrow(run, LINKS)


def _within(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a are in b; both sorted."""
    if not b.size:
        return np.zeros(a.size, dtype=bool)
    return b[np.minimum(np.searchsorted(b, a), b.size - 1)] == a


def set_links(sets: DataFrame, s: Settings) -> DataFrame:
    """Links between different sets that connect all linked sets: node, root of their components."""
    spark = sets.sparkSession
    total = sets.where("tokens is not null").agg(F.sum(F.col("n") - F.ceil(F.col("n") * s.numerator / s.denominator) + 1).alias("p")).first().p or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = max(16, partitions, int(total) // s.per_bucket)
    buckets = min(s.most_buckets, 1 << (least - 1).bit_length())
    turns = min(1 << 16, -(-int(total) // (buckets * s.per_bucket)) or 1)
    s = replace(s, slots=min(s.most_slots, max(s.slots, 8 * buckets, 1 << (int(total) // 16).bit_length())))
    runs = shared_runs(sets, s, buckets, frequent_tokens(sets, s, buckets, turns), turns)

    # groups: the leader and the sets of its runs, in parts of bounded size
    member = materialize(runs.where("sid <> leader").groupBy(F.col("leader").alias("gid"), "sid").agg(F.max("n").alias("n")), "members")
    # no part is larger than a task's even share of all members, so that the largest group is spread like the others
    s = replace(s, part_sets=min(s.part_sets, max(256, member.count() // partitions)))
    parts = F.ceil(F.greatest(F.count("*") / s.part_sets, F.sum("n") / s.part_tokens)).cast("int")
    salts = materialize(member.groupBy("gid").agg(parts.alias("salts")), "salts")
    placed = _dealt(member.select("gid", "sid"), salts, s)
    leaders = salts.select("gid", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("gid").alias("sid"), "salts")
    placed = materialize(placed.select("gid", "salt", "sid", "salts").unionByName(leaders), "parts")
    none = [F.lit(None).cast("boolean").alias("asks"), F.lit(None).cast("long").alias("team")]
    links = materialize(open_groups(placed.select("gid", "salt", "sid", *none), sets, s), "links")
    large = placed.where("salts > 1").select(F.col("gid").alias("leader"), "salt", "sid", "salts")
    if not large.isEmpty():
        more = materialize(_across_parts(runs, large, links, sets, s), "links")
        found = connected_components(links.unionByName(more))
        release(more)
    else:
        found = connected_components(links)
    release(runs, member, salts, placed, links)
    return found


def _dealt(rows: DataFrame, salts: DataFrame, s: Settings) -> DataFrame:
    """Rows of groups (``gid``) with the number of the group's parts and their own. Groups of several parts are few, one
    for each ``part_sets`` rows at most, so that the rows of a large group are not gathered to learn its number."""
    number = F.coalesce("salts", F.lit(1))
    numbered = rows.join(_few(salts.where("salts > 1"), s), "gid", "left").withColumn("salts", number)
    return numbered.withColumn("salt", F.pmod(F.xxhash64("sid"), F.col("salts")).cast("int"))


def _across_parts(runs: DataFrame, large: DataFrame, links: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links between sets in different parts of a group. In each part the sets of one class form blocks, and those that
    are alone in their class share one; sets query the blocks of other parts that hold sets of their runs and sizes.
    A set asks a part at most once per block, whatever the number of runs and of sets there."""
    teams = connected_components(links).withColumnsRenamed({"node": "sid", "root": "team"})
    member = large.where("sid <> leader").join(teams, "sid", "left").withColumn("team", F.coalesce("team", "sid"))
    member = member.withColumn("k", F.count("*").over(Window.partitionBy("leader", "salt", "team")))  # within one part
    alone = F.col("k") == 1
    block = F.when(alone, F.xxhash64("leader", "salt", F.lit("alone"))).otherwise(F.xxhash64("leader", "salt", "team", F.pmod(F.xxhash64("sid", F.lit("block")), F.ceil(F.col("k") / s.block))))
    member = materialize(member.withColumns({"block": block, "held": F.when(~alone, F.col("team"))}).drop("k"), "placed")
    rows = materialize(runs.join(member, ["leader", "sid"]), "placed_runs")
    # a set whose place is late for its own size is found by asking only
    target = rows.where("most >= n").groupBy("leader", "run", "salt", "salts", "held", "block").agg(F.min("n").alias("low"), F.max("most").alias("most"))
    # one row per part that may ask, so that a run is joined part by part
    target = target.withColumn("asker", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).where("asker <> salt")
    q, g = rows.alias("q"), target.alias("g")
    fits = (F.col("q.n") <= F.col("g.most")) & (F.col("g.low") <= F.col("q.most"))
    once = (F.col("q.most") < F.col("q.n")) | (F.col("q.salt") < F.col("g.salt"))
    on = (F.col("q.leader") == F.col("g.leader")) & (F.col("q.run") == F.col("g.run")) & (F.col("q.salt") == F.col("g.asker")) & ~F.col("q.team").eqNullSafe(F.col("g.held")) & once & fits
    asked = materialize(q.join(g, on).select(F.col("g.block").alias("gid"), F.col("q.sid").alias("sid"), F.col("q.team").alias("team")).distinct(), "queries")
    salts = materialize(asked.groupBy("gid").agg(F.ceil(F.count("*") / s.part_sets).cast("int").alias("salts")), "salts")
    held = member.select(F.col("block").alias("gid"), "sid", "team").join(salts, "gid")
    held = held.select("gid", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "sid", F.lit(False).alias("asks"), "team")
    asking = _dealt(asked, salts, s).select("gid", "salt", "sid", F.lit(True).alias("asks"), "team")
    return open_groups(held.unionByName(asking), sets, s)


def classes(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Per row: doc_id, key (hash of the text), n_shingles, root (names the class, null without words) and component_id."""
    s = settings or Settings()
    sets = write_sets(docs, s)
    roots = set_links(sets, s)
    own = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    # only sets that several rows have, or that link with another one, need to be looked up
    linked = own.join(roots.withColumnRenamed("node", "sid"), "sid")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")), "class_ids")
    linked = linked.join(_few(least, s), "root").select("sid", "root", "component_id")
    shared = own.join(linked, "sid", "left").where("rows > 1 or root is not null")
    shared = materialize(shared.select("sid", F.coalesce("root", "sid").alias("root"), F.coalesce("component_id", "least").alias("component_id")), "shared_sets")
    rows = sets.select("doc_id", "key", "sid", F.col("n").alias("n_shingles")).join(_few(shared, s), "sid", "left")
    return rows.select("doc_id", "key", "n_shingles", F.coalesce("root", "sid").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _few(rows: DataFrame, s: Settings) -> DataFrame:
    """Narrow rows, to be broadcast where there are at most ``few``."""
    return F.broadcast(rows) if rows.limit(s.few + 1).count() <= s.few else rows


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the class) per document."""
    return classes(docs, settings).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row of each class stays: that with the smallest id (null ids last), then the smallest hash of its text, then
    the first as JSON. Rows are told apart by id and text: other texts of an id that goes stay, if they are of other
    classes. Rows without words are in no class and all stay."""
    s = settings or Settings()
    rows = materialize(classes(docs, s).where("root is not null").groupBy("root", "doc_id", "key").agg(F.count("*").alias("n")), "classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")
    best = rows.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("rows"))
    several = materialize(best.where("rows > 1"), "several")
    gone = rows.join(_few(several, s), "root").where(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key")))).select("doc_id", "key")
    gone = materialize(gone, "gone")
    own = "_key"
    while own in docs.columns:
        own += "_"

    def same(other: str) -> Column:
        return F.col("d.doc_id").cast("long").eqNullSafe(F.col(f"{other}.doc_id")) & (F.col(f"d.{own}") == F.col(f"{other}.key"))

    keyed = docs.withColumn(own, text_key()).alias("d")
    kept = keyed.join(_few(gone, s).alias("g"), same("g"), "left_anti")
    repeated = best.where("best.n > 1").select(F.col("best.doc_id").alias("doc_id"), F.col("best.key").alias("key"))
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    repeated = materialize(repeated, "repeated").alias("r")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = kept.alias("d").join(repeated, same("r"), "left_semi").groupBy("doc_id", own).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return kept.alias("d").join(repeated, same("r"), "left_anti").select(*docs.columns).unionByName(first)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM w),
t AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS k FROM t a JOIN t b ON a.s = b.s AND a.doc_id <> b.doc_id AND a.n * 4 <= b.n * 5 AND b.n * 4 <= a.n * 5 GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM c WHERE 100 * k >= 80 * (nu + nv - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.v FROM r JOIN l ON l.u = r.b)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM g JOIN r ON r.a = g.doc_id GROUP BY ALL
"""
