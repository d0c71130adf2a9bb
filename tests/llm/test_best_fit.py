"""Best-fit packing: ids against the library, plans against enumeration, pieces against texts."""

import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from weftline.llm import best_fit


@pytest.fixture(scope="module")
def encoder():
    return best_fit.WordEncoder()


def whole(encoder, text):
    return encoder.whole.encode(text, add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts(encoder, spark):
    chars = [chr(c) for c in range(0x250) if not best_fit._UNUSUAL.search(chr(c))]
    for c in chars:
        for text in (c, f"a{c}", f"{c}a", f"1{c}", f".{c}'", f"{c}'s", f"'{c}", c + c):
            assert encoder.ids(text).tolist() == whole(encoder, text), text
    rng = random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice(chars if rng.random() < 0.4 else "abdelmrstv'EST019 .,-\n\t") for _ in range(rng.randint(0, 50)))
        assert encoder.ids(text).tolist() == whole(encoder, text), text
    for text in ["", " \n", "<|endoftext|>x", "中文 é̂ İ", "x" * 5000, "It'S we'LL 12a"]:
        assert encoder.ids(text).tolist() == whole(encoder, text)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("text is not null").collect():
        assert encoder.ids(r.text).tolist() == whole(encoder, r.text)


def test_a_small_memory_changes_nothing(encoder):
    few = best_fit.WordEncoder(most=2)
    text = "one two three, one two! four's one"
    assert few.ids(text).tolist() == encoder.ids(text).tolist() and len(few) <= 2


def held(counts, size):
    """Checks that a plan is whole, and returns the lengths in each sequence."""
    flows, n = best_fit.plan(counts, size)
    bins = defaultdict(list)
    for f in flows:
        for i in range(f.n):
            bins[f.sequence + i].append((f.offset, f.length))
    assert set(bins) == set(range(n))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    for k, c in counts.items():
        at = 0
        for first, m in sorted((f.first, f.n) for f in flows if f.length == k):
            assert first == at
            at += m
        assert at == c
    return [sorted((x for _, x in p), reverse=True) for p in bins.values()]


def test_plans_are_whole():
    rng = random.Random(3)
    for _ in range(400):
        size = rng.randint(3, 40)
        held({rng.randint(1, size): rng.randint(0, 6) for _ in range(rng.randint(0, 9))}, size)


def test_large_pieces_need_the_least_number_of_sequences():
    @lru_cache(None)
    def least(items, size):
        if not items:
            return 0
        x, rest = items[-1], items[:-1]
        return min([1 + least(rest, size), *(1 + least(rest[:i] + rest[i + 1 :], size) for i in range(len(rest)) if rest[i] + x <= size)])

    rng = random.Random(4)
    for _ in range(300):
        size = rng.randint(6, 30)
        items = tuple(sorted(rng.randint(size // 3 + 1, size) for _ in range(rng.randint(1, 8))))
        assert len(held(Counter(items), size)) == least(items, size), (items, size)


def test_small_pieces_go_where_one_by_one_best_fit_puts_them():
    rng = random.Random(6)
    for _ in range(300):
        size = rng.randint(9, 60)
        counts = {rng.randint(1, size): rng.randint(1, 7) for _ in range(8)}
        large = held({k: n for k, n in counts.items() if 3 * k > size}, size)
        rooms = [size - sum(p) for p in large]
        for k in sorted((k for k in counts if 3 * k <= size), reverse=True):
            for _ in range(counts[k]):
                fits = [r for r in rooms if r >= k]
                if fits:
                    rooms.remove(min(fits))
                rooms.append((min(fits) if fits else size) - k)
        assert Counter(size - sum(p) for p in held(counts, size)) == Counter(rooms)


def test_a_plan_does_not_grow_with_the_documents():
    rng = random.Random(8)
    counts = Counter(min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(20_000))
    small, large = (best_fit.plan({k: n * m for k, n in counts.items()})[0] for m in (10, 10_000_000))
    assert len(large) < 3 * len(small) < 60_000


def checked(encoder, docs, size=2048):
    """Pieces of the operator, held against the texts."""
    rows = best_fit.pack(docs, size=size).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.append(np.array(whole(encoder, r.text or ""), dtype="<u4"), np.uint32(0)).astype("<u4")
        for n, s in enumerate(range(0, len(ids), size)):
            want[(r.doc_id, n, s, len(ids[s : s + size]), zlib.crc32(ids[s : s + size].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= size
    return rows, bins


def test_odd_documents(spark, encoder, odd_docs, no_docs, clashing):
    rows, bins = checked(encoder, odd_docs.repartition(4))
    assert sum(r.length == 1 for r in rows) >= 2  # null and empty text
    docs = clashing(odd_docs).selectExpr("*", "'x' as part", "'y' as nth", "'z' as length")
    assert Counter(r.ids_crc32 for r in best_fit.pack(docs).collect()) == Counter(r.ids_crc32 for r in rows)
    assert best_fit.pack(no_docs).count() == 0


def test_one_id_and_one_text_on_all_rows(spark, encoder):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'the same few words in every row' as text").repartition(6)
    rows, bins = checked(encoder, docs)
    each = 2048 // rows[0].length
    assert len(bins) == -(-3000 // each)


def test_few_sequences_over_a_whole_table(spark, encoder):
    rows, bins = checked(encoder, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert re.fullmatch("doc_id,piece,start,length,ids_crc32,sequence_id,offset", ",".join(best_fit.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).columns))
