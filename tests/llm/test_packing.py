import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import packing


def cost(at, penalty, cuts, size):
    total, before = 0.0, 0
    for c in cuts:
        if c - before > size:
            return float("inf")
        total += size - (c - before) + penalty[at.index(c)]
        before = c
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 8), st.sampled_from([0.0, 1.0, 3.0])), min_size=1, max_size=9))
def test_plan_is_least_cost(steps):
    at, penalty = np.cumsum([s for s, _ in steps]).tolist(), [p for _, p in steps]
    best = min(cost(at, penalty, [*c, at[-1]], 8) for k in range(len(at)) for c in combinations(at[:-1], k))
    assert cost(at, penalty, packing.plan_cuts(at, penalty, 8), 8) == best


def test_rest_is_split_into_powers_of_two_where_that_is_cheaper():
    assert packing.split_rest(2048, 2048, 8) == [2048]
    assert packing.split_rest(2047, 2048, 8) == [2047]
    assert packing.split_rest(1300, 2048, 8) == [1024, 256, 16, 4]
    assert packing.split_rest(0, 2048, 8) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 8), min_size=1, max_size=9), st.booleans())
def test_open_end_is_least_cost(steps, final):
    at = np.cumsum(steps).tolist()
    penalty = [1.0] * len(at)
    rest = (lambda n: packing.rest_cost(n, 8, 2.0)) if final else (lambda n: 0.0)
    found = packing.plan_cuts(at, penalty, 8, rest)

    def total(cuts):
        left = at[-1] - (cuts[-1] if cuts else 0)
        return cost(at, penalty, cuts, 8) + rest(left) if left <= 8 else float("inf")

    assert total(found) == min(total(list(c)) for k in range(len(at) + 1) for c in combinations(at, k))


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder()


@pytest.mark.parametrize("text", ["", "Hello, world.\nNext line!", "ünïcödé 中文 🙂", "<|endoftext|>", "tabs\tand\u0085odd spaces x  ", "don't I'LL 12 345", "a" * 3000, "é" * 1000 + " ¡ñ!"])
def test_ids_equal_those_of_tokenizers(encoder, text):
    assert encoder.ids(text).tolist() == encoder.slow.encode(text, add_special_tokens=False).ids


def check(rows, texts, encoder, size=2048):
    """Each id in exactly one piece, pieces gapless in sequences."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for key, pieces in by_doc.items():
        ids = np.append(encoder.ids(texts[key] or ""), np.uint32(1)).astype("<u4")
        copies = sum(p.length for p in pieces) // len(ids)
        at = sorted((p.start, p.length, p.ids_crc32) for p in pieces)
        assert sum(p.length for p in pieces) == copies * len(ids)
        for start, length, crc in at:
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
        assert {p.doc_tokens for p in pieces} == {len(ids)}
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert pieces[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(pieces, pieces[1:], strict=False))
        assert sum(p.length for p in pieces) == pieces[0].sequence_tokens <= size


def test_pack_odd_documents(odd_docs, clashing, encoder):
    rows = packing.pack(clashing(odd_docs)).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    check(rows, texts, encoder)
    assert {r.doc_id for r in rows} == set(texts)
    assert [r.length for r in rows if r.doc_id in (4, 5)] == [1, 1]


def test_blocks_and_padding(spark, encoder):
    docs = spark.createDataFrame([(i, f"Sentence number {i} is here. " * (1 + i * 7 % 40)) for i in range(400)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, block=5000).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()}, encoder)
    lengths = {r.sequence_id: r.sequence_tokens for r in rows}.values()
    padding = sum(2048 - n for n in lengths if n & (n - 1))
    assert padding < 0.02 * sum(lengths)


def test_empty_table(no_docs):
    assert packing.pack(no_docs).count() == 0
