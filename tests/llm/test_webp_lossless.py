import base64

import naive_webp
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import media
from weftline.llm import webp_lossless as w

OPTIONS = [
    {}, {"cache_bits": 4}, {"references": False}, {"subtract_green": True}, {"cross": (13, -7, 100)}, {"groups": 3}, {"groups": 2, "cache_bits": 3, "subtract_green": True, "cross": (1, 2, 3), "predictor": 11}, *({"predictor": m} for m in range(14)),
]


@pytest.mark.parametrize("options", OPTIONS, ids=str)
@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (20, 33)])
def test_each_part_of_the_format_round_trips(options, shape):
    rng = np.random.RandomState(3)
    for top in (3, 200):
        px = rng.randint(0, top, size=shape).astype(np.uint32) * np.uint32(0x01010203) + np.uint32(0x7F000000)
        assert (w.decode(w.encode(px, **options)) == px).all()


@pytest.mark.parametrize("options", [*OPTIONS, {"palette": True}, {"palette": True, "predictor": 1, "cache_bits": 2}, {"tile_bits": 2, "predictor": 13, "cross": (-3, 5, -100)}], ids=str)
def test_a_decoder_of_its_own_reads_the_same(options):
    rng = np.random.RandomState(9)
    few = rng.randint(0, 2**32, size=11, dtype=np.uint64).astype(np.uint32)
    for px in (few[rng.randint(0, 11, size=(9, 13))], few[rng.randint(0, 2, size=(6, 21))]):
        data = w.encode(px, **options)
        assert naive_webp.decode(data, w.NEIGHBOURS) == px.tolist() == w.decode(data).tolist()


def test_a_file_of_another_encoder():
    """The one-pixel file that is widely used to find out whether a browser reads lossless WebP."""
    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert w.decode(data).shape == (1, 1) and w.decode(data).tolist() == naive_webp.decode(data, w.NEIGHBOURS)


def test_short_distances_are_ordered_by_nearness():
    far = [x * x + y * y for x, y in w.NEIGHBOURS]
    assert len(set(w.NEIGHBOURS)) == 120 and far == sorted(far) and all(y > 0 or x > 0 for x, y in w.NEIGHBOURS)


@pytest.mark.parametrize("text", ["a plain text, " * 40, "ab" * 300, "".join(map(chr, range(32, 127))) * 9, "\n".join(f"line {i % 7} that is met again and again" for i in range(40)), "x", "é漢🙂" * 50])
def test_stored_payloads_are_read_by_a_decoder_of_its_own(text):
    payload = media.padded(text.encode())
    rows = [row for f in media.files_of(media.store(payload)) for row in naive_webp.decode(f, w.NEIGHBOURS)]
    assert bytes(p >> 8 & 255 for row in rows for p in row) == payload == media.samples_of(media.store(payload))


def recurring(n, seed=4):
    """Text of groups of four bytes, of which few hundred recur, but no line does."""
    rng = np.random.RandomState(seed)
    groups = rng.randint(32, 127, size=(300, 4)).astype(np.uint8)
    return groups[rng.randint(0, 300, size=n // 4) ** 2 // 300].tobytes()


def test_payloads_of_recurring_groups_take_a_colour_cache():
    payload = media.padded(recurring(20_000))
    stored = media.store(payload)
    assert len(stored) < len(w.encode_grey(payload, 64)) * 15 / 16 and media.samples_of(stored) == payload
    (pixels,) = media.pixels_of(stored)
    assert pixels.shape == (len(payload) // 64, 16) and naive_webp.decode(stored, w.NEIGHBOURS) == pixels.tolist()
    short = media.padded(recurring(2000))
    assert media.store(short) == w.encode_grey(short, 64)


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_pixels_are_read_across_chunks(chunk, monkeypatch):
    whole = w._read_pixels
    read = []
    monkeypatch.setattr(w, "_read_pixels", lambda r, n, codes, bits: read.append(whole(r, n, codes, bits, chunk)) or read[-1])
    payload = media.padded(recurring(5000, 8))
    px = w.decode(w.encode_cached(payload, 16))
    assert px.astype("<u4").tobytes() == payload and read[-1] is not None
    mixed = np.random.RandomState(1).randint(0, 2**32, size=(9, 16), dtype=np.uint64).astype(np.uint32)
    for options in ({"references": False}, {"references": False, "cache_bits": 3}, {"predictor": 5, "cache_bits": 2}):
        assert (w.decode(w.encode(mixed, **options)) == mixed).all() and read[-1] is not None


def test_pixels_with_references_are_read_symbol_by_symbol():
    px = np.tile(np.random.RandomState(5).randint(0, 2**32, size=(3, 16), dtype=np.uint64).astype(np.uint32), (4, 1))
    for bits in (0, 4):
        assert (w.decode(w.encode(px, cache_bits=bits)) == px).all()


def test_cut_files_of_pixels_raise():
    stored = w.encode_cached(media.padded(recurring(5000)), 16)
    body = stored[20 : 20 + len(stored) // 2]
    with pytest.raises(ValueError):
        w.decode(b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=4, max_size=900) | st.text(alphabet="ab", min_size=4, max_size=600).map(str.encode), st.integers(1, 11))
def test_cached_pixels_round_trip(data, bits):
    payload = media.padded(data)
    stored = w.encode_cached(payload, 16, cache_bits=bits)
    assert w.decode(stored).astype("<u4").tobytes() == payload
    assert naive_webp.decode(stored, w.NEIGHBOURS) == w.decode(stored).tolist()


@pytest.mark.parametrize("mode", [1, 2])
def test_payloads_of_gradients_are_predicted(mode):
    steps = np.random.RandomState(2).randint(0, 3, size=(40, 64)).astype(np.uint8)
    rows = np.cumsum(steps, axis=2 - mode, dtype=np.uint8)
    payload = rows.tobytes()
    stored = media.store(payload)
    plain = len(payload) * 7 // 8
    assert len(stored) < plain / 2 and media.samples_of(stored) == payload
    assert bytes(p >> 8 & 255 for row in naive_webp.decode(stored, w.NEIGHBOURS) for p in row) == payload
    assert (media.pixels_of(stored)[0] >> 24 == 255).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes_pack_samples(colours):
    rng = np.random.RandomState(colours)
    table = rng.randint(0, 2**32, size=colours, dtype=np.uint64).astype(np.uint32)
    px = table[rng.randint(0, colours, size=(9, 21))]
    for options in ({}, {"predictor": 2}, {"cache_bits": 2}):
        assert (w.decode(w.encode(px, palette=True, **options)) == px).all()


def test_hand_made_file():
    """One red pixel, written bit by bit: no transform, no cache, one group, five codes of one symbol each."""
    out = w._Writer()
    for value, n in ((0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        out.put(value, n)
    for symbol in (0, 255, 0, 255, 0):
        out.put(1, 1)  # simple code
        out.put(0, 1)  # one symbol
        out.put(1, 1)  # of eight bits
        out.put(symbol, 8)
    assert w.decode(w._riff(out)).tolist() == [[0xFFFF0000]]


def test_damaged_files_raise():
    good = w.encode(np.arange(64, dtype=np.uint32).reshape(8, 8))
    with pytest.raises(ValueError):
        w.decode(b"RIFF" + good[4:20] + b"\0" + good[21:])
    with pytest.raises(ValueError):
        w.decode(good[: len(good) // 2])


def test_code_lengths_are_limited_and_complete():
    counts = {i: 2**i for i in range(25)}
    for limit in (12, 15):
        lengths = w.code_lengths(counts, limit)
        assert max(lengths.values()) <= limit and sum(2.0**-n for n in lengths.values()) == 1


@settings(max_examples=120, deadline=None)
@given(st.binary(max_size=700) | st.text(alphabet="ab \n", max_size=400).map(str.encode) | st.lists(st.sampled_from([b"a long line that is met again and again", b"x", b"another line of some length, too"]), max_size=30).map(b"\n".join))
def test_payloads_round_trip(data):
    payload = media.padded(data)
    stored = media.store(payload)
    assert media.samples_of(stored) == payload and stored[:4] == b"RIFF"


def test_long_payloads_take_several_images_and_long_references():
    data = media.padded(b"\n".join([b"y" * 9000 + b"end", *[bytes(range(32, 127)) * 200] * 90]))
    assert len(media.files_of(media.store(data))) == 2
    assert media.samples_of(media.store(data)) == data


def test_odd_documents(odd_docs, no_docs, clashing):
    rows = {r.doc_id: r for r in media.read_features(media.with_media(clashing(odd_docs))).collect()}
    assert rows[4].payload_bytes == rows[5].payload_bytes == 64 and rows[4].payload_sha256 == rows[5].payload_sha256 and rows[4].n_bytes == 0
    assert rows[1].media_sha256 == rows[2].media_sha256 and rows[1].feature == rows[2].feature
    assert media.read_features(media.with_media(no_docs)).count() == 0


@pytest.mark.parametrize("text", ["", "x", "a plain text, " * 40, "ab" * 300, "é漢🙂" * 50, "\n".join(f"line {i % 7} that is met again and again" for i in range(40))])
def test_small_payloads_weigh_pixels_where_asked(text):
    payload = media.padded(text.encode())
    stored = media.store(payload, 0)
    grey = w.encode_grey(payload, 64)
    assert media.samples_of(stored) == payload
    assert stored == grey or len(stored) < len(grey)
    rows = naive_webp.decode(stored, w.NEIGHBOURS)
    read = bytes(p >> k & 255 for row in rows for p in row for k in (0, 8, 16, 24)) if len(rows[0]) == 16 else bytes(p >> 8 & 255 for row in rows for p in row)
    assert read == payload


def test_the_media_column_weighs_payloads_of_every_size(spark):
    texts = ["", "x", recurring(2000).decode(), recurring(9000).decode()]
    rows = media.with_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: bytes(r.media) for r in rows} == {i: media.store(media.padded(t.encode()), 0) for i, t in enumerate(texts)}
