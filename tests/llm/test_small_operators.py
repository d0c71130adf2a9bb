"""License scans, fingerprints, chat formatting, WARC, mixing: brute force, round trips, odd tables."""

import hashlib
import random
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import chat_format as chat
from weftline.llm import fingerprint as fp
from weftline.llm import license_scan as lic
from weftline.llm import mixing, warc

# ---------------------------------------------------------------- licences


def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = [(i, label) for phrase, label in lic.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


TOKENS = st.sampled_from(["GNU", "general", "Public", "license", "apache", "cc", "by", "mit", "é", "x", ".", "\n", "Licensed", "under", "the", "version", "2", "0", "permission", "is", "hereby", "granted"])


@settings(max_examples=300, deadline=None)
@given(st.lists(TOKENS, max_size=40).map(" ".join))
def test_places_equal_brute_force(text):
    found = SCANNER.scan(text.encode())
    assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == brute_places(text)
    assert set(filter(None, found["base_labels"].split(","))) <= set(filter(None, found["labels"].split(","))) and 0 <= found["score"] <= 1


SCANNER = lic.LicenseScanner()


def test_matching_statistics_are_longest_matches():
    rng = random.Random(2)
    sequences = [[rng.choice("abc") for _ in range(12)] for _ in range(3)]
    auto = lic.SuffixAutomaton()
    for i, s in enumerate(sequences):
        auto.add(i, s)
    auto.finish()
    text = [rng.choice("abc") for _ in range(200)]
    state = size = 0
    for i, token in enumerate(text):
        state, size = auto.walk(state, size, token)
        joined = ["".join(s) for s in sequences]
        best = max(n for n in range(i + 2) if any("".join(text[i + 1 - n : i + 1]) in j for j in joined))
        assert size == best
        ends = {(k, p) for k, j in enumerate(joined) for p in range(len(j)) if size and j[: p + 1].endswith("".join(text[i + 1 - size : i + 1]))}
        assert auto.ends[state] == ends or not size


def test_templates_give_labels_of_their_own():
    text = "Header. " + lic.TEMPLATES["mit"][0].replace("copy", "kopy") + " And more. " + lic.TEMPLATES["bsd"][0]
    found = SCANNER.scan(text.encode())
    assert found["labels"] == "bsd,mit" and found["base_labels"] == "" and found["n_base"] == 0 and found["score"] > 0.8
    assert {x["label"] for x in found["spans"]} >= {"mit", "bsd"}
    assert SCANNER.scan(b"permission is hereby")["labels"] == ""


def test_each_copy_of_a_header_is_a_span():
    head, between = lic.TEMPLATES["apache"][0], " ".join(["code"] * 40)
    size = len(lic.words_of(head.encode()))
    for gap in (between, "", "x y"):
        step = size + len(gap.split())
        spans = [s for s in SCANNER.scan(f" {gap} ".join([head] * 3).encode())["spans"] if s["label"] == "apache"]
        assert [(s["start"], s["end"], s["coverage"]) for s in spans] == [(i * step, i * step + size, 1.0) for i in range(3)]
    # a worse copy stays beside a better one
    cut = " ".join(head.split()[:12])
    spans = [s for s in SCANNER.scan(f"{cut} {between} {head}".encode())["spans"] if s["label"] == "apache"]
    assert len(spans) == 2 and spans[0]["coverage"] < spans[1]["coverage"] == 1
    many = SCANNER.scan(" ".join([head] * 3000).encode())["spans"]
    assert len([s for s in many if s["label"] == "apache" and s["coverage"] == 1]) == 3000


@pytest.mark.parametrize("label", sorted(lic.TEMPLATES))
def test_each_licence_is_told_from_those_that_share_its_wording(label):
    for text in lic.TEMPLATES[label]:
        found = SCANNER.scan(f"# Copyright 2020 someone {text} end of file".encode())
        assert label in found["labels"].split(",") and set(found["labels"].split(",")) - {label} <= set(found["base_labels"].split(","))
        assert any(s["label"] == label and s["coverage"] == 1 and (s["start"], s["end"]) == (3, 3 + len(lic.words_of(text.encode()))) for s in found["spans"])


def test_bodies_without_their_opening_are_found():
    texts = lic.TEMPLATES
    mit = " ".join(texts["mit"][1].split()[25:])
    assert SCANNER.scan(mit.encode())["labels"] == "mit"
    assert SCANNER.scan(" ".join(texts["bsd"][1:]).encode())["labels"] == "bsd"
    three = " ".join([*texts["bsd"][:2], *texts["bsd-3-clause"], texts["bsd"][2]])
    assert SCANNER.scan(three.encode())["labels"] == "bsd,bsd-3-clause"
    # the warranty alone is shared by licences, so that it tells none
    assert SCANNER.scan(" ".join(texts["mit"][1].split()[88:130]).encode())["labels"] == ""


def test_license_scan_odd_documents(odd_docs, no_docs, clashing):
    rows = lic.scan_licenses(clashing(odd_docs)).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_places(texts[r.doc_id])
    assert len(rows) == odd_docs.count() and lic.scan_licenses(no_docs).count() == 0


# ---------------------------------------------------------------- fingerprints


def test_counts_equal_brute_force():
    data = bytes(random.Random(4).randrange(256) for _ in range(97))
    t = fp._PAIRS
    counts = [0] * fp.BUCKETS
    for table, (_, i, j) in zip(t, fp.TRIPLETS, strict=True):
        for k in range(len(data) - j):
            counts[int(fp._LAST[int(table[data[k] << 8 | data[k + i]]) ^ data[k + j]])] += 1
    assert fp.bucket_counts(data).tolist() == counts
    assert fp.bucket_counts(b"ab").sum() == 0 and fp.bucket_counts(b"abc").sum() == 1


def test_difference_is_bounded_and_symmetric():
    a, b = fp.fingerprint(b"hello world, hello again" * 9), fp.fingerprint(bytes(range(256)) * 3)
    assert fp.difference(a, a) == 0 and fp.likeness(a, a) == 1 and fp.difference(a, b) == fp.difference(b, a) and 0 <= fp.likeness(a, b) < 1


def brute_pairs(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1] or ""))
    out = []
    for i, (key, text, _) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = (fp.fingerprint(x.encode()) for x in (text, edited, following))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


def with_hashes(docs):
    """Rows and the hash that orders rows with equal ids."""
    return [tuple(r) for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, ''))").collect()]


def pairs(docs, *options):
    return sorted((tuple(r) for r in fp.edited_pairs(docs, *options).collect()), key=str)


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_edited_pairs_equal_brute_force(odd_docs, clashing, size):
    assert pairs(clashing(odd_docs), size) == brute_pairs(with_hashes(odd_docs))


def test_edited_pairs_of_many_ranges(spark):
    rows = [(i * 37 % 1009 * 10**12, "é" * (i % 7) + f"text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert pairs(docs, 20) == brute_pairs(with_hashes(docs)) == pairs(docs, 20, 3)


def test_edited_pairs_keep_every_row_of_large_null_and_repeated_ids(spark):
    top, least = (1 << 63) - 1, -(1 << 63)
    rows = [((1 << 60) + i, f"large {i}") for i in range(40)] + [(None, "no id")] + [(top, "top"), (least, "least"), (0, "zero"), (-1, "minus")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (1, 4, 50):
        assert pairs(docs, size) == brute_pairs(with_hashes(docs))
    # a third of all rows has one id, a third none, and many rows are the same
    rows += [((1 << 60) + 7, f"hot {i % 60}") for i in range(90)] + [(None, f"none {i % 50}") for i in range(90)] + [(least, f"last {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (3, 10):
        assert pairs(docs, size) == brute_pairs(with_hashes(docs))
    assert fp._ranges(docs.selectExpr("doc_id", "xxhash64(text) as h"), len(rows), 10).count > 25


def test_edited_pairs_small_tables(spark, no_docs):
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert pairs(one) == brute_pairs(with_hashes(one))
    nothing = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert pairs(nothing, 1) == brute_pairs(with_hashes(nothing))
    assert fp.edited_pairs(no_docs).count() == 0


# ---------------------------------------------------------------- chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "|", ">", "\\", "s", "/", "[INST]", "</s>", "<|end|>", "\n", "<<SYS>>", "é"]), max_size=12).map("".join))
def test_escapes_are_reversible(text):
    escaped = chat.escape(text)
    assert not any(c in escaped for c in chat.CONTROL) and chat.unescape(escaped) == text
    formatted, _ = chat.format_turn(text, [{"type": "text", "text": text}])
    ((role, parts),) = chat.parse_turns(formatted)
    assert role == text and "".join(p["text"] for p in parts) == text


def test_parts_become_placeholders():
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b.wav", "seconds": 2}, {"type": "text", "text": "<|image:0|>"}, {"type": "document", "ref": "c.pdf", "pages": 3}]
    formatted, attached = chat.format_turn("user", parts)
    assert [(a["kind"], a["ref"], a["position"], a["tokens"]) for a in attached] == [("image", "a.png", 0, 4), ("audio", "b.wav", 1, 50), ("document", "c.pdf", 2, 1536)]
    ((_, back),) = chat.parse_turns(formatted)
    assert [p.get("text", p.get("position")) for p in back] == ["see ", 0, 1, "<|image:0|>", 2]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])
    with pytest.raises(ValueError):
        list(chat.parse_turns(formatted + "x"))


def test_format_turns_columns(spark):
    typed = spark.createDataFrame([(1, "user", [("image", None, "x", 14, 14)]), (2, "user", None)], "conv_id long, role string, parts array<struct<type: string, text: string, ref: string, width: int, height: int>>")
    rows = {r.conv_id: r for r in chat.format_turns(typed).collect()}
    assert rows[1].n_placeholder_tokens == 1 and rows[1].attachments[0].ref == "x" and rows[2].attachments == []
    plain = spark.createDataFrame([(1, 0, "a", "hi", "clash")], "conv_id long, turn int, role string, text string, formatted string")
    assert chat.format_turns(plain).first().formatted == "<|turn|>a<|text|>hi<|end|>\n"


def test_conversations_digest(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, "assistant", None), (2, 0, "assistant", None), (None, 0, "user", "x"), (3, None, "assistant", "first"), (3, 0, "assistant", "é\\"), (4, 0, None, "")]
    got = {r.conv_id: r for r in chat.digest_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\na\nassistant\nb</s>\n") and got[1].loss_sha256 == sha("b</s>") and (got[1].n_turns, got[1].loss_chars) == (2, 5)
    assert got[2].n_turns == 2 and got[2].loss_chars == 0 and got[3].loss_sha256 == sha("firsté\\") and got[4].turns_sha256 == sha("\n\n") and got[None].n_turns == 1
    assert chat.digest_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def brute_digest(turns):
    """Digests of one conversation's (role, text), and what it must format to."""
    formatted = "".join(chat.format_turn(r, [{"type": "text", "text": t}])[0] for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(loss), sha(loss), len(formatted))


@pytest.mark.parametrize("chunk", [1, 60, 4_000_000])
def test_masked_text_is_read_back_from_stored_conversations(spark, chunk):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    words = ["assistant", "<|turn|>", "<|end|>\n", "\\", "é🙂", "</s>", "<|image:0|>", "plain text", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "assistant\\", "<|text|>"]), None if rng.random() < 0.1 else " ".join(rng.choices(words, k=rng.randrange(6)))) for c in (1, 2, 3, None) for t in range(25)]
    rows += [(4, 0, "user", "x"), (4, 1, "assistant", "very long </s> " * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("start", "formatted", "loss", "chunk", "last", "_order")})
    got = {r.conv_id: tuple(r)[1:] for r in chat.digest_conversations(turns, chunk=chunk).collect()}
    assert got == {c: brute_digest([(r, t) for k, _, r, t in rows if k == c]) for c in (1, 2, 3, 4, None)}


def test_mask_spans_cover_the_assistants_parts_alone(spark):
    parts = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
    rows = [
        (1, 0, "user", [("text", "look: ", None, None, None, None, None), ("image", None, "a.png", 28, 28, None, None)]),
        (1, 1, "assistant", [("text", "a <|end|> ", None, None, None, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("text", "b\\", None, None, None, None, None), ("document", None, "c.pdf", None, None, None, 2)]),
        (1, 2, "assistant", None),
    ]
    stored = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts {parts}"))
    row = stored.first()
    assert [chat.unescape(row.formatted[x.start : x.start + x.length]) for x in row.loss] == ["a <|end|> <|audio:0|>b\\<|document:1|>"]
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 50), ("document", "c.pdf", 1024)] and row.n_placeholder_tokens == 1078
    digest = chat.digest_stored(stored).first()
    assert digest.n_turns == 3 and digest.loss_sha256 == hashlib.sha256(b"a <|end|> b\\").hexdigest() and digest.formatted_chars == len(row.formatted)


# ---------------------------------------------------------------- WARC

BIG = "<p>" + "x" * 120 + "</p>"


def brute_records(rows):
    data = [(k, (h or "").encode()) for k, h in rows]
    first = {}
    for k, h in data:
        if k is not None:
            first[h] = min(first.get(h, k), k)
    out = []
    for k, h in data:
        later = len(h) >= 100 and h in first and k != first[h] and [x for _, x in data].count(h) > 1
        out.append((k, len(h), hashlib.sha256(h).hexdigest(), "revisit" if later else "response", first[h] if later else None))
    return sorted(out, key=str)


PAGES = "page_id long, url string, html string"
EVIL = f"a\r\n\r\n{warc.VERSION}\r\nWARC-Type: response\r\n\r\nb\r\n\r\n" + "z" * 100
ODD_PAGES = [
    (3, "u", BIG), (1, "u\r\nX: y", BIG), (2, None, BIG), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", EVIL), (8, "u", EVIL), (9, "u", "é🙂\r\n\r\n" * 40), (None, "u", BIG), (None, "u", BIG),
    (10, "u", "x\r\n\r\n"), (1, "u", BIG), (-5, "u", "tail\n" * 60), (11, "u", "long " * 300_000), (12, "u", "long " * 300_000), (None, None, "only without ids " * 20), (None, None, "only without ids " * 20), (8, "u", EVIL),
]


def records_of(folder):
    """Per file the records of its gzip members, by a reader of its own."""
    import gzip
    import io

    out = []
    for p in sorted(x for x in folder.iterdir() if x.name.startswith("part-")):
        data, records = p.read_bytes(), []
        starts = [i for i in range(len(data)) if data[i : i + 4] == b"\x1f\x8b\x08\x00"]
        whole = gzip.GzipFile(fileobj=io.BytesIO(data)).read()
        while whole:
            head, rest = whole.split(b"\r\n\r\n", 1)
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            records.append((fields, rest[:n]))
            whole = rest[n + 4 :]
        out.append((len(starts), records))
    return out


@pytest.mark.parametrize("few", [1_000_000, 1], ids=["broadcast", "waves"])
@pytest.mark.parametrize("stored", [True, False])
def test_archives_round_trip(spark, tmp_path, few, stored):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(ODD_PAGES, PAGES).repartition(3).withColumns({c: F.lit("clash") for c in ("digest", "first", "sole", "n", "refers_to", "payload_bytes", "value")})
    if stored:
        pages.write.parquet(f"{tmp_path}/pages")
        pages = spark.read.parquet(f"{tmp_path}/pages")
    warc.write_archives(pages, f"{tmp_path}/w", few=few, blob_mb=0)
    records = warc.read_archives(spark, f"{tmp_path}/w")
    got = sorted((tuple(r) for r in warc.resolve_revisits(records, few - 1).collect()), key=str)
    assert got == brute_records([(k, h) for k, _, h in ODD_PAGES])
    rows = records.collect()
    texts = sorted((h or "") for _, _, h in ODD_PAGES)
    assert [r.payload for r in rows if r.record_type == "revisit"] == [None] * sum(r.record_type == "revisit" for r in rows) and set(r.payload for r in rows if r.payload is not None) == set(texts)
    ids = {r.record_id: r for r in rows}
    assert len(ids) == len(rows) == len(ODD_PAGES)
    for r in rows:  # page 1 stands twice, so its copies name no single record
        if r.record_type == "revisit":
            assert (r.refers_to_id is None) == (r.refers_to == 1) and (r.refers_to_id is None or ids[r.refers_to_id].page_id == r.refers_to)


def test_each_record_is_a_member_after_a_warcinfo(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(ODD_PAGES, PAGES).repartition(2), f"{tmp_path}/w")
    files = records_of(tmp_path / "w")
    for members, records in files:
        assert members == len(records) + 1  # the last one is empty
        kinds = [f[b"WARC-Type"] for f, _ in records]
        assert kinds[0] == b"warcinfo" and b"warcinfo" not in kinds[1:]
        assert {f[b"WARC-Warcinfo-ID"] for f, _ in records[1:]} == {records[0][0][b"WARC-Record-ID"]}
    every = [x for _, records in files for x in records]
    assert len({f[b"WARC-Record-ID"] for f, _ in every}) == len(every) == len(ODD_PAGES) + len(files)
    assert sum(BIG.encode() in b for _, b in every) == 2 and all(b"sha256:" in f[b"WARC-Payload-Digest"] for f, _ in every if f[b"WARC-Type"] != b"warcinfo")


def test_payloads_are_in_no_exchange(spark, tmp_path):
    spark.createDataFrame(ODD_PAGES, PAGES).write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    for records in warc.plan_records(pages):
        plan = records._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    plan = warc.shared_payloads(pages)._jdf.queryExecution().executedPlan().toString()
    assert all("html" not in line for line in plan.split("\n") if "Exchange" in line)


def test_changed_archives_are_refused():
    head = warc.page_record(1, "u", b"x" * 9, 9, hashlib.sha256(b"x" * 9).hexdigest(), None, True, "run", "0", "info", "2025-01-01T00:00:00Z")
    assert warc.parse_record(head)[1].endswith(b"x" * 9)
    with pytest.raises(ValueError):
        warc.parse_record(head[:-1])
    with pytest.raises(ValueError):
        list(warc.members_of(warc._member(head)[:-3]))


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], PAGES)
    warc.write_archives(pages, f"{tmp_path}/e")
    assert warc.resolve_revisits(warc.read_archives(spark, f"{tmp_path}/e")).count() == 0


# ---------------------------------------------------------------- mixing


def test_rates_are_means(spark):
    docs = spark.createDataFrame([(i, "t", "en", "big" if i % 4 else None, 1) for i in range(8000)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.replicate(docs, targets={"big": 1.0})
    assert out.where("source is null").count() == 0
    rows = mixing.replicate(docs).groupBy("source").count().collect()
    n = {None: 2000, "big": 6000}
    w = {k: v**0.5 for k, v in n.items()}
    for r in rows:
        assert r["count"] == pytest.approx(8000 * w[r.source] / sum(w.values()), rel=0.06)


def test_counts_invert_poisson(spark):
    import math

    docs = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(500)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.n_copies for r in mixing.replicate(docs).collect()}
    for i in range(500):
        u = int(hashlib.md5(f"{i}|{mixing.SEED}".encode()).hexdigest()[:13], 16) / 16**13
        k, below = 0, math.exp(-1)
        while below <= u:
            k += 1
            below += math.exp(-1) / math.factorial(k)
        assert got.get(i, 0) == k


def test_targets_are_met_without_a_cap_and_sql_agrees(spark, tmp_path):
    import duckdb

    # a source of 200 rows among 10,000, a third of the rows without an id
    rows = [(None if i % 3 == 0 else i, f"text {i}", "en", "small" if i < 200 else "large" if i % 7 else None, 1) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()
    n = {r.source: r["count"] for r in mixing.replicate(docs, targets={"small": 0.5, "large": 0.5}).groupBy("source").count().collect()}
    assert set(n) == {"small", "large"} and sum(n.values()) == pytest.approx(10_000, rel=0.05) and n["small"] / sum(n.values()) == pytest.approx(0.5, abs=0.03)
    documents = docs.toArrow()
    sql = duckdb.sql(mixing.OP5_SQL).fetchall()
    got = mixing.replicate(docs).select("doc_id", "text", "lang", "source", "n_chars", "rate", "n_copies", "copy", "shuffle_key").collect()
    plain = lambda r: (-1 if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:5], round(r[5], 9), *r[6:])
    assert max(r.rate for r in got) > 4 and sorted(map(plain, got), key=str) == sorted(map(plain, sql), key=str) and documents.num_rows == 10_000


def test_mixing_odd_documents(odd_docs, no_docs, clashing):
    docs = clashing(odd_docs)
    out = mixing.replicate(docs)
    assert set(docs.columns) <= set(out.columns) and out.where("copy >= n_copies").count() == 0
    a = sorted(map(str, out.collect()))
    assert a == sorted(map(str, mixing.replicate(docs.repartition(3)).collect()))
    assert mixing.replicate(no_docs).count() == 0
    with pytest.raises(ValueError):
        mixing.replicate(docs, max_rate=20)


def test_order_is_shuffled(spark):
    docs = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(2000)], "doc_id long, text string, lang string, source string, n_chars long")
    ids = [r.doc_id for r in mixing.replicate(docs).collect()]
    assert SequenceMatcher(None, ids[:300], sorted(ids[:300])).ratio() < 0.3


def test_small_sources_reach_their_targets(spark):
    rows = [(i, "t", "en", "tiny" if i < 100 else "big", 1) for i in range(40_100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()
    n = {r.source: (r.rate, r.n) for r in mixing.replicate(docs).groupBy("source", "rate").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert n["tiny"][0] == pytest.approx(10 * 40_100 / (210 * 100)) and n["tiny"][1] == pytest.approx(1910, rel=0.1)
    capped = mixing.replicate(docs, max_rate=4).where("source = 'tiny'")
    assert capped.first().rate == 4 and capped.count() < 500


def test_large_rates_invert_poisson(spark):
    import math

    docs = spark.createDataFrame([(i, "t", "en", "one" if i < 5 else "big", 1) for i in range(20_000)], "doc_id long, text string, lang string, source string, n_chars long")
    rate = 0.5 * 20_000 / 5
    got = {r.doc_id: r.n_copies for r in mixing.replicate(docs, targets={"one": 1.0, "big": 1.0}).where("source = 'one' and copy = 0").collect()}
    for i in range(5):
        u = int(hashlib.md5(f"{i}|{mixing.SEED}".encode()).hexdigest()[:13], 16) / 16**13
        k, below = 0, math.exp(-rate)
        while below <= u:
            k += 1
            below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        assert got[i] == k
