import random
import re

import pytest

from weftline.llm import jaccard_join as jj

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """doc_id -> (size, component) from all pairs."""
    sets = []
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
        sets.append((key, frozenset(grams)))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        least.setdefault(find(i), []).append(key)
    return sorted((key, len(s), min([k for k in least[find(i)] if k is not None], default=key)) for i, (key, s) in enumerate(sets) if key is not None)


def family(seed, n=140):
    """Near copies at all distances, shared passages, and exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, passage = [word() for _ in range(120)], [word() for _ in range(40)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
                text[rng.randrange(len(text))] = word()
        elif kind < 0.8:
            text = [word() for _ in range(rng.randrange(0, 30))] + passage
        else:
            text = [word() for _ in range(rng.randrange(0, 9))]
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("settings", [jj.Settings(), jj.Settings(part_sets=6, block=3, per_bucket=500, cells=64, frequent=2), jj.Settings(few=1, part_tokens=3000, slots=1 << 10), jj.Settings(most_buckets=16, per_bucket=100, slots=256, most_slots=256), jj.Settings(hot=3, frequent=2), jj.Settings(hot=2, few=1, part_sets=7, most_buckets=16, per_bucket=300)], ids=["default", "parts", "joins", "turns", "hot", "all"])
def test_equals_brute_force(spark, settings):
    rows = family(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in jj.near_duplicates(docs, settings).collect())
    assert got == brute(rows)


def test_boundary_is_inclusive(spark):
    # 8 shared shingles of 10 in the union: exactly 0.8
    a = "p0 p1 p2 p3 a b c d e f g h i"
    rows = [(1, a), (2, a + " j"), (3, "x " + a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jj.near_duplicates(docs).collect()) == brute(rows)


def test_odd_documents(odd_docs, no_docs, clashing):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [tuple(r) for r in jj.near_duplicates(clashing(odd_docs)).collect()]
    assert sorted(x for x in got if x[0] is not None) == brute(rows)
    assert [x for x in got if x[0] is None] == [(None, brute([(1, rows[0][1])])[0][1], 1)]
    assert jj.near_duplicates(no_docs).count() == 0


def test_keep_one(odd_docs, clashing):
    kept = jj.keep_one(clashing(odd_docs))
    assert kept.columns == clashing(odd_docs).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    expected = sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in odd_docs.collect()])})
    assert ids == expected


def test_keep_one_tells_rows_apart_by_text(spark):
    b, d = "quite another text of seven plain words", "and here is a third one, unlike the two before"
    rows = [(3, "same words in this one text", "x"), (5, "same words in this one text", "x"), (5, b, "x"), (7, "SAME words in this one text", "x"), (7, d, "x"), (9, d[::-1], "x"), (9, "", "x"), (9, "", "x"), (None, "only without an id it has words", "b"), (None, "only without an id it has words", "a"), (3, "same words in this one text", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string").repartition(3)
    for s in (jj.Settings(), jj.Settings(few=0)):
        kept = sorted(map(tuple, jj.keep_one(docs, s).collect()), key=str)
        # one row of each class; both texts that share the ids 5 and 7 with copies stay; what has no words stays
        assert kept == sorted([(3, "same words in this one text", "a"), (5, b, "x"), (7, d, "x"), (9, d[::-1], "x"), (9, "", "x"), (9, "", "x"), (None, "only without an id it has words", "a")], key=str)


def template(n):
    """Different texts that share most of a template and do not link."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(n):
        text = list(base)
        for k in rng.sample(range(5, 95), 4):
            text[k] = f"own{i}x{k}"
        rows.append((i, " ".join(text)))
    return rows


def test_large_groups_of_unlike_texts_ask_parts_not_sets(spark, monkeypatch):
    asked = []
    plain = jj.materialize

    def counted(df, name="step"):
        out = plain(df, name)
        if name == "queries":
            asked.append(out.count())
        return out

    monkeypatch.setattr(jj, "materialize", counted)
    for n in (60, 120):
        rows = template(n)
        got = sorted(tuple(r) for r in jj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), jj.Settings(part_sets=20)).collect())
        assert got == brute(rows)
    assert len(asked) == 2 and all(a <= n * -(-n // 10) for a, n in zip(asked, (60, 120), strict=True))


def test_sketches_bound_differences():
    import numpy as np

    rng = np.random.RandomState(1)
    a = np.unique(rng.randint(0, 1 << 40, 500).astype(np.uint64))
    b = np.union1d(a[:450], rng.randint(0, 1 << 40, 60).astype(np.uint64))
    s = jj.sketches([a, b], 1024)
    assert int(np.bitwise_count(s[0] ^ s[1]).sum()) <= len(np.setxor1d(a, b))


def test_tokens_pack():
    import numpy as np

    t = np.array([0, 1, (1 << 48) - 1, 12345678901], dtype=np.uint64)
    assert jj.unpack_tokens(jj.pack_tokens(t)).tolist() == t.tolist()
