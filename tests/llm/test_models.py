"""Language ID and quality: inference against brute force, held-out accuracy, odd tables."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import language_id as li
from weftline.llm import quality as q

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("text", ["Ab  c!é", "", "a", "  ", "Zebra zebra 12 zebra-crossing Ünïcödé ... x", "aaaa" * 50])
@pytest.mark.parametrize("buckets", [1 << 6, 1 << 14])
def test_gram_counts_equal_brute_force(text, buckets):
    spaced = [32, *(c if c >= 128 else c | 32 if chr(c).isalpha() else 32 for c in text.encode()), 32]
    cleaned = [c for i, c in enumerate(spaced) if not (c == 32 and i and spaced[i - 1] == 32)]
    shift, expected = 32 - (buckets.bit_length() - 1), {}
    for i in range(len(cleaned) - 1) if len(cleaned) > 2 else ():
        a, b = cleaned[i : i + 2]
        grams = [((a << 8 | b) * 2246822519 + 374761393) % (1 << 32) >> shift]
        if i + 2 < len(cleaned):
            grams.append((a << 16 | b << 8 | cleaned[i + 2]) * 2654435761 % (1 << 32) >> shift)
        for g in grams:
            expected[g] = expected.get(g, 0) + 1
    at, n = li.gram_counts(text.encode(), buckets)
    assert dict(zip(at.tolist(), n.tolist(), strict=True)) == expected


def best_fit(p, n, rounds=400):
    """Proportions of a set by many plain steps, one n-gram at a time."""
    mix = [1 / p.shape[1]] * p.shape[1]
    for _ in range(rounds):
        new = [0.0] * len(mix)
        for row, c in zip(p.tolist(), n.tolist(), strict=True):
            whole = sum(m * x for m, x in zip(mix, row, strict=True))
            for k, x in enumerate(row):
                new[k] += c * mix[k] * x / whole
        mix = [x / n.sum() for x in new]
    return mix, sum(c * math.log(sum(m * x for m, x in zip(mix, row, strict=True))) for row, c in zip(p.tolist(), n.tolist(), strict=True))


def test_language_sets_equal_exhaustive_search():
    """The chosen set has the greatest penalised likelihood of all sets, by a fit of its own."""
    from itertools import combinations

    rng = np.random.RandomState(5)
    model = li.MixtureModel(list("abcd"), rng.gamma(0.3, size=(4, 64)) * 1000, rounds=60)
    draw = lambda k, size: rng.choice(64, size, p=model.likely[:, k] / model.likely[:, k].sum())
    cases = [{0: 300}, {0: 300, 1: 150}, {0: 200, 1: 200, 2: 200}, {3: 20}, {0: 150, 1: 150, 2: 150, 3: 150}, {2: 400, 3: 24}]
    for sizes in cases:
        at, n = np.unique(np.concatenate([draw(k, size) for k, size in sizes.items()]), return_counts=True)
        n = n.astype(float)
        p = np.column_stack([model.likely[at], np.full(at.size, 1 / 64)])
        cost = model.penalty * math.log(n.sum() + 1)
        scored = {}
        for size in range(1, 5):
            for own in combinations(range(4), size):
                mix, value = best_fit(p[:, [*own, 4]], n, 150)
                scored[own] = (value - (size - 1) * cost, mix)
                assert value <= model._most(p, n) + 1e-9
        best = max(scored, key=lambda k: scored[k][0])
        found, _ = model.infer(at, n)
        assert set(found) == {model.languages[k] for k in best}
        for k, share in zip(best, scored[best][1], strict=False):
            assert found[model.languages[k]] == pytest.approx(share, abs=0.02)


def test_a_small_passage_in_a_long_text_is_found():
    rng = np.random.RandomState(6)
    model = li.MixtureModel(list("abcd"), rng.gamma(0.3, size=(4, 512)) * 1000)
    drawn = np.concatenate([rng.choice(512, size, p=model.likely[:, k] / model.likely[:, k].sum()) for k, size in ((0, 60_000), (2, 900))])
    found, _ = model.infer(*(x.astype(t) for x, t in zip(np.unique(drawn, return_counts=True), (int, float), strict=True)))
    assert set(found) == {"a", "c"} and found["c"] == pytest.approx(0.015, abs=0.005)


def test_mixture_proportions():
    rng = np.random.RandomState(0)
    counts = rng.gamma(0.3, size=(3, 512)) * 1000
    model = li.MixtureModel(["a", "b", "c"], counts)
    drawn = np.concatenate([rng.choice(512, 1400, p=model.likely[:, 0] / model.likely[:, 0].sum()), rng.choice(512, 600, p=model.likely[:, 2] / model.likely[:, 2].sum())])
    at, n = np.unique(drawn, return_counts=True)
    found, _ = model.infer(at, n.astype(float))
    assert set(found) == {"a", "c"} and found["a"] == pytest.approx(0.7, abs=0.05)
    pure, _ = model.infer(*(x.astype(t) for x, t in zip(np.unique(drawn[:1400], return_counts=True), (int, float), strict=True)))
    assert set(pure) == {"a"}
    # a step of expectation-maximisation never lowers the likelihood
    p = model.likely[at]
    values = [float(n @ np.log(p @ li.MixtureModel(["a", "b", "c"], counts, rounds=k)._fit(p, n.astype(float), np.full(3, 1 / 3))[0])) for k in range(6)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:], strict=False))


def test_the_background_takes_what_is_no_language():
    rng = np.random.RandomState(0)
    counts = rng.gamma(0.3, size=(3, 512)) * 1000
    model = li.MixtureModel(["a", "b", "c"], counts)
    pure = rng.choice(512, 1000, p=model.likely[:, 0] / model.likely[:, 0].sum())
    half, none = np.concatenate([pure, rng.choice(512, 1000)]), rng.choice(512, 2000)
    shares = [sum(model.infer(at, n.astype(float))[0].values()) for at, n in (np.unique(x, return_counts=True) for x in (pure, half, none))]
    assert shares[0] > 0.9 and shares[1] == pytest.approx(0.5, abs=0.1) and shares[2] < 0.2


def test_language_odd_documents(spark, odd_docs, no_docs, clashing):
    model = li.train(clashing(odd_docs))
    rows = {r.doc_id: r for r in li.predict(clashing(odd_docs), model).collect()}
    assert [rows[k].lang_pred for k in (4, 5, 7, 11)] == ["und"] * 4 and rows[1].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows.values())
    empty = li.train(no_docs)
    assert {r.lang_pred for r in li.predict(odd_docs, empty).collect()} == {"und"} and li.predict(no_docs, model).count() == 0
    kept = li.keep_determined(clashing(odd_docs), model)
    assert kept.columns == clashing(odd_docs).columns and {4, 5, 7, 11}.isdisjoint({r.doc_id for r in kept.collect()})


def test_mixtures_of_any_number_of_languages_stay(spark):
    words = {c: ["".join(np.random.RandomState(i * 100 + j).choice(list(c), 5)) for j in range(60)] for i, c in enumerate(["abcde", "fghij", "klmno", "pqrst", "uvwxy"])}
    rng = np.random.RandomState(3)
    taught = [(i, " ".join(rng.choice(words[c], 100)), c, "s", 1) for i, c in enumerate(sorted(words) * 20)]
    model = li.train(spark.createDataFrame(taught, "doc_id long, text string, lang string, source string, n_chars long"))
    mixed = {k: " ".join(" ".join(rng.choice(words[c], 60)) for c in sorted(words)[:k]) for k in range(1, 6)}
    noise = {k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 2000)) for k in (11, 12)}
    docs = spark.createDataFrame([(k, t, None, "s", 1) for k, t in (mixed | noise).items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in li.keep_determined(docs, model).collect()) == [1, 2, 3, 4, 5]


def test_rows_without_ids_are_drawn_by_their_texts(spark, monkeypatch):
    from weftline.llm import language_id

    docs = spark.range(60).selectExpr("cast(null as long) as doc_id", "concat('ein kurzer satz ', 100 + id) as text", "'de' as lang").unionByName(spark.range(60).selectExpr("id as doc_id", "'one text for all' as text", "'en' as lang"))
    docs = docs.unionByName(spark.range(40).selectExpr("7L as doc_id", "'siempre la misma fila' as text", "'es' as lang"))
    monkeypatch.setattr(language_id, "MixtureModel", lambda languages, counts: dict(zip(languages, counts.sum(axis=1), strict=True)))
    full = language_id.train(docs, per_language=1000)
    for asked in (59, 30, 10):
        part = language_id.train(docs, per_language=asked)
        assert all(abs(part[k] / full[k] - asked / 60) < 0.2 for k in ("de", "en"))
    # no language is learned from nothing; equal rows go together
    least = language_id.train(docs, per_language=0)
    assert min(least.values()) > 0 and least["es"] == full["es"] and least["de"] < full["de"] / 20


def test_the_number_of_languages_is_bounded(spark):
    from weftline.llm import language_id

    docs = spark.range(10_000).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('l', id) as lang").unionByName(spark.range(20).selectExpr("-id as doc_id", "concat('wort ', id) as text", "'de' as lang"))
    model = language_id.train(docs, buckets=1024)
    assert len(model.languages) == 256 and "de" in model.languages and "l0" in model.languages and "l9999" not in model.languages
    assert language_id.predict(docs.where("doc_id = 5000"), model).count() == 1


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = li.op4_language_id(spark, DATA).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def brute_marginals(score, link):
    n = len(score)
    weight = {y: math.exp(sum(score[t][y[t]] for t in range(n)) + sum(link[y[t]][y[t + 1]] for t in range(n - 1))) for y in product((0, 1), repeat=n)}
    z = sum(weight.values())
    return [[sum(w for y, w in weight.items() if y[t] == k) / z for k in (0, 1)] for t in range(n)], math.log(z)


def test_marginals_equal_enumeration():
    rng = np.random.RandomState(1)
    lengths = [1, 4, 2, 6]
    doc = np.repeat(np.arange(4), lengths)
    score, link = rng.randn(doc.size, 2), rng.randn(2, 2)
    own, pair, z = q.marginals(score, link, doc)
    expected = [brute_marginals(score[doc == d].tolist(), link.tolist()) for d in range(4)]
    assert np.allclose(own, np.concatenate([m for m, _ in expected])) and z == pytest.approx(sum(x for _, x in expected))
    assert pair.sum() == pytest.approx(sum(n - 1 for n in lengths))


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_chains_of_any_length_run_in_blocks(block):
    rng = np.random.RandomState(4)
    lengths = [1, 9, 2, 6, 3]
    doc = np.repeat(np.arange(5), lengths)
    score, link = rng.randn(doc.size, 2) * 3, rng.randn(2, 2)
    own, pair, z = q.marginals(score, link, doc, block)
    expected = [brute_marginals(score[doc == d].tolist(), link.tolist()) for d in range(5)]
    assert np.allclose(own, np.concatenate([m for m, _ in expected])) and z == pytest.approx(sum(x for _, x in expected))
    assert np.allclose(pair, q.marginals(score, link, doc, 100)[1])


def test_choice_of_repeated_ids_and_labels_is_fixed(spark):
    docs = [(1, "Good text one.\nAnd more."), (1, "### || 999"), (2, "### || 888 77"), (2, "### || 888 77"), (3, "A plain line."), (4, "line\n" * 500)]
    labels = [(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0), (4, 1, 0)]
    fields = []
    for n in (1, 3, 5):
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(n)
        fields.append(q.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(n), sample_lines=100, steps=20))
    assert fields[0].prior == pytest.approx(1 / 3)  # ids 1 and 2 are bad, 3 is good, 4 has too many lines
    assert all(np.array_equal(f.weights, fields[0].weights) and np.array_equal(f.link, fields[0].link) for f in fields)


def test_gradient_equals_differences():
    rng = np.random.RandomState(2)
    doc = np.array([0, 0, 0, 1, 1])
    f, good, w, link = rng.randn(5, 3), np.array([0, 1, 1, 0, 0]), rng.randn(3, 2), rng.randn(2, 2)

    def loss(w, link):
        s = f @ w
        inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        return q.marginals(s, link, doc)[2] - s[np.arange(5), good].sum() - link[good[inner - 1], good[inner]].sum()

    own, pair, _ = q.marginals(f @ w, link, doc)
    seen = np.eye(2)[good]
    g = f.T @ (own - seen)
    for i, k in product(range(3), range(2)):
        e = np.zeros_like(w)
        e[i, k] = 1e-5
        assert g[i, k] == pytest.approx((loss(w + e, link) - loss(w - e, link)) / 2e-5, abs=1e-5)


def test_line_features_of_a_slice_equal_those_of_single_texts():
    texts = [b"", b"One line.\nTwo Two two!", b"\n\n", "é | ü ***\nx".encode(), b"last"]
    x, size, doc = q.line_features(texts)
    alone = [q.line_features([t]) for t in texts]
    assert np.allclose(x, np.concatenate([a[0] for a in alone])) and doc.tolist() == [1, 1, 3, 3, 4] and size.tolist() == [9, 12, 11, 1, 4]


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = q.op3_quality(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_odd_documents(spark, odd_docs, no_docs, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0), (8, 0, None), (9, None, 0), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    field = q.train(clashing(odd_docs), labels)
    rows = q.score_documents(clashing(odd_docs), field).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows) and by[4].score == by[5].score == by[7].score == field.prior and by[4].n_lines == 0
    assert q.score_documents(no_docs, field).count() == 0
    untrained = q.train(odd_docs, labels.where("false"))
    assert {r.score for r in q.score_documents(odd_docs, untrained).collect()} == {0.5}
    assert q.keep_good(clashing(odd_docs), field).columns == clashing(odd_docs).columns


def test_labels_are_never_inputs(spark):
    """Scores of held-out rows stay when their labels, languages and sources change."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300).cache()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").cache()
    held = li.fold("doc_id", 5) == 0
    a = q.score_documents(docs, q.train(docs, labels.where(~held))).orderBy("doc_id").collect()
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    b = q.score_documents(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), q.train(docs, flipped.where(~held))).orderBy("doc_id").collect()
    assert a == b
