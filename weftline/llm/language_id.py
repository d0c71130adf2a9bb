"""Language ID: multilingual mixture inference.

Languages are learned as distributions over hashed byte n-grams (lower-cased,
word edges marked), from a bounded sample of labelled rows. A document is a
mixture of languages and of a uniform background, which is a component of every
set: what it holds lowers the score. Expectation-maximisation over the n-grams
estimates the proportions. The language set grows from the best single language:
each step tries every language that is not yet chosen, and takes the one with the
greatest likelihood, while that pays the penalty. (No step is tried where the
likelihood of all languages together, bounded from above by its gradient, could
not pay it.) The largest proportion names the document.

Parameters: the ``most_languages`` most frequent languages are learned; about
``per_language`` rows are sampled of each (by a hash of id and text; every language
with fewer keeps all its rows), of which each counts as ``most_grams`` n-grams at most, whatever its length (all its
n-grams are read, their counts are scaled); ``buckets`` n-gram buckets,
``penalty`` per added language and log n-gram, ``rounds`` of
expectation-maximisation.

Defined cases: null text, empty text and texts without a letter are ``und`` with
score 0; null languages teach nothing; rows without an id are drawn by their texts; a text whose n-grams were never seen falls
to the background; without any labelled row, as with an empty table, everything
is ``und``; repeated rows teach repeatedly and give repeated results; very long
texts are counted whole; of equal likelihoods or proportions the language that
comes first by name wins; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import filter_rows, slices, table

BUCKETS = 1 << 14
UNDETERMINED = "und"


def fold(column: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column.cast("string").cast("binary")) % folds


def _byte_classes() -> np.ndarray:
    """Lower case for A-Z; anything else that is no letter in ASCII is a space."""
    out = np.full(256, 32, dtype=np.uint32)
    for c in range(256):
        if c >= 128 or chr(c).isalpha():
            out[c] = c | 32 if c < 128 else c
    return out


_CLASS = _byte_classes()


def gram_counts(data: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's byte trigrams and bigrams, and their counts. Runs of spaces count once."""
    b = _CLASS[np.frombuffer(b" " + data + b" ", dtype=np.uint8)]
    blank = b == 32
    keep = ~(blank[1:] & blank[:-1])
    b = b[1:][keep]
    b = np.concatenate([[np.uint32(32)], b]).astype(np.uint32)
    if b.size < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    pair = b[:-1] << 8 | b[1:]
    three = pair[:-1] << 8 | b[2:]
    shift = 32 - (buckets.bit_length() - 1)
    hashed = np.concatenate([three * np.uint32(2654435761) >> np.uint32(shift), (pair * np.uint32(2246822519) + np.uint32(374761393)) >> np.uint32(shift)])
    counts = np.bincount(hashed, minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text[:64]) or any(c.isalpha() for c in text[64:])


class MixtureModel:
    """Learned languages and the inference of a document's mixture."""

    def __init__(self, languages: list[str], counts: np.ndarray, penalty: float = 4.0, rounds: int = 12):
        self.languages, self.penalty, self.rounds = languages, penalty, rounds
        total = counts.sum(axis=1, keepdims=True)
        self.buckets = counts.shape[1]
        share = (counts + 0.5) / (total + 0.5 * self.buckets)
        self.likely = np.ascontiguousarray(share.T)  # bucket, language

    def _fit(self, p: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation, and the log-likelihood."""
        mix, total = start, n.sum()
        for _ in range(self.rounds):
            mix = mix * (p.T @ (n / (p @ mix))) / total
        return mix, float(n @ np.log(p @ mix))

    def infer(self, at: np.ndarray, n: np.ndarray) -> tuple[dict[str, float], float]:
        """Proportions of the chosen language set, and the log-likelihood per n-gram; the rest is the background's."""
        if not self.languages or not at.size:
            return {}, 0.0
        k_all = len(self.languages)
        p = np.column_stack([self.likely[at], np.full(at.size, 1 / self.buckets)])  # the background comes last
        single, alone = self._alone(p, n)
        chosen = [int(np.argmax(alone))]
        best, mix = float(alone[chosen[0]]), np.array([single[chosen[0]], 1 - single[chosen[0]]])
        cost = self.penalty * np.log(n.sum() + 1)
        if k_all > 1 and self._most(p, n) > best + cost:
            while len(chosen) < k_all:
                tried = [self.fit_set([*chosen, k], p, n) for k in range(k_all) if k not in chosen]
                found, value, own = max(tried, key=lambda t: (t[1], [-k for k in t[2]]))
                if value <= best + cost:
                    break
                chosen, best, mix = own, value, found
        return {self.languages[k]: float(m) for k, m in zip(chosen, mix[:-1], strict=True)}, best / float(n.sum())

    def fit_set(self, languages: list[int], p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float, list[int]]:
        """Proportions of a set and the background, and the log-likelihood."""
        own = [*languages, len(self.languages)]
        found, value = self._fit(p[:, own], n, np.append(np.full(len(languages), 0.9 / len(languages)), 0.1))
        return found, value, languages

    def _most(self, p: np.ndarray, n: np.ndarray) -> float:
        """No mixture is likelier than this: as the log-likelihood is concave in the proportions, its gradient at some
        proportions bounds it everywhere."""
        mix, value = self._fit(p, n, np.full(p.shape[1], 1 / p.shape[1]))
        gain = float((p.T @ (n / (p @ mix))).max() / n.sum())
        return value + float(n.sum()) * np.log(max(1.0, gain))

    def _alone(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each language with the background alone: its share, and the log-likelihood."""
        own, back, total = p[:, :-1], p[:, -1:], n.sum()
        share = np.full(own.shape[1], 0.9)
        for _ in range(self.rounds):
            part = share * own
            share = n @ (part / (part + (1 - share) * back)) / total
        return share, n @ np.log(share * own + (1 - share) * back)

    def is_language(self, at: np.ndarray, n: np.ndarray) -> bool:
        """False without languages, and if a uniform background beside all of them raises the log-likelihood by more
        than its penalty and takes the larger part of the text."""
        if not self.languages or not at.size:
            return False
        p = np.column_stack([self.likely[at], np.full(at.size, 1 / self.buckets)])
        k = len(self.languages)
        mix, value = self._fit(p, n, np.full(k + 1, 1 / (k + 1)))
        if mix[-1] <= 0.5:
            return True
        _, without = self._fit(p[:, :k], n, np.full(k, 1 / k))
        return value <= without + self.penalty * np.log(n.sum() + 1)

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        if not text or not has_letter(text):
            return UNDETERMINED, 0.0, {}
        found, _ = self.infer(*gram_counts(text.encode(), self.buckets))
        if not found:
            return UNDETERMINED, 0.0, {}
        top = max(sorted(found), key=found.get)
        return top, min(1.0, found[top]), found


def train(docs: DataFrame, per_language: int = 2000, buckets: int = BUCKETS, most_grams: int = 1000, most_languages: int = 256, **options) -> MixtureModel:
    """Learns from rows with text and language, of the ``most_languages`` languages that most rows have (of equal ones the
    first by name). Rows are drawn by a hash of id and text, about ``per_language`` of each language, and that of the
    smallest hash always; equal rows are drawn together.

    Counts are summed per task before the shuffle; the driver receives a row per learned language, and ``buckets`` counts.
    """
    hashed = F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1 << 30)).alias("h")
    rows = docs.where("text is not null and lang is not null").select("lang", "text", hashed)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least"))
    learned = sizes.orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not learned:
        return MixtureModel([], np.zeros((0, buckets)), **options)
    bounds = [(r.lang, max(r.least + 1, math.ceil(min(1.0, per_language / r.n) * (1 << 30)))) for r in learned]
    bound = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, below long"))  # a row per learned language
    drawn = rows.join(bound, "lang").where("h < below")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = gram_counts(text.encode(), buckets)
                sums.setdefault(lang, np.zeros(buckets))[at] += n * min(1.0, most_grams / max(1.0, n.sum()))
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size), pa.array(at), pa.array(s[at])], ["lang", "at", "n"])

    parts = drawn.select("lang", "text").mapInArrow(run, "lang string, at long, n double").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    languages = sorted(k for k, _ in bounds)
    counts = np.zeros((len(languages), buckets))
    where = {k: i for i, k in enumerate(languages)}
    for r in parts.toLocalIterator():
        counts[where[r.lang], r.at] = round(r.n, 6)
    return MixtureModel(languages, counts, **options)


def predict(docs: DataFrame, model: MixtureModel, id_col: str = "doc_id") -> DataFrame:
    """lang_pred, score and the proportions (``mixture``) of each document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x buckets numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, 1000, 16):
                found = [m.predict(t) for t in part.column(1).to_pylist()]
                mixtures = pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), mixtures], [id_col, "lang_pred", "score", "mixture"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, mixture map<string, double>")


def keep_determined(docs: DataFrame, model: MixtureModel) -> DataFrame:
    """Documents in the learned languages, in any mixture; those that are no language, and those without a letter, go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        known = lambda text: bool(text) and has_letter(text) and m.is_language(*gram_counts(text.encode(), m.buckets))
        return lambda texts: [known(t) for t in texts]

    return filter_rows(docs, make)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns outside fold 1 of 3, predicts every document; ``n_languages`` is the size of the chosen set."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(F.coalesce(fold("doc_id", 3), F.lit(0)) != 1))
    found = predict(docs, model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("mixture").cast("long").alias("n_languages"))
