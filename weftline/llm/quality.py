"""Quality classifier: a linear-chain conditional random field over lines.

Each line is good or bad. Its features (shares of character classes, lengths,
repeated words) and those of its neighbours feed linear scores; transitions
link the labels of adjacent lines. Documents' labels teach every line of the
document. A document's quality is the mean marginal probability of good, from
the forward-backward recursions, weighted by the lines' lengths in bytes.

Parameters: at most ``sample`` labelled documents, of ``sample_lines`` lines in all,
are learned from (the smallest hashes of their ids), each as one whole chain;
``l2`` and ``steps`` of gradient descent.

Defined cases: blank lines are no lines; null, empty and blank texts score the
share of good documents in the sample; without labels, as with empty tables,
every score is that share with nothing seen, 0.5; null labels teach nothing;
repeated rows teach once and give repeated results; of several labels or texts
under one id a fixed choice teaches (see ``train``); all lines of a long text
count, in one chain; a score of exactly the threshold counts as good; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import as_bytes, filter_rows, slices, table
from weftline.llm._text import words
from weftline.llm.language_id import fold

#: Classes of bytes whose shares are features: lower, upper, digit, blank, stop, ending, bar, other symbol, non-ASCII
CLASSES = 9
FEATURES = CLASSES + 6


def _classes() -> np.ndarray:
    out = np.full(256, 7, dtype=np.int64)
    for c in range(256):
        ch = chr(c)
        out[c] = 8 if c >= 128 else 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3 if ch.isspace() else 4 if ch in ".,;:'\"-()" else 5 if ch in "!?" else 6 if ch == "|" else 7
    return out


_CLASS = _classes()


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line that isn't blank: features, length in bytes, number of its document."""
    b = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(b == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    doc_end = np.cumsum([len(t) + 1 for t in texts]) - 1
    doc = np.searchsorted(doc_end, ends, side="left")
    n_lines = ends.size
    line = np.repeat(np.arange(n_lines), ends - starts + 1)
    counts = np.bincount(line * CLASSES + _CLASS[b], minlength=n_lines * CLASSES).reshape(n_lines, CLASSES).astype(np.float64)
    size = (ends - starts).astype(np.float64)
    counts[:, 3] -= 1  # the line end
    low = np.where((b >= 65) & (b <= 90), b | 32, b).astype(np.uint8)
    ws, we, wh = words(low)
    wline = line[ws] if ws.size else np.zeros(0, dtype=np.int64)
    n_words = np.bincount(wline, minlength=n_lines).astype(np.float64)
    same = np.flatnonzero((wh[1:] == wh[:-1]) & (wline[1:] == wline[:-1])) + 1
    repeated = np.bincount(wline[same], minlength=n_lines)
    letters = np.bincount(wline, weights=(we - ws).astype(np.float64), minlength=n_lines)
    capital = np.bincount(wline, weights=(_CLASS[b[ws]] == 1).astype(np.float64), minlength=n_lines)
    alone = np.bincount(wline, weights=(we - ws == 1).astype(np.float64), minlength=n_lines)
    per = np.maximum(n_words, 1)
    x = np.column_stack([counts / np.maximum(size, 1)[:, None], np.log1p(size), np.log1p(n_words), letters / per, repeated / per, capital / per, alone / per])
    keep = n_words > 0
    return x[keep], size[keep], doc[keep]


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after within the document, whether there is one, and a constant."""
    n, k = x.shape
    out = np.zeros((n, 3 * k + 3))
    out[:, :k] = x
    if n > 1:
        linked = (doc[1:] == doc[:-1])[:, None]
        out[1:, k : 2 * k] = x[:-1] * linked
        out[:-1, 2 * k : 3 * k] = x[1:] * linked
        out[1:, 3 * k] = linked[:, 0]
        out[:-1, 3 * k + 1] = linked[:, 0]
    out[:, -1] = 1
    return out


def marginals(score: np.ndarray, link: np.ndarray, doc: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once. ``score``: (lines, 2), ``link``: (2, 2), ``doc``: ascending numbers.

    Chains of any length: each block of ``block`` lines is first summed to the matrix that leads through it, the
    matrices carry messages along the chains, and then all blocks run side by side. Returns the lines' marginals, the
    summed pair marginals and the log partition function.
    """
    n = score.shape[0]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    lengths = np.diff(np.append(first, n))
    per = -(-lengths // block)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)  # a block's number in its chain
    start = np.repeat(first, per) + nth * block
    size = np.minimum(block, np.repeat(first + lengths, per) - start)
    opens, closes = nth == 0, nth == np.repeat(per, per) - 1
    by_size = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[by_size], -np.arange(1, size.max() + 1), side="right")
    by_nth = np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1])

    def through(m: np.ndarray) -> np.ndarray:
        """Messages (blocks, 2) one line on, before that line's score."""
        return np.column_stack([np.logaddexp(m[:, 0] + link[0, c], m[:, 1] + link[1, c]) for c in (0, 1)])

    into, out = np.full((size.size, 2), [0.0, -np.inf]), np.zeros((size.size, 2))
    if len(by_nth) > 1:
        lead = np.empty((2, size.size, 2))  # from the label before the block to that of its last line
        for a in (0, 1):
            lead[a] = np.where(opens[:, None], 0.0, link[a]) + score[start]
            for t in range(1, size.max()):
                at = by_size[: alive[t]]
                lead[a][at] = through(lead[a][at]) + score[start[at] + t]
        for at in by_nth[1:]:
            into[at] = np.logaddexp(into[at - 1, :1] + lead[0][at - 1], into[at - 1, 1:] + lead[1][at - 1])
        for at in by_nth[:0:-1]:
            out[at - 1] = np.column_stack([np.logaddexp(lead[a][at, 0] + out[at, 0], lead[a][at, 1] + out[at, 1]) for a in (0, 1)])
    fwd, bwd = np.empty((n, 2)), np.empty((n, 2))
    fwd[start] = np.where(opens[:, None], 0.0, through(into)) + score[start]
    for t in range(1, size.max()):
        at = start[by_size[: alive[t]]] + t
        fwd[at] = through(fwd[at - 1]) + score[at]
    bwd[start + size - 1] = np.where(closes[:, None], 0.0, out)
    for t in range(size.max() - 2, -1, -1):
        at = start[by_size[: alive[t + 1]]] + t
        after = bwd[at + 1] + score[at + 1]
        bwd[at] = np.column_stack([np.logaddexp(link[a, 0] + after[:, 0], link[a, 1] + after[:, 1]) for a in (0, 1)])
    whole = fwd + bwd
    z = np.logaddexp(whole[:, 0], whole[:, 1])
    own = np.exp(whole - z[:, None])
    pair = np.zeros((2, 2))
    inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    if inner.size:
        for a in (0, 1):
            for c in (0, 1):
                pair[a, c] = np.exp(fwd[inner - 1, a] + link[a, c] + score[inner, c] + bwd[inner, c] - z[inner]).sum()
    return own, pair, float(z[first].sum())


class LineField:
    """The conditional random field."""

    def __init__(self, prior: float = 0.5):
        self.prior = prior
        self.weights: np.ndarray | None = None

    def _inputs(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.std, doc)

    def fit(self, x: np.ndarray, doc: np.ndarray, good: np.ndarray, l2: float = 1e-3, steps: int = 200, rate: float = 0.1) -> LineField:
        """``good``: 0 or 1 per line. Adam on the mean log-likelihood of the chains."""
        self.mean, self.std = x.mean(axis=0), x.std(axis=0) + 1e-6
        f = self._inputs(x, doc)
        n = len(good)
        seen = np.zeros((n, 2))
        seen[np.arange(n), good] = 1
        inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
        seen_pair = np.zeros((2, 2))
        np.add.at(seen_pair, (good[inner - 1], good[inner]), 1)
        w, link = np.zeros((f.shape[1], 2)), np.zeros((2, 2))
        both = [w, link]
        m, v = [np.zeros_like(p) for p in both], [np.zeros_like(p) for p in both]
        for step in range(1, steps + 1):
            own, pair, _ = marginals(f @ w, link, doc)
            for k, g in enumerate((f.T @ (own - seen) / n + l2 * w, (pair - seen_pair) / n + l2 * link)):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                both[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        self.weights, self.link = w, link
        return self

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Quality of each text, and its number of lines."""
        out = np.full(len(texts), self.prior)
        lines = np.zeros(len(texts), dtype=np.int64)
        if self.weights is None or not texts:
            return out, lines
        x, size, doc = line_features(texts)
        if x.shape[0]:
            own, _, _ = marginals(self._inputs(x, doc) @ self.weights, self.link, doc)
            total = np.bincount(doc, weights=size, minlength=len(texts))
            good = np.bincount(doc, weights=size * own[:, 1], minlength=len(texts))
            lines = np.bincount(doc, minlength=len(texts))
            out = np.where(total > 0, good / np.maximum(total, 1), out)
        return np.clip(out, 0, 1), lines


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_lines: int = 400_000, **options) -> LineField:
    """Learns from at most ``sample`` labelled documents; only their features reach the driver.

    An id with labels of both kinds counts as the lower one; of several texts under one id that of the smallest hash
    teaches. Documents are drawn whole, in the order of a hash of their ids, while their lines add up to no more than
    ``sample_lines``; one that is larger alone is passed over.
    """
    ranked = F.struct(F.xxhash64("doc_id", F.lit("quality sample")).alias("h"), "doc_id")
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    drawn = known.withColumn("rank", ranked).orderBy("rank").limit(sample)
    one = F.min(F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("text")))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality", "rank").agg(one.alias("one"))  # at most ``sample`` rows
    rows = rows.select("doc_id", "quality", "rank", "one.text")
    sizes = rows.select("doc_id", "quality", "rank", (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"))
    chosen, total = {}, 0
    for r in sorted(sizes.collect(), key=lambda r: tuple(r["rank"])):
        if total + r.lines <= sample_lines:
            total += r.lines
            chosen[r.doc_id] = len(chosen)
    if not chosen:
        return LineField()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500, 1):
                texts = as_bytes(part.column(1))
                x, _, doc = line_features(texts)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                data = [x[a:b].astype("<f4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(data, pa.binary())], ["doc_id", "quality", "x"])

    kind, ids = (rows.schema[c].dataType.simpleString() for c in ("quality", "doc_id"))
    picked = docs.sparkSession.createDataFrame([(k,) for k in chosen], f"doc_id {ids}")
    taught = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality")
    got = sorted(taught.mapInArrow(run, f"doc_id {ids}, quality {kind}, x binary").collect(), key=lambda r: chosen[r.doc_id])
    field = LineField(prior=sum(int(r.quality) for r in got) / len(got))
    xs = [np.frombuffer(r.x, dtype="<f4").reshape(-1, FEATURES).astype(np.float64) for r in got]
    x, per = np.concatenate(xs), [len(own) for own in xs]
    if not x.shape[0]:
        return field
    return field.fit(x, np.repeat(np.arange(len(got)), per), np.repeat([int(r.quality) for r in got], per), **options)


def score_documents(docs: DataFrame, field: LineField, id_col: str = "doc_id") -> DataFrame:
    """score (probability of good) and number of lines of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 500, 1):
                score, lines = shared.value.score(as_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(lines)], [id_col, "score", "n_lines"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, score double, n_lines long")


def keep_good(docs: DataFrame, field: LineField, least: float = 0.3) -> DataFrame:
    """Documents whose quality is ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        return lambda texts: (shared.value.score([(t or "").encode() for t in texts])[0] >= least).tolist()

    return filter_rows(docs, make, rows=500, mb=1)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns outside fold 0 of 5, scores every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    field = train(docs, labels.where(~held))
    found = score_documents(docs, field)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines")
