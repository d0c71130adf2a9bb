"""License scans: a generalised suffix automaton over licence tokens.

Each text streams through the automaton, which yields its matching statistics
(the longest template substring that ends at each word). Right-maximal matches
are chained, in order and with bounded gaps, into covered template spans, every
one that overlaps no better span of the same template. Licences share wording, so
of spans that lie for the better part in one another only the best is kept: that
of the larger share of its template, then of more words. The share of a template
that a kept span covers decides the labels.

Defined cases: null text counts as empty; empty texts have no words, no places,
empty labels and score 0; an empty table gives no rows; repeated rows give
repeated results; very long texts are streamed word by word and never cut; of
equal chains one in the middle is taken first, so that many copies in a row are
halved, and equal spans of different templates are all kept; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import as_bytes, map_batches, table
from weftline.llm.license_texts import TEMPLATES

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases and labels of the contract.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text after lower-casing A-Z; every non-ASCII byte belongs to a word."""
    return WORD.findall(text.lower())


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton of token sequences."""

    step: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    #: per state: (sequence, last position) of the occurrences that end there
    ends: list[set] = field(default_factory=lambda: [set()])

    def _new(self, length: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, at: int, token, to: int) -> int:
        copy = self._new(self.length[at] + 1, dict(self.step[to]), self.link[to])
        self.link[to] = copy
        while at >= 0 and self.step[at].get(token) == to:
            self.step[at][token] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, token) -> int:
        if (to := self.step[last].get(token)) is not None:
            return to if self.length[to] == self.length[last] + 1 else self._split(last, token, to)
        new, at = self._new(self.length[last] + 1, {}, 0), last
        while at >= 0 and token not in self.step[at]:
            self.step[at][token] = new
            at = self.link[at]
        if at >= 0:
            to = self.step[at][token]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, token, to)
        return new

    def add(self, sequence: int, tokens: list) -> None:
        last = 0
        for i, token in enumerate(tokens):
            last = self._extend(last, token)
            self.ends[last].add((sequence, i))

    def finish(self) -> SuffixAutomaton:
        """Carry occurrences up the suffix links: a state then knows each place where its strings end."""
        for s in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]
        return self

    def walk(self, state: int, size: int, token) -> tuple[int, int]:
        """Matching statistics, one token on."""
        while state and token not in self.step[state]:
            state = self.link[state]
            size = self.length[state]
        to = self.step[state].get(token)
        return (0, 0) if to is None else (to, size + 1)


class LicenseScanner:
    """Base phrases and templates in one automaton. ``min_match``: words of a chained match, ``max_gap``: words
    between chained matches, ``cover``: the share of a template that gives its label."""

    def __init__(self, phrases: dict[str, str] | None = None, templates: dict[str, tuple[str, ...]] | None = None, min_match: int = 4, max_gap: int = 12, cover: float = 0.6):
        phrases, templates = BASE_PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
        self.min_match, self.max_gap, self.cover = min_match, max_gap, cover
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        self.templates = [(words_of(t.encode()), label) for label, texts in templates.items() for t in texts]
        self.auto = SuffixAutomaton()
        sequences = [t for t, _ in self.phrases + self.templates]
        for i, tokens in enumerate(sequences):
            self.auto.add(i, tokens)
        self.auto.finish()
        self.vocabulary = frozenset(w for t in sequences for w in t)
        n = len(self.phrases)
        #: per state: phrases that its strings end with, given that they are long enough
        self.phrase_at: list[list[int]] = [[] for _ in self.auto.step]
        for k, (tokens, _) in enumerate(self.phrases):
            at = 0
            for token in tokens:
                at = self.auto.step[at][token]
            self.phrase_at[at].append(k)
        for s in sorted(range(1, len(self.auto.step)), key=self.auto.length.__getitem__):
            self.phrase_at[s] = self.phrase_at[s] + self.phrase_at[self.auto.link[s]]
        self.template_at = [sorted((k - n, i) for k, i in ends if k >= n) for ends in self.auto.ends]

    def scan(self, text: bytes) -> dict:
        words = words_of(text)
        known = self.vocabulary
        walk, phrase_at = self.auto.walk, self.phrase_at
        state = size = 0
        at = -2
        places: list[tuple[int, int]] = []
        long: list[tuple[int, int, int]] = []
        for i in [i for i, w in enumerate(words) if w in known]:
            if i != at + 1:
                if size >= self.min_match:
                    long.append((at, size, state))
                state = size = 0
            before = (at, size, state)
            state, size = walk(state, size, words[i])
            if before[1] >= self.min_match and size <= before[1] and i == at + 1:
                long.append(before)
            at = i
            if phrase_at[state]:
                places.extend((i - n + 1, k) for k in phrase_at[state] if (n := len(self.phrases[k][0])) <= size)
        if size >= self.min_match:
            long.append((at, size, state))
        spans = self._best_of_each_place(self._chain(long))
        base = sorted({self.phrases[k][1] for _, k in places})
        own = {self.templates[t][1] for t, covered, *_ in spans if covered >= self.cover}
        score = max([1.0 if places else 0.0, *(covered for _, covered, *_ in spans)])
        starts = [s for s, _ in places]
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(base),
            "labels": ",".join(sorted(own.union(base))),
            "score": score,
            "spans": [{"label": self.templates[t][1], "start": a, "end": b, "coverage": c} for t, c, a, b in spans],
        }

    def _chain(self, long: list[tuple[int, int, int]]) -> list[tuple[int, float, int, int]]:
        """Per template the chains that overlap no better one: (template, share covered, first word, word after the last).

        The best chain is taken, its words are removed, and what is left on either side is searched again.
        """
        per: dict[int, list] = {}
        for at, size, state in long:
            for t, i in self.template_at[state]:
                per.setdefault(t, []).append((at - size + 1, at + 1, i - size + 1, i + 1))
        out = []
        for t, matches in per.items():
            pieces = self._apart(matches)
            while pieces:
                found = pieces.pop()
                covered, a, b = self._best(found)
                out.append((t, min(1.0, covered / len(self.templates[t][0])), a, b))
                left = [(p, min(q, a), c, d - max(0, q - a)) for p, q, c, d in found if min(q, a) - p >= self.min_match]
                right = [(max(p, b), q, c + max(0, b - p), d) for p, q, c, d in found if q - max(p, b) >= self.min_match]
                pieces += [*self._apart(left), *self._apart(right)]
        return sorted(out, key=lambda x: (self.templates[x[0]][1], x[2]))

    def _best_of_each_place(self, spans: list[tuple[int, float, int, int]]) -> list[tuple[int, float, int, int]]:
        """Spans without those that lie for the better part in a span that is better: of a larger share, then of more words."""
        rank = lambda x: (x[1], x[1] * len(self.templates[x[0]][0]))
        order = sorted(spans, key=lambda x: (x[2], x[3]))
        beaten = [False] * len(order)
        open_: list[int] = []
        for i, x in enumerate(order):
            open_ = [j for j in open_ if order[j][3] > x[2]]
            for j in open_:
                y = order[j]
                common = min(x[3], y[3]) - x[2]
                if rank(x) != rank(y):
                    worse, k = (x, i) if rank(x) < rank(y) else (y, j)
                    beaten[k] |= 2 * common >= worse[3] - worse[2]
            open_.append(i)
        kept = [x for x, gone in zip(order, beaten, strict=True) if not gone]
        return sorted(kept, key=lambda x: (self.templates[x[0]][1], x[2]))

    def _apart(self, found: list[tuple]) -> list[list[tuple]]:
        """Matches in pieces so far apart that no chain crosses; each piece by its matches' ends."""
        pieces: list[list[tuple]] = []
        end = 0
        for m in sorted(found):
            if not pieces or m[0] - end > self.max_gap:
                pieces.append([])
            pieces[-1].append(m)
            end = max(end, m[1])
        return [sorted(p, key=lambda m: (m[1], m[3])) for p in pieces]

    def _best(self, found: list[tuple]) -> tuple[int, int, int]:
        """Words covered, first word and word after the last of the chain that covers most."""
        best: list[tuple[int, int]] = []  # words covered, first word of the chain
        low = 0
        for j, (a, b, c, d) in enumerate(found):
            while low < j and found[low][1] < a - self.max_gap:
                low += 1
            top = (d - c, a)
            for h in range(low, j):
                pa_, pb, pc, pd_ = found[h]
                over = max(0, pb - a, pd_ - c)
                if pa_ < a and pc < c and over < d - c and c - pd_ <= self.max_gap and best[h][0] + d - c - over > top[0]:
                    top = (best[h][0] + d - c - over, best[h][1])
            best.append(top)
        most = max(n for n, _ in best)
        ties = [j for j, (n, _) in enumerate(best) if n == most]
        # of equal chains one in the middle, so that many copies in a row are halved; of those that overlap the first
        k = len(ties) // 2
        while k and found[ties[k - 1]][1] > best[ties[k]][1]:
            k -= 1
        return most, best[ties[k]][1], found[ties[k]][1]


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, coverage: double>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per text: its id, the contract's columns and the covered template ``spans``."""
    names = [f.split()[0] for f in re.sub(r"<.*>", "", FIELDS).split(", ")]
    kind = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))}
    made: list[LicenseScanner] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(LicenseScanner(**options))
        found = [made[0].scan(t) for t in as_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[n] for x in found], kind.get(n, pa.int64())) for n in names)], [id_col, *names])

    ids = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {ids}, {FIELDS}")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns of the contract over all documents; ``n_spans`` counts covered template spans."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")
