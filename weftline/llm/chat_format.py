r"""Chat formatting: typed content parts.

A message holds a list of parts (text, image, audio, document). A visitor
flattens them into one ordered string: texts are escaped, other parts become
placeholders, and the visitor records an attachment reference and the number of
tokens that each placeholder expands to. Turns are marked by control strings;
inside texts a backslash breaks every control string, so that formatting can be
read back exactly.

Conversations are stored as strings with loss masks: spans, counted from the
conversation's start, of the assistant's text. Turns are dealt out by
conversation and streamed; a conversation longer than ``chunk`` characters is
stored in several rows, cut between turns, so nothing larger than a chunk or a
single turn is held. Reading back parses the stored strings and takes the
trained text from the spans alone; only conversations of several rows are dealt
out again.

Defined cases: null text is empty, null role is the empty role, null turns come
first, a null conversation id is a conversation of its own; rows with equal
turns are ordered by role, then text; repeated rows are repeated turns; a null
list of parts is empty; parts of unknown type raise ValueError; very long texts
are whole; other columns are not read, whatever their names, or stay as they are
in ``format_turns``; an empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import materialize, slices, table

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that steer a model; texts never contain them unbroken.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile(f"(?={'|'.join(map(re.escape, CONTROL))})(.)", re.DOTALL)  # overlapping ones too
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    r"""Double backslashes, then break each control string by a backslash after its first character."""
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


@dataclass
class PartVisitor:
    """Flattens the parts of one message. ``*_tokens``: what a placeholder of the kind expands to, per unit."""

    image_patch: int = 14
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 512
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        handler = getattr(self, f"visit_{part.get('type')}", None)
        if handler is None:
            raise ValueError(f"unknown part type: {part.get('type')!r}")
        handler(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (-(-max(0, int(part.get(k) or 0)) // self.image_patch) for k in ("width", "height"))
        self._place("image", part, max(1, across * down))

    def visit_audio(self, part: dict) -> None:
        self._place("audio", part, max(1, round(float(part.get("seconds") or 0) * self.audio_tokens_per_second)))

    def visit_document(self, part: dict) -> None:
        self._place("document", part, max(1, int(part.get("pages") or 0) * self.document_tokens_per_page))

    def _place(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref") or "", "position": len(self.attachments), "tokens": tokens})
        self.pieces.append(f"<|{kind}:{len(self.attachments) - 1}|>")


def format_turn(role: str | None, parts: list[dict], visitor: PartVisitor | None = None) -> tuple[str, list[dict]]:
    """One turn's string and its attachments, which are numbered within the turn."""
    visitor = visitor or PartVisitor()
    for part in parts:
        visitor.visit(part)
    return f"{OPEN}{escape(role or '')}{MIDDLE}{''.join(visitor.pieces)}{CLOSE}\n", visitor.attachments


_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(CLOSE)}\n", re.DOTALL)
_PLACE = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def parse_turns(formatted: str) -> Iterator[tuple[str, list[dict]]]:
    """(role, parts) of each turn of a formatted string; the exact inverse of ``format_turn`` but for part sizes."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        parts, last = [], 0
        for p in _PLACE.finditer(m[2]):
            if p.start() > last:
                parts.append({"type": "text", "text": unescape(m[2][last : p.start()])})
            parts.append({"type": p[1], "position": int(p[2])})
            last = p.end()
        if last < len(m[2]) or not parts:
            parts.append({"type": "text", "text": unescape(m[2][last:])})
        yield unescape(m[1]), parts
    if at != len(formatted):
        raise ValueError("text after the last turn")


def format_turns(rows: DataFrame) -> DataFrame:
    """Turn rows with ``role`` and ``parts`` (array of structs) or ``text``: adds ``formatted``, ``attachments`` and ``n_placeholder_tokens``.

    The columns of the input stay, but for clashing names, which are replaced.
    """
    typed = "parts" in rows.columns
    # one column that the function reads; what it adds comes back beside the untouched row
    message = F.struct(F.col("role"), F.col("parts") if typed else F.col("text"))

    @F.pandas_udf("formatted string, attachments array<struct<kind: string, ref: string, position: int, tokens: long>>, n_placeholder_tokens long")
    def made(x):
        import pandas as pd

        out = []
        for role, content in zip(x.iloc[:, 0], x.iloc[:, 1], strict=True):
            parts = [{"type": "text", "text": content}] if not typed else [p if isinstance(p, dict) else p.asDict() for p in (content if content is not None else [])]
            out.append(format_turn(role, parts))
        return pd.DataFrame({"formatted": [f for f, _ in out], "attachments": [a for _, a in out], "n_placeholder_tokens": [sum(y["tokens"] for y in a) for _, a in out]})

    kept = [c for c in rows.columns if c not in ("formatted", "attachments", "n_placeholder_tokens")]
    return rows.select(*kept, made(message).alias("_made")).select(*kept, "_made.*")


# ---------------------------------------------------------------- stored conversations


@dataclass
class Chunk:
    """What is formatted of the conversation that streams by and not yet stored."""

    key: object
    number: int = 0
    start: int = 0  # characters of the conversation before this chunk
    size: int = 0
    placeholder_tokens: int = 0
    pieces: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def add(self, role: str | None, parts: list[dict], trained: str) -> None:
        """One turn. The mask covers the parts of the trained role's turn, without what marks the turn."""
        formatted, attached = format_turn(role, parts)
        if role == trained:
            ahead = len(OPEN) + len(escape(role)) + len(MIDDLE)
            length = len(formatted) - ahead - len(CLOSE) - 1
            if length:
                self.spans.append((self.start + self.size + ahead, length))
        self.pieces.append(formatted)
        self.size += len(formatted)
        self.attachments += attached
        self.placeholder_tokens += sum(a["tokens"] for a in attached)

    def row(self, last: bool) -> tuple:
        return (self.key, self.number, last, self.start, "".join(self.pieces), [{"start": a, "length": n} for a, n in self.spans], self.attachments, self.placeholder_tokens)

    def following(self) -> Chunk:
        return Chunk(self.key, self.number + 1, self.start + self.size)


STORED = (
    "conv_id long, chunk long, last boolean, start long, formatted string, loss array<struct<start: long, length: long>>, "
    "attachments array<struct<kind: string, ref: string, position: int, tokens: long>>, n_placeholder_tokens long"
)
_STORED = pa.schema([
    ("conv_id", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("start", pa.int64()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("position", pa.int32()), ("tokens", pa.int64())]))), ("n_placeholder_tokens", pa.int64()),
])


def text_parts() -> Column:
    """A text column as a list of one typed part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))


def format_conversations(turns: DataFrame, trained: str = "assistant", chunk: int = 4_000_000) -> DataFrame:
    """Turn rows (conv_id, turn, role, and parts or text) as formatted conversations with loss masks: one row each, or one
    per ``chunk`` characters. Attachments are numbered within their turn."""
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.col("role")]
    if "parts" in turns.columns:
        narrow = turns.select(*columns, F.coalesce("parts", F.array()).alias("parts")).withColumn("_order", F.to_json("parts"))
    else:
        narrow = turns.select(*columns, text_parts().alias("parts"), F.col("text").alias("_order"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Chunk | None = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STORED, strict=True)], schema=_STORED)

        for batch in batches:
            for part in slices(batch, 2000, 16):
                done, held = [], 0
                for key, role, parts in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    if now is None or now.key != key:
                        if now is not None:
                            done.append(now.row(True))
                            held += now.size
                        now = Chunk(key)
                    elif now.size >= chunk:
                        done.append(now.row(False))
                        held += now.size
                        now = now.following()
                    now.add(role, parts, trained)
                    if held >= 16_000_000:
                        yield batch_of(done)
                        done, held = [], 0
                if done:
                    yield batch_of(done)
        if now is not None:
            yield batch_of([now.row(True)])

    dealt = narrow.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "_order")
    return dealt.select("conv_id", "role", "parts").mapInArrow(run, STORED)


@dataclass
class _Digest:
    """What is known of the conversation that is read back."""

    key: object
    turns: int = 0
    chars: int = 0
    loss_chars: int = 0
    all: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, formatted: str, start: int, spans: list[dict]) -> None:
        """The next stored string. Turns come from its marks, trained text from its mask."""
        if start != self.chars:
            raise ValueError("a chunk is missing")
        for role, parts in parse_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{''.join(p.get('text', '') for p in parts)}\n".encode())
        for span in spans:
            at = span["start"] - start
            if at < 0 or at + span["length"] > len(formatted):
                raise ValueError("a span leaves its chunk")
            text = unescape(_PLACE.sub("", formatted[at : at + span["length"]]))
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return (self.key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_stored(stored: DataFrame) -> DataFrame:
    """Digests of stored conversations, read back. Placeholders are no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [f.split()[0] for f in DIGEST.split(", ")]
        for batch in batches:
            for part in slices(batch, 2000, 16):
                done = []
                for key, number, last, start, formatted, spans in zip(*(part.column(i).to_pylist() for i in range(6)), strict=True):
                    if number == 0:
                        now = _Digest(key)
                    now.add(formatted, start, spans)
                    if last:
                        done.append(now.row())
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    columns = ["conv_id", "chunk", "last", "start", "formatted", "loss"]
    whole = stored.where("chunk = 0 and last").select(*columns).mapInArrow(run, DIGEST)
    cut = stored.where("not (chunk = 0 and last)").select(*columns).repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "chunk")
    return whole.unionByName(cut.mapInArrow(run, DIGEST))


def digest_conversations(turns: DataFrame, **options) -> DataFrame:
    """Format and store conversations, read them back, and digest them."""
    return digest_stored(materialize(format_conversations(turns, **options), "conversations"))


def probe_conversation(spark: SparkSession) -> DataFrame:
    """The conversation -7 of the contract: both turns say what looks like control strings."""
    return spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn int, role string, text string")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    columns = ["conv_id", "turn", "role", "text"]
    return digest_conversations(table(spark, sf_dir, "conversations").select(*columns).unionByName(probe_conversation(spark)))


def _sql_escaped(column: str) -> str:
    """SQL of an escaped text's length: backslashes count twice, each control string gets one more character."""
    doubled = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    more = " + ".join(f"(length({doubled}) - length(replace({doubled}, '{c}', ''))) // {len(c)}" for c in CONTROL)
    return f"length({doubled}) + {more}"


OP10_SQL = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + len(MIDDLE) + len(CLOSE) + 1} + {_sql_escaped("role")} + {_sql_escaped("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
