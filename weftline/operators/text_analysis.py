"""Deterministic text segmentation and lexical metrics over many documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cue words of the lexical metrics.
ABSOLUTE_CUES = ("all", "always", "any", "every", "exactly", "never", "no", "only")
NEGATION_CUES = ("can't", "cannot", "dont", "don't", "never", "no", "not", "won't", "without")
MODAL_CUES = ("can", "could", "may", "might", "must", "need", "needs", "required", "should", "will", "would")
# What a code line starts with.
CODE_STARTS = ("from ", "import ", "def ", "class ", "try:", "except", "return ", "@", "with ", "for ", "if ", "elif ", "else:", "while ", "print(")


def normalize_newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


#: A word character: letters, numbers and the underscore of all scripts.
_W, _NOT_W = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_\s]"


def tokens(text: Column) -> Column:
    """Unicode word runs and single other symbols."""
    return F.regexp_extract_all(text, F.lit(f"(?U){_W}+|{_NOT_W}"), F.lit(0))


def lexical_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts of tokens by kind, question marks and cue words.

    One scan makes every run of word characters with a letter, and the spaces behind it, a single letter; the kinds are
    counted in the short text that is left, so no list of all tokens is built. Cue words have a scan of their own. Those
    with an apostrophe never count, as the tokenizer splits them.
    """
    every = sorted({w for w in ABSOLUTE_CUES + NEGATION_CUES + MODAL_CUES if w.isalpha()})
    first, second = ("".join(sorted({c for w in every for c in (w[k], w[k].upper())})) for k in (0, 1))
    # a character that is no word's, then cheap tests, which few places pass; one first letter with another word's rest is
    # dropped by isin. A look behind would take half of a character beyond 16 bits
    cue = rf"[^\p{{L}}\p{{N}}_]([{first}](?=[{second}])(?i:{'|'.join(sorted({w[1:] for w in every}))})(?!{_W}))"
    # the test behind the first number keeps long runs of numbers linear
    worded = rf"(?:\p{{L}}++|[\p{{N}}_](?<![\p{{N}}_].)[\p{{N}}_]*+\p{{L}}++)(?:[\p{{N}}_]{_W}*+)?+ *+"
    gone = lambda c, pattern, by="": F.regexp_replace(c, F.lit(pattern), F.lit(by))
    found = lambda c, pattern, group=0: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({"_cues": F.transform(found(F.concat(F.lit(" "), body), cue, 1), F.lower), "_short": gone(body, worded, "a")})
    d = d.withColumns({"_numbers": found("_short", r"[\p{N}_]++"), "_rest": gone("_short", r"[\p{N}_\p{IsWhite_Space}]++")})
    d = d.withColumn("_symbols", F.replace("_rest", F.lit("a"), F.lit("")))
    numbers = lambda pattern: F.size(F.filter("_numbers", lambda w: w.rlike(pattern)))
    cues = lambda words: F.size(F.filter("_cues", lambda c: c.isin(list(words)))).cast("long")
    return d.withColumns({
        "token_count": (F.char_length("_rest") + F.size("_numbers")).cast("long"), "alphabetic_token_count": (F.char_length("_rest") - F.char_length("_symbols")).cast("long"), "digit_token_count": numbers(r"\A\p{Nd}++\z").cast("long"),
        "punctuation_token_count": (F.char_length("_symbols") + numbers(r"\A_++\z")).cast("long"), "question_mark_count": F.regexp_count("_symbols", F.lit("[?¿]")).cast("long"),
        "absolute_cue_count": cues(ABSOLUTE_CUES), "negation_cue_count": cues(NEGATION_CUES), "modal_cue_count": cues(MODAL_CUES),
    }).drop("_cues", "_short", "_numbers", "_rest", "_symbols")


def lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """line_no (from 1), line, and its character range [char_start, char_end) without the newline. A final newline ends
    the last line and begins none; empty texts have no lines. ``keep`` names columns that the lines get of their document.

    Documents are dealt by id before they are cut, so that what follows by id, here and in the steps below, needs no
    further shuffle of lines.
    """
    d = docs.select(id_col, *keep, F.col(text).alias("_b")).where("_b <> ''").repartition(F.col(id_col))
    d = d.withColumn("_b", normalize_newlines(F.col("_b")))
    d = d.withColumn("_b", F.when(F.endswith("_b", F.lit("\n")), F.expr("left(_b, char_length(_b) - 1)")).otherwise(F.col("_b")))
    parts = F.split("_b", "\n", -1)
    placed = d.select(id_col, *keep, F.posexplode(parts).alias("pos", "line")).withColumn("line_no", (F.col("pos") + 1).cast("long"))
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("char_start", F.coalesce(F.sum(F.char_length("line").cast("long") + 1).over(w), F.lit(0)))
    return placed.select(id_col, "line_no", "line", "char_start", (F.col("char_start") + F.char_length("line")).alias("char_end"), *keep)


def _hits(lines_: DataFrame, markers: list[dict], id_col: str) -> DataFrame:
    """Adds for each marker, by its name behind ``_at_``, its first line in the document; one sort by document and line."""
    w = Window.partitionBy(id_col).orderBy("line_no")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    deepest = max([len(m["value"]) for m in markers if m["match"] == "sequence"], default=2)
    ahead = lines_.withColumns({f"_l{k}": F.lead("line", k).over(w) for k in range(1, max(2, deepest))})
    for m in markers:
        if m["match"] == "sequence":
            hit = F.col("line") == m["value"][0]
            for k, v in enumerate(m["value"][1:], 1):
                hit = hit & (F.col(f"_l{k}") == v)
        else:
            hit = F.col("line") == m["value"]
            if m["match"] == "lookahead":
                hit = hit & F.col("_l1").startswith(m["next_prefix"])
        hit = hit & F.col(id_col).isNotNull()
        if m.get("after"):
            hit = hit & (F.col("line_no") > F.col(f"_at_{m['after']}"))
        ahead = ahead.withColumn(f"_at_{m['name']}", F.min(F.when(hit, F.col("line_no"))).over(whole))
    return ahead.drop(*[f"_l{k}" for k in range(1, max(2, deepest))])


def find_markers(lines_: DataFrame, markers: list[dict], id_col: str = "doc_id", required: bool = False) -> DataFrame:
    """First line of each marker per document. A marker has a name, a value and a match: ``exact``, ``lookahead`` (with
    ``next_prefix``) or ``sequence`` (a list as value); ``after`` names a marker that must come before.

    With ``required``, a document without a marker raises ValueError.
    """
    names = [m["name"] for m in markers]
    hits = _hits(lines_.select(id_col, "line_no", "line"), markers, id_col)
    found = hits.groupBy(id_col).agg(*[F.max(f"_at_{n}").alias(n) for n in names]) if names else hits.select(id_col).distinct()
    if required and (lost := found.where(" or ".join(f"`{n}` is null" for n in names)).limit(1).count()):
        raise ValueError(f"markers missing in {lost} document or more")
    return found


def in_sections(lines_: DataFrame, markers: list[dict], id_col: str = "doc_id") -> DataFrame:
    """The lines with section_no and section_type: each marker begins a section of its ``type`` up to the next; the lines
    before are ``preamble``. Of markers at one line the first in the list gives the type. Lines without an id are
    in no section."""
    marked = _hits(lines_.where(F.col(id_col).isNotNull()), markers, id_col)
    at = [(F.col(f"_at_{m['name']}"), m["type"]) for m in markers]
    last = F.greatest(F.lit(1).cast("long"), F.lit(0).cast("long"), *[F.when(c <= F.col("line_no"), c) for c, _ in at])
    kind = F.lit("preamble")
    for c, k in reversed(at):
        kind = F.when(c == F.col("_from"), k).otherwise(kind)
    begun = F.array_distinct(F.filter(F.array(F.lit(1).cast("long"), *[c for c, _ in at]), lambda x: x <= F.col("line_no")))
    placed = marked.withColumn("_from", last).withColumns({"section_no": F.size(begun), "section_type": kind})
    return placed.drop("_from", *[f"_at_{m['name']}" for m in markers])


def sections(lines_: DataFrame, markers: list[dict], id_col: str = "doc_id") -> DataFrame:
    """Ranges of lines of the sections of ``in_sections``."""
    placed = in_sections(lines_.select(id_col, "line_no", "line"), markers, id_col)
    ranged = placed.groupBy(id_col, "section_no", "section_type").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"))
    return ranged.select(id_col, "section_no", "section_type", "line_start", "line_end")


def paragraphs(lines_: DataFrame, sections_: DataFrame | None = None, id_col: str = "doc_id", blank: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Maximal runs of lines that aren't blank, within sections: line and character ranges, text, lines as array.

    Sections are those of the table, or else of the lines' own section_no and section_type (``in_sections``), which saves
    a join; without either all is ``preamble``. ``keep`` names columns of the document that the lines have.
    """
    blank = F.trim("line") == "" if blank is None else blank
    placed = lines_.withColumn("_blank", blank.cast("int"))
    if sections_ is not None:
        # one row per document and section: lines look theirs up by a range within the document
        s = sections_.select(id_col, "section_no", "section_type", "line_start", "line_end")
        placed = placed.join(s, id_col).where("line_no between line_start and line_end").drop("line_start", "line_end")
    elif "section_no" not in lines_.columns:
        placed = placed.withColumns({"section_no": F.lit(1), "section_type": F.lit("preamble")})
    # sections are ranges of lines, so the order by line is theirs too
    island = F.sum("_blank").over(Window.partitionBy(id_col).orderBy("line_no"))
    runs = placed.withColumn("_island", island).where("_blank = 0")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    own = [F.first(c).alias(c) for c in keep]
    grouped = runs.groupBy(id_col, "section_no", "section_type", "_island").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), listed.alias("lines"), *own)
    return grouped.drop("_island").withColumn("text", F.array_join("lines", "\n"))


def is_code_line(line: Column) -> Column:
    """Begins like code, assigns, or is a short head that ends with a colon."""
    s = F.trim(line)
    begins = F.lit(False)
    for c in CODE_STARTS:
        begins = begins | s.startswith(c)
    assigns = s.contains("=") & ~s.contains("==") & ~s.endswith("?")
    head = s.endswith(":") & (F.size(F.split(s, r"\s+")) <= 6)
    return (s != "") & (begins | assigns | head)


#: Rules in order; the first that holds gives type and rule name. ``when`` is SQL over section_type, text, lower, first
#: and code_share. The document-specific rules of an analysis are passed in the same form.
DEFAULT_RULES = (
    ("notebook_code_paste", "notebook_code_likeness>=0.35", "section_type like 'notebook%' and code_share > 0 and code_share >= 0.35"),
    ("notebook_runtime_output", "notebook_fallback", "section_type like 'notebook%'"),
    ("transcript_user_text", "question_pattern", "text like '%?%' and (lower like 'ok %' or lower like '%explic%')"),
    ("transcript_assistant_text", "transcript_fallback", "section_type like 'transcript%'"),
    ("preamble_instruction", "preamble", "section_type = 'preamble'"),
)


# Texts by which the rules of a chat export's analysis know a paragraph.
CLOSING_TAGS = ("</think>", "</antmlThinking>")
FINISHED_LINE = "Pensamiento completado"
META_PHRASES = ("wait, i should make sure", "let's refine", "this looks perfect")
PERSONA_OPENINGS = ("cold coffee", "pulls my oversized", "i pull my oversized")
QUESTION_OPENINGS = ("ok ", "pero ", "ayud", "inm ")
QUESTION_PHRASE = "explic"
AFFECTIONATE_PHRASES = ("my love", "mi amor", "cariño", "te amo", "te adoro")


def _any(test: str, column: str, values: tuple[str, ...]) -> str:
    """SQL: some value passes the test (startswith, contains) on a column."""
    quoted = ["'" + v.replace("'", "\\'") + "'" for v in values]
    return "(" + " or ".join(f"{test}({column}, {q})" for q in quoted) + ")"


#: The rules of a chat export's analysis as data, in order.
CONTEXT_RULES = (
    ("reasoning_tag_artifact", f"exact_line:{FINISHED_LINE}", f"first = '{FINISHED_LINE}'"),
    ("reasoning_tag_artifact", "exact_thought_closing_tag", f"first in {CLOSING_TAGS}"),
    ("notebook_code_paste", "major_section_notebook_and_code_likeness>=0.35", "section_type like 'notebook%' and code_share >= 0.35"),
    ("notebook_runtime_output", "major_section_notebook_fallback", "section_type like 'notebook%'"),
    ("dataset_description", "major_section_dataset", "section_type = 'dataset_description'"),
    ("ui_footer_artifact", "major_section_footer", "section_type = 'ui_footer_artifact'"),
    ("meta_reasoning", "meta_reasoning_phrase", _any("contains", "lower", META_PHRASES)),
    ("preamble_instruction", "persona_opening_phrase", _any("startswith", "lower", PERSONA_OPENINGS)),
    ("transcript_user_text", "question_pattern", f"contains(text, '?') and ({_any('startswith', 'lower', QUESTION_OPENINGS)} or contains(lower, '{QUESTION_PHRASE}'))"),
    ("transcript_assistant_text", "affectionate_assistant_phrase", _any("contains", "lower", AFFECTIONATE_PHRASES)),
    ("transcript_assistant_text", "major_section_transcript_fallback", "section_type like 'transcript%'"),
    ("preamble_instruction", "major_section_preamble", "section_type = 'preamble_instruction'"),
)


def classify(paragraphs_: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    """Adds paragraph_type and classifier_rule; ``other`` by ``fallback`` where no rule holds."""
    share = F.size(F.filter("lines", is_code_line)) / F.size("lines")
    p = paragraphs_.withColumns({"code_share": share, "lower": F.lower("text"), "first": F.trim(F.col("lines")[0])})
    kind, name = F.lit("other"), F.lit("fallback")
    for k, n, when in reversed(rules):
        kind, name = F.when(F.expr(when), k).otherwise(kind), F.when(F.expr(when), n).otherwise(name)
    return p.withColumns({"paragraph_type": kind, "classifier_rule": name}).drop("lower", "first")


def segments(classified: DataFrame, id_col: str = "doc_id", preview: int = 160) -> DataFrame:
    """Adds segment_id (seg_0001 on, in document order), the text's SHA-256 and a preview without newlines."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy("section_no", "line_start"))
    return classified.withColumns({"segment_id": F.concat(F.lit("seg_"), F.lpad(n.cast("string"), 4, "0")), "sha256": F.sha2(F.col("text").cast("binary"), 256), "preview": F.substring(F.regexp_replace("text", "\n", " "), 1, preview)})


def section_blocks(segments_: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adjacent segments of one section and type as one block: its lines and number of segments."""
    w = Window.partitionBy(id_col).orderBy("section_no", "line_start")
    change = F.coalesce((F.lag("paragraph_type").over(w) != F.col("paragraph_type")) | (F.lag("section_no").over(w) != F.col("section_no")), F.lit(True))
    marked = segments_.withColumn("_change", change).withColumn("block_no", F.sum(F.col("_change").cast("int")).over(w))
    return marked.groupBy(id_col, "section_no", "paragraph_type", "block_no").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.count("*").alias("n_segments"))


def counts_by_type(segments_: DataFrame) -> DataFrame:
    return segments_.groupBy("paragraph_type").agg(F.count("*").alias("n"))


def run_id(input_sha: str, config_sha: str) -> str:
    """Name of an analysis run by the hashes of its input and configuration."""
    return f"trace_{input_sha[:12]}_{config_sha[:12]}"


# ---------------------------------------------------------------- statistics


def describe(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """count, mean, median, min, max, p10 and p90 (linear) of the values that aren't null."""
    keep = rows.where(F.col(value).isNotNull())
    p = lambda q: F.expr(f"percentile(`{value}`, {q})")
    return keep.groupBy(*(keys or [])).agg(F.count("*").alias("count"), F.avg(value).alias("mean"), p(0.5).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), p(0.1).alias("p10"), p(0.9).alias("p90"))


def value_counts(rows: DataFrame, value: str, top: int | None = None) -> DataFrame:
    """Counts by value; the ``top`` most frequent, equal counts by value, where asked for."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), value).limit(top) if top else counts
