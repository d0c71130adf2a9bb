"""A deterministic analysis run over text files: artifacts, their hashes, a manifest and an event log.

Texts are read, segmented and measured by Spark in one plan; what belongs to a
document is grouped under it, bounded by its text, and the tasks write its
folder. ``output_root`` must be a folder that all machines mount, as the files
are plain ones. Writing is repeatable: a task that runs again writes the same bytes.
"""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import text_analysis as ta
from weftline.sources.tables import canonical_json, write_artifact

SEGMENT_COLUMNS = ["segment_id", "section_no", "section_type", "paragraph_type", "classifier_rule", "line_start", "line_end", "char_start", "char_end", "sha256", "preview"]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """name and text of files; bytes that are no UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("input_sha256"))


def _grouped(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Per document its rows, in the order of the first column, as an array of structs."""
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def artifacts(docs: DataFrame, markers: list[dict] | None = None, rules=ta.DEFAULT_RULES) -> DataFrame:
    """One row per document: doc_id, text, input_sha256, sections, segments, counts, metrics."""
    lines = ta.lines(docs)
    sections = ta.sections(lines, markers or [])
    segments = ta.segments(ta.classify(ta.paragraphs(lines, sections), rules))
    counts = segments.groupBy("doc_id", "paragraph_type").agg(F.count("*").alias("n"))
    metrics = ta.lexical_metrics(docs)
    kept = [c for c in metrics.columns if c not in ("doc_id", "text", "input_sha256")]
    rows = docs.join(metrics.select("doc_id", F.struct(*kept).alias("metrics")), "doc_id")
    for found in (_grouped(sections, ["section_no", *[c for c in sections.columns if c not in ("doc_id", "section_no")]], "sections"), _grouped(segments, SEGMENT_COLUMNS, "segments"), _grouped(counts, ["paragraph_type", "n"], "counts")):
        rows = rows.join(found, "doc_id", "left")
    return rows


def _write(doc: dict, root: str, config: bytes) -> dict:
    """Writes a document's folder and returns its manifest."""
    run = ta.run_id(doc["input_sha256"], _sha(config))
    folder = Path(root) / run
    normalized = doc["text"].replace("\r\n", "\n").replace("\r", "\n")
    rows = doc["segments"] or []
    files = {
        "config.json": config,
        "normalized.txt": normalized.encode(),
        "sections.jsonl": _jsonl(doc["sections"] or []),
        "segments.jsonl": _jsonl([{"run_id": run, **r} for r in rows]),
        "counts.json": canonical_json({r["paragraph_type"]: r["n"] for r in doc["counts"] or []}),
        "metrics.json": canonical_json(doc["metrics"]),
    }
    hashes = {name: write_artifact(folder / name, data) for name, data in files.items()}
    events = [{"step": i, "event": "wrote", "artifact": name, "sha256": h} for i, (name, h) in enumerate(hashes.items())]
    hashes["events.jsonl"] = write_artifact(folder / "events.jsonl", _jsonl(events))
    manifest = {"run_id": run, "document": doc["doc_id"], "input_sha256": doc["input_sha256"], "config_sha256": _sha(config), "artifacts": hashes, "segments": len(rows)}
    write_artifact(folder / "manifest.json", canonical_json(manifest))
    return manifest


def analyze(spark: SparkSession, path: str, output_root: str, markers: list[dict] | None = None, rules=ta.DEFAULT_RULES) -> list[dict]:
    """Writes a folder per document under ``output_root`` and returns the manifests, by document. The same input and
    configuration give the same run id and the same bytes."""
    config = canonical_json({"markers": markers or [], "rules": [list(r) for r in rules]})

    def run(batches):
        for batch in batches:
            made = [_write(doc, output_root, config) for doc in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([m["document"] for m in made], pa.string()), pa.array([json.dumps(m) for m in made], pa.string())], ["doc_id", "manifest"])

    written = artifacts(read_texts(spark, path), markers, rules).mapInArrow(run, "doc_id string, manifest string").collect()
    return [json.loads(r.manifest) for r in sorted(written, key=lambda r: r.doc_id)]


def _jsonl(rows: list[dict]) -> bytes:
    return "".join(json.dumps(r, ensure_ascii=False, sort_keys=True) + "\n" for r in rows).encode()


def _sha(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()
