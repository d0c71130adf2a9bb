"""Segments of new documents, as they arrive.

Reads a folder of Parquet files (or a glob) as a file stream, cuts each document
into sections at marker lines and into paragraphs, classifies these by rules and
measures them, and writes a row per segment, partitioned by micro-batch and type.

The stream's checkpoint is the mark of what was read: a run takes the files that
came since the last one, in batches of a bounded number of files, and ends. A batch
owns the folder of its number, which it replaces, so a batch that is repeated after
a failure leaves the same rows once. Files are taken as immutable: a file that
changes under its name is not read again.

Documents are told apart by their file and row, so repeated and missing ids are
documents of their own. Null and empty texts have no segments. A run without new
files writes nothing.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs._command import command, configuration, written
from weftline.operators import text_analysis as ta

LOG = logging.getLogger("jobs.segment_documents")
RULES = {"default": ta.DEFAULT_RULES, "chat_export": ta.CONTEXT_RULES}
_COUNTS = ("token_count", "alphabetic_token_count", "digit_token_count", "punctuation_token_count", "question_mark_count", "absolute_cue_count", "negation_cue_count", "modal_cue_count")
_SEGMENT = ("segment_id string", "section_no long", "section_type string", "classifier_rule string", "line_start long", "line_end long", "char_start long", "char_end long", "sha256 string", "preview string", *[f"{c} long" for c in _COUNTS])


def output_schema(config: dict) -> str:
    kinds = dict(field.split() for field in config["schema"].split(", "))
    return ", ".join([*[f"{c} {kinds[c]}" for c in (config["id"], *config["keep"])], *_SEGMENT, "batch long", "paragraph_type string"])


def segments(docs: DataFrame, config: dict) -> DataFrame:
    """A row per segment. ``docs`` have a ``key`` of their own beside the columns that the configuration names."""
    # documents are shuffled once, with what their segments keep of them; all steps then work where their lines are
    docs = docs.select("key", F.col(config["text"]).alias("text"), F.struct(config["id"], *config["keep"]).alias("_own"))
    lines = ta.in_sections(ta.lines(docs, "key", "text", ("_own",)), config["markers"], "key")
    blank = F.char_length(F.trim("line")) == 0 if not config["blank_below"] else F.char_length("line") < config["blank_below"]
    paragraphs = ta.paragraphs(lines, None, "key", blank, ("_own",))
    found = ta.segments(ta.classify(paragraphs, RULES[config["rules"]]).drop("lines"), "key")
    measured = ta.lexical_metrics(found, "text").withColumn("section_no", F.col("section_no").cast("long"))
    return measured.select("_own.*", "paragraph_type", *[field.split()[0] for field in _SEGMENT])


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Segments the documents that came since the last run. Returns how many rows were read, and batches and segments written."""
    config = config or configuration("segment_documents")
    done = {"read": 0, "batches": 0, "written": 0}

    def write(batch: DataFrame, number: int) -> None:
        at = f"{output}/batch={number}"
        read = batch.count()
        # the replaced folder is this batch's own; partitions are as large as the session's advisory size
        segments(batch, config).hint("rebalance", "paragraph_type").write.mode("overwrite").partitionBy("paragraph_type").parquet(at)
        made = written(batch.sparkSession, at, output_schema(config)).count()
        for what, n in (("read", read), ("batches", 1), ("written", made)):
            done[what] += n
        LOG.info("batch %d: %d documents, %d segments to %s", number, read, made, at)

    stream = spark.readStream.schema(config["schema"]).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(input)
    docs = stream.select(F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("key"), config["id"], config["text"], *config["keep"])
    query = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("read %d new documents of %s; %d batches, %d segments", done["read"], input, done["batches"], done["written"])
    return done


def output(spark: SparkSession, path: str, config: dict | None = None) -> DataFrame:
    """All segments written so far, by any run."""
    return written(spark, path, output_schema(config or configuration("segment_documents")))


if __name__ == "__main__":
    command("segment_documents", run, {"input": "folder or glob of Parquet files", "output": "folder of the segments", "checkpoint": "folder of the stream's checkpoint"})
