"""The jobs as queries: each runs twice into a folder of its own, which stays, and returns what stands there."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from jobs import edge_dataset, segment_documents
from weftline.plans import queries as plans
from weftline.plans.storage import base_dir
from weftline.plans.views import with_views


def _folder(spark: SparkSession, name: str) -> str:
    return f"{base_dir(spark)}/{name}-{uuid4().hex}"


def job1_segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of all documents; the second run finds nothing new."""
    at = _folder(spark, "job1")
    for _ in range(2):
        # a glob, as the table may be one file
        segment_documents.run(spark, f"{sf_dir}/documents.parquet*", f"{at}/segments", f"{at}/checkpoint")
    return segment_documents.output(spark, f"{at}/segments").drop("batch")


def job2_edge_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set of all volumes; the second run replaces it by the same rows."""
    at = _folder(spark, "job2")
    for _ in range(2):
        edge_dataset.run(spark, f"{sf_dir}/events.parquet", f"{sf_dir}/events.parquet", at)
    return plans.r6(edge_dataset.output(spark, at), "d", "dz", "dy", "dx", "score_i", "score_j")


def _cue(words: tuple[str, ...]) -> str:
    return f"len(list_filter(k, lambda w: lower(w) IN ({', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in words)})))"


_SEGMENTS = rf"""
WITH dk AS (SELECT row_number() OVER () AS doc_id, doc_id AS own_id, text, source FROM documents), {plans._CLASS.replace("FROM documents", "FROM dk").removeprefix("WITH ")},
sg AS (SELECT *, regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_\s]') AS k, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, line_start) AS n FROM cl)
SELECT dk.own_id AS doc_id, dk.source, 'seg_' || lpad(CAST(n AS VARCHAR), 4, '0') AS segment_id, section_no, section_type, classifier_rule, line_start, line_end, char_start, char_end, sha256(sg.text) AS sha256,
  substr(replace(sg.text, chr(10), ' '), 1, 160) AS preview, len(k) AS token_count, len(list_filter(k, lambda w: regexp_matches(w, '\pL'))) AS alphabetic_token_count, len(list_filter(k, lambda w: regexp_full_match(w, '\p{{Nd}}+'))) AS digit_token_count,
  len(list_filter(k, lambda w: regexp_full_match(w, '[^\pL\pN]+'))) AS punctuation_token_count, len(regexp_extract_all(sg.text, '[?¿]')) AS question_mark_count, {_cue(plans.text_analysis.ABSOLUTE_CUES)} AS absolute_cue_count,
  {_cue(plans.text_analysis.NEGATION_CUES)} AS negation_cue_count, {_cue(plans.text_analysis.MODAL_CUES)} AS modal_cue_count, paragraph_type
FROM sg JOIN dk ON dk.doc_id = sg.doc_id
"""
_EDGES = f"""WITH {plans._NEG}, pi AS (SELECT volume, node_id, row_number() OVER (PARTITION BY volume ORDER BY node_id) - 1 AS p FROM (SELECT volume, i AS node_id FROM sn UNION SELECT volume, j FROM sn))
SELECT bp.volume, bp.t, bp.i, bp.j, round(d, 6) AS d, round(dz, 6) AS dz, round(dy, 6) AS dy, round(dx, 6) AS dx, round(score_i, 6) AS score_i, round(score_j, 6) AS score_j, bp.label, a.p AS patch_i, b.p AS patch_j, CASE WHEN bp.t < 80 THEN 'train' ELSE 'val' END AS split
FROM bp JOIN sn ON sn.volume = bp.volume AND sn.i = bp.i AND sn.j = bp.j JOIN pi a ON a.volume = bp.volume AND a.node_id = bp.i JOIN pi b ON b.volume = bp.volume AND b.node_id = bp.j WHERE bp.t >= 0 AND bp.t < 100"""

QUERIES = {"job1_segment_documents": job1_segment_documents, "job2_edge_dataset": job2_edge_dataset}
ORACLES = {"job1_segment_documents": _SEGMENTS, "job2_edge_dataset": with_views(_EDGES)}
