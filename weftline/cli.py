"""Command line: each stage from files to files, ``python -m weftline.cli STAGE --help``.

Tables are CSV with a header, or Parquet where the name ends so.
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline import schema
from weftline.operators import bricks, detection, divisions, evaluation, formatting, pairs, tracking
from weftline.sources import chunked, lineage_store, tables


def _read(spark: SparkSession, path: str, s: T.StructType | None = None) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return tables.read_csv(spark, path, s) if s is not None else spark.read.csv(path, header=True, inferSchema=True)


def _write(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        tables.write_csv(df, path, order)


def _scales(text: str) -> tuple[tuple[float, float], ...]:
    """``small,large;small,large`` in micrometres."""
    return tuple(tuple(float(x) for x in pair.split(",")) for pair in text.split(";"))


def _frames(spark: SparkSession, path: str) -> DataFrame:
    chunked.register(spark)
    return spark.read.format("chunked_frames").load(path)


def detect(spark, a) -> None:
    if a.version == 1:
        whole, in_bricks = detection.detect_v1, bricks.detect_bricks_v1
        options = {"sigmas": tuple(float(x) for x in a.sigmas.split(",")), "quantile": a.quantile, "min_score": a.min_score, "most": a.max, "least": a.min, "k": a.xy_downsample}
    else:
        whole, in_bricks = detection.detect_v2, bricks.detect_bricks_v2
        options = {"k": a.xy_downsample, "scales": _scales(a.dog_scales), "rel": a.rel_threshold, "percentile": a.abs_percentile, "radius_um": a.min_distance_um, "most": a.max_peaks, "refine": not a.no_refine}
    if a.bricks:
        chunked.register(spark)
        found = in_bricks(spark.read.format("chunked_bricks").load(a.test_dir), **options)
    else:
        found = detection.detect_frames(_frames(spark, a.test_dir), whole, **options)
    _write(found, a.output)


def link(spark, a) -> None:
    points = _read(spark, a.predictions, schema.DETECTIONS)
    _write(tracking.track(points, a.max_link_um, a.min_track_length, a.close_gaps, a.max_gap, a.gap_dist_um).drop("node_id"), a.output)


def kalman(spark, a) -> None:
    _write(tracking.kalman_track(_read(spark, a.predictions, schema.DETECTIONS), a.max_distance), a.output)


def divide(spark, a) -> None:
    if a.input_tracks:
        tracks = _read(spark, a.input_tracks, schema.TRACKS)
    elif a.predictions:
        tracks = tracking.kalman_track(_read(spark, a.predictions, schema.DETECTIONS), a.max_distance)
    else:
        raise SystemExit("either --predictions or --input-tracks is needed")
    _write(tracks, a.output)
    _write(divisions.division_edges(tracks, a.max_gap, a.division_distance_um), a.division_edges)


def divide_scored(spark, a) -> None:
    rules = divisions.EventRules(a.max_parent_child_dist_um, a.min_daughter_separation_um, a.min_parent_age, a.min_daughter_persistence, a.max_gap, not a.allow_existing_daughter_tracks)
    events = divisions.division_events(_read(spark, a.tracks, schema.TRACKS), rules)
    _write(events, a.output)
    if a.edges_output:
        _write(divisions.events_to_edges(events), a.edges_output)


def graph_table(spark, a) -> None:
    edges = None
    if a.division_edges:
        edges = _read(spark, a.division_edges)
        edges = edges.withColumn("ordinal", F.monotonically_increasing_id())
    _write(formatting.graph_table(_read(spark, a.tracks, schema.TRACKS), edges), a.output, ["id"])


def _lineage(spark, path: str, volumes: list[str] | None = None):
    """Ground truth from lineage stores where the folder has some, else from Parquet tables."""
    stores = Path(path).is_dir() and any(p.suffix == ".geff" for p in Path(path).iterdir())
    return (lineage_store.read_lineage_stores if stores else tables.read_lineage)(spark, path, volumes)


def evaluate(spark, a) -> None:
    submission = _read(spark, a.submission)
    names = a.datasets.split(",") if a.datasets else None
    nodes, edges = formatting.split_graph(submission, names)
    if a.version == 1:
        from weftline.operators.joins import existing_edges

        edges = existing_edges(edges, nodes)
    gt_nodes, gt_edges, meta = _lineage(spark, a.train_dir, names)
    rows = evaluation.evaluate(nodes, edges, gt_nodes, gt_edges, meta, a.version)
    print(json.dumps({"volumes": [r.asDict() for r in rows.orderBy("volume").collect()], "all": evaluation.aggregate(rows, a.version).first().asDict()}, indent=2))


def calibrate(spark, a) -> None:
    from weftline.plans.calibration import calibrate as run

    gt_nodes, gt_edges, meta = _lineage(spark, a.train_dir)
    keep = pairs.validation_subset(meta, a.subset_size).select("volume")
    only = lambda df: df.join(keep, "volume", "left_semi")
    rows = run(only(_frames(spark, a.train_dir)), only(gt_nodes), only(gt_edges), only(meta), a.n_trials, a.seed, most=a.topk, min_track_length=a.min_track_length)
    tables.write_artifact(a.output, tables.canonical_json([r.asDict() for r in rows.collect()]))  # at most 30 rows


def truth_statistics(spark, a) -> None:
    nodes, edges, _ = _lineage(spark, a.train_dir)
    _write(divisions.truth_divisions(nodes, edges), a.output)


def tracklet_export(spark, a) -> None:
    nodes, edges, _ = _lineage(spark, a.train_dir)
    table, labels = tracking.tracklets(nodes, edges)
    tables.write_tracklet_table(table, f"{a.output_dir}/tracks")
    painted = detection.paint_labels(nodes.join(labels, ["volume", "node_id"]).where("label is not null").withColumn("ord", F.col("node_id")), tuple(a.radii), tuple(a.shape))
    for r in tables.label_frames(painted, tuple(a.shape)).toLocalIterator():
        tables.write_artifact(Path(a.output_dir) / r.volume / r.name, bytes(r.content))


def edge_pairs(spark, a) -> None:
    nodes, edges, _ = _lineage(spark, a.train_dir)
    points = tracking.number_nodes(_read(spark, a.dets, schema.DETECTIONS), "score")
    found = pairs.edge_pairs(points, nodes, edges)
    tables.write_shards(pairs.sample_negatives(found, a.neg_ratio) if a.neg_ratio else found, a.output_dir)


def analyze_text(spark, a) -> None:
    from weftline.plans.trace import analyze

    markers = json.loads(Path(a.markers).read_text()) if a.markers else None
    print(json.dumps(analyze(spark, a.input, a.output_root, markers), indent=2))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(required=True)

    def stage(name: str, run, **options) -> None:
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        for option, default in options.items():
            flag = "--" + option.replace("_", "-")
            if default is bool:
                s.add_argument(flag, action=argparse.BooleanOptionalAction, default=False)
            elif default is True:
                s.add_argument(flag, action=argparse.BooleanOptionalAction, default=True)
            elif default is str:
                s.add_argument(flag, required=True)
            elif isinstance(default, tuple):
                s.add_argument(flag, nargs=len(default), type=int, default=list(default))
            else:
                s.add_argument(flag, type=type(default) if default is not None else str, default=default)

    stage("detect", detect, test_dir=str, output=str, version=2, sigmas="1,1.5,2,2.5,3", quantile=0.9995, min_score=0.015, max=350, min=40, xy_downsample=4, dog_scales="1.5,4.0;2.2,5.5", rel_threshold=0.045, abs_percentile=50.0, min_distance_um=3.2, max_peaks=40000, no_refine=bool, bricks=bool)
    stage("link", link, predictions=str, output=str, max_link_um=8.0, min_track_length=2, close_gaps=True, max_gap=1, gap_dist_um=6.0)
    stage("link-strict", link, predictions=str, output=str, max_link_um=4.0, min_track_length=5, close_gaps=bool, max_gap=1, gap_dist_um=4.0)
    stage("kalman", kalman, predictions=str, output=str, max_distance=50.0)
    stage("divisions", divide, predictions=None, input_tracks=None, output=str, division_edges=str, max_distance=50.0, division_distance_um=8.0, max_gap=1)
    stage("division-events", divide_scored, tracks=str, output=str, edges_output=None, max_parent_child_dist_um=8.0, min_daughter_separation_um=8.0, min_parent_age=10, min_daughter_persistence=2, max_gap=1, allow_existing_daughter_tracks=bool)
    stage("graph-table", graph_table, tracks=str, division_edges=None, output=str)
    stage("evaluate", evaluate, submission=str, train_dir=str, datasets=None, version=2)
    stage("calibrate", calibrate, train_dir=str, output=str, n_trials=30, subset_size=15, topk=500, min_track_length=2, seed=20260702)
    stage("truth-statistics", truth_statistics, train_dir=str, output=str)
    stage("tracklets", tracklet_export, train_dir=str, output_dir=str, radii=(2, 4, 4), shape=(64, 256, 256))
    stage("edge-pairs", edge_pairs, train_dir=str, dets=str, output_dir=str, neg_ratio=0)
    stage("analyze-text", analyze_text, input=str, output_root=str, markers=None)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName("weftline").getOrCreate(), a)


if __name__ == "__main__":
    main()
