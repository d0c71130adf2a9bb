"""Jobs: growing input, repeated batches, reruns, command lines."""

import json
import os
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import _command, edge_dataset, segment_documents
from weftline.operators import ranks

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


def rows(df):
    return Counter(map(str, df.drop("batch").collect()))


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The documents in four files, with missing and repeated ids, repeated rows, null and empty texts among them."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60")
    odd = spark.createDataFrame([(None, "one line that is long enough to be a paragraph\nand a second line of the same paragraph", "en", "s", 1)] * 2 + [(1, "", "en", "s", 0), (1, None, None, None, None), (2, "ok can you explic this to me, please? it is long enough", "en", "s", 9)], docs.schema)
    all_ = docs.unionByName(odd)
    base = tmp_path_factory.mktemp("parts")
    for n in range(4):
        all_.where(f"coalesce(doc_id, 3) % 4 = {n}").coalesce(1).write.parquet(f"{base}/{n}")
    return [next(Path(f"{base}/{n}").glob("part-*.parquet")) for n in range(4)]


def come(folder, part):
    """A file arrives as a copy, in one step."""
    folder.mkdir(exist_ok=True)
    (folder / f".{part.parent.name}.tmp").write_bytes(part.read_bytes())
    os.rename(folder / f".{part.parent.name}.tmp", folder / f"{part.parent.name}.parquet")


def expected(spark, config, *files):
    docs = spark.read.parquet(*map(str, files)).withColumn("key", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"))
    return Counter(map(str, segment_documents.segments(docs, config).select(*[c for c in segment_documents.output(spark, "/nowhere").columns if c != "batch"]).collect()))


def test_two_runs_over_growing_input(spark, parts, tmp_path):
    config = _command.configuration("segment_documents") | {"files_per_batch": 1}
    at = {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark"), "config": config}
    come(tmp_path / "in", parts[0])
    come(tmp_path / "in", parts[1])
    first = segment_documents.run(spark, **at)
    assert first["batches"] == 2 and first["read"] == spark.read.parquet(at["input"]).count()
    assert rows(segment_documents.output(spark, at["output"])) == expected(spark, config, *parts[:2])
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    come(tmp_path / "in", parts[2])
    come(tmp_path / "in", parts[3])
    second = segment_documents.run(spark, **at)
    assert second["read"] == sum(spark.read.parquet(str(p)).count() for p in parts[2:]) and second["batches"] == 2  # only what is new
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items())
    out = segment_documents.output(spark, at["output"])
    assert rows(out) == expected(spark, config, *parts) and first["written"] + second["written"] == out.count()
    third = segment_documents.run(spark, **at)
    assert third == {"read": 0, "batches": 0, "written": 0} and rows(segment_documents.output(spark, at["output"])) == rows(out)
    # two equal rows without an id are two documents; both share a type's partition
    assert out.where("doc_id is null").count() == 2 and {p.name for p in (tmp_path / "out").glob("batch=0/*") if p.is_dir()} <= {"paragraph_type=other", "paragraph_type=preamble_instruction", "paragraph_type=transcript_user_text"}


def test_documents_are_read_and_shuffled_once(spark, parts):
    docs = spark.read.parquet(*map(str, parts)).withColumn("key", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"))
    made = segment_documents.segments(docs, _command.configuration("segment_documents"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("Exchange ") == 1 and "Join" not in plan, plan
    # columns of the document may have any name, those of a segment's own steps too
    config = _command.configuration("segment_documents") | {"keep": ["lines", "line", "text"], "schema": "doc_id long, text string, lines string, line string"}
    named = docs.withColumns({"lines": F.lit("a"), "line": F.col("source")})
    got = segment_documents.segments(named, config).select("doc_id", "segment_id", "lines", "line", "text", "sha256")
    want = made.select("doc_id", "segment_id", F.lit("a").alias("lines"), F.col("source").alias("line"), "sha256")
    assert rows(got.drop("text")) == rows(want)


def test_a_batch_that_failed_is_written_once(spark, parts, tmp_path):
    at = {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}
    come(tmp_path / "in", parts[0])
    segment_documents.run(spark, **at)
    want = rows(segment_documents.output(spark, at["output"]))
    # as after a stop between writing and committing: the batch is planned, its output half there
    for f in ("0", ".0.crc"):
        (tmp_path / "mark/commits" / f).unlink(missing_ok=True)
    next((tmp_path / "out/batch=0").rglob("*.parquet")).unlink()
    come(tmp_path / "in", parts[1])
    segment_documents.run(spark, **at)
    config = _command.configuration("segment_documents")
    assert rows(segment_documents.output(spark, at["output"]).where("batch = 0")) == want
    assert rows(segment_documents.output(spark, at["output"])) == expected(spark, config, *parts[:2])


def test_a_batch_that_raises_ends_the_run(spark, parts, tmp_path):
    come(tmp_path / "in", parts[0])
    config = _command.configuration("segment_documents") | {"rules": "unknown"}
    at = {"input": str(tmp_path / "in"), "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}
    with pytest.raises(Exception, match="unknown"):
        segment_documents.run(spark, **at, config=config)
    assert segment_documents.output(spark, at["output"]).count() == 0
    assert segment_documents.run(spark, **at)["read"] > 0  # nothing was marked as read


def test_empty_input(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert segment_documents.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"))["read"] == 0
    assert segment_documents.output(spark, str(tmp_path / "out")).count() == 0


def test_the_training_set_reruns_alike(spark, tmp_path):
    table, out = f"{DATA}/events.parquet", str(tmp_path / "set")
    first = edge_dataset.run(spark, table, table, out)
    want = rows(edge_dataset.output(spark, out))
    assert sum(want.values()) == sum(n for k, n in first.items() if "/" in k) > 0
    assert edge_dataset.run(spark, table, table, out) == first and rows(edge_dataset.output(spark, out)) == want
    # some volumes only: the others' files stay
    names = sorted({re.match("(.*)/", k)[1] for k in first if "/" in k})
    kept = {p: p.stat().st_mtime_ns for n in names[1:] for p in Path(out, f"volume={n}").rglob("*.parquet")}
    before = set(Path(out, f"volume={names[0]}").rglob("*.parquet"))
    part = edge_dataset.run(spark, table, table, out, _command.configuration("edge_dataset") | {"volumes": names[:1]})
    assert {k for k in part if "/" in k} == {k for k in first if k.startswith(f"{names[0]}/")} and part["points"] < first["points"]
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items()) and before.isdisjoint(Path(out, f"volume={names[0]}").rglob("*.parquet"))
    assert rows(edge_dataset.output(spark, out)) == want


def test_the_training_set_leaves_odd_rows_out(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    odd = [events.limit(5).withColumn(c, F.lit(None).cast(events.schema[c].dataType)) for c in ("event_type", "ts", "user_id", "event_id")]
    all_ = events
    for df in odd:
        all_ = all_.unionByName(df)
    all_.withColumn("label", F.lit("clash")).write.parquet(str(tmp_path / "events"))
    edge_dataset.run(spark, str(tmp_path / "events"), str(tmp_path / "events"), str(tmp_path / "odd"))
    edge_dataset.run(spark, f"{DATA}/events.parquet", f"{DATA}/events.parquet", str(tmp_path / "plain"))
    assert rows(edge_dataset.output(spark, str(tmp_path / "odd"))) == rows(edge_dataset.output(spark, str(tmp_path / "plain")))
    events.where("false").write.parquet(str(tmp_path / "none"))
    edge_dataset.run(spark, str(tmp_path / "none"), str(tmp_path / "none"), str(tmp_path / "empty"))
    assert edge_dataset.output(spark, str(tmp_path / "empty")).count() == 0


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"negatives": 7}))
    assert _command.configuration("edge_dataset", str(path))["negatives"] == 7
    path.write_text(json.dumps({"negative": 7}))
    with pytest.raises(ValueError, match="negative"):
        _command.configuration("edge_dataset", str(path))


@pytest.mark.parametrize("name", ["segment_documents", "edge_dataset"])
def test_command_line(spark, parts, tmp_path, name):
    come(tmp_path / "in", parts[0])
    events = f"{DATA}/events.parquet"
    given = {"segment_documents": ["--input", str(tmp_path / "in"), "--checkpoint", str(tmp_path / "mark")], "edge_dataset": ["--points", events, "--truth", events]}[name]
    code = f"import sys, runpy; sys.argv[0] = {name!r}; runpy.run_module('jobs.{name}', run_name='__main__'); assert not any(m.startswith(('weftline.llm', 'corpus_pipeline')) for m in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code, *given, "--output", str(tmp_path / "out")], cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=4 --conf spark.ui.enabled=false pyspark-shell"})
    assert done.returncode == 0, done.stderr[-2000:]
    assert re.search(r"jobs\.\w+ read \d+", done.stderr) and list((tmp_path / "out").rglob("*.parquet"))


def test_row_numbers_of_large_groups(spark):
    data = [(k, p, o) for k in ("a", "b", None) for p in (3, 1, None) for o in (5, 2, 9)]
    got = ranks.number_rows(spark.createDataFrame(data, "k string, p int, o int"), ["k"], ["p"], ["o"], "n").collect()
    for k in ("a", "b", None):
        order = sorted((r for r in got if r.k == k), key=lambda r: (r.p is not None, r.p or 0, r.o))
        assert [r.n for r in order] == list(range(1, 10))
