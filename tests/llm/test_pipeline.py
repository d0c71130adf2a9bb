import corpus_pipeline as pipeline
from test_jaccard_join import brute
from test_packing import check

from weftline.llm import mixing, packing

DATA = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "mixing", "packing"]
    languages = pipeline.language_stage(spark, docs, DATA).cache()
    assert languages.columns == docs.columns and languages.count() >= 0.98 * docs.count()
    good = pipeline.quality_stage(spark, languages, DATA).cache()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = good.join(labels, "doc_id").groupBy("quality").count().collect()
    assert sum(r["count"] for r in kept if r.quality == 0) <= 3
    assert languages.join(labels.where("quality = 1"), "doc_id").join(good, "doc_id", "left_anti").count() <= 3
    one = pipeline.near_duplicate_stage(spark, good, DATA).cache()
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in good.collect()])})
    mixed = pipeline.mixing_stage(spark, one, DATA).cache()
    assert mixed.columns == docs.columns and mixed.count() == mixing.replicate(one).count()
    rows = pipeline.packing_stage(spark, mixed, DATA).collect()
    check(rows, {r.doc_id: r.text for r in mixed.collect()}, packing.Encoder())


def test_run_equals_its_stages_and_empty_tables_pass(spark, store, no_docs):
    assert pipeline.run(spark, DATA).count() > 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pipeline.run(spark, store(documents=no_docs, labels=labels)).count() == 0


def test_odd_documents_pass_each_stage(spark, odd_docs, clashing, store):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    path = store(labels=labels)
    docs = clashing(odd_docs)
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == clashing(odd_docs).columns
    assert pipeline.STAGES[-1][1](spark, docs, path).count() > 0
