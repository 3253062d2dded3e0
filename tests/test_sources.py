"""Corpus files read in many tasks, and the bucketed sink."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.sources.corpus import array_records, corpus_project, load_corpus_json
from tessera.sources.tables import write_bucketed

NASTY = ['a { b', '{"document": 7, "tokens": []}', '}, {', '{{{', ']', '}', '"{', '\\{"document":', 'ünï {"labels" : ', '{ "document" :', '\n{\n']


def _records(n):
    out = []
    for i in range(n):
        words = [NASTY[(i + k) % len(NASTY)] for k in range(i % 5)] + ["x" * (i % 40)]
        out.append({"document": i, "full_text": " ".join(words), "tokens": words, "trailing_whitespace": [True] * len(words),
                    "labels": None if i % 7 == 0 else ["O"] * len(words)})
    return out


def _rows(df):
    return sorted((r.document, r.full_text, r.tokens, r.trailing_whitespace, r.provided_labels) for r in corpus_project(df).collect())


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_file_is_read_by_many_tasks(spark, tmp_path, indent):
    path = str(tmp_path / "array.json")
    with open(path, "w") as f:
        json.dump(_records(400), f, indent=indent, ensure_ascii=indent is None)
    whole = _rows(load_corpus_json(spark, path, split=False))
    assert len(whole) == 400
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("512b", "7k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            pieces = spark.read.option("lineSep", "{").text(path)
            assert size == "64m" or pieces.rdd.getNumPartitions() > os.path.getsize(path) // (9 << 10)
            assert _rows(load_corpus_json(spark, path)) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_arrays_in_several_files_and_empty_ones(spark, tmp_path):
    d = tmp_path / "many"
    d.mkdir()
    for k, text in enumerate([json.dumps(_records(5)), "[]", " [ \n ] ", "", json.dumps(_records(2)[1:])]):
        (d / f"{k}.json").write_text(text)
    assert [r[0] for r in _rows(load_corpus_json(spark, str(d)))] == [0, 1, 1, 2, 3, 4]


@pytest.mark.parametrize("text", ['{"other": 1}', "[1, 2]", 'x [{"document": 1}]', '[{"document": 1, "tokens": [}]'])
def test_other_text_fails(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception):
        load_corpus_json(spark, str(path)).collect()


def test_record_texts_are_whole(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(_records(30)))
    got = sorted((json.loads(r.record) for r in array_records(spark, str(path), ["document"]).collect()), key=lambda r: r["document"])
    assert got == _records(30)


def test_a_rerun_replaces_one_threshold_only(spark):
    name = "sink_of_predictions"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    rows = spark.createDataFrame([(t, d, k, "old") for t in (0.25, 0.5) for d in range(20) for k in (1, 0)],
                                 "threshold double, document long, token int, label string")
    try:
        write_bucketed(rows, name, buckets=4)
        again = rows.where("threshold = 0.5 and document < 5").withColumn("label", F.lit("new"))
        write_bucketed(again.select("label", "token", "document", "threshold"), name, buckets=4)
        got = {(r.threshold, r.label): r.n for r in spark.table(name).groupBy("threshold", "label").agg(F.count("*").alias("n")).collect()}
        assert got == {(0.25, "old"): 40, (0.5, "new"): 10}
        a, b = spark.table(name).where("threshold = 0.25"), spark.table(name).where("threshold = 0.5")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = a.join(b, "document")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == 20
        per = a.groupBy("document").count()
        assert "Exchange" not in per._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE IF EXISTS {name}")
