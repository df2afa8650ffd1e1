"""Splits, statistics, sources, sinks, rules, providers and streaming on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import dedup, filters, providers, rewrite, splits, stats
from quarry.sources import readers, writers
from quarry.streaming import dedup as stream


def rows(spark, n=40):
    return spark.createDataFrame([(k, f"text {k % 30}", ["a", "b", None][k % 3]) for k in range(n)], "id long, text string, label string")


def test_stratified_counts(spark):
    got = splits.stratified(rows(spark), "id", ["label"], 0.25).groupBy("label").agg(F.count_if("chosen").alias("n")).collect()
    assert {r.label: r.n for r in got} == {"a": round(14 * 0.25), "b": round(13 * 0.25), None: 0}


def test_split_keeps_all_rows_once(spark):
    df = rows(spark).withColumn("split", F.when(F.col("id") < 10, "test").when(F.col("id") < 15, "train"))
    got = splits.split_existing(df, "id", "label")
    assert got.count() == 40 and got.select("id").distinct().count() == 40
    assert got.filter("id < 10").select("split").distinct().collect() == [("test",)]
    assert {r[0] for r in got.select("split_method").distinct().collect()} == {"original", "internal", "internal_dev"}


def test_equal_keys_stay_together(spark):
    got = splits.split_by_key(rows(spark), F.col("text"))
    assert splits.leakage(got, "text").isEmpty()


def test_first_wins_and_again(spark):
    once = dedup.first_of(rows(spark), ["text"], ["id"])
    assert {r.id for r in once.collect()} == set(range(30))
    assert dedup.first_of(once, ["text"], ["id"]).count() == 30
    assert dedup.unwritten(rows(spark), once, "id").count() == 10


def test_auc_and_u_with_ties(spark):
    pairs = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.8, 0), (0.9, 1)]
    df = spark.createDataFrame(pairs, "s double, y int")
    u = sum((a > b) + 0.5 * (a == b) for a, y in pairs if y for b, z in pairs if not z)
    assert stats.mann_whitney(df, "s", "y").first().u == u
    assert stats.roc_auc(df, "s", "y").first().auc == pytest.approx(u / 9, abs=1e-6)


def test_funnel(spark):
    got = filters.funnel(rows(spark), {"low": F.col("id") < 20, "a": F.col("label") == "a"}, ["label"]).collect()
    assert {(r.label, r.total, r.low, r.a) for r in got} == {("a", 14, 7, 7), ("b", 13, 7, 0), (None, 13, 6, 0)}


def test_rules_repeat(spark):
    made = rows(spark).select(rewrite.replace_terms(F.lit("see the end"), "id").alias("x"))
    assert made.collect() == made.collect() and made.distinct().count() == 2
    assert spark.range(1).select(rewrite.with_intervals(F.lit("99% and 3%.")).alias("x")).first().x == "99% (95% CI 94-100) and 3% (95% CI 0-8)."


def test_tree(spark, tmp_path):
    long = "This is one plain sentence about a small study of sleep in older people who live at home. " * 2
    base = tmp_path / "raw" / "trials" / "train" / "pls"
    base.mkdir(parents=True)
    (base / "a.txt").write_text(long + "|||" + "Short summary.|||more")
    (base / "b.csv").write_bytes(("Title,TEXT\ncaf\xe9," + long + "\n").encode("latin1"))
    (base / "c.jsonl").write_text(json.dumps({"text": long, "summary": "s"}) + "\n\n{broken\n" + json.dumps({"Body": "short", "PLS": long + "Really."}) + "\n" + json.dumps({"body": long + "Also.", "lay_summary": long}) + "\n")
    (base / "d.json").write_text(json.dumps([{"Text": long}, {"text": "too short"}]))
    got = readers.read_tree(spark, str(tmp_path)).cache()
    assert {r.doc_id for r in got.collect()} == {"trials_a#p1", "trials_b#r0", "trials_c#l0", "trials_c#l3", "trials_c#l4", "trials_d#o0"}
    assert {(r.split, r.label, r.source_dataset) for r in got.collect()} == {("train", "pls", "trials")}
    # Told by the mark, or both sides valid.
    assert {r.doc_id for r in got.filter("has_pair").collect()} == {"trials_a#p1", "trials_c#l4"}
    once = writers.curated(got)
    assert once.count() == 6
    writers.write_splits(once, str(tmp_path / "out"))
    writers.write_csv(once, str(tmp_path / "csv"), ["doc_id", "nothing", "label"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["doc_id", "label"]
    assert writers.statistics(once).first().records == 6
    for _ in range(2):
        writers.append_new(once.select("doc_id", "texto_original"), str(tmp_path / "app"), "doc_id")
    assert spark.read.parquet(str(tmp_path / "app")).count() == 6


def test_path_facts(spark):
    df = spark.createDataFrame([("/x/raw/ds/b1/b2/train/test/pls/non_pls/f.txt",), ("/y/f.txt",)], "p string")
    a, b = df.select(*[v.alias(k) for k, v in readers.path_facts(F.col("p")).items()]).collect()
    assert (a.source_dataset, a.split, a.label) == ("ds", "test", "non_pls") and (b.source_dataset, b.split, b.label) == ("unknown", "unsplit", None)


def test_providers(spark):
    df = spark.createDataFrame([("A b. C d. E f. G h.",), (None,)], "t string")
    assert [r.g for r in providers.generate(df, "t", "g").orderBy(F.desc("t")).collect()] == ["A b. C d. E f.", None]
    assert df.select(providers.detect_language("t").alias("x")).first().x == "unknown"
    calls, waits = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert providers.with_retries(fails, sleep=waits.append)() == "done" and waits == [1.0, 2.0]
    clock = iter([0, 0, 10, 61]).__next__
    limit = providers.RateLimit(1, 60, clock, waits.append)
    limit.take()
    limit.take()
    assert waits[-1] == 50


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "text string").withColumn("at", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("text string, at timestamp").parquet(str(tmp_path / "in"))
    stream.write(stream.deduplicated(source, "text", "at"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_plans_stay_out_of_python(spark):
    from quarry.plans.catalogue import QUERIES

    plan = QUERIES["flagship_funnel"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<text:string,source:string>" in plan
