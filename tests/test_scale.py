"""What must not be worked out again and again, nor be held at once: plans, calls and batches."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from quarry.functions import lexical as L
from quarry.functions import readability as R
from quarry.functions import text as X
from quarry.operators import chunking, classify, filters, reports, stats


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark):
    return spark.createDataFrame([(k, "abc"[k % 3], f"The cat number {k} sat. It ate.") for k in range(30)], "doc_id long, source string, text string")


def test_syllables_are_those_of_the_words(spark):
    draw = random.Random(3)
    rows = [(" ".join("".join(draw.choices("aeybce-1é.\n", k=draw.randint(1, 7))) for _ in range(40)),) for _ in range(300)] + [(t,) for t in ("", " \n", "e", "the", "E e. ée x", "a" * 3000, "b" * 3000, "be" * 3000, None)]
    n = F.transform(X.words("text"), R.syllables)
    wanted = {"n_syllables": R.total(n), "n_complex": F.size(F.filter(n, lambda v: v >= 3)), "n_letters": R.total(F.transform(X.words("text"), lambda w: F.length(w).cast("bigint")))}
    got = R.counts(spark.createDataFrame(rows, "text string")).select(*[(F.col(k) == v).alias(k) for k, v in wanted.items()])
    assert got.distinct().collect() == [(True, True, True)]


def test_texts_are_gone_over_few_times(spark):
    assert plan_of(L.classified(texts(spark)).select("fre", "fkg")).count("regexp_extract_all") <= 4
    assert plan_of(texts(spark).select(L.judged("text").alias("j"))).count("split(") == 2  # words and sentences


def test_filters_repeat_nothing(spark):
    df = L.classified(texts(spark))
    steps = {"a": F.col("fre") >= 0, "b": F.col("fkg") <= 90, "c": F.col("confidence") >= 0.1}
    assert plan_of(filters.approved(df, steps)).count("regexp_extract_all") == plan_of(df).count("regexp_extract_all")
    assert filters.approved(df, steps).count() == df.filter("fre >= 0 AND fkg <= 90 AND confidence >= 0.1").count()


def test_errors_and_runs_read_texts_once(spark):
    df = L.classified(texts(spark)).withColumns({"pred": (F.col("confidence") >= 0.75).cast("int"), "y": F.lit(0)})
    assert plan_of(reports.errors(df, "y", "pred", "doc_id", "text")).count("regexp_extract_all") == plan_of(df.select("pred")).count("regexp_extract_all")
    assert plan_of(reports.compare_runs(df, "source")).count("LogicalRDD") == 1


def test_ranks_score_rows_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scored(k):
        calls.add(1)
        return float(k % 7)

    df = spark.range(200).select(scored("id").alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = stats.mann_whitney(df, "s", "y").first()
    a, b = [k % 7 for k in range(200) if k % 3 == 0], [k % 7 for k in range(200) if k % 3]
    assert (got.n1, got.n0, got.u) == (len(a), len(b), sum((x > y) + 0.5 * (x == y) for x in a for y in b))
    assert calls.value == 200


def test_sentences_without_an_end():
    text, start = "no end here " * 40_000, time.process_time()
    assert chunking.split_sentences(text) == [text.strip()] and len(chunking.pack(text)) == 300
    assert chunking.split_sentences("A b c... D e?! \n F g h") == ["A b c...", "F g h"]
    assert time.process_time() - start < 20


def test_chunks_are_made_a_few_texts_at_a_time(spark, monkeypatch):
    text = "word " * 20_000
    df = spark.createDataFrame([(k, text) for k in range(60)], "doc_id long, text string").coalesce(1)
    held = chunking.chunked(df, "text", "recursive", keep_text=False).mapInArrow(lambda bs: (b.select(["doc_id"]).slice(0, 1).append_column("n", pa.array([b.num_rows], pa.int64())) for b in bs if b.num_rows), "doc_id long, n long")
    wanted = [(k, c, t) for k in range(2) for c, t in enumerate(chunking.split_recursive(text))]
    got = chunking.chunked(df, "text", "recursive").filter("doc_id < 2").orderBy("doc_id", "chunk_id")
    assert [tuple(r) for r in got.select("doc_id", "chunk_id", "chunk").collect()] == wanted and got.columns == ["doc_id", "text", "chunk_id", "chunk"]
    assert held.agg(F.sum("n")).first()[0] == 60 * len(wanted) // 2
    part = pa.RecordBatch.from_pydict({"text": ["x" * 400_000, None, "x" * 400_000, "x" * 3_000_000, "y", "z"]})
    assert [p.num_rows for p in chunking._slices(part, "text")] == [3, 1, 2]


def test_term_weights_sort_no_terms(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (None, "aa cc"), (3, None), (4, "dd bb cc")], "doc_id long, text string")
    made = stats.tfidf(df, "doc_id", "text")
    assert "Window" not in plan_of(made)
    rows = made.collect()
    assert {(r.doc_id, r.term, r.tf) for r in rows} == {(1, "aa", 2), (1, "bb", 2), (1, "cc", 1), (None, "aa", 1), (None, "cc", 1), (4, "bb", 1), (4, "cc", 1)}
    assert all(abs(sum(r.weight**2 for r in rows if r.doc_id == k) - 1) < 1e-5 for k in (1, None, 4))


def test_training_keeps_no_texts(spark, monkeypatch):
    held, persist = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda df, *a: (held.append(df.columns), persist(df, *a))[1])
    df = spark.createDataFrame([(k, f"plain words number {k % 5} help you" if k % 2 else f"the cohort placebo trial {k % 7} was randomized", k % 2) for k in range(40)], "doc_id long, text string, label int")
    model = classify.fit(df, iterations=5)
    assert held and not any({"text", "_terms"} & {*columns} for columns in held)
    assert {"plain words", "cohort", "placebo trial"} <= {*model.stages[4].vocabulary}
    p = {r.doc_id: r.p_plain for r in classify.score(model, df).collect()}
    assert all((p[k] > 0.5) == bool(k % 2) for k in range(40))
