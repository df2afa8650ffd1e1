"""Text, readability, terms and metrics against plain Python on hand-made rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import lexical as L
from quarry.functions import metrics as M
from quarry.functions import readability as R
from quarry.functions import text as X
from quarry.operators import chunking as C


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_normal_form(spark):
    text = "  Ａ\tb  c\r\n\r\n\r\n\r\nd \n e  "
    assert one(spark, X.normalise("t"), t=text) == "A b c\n\nd\ne"
    assert one(spark, X.normalise("t"), t=None) == ""


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), ("  ", 0), ("a", 1), (" a b\nc ", 3)])
def test_word_count(spark, text, n):
    assert one(spark, X.word_count("t"), t=text) == n
    assert one(spark, F.size(X.words("t")), t=text) == n


def test_sentences_and_tail(spark):
    text = "One two three. Four five six! and the tail here"
    assert one(spark, X.closed_sentences("t"), t=text) == ["One two three.", "Four five six!", "and the tail here"]
    assert one(spark, X.closed_sentences("t", keep_tail=False), t=text) == ["One two three.", "Four five six!"]


def test_paragraph_bounds(spark):
    text = " ".join(["w"] * 19) + "\n\n" + " ".join(["v"] * 20)
    assert one(spark, X.paragraphs("t"), t=text) == [" ".join(["v"] * 20)]


def test_echo_and_grams(spark):
    assert one(spark, X.without_echo("t"), t="a a b b a") == "a b a"
    assert one(spark, X.ngrams(X.words("t"), 2), t="a b c") == ["a b", "b c"]
    assert one(spark, X.ngrams(X.words("t"), 4), t="a b c") == []


def test_readability(spark):
    df = spark.createDataFrame([("The cat sat. The dog ran.",), ("",)], "text string")
    a, b = R.battery(df).orderBy(F.length("text").desc()).collect()
    assert a.flesch == pytest.approx(206.835 - 1.015 * 3 - 84.6)
    assert b.flesch == 0 and b.kincaid == 0


def test_issue_bounds(spark):
    text = "word " * 19 + "words"  # 100 characters, 20 words
    assert one(spark, L.quality_issues("t", F.lit("en")), t=text) == []
    assert "Too_short" in one(spark, L.quality_issues("t", F.lit("en")), t=text[1:])
    assert one(spark, L.quality_issues("t", F.lit("en")), t=None) == ["Empty"]
    assert one(spark, L.is_valid(L.quality_issues("t", F.lit("en"))), t="x " * 3000) is True


def test_repetition(spark):
    d = L.diversity("t")
    assert one(spark, d["repeated_bigrams"], t="a b a b c") == pytest.approx(1 / 4)
    assert one(spark, d["ttr"], t="A a b") == pytest.approx(2 / 3)


@pytest.mark.parametrize(("p", "r"), [(["a", "b"], ["a", "b"]), (["a"], ["b"]), ([], ["a"]), ([], [])])
def test_metric_extremes(spark, p, r):
    same = float(p == r and bool(p))
    assert one(spark, M.set_f1(F.col("p"), F.col("r")), p=p, r=r) == same
    assert one(spark, M.rouge_n(F.col("p"), F.col("r"), 1)[2], p=p, r=r) == same
    assert one(spark, M.rouge_l(F.col("p"), F.col("r")), p=p, r=r) == same


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab c. d! \n\n".split(" ") + ["word", "\n\n", "x. "]), max_size=80), st.integers(3, 12))
def test_packing(parts, most):
    text = " ".join(parts)
    for function in (C.pack, C.pack_semantic):
        if function is C.pack:
            assert all(len(c.split()) <= most for c in function(text, most))
    assert all(len(c) <= 20 for c in C.split_recursive(text, 20, 5))


def test_windows(spark):
    text = " ".join(map(str, range(25)))
    got = one(spark, C.token_windows("t", 10, 3), t=text)
    assert got == [[str(k) for k in range(a, min(a + 10, 25))] for a in (0, 7, 14, 21)][: len(got)] and got[-1][-1] == "24"
