"""Label and text predicates, the approval funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_blank(col: str) -> Column:
    return F.coalesce(F.col(col).rlike("\\S"), F.lit(False))


def by_label(df: DataFrame, label: str, positive: str, negative: str, least: int = 50) -> DataFrame:
    """``df`` with ``chosen_text``: the summary for positive, the original for negative labels, of at least so many characters."""
    text = F.when(F.col(label) == 1, F.col(positive)).when(F.col(label) == 0, F.col(negative))
    return df.withColumn("chosen_text", F.trim(text)).filter(F.length("chosen_text") >= least)


def kept(df: DataFrame, test: Column) -> DataFrame:
    """Rows that pass, the columns that the test reads being computed once.

    A plain filter is pushed below them, and works out each of them again for every mention.
    """
    return df.withColumn("_at", F.monotonically_increasing_id()).filter((F.col("_at") >= 0) & test).drop("_at")


def funnel(df: DataFrame, steps: dict[str, Column], by: list[str]) -> DataFrame:
    """How many rows pass the first step, the first two, and so on, in one aggregation."""
    passed, out = F.lit(True), []
    for name, test in steps.items():
        passed = passed & F.coalesce(test, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *out)


def approved(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    passed = F.lit(True)
    for test in steps.values():
        passed = passed & test
    return kept(df, passed)
