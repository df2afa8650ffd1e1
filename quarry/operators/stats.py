"""Descriptions, truncation, class metrics, rank statistics, term weights, comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import let, words
from quarry.operators.filters import kept


def describe(df: DataFrame, col: str, population: bool = False) -> DataFrame:
    """Count, mean, deviation, least, quartiles, 90th, 95th and 99th percentile, greatest."""
    q = F.percentile(F.col(col), F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))))
    out = df.agg(F.count(col).alias("n"), F.round(F.avg(col), 6).alias("mean"), F.round((F.stddev_pop if population else F.stddev)(col), 6).alias("std"), F.min(col).alias("least"), F.max(col).alias("most"), q.alias("_q"))
    return out.select("n", "mean", "std", "least", *[F.round(F.col("_q")[k], 6).alias(name) for k, name in enumerate(("q25", "median", "q75", "q90", "q95", "q99"))], "most")


def truncation(df: DataFrame, tokens: str, limit: int) -> DataFrame:
    """How many rows exceed the limit and what they lose."""
    t, cut = F.col(tokens), F.col(tokens) > limit
    lost = F.when(cut, t - limit)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(cut).alias("truncated"), F.round(F.lit(100.0) * F.count_if(cut) / F.count(F.lit(1)), 6).alias("truncated_pct"),
        F.round(F.coalesce(F.avg(lost), F.lit(0.0)), 6).alias("mean_lost"), F.round(F.coalesce(F.avg(F.lit(100.0) * lost / t), F.lit(0.0)), 6).alias("mean_lost_pct"), F.coalesce(F.sum(lost), F.lit(0)).alias("total_lost"), F.round(F.avg(F.coalesce(lost, F.lit(0))), 6).alias("mean_lost_all"),
    ).withColumns({
        "advice": F.when(F.col("truncated_pct") > 50, "chunk").when(F.col("truncated_pct") > 20, "consider chunking").otherwise("fine"), "loss": F.when(F.col("mean_lost") > 100, "much lost").when(F.col("mean_lost") > 50, "some lost").otherwise("little lost"),
    })


def grouped(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Mean and median of a value for each value of each group column, independently, in one scan."""
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("value")) for g in groups]))
    flat = df.select(each.alias("_g"), F.col(value).alias("_v")).select("_g.grouping", "_g.value", "_v")
    return flat.groupBy("grouping", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_v"), 6).alias("mean"), F.round(F.median("_v"), 6).alias("median"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, label: str, pred: str, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1, macro and weighted F1; for each group with enough rows."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    n = {"tp": y & p, "fp": ~y & p, "fn": y & ~p, "tn": ~y & ~p}
    c = df.groupBy(*(by or [])).agg(*[F.count_if(v).alias(k) for k, v in n.items()]).withColumn("n", F.expr("tp + fp + fn + tn")).filter(F.col("n") >= least)
    r = lambda e: F.expr(f"round({e}, 6)")
    div = lambda a, b: f"(CASE WHEN {b} = 0 THEN 0.0D ELSE cast({a} AS double) / ({b}) END)"
    f1, f0 = div("2 * tp", "(2 * tp + fp + fn)"), div("2 * tn", "(2 * tn + fp + fn)")
    return c.select(
        *(by or []), "n", r(div("tp + tn", "n")).alias("accuracy"), r(div("tp", "(tp + fp)")).alias("precision"), r(div("tp", "(tp + fn)")).alias("recall"), r(f1).alias("f1"),
        r(f"({f1} + {f0}) / 2.0D").alias("macro_f1"), r(f"({f1} * (tp + fn) + {f0} * (tn + fp)) / n").alias("weighted_f1"),
    )


def _rank_sum(df: DataFrame, score: str, positive: Column, parts: int = 256) -> DataFrame:
    """n1, n0 and the rank sum of positives, ties sharing ranks: ranks come from counts by score, so ties cost one row.

    Scores are put in order within ranges (at most ``parts``), whose bounds are approximate quantiles;
    the ranges' counts give the ranks that come before. Bounds and ranks read the same columns of the
    counts by score, so that these are made and shuffled once.
    """
    told = df.withColumn("_y", positive).select(F.col(score).alias("_s"), "_y")
    by = kept(told, F.col("_s").isNotNull() & F.col("_y").isNotNull()).groupBy("_s").agg(F.count_if("_y").alias("p"), F.count(F.lit(1)).alias("n"))
    cuts = by.agg(F.percentile_approx("_s", [k / parts for k in range(1, parts)], 10_000).alias("_cuts"), F.sum("p").alias("n1"), F.sum("n").alias("all"))
    placed = by.crossJoin(F.broadcast(cuts)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col("_s")))).drop("_cuts")  # one row
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_part").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.withColumn("_before", before).groupBy("_part").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.sum(F.col("p") * (F.col("_before") + (F.col("n") + 1) / F.lit(2.0))).alias("r"), F.max("n1").alias("n1"), F.max("all").alias("all"),
    )
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    return ranges.withColumn("r", F.col("r") + F.col("p") * earlier).agg(F.max("n1").alias("n1"), F.max(F.expr("all - n1")).alias("n0"), F.sum("r").alias("r1"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    return _rank_sum(df, score, F.col(label) == 1).select(F.round(F.expr("(r1 - n1 * (n1 + 1) / 2.0D) / (n1 * n0)"), 6).alias("auc"))


def mann_whitney(df: DataFrame, score: str, label: str) -> DataFrame:
    return _rank_sum(df, score, F.col(label) == 1).select("n1", "n0", F.expr("r1 - n1 * (n1 + 1) / 2.0D").alias("u"))


def two_sided_p(u: float, n1: int, n0: int) -> float:
    """Normal approximation without a correction for ties."""
    spread = math.sqrt(n1 * n0 * (n1 + n0 + 1) / 12)
    return math.erfc(abs(u - n1 * n0 / 2) / spread / math.sqrt(2)) if spread else 1.0


def tfidf(df: DataFrame, id_col: str, text_col: str, min_df: int = 2, max_df: float = 0.95, features: int = 10_000) -> DataFrame:
    """(id, term, tf, weight): smoothed idf plus one, rows of length 1; the most frequent terms within the bounds."""
    # Dealt out by id once (as a struct, so that nulls are equal); terms are counted within the row, and norms are joined
    # to the terms without a shuffle or sort, so that a task holds its texts but never its terms.
    grouped = df.groupBy(F.struct(id_col).alias("_id")).agg(F.collect_list(F.lower(text_col)).alias("_texts"))
    split = F.flatten(F.transform("_texts", lambda t: F.filter(F.split(t, "[^a-z0-9]+"), lambda w: F.length(w) > 1)))
    starts = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    runs = lambda w: let(starts(w), lambda s: F.transform(s, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(s, k + 1), F.size(w)) - i).cast("bigint").alias("tf"))))
    counted = let(F.sort_array(split), lambda w: F.when(F.size(w) > 0, runs(w)))
    tf = grouped.select("_id", F.explode(counted).alias("_x")).select("_id", "_x.*")
    total = df.agg(F.count(F.lit(1)).alias("docs"))
    counts = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurs")).crossJoin(F.broadcast(total))  # one row
    kept = counts.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("docs"))).orderBy(F.desc("occurs"), "term").limit(features)
    weighed = tf.join(F.broadcast(kept), "term").withColumn("raw", F.col("tf") * (F.ln((F.lit(1.0) + F.col("docs")) / (F.lit(1.0) + F.col("df"))) + 1))
    norms = weighed.groupBy("_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_norm"))
    return weighed.join(norms.hint("shuffle_hash"), "_id").select(F.col("_id")[id_col].alias(id_col), "term", "tf", F.round(F.col("raw") / F.col("_norm"), 6).alias("weight"))


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    return df.groupBy(F.width_bucket(F.col(col).cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def compare_versions(df: DataFrame, version: str, metrics: dict[str, bool]) -> DataFrame:
    """Means of metrics by version and a point for each that is best (True: more is better)."""
    means = df.groupBy(version).agg(*[F.round(F.avg(m), 6).alias(m) for m in metrics])
    points = F.lit(0).cast("bigint")
    for m, more in metrics.items():
        best = (F.max if more else F.min)(m).over(Window.partitionBy())
        points = points + (F.col(m) == best).cast("bigint")
    return means.withColumn("points", points)


def vocabulary(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.explode(words(text_col)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
