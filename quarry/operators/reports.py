"""Reports over runs: summaries, bands, scores, projections, decisions, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import lexical as L
from quarry.functions.text import preview, word_count
from quarry.operators.chunking import expand_tokens
from quarry.operators.filters import kept
from quarry.operators.stats import truncation


def summary(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """A row for each metric: mean, median, deviation, least, greatest, and how many rows meet its condition. One scan."""
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("v"), F.coalesce(test, F.lit(False)).alias("meets")) for k, test in metrics.items()])
    flat = df.select(F.explode(rows).alias("r")).select("r.*")
    return flat.groupBy("metric").agg(
        F.round(F.avg("v"), 6).alias("mean"), F.round(F.median("v"), 6).alias("median"), F.round(F.stddev("v"), 6).alias("std"), F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("most"),
        F.count_if("meets").alias("meets"),
    )


def at_thresholds(df: DataFrame, col: str, thresholds=(0.5, 0.6, 0.7, 0.75, 0.8, 0.9)) -> DataFrame:
    """One row: how many rows reach each threshold."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(col) >= t).alias(f"at_{round(t * 100)}") for t in thresholds])


def distribution(df: DataFrame, bands: dict[str, Column]) -> DataFrame:
    """(measure, band, n, pct): how the rows are spread over the bands of each measure. One scan."""
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), b.alias("band")) for k, b in bands.items()])
    counts = df.select(F.explode(rows).alias("r")).select("r.*").groupBy("measure", "band").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("measure").agg(F.sum("n").alias("_all"))
    return counts.join(total, "measure").select("measure", "band", "n", F.round(F.lit(100.0) * F.col("n") / F.col("_all"), 6).alias("pct"))


def run_score(df: DataFrame, by: list[str]) -> DataFrame:
    """Scores out of 100 for validity, readability, variety and freedom from repetition, and their mean; from valid, fre, ttr, repeated_trigrams."""
    part = lambda x: F.least(F.lit(100.0), x)
    out = df.groupBy(*by).agg(F.avg(F.col("valid").cast("double")).alias("_v"), F.avg("fre").alias("_f"), F.avg("ttr").alias("_t"), F.avg("repeated_trigrams").alias("_r"))
    made = {
        "validity": F.col("_v") * 100, "reading": part(F.greatest(F.lit(0.0), (F.col("_f") - 40) / 30 * 100)), "variety": part(F.col("_t") / 0.7 * 100), "freshness": part((F.lit(1.0) - F.col("_r") / 0.2) * 100),
    }
    out = out.withColumns(made)
    mean = (F.col("validity") + F.col("reading") + F.col("variety") + F.col("freshness")) / 4
    return out.select(*by, *[F.round(k, 6).alias(k) for k in made], F.round(mean, 6).alias("score"))


def compare_runs(df: DataFrame, version: str, low: int = 150, high: int = 250) -> DataFrame:
    """Means of fre, fkg and n_words by version, the share in range, up to eight points, and which version wins (the least name of equals)."""
    inside = F.avg(F.col("n_words").between(low, high).cast("double")) * 100
    m = df.groupBy(version).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("fre"), 6).alias("fre"), F.round(F.avg("fkg"), 6).alias("fkg"), F.round(F.avg("n_words"), 6).alias("n_words"), F.round(inside, 6).alias("in_range_pct"))
    points = (
        F.when(F.col("fre").between(60, 70), 3).when(F.col("fre").between(55, 75), 1).otherwise(0) + F.when(F.col("fkg").between(7, 9), 3).when(F.col("fkg") <= 10, 1).otherwise(0)
        + F.when(F.col("in_range_pct") >= 90, 2).when(F.col("in_range_pct") >= 80, 1).otherwise(0)
    )
    best = F.min_by(version, F.struct(-F.col("points"), F.col(version))).over(Window.partitionBy())  # a row for each version, and the texts are read once
    return m.withColumn("points", points).withColumn("winner", F.col(version).eqNullSafe(best))


def recommendations(df: DataFrame, low: int = 140, high: int = 210) -> DataFrame:
    """One row: what a run's statistics call for; from valid, n_words, fre, fkg and ttr."""
    s = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if(F.col("n_words") < low).alias("short"), F.count_if(F.col("n_words") > high).alias("long"),
        F.avg("fre").alias("fre"), F.avg("fkg").alias("fkg"), F.avg("ttr").alias("ttr"),
    )
    many = F.col("invalid") / F.col("n") > 0.2
    advice = F.array_compact(F.array(
        F.when(many & (F.col("short") > F.col("long")), "high: too many short texts, ask for more tokens"), F.when(many & (F.col("short") <= F.col("long")), "medium: too many long texts, ask for fewer tokens"),
        F.when(F.col("fre") < 60, "medium: hard to read, ask for shorter sentences"), F.when(F.col("fkg") > 9, "medium: grade too high, ask for plainer words"), F.when(F.col("ttr") < 0.5, "medium: words repeat, raise the penalty"),
    ))
    return s.select("n", "invalid", "short", "long", F.array_join(F.when(F.col("n") > 0, F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("none")))), " | ").alias("advice"))


def decision(df: DataFrame, share: float = 80.0) -> DataFrame:
    """One row: whether a run may go on: excellent, acceptable or not ready, from means of fre and fkg and the share of 150 to 250 words."""
    s = df.agg(F.round(F.avg("fre"), 6).alias("fre"), F.round(F.avg("fkg"), 6).alias("fkg"), F.round(F.avg(F.col("n_words").between(150, 250).cast("double")) * 100, 6).alias("in_range_pct"))
    fine = F.col("fre").between(55, 75) & (F.col("fkg") <= 10) & (F.col("in_range_pct") >= share)
    told = F.when(fine & (F.col("fre") >= 60) & (F.col("fkg") <= 9), "excellent").when(fine, "acceptable").otherwise("not ready")
    return s.withColumn("decision", told)


def cost_report(df: DataFrame, cost: str, sizes=(10_000, 20_000), per_minute: float = 500.0, slack: float = 1.2) -> DataFrame:
    """One row: total and mean cost, and for each planned size the cost and the minutes that it will take."""
    out = df.agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("_t"), F.avg(cost).alias("_m"))
    plans = [c for n in sizes for c in (F.round(F.coalesce("_m", F.lit(0.0)) * n, 6).alias(f"cost_{n}"), F.lit(round(n / per_minute * slack, 6)).alias(f"minutes_{n}"))]
    return out.select("n", F.round("_t", 6).alias("total"), F.round("_m", 9).alias("mean"), *plans)


def before_and_after(df: DataFrame, text: str, limit: int = 400, overlap: int = 50) -> DataFrame:
    """Two rows: rows and truncation statistics of whole texts and of their windows."""
    whole = df.select(F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\\s+"), lambda w: w != "")).cast("bigint").alias("n"))
    cut = expand_tokens(df.select(text), text, limit, overlap).select(F.col("chunk_tokens").cast("bigint").alias("n"))
    return truncation(whole, "n", limit).select(F.lit("before").alias("when"), "*").unionByName(truncation(cut, "n", limit).select(F.lit("after").alias("when"), "*"))


def short_lengths(df: DataFrame, source: str, target: str, limit: int = 512, special: int = 1) -> DataFrame:
    """One row: mean, median and greatest tokens (words and special ones) of both sides, and how many sources exceed the limit."""
    s, t = word_count(source) + special, word_count(target) + special
    stats = lambda x, n: [F.round(F.avg(x), 6).alias(f"{n}_mean"), F.round(F.median(x), 6).alias(f"{n}_median"), F.max(x).alias(f"{n}_most")]
    return df.agg(*stats(s, "source"), F.count_if(s > limit).alias("truncated"), F.round(F.lit(100.0) * F.count_if(s > limit) / F.count(F.lit(1)), 6).alias("truncated_pct"), *stats(t, "target"))


def compare_models(df: DataFrame, truth: str, baseline: str, improved: str, size: int = 200) -> DataFrame:
    """``df`` with previews, word counts, differences from the truth, and the improvement."""
    n = {k: word_count(c) for k, c in (("truth", truth), ("baseline", baseline), ("improved", improved))}
    off = {k: F.abs(n[k] - n["truth"]) for k in ("baseline", "improved")}
    return df.withColumns({
        **{f"{k}_preview": preview(c, size) for k, c in (("truth", truth), ("baseline", baseline), ("improved", improved))}, **{f"{k}_words": v for k, v in n.items()}, **{f"{k}_off": v for k, v in off.items()},
        "improvement": off["baseline"] - off["improved"],
    })


def comparison_summary(compared: DataFrame) -> DataFrame:
    """One row: mean differences of both models, the gain, and the share of rows that improved."""
    a, b = F.avg("baseline_off"), F.avg("improved_off")
    return compared.agg(F.count(F.lit(1)).alias("n"), F.round(a, 6).alias("baseline_off"), F.round(b, 6).alias("improved_off"), F.round(a - b, 6).alias("gain"), F.round(F.lit(100.0) * F.count_if(F.col("improvement") > 0) / F.count(F.lit(1)), 6).alias("improved_pct"))


def errors(df: DataFrame, label: str, pred: str, id_col: str, text: str, size: int = 200) -> DataFrame:
    """A row for each kind of error: how often it occurs, and the least id with its text's beginning."""
    kind = F.when((F.col(label) == 0) & (F.col(pred) == 1), "false_positive").when((F.col(label) == 1) & (F.col(pred) == 0), "false_negative")
    wrong = kept(df.withColumn("kind", kind), F.col("kind").isNotNull()).select("kind", F.col(id_col).alias("_id"), preview(text, size).alias("_t"))
    return wrong.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first_id"), F.min_by("_t", "_id").alias("first_text"))


def mean_words(df: DataFrame, text: str) -> DataFrame:
    """One row: mean words of a column of texts, 0 without rows."""
    return df.agg(F.round(F.coalesce(F.avg(word_count(text)), F.lit(0.0)), 6).alias("mean_words"))


def bands_of(fre: str = "fre", fkg: str = "fkg", ttr: str = "ttr") -> dict[str, Column]:
    return {"fre": L.fre_band(F.col(fre)), "fkg": L.fkg_band(F.col(fkg)), "ttr": L.ttr_band(F.col(ttr))}
