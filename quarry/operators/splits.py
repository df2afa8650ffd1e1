"""Reproducible splits and samples by hash ranks, leakage and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256)


def ranked(df: DataFrame, id_col: str, strata: list[str], seed: str = "42", digits: int = 4) -> DataFrame:
    """``df`` with ``_rank``, its place in its stratum by hash, and ``_n``, the stratum's size.

    Rows are put in order within 16**digits buckets of the hash, and the buckets' counts are
    summed up, so that no stratum, however large, is put in order by one task.
    """
    marked = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_b", F.substring("_h", 1, digits))
    counts = marked.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    by = Window.partitionBy(*strata)
    starts = counts.select(*[F.col(s).alias(f"_s{k}") for k, s in enumerate(strata)], F.col("_b").alias("_sb"), (F.sum("_c").over(by.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(by).alias("_n"))
    same = F.col("_b") == F.col("_sb")
    for k, s in enumerate(strata):
        same = same & F.col(s).eqNullSafe(F.col(f"_s{k}"))
    own = marked.withColumn("_own", F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", id_col)))
    return own.join(starts, same).withColumn("_rank", F.col("_before") + F.col("_own")).select(*df.columns, "_rank", "_n")


def stratified(df: DataFrame, id_col: str, strata: list[str], fraction: float, seed: str = "42") -> DataFrame:
    """``df`` with ``chosen``: exactly round-half-even(fraction * n) rows of each stratum, by hash rank; null strata choose none."""
    known = F.lit(True)
    for s in strata:
        known = known & F.col(s).isNotNull()
    return ranked(df, id_col, strata, seed).withColumn("chosen", known & (F.col("_rank") <= F.bround(F.lit(fraction) * F.col("_n")))).drop("_rank", "_n")


def split_existing(df: DataFrame, id_col: str, label: str, split: str = "split", test: float = 0.2, dev: float = 0.1, seed: str = "42") -> DataFrame:
    """Train, dev and test where given splits stay (``original``), others are drawn by label (``internal``, ``internal_dev``)."""
    given = df.filter(F.col(split).isin("train", "test")).withColumn("split_method", F.lit("original"))
    open_ = stratified(df.filter(~F.coalesce(F.col(split).isin("train", "test"), F.lit(False))), id_col, [label], test, seed)
    drawn = open_.withColumn(split, F.when(F.col("chosen"), "test").otherwise("train")).withColumn("split_method", F.lit("internal")).drop("chosen")
    both = given.unionByName(drawn)
    devs = stratified(both.filter(F.col(split) == "train"), id_col, [label], dev, seed + "dev")
    devs = devs.withColumns({"split_method": F.when(F.col("chosen"), "internal_dev").otherwise(F.col("split_method")), split: F.when(F.col("chosen"), "dev").otherwise(F.col(split))}).drop("chosen")
    return both.filter(F.col(split) != "train").unionByName(devs)


def split_by_key(df: DataFrame, key: Column, cuts=(0.8, 0.9), seed: str = "42") -> DataFrame:
    """``df`` with ``split`` by a hash of the key, so that equal keys, such as chunks of one parent, never part."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), key), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return df.withColumn("split", F.when(part < cuts[0], "train").when(part < cuts[1], "dev").otherwise("test"))


def split_two_steps(df: DataFrame, key: Column, train: float = 0.8, seed: str = "42") -> DataFrame:
    """``df`` with ``split``: the first ``train`` of the distinct keys, in the order of a hash, train; of the rest, half dev and half test.

    Shares are exact to a key (halves up), and rows with one key never part.
    """
    keyed = df.withColumn("_key", key)
    one = ranked(keyed.select("_key").distinct().withColumn("_all", F.lit(1)), "_key", ["_all"], seed)
    cut = F.floor(F.lit(train) * F.col("_n") + 0.5)
    half = cut + F.floor((F.col("_n") - cut + 1) / 2)
    told = one.select("_key", F.when(F.col("_rank") <= cut, "train").when(F.col("_rank") <= half, "dev").otherwise("test").alias("split"))
    return keyed.join(told.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k"))).select(*df.columns, "split")


def leakage(df: DataFrame, key: Column | str, split: str = "split") -> DataFrame:
    """Keys that occur in more than one split."""
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias("key")).agg(F.count_distinct(split).cast("bigint").alias("n_splits")).filter("n_splits > 1")


def shares(df: DataFrame, col: str) -> DataFrame:
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def drift(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """The largest difference of a label's share between any split and the whole; the windows see a row for each split and label."""
    whole = Window.partitionBy()
    n = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("own", F.col("n") / F.sum("n").over(Window.partitionBy(split))).withColumn("all", F.sum("n").over(Window.partitionBy(label)) / F.sum("n").over(whole))
    return n.agg(F.round(F.max(F.abs(F.col("own") - F.col("all"))), 6).alias("drift"))


def sample(df: DataFrame, id_col: str, n: int, seed: str = "42") -> DataFrame:
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


def sanity(df: DataFrame, source: str, target: str, least_rows: int = 100, ratios=(0.1, 1.0)) -> DataFrame:
    """One row of checks of an evaluation set: figures, and whether size, ratio of lengths, blanks and repetitions are as they should be."""
    n = lambda c: F.coalesce(F.regexp_count(F.col(c), F.lit("\\S+")), F.lit(0))
    out = df.agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg(n(source)), 6).alias("source_words"), F.round(F.avg(n(target)), 6).alias("target_words"), F.count_if(n(source) == 0).alias("blank_sources"),
        F.count_if(n(target) == 0).alias("blank_targets"), (F.count(source) - F.count_distinct(source)).alias("repeated_sources"),
    )
    ratio = F.col("target_words") / F.nullif(F.col("source_words"), F.lit(0.0))
    return out.withColumns({
        "size_ok": F.col("rows") >= least_rows, "ratio_ok": F.coalesce(ratio.between(*ratios), F.lit(False)), "blanks_ok": (F.col("blank_sources") == 0) & (F.col("blank_targets") == 0), "distinct_ok": F.col("repeated_sources") == 0,
    })
