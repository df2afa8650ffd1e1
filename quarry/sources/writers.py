"""Sinks: curated records, splits, statistics, pairs, appended results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import content_key
from quarry.operators.dedup import first_of, unwritten


def curated(df: DataFrame) -> DataFrame:
    """Records without repetitions of text and summary; the first by path and place stays."""
    return first_of(df, [content_key("texto_original", "resumen")], ["source", "_pos"]).drop("_pos")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Columns in the given order, those that exist."""
    have = [c for c in (columns or df.columns) if c in df.columns]
    df.select(*have).write.mode("overwrite").csv(path, header=True, escape='"')


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def statistics(df: DataFrame) -> DataFrame:
    """One row: records, pairs, counts by source and by label (null: unlabeled), mean of readability scores that aren't 0."""
    counts = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    by = lambda c: df.groupBy(F.coalesce(c, F.lit("unlabeled")).alias(c)).agg(F.count(F.lit(1)).alias("n")).agg(counts(c).alias(f"by_{c}"))
    whole = df.agg(F.count(F.lit(1)).alias("records"), F.count_if("has_pair").alias("pairs"), F.avg(F.nullif(F.col("flesch_score"), F.lit(0.0))).alias("mean_flesch"))
    return whole.crossJoin(by("source_dataset")).crossJoin(by("label"))


def append_new(df: DataFrame, path: str, id_col: str) -> None:
    """Appends rows whose ids aren't there yet, so that a broken run can go on."""
    spark = df.sparkSession
    try:
        df = unwritten(df, spark.read.parquet(path), id_col)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").parquet(path)
