"""Optional streaming form of curation: files in, first occurrences out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def deduplicated(stream: DataFrame, text_col: str, time_col: str, within: str = "1 day") -> DataFrame:
    """Rows of a stream whose text didn't occur within the watermark."""
    keyed = stream.withColumn("_key", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    return keyed.withWatermark(time_col, within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended as Parquet, then stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
