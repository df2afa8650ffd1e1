"""Exact deduplication, decontamination, unions, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import gram_hashes, words


def first_of(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order, which decides ties, so make it total.

    An aggregate, not a window: rows that aren't the first of their task go before the shuffle.
    """
    named = {f"_k{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(keys)}
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), F.struct(*order).alias("_order"), *[c.alias(n) for n, c in named.items()])
    return rows.groupBy(*named).agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def duplicate_groups(df: DataFrame, key: Column | str, id_col: str) -> DataFrame:
    """Keys that occur more than once: how often, and the least id."""
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).filter("n > 1")


#: Runs of held-out texts (8 bytes each) that are broadcast; beyond it both sides are shuffled, behind Spark's runtime Bloom filter.
BROADCAST_RUNS = 4_000_000


def contaminated(docs: DataFrame, held_out: DataFrame, id_col: str, text_col: str = "text", n: int = 8) -> DataFrame:
    """Ids of documents that share a run of n words with held-out texts; runs are compared by 64-bit hashes."""
    gram = lambda df: F.explode(F.array_distinct(gram_hashes(F.transform(words(text_col), F.lower), n)))
    known = held_out.select(gram(held_out).alias("gram")).distinct()
    if known.count() <= BROADCAST_RUNS:
        known = F.broadcast(known)
    return docs.select(id_col, gram(docs).alias("gram")).join(known, "gram", "left_semi").select(id_col).distinct()


def unwritten(df: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Rows whose ids aren't in what an earlier run wrote."""
    return df.join(done.select(id_col).distinct(), id_col, "left_anti")
