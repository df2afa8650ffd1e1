"""Mixing sources to target weights by systematic sampling.

Each document expects ``total * weight(source) / size(source)`` copies. Within a source,
in an order given by a seeded hash, the expected copies are summed up, one random offset
is added, and a document is emitted once for every integer boundary that its part of the
sum crosses. So each document's copies differ from its expectation by less than one, and
the copies of a source of n documents from the target by less than 1 + n / 1,000,000, as
expectations are cut down to whole millionths, in the SQL too.

The prefix sums take two levels: sums within buckets of the hash, and offsets of the
buckets, so that no source, however hot, is put in order by one task. All arithmetic is in
integers (millionths of a copy), so that results don't depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import column, spare

#: Parts of one expected copy.
UNIT = 1_000_000
#: Rows of a bucket, about; the number of buckets follows the number of rows.
BUCKET_ROWS = 4096
#: Production weights: the hot source is held to a tenth, others share alike.
WEIGHTS, OTHERS, SEED = {"src0": 2.0}, 1.0, "mix-1"


def _number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    others: float = OTHERS,
    total: int | None = None,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    copy_col: str | None = "copy",
) -> DataFrame:
    """``docs`` with each row repeated so that sources have their target shares of rows.

    weights: by source; ``others`` for any source that isn't named. total: rows wanted in
    all; None: as many as ``docs`` has. copy_col: added column that numbers a row's copies
    from 1; None: none is added; a column of that name in ``docs`` is replaced.

    Null sources form a source of their own (weight ``others``), apart from "". Null ids
    sort first. Null or empty texts are rows like any other. Repeated rows are separate
    rows; ties of the hash are settled by id and then by text. A weight of 0 drops a
    source, negative ones are refused. An empty table gives an empty table. Other columns
    are kept.
    """
    weights = WEIGHTS if weights is None else weights
    if others < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    if copy_col:
        docs = docs.select(*[column(docs, c) for c in docs.columns if c.lower() != copy_col.lower()])
    rows = docs.count()
    total = rows if total is None else total
    digits = 1
    while 16**digits * BUCKET_ROWS < rows and digits < 7:
        digits += 1
    key, h, bucket, size, each, before, at, offset, copies = spare(docs, "k", "h", "b", "size", "each", "before", "at", "offset", "copies")
    source, ident = column(docs, source_col), column(docs, id_col).cast("string")
    marked = docs.withColumns({
        key: F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")),
        h: F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(ident, F.lit("null")))),
    }).withColumn(bucket, F.substring(F.col(h), 1, digits))

    # A row per source and bucket, far fewer than documents.
    weight = F.lit(float(others))
    for name, w in weights.items():
        weight = F.when(F.col(key) == F.lit("s" + name), F.lit(float(w))).otherwise(weight)
    counts = marked.groupBy(key, bucket).agg(F.count(F.lit(1)).alias(size))
    sizes = counts.groupBy(key).agg(F.sum(size).alias("n")).withColumn("w", (weight * UNIT).cast("bigint").cast("decimal(20,0)"))
    # A decimal quotient, cut down to whole units of a copy.
    sums = sizes.agg(F.sum("w").alias("all"))
    shares = sizes.crossJoin(F.broadcast(sums)).select(  # the other side is one row
        key,
        F.coalesce(F.expr(f"cast((w * {int(total)} * {UNIT}BD) div nullif(all * n, 0) as bigint)"), F.lit(0)).alias(each),
        F.pmod(_number(F.concat_ws("|", F.lit(seed), F.col(key)), 12), F.lit(UNIT)).alias(offset),
    )
    by_bucket = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn(before, F.coalesce(F.sum(size).over(by_bucket), F.lit(0))).join(shares, key).select(key, bucket, before, each, offset)

    ordered = Window.partitionBy(key, bucket).orderBy(F.col(h), column(docs, id_col), column(docs, text_col))
    placed = marked.withColumn(at, F.row_number().over(ordered)).join(starts, [key, bucket])
    # Copies: boundaries between the sums before and after the row.
    high = F.expr(f"(`{each}` * (`{before}` + `{at}`) + `{offset}`) div {UNIT}")
    low = F.expr(f"(`{each}` * (`{before}` + `{at}` - 1) + `{offset}`) div {UNIT}")
    placed = placed.withColumn(copies, high - low).filter(F.col(copies) > 0)
    number = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copy_col or copies)
    out = placed.select(*[column(docs, c) for c in docs.columns], number)
    return out if copy_col else out.drop(copies)


#: DuckDB SQL for the production query over the view that is named.
SQL = """
WITH k AS (SELECT doc_id, source, text, coalesce('s' || source, 'n') AS k,
    md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM {docs}),
sizes AS (SELECT k, count(*) AS n, CAST(CASE WHEN k = 'ssrc0' THEN 2.0 ELSE 1.0 END * 1000000 AS HUGEINT) AS w FROM k GROUP BY k),
shares AS (SELECT k, CAST((w * (SELECT sum(n) FROM sizes)::HUGEINT * 1000000) // ((SELECT sum(w) FROM sizes)::HUGEINT * n) AS BIGINT) AS each,
    CAST('0x' || substr(md5('{seed}|' || k), 1, 12) AS BIGINT) % 1000000 AS o FROM sizes),
ranked AS (SELECT k.*, each, o, row_number() OVER (PARTITION BY k.k ORDER BY h, doc_id NULLS FIRST, text NULLS FIRST) AS pos FROM k JOIN shares USING (k)),
copies AS (SELECT *, (each * pos + o) // 1000000 - (each * (pos - 1) + o) // 1000000 AS copies FROM ranked)
"""


def op1_mixing(spark, sf_dir):
    """Documents at the production weights: ids, sources and the number of the copy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "source", "text", "copy")


QUERIES = {"op1_mixing": op1_mixing}
ORACLE = {
    "op1_mixing": SQL.format(seed=SEED, docs="documents")
    + "SELECT doc_id, source, text, CAST(unnest(generate_series(1, copies)) AS INTEGER) AS copy FROM copies WHERE copies > 0"
}
