"""Readers of text, CSV, JSON, JSON Lines and PDF trees into clean records."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import lexical as L
from quarry.functions import readability as R
from quarry.functions.text import normalise, paragraphs, word_count

#: Names of columns that hold the text or its summary, in any case; the first in a header wins.
ORIGINAL = tuple("abstract article body content document document_text full_text input original original_text source source_text text texto texto_original".split())
SUMMARY = tuple("lay_summary plain plain_language plain_language_summary plain_summary plainlanguage pls pls_text resumen simple simplified summary target".split())
#: Other names of datasets.
DATASETS = {"clinicaltrials.gov": "clinicaltrials", "trial summaries": "trialsummaries"}
SUFFIXES = ("txt", "csv", "json", "jsonl", "pdf")


def path_facts(path: Column) -> dict[str, Column]:
    """Dataset, bucket, split and label from the segments of a path in any case; "test" wins over "train", "non_pls" over "pls"."""
    parts = F.split(F.lower(F.url_decode(F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), "^[a-z]+:/*", "/"))), "/")
    at = F.array_position(parts, "raw").cast("int")
    has = lambda x: F.array_contains(parts, x)
    rest = F.slice(parts, at + 2, F.greatest(F.lit(0), F.size(parts) - at - 2))
    name, known = F.get(parts, at), F.create_map(*[F.lit(x) for pair in DATASETS.items() for x in pair])
    return {
        "source_dataset": F.when(at > 0, F.coalesce(F.try_element_at(known, name), name)).otherwise("unknown"), "source_bucket": F.when(at > 0, F.array_join(rest, "/")).otherwise(""),
        "split": F.when(has("test"), "test").when(has("train"), "train").otherwise("unsplit"), "label": F.when(has("non_pls") | has("non-pls"), "non_pls").when(has("pls"), "pls"),
    }


def pick_columns(header: list[str]) -> tuple[str, str | None]:
    """The columns of text and summary: the first with a known name in any case, else the first others."""
    text = next((h for h in header if h.lower().strip() in ORIGINAL), None)
    made = next((h for h in header if h.lower().strip() in SUMMARY), None)
    text = text or next((h for h in header if h != made), header[0])
    return text, made or next((h for h in header if h != text), None)


def _stem(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)\\.[^./]+$", 1)


def _rows(df: DataFrame, mark: str, first: int) -> DataFrame:
    """(path, pos, text, summary, and paired where that is told) to records; pos counts from 0.

    Both sides make a pair if the quality check passes them, or where ``paired`` says so.
    """
    sound = lambda c: L.is_valid(L.quality_issues(normalise(c), F.lit("en")))
    pair = sound("text") & sound("summary")
    pair = F.coalesce("paired", pair) if "paired" in df.columns else pair
    facts = path_facts(F.col("path"))
    return df.withColumns(facts).select(
        normalise("text").alias("texto_original"), normalise("summary").alias("resumen"), F.col("path").alias("source"),
        F.concat(F.col("source_dataset"), F.lit("_"), _stem(F.col("path")), F.lit(mark), (F.col("pos") + first).cast("string")).alias("doc_id"), "split", "label", "source_dataset", "source_bucket",
        pair.alias("has_pair"), F.col("pos").alias("_pos"),
    )


def _files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", text.alias("text"), "content")


def read_txt(spark: SparkSession, root: str) -> DataFrame:
    """A record for each paragraph of 20 words; "|||" once parts a text from its summary."""
    both = F.split("text", "\\|\\|\\|", 2)
    row = lambda t, m, p: F.struct(t.alias("text"), m.alias("summary"), p.alias("paired"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    parts = F.when(F.size(both) == 2, F.array(row(both[0], both[1], F.lit(True)))).otherwise(F.transform(paragraphs(normalise("text")), lambda p: row(p, none, no)))
    return _rows(_files(spark, root, "txt").select("path", F.posexplode(parts).alias("pos", "r")).select("path", "pos", "r.*"), "#p", 1)


def _chosen(keys: Column, names: tuple[str, ...]) -> Column:
    """The first key with a known name in any case."""
    return F.get(F.filter(keys, lambda k: F.array_contains(F.array(*map(F.lit, names)), F.lower(F.trim(k)))), 0)


def _of_map(df: DataFrame) -> DataFrame:
    """(path, pos, m, keys) to (path, pos, text, summary): names are looked up among the keys, else the first others are taken."""
    told = df.withColumns({"_t": _chosen(F.col("keys"), ORIGINAL), "_s": _chosen(F.col("keys"), SUMMARY)})
    text = F.coalesce("_t", F.get(F.filter("keys", lambda k: ~k.eqNullSafe(F.col("_s"))), 0), F.get("keys", 0))
    told = told.withColumn("_t", text)
    told = told.withColumn("_s", F.coalesce("_s", F.get(F.filter("keys", lambda k: ~k.eqNullSafe(F.col("_t"))), 0)))
    return told.select("path", "pos", F.try_element_at("m", F.col("_t")).alias("text"), F.try_element_at("m", F.col("_s")).alias("summary"))


def read_jsonl(spark: SparkSession, root: str) -> DataFrame:
    """A record for each line that is an object; blank and broken lines are skipped."""
    lines = _files(spark, root, "jsonl").select("path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    parsed = lines.select("path", "pos", F.from_json("line", "map<string,string>").alias("m")).filter(F.size("m") > 0)
    return _rows(_of_map(parsed.withColumn("keys", F.map_keys("m"))), "#l", 0)


def read_json(spark: SparkSession, root: str) -> DataFrame:
    """A record for each object of a file's array, or for its one object; the first object's keys tell the columns of all."""
    whole = _files(spark, root, "json")
    many = F.when(F.ltrim("text").startswith("["), F.col("text")).otherwise(F.concat(F.lit("["), F.col("text"), F.lit("]")))
    parsed = whole.select("path", F.from_json(many, "array<map<string,string>>").alias("all")).withColumn("keys", F.map_keys(F.get("all", 0)))
    return _rows(_of_map(parsed.select("path", "keys", F.posexplode("all").alias("pos", "m")).filter(F.size("m") > 0)), "#o", 0)


def read_csv(spark: SparkSession, root: str) -> DataFrame:
    """A record for each row. Files are parsed whole where they lie, each with its own encoding and header, in one plan however many there are."""

    def run(batches):
        import csv
        import io

        csv.field_size_limit(1 << 30)
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    text = data.decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = data.decode("latin-1")
                rows = csv.reader(io.StringIO(text, newline=""))
                header = next(rows, None)
                if not header:
                    continue
                first, second = pick_columns(header)
                at, to = header.index(first), header.index(second) if second else None
                cell = lambda row, k: row[k] if k is not None and k < len(row) and row[k] != "" else None
                found = [(cell(r, at), cell(r, to)) for r in rows if r]
                for a in range(0, len(found), 10_000):
                    part = found[a : a + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(a, a + len(part)), pa.int32()), *(pa.array([r[k] for r in part], pa.string()) for k in (0, 1))], names=["path", "pos", "text", "summary"])

    return _rows(_files(spark, root, "csv").select("path", "content").mapInArrow(run, "path string, pos int, text string, summary string"), "#r", 0)


def read_pdf(spark: SparkSession, root: str) -> DataFrame:
    """Paragraphs of PDF files, if the optional reader is installed; never paired."""
    import pandas as pd

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        import io

        from pypdf import PdfReader

        return s.map(lambda b: "\n".join((p.extract_text() or "") for p in PdfReader(io.BytesIO(b)).pages))

    whole = _files(spark, root, "pdf").select("path", text("content").alias("text"))
    return _rows(whole.select("path", F.posexplode(paragraphs(normalise("text"))).alias("pos", "text")).withColumn("summary", F.lit(None).cast("string")), "#pdf_p", 1)


def read_tree(spark: SparkSession, root: str, pdf: bool = False, lang: str = "en") -> DataFrame:
    """All files below ``root`` as clean records with measures; those of which the quality check rejects both sides are left out."""
    rows = read_txt(spark, root)
    for reader in (read_csv, read_json, read_jsonl) + ((read_pdf,) if pdf else ()):
        rows = rows.unionByName(reader(spark, root))
    issues = {f"_{k}": L.quality_issues(c, F.lit(lang), lang) for k, c in (("src", "texto_original"), ("pls", "resumen"))}
    kept = rows.withColumns(issues).filter(L.is_valid(F.col("_src")) | L.is_valid(F.col("_pls")))
    found = F.concat("_src", F.when(F.col("resumen") == "", F.array().cast("array<string>")).otherwise(F.col("_pls")))
    out = R.counts(kept.withColumn("_issues", found), "texto_original")
    return out.select(
        "texto_original", "resumen", "source", "doc_id", "split", "label", "source_dataset", "source_bucket", "has_pair", word_count("texto_original").cast("int").alias("word_count_src"), word_count("resumen").cast("int").alias("word_count_pls"),
        R.flesch().alias("flesch_score"), R.word_length().alias("avg_word_length"), L.domain_share("texto_original").alias("medical_density"), F.array_join("_issues", "|").alias("quality_issues"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("processing_date"), "_pos",
    )


def read_pairs(spark: SparkSession, path: str, source: str, target: str, least=(20, 10)) -> DataFrame:
    """JSON Lines pairs whose sides have enough words."""
    df = spark.read.schema(f"`{source}` string, `{target}` string").json(path)
    return df.filter((word_count(source) >= least[0]) & (word_count(target) >= least[1]))


def read_table(spark: SparkSession, path: str, renamed: dict[str, str] | None = None, needed: list[str] | None = None) -> DataFrame:
    """A Parquet table for training or evaluation: columns renamed, rows without text in a needed column left out."""
    df = spark.read.parquet(path).withColumnsRenamed(renamed or {})
    return complete(df, needed or df.columns)


def complete(df: DataFrame, needed: list[str]) -> DataFrame:
    """Rows whose needed columns are neither null nor blank."""
    for c in needed:
        df = df.filter(F.col(c).isNotNull() & F.col(c).cast("string").rlike("\\S"))
    return df


def read_corpus(spark: SparkSession, path: str, only_non_pls: bool = False, with_empty: bool = False) -> DataFrame:
    """Clean records as JSON Lines, if wanted only unsimplified ones, and without empty originals unless asked for."""
    df = spark.read.json(path)
    if only_non_pls:
        df = df.filter(F.col("label") == "non_pls")
    return df if with_empty else complete(df, ["texto_original"])


def first_existing(paths: list[str]) -> str | None:
    from pathlib import Path

    return next((p for p in paths if Path(p).exists()), None)
