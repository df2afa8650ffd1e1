"""Helpers for the operators: tables, the shared folder, Arrow functions, spare names."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Place of the public vocabulary files; a parameter of every function that reads one.
TOKENIZERS = os.environ.get("QUARRY_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one on a single machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def mounted(folder: str) -> Path:
    """The shared folder as a path that files can be opened under; it must be mounted."""
    scheme, colon, path = folder.partition(":")
    if not colon:
        return Path(folder)
    if scheme != "file":
        raise ValueError(f"sorting on disk needs a shared folder that is mounted, not {scheme}:")
    return Path("/" + path.lstrip("/"))


#: Folders of tables that ``written`` made and nothing has deleted yet.
_MADE: list[str] = []


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder: cuts lineage, survives lost executors.

    What isn't deleted by ``removed`` or ``cleared`` goes when the driver ends.
    """
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    name = folder.rstrip("/").rpartition("/")[2]
    _MADE[:] = [m for m in _MADE if m.rpartition("/")[2] != name]


def removed(df: DataFrame) -> None:
    """Deletes the table that ``written`` made, once nothing reads it any more."""
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def mark() -> int:
    """A point in time for ``cleared``."""
    return len(_MADE)


def cleared(since: int, *kept: DataFrame) -> None:
    """Deletes all tables written since the mark but those that ``kept`` read."""
    names = {file.rpartition("/")[0].rpartition("/")[2] for df in kept for file in df.inputFiles()}
    for folder in _MADE[since:]:
        if folder.rpartition("/")[2] not in names and (spark := SparkSession.getActiveSession()):
            _delete(spark, folder)


@atexit.register
def _leave() -> None:
    for folder in _MADE:
        if not folder.partition(":")[1] or folder.startswith("file:"):
            shutil.rmtree(mounted(folder), ignore_errors=True)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made from ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def column(df: DataFrame, name: str):
    """The column with this very name, whatever signs it has."""
    return df["`" + name.replace("`", "``") + "`"]


def added(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[list]], fields: list[tuple[str, str]], drop: Iterable[str] = ()) -> DataFrame:
    """``df`` with new columns that ``function`` makes of each Arrow batch; old ones of the same names go.

    fields: names and Spark types of the new columns. drop: columns of df left out.
    """
    gone = {c.lower() for c in drop} | {name.lower() for name, _ in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    new = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    schema = T.StructType(kept + new.fields)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + list(made), names=names + [n for n, _ in fields])

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """Texts of a batch, with "" for null."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def tokenizer_file(name: str, folder: str | None = None) -> str:
    path = Path(folder or TOKENIZERS) / name
    if not path.exists():
        raise FileNotFoundError(f"no vocabulary {path}; pass its folder")
    return str(path)
