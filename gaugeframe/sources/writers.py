"""Sinks. Nothing that grows with the data is squeezed into one file."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import column

# The folder of the innermost stored_tables block, and of local applications without a shared one.
_folder: ContextVar[str | None] = ContextVar("stored-tables", default=None)
_local: dict[str, str] = {}

WRITE_MODES = ("overwrite", "ignore", "append", "error")


def write_json(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """JSON Lines; ``ignore`` keeps an existing output.

    ``single_file`` is for tables bounded by the configuration (a row per column or key).
    """
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}")
    (df.coalesce(1) if single_file else df).write.mode(mode).json(path)


def write_text(df: DataFrame, path: str, separator: str = ",") -> None:
    """One text line per row, columns joined; an existing output is kept."""
    line = F.concat_ws(separator, *[column(c).cast("string") for c in df.columns])
    df.select(line.alias("value")).write.mode("ignore").text(path)


def write_extended(df: DataFrame, path: str, format: str = "json", mode: str = "overwrite") -> None:
    """The source with its per-row quality columns, written by all tasks in parallel."""
    df.write.mode(mode).format(format).save(path)


def copy_source_quality(spark: SparkSession, folder: str, output: str) -> None:
    """Copy the stored quality report of a source unchanged."""
    write_json(spark.read.json(f"{folder}/source_quality"), f"{output}/source_quality")


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: one per
    application, removed when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    application = spark.sparkContext.applicationId
    if application in _local:
        return _local[application]
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    _local[application] = tempfile.mkdtemp(prefix="gaugeframe-")
    atexit.register(shutil.rmtree, _local[application], ignore_errors=True)
    return _local[application]


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[str]:
    """Tables stored inside go to one folder, which is removed at the end.

    For code that reads its results inside the block: a DataFrame on top of stored tables
    cannot be read after it. Outside of any block stored tables stay, as files of a
    checkpoint do, until the folder is cleaned.
    """
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    token = _folder.set(folder)
    try:
        yield folder
    finally:
        _folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of this table, not of the source.
    """
    spark = df.sparkSession
    path = f"{_folder.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
