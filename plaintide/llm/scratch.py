"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_local: list[str] = []
#: Tables of the step that the present thread is in.
_step: ContextVar[list[str] | None] = ContextVar("step", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; a temporary one only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="plaintide-llm-"))
        folder = _local[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (_written if _step.get() is None else _step.get()).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: short lineage that outlives an executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` gives as a written table; the tables that `make` wrote on its way are deleted, also if it fails."""
    path, own = new_path(spark, name), []
    outer = _step.set(own)
    try:
        df = make()
        df.write.parquet(path)
    finally:
        _step.reset(outer)
        _delete(spark, own)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored_at = path
    return found


def discard(df: DataFrame) -> None:
    """Deletes a table of `written_alone` that nothing reads any more; other tables stay."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, [path])


def release(spark: SparkSession) -> None:
    """Deletes the tables written so far; call it when the results that read them are stored."""
    _delete(spark, _written)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(hadoop).delete(path, True)
