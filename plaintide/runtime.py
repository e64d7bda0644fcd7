"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder, as named by the cluster's `spark.checkpoint.dir`; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="plaintide-"))
        folder = _local[0]
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes `df` as Parquet below the shared folder and goes on from there; survives lost executors.

    Columns are stored by position, so any names will do. `discard` deletes the files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/step-{uuid.uuid4().hex}"
    stored = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    empty = [c for c, kind in stored.dtypes if kind == "void"]
    stored = stored.withColumns({c: F.col(c).cast("string") for c in empty}) if empty else stored
    stored.write.parquet(path)
    read = spark.read.schema(stored.schema).parquet(path).toDF(*df.columns)
    read._stored_at = path
    return read


def discard(*frames: DataFrame) -> None:
    """Deletes what `cut_lineage` wrote for the frames; nothing may read them any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
