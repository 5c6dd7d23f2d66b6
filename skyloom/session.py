"""Session construction and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: list[str] = []


def local_session(cores: int | str = 8, memory: str = "16g", name: str = "skyloom") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # call-site capture costs more than the expressions it annotates
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str | None:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, gets a
    temporary folder when the setting is absent; it goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        if not _LOCAL_SCRATCH:
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            _LOCAL_SCRATCH.append(folder)
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        return _LOCAL_SCRATCH[0]
    return None


def new_table_path(spark: SparkSession, label: str) -> str:
    base = shared_dir(spark)
    if base is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(base, "skyloom", f"{label}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several branches: later branches read a columnar
    table instead of recomputing the scan, and a lost executor costs one task.
    The folder must be set; a plan that silently stays lazy would grow with
    every step that reads it twice.
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a written table that nothing will read again, wherever its files are."""
    files = df.inputFiles()
    if files:
        context = df.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
