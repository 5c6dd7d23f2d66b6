"""Reading and writing observation tables and results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.scale import enrich, take_lowest


def scan(spark: SparkSession, path: str, partition_keys: list[str] | None = None,
         columns: list[str] | None = None) -> DataFrame:
    """Observations of the given months; both filters reach the file listing."""
    df = spark.read.parquet(path)
    if partition_keys is not None:
        df = df.where(F.col("partition_key").isin(list(partition_keys)))
    return df.select(*columns) if columns else df


def resolve_column(columns: list[str], candidates: list[str], fallback: bool = False) -> str | None:
    """First candidate present, ignoring case; else the first column if asked."""
    present = {c.lower(): c for c in columns}
    for name in candidates:
        if name.lower() in present:
            return present[name.lower()]
    return columns[0] if fallback and columns else None


def rename_candidates(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Select one column per target name from its candidates, null when absent."""
    out = []
    for name, candidates in wanted.items():
        found = resolve_column(df.columns, candidates)
        out.append(
            (F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name)
        )
    return df.select(*out)


def without_void(df: DataFrame) -> DataFrame:
    """Columns that only ever hold null get a type that parquet can store."""
    return df.withColumns(
        {f.name: F.col(f.name).cast("double") for f in df.schema if f.dataType.typeName() == "void"}
    )


def write_slice(df: DataFrame, path: str, mode: str = "error") -> None:
    without_void(df).write.mode(mode).option("compression", "zstd").parquet(path)


def clustered_write(df: DataFrame, path: str, partition_by: str = "partition_key",
                    sort_by: tuple[str, ...] = ("tile_id", "latitude", "longitude"),
                    mode: str = "error", partitions: int | None = None) -> None:
    """Directory per partition key, files sorted so row-group ranges are narrow.

    The range split includes the sort columns, so a month that holds most rows
    still spreads over many writers.
    """
    keys = [partition_by, *sort_by]
    spread = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    spread.sortWithinPartitions(*keys).write.mode(mode).partitionBy(partition_by).parquet(path)


def fan_out(df: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """One row per (row, slice it belongs to), from a single pass."""
    labels = F.array(*[F.when(cond, F.lit(name)) for name, cond in slices.items()])
    return df.withColumn("label", F.explode(F.array_compact(labels)))


def write_fan_out(df: DataFrame, slices: dict[str, Column], path: str, mode: str = "error") -> None:
    """Write every slice under ``label=<name>`` while scanning once."""
    fan_out(without_void(df), slices).write.mode(mode).partitionBy("label").parquet(path)


def backfill(facts: DataFrame, location_keys: DataFrame,
             on: tuple[str, ...] = ("longitude", "latitude")) -> DataFrame:
    """Add key columns computed once per distinct coordinate."""
    return enrich(facts, location_keys, list(on))


def table_has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a readable, non-empty parquet table exists at ``path``."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target) or not fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        return False
    return not spark.read.parquet(path).isEmpty()


def ingest_datasets(spark: SparkSession, jobs: dict[str, tuple[str, Callable[[], DataFrame]]],
                    only: list[str] | None = None, skip_existing: bool = False) -> DataFrame:
    """Run ingest jobs ``name -> (path, build)`` and report what happened."""
    unknown = set(only or []) - set(jobs)
    if unknown:
        raise KeyError(f"unknown datasets: {sorted(unknown)}")
    report = []
    for name, (path, build) in jobs.items():
        if only and name not in only:
            continue
        if skip_existing and table_has_rows(spark, path):
            report.append((name, path, "skipped"))
        else:
            write_slice(build(), path, "overwrite")
            report.append((name, path, "written"))
    return spark.createDataFrame(report, "dataset string, path string, action string")


def write_result(df: DataFrame, path: str, fmt: str, mode: str = "error") -> None:
    """Result tables as CSV (with header) or JSON lines."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown result format {fmt!r}")
    writer = df.write.mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.json(path)


def representative_sample(df: DataFrame, max_rows: int, order: Column, order_range: int,
                          ties: list[str]) -> DataFrame:
    """Exactly ``max_rows`` rows (or all), the lowest of a reproducible order."""
    return take_lowest(df, [], order, ties, max_rows, order_range)


def collect_frame(df: DataFrame, max_rows: int):
    """At most ``max_rows`` rows as a pandas frame; the cap is mandatory."""
    return df.limit(int(max_rows)).toPandas()
