"""Incremental versions of the batch statistics as Structured Streaming jobs.

Each micro-batch adds its own mergeable rows under ``batch=<id>``, overwriting
only itself, so a batch that runs twice changes nothing.  Reading merges the
rows of all batches; the state is as big as the statistics, not as the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.bins import DIMENSIONS
from skyloom.operators.gram import Gram, gram_by, square
from skyloom.operators.ranks import column_quantiles
from skyloom.operators.scale import take_lowest
from skyloom.plans.features import PLACE


def _x(name: str) -> Column:
    v = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(v), v)


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = 1, **options) -> DataFrame:
    """A stream over a parquet folder with the schema of what is there; without ``files_per_batch`` all that is new is one batch."""
    schema = spark.read.options(**options).parquet(path).schema
    stream = spark.readStream.schema(schema).options(**options)
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(path)


def run_partials(stream: DataFrame, partial: Callable[[DataFrame, int], DataFrame], path: str,
                 mode: str = "append") -> None:
    """Run the stream to its present end, one partial result per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch, batch_id).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")


# --- features attached to a stream -----------------------------------------------------


def attach_features(stream: DataFrame, features: DataFrame, path: str) -> None:
    """Join each micro-batch with the place-feature table and append it."""
    joined = stream.join(features, list(PLACE), "left")
    query = (
        joined.writeStream.format("parquet").option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress").outputMode("append")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


# --- scaler statistics ---------------------------------------------------------------


def scaler_partial(columns: Sequence[str]) -> Callable[[DataFrame, int], DataFrame]:
    def partial(batch: DataFrame, _: int) -> DataFrame:
        rows = [
            F.struct(
                F.lit(c).alias("column"), F.count(_x(c)).alias("n"), F.avg(_x(c)).alias("mean"),
                (F.var_pop(_x(c)) * F.count(_x(c))).alias("m2"), F.min(_x(c)).alias("min"),
                F.max(_x(c)).alias("max"),
            )
            for c in columns
        ]
        return batch.agg(F.array(*rows).alias("r")).select(F.inline("r"))

    return partial


def merged_scaler(rows: DataFrame) -> DataFrame:
    """Combine per-batch moments: total mean, then within plus between spread."""
    total = rows.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"),
        F.sum("m2").alias("within"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"),
        F.min("min").alias("min"), F.max("max").alias("max"),
    )
    mean = F.try_divide("s", "n")
    m2 = F.col("within") + F.greatest(F.lit(0.0), F.col("q") - F.col("s") * mean)
    return total.select("column", "n", mean.alias("mean"), F.try_divide(m2, F.col("n")).alias("var"), "min", "max")


# --- smoothed medians ------------------------------------------------------------------

KEEP_SHARE = 0.9  # fixed value: weight of the old median


def median_partial(columns: Sequence[str]) -> Callable[[DataFrame, int], DataFrame]:
    def partial(batch: DataFrame, _: int) -> DataFrame:
        found = column_quantiles(batch, columns, [0.5])
        rows = [(c, found[c][0]) for c in columns]
        return batch.sparkSession.createDataFrame(rows, "column string, median double")

    return partial


def smoothed_medians(rows: DataFrame, keep: float = KEEP_SHARE) -> DataFrame:
    """Exponential average in batch order; the first batch sets the start."""
    ordered = rows.where(F.col("median").isNotNull()).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("batch", "median"))).alias("m")
    )
    first = F.get("m", F.lit(0))["median"]
    rest = F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0)))
    smooth = F.aggregate(rest, first, lambda acc, e: acc * F.lit(keep) + e["median"] * F.lit(1 - keep))
    return ordered.select("column", smooth.alias("median"))


# --- metrics ---------------------------------------------------------------------------


def metric_partial(prediction: str, target: str) -> Callable[[DataFrame, int], DataFrame]:
    def partial(batch: DataFrame, _: int) -> DataFrame:
        y, e = _x(target), _x(prediction) - _x(target)
        sums = batch.where(y.isNotNull() & e.isNotNull()).agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(e * e), F.lit(0.0)).alias("sse"),
            F.coalesce(F.sum(F.abs(e)), F.lit(0.0)).alias("sae"), F.coalesce(F.sum(y), F.lit(0.0)).alias("sy"),
            F.coalesce(F.sum(y * y), F.lit(0.0)).alias("syy"),
        )
        return sums

    return partial


def metric_history(rows: DataFrame) -> DataFrame:
    """Error measures of every batch."""
    return rows.select("batch", *_measures())


def running_metrics(rows: DataFrame) -> DataFrame:
    """Error measures over all batches so far."""
    total = rows.agg(*[F.sum(c).alias(c) for c in ("n", "sse", "sae", "sy", "syy")])
    return total.select(*_measures())


def _measures() -> list[Column]:
    n, sse = F.col("n"), F.col("sse")
    sst = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    return [
        F.col("n").alias("n_rows"), F.sqrt(F.try_divide(sse, n)).alias("rmse"),
        F.try_divide(F.col("sae"), n).alias("mae"), (F.lit(1.0) - F.try_divide(sse, sst)).alias("r2"),
    ]


# --- reservoir ---------------------------------------------------------------------------


def reservoir_partial(order: Column, order_range: int, ties: list[str], k: int):
    """Lowest ``k`` rows of a batch; the lowest of all batches are a uniform sample."""

    def partial(batch: DataFrame, _: int) -> DataFrame:
        return take_lowest(batch, [], order, ties, k, order_range)

    return partial


def reservoir(rows: DataFrame, order: Column, order_range: int, ties: list[str], k: int) -> DataFrame:
    return take_lowest(rows.drop("batch"), [], order, ties, k, order_range)


# --- histogram catalog and products --------------------------------------------------------


def histogram_counts(stream: DataFrame, dim: str, groups: list[str]) -> DataFrame:
    """Streaming counts per group and bin; Spark keeps one number per key."""
    d = DIMENSIONS[dim]
    return stream.groupBy(*groups, d.bin_expr().alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def latest_counts(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Last update of every key (update mode sends changed keys only)."""
    return rows.groupBy(*groups, "bin").agg(F.max_by("n", "batch").alias("n"))


def gram_partial(columns: Sequence[str]) -> Callable[[DataFrame, int], DataFrame]:
    return lambda batch, _: gram_by(batch.dropna("any", subset=list(columns)), columns)


def merged_gram(rows: DataFrame, columns: Sequence[str]) -> Gram:
    summed = rows.where(F.col("n") > 0).select("n", F.posexplode("products").alias("pos", "v")).groupBy("pos").agg(
        F.sum("v").alias("v"), F.sum("n").alias("n")
    )
    got = summed.orderBy("pos").collect()  # one small matrix
    return Gram(list(columns), int(got[0]["n"]), square([r["v"] for r in got], len(columns)))


