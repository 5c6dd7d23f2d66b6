"""Statistics and histograms per month and tile, and reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.bins import DIMENSIONS, Dimension, closed_histogram_bin, dense_counts
from skyloom.operators.scale import enrich

GROUP = ("partition_key", "tile_id")


def _row_dimensions(names: list[str]) -> list[Dimension]:
    return [DIMENSIONS[n] for n in names if DIMENSIONS[n].kind != "extent"]


def histogram_config(names: list[str] | None = None, spark=None) -> DataFrame:
    """Bin edges per dimension as a table."""
    rows = [
        (d.name, [str(e) for e in d.edges], d.n_bins, d.kind != "quarter")
        for d in (DIMENSIONS[n] for n in names or DIMENSIONS)
    ]
    return spark.createDataFrame(
        rows, "dimension string, bin_edges array<string>, n_bins int, numeric boolean"
    )


def partition_statistics(obs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Row counts, temperature and coordinate ranges and all histograms, in one pass.

    ``obs`` has a resolved ``temperature``.  Every row counts once in each
    dimension; counts are combined per month, tile, dimension and bin before the
    shuffle, of which there are few whatever the number of rows.
    """
    names = list(names or DIMENSIONS)
    dims = _row_dimensions(names)
    binned = obs.withColumns({f"b_{d.name}": d.bin_expr() for d in dims})
    if any(d.name == "temperature" for d in dims):
        binned = binned.withColumn(
            "b_temperature", F.when(F.col("temperature").isNotNull(), F.col("b_temperature"))
        )
    t = F.col("temperature").cast("double")
    # The entry named "" carries the plain statistics.
    entries = [F.struct(F.lit("").alias("dim"), F.lit(0).alias("bin"))] + [
        F.struct(F.lit(d.name).alias("dim"), F.col(f"b_{d.name}").alias("bin")) for d in dims
    ]
    split = binned.select(
        *GROUP, t.alias("t"), "longitude", "latitude", F.explode(F.array(*entries)).alias("e")
    ).where(F.col("e.bin").isNotNull())

    def once(value: str) -> Column:
        return F.when(F.col("e.dim") == "", F.col(value))

    per_bin = split.groupBy(*GROUP, "e.dim", "e.bin").agg(
        F.count(F.lit(1)).alias("n"), F.count(once("t")).alias("nt"), F.sum(once("t")).alias("st"),
        F.min(once("t")).alias("t0"), F.max(once("t")).alias("t1"),
        F.min(once("longitude")).alias("x0"), F.max(once("longitude")).alias("x1"),
        F.min(once("latitude")).alias("y0"), F.max(once("latitude")).alias("y1"),
    )

    def plain(c: str) -> Column:
        return F.max(F.when(F.col("dim") == "", F.col(c)))

    out = per_bin.groupBy(*GROUP).agg(
        plain("n").alias("row_count"), plain("t0").alias("value_min"), plain("t1").alias("value_max"),
        F.try_divide(plain("st"), plain("nt")).alias("value_mean"),
        plain("x0").alias("lon_min"), plain("x1").alias("lon_max"),
        plain("y0").alias("lat_min"), plain("y1").alias("lat_max"),
        *[
            dense_counts(
                F.collect_list(F.when(F.col("dim") == d.name, F.struct("bin", "n"))), d.n_bins
            ).alias(f"{d.name}_counts")
            for d in dims
        ],
    )
    for name, lo, hi in (("longitude", "lon_min", "lon_max"), ("latitude", "lat_min", "lat_max")):
        if name in names:
            out = out.withColumn(f"{name}_counts", occupancy(DIMENSIONS[name], F.col(lo), F.col(hi)))
    return out


def occupancy(dim: Dimension, low: Column, high: Column) -> Column:
    """1 for every bin between those of the minimum and maximum, else 0."""
    first, last = dim.bin_of(low), dim.bin_of(high)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim.n_bins - 1)),
        lambda i: F.when((i >= first) & (i <= last), F.lit(1)).otherwise(F.lit(0)).cast("long"),
    )


def histogram_rows(obs: DataFrame, dim: str, groups: list[str]) -> DataFrame:
    """(groups, bin, n) counts of one dimension, clamped to its range."""
    d = DIMENSIONS[dim]
    rows = obs.where(F.col("temperature").isNotNull()) if dim == "temperature" else obs
    return rows.groupBy(*groups, d.bin_expr().alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def densify(counts: DataFrame, groups: list[str], n_bins: int, name: str = "counts") -> DataFrame:
    """Arrays with a zero for every absent bin; no grid of groups and bins is built."""
    return counts.groupBy(*groups).agg(
        dense_counts(F.collect_list(F.struct("bin", "n")), n_bins).alias(name)
    )


def sum_arrays(df: DataFrame, groups: list[str], column: str) -> DataFrame:
    """Element-wise sum of an array column per group (or overall)."""
    summed = (
        df.select(*groups, F.posexplode(column).alias("pos", "v"))
        .groupBy(*groups, "pos").agg(F.sum("v").alias("v"))
    )
    entries = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return summed.groupBy(*groups).agg(F.transform(entries, lambda e: e["v"]).alias(column))


def sum_arrays_rollup(df: DataFrame, group: str, column: str) -> DataFrame:
    """Element-wise sums per group and overall (null group) from one shuffle."""
    summed = (
        df.select(group, F.posexplode(column).alias("pos", "v"))
        .groupBy(group, "pos").agg(F.sum("v").alias("v"))
    )
    total = summed.groupBy("pos").agg(F.sum("v").alias("v")).select(
        F.lit(None).cast(df.schema[group].dataType).alias(group), "pos", "v"
    )
    entries = F.array_sort(F.collect_list(F.struct("pos", "v")))
    return summed.unionByName(total).groupBy(group).agg(
        F.transform(entries, lambda e: e["v"]).alias(column)
    )


def partition_summary(stats: DataFrame) -> DataFrame:
    """Per month: tiles, rows, range and mean of tile means."""
    return stats.groupBy("partition_key").agg(
        F.count_distinct("tile_id").alias("n_tiles"), F.sum("row_count").alias("n_rows"),
        F.round(F.min("value_min"), 2).alias("value_min"), F.round(F.max("value_max"), 2).alias("value_max"),
        F.round(F.avg("value_mean"), 2).alias("value_mean"),
    )


def dataset_profile(obs: DataFrame, temperature: str = "temperature") -> DataFrame:
    """One row that describes a slice; columns absent from the slice are left out."""
    have = set(obs.columns)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if "tile_id" in have:
        aggs.append(F.count_distinct("tile_id").alias("n_tiles"))
    for c, digits in (("year", None), ("month_of_year", None), ("hour_of_day", 2)):
        if c in have:
            for fn, end in ((F.min, "min"), (F.max, "max")):
                value = fn(c) if digits is None else F.round(fn(c), digits)
                aggs.append(value.alias(f"{c}_{end}"))
    if temperature in have:
        t = F.col(temperature)
        for fn, name in ((F.avg, "mean"), (F.stddev_samp, "std"), (F.min, "min"), (F.max, "max")):
            aggs.append(F.round(fn(t), 3).alias(f"temperature_{name}"))
    for c in ("aster_lst", "modis_lst"):
        if c in have:
            aggs.append(F.count(c).alias(f"n_{c.split('_')[0]}"))
    if "ndvi" in have:
        aggs.append(F.round(F.count("ndvi") / F.count(F.lit(1)), 4).alias("ndvi_coverage_frac"))
    return obs.agg(*aggs)


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: filled rows, approximate distinct count, lowest and highest text."""
    columns = columns or df.columns
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    aggs = []
    for i, c in enumerate(texts):
        aggs += [
            F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}"),
            F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col("n_rows"), F.col(f"n{i}").alias("n_filled"),
            F.col(f"d{i}").alias("n_distinct_approx"), F.col(f"lo{i}").alias("value_min"),
            F.col(f"hi{i}").alias("value_max"),
        )
        for i, c in enumerate(columns)
    ]
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *aggs)
    return wide.select(F.inline(F.array(*rows)))


def value_sample(df: DataFrame, column: str, sample: int = 100) -> DataFrame:
    """The lowest distinct values of a column, at most ``sample``."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(sample)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), *columns
    )


def equal_width_histogram(df: DataFrame, column: str, edges: list[float],
                          groups: list[str] | None = None) -> DataFrame:
    """(bin, n) with a closed last bin; NaN and values outside are dropped."""
    b = closed_histogram_bin(F.col(column).cast("double"), edges)
    return (
        df.withColumn("bin", b).where(F.col("bin").isNotNull())
        .groupBy(*(groups or []), "bin").agg(F.count(F.lit(1)).alias("n"))
    )


def tile_mean_and_spread(df: DataFrame, value: str = "ndvi", tile: str = "tile_id",
                         prefix: str = "ndvi_struct") -> DataFrame:
    """Temporal mean and standard deviation of each tile, added to its rows.

    Computed as a map-side combined aggregate joined back, rather than a
    window, so that a tile with most of the rows is not gathered in one task.
    """
    stats = df.where(F.col(tile).isNotNull()).groupBy(tile).agg(
        F.avg(value).alias(f"{prefix}_mean"), F.stddev_samp(value).alias(f"{prefix}_std"),
        F.count(F.lit(1)).alias("n"),
    )
    return enrich(df, stats.drop("n"), [tile], stats.select(tile, "n"))


def distribution_report(obs: DataFrame) -> DataFrame:
    """Counts by year, month and whole hour in one pass."""
    entry = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("dimension"), F.floor(F.col(c)).cast("int").alias("value"))
                for n, c in (("year", "year"), ("month", "month_of_year"), ("hour", "hour_of_day"))
            ]
        )
    )
    joint = obs.groupBy("year", "month_of_year", F.floor("hour_of_day").alias("hour_of_day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return joint.select(entry.alias("e"), "n").groupBy("e.dimension", "e.value").agg(
        F.sum("n").alias("n")
    ).orderBy("dimension", "value")

