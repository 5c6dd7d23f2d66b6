"""Scoring months against a target distribution and sampling to it."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions.bins import DIMENSIONS
from skyloom.operators.scale import hash_order, running_total, take_lowest

# Anomalous periods, start included, end excluded.
OUTLIER_PERIODS = (
    ("heat_2006_summer", date(2006, 6, 1), date(2006, 9, 1)),
    ("warm_2007_apr", date(2007, 4, 1), date(2007, 5, 1)),
    ("cold_2010_winter", date(2010, 1, 1), date(2010, 3, 1)),
    ("cold_2012_feb", date(2012, 2, 1), date(2012, 3, 1)),
    ("heat_2013_summer", date(2013, 7, 1), date(2013, 9, 1)),
    ("heat_2015_summer", date(2015, 7, 1), date(2015, 9, 1)),
    ("drought_2018", date(2018, 5, 1), date(2018, 9, 1)),
    ("heat_2019_jun_jul", date(2019, 6, 1), date(2019, 8, 1)),
    ("heat_2020_aug", date(2020, 8, 1), date(2020, 9, 1)),
)


# --- calendar ---------------------------------------------------------------------


def expand_months(periods: DataFrame) -> DataFrame:
    """(label, start, end) to (label, partition_key), the end month excluded."""
    last = F.add_months(F.trunc("end", "MM"), -1)
    first = F.trunc("start", "MM")
    months = F.sequence(first, last, F.expr("interval 1 month"))
    each = periods.where(first <= last).select("label", F.explode(months).alias("month"))
    return each.select("label", F.date_format("month", "yyyy-MM").alias("partition_key"))


def period_table(spark: SparkSession, periods=OUTLIER_PERIODS) -> DataFrame:
    return spark.createDataFrame(list(periods), "label string, start date, end date")


def excluded_months(months: DataFrame) -> DataFrame:
    """Sorted distinct month keys of all periods."""
    return months.select("partition_key").distinct().orderBy("partition_key")


def months_outside(keys: DataFrame, excluded: DataFrame) -> DataFrame:
    return keys.join(excluded.select("partition_key").distinct(), "partition_key", "left_anti")


# --- targets and scores --------------------------------------------------------------


def target_vector(dimension: str, target: dict | None) -> list[float]:
    """Desired share per bin: uniform when empty, else normalised.

    A number goes to the bin with the nearest lower edge (the lower one on a
    tie), a label to its own bin or, when unknown, to the first.
    """
    dim = DIMENSIONS[dimension]
    if not target:
        return [1.0 / dim.n_bins] * dim.n_bins
    edges = dim.lower_edges
    total = float(sum(target.values()))
    out = [0.0] * dim.n_bins
    for value, weight in target.items():
        if isinstance(value, str):
            index = edges.index(value) if value in edges else 0
        else:
            index = min(range(len(edges)), key=lambda i: abs(float(edges[i]) - float(value)))
        out[index] += weight / total
    return out


def normalise_targets(targets: dict) -> dict[str, dict]:
    """Accept ``{dimension: {...}}`` or a flat ``{temperature: share}``."""
    if targets and all(isinstance(k, (int, float)) for k in targets):
        return {"temperature": targets}
    unknown = set(targets) - set(DIMENSIONS)
    if unknown:
        raise KeyError(f"unknown dimensions {sorted(unknown)}")
    return targets


def overlap(counts: Column, target: list[float]) -> Column:
    """Sum over bins of the smaller of actual and desired share; 0 without rows."""
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda a, v: a + v)
    wanted = F.array(*[F.lit(t) for t in target])
    shares = F.zip_with(counts, wanted, lambda c, t: F.least(F.try_divide(c.cast("double"), total), t))
    score = F.aggregate(shares, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return F.when(total > 0, score).otherwise(F.lit(0.0))


def score_partitions(histograms: DataFrame, targets: dict) -> DataFrame:
    """(partition_key, weight): product of overlaps, only positive weights.

    ``histograms`` has one row per month with ``<dimension>_counts`` arrays.
    """
    targets = normalise_targets(targets)
    weight = F.lit(1.0)
    for name, target in targets.items():
        weight = weight * overlap(F.col(f"{name}_counts"), target_vector(name, target))
    return (
        histograms.select("partition_key", weight.alias("weight"))
        .where(F.col("weight") > 0)
        .orderBy(F.desc("weight"), "partition_key")
    )


def quotas(weights: DataFrame, max_rows: int, key: str = "partition_key") -> DataFrame:
    """Whole-number shares of ``max_rows`` in proportion to the weights.

    Rounded down first; the remainder goes one by one to the heaviest, round
    robin.  The table has one row per month, so its windows are tiny.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.desc("weight"), key)
    share = F.floor(F.col("weight") / F.sum("weight").over(everything) * F.lit(max_rows)).cast("long")
    out = weights.withColumns(
        {"base": share, "place": F.row_number().over(ranked), "k": F.count(F.lit(1)).over(everything)}
    )
    left = F.lit(max_rows) - F.sum("base").over(everything)
    extra = F.floor(left / F.col("k")) + F.when(F.col("place") <= left % F.col("k"), 1).otherwise(0)
    return out.withColumn("quota", (F.col("base") + extra).cast("long")).where(
        F.col("quota") > 0
    ).select(key, "weight", "quota")


def sample_by_quota(obs: DataFrame, quota_table: DataFrame, order: Column, order_range: int,
                    ties: list[str], key: str = "partition_key") -> DataFrame:
    """Each month's rows with the lowest order, as many as its quota."""
    marked = obs.join(quota_table.select(key, "quota"), key)
    return take_lowest(marked, [key], order, ties, F.col("quota"), order_range).drop("quota")


def sequential_cap(obs: DataFrame, max_rows: int, order: Column, order_range: int,
                   ties: list[str], key: str = "partition_key") -> DataFrame:
    """Months in order until a total is reached; only the last month is cut.

    Counts per month give each its allowance, so nothing is sorted as a whole.
    """
    before = Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    allowance = (
        obs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("left", F.lit(max_rows) - F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where(F.col("left") > 0)
        .select(key, F.least("n", "left").alias("quota"))
    )
    return sample_by_quota(obs, allowance, order, order_range, ties, key)


def representative_plan(histograms: DataFrame, excluded: DataFrame, max_rows: int) -> DataFrame:
    """Quotas for a uniform year, month and hour, outside the excluded months."""
    kept = months_outside(histograms, excluded)
    uniform = {"year": {}, "month_of_year": {}, "hour_of_day": {}}
    return quotas(score_partitions(kept, uniform), max_rows)


# --- slices -------------------------------------------------------------------------


def point_time_filter(df: DataFrame, lon: float | None = None, lat: float | None = None,
                      year: int | None = None, month: int | None = None, day: int | None = None,
                      hour: float | None = None, tol_deg: float = 0.0005,
                      max_rows: int | None = None, ties: list[str] | None = None) -> DataFrame:
    """Rows near a point and time; year and month also prune partitions.

    ``max_rows`` keeps the lowest rows in the order of ``ties``, which it needs:
    without an order the rows would differ from run to run.
    """
    if max_rows is not None and not ties:
        raise ValueError("max_rows needs ties, the columns that order the rows")
    cond = F.lit(True)
    if lon is not None:
        cond &= F.col("longitude").between(lon - tol_deg, lon + tol_deg)
    if lat is not None:
        cond &= F.col("latitude").between(lat - tol_deg, lat + tol_deg)
    if year is not None:
        cond &= F.col("year") == year
        cond &= F.col("partition_key").startswith(f"{year:04d}-")
    if month is not None:
        cond &= F.col("month_of_year") == month
        if year is not None:
            cond &= F.col("partition_key") == f"{year:04d}-{month:02d}"
    if day is not None:
        cond &= F.col("day_of_month") == day
    if hour is not None:
        cond &= F.col("hour_of_day").between(hour - 0.5, hour + 0.5)
    out = df.where(cond)
    if max_rows is None:
        return out
    return out.orderBy(*ties).limit(max_rows)


def dominant_group(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the group with most rows; ties go to the lowest keys."""
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), *keys).limit(1)
    return df.join(top.select(*keys), keys, "left_semi")


def whole_group_cap(df: DataFrame, group: str, max_rows: int, order: Column | None = None) -> DataFrame:
    """Whole groups in random order until the cap is reached (last one kept whole)."""
    order = order if order is not None else hash_order(group)[0]
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("__o", order.cast("long"))
    per_order = sizes.groupBy("__o").agg(F.sum("n").alias("n"))
    before = running_total(per_order, "__o", ["n"]).select("__o", "n_before")
    # Groups that share an order value (a hash collision) go by their own value.
    same = Window.partitionBy("__o").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    kept = (
        sizes.withColumn("__same", F.coalesce(F.sum("n").over(same), F.lit(0)))
        .join(before, "__o")
        .where(F.col("n_before") + F.col("__same") < max_rows)
    )
    return df.join(kept.select(group), group, "left_semi")


def time_split(df: DataFrame, column: str = "year", share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Earlier rows to train on, the rest to test, cut at an exact quantile."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # Years are few: their counts fit the driver.
    rows = sorted((row[0], row["n"]) for row in counts.where(F.col(column).isNotNull()).collect())
    total, spot, seen, cut = sum(n for _, n in rows), share, 0, None
    for value, n in rows:
        seen += n
        if seen > spot * (total - 1):
            cut = value
            break
    return df.where(F.col(column) <= F.lit(cut)), df.where(F.col(column) > F.lit(cut))


def fold_of(order: Column, folds: int) -> Column:
    return F.pmod(order, F.lit(folds)).cast("int")
