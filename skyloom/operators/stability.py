"""How steady a result is over many datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL_DATASET_ROWS = 10_000  # fixed value: smaller datasets are the spatial tier


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def _spread(v: Column, ddof: int) -> Column:
    one = F.stddev_pop(v) if ddof == 0 else F.stddev_samp(v)
    return F.when(F.count(v) > 0, F.coalesce(one, F.lit(0.0)))


def spread_stats(value: Column, prefix: str, ddof: int = 1) -> list[Column]:
    """mean, std, cv, min, max and n of a value."""
    mean, std = F.avg(value), _spread(value, ddof)
    return [
        mean.alias(f"{prefix}_mean"), std.alias(f"{prefix}_std"),
        (std / (mean + F.lit(1e-6))).alias(f"{prefix}_cv"), F.min(value).alias(f"{prefix}_min"),
        F.max(value).alias(f"{prefix}_max"), F.count(value).alias(f"{prefix}_n"),
    ]


def stability_of(cv: str) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.col(cv))


def sign_share(value: Column) -> Column:
    pos, n = F.count_if(value > 0), F.count(value)
    return F.try_divide(F.greatest(pos, n - pos).cast("double"), n)


def pair_stability(results: DataFrame, ddof: int = 1, full_rows: int = FULL_DATASET_ROWS) -> DataFrame:
    """Per feature pair over datasets; the small ones only vote on the sign.

    ``results`` has dataset, n_rows, feature and source columns, pearson_r,
    spearman_r and mi.
    """
    keys = ["feature_a", "source_a", "feature_b", "source_b"]
    full = F.col("n_rows") >= full_rows
    tiers = results.withColumns(
        {
            "pf": F.when(full, _finite("pearson_r")), "ps": F.when(~full, _finite("pearson_r")),
            "sf": F.when(full, _finite("spearman_r")), "mf": F.when(full, _finite("mi")),
        }
    )
    out = tiers.groupBy(*keys).agg(
        F.count_if(full).alias("n_full"), F.count_if(~full).alias("n_spatial"),
        *spread_stats(F.abs("pf"), "pearson", ddof), *spread_stats(F.abs("sf"), "spearman", ddof),
        *spread_stats(F.col("mf"), "mi", ddof), sign_share(F.col("pf")).alias("sign_share"),
        F.sum("pf").alias("__sum"), F.count_if(F.col("ps") > 0).alias("__pos"), F.count("ps").alias("__spatial"),
    )
    same = F.when(F.col("__sum") > 0, F.col("__pos")).otherwise(F.col("__spatial") - F.col("__pos"))
    return out.withColumns(
        {
            "stability": stability_of("pearson_cv"),
            "spatial_agree": F.when(
                F.col("__sum").isNotNull() & (F.col("__spatial") > 0),
                same.cast("double") / F.col("__spatial"),
            ),
        }
    ).drop("__sum", "__pos", "__spatial")


def feature_stability(results: DataFrame, full_rows: int = FULL_DATASET_ROWS) -> DataFrame:
    """Per feature over the full datasets, strongest mean absolute r first."""
    v = _finite("pearson_r")
    rows = results.where(F.col("n_rows") >= full_rows).withColumn("v", v)
    out = rows.groupBy("feature").agg(
        F.avg("v").alias("mean_r"), *spread_stats(F.abs("v"), "abs_r"), sign_share(F.col("v")).alias("sign_share")
    )
    return out.where(F.col("abs_r_n") > 0).withColumn("stability", stability_of("abs_r_cv")).orderBy(
        F.desc("abs_r_mean"), "feature"
    )


def partial_stability(results: DataFrame, full_rows: int = FULL_DATASET_ROWS) -> DataFrame:
    """Per feature: spread of the adjusted (else plain) partial r and mean confounding."""
    rows = results.where(F.col("n_rows") >= full_rows).withColumn(
        "v", F.coalesce(F.nullif(_finite("partial_r_adj"), F.lit(0.0)), _finite("partial_r"))
    )
    out = rows.groupBy("feature").agg(
        F.count("v").alias("n_full"), *spread_stats(F.abs("v"), "abs_r"),
        sign_share(F.col("v")).alias("sign_share"), F.avg(_finite("confounding_fraction")).alias("mean_confounding"),
    )
    return out.withColumn("stability", stability_of("abs_r_cv")).orderBy(F.desc("stability"), "feature")


def value_stability(results: DataFrame, group: list[str], value: str,
                    full_rows: int = FULL_DATASET_ROWS) -> DataFrame:
    """Signed spread of one statistic (Moran's I, a CV R2) over the full datasets."""
    rows = results.where(F.col("n_rows") >= full_rows).withColumn("v", _finite(value))
    out = rows.groupBy(*group).agg(*spread_stats(F.col("v"), value))
    return out.withColumn("stability", stability_of(f"{value}_cv"))


def source_matrix(pairs: DataFrame, metric: str) -> DataFrame:
    """Mean metric over all pairs of two source groups, order ignored."""
    v = _finite(metric)
    v = v if metric == "mi" else F.abs(v)
    return (
        pairs.withColumns(
            {"source_1": F.least("source_a", "source_b"), "source_2": F.greatest("source_a", "source_b"), "v": v}
        )
        .where(F.col("v").isNotNull())
        .groupBy("source_1", "source_2").agg(F.avg("v").alias(metric))
    )


def top_pairs(pairs: DataFrame, k: int = 3, group: str = "dataset", metric: str = "pearson_r") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(F.abs(metric)), "feature_a", "feature_b")
    return pairs.where(_finite(metric).isNotNull()).withColumn("place", F.row_number().over(w)).where(
        F.col("place") <= k
    )
