"""Nested spatial models, leave-one-block-out validation and scenarios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.operators.autocorrelation import morans_i
from skyloom.operators.gram import gram, gram_by, ols, solve, square, tile_residuals
from skyloom.operators.scale import take_lowest
from skyloom.session import materialise


def _x(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


# --- nested models ---------------------------------------------------------------------


def nested_morans(df: DataFrame, models: dict[str, list[str]], target: str, tile: str,
                  coordinates: DataFrame, min_tile_n: int = 1, n_perm: int = 999) -> DataFrame:
    """OLS per model, then Moran's I of its tile-mean residuals.

    ``coordinates`` maps a tile to axial q and r.  Each model's feature list
    starts with the intercept column.
    """
    out = None
    for label, features in models.items():
        rows = df.dropna("any", subset=[*features, target, tile])
        fit = ols(rows, features, target, features[0])
        residuals = tile_residuals(rows, fit, target, tile, min_tile_n).select(
            F.col(tile).alias("tile"), "value"
        )
        stats = morans_i(residuals.join(coordinates, "tile"), n_perm).select(
            F.lit(label).alias("model"), F.lit(fit.n).cast("long").alias("n_obs"), "n_tiles",
            F.lit(len(features)).alias("n_features"), F.lit(fit.r2).alias("global_r2"),
            "morans_i", "expected_i", "p_value",
        )
        out = stats if out is None else out.unionByName(stats)
    return out


def moran_deltas(models: DataFrame, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """Drop of Moran's I from one model to the next, with a verdict.

    Fixed thresholds: above 0.02 positive, above -0.02 near zero, above -0.05
    mildly negative, else strongly negative.
    """
    i = models.select("model", "morans_i")
    rows = None
    for a, b in steps:
        both = i.where(F.col("model").isin(a, b)).agg(
            F.max(F.when(F.col("model") == a, F.col("morans_i"))).alias("a"),
            F.max(F.when(F.col("model") == b, F.col("morans_i"))).alias("b"),
        )
        one = both.select(F.lit(f"{a}->{b}").alias("step"), (F.col("a") - F.col("b")).alias("delta_i"))
        rows = one if rows is None else rows.unionByName(one)
    d = F.col("delta_i")
    return rows.withColumn(
        "verdict",
        F.when(d > 0.02, "positive").when(d > -0.02, "near-zero").when(d > -0.05, "mildly negative")
        .when(d.isNotNull(), "strongly negative"),
    )


# --- block validation --------------------------------------------------------------------


def with_block(df: DataFrame, kind: str, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Add ``block``: hex_r8, hex_r7, rect_1km or rect_2km."""
    if kind in ("hex_r8", "hex_r7"):
        return df.withColumn("block", geo.hex_key(lon, lat, int(kind[-1])))
    if kind in ("rect_1km", "rect_2km"):
        plane = geo.with_projection(df, geo.lambert72_steps(), lon, lat, "__px", "__py")
        return plane.withColumn("block", geo.rect_key("__px", "__py", 1000.0 * int(kind[5]))).drop("__px", "__py")
    raise ValueError(f"unknown block kind {kind!r}")


def _scores(rows: DataFrame, group: str, target: str) -> DataFrame:
    e = _x(target) - F.col("__pred")
    sst = F.var_pop(_x(target)) * F.count(F.lit(1))
    r2 = F.lit(1.0) - F.sum(e * e) / F.greatest(sst, F.lit(1e-14))
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_test"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r2)).alias("r2"),
    )


def _dot(columns: Sequence[str], beta: str) -> Column:
    x = F.array(*[_x(c) for c in columns])
    return F.aggregate(F.zip_with(x, F.col(beta), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)


def held_out_rows(df: DataFrame, block: str, order: Column, order_range: int, ties: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows per block, the lowest of a reproducible order."""
    return take_lowest(df, [block], order, ties, cap, order_range)


def leave_block_out(df: DataFrame, features: Sequence[str], target: str, block: str, tests: DataFrame,
                    ridge: float = 1e-4, min_block_n: int = 1) -> DataFrame:
    """Hold out each block in turn by subtracting its sums from the total.

    Sums per block come from one pass; the small solves run where the block
    rows are, with the total as a constant; scores are column arithmetic on the
    test rows joined to their block's coefficients.
    """
    features = list(features)
    p = len(features)
    columns = [*features, target]
    complete = df.dropna("any", subset=[*columns, block])
    blocks = materialise(gram_by(complete, columns, [block]), "blocks")
    total_row = (
        blocks.select("n", F.posexplode("products").alias("pos", "v"))
        .groupBy("pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("pos").collect()
    )
    if not total_row:
        return df.sparkSession.createDataFrame(
            [], f"{block} string, n_train long, n_test long, mae double, rmse double, r2 double"
        )
    total, n_total = square([r["v"] for r in total_row], p + 1), int(total_row[0]["n"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, n, products in zip(batch[block], batch["n"], batch["products"]):
                rest = total - square(products, p + 1)
                n_train = n_total - int(n)
                if n >= min_block_n and n_train >= p:
                    beta = solve(rest[:p, :p], rest[:p, p], ridge)
                    rows.append((key, n_train, beta.tolist()))
            yield pd.DataFrame(rows, columns=[block, "n_train", "beta"])

    kind = df.schema[block].dataType.simpleString()
    betas = blocks.mapInPandas(fit, f"`{block}` {kind}, n_train long, beta array<double>")
    scored = tests.dropna("any", subset=[*columns, block]).join(betas, block).withColumn(
        "__pred", _dot(features, "beta")
    )
    n_train = betas.select(block, "n_train")
    return _scores(scored, block, target).join(n_train, block).select(
        block, "n_train", "n_test", "mae", "rmse", "r2"
    )


def random_folds(tests: DataFrame, features: Sequence[str], target: str, fold: Column, n_folds: int = 5,
                 ridge: float = 1e-4) -> DataFrame:
    """Plain k-fold on the pooled test rows, from k + 1 small systems."""
    features = list(features)
    p, columns = len(features), [*features, target]
    rows = tests.dropna("any", subset=columns).withColumn("fold", fold)
    sums = gram_by(rows, columns, ["fold"]).collect()  # one row per fold
    mats = {r["fold"]: square(r["products"], p + 1) for r in sums}
    total = sum(mats.values()) if mats else np.zeros((p + 1, p + 1))
    table = [
        (int(k), solve((total - m)[:p, :p], (total - m)[:p, p], ridge).tolist()) for k, m in mats.items()
    ]
    betas = tests.sparkSession.createDataFrame(table, "fold int, beta array<double>")
    # one row per fold: n_folds bounds its size
    scored = rows.join(F.broadcast(betas), "fold").withColumn("__pred", _dot(features, "beta"))
    return _scores(scored, "fold", target)


def cv_summary(scores: DataFrame, digits: int = 4) -> DataFrame:
    """Mean and population deviation of the scores; median and deciles of R2."""

    def q(p: float) -> Column:
        return F.percentile("r2", F.lit(p))

    aggs = [F.count(F.lit(1)).alias("n_blocks")]
    for m in ("mae", "rmse", "r2"):
        aggs += [F.round(F.avg(m), digits).alias(f"{m}_mean"), F.round(F.stddev_pop(m), digits).alias(f"{m}_std")]
    for name, p in (("median", 0.5), ("q10", 0.1), ("q90", 0.9)):
        aggs.append(F.round(q(p), digits).alias(f"r2_{name}"))
    return scores.agg(*aggs)


# --- scenarios ---------------------------------------------------------------------------

# Policy scenarios as absolute feature values.
SCENARIOS: tuple[tuple[str, dict[str, float]], ...] = (
    ("veg_10pct", {"ua_vegetation_100m_frac": 0.10}),
    ("veg_20pct", {"ua_vegetation_100m_frac": 0.20}),
    ("veg_30pct", {"ua_vegetation_100m_frac": 0.30}),
    ("veg_50pct", {"ua_vegetation_100m_frac": 0.50}),
    ("water_5pct", {"ua_water_wetlands_100m_frac": 0.05}),
    ("water_10pct", {"ua_water_wetlands_100m_frac": 0.10}),
    ("water_20pct", {"ua_water_wetlands_100m_frac": 0.20}),
    ("veg30_water10", {"ua_vegetation_100m_frac": 0.30, "ua_water_wetlands_100m_frac": 0.10}),
    ("veg20_water5", {"ua_vegetation_100m_frac": 0.20, "ua_water_wetlands_100m_frac": 0.05}),
    ("trees_10", {"trees_plantedby_100m_count": 10.0}),
    ("trees_25", {"trees_plantedby_100m_count": 25.0}),
    ("trees_50", {"trees_plantedby_100m_count": 50.0}),
)
AIR_SHARE = 0.5


def fit_scenario_model(df: DataFrame, confounders: Sequence[str], morphology: Sequence[str],
                       green: Sequence[str], target: str) -> DataFrame:
    """(feature, beta, mean, std, n_rows): effects per natural unit.

    Morphology and greening enter standardised with missing values at the
    mean; the fit is the minimum-norm solution, so that repeated columns share
    their effect.
    """
    scaled = [*morphology, *green]
    rows = df.where(_x(target).isNotNull() & ~F.isnan(_x(target)))
    aggs = []
    for i, c in enumerate(scaled):
        v = F.when(~F.isnan(_x(c)), _x(c))
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    stats = df.agg(*aggs).first()
    mean = {c: stats[f"m{i}"] or 0.0 for i, c in enumerate(scaled)}
    std = {c: s if (s := stats[f"s{i}"] or 0.0) > 1e-12 else 1.0 for i, c in enumerate(scaled)}
    named = {
        f"__f{i}": F.coalesce((F.when(~F.isnan(_x(c)), _x(c)) - F.lit(mean[c])) / F.lit(std[c]), F.lit(0.0))
        for i, c in enumerate(scaled)
    }
    design = [*confounders, *named]
    g = gram(rows.withColumns(named), [*design, target])
    beta = solve(g.block(design, design), g.block(design, [target])[:, 0], rcond=1e-10)
    offset = len(confounders) + len(morphology)
    out = [(c, float(beta[offset + i]) / std[c], mean[c], std[c], g.n) for i, c in enumerate(green)]
    return df.sparkSession.createDataFrame(out, "feature string, beta double, mean double, std double, n_rows long")


def scenario_table(spark, scenarios=SCENARIOS) -> DataFrame:
    rows = [(name, f, float(v)) for name, values in scenarios for f, v in values.items()]
    return spark.createDataFrame(rows, "scenario string, feature string, value double")


def evaluate_scenarios(fit: DataFrame, scenarios: DataFrame, digits: int = 4) -> DataFrame:
    """Temperature change per scenario; features it does not name stay at their mean."""
    term = F.col("beta") * (F.col("value") - F.col("mean"))
    named = scenarios.join(fit, "feature", "left")
    return named.groupBy("scenario").agg(
        F.round(F.coalesce(F.sum(term), F.lit(0.0)), digits).alias("delta_t"),
        F.round(F.coalesce(F.sum(term), F.lit(0.0)) * F.lit(AIR_SHARE), digits).alias("delta_t_air"),
        F.count("beta").alias("n_terms"),
    )
