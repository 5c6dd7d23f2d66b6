"""Regression models, their comparison, search and explanation."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.operators.ranks import reached
from skyloom.operators.scale import hash_order, numbered, take_lowest
from skyloom.operators.transforms import FittedScaler, FittedTransforms, Transform, fit_scaler, fit_transforms
from skyloom.session import materialise


def _x(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


# --- metrics -----------------------------------------------------------------------


#: Number of equal rows that one row stands for.
EQUAL = "__equal"


def equal_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The different rows of ``columns``, written, with how often each occurs as ``EQUAL``.

    They are dealt out evenly: whoever passes over them many times waits for the largest part each time.
    """
    keys = [F.col(f"`{c}`") for c in columns]
    return materialise(evenly(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(EQUAL)), columns), "equal-rows")


def evenly(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Different rows of ``columns`` in as many parts of like size as there are cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *[F.col(f"`{c}`") for c in columns])


#: Equal rows that a forest draws one by one at least; more are drawn in so many pieces.
DRAWN = 32


def in_pieces(df: DataFrame, most: int) -> DataFrame:
    """Rows that stand for n as n rows of their own, or as ``most`` of even shares where n is more.

    A forest draws each piece by itself.  Rows that occur no more than ``most``
    times are drawn as if they had not been put together, and a set of rows has
    at least ``most`` pieces if it has as many rows, so that a least number of
    drawn rows in a node, far below ``most``, is met by the same nodes.
    """
    if most <= 1:
        return df
    n, k = F.col(EQUAL), F.least(F.col(EQUAL), F.lit(int(most)))
    cut = df.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), k - 1)))
    share = F.floor(n / k) + F.when(F.col("__piece") < n % k, 1).otherwise(0)
    return cut.withColumn(EQUAL, share.cast("long")).drop("__piece")


def regression_metrics(df: DataFrame, prediction: str, target: str, by: Sequence[str] = (), weight: str | None = None, centre: float = 0.0) -> DataFrame:
    """All error measures, overall or per group, in one pass.

    With ``weight`` a row stands for that many; ``centre``, near the mean of the
    target, then keeps the digits of its squares.
    """
    rows = df.where(_x(target).isNotNull() & _x(prediction).isNotNull())
    y, e = _x(target), _x(prediction) - _x(target)
    share = F.abs(e / F.when(F.abs(y) > 1e-6, y).otherwise(F.lit(1.0)))
    if weight is None:
        n, sst, mean = F.count(F.lit(1)), F.var_pop(y) * F.count(F.lit(1)), F.avg
    else:
        n, off = F.sum(F.col(weight)), y - F.lit(float(centre))
        squares = F.sum(F.col(weight) * off * off) - F.sum(F.col(weight) * off) ** 2 / n
        # a constant target has no squares, whatever the last digit says
        sst = F.when(F.min(y) == F.max(y), F.lit(0.0)).otherwise(squares)

        def mean(v: Column) -> Column:
            return F.sum(F.col(weight) * v) / n

    mse = mean(e * e)
    return rows.groupBy(*by).agg(
        n.alias("n_rows"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        mean(F.abs(e)).alias("mae"), (F.lit(1.0) - F.try_divide(mse * n, sst)).alias("r2"),
        (mean(share) * F.lit(100.0)).alias("mape"), mean(e).alias("bias"),
        F.max(F.abs(e)).alias("max_error"),
    )


def leaderboard(scores: DataFrame, top: int = 20, ties: Sequence[str] = ()) -> DataFrame:
    """Best first by error, then by fit; only the winners are ranked."""
    best = scores.orderBy(F.asc_nulls_last("rmse"), F.desc("r2"), *ties).limit(top)
    w = Window.orderBy(F.asc_nulls_last("rmse"), F.desc("r2"), *ties)
    return best.withColumn("place", F.row_number().over(w))


# --- models ----------------------------------------------------------------------------

# Default settings per model.
MODELS: dict[str, dict] = {
    "linear": {"regParam": 1e-5},
    "ridge": {"regParam": 1e-4},
    "elastic_net": {"regParam": 1e-4, "elasticNetParam": 0.5},
    "huber": {"epsilon": 1.35, "regParam": 1e-5},
    "nystroem": {"n_components": 100, "gamma": 0.1, "regParam": 1e-5},
    "random_forest": {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 10},
    "boosting": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1},
    "second_order": {"rounds": 100, "depth": 6, "rate": 0.1},
    "extra_trees": {"trees": 100, "depth": 10, "leaf_rows": 5},
}


def fills(df: DataFrame, features: Sequence[str], weight: str | None = None) -> dict[str, float]:
    """What a missing value of each feature becomes: the median, zero for a column without any value.

    One pass over all columns; ranks are off by at most a ten-thousandth.  With
    ``weight`` a row stands for that many, and ranks are exact.
    """
    if weight is not None:
        return {f: (own[0] if own else 0.0) for f, own in reached(df, features, [0.5], weight).items()}
    present = [F.when(~F.isnan(_x(f)), _x(f)) for f in features]
    row = df.agg(*[F.percentile_approx(v, 0.5).alias(f"m{i}") for i, v in enumerate(present)]).first()
    return {f: float(row[f"m{i}"] or 0.0) for i, f in enumerate(features)}


def filled(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    """``df`` with no missing value in the features; no row goes."""
    return df.withColumns({f: F.coalesce(F.when(~F.isnan(_x(f)), _x(f)), F.lit(v)) for f, v in fill.items()})


class Fitted:
    """A model with what is done to its rows, in training and in scoring: transforms, then fills, then scaling."""

    def __init__(self, model, fill: dict[str, float], transforms: FittedTransforms | None = None, scaler: FittedScaler | None = None):
        self.model, self.fill, self.transforms, self.scaler = model, fill, transforms, scaler

    def __getattr__(self, name: str):
        return getattr(self.model, name)

    @property
    def inputs(self) -> list[str]:
        """The columns that the model itself sees."""
        return list(self.fill)

    def prepared(self, df: DataFrame) -> DataFrame:
        rows = filled(self.transforms.transform(df) if self.transforms else df, self.fill)
        return self.scaler.transform(rows) if self.scaler else rows

    def transform(self, df: DataFrame) -> DataFrame:
        """Every row of ``df`` with a prediction; columns that preparing changes or drops come back as they were."""
        changed = self.transforms is not None or self.scaler is not None
        rows = self.prepared(df.select(F.struct("*").alias("__row"), "*") if changed else df)
        plain = isinstance(self.model, NystroemModel) or not hasattr(self.model, "uid")
        out = self.model.transform(rows if plain else assemble(rows, self.inputs)).drop("features")
        return out.select("__row.*", "prediction") if changed else out


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df)


class NystroemModel:
    """Kernel features from landmark rows followed by a linear model."""

    def __init__(self, landmarks: np.ndarray, gamma: float, features: list[str]):
        self.landmarks, self.gamma, self.features = landmarks, gamma, features
        d = ((landmarks[:, None, :] - landmarks[None, :, :]) ** 2).sum(axis=2)
        values, vectors = np.linalg.eigh(np.exp(-gamma * d))
        self.root = vectors / np.sqrt(np.maximum(values, 1e-12)) @ vectors.T
        self.linear: Model | None = None

    def map_features(self, df: DataFrame) -> DataFrame:
        landmarks, gamma, root = self.landmarks, self.gamma, self.root

        @F.pandas_udf("array<double>")
        def kernel(rows: pd.Series) -> pd.Series:
            x = np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, landmarks.shape[1]))
            d = (x**2).sum(axis=1)[:, None] - 2 * x @ landmarks.T + (landmarks**2).sum(axis=1)[None, :]
            return pd.Series(list(np.exp(-gamma * np.maximum(d, 0.0)) @ root))

        values = F.array(*[_x(f) for f in self.features])
        return df.withColumn("features", array_to_vector(kernel(values)))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.linear.transform(self.map_features(df))


def fit_model(kind: str, train: DataFrame, features: Sequence[str], target: str, seed: int = 42, *, transforms: Sequence[Transform] = (),
              scaler: str | None = None, column_scalers: dict[str, str] | None = None, weight: str | None = None,
              fill: dict[str, float] | None = None, **params):
    """Fit one of ``MODELS`` on all rows that have a target; missing features become medians.

    ``transforms`` are learned from the training rows; their outputs join the
    features, and the columns they consume leave them.  ``scaler`` is the
    default for all columns, ``column_scalers`` names others for some.

    Models that go over the rows many times, or form much for each, see equal
    rows of features and target once, with their number as weight; forests see
    them in pieces, which they draw.  With ``weight=EQUAL`` the rows are such
    ``equal_rows`` already; transforms and scalers must then have been applied.
    ``fill`` is what stands for missing features where that is known.
    """
    if kind not in MODELS:
        raise ValueError(f"unknown model {kind!r}")
    if weight is not None and (weight != EQUAL or transforms or scaler or column_scalers):
        raise ValueError(f"weighted rows are equal_rows, their number is {EQUAL!r}, and they are neither transformed nor scaled here")
    options = {**MODELS[kind], **params}
    common = {"featuresCol": "features", "labelCol": target, "predictionCol": "prediction"}
    train = train.where(_x(target).isNotNull() & ~F.isnan(_x(target)))
    shaped = fit_transforms(train, transforms, kind) if transforms else None
    if shaped:
        shown = shaped.transform(train).columns
        features = [c for c in dict.fromkeys([*features, *shaped.added()]) if c in shown]
    fill = fill or fills(shaped.transform(train) if shaped else train, features, weight)
    ready = Fitted(None, fill, shaped)
    if scaler is not None or column_scalers:
        ready.scaler = fit_scaler(ready.prepared(train), features, scaler or "none", column_scalers)
    train = ready.prepared(train)

    def fitted(model) -> Fitted:
        ready.model = model
        return ready

    if kind in ("second_order", "extra_trees"):
        from skyloom.operators import trees

        own = {"fill": fill, "weight": weight}
        if kind == "second_order":
            return fitted(trees.fit_boosted(train, features, target, trees.Boosting(**{"seed": seed, **options}), **own))
        return fitted(trees.fit_random_trees(train, features, target, trees.RandomTrees(**{"seed": seed, **options}), **own))
    if weight is None and kind not in ("linear", "ridge"):  # these are done with one pass
        train, weight = equal_rows(train, [*features, target]), EQUAL
    if weight is not None:
        common["weightCol"] = weight
    if kind == "nystroem":
        m, gamma = int(options.pop("n_components")), float(options.pop("gamma"))
        order, size = hash_order(*features, seed=seed)
        picked = take_lowest(train.select(*features).distinct(), [], order, list(features), m, size)
        model = NystroemModel(picked.toPandas().to_numpy(dtype=float), gamma, list(features))  # m rows
        model.linear = LinearRegression(**common, **options).fit(model.map_features(train))
        return fitted(model)
    if kind in ("random_forest", "boosting"):  # a node needs so many rows, and not so many different ones
        least = int(options.get("minInstancesPerNode", 1))
        train = in_pieces(train, max(3 * least, DRAWN) if kind == "random_forest" else least)
    data = assemble(train, features)
    if kind in ("linear", "ridge", "elastic_net"):
        fit = LinearRegression(**common, **options).fit(data)
    elif kind == "huber":
        fit = LinearRegression(**common, loss="huber", **options).fit(data)
    elif kind == "random_forest":
        fit = RandomForestRegressor(**common, seed=seed, **options).fit(data)
    else:
        fit = GBTRegressor(**common, seed=seed, **options).fit(data)
    return fitted(fit)


def predict(model: Fitted, df: DataFrame) -> DataFrame:
    """Every row of ``df`` with a prediction."""
    return model.transform(df)


def train_all(train: DataFrame, test: DataFrame, features: Sequence[str], target: str,
              kinds: Sequence[str] | None = None, settings: dict[str, dict] | None = None, transforms: Sequence[Transform] = (),
              scaler: str | None = None, column_scalers: dict[str, str] | None = None) -> DataFrame:
    """Fit every requested model on the same split, prepared alike, and compare them.

    Without transforms, which may look at any column, equal rows are scored
    once, and without scalers they are trained on once, with their number: both
    frames are then read once, whatever the number of models.  Else they are
    read once or more for every model, so they should be written tables.
    """
    out, weights = None, {}
    if not transforms:
        test = equal_rows(test, [*features, target])
        weights = {"weight": EQUAL, "centre": test.agg(F.avg(_x(target))).first()[0] or 0.0}
    prepare = {"transforms": transforms, "scaler": scaler, "column_scalers": column_scalers}
    if not (transforms or scaler or column_scalers):
        train = equal_rows(train.where(_x(target).isNotNull() & ~F.isnan(_x(target))), [*features, target])
        prepare = {"weight": EQUAL, "fill": fills(train, features, EQUAL)}
    for kind in kinds or MODELS:
        model = fit_model(kind, train, features, target, **prepare, **(settings or {}).get(kind, {}))
        row = regression_metrics(predict(model, test), "prediction", target, **weights)
        row = row.select(F.lit(kind).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("rmse")


def evaluate_per_label(model, df: DataFrame, features: Sequence[str], target: str, label: str = "label") -> DataFrame:
    """Metrics per held-out slice from one scoring pass."""
    return regression_metrics(predict(model, df), "prediction", target, [label])


# --- search -----------------------------------------------------------------------------


def expand_grid(grid: dict[str, Sequence]) -> list[dict]:
    names = list(grid)
    return [dict(zip(names, values)) for values in itertools.product(*grid.values())]


SEARCH_SCHEMA = "model string, params string, rmse double, r2 double, mae double, error string"


def grid_search(kind: str, train: DataFrame, test: DataFrame, features: Sequence[str], target: str,
                grid: dict[str, Sequence], parallelism: int = 2) -> DataFrame:
    """One row per combination; a combination that fails is recorded, not fatal."""
    train, test = materialise(train, "train"), materialise(test, "test")

    def one(params: dict) -> tuple:
        label = ", ".join(f"{k}={v}" for k, v in params.items())
        try:
            model = fit_model(kind, train, features, target, **params)
            row = regression_metrics(predict(model, test), "prediction", target).first()
            return (kind, label, row["rmse"], row["r2"], row["mae"], None)
        except Exception as exc:  # the report carries the reason
            return (kind, label, None, None, None, f"{type(exc).__name__}: {exc}"[:500])

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(one, expand_grid(grid)))
    return train.sparkSession.createDataFrame(rows, SEARCH_SCHEMA)


def half_split_search(kind: str, df: DataFrame, features: Sequence[str], target: str,
                      grid: dict[str, Sequence], key: Sequence[str], n_splits: int = 3) -> DataFrame:
    """Mean error of every combination over random half splits."""
    df = materialise(df, "search")
    parts = None
    for i in range(n_splits):
        order, _ = hash_order(*key, seed=i)
        half = order % 2 == 0
        got = grid_search(kind, df.where(half), df.where(~half), features, target, grid)
        parts = got if parts is None else parts.unionByName(got)
    return parts.groupBy("model", "params").agg(
        F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"), F.count("rmse").alias("n_splits"),
        F.first("error", True).alias("error"),
    ).orderBy(F.asc_nulls_last("rmse"))


# --- explanation ------------------------------------------------------------------------


def feature_importance(model, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Shares that sum to one: tree gains, or coefficients times deviations."""
    spark = df.sparkSession
    if hasattr(model, "importance"):
        raw = [model.importance()[f] for f in features]
    elif hasattr(model, "featureImportances"):
        raw = [float(v) for v in model.featureImportances.toArray()]
    else:
        row = df.agg(*[F.stddev_samp(_x(f)).alias(f"s{i}") for i, f in enumerate(features)]).first()
        raw = [abs(float(c)) * (row[f"s{i}"] or 0.0) for i, c in enumerate(model.coefficients.toArray())]
    total = sum(raw) or 1.0
    rows = [(f, v / total) for f, v in zip(features, raw)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def natural_coefficients(coefficients: dict[str, float], intercept: float, scaler) -> tuple[dict[str, float], float]:
    """Coefficients of scaled columns in original units."""
    out, base = {}, intercept
    for c, b in coefficients.items():
        offset, scale = scaler.params(c)
        out[c] = b / scale
        base -= b * offset / scale
    return out, base


def linear_attribution(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """``{feature}_effect`` = coefficient times distance from the mean."""
    row = df.agg(*[F.avg(_x(f)).alias(f"m{i}") for i, f in enumerate(coefficients)]).first()
    return df.withColumns(
        {
            f"{f}_effect": F.lit(float(b)) * (_x(f) - F.lit(row[f"m{i}"] or 0.0))
            for i, (f, b) in enumerate(coefficients.items())
        }
    )


def permutation_importance(score: Callable[[DataFrame], DataFrame], df: DataFrame, features: Sequence[str],
                           target: str, row_id: str, seed: int = 42) -> DataFrame:
    """Rise of the squared error when one column is shuffled, at least zero.

    Rows are numbered by two hash orders; the value of the row at a place in
    one order moves to the row at that place in the other.
    """
    df = materialise(df.select(row_id, target, *features), "scored")

    def mse(frame: DataFrame) -> float:
        e = _x("prediction") - _x(target)
        return score(frame).agg(F.avg(e * e)).first()[0]

    base, rows = mse(df), []
    here = numbered(df.withColumn("__h", F.xxhash64(row_id, F.lit(seed))), [], "__h", row_id).drop("__h")
    here = materialise(here, "places")
    for i, f in enumerate(features):
        there = numbered(
            df.select(row_id, f).withColumn("__h", F.xxhash64(row_id, F.lit(seed + 1 + i))), [], "__h", row_id
        ).select("place", F.col(f).alias("__moved"))
        mixed = here.join(there, "place").withColumn(f, F.col("__moved")).drop("__moved", "place")
        rows.append((f, max(0.0, mse(mixed) - base)))
    return df.sparkSession.createDataFrame(rows, "feature string, delta_mse double").orderBy(F.desc("delta_mse"))


