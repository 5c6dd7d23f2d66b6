"""Feature transforms, imputation, scaling and data checks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators.ranks import column_quantiles
from skyloom.operators.scale import exact_quantiles, running_total
from skyloom.session import materialise

# Columns that are never features, and the tile keys.
NEVER_FEATURES = (
    "longitude",
    "latitude",
    "aster_lst",
    "modis_lst",
    "ndvi",
    "temperature",
    "image_id",
    "timestamp",
    "partition_key",
    "tile_id",
    "tile_h3_r8",
    "tile_h3_r7",
    "tile_rect_1km",
    "tile_rect_2km",
    "tile_ngi",
)

# What a fitted transform adds: (name, column) pairs.
Built = dict[str, Column]


@dataclass(frozen=True)
class Transform:
    """New columns from old ones.

    ``build(df, present)`` may run small aggregations to learn parameters and
    returns columns that depend on ``inputs`` only.
    """

    name: str
    inputs: tuple[str, ...]
    build: Callable[[DataFrame], Built] = field(compare=False)
    drop_inputs: bool = False
    skip_models: frozenset[str] = frozenset()


def _have(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def _x(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def _opts(drop_inputs: bool, skip_models) -> dict:
    return {"drop_inputs": drop_inputs, "skip_models": frozenset(skip_models or ())}


def func(cols: Sequence[str], fn: Callable[[Column], Column], symbol: str, *,
         drop_inputs: bool = False, skip_models=None) -> Transform:
    """``{col}{symbol}`` from a Column-to-Column function."""
    return Transform(
        f"func({', '.join(cols)}, {symbol})", tuple(cols),
        lambda df: {f"{c}{symbol}": fn(_x(c)) for c in _have(df, cols)}, **_opts(drop_inputs, skip_models),
    )


def cyclical(col: str, period: float, *, drop_inputs: bool = False, skip_models=None) -> Transform:
    def build(df: DataFrame) -> Built:
        if col not in df.columns:
            return {}
        angle = _x(col) * F.lit(2 * math.pi) / F.lit(float(period))
        return {f"{col}_sin": F.sin(angle), f"{col}_cos": F.cos(angle)}

    return Transform(f"cyclical({col}, {period})", (col,), build, **_opts(drop_inputs, skip_models))


def _pairwise(kind: str, sign: str, pairs, op, drop_inputs, skip_models) -> Transform:
    pairs = [tuple(p) for p in pairs]
    return Transform(
        f"{kind}({', '.join(f'{a}{sign}{b}' for a, b in pairs)})",
        tuple(c for p in pairs for c in p),
        lambda df: {
            f"{a}{sign}{b}": op(_x(a), _x(b)) for a, b in pairs if a in df.columns and b in df.columns
        },
        **_opts(drop_inputs, skip_models),
    )


def interaction(pairs, *, drop_inputs: bool = False, skip_models=None) -> Transform:
    return _pairwise("interaction", "×", pairs, lambda a, b: a * b, drop_inputs, skip_models)


def delta(a: str, b: str, *, drop_inputs: bool = False, skip_models=None) -> Transform:
    return _pairwise("delta", "−", [(a, b)], lambda x, y: x - y, drop_inputs, skip_models)


difference = delta


def ratio(numerator: str, denominator: str, epsilon: float = 1e-6, *, drop_inputs: bool = False,
          skip_models=None) -> Transform:
    return _pairwise(
        "ratio", "÷", [(numerator, denominator)],
        lambda x, y: F.try_divide(x, y + F.lit(epsilon)), drop_inputs, skip_models,
    )


def polynomial(cols: Sequence[str], degree: int = 2, interaction_only: bool = False,
               include_bias: bool = False, *, drop_inputs: bool = False, skip_models=None) -> Transform:
    """All products up to ``degree``, named ``a``, ``a^2``, ``a b``."""

    def build(df: DataFrame) -> Built:
        present = _have(df, cols)
        pick = itertools.combinations if interaction_only else itertools.combinations_with_replacement
        out: Built = {"1": F.lit(1.0)} if include_bias and present else {}
        for d in range(1, degree + 1):
            for combo in pick(present, d):
                value = _x(combo[0])
                for c in combo[1:]:
                    value = value * _x(c)
                powers = {c: combo.count(c) for c in dict.fromkeys(combo)}
                out[" ".join(c if n == 1 else f"{c}^{n}" for c, n in powers.items())] = value
        return out

    return Transform(f"poly({degree}, {', '.join(cols)})", tuple(cols), build, **_opts(drop_inputs, skip_models))


def remove(cols: str | Sequence[str], *, skip_models=None) -> Transform:
    cols = (cols,) if isinstance(cols, str) else tuple(cols)
    return Transform(f"remove({', '.join(cols)})", cols, lambda df: {}, **_opts(True, skip_models))


def clip_outliers(cols: Sequence[str], low_pct: float = 1.0, high_pct: float = 99.0, *,
                  drop_inputs: bool = False, skip_models=None) -> Transform:
    """``{col}⌈⌋``: limits are exact percentiles of the whole training frame."""

    def build(df: DataFrame) -> Built:
        out = {}
        limits = column_quantiles(df, _have(df, cols), [low_pct / 100, high_pct / 100])
        for c, (lo, hi) in limits.items():
            clipped = _x(c) if lo is None else F.greatest(F.lit(lo), F.least(F.lit(hi), _x(c)))
            out[f"{c}⌈⌋"] = F.when(_x(c).isNotNull(), clipped)
        return out

    return Transform(f"clip({', '.join(cols)})", tuple(cols), build, **_opts(drop_inputs, skip_models))


def zscore(cols: Sequence[str], *, drop_inputs: bool = False, skip_models=None) -> Transform:
    """``{col}z`` with the mean and sample deviation of the whole training frame."""

    def build(df: DataFrame) -> Built:
        present = _have(df, cols)
        if not present:
            return {}
        aggs = []
        for i, c in enumerate(present):
            v = F.when(~F.isnan(_x(c)), _x(c))
            aggs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        return {
            f"{c}z": (_x(c) - F.lit(row[f"m{i}"])) / F.lit((row[f"s{i}"] or 0.0) + 1e-9)
            for i, c in enumerate(present)
        }

    return Transform(f"zscore({', '.join(cols)})", tuple(cols), build, **_opts(drop_inputs, skip_models))


def log1p(cols: Sequence[str], clip_min: float = 0.0, **options) -> Transform:
    return func(cols, lambda v: F.log1p(F.greatest(v, F.lit(clip_min))), "㏒", **options)


def sqrt(cols: Sequence[str], clip_min: float = 0.0, **options) -> Transform:
    return func(cols, lambda v: F.sqrt(F.greatest(v, F.lit(clip_min))), "√", **options)


@dataclass(frozen=True)
class FittedTransforms:
    """Steps with what they learned: the columns each adds, and those that go with it and at the end."""

    steps: tuple[tuple[Built, tuple[str, ...]], ...]
    consumed: frozenset[str]

    def added(self) -> list[str]:
        return [name for built, _ in self.steps for name in built]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for built, dropped in self.steps:
            if built:
                kept = [F.col(f"`{n}`") for n in out.columns if n not in built]
                out = out.select(*kept, *[c.alias(n) for n, c in built.items()])
            out = out.drop(*[c for c in dropped if c in out.columns])
        return out.drop(*[c for c in self.consumed if c in out.columns])


def fit_transforms(df: DataFrame, transforms: Sequence[Transform], model: str | None = None) -> FittedTransforms:
    """Learn the steps from ``df``, one after the other, so that they can be applied to other rows.

    ``drop_inputs`` acts at once, but for what the step itself has just made; at
    the end every original column that some applied transform consumed is gone.
    Steps that skip ``model`` do nothing.
    """
    original, consumed, steps, out = set(df.columns), set(), [], df
    for t in transforms:
        if model is not None and model in t.skip_models:
            continue
        built = t.build(out)
        dropped = tuple(c for c in t.inputs if c not in built) if t.drop_inputs else ()
        consumed |= set(t.inputs) & original
        steps.append((built, dropped))
        out = FittedTransforms((steps[-1],), frozenset()).transform(out)
    return FittedTransforms(tuple(steps), frozenset(consumed))


def apply_transforms(df: DataFrame, transforms: Sequence[Transform], model: str | None = None) -> DataFrame:
    """Apply in order; outputs may feed later steps and replace columns of their name."""
    return fit_transforms(df, transforms, model).transform(df)


def running_zscore(df: DataFrame, column: str, order: str) -> DataFrame:
    """z-score of each row against the rows up to it in a total order.

    ``order`` must be unique.  Sums before each row come from the distributed
    running total, so the stream is never sorted in one task.
    """
    v = F.when(~F.isnan(_x(column)), _x(column))
    base = df.withColumns(
        {"__v": v, "__n": F.when(v.isNotNull(), 1).otherwise(0), "__s": F.coalesce(v, F.lit(0.0)),
         "__q": F.coalesce(v * v, F.lit(0.0))}
    )
    run = running_total(base, order, ["__n", "__s", "__q"])
    n = F.col("__n") + F.col("__n_before")
    s = F.col("__s") + F.col("__s_before")
    q = F.col("__q") + F.col("__q_before")
    mean = F.try_divide(s, n)
    spread = F.sqrt(F.greatest(F.lit(0.0), q - s * mean) / F.greatest(n - 1, F.lit(1)))
    return run.withColumn(f"{column}z", (F.col("__v") - mean) / (spread + F.lit(1e-9))).drop(
        *[c for c in run.columns if c.startswith("__")]
    )


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns that are not metadata."""
    numeric = {"byte", "short", "integer", "long", "float", "double"}
    return [
        f.name for f in df.schema
        if f.dataType.typeName() in numeric and f.name not in NEVER_FEATURES and f.name not in exclude
    ]


def drop_empty_or_constant(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop listed columns that hold fewer than two distinct values."""
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(f"`{c}`")
        aggs.append((F.min(v) < F.max(v)).alias(f"k{i}"))
    row = df.agg(*aggs).first()
    return df.drop(*[c for i, c in enumerate(columns) if not row[f"k{i}"]])


def complete_cases(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows without null or NaN in the columns and without null keys."""
    return df.dropna("any", subset=[*columns, *keys])


# --- imputation and scaling --------------------------------------------------------


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """Count, missing, mean, median, deviation, range and quartiles of a column."""
    v = F.when(~F.isnan(_x(column)), _x(column))
    values = materialise(df.select(v.alias("v")), "column")
    q25, q50, q75 = exact_quantiles(values, "v", [0.25, 0.5, 0.75])
    return values.agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count("v")).alias("n_missing"),
        F.round(F.avg("v"), 6).alias("mean"), F.lit(q50).alias("median"),
        F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.lit(q25).alias("q25"), F.lit(q75).alias("q75"),
    )


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    return {c: found[0] for c, found in column_quantiles(df, columns, [0.5]).items()}


def impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Fill null and NaN with the given value, or zero when there is none."""
    return df.withColumns(
        {
            c: F.when(_x(c).isNull() | F.isnan(_x(c)), F.lit(float(v or 0.0))).otherwise(_x(c))
            for c, v in values.items()
        }
    )


SCALERS = ("standard", "minmax", "maxabs", "none")


@dataclass(frozen=True)
class FittedScaler:
    """Per-column offset and scale: ``(x - offset) / scale``."""

    kinds: dict[str, str]
    stats: dict[str, dict[str, float]]

    def params(self, column: str) -> tuple[float, float]:
        s, kind = self.stats[column], self.kinds[column]
        if kind == "standard":
            offset, scale = s["mean"], math.sqrt(s["var"])
        elif kind == "minmax":
            offset, scale = s["min"], s["max"] - s["min"]
        elif kind == "maxabs":
            offset, scale = 0.0, max(abs(s["min"]), abs(s["max"]))
        else:
            offset, scale = 0.0, 1.0
        return offset, scale or 1.0

    def transform(self, df: DataFrame) -> DataFrame:
        def scaled(c: str) -> Column:
            offset, scale = self.params(c)
            return (_x(c) - F.lit(offset)) / F.lit(scale)

        return df.withColumns({c: scaled(c) for c in self.kinds if c in df.columns})

    def inverse(self, df: DataFrame) -> DataFrame:
        def natural(c: str) -> Column:
            offset, scale = self.params(c)
            return _x(c) * F.lit(scale) + F.lit(offset)

        return df.withColumns({c: natural(c) for c in self.kinds if c in df.columns})

    def summary(self, spark) -> DataFrame:
        rows = [
            (c, k, *[float(self.stats[c][x]) for x in ("n", "mean", "var", "min", "max")], *map(float, self.params(c)))
            for c, k in self.kinds.items()
        ]
        return spark.createDataFrame(
            rows,
            "column string, scaler string, n double, mean double, var double, min double, max double, "
            "offset double, scale double",
        )


def fit_scaler(df: DataFrame, columns: Sequence[str], default: str = "standard",
               overrides: dict[str, str] | None = None, nan_as_zero: bool = False) -> FittedScaler:
    """All statistics of all columns in one aggregation."""
    overrides = overrides or {}
    kinds = {c: overrides.get(c, default) for c in columns}
    unknown = set(kinds.values()) - set(SCALERS)
    if unknown:
        raise ValueError(f"unknown scalers {sorted(unknown)}")
    aggs = []
    for i, c in enumerate(columns):
        v = F.when(~F.isnan(_x(c)), _x(c))
        v = F.coalesce(v, F.lit(0.0)) if nan_as_zero else v
        aggs += [
            F.count(v).alias(f"n{i}"), F.avg(v).alias(f"mean{i}"), F.var_pop(v).alias(f"var{i}"),
            F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}"),
        ]
    row = df.agg(*aggs).first()
    stats = {
        c: {k: row[f"{k}{i}"] or 0.0 for k in ("n", "mean", "var", "min", "max")}
        for i, c in enumerate(columns)
    }
    return FittedScaler(kinds, stats)


# --- data checks ---------------------------------------------------------------------

CHECK_SCHEMA = "check string, column string, value double, level string"


class QualityError(ValueError):
    """Raised by strict checks that found an error."""


def _report(df: DataFrame, rows: list[tuple], strict: bool) -> DataFrame:
    if strict and any(r[3] == "error" for r in rows):
        raise QualityError("; ".join(f"{r[0]} {r[1]} {r[2]}" for r in rows if r[3] == "error"))
    return df.sparkSession.createDataFrame(rows, CHECK_SCHEMA)


def check_inputs(df: DataFrame, columns: Sequence[str], target: str, max_x: float = 50.0,
                 max_y: float = 1e3, strict: bool = False) -> DataFrame:
    """Findings about scaled features and the target from one aggregation."""
    aggs = []
    for i, c in enumerate([*columns, target]):
        v = _x(c)
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        aggs += [
            F.count_if(bad).alias(f"b{i}"), F.max(F.abs(F.when(~bad, v))).alias(f"a{i}"),
            F.stddev_pop(F.when(~bad, v)).alias(f"s{i}"),
        ]
    row, found = df.agg(*aggs).first(), []
    for i, c in enumerate([*columns, target]):
        limit, label = (max_y, "target") if i == len(columns) else (max_x, "feature")
        if row[f"b{i}"]:
            found.append((f"{label}_non_finite", c, float(row[f"b{i}"]), "error"))
        if (row[f"a{i}"] or 0.0) > limit:
            found.append((f"{label}_too_large", c, float(row[f"a{i}"]), "error"))
        if i < len(columns) and (row[f"s{i}"] or 0.0) < 1e-8:
            found.append(("zero_variance", c, float(row[f"s{i}"] or 0.0), "warn"))
    return _report(df, found, strict)


def check_scaler(df: DataFrame, scaler: FittedScaler, columns: Sequence[str], strict: bool = False) -> DataFrame:
    found = [("scaler_missing", c, 0.0, "error") for c in columns if c not in scaler.kinds]
    found += [
        ("scaler_unfitted", c, 0.0, "error")
        for c in columns if c in scaler.stats and not scaler.stats[c]["n"]
    ]
    return _report(df, found, strict)


def check_coefficients(df: DataFrame, coefficients: dict[str, float], limit: float = 50.0,
                       strict: bool = False) -> DataFrame:
    found = [("coefficient_too_large", c, float(v), "error") for c, v in coefficients.items() if abs(v) > limit]
    return _report(df, found, strict)


def check_predictions(df: DataFrame, prediction: str, target: str, max_pred: float = 1e3,
                      max_bias: float = 50.0, strict: bool = False) -> DataFrame:
    p, y = _x(prediction), _x(target)
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == F.lit(float("inf")))
    row = df.agg(
        F.count_if(bad).alias("b"), F.max(F.abs(F.when(~bad, p))).alias("m"),
        (F.avg(F.when(~bad, p)) - F.avg(y)).alias("bias"),
    ).first()
    found = []
    if row["b"]:
        found.append(("prediction_non_finite", prediction, float(row["b"]), "error"))
    if (row["m"] or 0.0) > max_pred:
        found.append(("prediction_too_large", prediction, float(row["m"]), "error"))
    if abs(row["bias"] or 0.0) > max_bias:
        found.append(("bias_too_large", prediction, float(row["bias"]), "warn"))
    return _report(df, found, strict)
