"""Sums of products: the sufficient statistics behind every linear fit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Above this many columns the products are formed in Arrow batches.
EXPRESSION_LIMIT = 14
# Groups held per task before partial sums are passed on.
GROUPS_IN_MEMORY = 2000


def _x(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def triangle(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def square(upper: Sequence[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for (i, j), v in zip(triangle(p), upper):
        out[i, j] = out[j, i] = v
    return out


def gram_by(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Per group: ``n`` and ``products``, the upper triangle of X'X row by row.

    Rows must be complete.  Narrow designs are plain sums that combine before
    the shuffle; wide ones are summed per Arrow batch in each task first.
    """
    columns, groups = list(columns), list(groups)
    pairs = triangle(len(columns))
    if len(columns) <= EXPRESSION_LIMIT:
        sums = [F.sum(_x(columns[i]) * _x(columns[j])).alias(f"s{k}") for k, (i, j) in enumerate(pairs)]
        wide = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), *sums)
        return wide.select(*groups, "n", F.array(*[f"s{k}" for k in range(len(pairs))]).alias("products"))

    narrow = df.select(*groups, *[_x(c).alias(f"x{k}") for k, c in enumerate(columns)])
    names = [f"x{k}" for k in range(len(columns))]
    upper = np.triu_indices(len(columns))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def flush() -> pd.DataFrame:
            rows = [(*k, int(n), m[upper].tolist()) for k, (n, m) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*groups, "n", "products"])

        for batch in batches:
            parts = batch.groupby(groups, dropna=False) if groups else [((), batch)]
            for key, part in parts:
                key = key if isinstance(key, tuple) else (key,)
                x = part[names].to_numpy(dtype=float)
                entry = held.setdefault(key, [0, np.zeros((len(names), len(names)))])
                entry[0] += len(x)
                entry[1] += x.T @ x
            if len(held) > GROUPS_IN_MEMORY:
                yield flush()
        if held:
            yield flush()

    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    schema = (fields + ", " if fields else "") + "n long, products array<double>"
    parts = narrow.mapInPandas(partial, schema)
    by_place = (
        parts.select(*groups, "n", F.posexplode("products").alias("pos", "v"))
        .groupBy(*groups, "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    )
    entries = F.array_sort(F.collect_list(F.struct("pos", "v")))  # one per matrix entry
    return by_place.groupBy(*groups).agg(
        F.first("n").alias("n"), F.transform(entries, lambda e: e["v"]).alias("products")
    )


@dataclass(frozen=True)
class Gram:
    """Cross products of named columns, small enough for the driver."""

    columns: list[str]
    n: int
    matrix: np.ndarray

    def block(self, rows: Sequence[str], cols: Sequence[str]) -> np.ndarray:
        at = {c: i for i, c in enumerate(self.columns)}
        return self.matrix[np.ix_([at[r] for r in rows], [at[c] for c in cols])]


def gram(df: DataFrame, columns: Sequence[str]) -> Gram:
    row = gram_by(df, columns).first()
    if row is None or not row["n"]:
        return Gram(list(columns), 0, np.zeros((len(columns), len(columns))))
    return Gram(list(columns), int(row["n"]), square(row["products"], len(columns)))


def solve(xtx: np.ndarray, xty: np.ndarray, ridge: float = 0.0, rcond: float | None = None) -> np.ndarray:
    """Minimum-norm solution of the normal equations."""
    return np.linalg.lstsq(xtx + ridge * np.eye(len(xtx)), xty, rcond=rcond)[0]


@dataclass(frozen=True)
class OlsFit:
    columns: list[str]
    beta: np.ndarray
    n: int
    r2: float
    sse: float

    def prediction(self) -> Column:
        out = F.lit(0.0)
        for c, b in zip(self.columns, self.beta):
            out = out + F.lit(float(b)) * _x(c)
        return out


def ols(df: DataFrame, features: Sequence[str], target: str, one: str = "z_one") -> OlsFit:
    """Least squares from sums of products; ``one`` names the intercept column."""
    features = list(features)
    g = gram(df, [*features, target])
    xtx, xty = g.block(features, features), g.block(features, [target])[:, 0]
    beta = solve(xtx, xty)
    yty = g.matrix[-1, -1]
    sse = float(yty - 2 * beta @ xty + beta @ xtx @ beta)
    sum_y = g.block([one], [target])[0, 0] if one in features else 0.0
    sst = yty - (sum_y**2 / g.n if g.n else 0.0)
    return OlsFit(features, beta, g.n, float(np.clip(1 - sse / max(sst, 1e-14), 0.0, 1.0)), sse)


def tile_residuals(df: DataFrame, fit: OlsFit, target: str, tile: str, min_n: int = 1) -> DataFrame:
    """Mean residual per tile with at least ``min_n`` rows."""
    return (
        df.groupBy(tile)
        .agg(F.avg(_x(target) - fit.prediction()).alias("value"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_n)
    )
