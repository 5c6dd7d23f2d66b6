"""Difference-in-differences with tile and month effects."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.derive import scene_month, scene_year
from skyloom.functions.tails import chi2_upper, t_quantile_975, t_two_sided
from skyloom.operators.gram import triangle
from skyloom.operators.sampling import whole_group_cap
from skyloom.operators.scale import enrich
from skyloom.session import materialise

EVENT_WINDOW = (-5, 10)  # fixed values: years before and after the onset
REFERENCE_YEAR = -1


def build_panel(df: DataFrame, outcome: str, treatment: str, tile: str = "tile_id",
                controls: Sequence[str] = (), ts: str | None = None, scene_ym: str | None = None) -> DataFrame:
    """Typed, complete rows: tile, scene_ym, y, d and the controls."""
    if scene_ym:
        month = F.col(scene_ym).cast("int")
    elif ts:
        month = scene_month(F.year(ts), F.month(ts))
    else:
        month = scene_month("year", "month_of_year")
    out = df.select(
        F.col(tile).alias("tile"), month.alias("scene_ym"), F.col(outcome).cast("double").alias("y"),
        F.col(treatment).cast("double").alias("d"), *[F.col(c).cast("double").alias(c) for c in controls],
    )
    return out.dropna("any")


def eligible(panel: DataFrame, min_obs: int = 3) -> DataFrame:
    """Rows of tiles that were treated at some time and seen often enough."""
    tiles = panel.groupBy("tile").agg(F.max("d").alias("most"), F.count(F.lit(1)).alias("n"))
    return panel.join(tiles.where((F.col("most") > 0) & (F.col("n") >= min_obs)).select("tile"), "tile", "left_semi")


def cap_tiles(panel: DataFrame, max_rows: int, order: Column | None = None) -> DataFrame:
    """Whole tiles in random order until the cap is reached."""
    return whole_group_cap(panel, "tile", max_rows, order)


def event_time(panel: DataFrame, window: tuple[int, int] = EVENT_WINDOW) -> DataFrame:
    """Add onset year, event time and its clipped bin; tiles without onset go."""
    dated = panel.withColumn("scene_year", scene_year("scene_ym"))
    onset = dated.where(F.col("d") > 0).groupBy("tile").agg(F.min("scene_year").alias("onset_year"))
    out = dated.join(onset, "tile").withColumn("event_time", F.col("scene_year") - F.col("onset_year"))
    return out.withColumn("k_bin", F.greatest(F.lit(window[0]), F.least(F.lit(window[1]), "event_time")))


def demean(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Subtract group means (one effect), from a combined aggregate joined back."""
    means = df.groupBy(group).agg(
        *[F.avg(c).alias(f"__{c}") for c in columns], F.count(F.lit(1)).alias("n")
    )
    joined = enrich(df, means.drop("n"), [group], means.select(group, "n"))
    return joined.withColumns({c: F.col(c) - F.col(f"__{c}") for c in columns}).drop(
        *[f"__{c}" for c in columns]
    )


@dataclass
class TwoWayFit:
    """Coefficients with tile-clustered errors; absorbed columns are left out."""

    regressors: list[str]
    beta: dict[str, float]
    covariance: np.ndarray
    n_obs: int
    n_tiles: int
    n_periods: int
    r2_within: float
    df_resid: int
    dropped: list[str] = field(default_factory=list)

    def rows(self) -> list[tuple]:
        crit = t_quantile_975(self.df_resid)
        out = []
        for i, name in enumerate(self.regressors):
            b, se = self.beta[name], math.sqrt(max(self.covariance[i, i], 0.0))
            p = t_two_sided(b / se, self.df_resid) if se > 0 else None
            out.append((name, b, se, b - crit * se, b + crit * se, p))
        return out

    def wald(self, names: Sequence[str]) -> float | None:
        """p of the joint test that the named coefficients are all zero."""
        at = [self.regressors.index(n) for n in names if n in self.regressors]
        if not at:
            return None
        b = np.array([self.beta[self.regressors[i]] for i in at])
        v = self.covariance[np.ix_(at, at)]
        return chi2_upper(float(b @ np.linalg.pinv(v) @ b), len(at))


def _tile_cells(panel: DataFrame, columns: list[str], bin_column: str | None = None) -> DataFrame:
    """Per tile a list of month cells with counts and sums, and the tile's products.

    Both effects are constant within a (tile, month) cell, so its moments are
    all the fit needs; a tile's list is as long as there are months.  The bin,
    constant within a cell as well, goes along as a number.
    """
    pairs = triangle(len(columns))
    kept = F.lit(0) if bin_column is None else F.col(bin_column)
    cells = panel.withColumn("__bin", kept.cast("int")).groupBy("tile", "scene_ym", "__bin").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{k}") for k, (i, j) in enumerate(pairs)],
    )
    return cells.groupBy("tile").agg(
        F.collect_list("scene_ym").alias("months"), F.collect_list("__bin").alias("bins"), F.collect_list("n").alias("n"),
        F.collect_list(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s"),
        F.array(*[F.sum(f"p{k}") for k in range(len(pairs))]).alias("p"),
    )


def two_way_fit(panel: DataFrame, regressors: Sequence[str], outcome: str = "y", bins: tuple[str, dict[str, int]] | None = None) -> TwoWayFit:
    """Least squares with tile and month effects, exact on unbalanced panels.

    Tile effects are removed inside each tile; months, a few hundred at most,
    stay as explicit columns of one normal matrix that tasks add up in numpy.
    No sweep over the data is repeated.  The covariance sums score products per
    tile and is scaled by n / (n - k - absorbed effects).

    ``bins`` is a whole-number column with one value in each (tile, month) and
    the names of regressors, the first ones, that indicate its values.  They are
    formed where a tile is fitted, so what a tile holds does not grow with their
    number.
    """
    bin_column, indicated = bins or (None, {})
    regressors = [*indicated, *regressors]
    marks = np.array(list(indicated.values()), int)
    k, own = len(regressors) + 1, [*regressors[len(marks) :], outcome]
    tiles = materialise(_tile_cells(panel, own, bin_column), "tiles")
    months = sorted(r[0] for r in tiles.select(F.explode("months")).distinct().collect())
    at = {m: i for i, m in enumerate(months)}
    width, size = len(months), len(months) + k
    upper_own = np.triu_indices(len(own))

    def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        where = np.array([at[m] for m in row.months])
        n = np.asarray(row.n, dtype=float)
        s = np.stack([np.asarray(v, dtype=float) for v in row.s])
        inside = (np.asarray(row.bins)[:, None] == marks[None, :]).astype(float)
        products, first = np.zeros((k, k)), len(marks)
        products[:first, :first] = (inside * n[:, None]).T @ inside
        products[:first, first:] = inside.T @ s
        products[first:, :first] = products[:first, first:].T
        part = np.zeros((len(own), len(own)))
        part[upper_own] = row.p
        products[first:, first:] = part + part.T - np.diag(np.diag(part))
        return where, n, np.column_stack([inside * n[:, None], s]), products

    def normal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, n_obs, n_tiles = np.zeros((size, size)), 0.0, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                where, n, s, p = unpack(row)
                total, sums = n.sum(), s.sum(axis=0)
                g[where, where] += n
                g[np.ix_(where, where)] -= np.outer(n, n) / total
                g[where, width:] += s - np.outer(n, sums) / total
                g[width:, width:] += p - np.outer(sums, sums) / total
                n_obs, n_tiles = n_obs + total, n_tiles + 1
        g[width:, :width] = g[:width, width:].T
        values = [*g[np.triu_indices(size)], n_obs, n_tiles]
        yield pd.DataFrame({"pos": range(len(values)), "v": values})

    summed = tiles.mapInPandas(normal, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v"))
    values = [r["v"] for r in summed.orderBy("pos").collect()]  # one small matrix
    if not values or not values[-1]:
        raise ValueError("no rows to fit")
    g = np.zeros((size, size))
    g[np.triu_indices(size)] = values[:-2]
    g = g + g.T - np.diag(np.diag(g))
    n_obs, n_tiles = int(round(values[-2])), int(round(values[-1]))

    by_month = np.linalg.pinv(g[:width, :width], rcond=1e-12) @ g[:width, width:]
    left = g[width:, width:] - g[:width, width:].T @ by_month
    scale = np.diag(g[width:, width:])[:-1]
    keep: list[int] = []
    for i in range(k - 1):  # a column that the effects or earlier columns explain is absorbed
        trial = [*keep, i]
        block = left[np.ix_(trial, trial)]
        rest = block[-1, -1]
        if len(keep):
            rest -= block[-1, :-1] @ np.linalg.lstsq(block[:-1, :-1], block[:-1, -1], rcond=None)[0]
        if rest > 1e-9 * max(scale[i], 1e-12):
            keep = trial
    names = [list(regressors)[i] for i in keep]
    xx, xy = left[np.ix_(keep, keep)], left[keep, -1]
    beta = np.linalg.solve(xx, xy) if keep else np.zeros(0)

    def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meat = np.zeros((len(keep), len(keep)))
        for batch in batches:
            for row in batch.itertuples(index=False):
                where, n, s, p = unpack(row)
                effect = by_month[where]
                u = (s.sum(axis=0) - n @ effect) / n.sum() + effect
                c = p - u.T @ s - s.T @ u + (u * n[:, None]).T @ u
                score = c[keep, -1] - c[np.ix_(keep, keep)] @ beta
                meat += np.outer(score, score)
        flat = meat.ravel()
        yield pd.DataFrame({"pos": range(len(flat)), "v": flat})

    parts = tiles.mapInPandas(scores, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v"))
    meat = np.array([r["v"] for r in parts.orderBy("pos").collect()]).reshape(len(keep), len(keep))
    bread = np.linalg.inv(xx) if keep else xx
    free = max(n_obs - len(keep) - (n_tiles + width - 1), 1)
    inner = g[width:, width:]
    sse = inner[-1, -1] - 2 * beta @ inner[keep, -1] + beta @ inner[np.ix_(keep, keep)] @ beta
    return TwoWayFit(
        names, dict(zip(names, map(float, beta))), bread @ meat @ bread * (n_obs / free), n_obs, n_tiles,
        width, float(1 - sse / inner[-1, -1]) if inner[-1, -1] > 0 else float("nan"), free,
        [r for r in regressors if r not in names],
    )


COEFFICIENTS = "term string, estimate double, std_error double, ci_low double, ci_high double, p_value double"


def difference_in_differences(panel: DataFrame, controls: Sequence[str] = ()) -> tuple[DataFrame, TwoWayFit]:
    """Effect of the treatment column ``d`` with two-way effects."""
    fit = two_way_fit(panel, ["d", *controls])
    return panel.sparkSession.createDataFrame(fit.rows(), COEFFICIENTS), fit


def event_study(panel: DataFrame, window: tuple[int, int] = EVENT_WINDOW,
                controls: Sequence[str] = ()) -> tuple[DataFrame, float | None]:
    """One coefficient per year around the onset and the p of the pre-period test.

    Years beyond the window fall into its ends; the year before the onset is
    the reference.
    """
    if window[0] >= window[1]:
        raise ValueError(f"window must rise, got {window}")
    ks = [k for k in range(window[0], window[1] + 1) if k != REFERENCE_YEAR]
    names = {k: f"k_{'m' if k < 0 else 'p'}{abs(k)}" for k in ks}
    fit = two_way_fit(event_time(panel, window), controls, bins=("k_bin", {names[k]: k for k in ks}))
    back = {v: k for k, v in names.items()}
    table = [(back[t[0]], *t[1:]) for t in fit.rows() if t[0] in back]
    out = panel.sparkSession.createDataFrame(table, COEFFICIENTS.replace("term string", "event_time int"))
    return out, fit.wald([names[k] for k in ks if k < REFERENCE_YEAR])
