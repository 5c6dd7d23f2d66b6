"""Correlation, rank correlation, mutual information and partial correlation."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.derive import role_of, source_of
from skyloom.functions.tails import correlation_p, t_two_sided
from skyloom.operators.gram import gram_by, solve, square
from skyloom.operators.ranks import cells, picked, ranked_values
from skyloom.operators.scale import enrich
from skyloom.session import materialise


def _x(name: str) -> Column:
    v = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(v), v)


#: Equal-frequency bins of the counting estimate of mutual information.
BINS = 10


def pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(i, x, y, n): the distinct complete values of every pair with their count, written; hot values become one row."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("i"), _x(x).alias("x"), _x(y).alias("y")) for k, (x, y) in enumerate(pairs)]))
    rows = df.select(each.alias("c")).select("c.*").where("x is not null and y is not null")
    return materialise(rows.groupBy("i", "x", "y").agg(F.count(F.lit(1)).alias("n")), "pairs")


def _sides(pairs: DataFrame) -> dict[str, DataFrame]:
    """The values of either side with their places in the pair."""
    return {c: ranked_values(pairs.groupBy("i", c).agg(F.sum("n").alias("n")), c) for c in ("x", "y")}


def _rank_sums(pairs: DataFrame, sides: dict[str, DataFrame]) -> dict[int, tuple[float | None, int]]:
    totals = materialise(pairs.groupBy("i").agg(F.sum("n").alias("total")), "totals")
    joined = pairs
    for c, ranked in sides.items():
        centred = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0) - (F.col("total") + 1) / F.lit(2.0)
        joined = enrich(joined, ranked.join(totals, "i").select("i", c, centred.alias(f"r{c}")), ["i", c])
    sums = joined.groupBy("i").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(a) * F.col(b)).alias(k) for k, a, b in (("xy", "rx", "ry"), ("xx", "rx", "rx"), ("yy", "ry", "ry"))]
    )
    out = {}
    for r in sums.collect():  # one row a pair
        rho = r["xy"] / math.sqrt(r["xx"] * r["yy"]) if r["n"] > 1 and r["xx"] and r["yy"] else None
        out[r["i"]] = (rho, r["n"])
    return out


def spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[tuple[float | None, int]]:
    """Rank correlation of every pair over its complete rows, ties at their average rank; jobs do not grow with the pairs."""
    counted = pair_counts(df, pairs)
    found = _rank_sums(counted, _sides(counted))
    return [found.get(k, (None, 0)) for k in range(len(pairs))]


def spearman(df: DataFrame, x: str, y: str) -> tuple[float | None, int]:
    return spearman_pairs(df, [(x, y)])[0]


def information(joint: np.ndarray) -> float:
    """Mutual information in nats of a table of counts."""
    total, held = joint.sum(), joint > 0
    apart = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
    return float((joint[held] / total * np.log(joint[held] * total / apart[held])).sum())


def _binned_information(pairs: DataFrame, sides: dict[str, DataFrame], bins: int) -> dict[int, float]:
    probs = [i / bins for i in range(1, bins)]
    cuts = {c: picked(ranked, probs, c) for c, ranked in sides.items()}
    if not cuts["x"]:
        return {}
    rows = [(i, cuts["x"][i][1], cuts["y"][i][1]) for i in cuts["x"]]
    asked = pairs.sparkSession.createDataFrame(rows, "i int, cx array<double>, cy array<double>")

    def bin_of(value: str, at: str) -> Column:
        return F.size(F.filter(at, lambda e: e <= F.col(value)))

    met = pairs.join(F.broadcast(asked), "i").groupBy("i", bin_of("x", "cx").alias("bx"), bin_of("y", "cy").alias("by")).agg(F.sum("n").alias("n"))
    tables: dict[int, np.ndarray] = {}
    for r in met.collect():  # at most bins squared rows a pair
        tables.setdefault(r["i"], np.zeros((bins, bins)))[r["bx"], r["by"]] = r["n"]
    return {i: information(t) for i, t in tables.items()}


def mutual_information_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], bins: int = BINS) -> list[float | None]:
    """Counting estimates in nats over equal-frequency bins of both columns, for all pairs in the same few jobs."""
    counted = pair_counts(df, pairs)
    found = _binned_information(counted, _sides(counted), bins)
    return [found.get(k) for k in range(len(pairs))]


def mutual_information(df: DataFrame, x: str, y: str, bins: int = BINS) -> float | None:
    return mutual_information_pairs(df, [(x, y)], bins)[0]


SIMPLE_SCHEMA = (
    "feature string, source string, n_valid long, pearson_r double, pearson_p double, "
    "spearman_r double, spearman_p double, mi double, slope_per_unit double, slope_per_std double, "
    "feature_mean double, feature_std double, target_mean double, target_std double"
)


def simple_associations(df: DataFrame, features: Sequence[str], target: str, min_rows: int = 5,
                        with_mi: bool = True, digits: int = 6) -> DataFrame:
    """One row per feature, strongest Pearson first.  Moments of all features share a pass."""
    aggs = []
    for i, f in enumerate(features):
        x = F.when(_x(target).isNotNull(), _x(f))
        y = F.when(_x(f).isNotNull(), _x(target))
        aggs += [
            F.count(x).alias(f"n{i}"), F.corr(x, y).alias(f"r{i}"), F.avg(x).alias(f"mx{i}"),
            F.stddev_samp(x).alias(f"sx{i}"), F.avg(y).alias(f"my{i}"), F.stddev_samp(y).alias(f"sy{i}"),
        ]
    row, out = df.agg(*aggs).first(), []
    counted = pair_counts(df, [(f, target) for f in features])
    sides = _sides(counted)
    ranks = _rank_sums(counted, sides)
    shared = _binned_information(counted, sides, BINS) if with_mi else {}

    def cut(v):
        return None if v is None else round(float(v), digits)

    for i, f in enumerate(features):
        n, rho = row[f"n{i}"], row[f"r{i}"]
        if n < min_rows or rho is None or math.isnan(rho):
            continue
        sx, sy = row[f"sx{i}"], row[f"sy{i}"]
        rank = ranks[i][0]
        out.append(
            (
                f, source_of(f), n, cut(rho), cut(correlation_p(rho, n)), cut(rank),
                cut(correlation_p(rank, n)), cut(shared.get(i)),
                cut(rho * sy / sx) if sx > 1e-10 else None, cut(rho * sy), cut(row[f"mx{i}"]), cut(sx),
                cut(row[f"my{i}"]), cut(sy),
            )
        )
    return df.sparkSession.createDataFrame(out, SIMPLE_SCHEMA).orderBy(F.desc(F.abs("pearson_r")), "feature")


def _block_ranks(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The places of all columns' values, and rows of centred ranks ``r0, r1, ...`` with their count ``n``."""
    ids = materialise(rows.withColumn("__row", F.monotonically_increasing_id()), "block")
    each = cells(ids, columns, ["__row", "n"])
    ranked = ranked_values(each.groupBy("i", "value").agg(F.sum("n").alias("n")))
    sizes = ranked.groupBy("i").agg(F.sum("n").alias("total"))
    centred = F.col("n_before") + (F.col("n") + 1) / F.lit(2.0) - (F.col("total") + 1) / F.lit(2.0)
    placed = enrich(each, ranked.join(sizes, "i").select("i", "value", centred.alias("rank")), ["i", "value"])
    wide = placed.groupBy("__row").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("i") == k, F.col("rank"))).alias(f"r{k}") for k in range(len(columns))])
    return ranked, wide


def _block_tables(rows: DataFrame, columns: Sequence[str], cuts: list[list[float]], pairs: list[tuple[int, int]], bins: int) -> np.ndarray:
    """Joint counts of all pairs (pairs, bins, bins): each task adds its rows to arrays of fixed size."""

    def bin_of(k: int) -> Column:
        return F.size(F.filter(F.array(*[F.lit(v) for v in cuts[k]]), lambda e: e <= _x(columns[k])))

    binned = rows.select("n", *[bin_of(k).alias(f"b{k}") for k in range(len(columns))])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((len(pairs), bins * bins))
        for batch in batches:
            at, weights = batch.drop(columns="n").to_numpy(), batch["n"].to_numpy()
            for k, (p, q) in enumerate(pairs):
                held[k] += np.bincount(at[:, p] * bins + at[:, q], weights, bins * bins)
        yield pd.DataFrame({"counts": [held.ravel().astype(np.int64)]})

    parts = binned.mapInPandas(counted, "counts array<long>").select(F.posexplode("counts").alias("pos", "v"))
    found = parts.groupBy("pos").agg(F.sum("v").alias("v")).collect()  # pairs times bins squared numbers
    out = np.zeros(len(pairs) * bins * bins)
    for r in found:
        out[r["pos"]] = r["v"]
    return out.reshape(len(pairs), bins, bins)


CROSS_SCHEMA = (
    "feature_a string, source_a string, feature_b string, source_b string, n_valid long, "
    "pearson_r double, pearson_p double, spearman_r double, spearman_p double, mi double"
)


def cross_correlations(df: DataFrame, features: Sequence[str], min_rows: int = 100,
                       ranks: bool = True, bins: int = BINS) -> DataFrame:
    """Every pair of features from different source groups, over the rows that are complete for the two groups.

    A block of two groups is read as a whole: all Pearson coefficients come
    from one aggregation, all rank correlations from the product matrix of
    their ranks, and all mutual informations from one pass over joint counts.
    Jobs grow with the group pairs and not with the feature pairs.
    """
    groups: dict[str, list[str]] = {}
    for f in features:
        if source_of(f):
            groups.setdefault(source_of(f), []).append(f)
    out = []
    for a, b in itertools.combinations(sorted(groups), 2):
        block = [*groups[a], *groups[b]]
        rows = df.select(*[_x(c).alias(c) for c in block]).dropna("any")
        named = list(itertools.product(groups[a], groups[b]))
        pairs = [(block.index(p), block.index(q)) for p, q in named]
        row = rows.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.corr(F.col(f"`{p}`"), F.col(f"`{q}`")).alias(f"r{k}") for k, (p, q) in enumerate(named)],
        ).first()
        if row["n"] < min_rows:
            continue
        spearmans, shared = [None] * len(pairs), [None] * len(pairs)
        if ranks:
            counts = materialise(rows.groupBy(*[f"`{c}`" for c in block]).agg(F.count(F.lit(1)).alias("n")), "block-counts")
            ranked, wide = _block_ranks(counts, block)
            weighed = [(F.col(f"r{k}") * F.sqrt("n")).alias(f"r{k}") for k in range(len(block))]
            gram = gram_by(wide.select(*weighed), [f"r{k}" for k in range(len(block))]).first()
            products = square(gram["products"], len(block))
            for k, (p, q) in enumerate(pairs):
                scale = math.sqrt(products[p, p] * products[q, q])
                spearmans[k] = float(products[p, q] / scale) if scale else None
            quantiles = picked(ranked, [i / bins for i in range(1, bins)])
            tables = _block_tables(counts, block, [quantiles[k][1] for k in range(len(block))], pairs, bins)
            shared = [information(t) for t in tables]
        for k, (p, q) in enumerate(named):
            rho, rank = row[f"r{k}"], spearmans[k]
            out.append((p, a, q, b, row["n"], rho, correlation_p(rho, row["n"]), rank, correlation_p(rank, row["n"]), shared[k]))
    return df.sparkSession.createDataFrame(out, CROSS_SCHEMA)


# --- partial correlation --------------------------------------------------------------


def _unpivot(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long rows (feature, x) with the kept columns; rows without x are dropped."""
    entry = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), _x(f).alias("x")) for f in features])
    )
    return df.select(*keep, entry.alias("e")).select(*keep, "e.feature", "e.x").where("x is not null")


def partial_from_products(products: Sequence[float], n: int, q: int) -> dict:
    """Partial r of x and y given q confounders, from sums over [Z, x, y]."""
    g = square(products, q + 2)
    if n < q + 2:
        return {}
    ztz, ztx, zty = g[:q, :q], g[:q, q], g[:q, q + 1]
    bx, by = solve(ztz, ztx), solve(ztz, zty)
    xmx, ymy, xmy = g[q, q] - ztx @ bx, g[q + 1, q + 1] - zty @ by, g[q, q + 1] - ztx @ by
    if xmx * ymy <= 0:
        return {}
    rho = float(np.clip(xmy / math.sqrt(xmx * ymy), -1, 1))
    free = n - q - 1
    t = rho * math.sqrt(free / max(1 - rho * rho, 1e-14)) if free >= 1 else None
    mean_x, mean_y = ztx[0] / n, zty[0] / n
    found = {
        "partial_r": rho, "t_stat": t, "partial_p": t_two_sided(t, free) if t is not None else None,
        "effect_slope": xmy / xmx if abs(xmx) > 1e-14 else None,
        "feature_mean": mean_x, "feature_std": math.sqrt(max(0.0, g[q, q] / n - mean_x**2)),
        "target_mean": mean_y, "target_std": math.sqrt(max(0.0, g[q + 1, q + 1] / n - mean_y**2)),
    }
    return {k: None if v is None else float(v) for k, v in found.items()}


PARTIAL_SCHEMA = (
    "feature string, source string, n_valid long, partial_r double, partial_p double, t_stat double, "
    "effect_slope double, partial_r_adj double, partial_p_adj double, confounding_fraction double, "
    "feature_mean double, feature_std double, target_mean double, target_std double"
)


def partial_correlations(df: DataFrame, features: Sequence[str], target: str, confounders: Sequence[str],
                         morphology: Sequence[str] = ()) -> DataFrame:
    """Partial correlation with the target given the confounders, per feature.

    With ``morphology`` the standardised morphology columns join the
    confounders for an adjusted coefficient and the share of the plain one that
    they explain.  The first confounder must be the intercept.
    """
    z, morph = list(confounders), list(morphology)
    base = df.where(_x(target).isNotNull())
    if morph:
        stats = base.agg(
            *[F.avg(_x(m)).alias(f"a{i}") for i, m in enumerate(morph)],
            *[F.stddev_pop(_x(m)).alias(f"s{i}") for i, m in enumerate(morph)],
        ).first()
        scaled = {}
        for i, m in enumerate(morph):
            spread = stats[f"s{i}"] or 0.0
            scaled[f"__m{i}"] = (
                F.coalesce((_x(m) - F.lit(stats[f"a{i}"])) / F.lit(spread), F.lit(0.0))
                if spread >= 1e-10 else F.lit(0.0)
            )
        base = base.withColumns(scaled)
    extra = [f"__m{i}" for i in range(len(morph))]
    long = _unpivot(base, features, [*z, *extra, target])

    def fits(columns: list[str]) -> dict[str, tuple[int, dict]]:
        rows = gram_by(long, [*columns, "x", target], ["feature"]).collect()  # one row per feature
        return {
            row["feature"]: (row["n"], partial_from_products(row["products"], row["n"], len(columns)))
            for row in rows
        }

    plain = fits(z)
    adjusted = fits([*z, *extra]) if morph else {}
    out = []
    for f in features:
        n, p = plain.get(f, (0, {}))
        a = adjusted.get(f, (0, {}))[1]
        share = None
        if p and a and abs(p["partial_r"]) > 1e-12:
            share = (p["partial_r"] - a["partial_r"]) / p["partial_r"]
        out.append(
            (
                f, source_of(f), n, p.get("partial_r"), p.get("partial_p"), p.get("t_stat"),
                p.get("effect_slope"), a.get("partial_r"), a.get("partial_p"), share,
                *[p.get(k) for k in ("feature_mean", "feature_std", "target_mean", "target_std")],
            )
        )
    return df.sparkSession.createDataFrame(out, PARTIAL_SCHEMA)


def greening(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if role_of(c) == "greening"]


def morphology(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if role_of(c) == "morphology"]
