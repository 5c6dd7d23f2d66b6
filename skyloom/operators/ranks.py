"""Ranks and exact quantiles of many columns at once.

Columns are laid out as (column number, value) rows and counted, so that one
sort by ranges serves all of them: the number of jobs does not depend on the
number of columns, and hot values are one row before anything is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import materialise


def number(name: str) -> Column:
    """A column as double, NaN as null."""
    v = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(v), v)


def ordered_totals(df: DataFrame, groups: Sequence[str], order: str, amounts: Sequence[str]) -> DataFrame:
    """``df`` with ``<amount>_before``, the group's sum over rows of lower ``order``, which is unique in a group.

    A sort by ranges deals the rows out, so a group of any size is spread over
    tasks; each part adds what the group has in earlier parts.
    """
    groups = list(groups)
    ranged = materialise(df.repartitionByRange(*groups, order).withColumn("__part", F.spark_partition_id()), "ranged")
    across = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__part", *groups).agg(*[F.sum(a).alias(f"__t_{a}") for a in amounts])
    starts = sums.select("__part", *groups, *[F.coalesce(F.sum(f"__t_{a}").over(across), F.lit(0)).alias(f"__s_{a}") for a in amounts])
    inside = Window.partitionBy("__part", *groups).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, ["__part", *groups]).select(
        *df.columns, *[(F.coalesce(F.sum(a).over(inside), F.lit(0)) + F.col(f"__s_{a}")).alias(f"{a}_before") for a in amounts]
    )


def cells(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(kept columns, i, value) for every value of the columns that is there."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("i"), number(c).alias("value")) for k, c in enumerate(columns)]))
    return df.select(*keep, each.alias("__c")).select(*keep, "__c.i", "__c.value").where("value is not null")


def ranked_values(counts: DataFrame, value: str = "value") -> DataFrame:
    """(i, value, n) rows with ``n_before``, written: every distinct value's place in its column."""
    return materialise(ordered_totals(counts, ["i"], value, ["n"]), "ranked-values")


def column_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return ranked_values(cells(df, columns).groupBy("i", "value").agg(F.count(F.lit(1)).alias("n")))


def picked(ranked: DataFrame, probs: Sequence[float], value: str = "value") -> dict[int, tuple[int, list[float]]]:
    """For each column number the number of values, and its quantiles with linear interpolation between neighbours."""
    totals = {r["i"]: r["n"] for r in ranked.groupBy("i").agg(F.sum("n").alias("n")).collect()}  # one row a column
    if not totals:
        return {}
    spots = {i: [p * (n - 1) for p in probs] for i, n in totals.items()}
    wanted = [(i, sorted({int(s) for s in own} | {min(int(s) + 1, totals[i] - 1) for s in own})) for i, own in spots.items()]
    asked = ranked.sparkSession.createDataFrame(wanted, "i int, spots array<long>")
    hit = F.filter("spots", lambda s: (s >= F.col("n_before")) & (s < F.col("n_before") + F.col("n")))
    met = ranked.join(F.broadcast(asked), "i").select("i", F.col(value).alias("v"), F.explode(hit).alias("spot"))
    at = {(r["i"], r["spot"]): float(r["v"]) for r in met.collect()}  # two values for each quantile
    out = {}
    for i, n in totals.items():
        quantiles = []
        for s in spots[i]:
            low = int(s)
            a, b = at[i, low], at[i, min(low + 1, n - 1)]
            quantiles.append(a + (b - a) * (s - low))
        out[i] = (n, quantiles)
    return out


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of every column from one pass; None for a column without values."""
    found = picked(column_ranks(df, columns), probs) if columns else {}
    return {c: found[k][1] if k in found else [None] * len(probs) for k, c in enumerate(columns)}


def reached(df: DataFrame, columns: Sequence[str], probs: Sequence[float], weight: str) -> dict[str, list[float]]:
    """For every column the least values at which those shares of its rows are reached, a row standing for ``weight``.

    Exact, and values of the column; an empty list for a column without values.
    """
    counts = cells(df, columns, [weight]).groupBy("i", "value").agg(F.sum(weight).alias("n"))
    ranked = ranked_values(counts)
    totals = {r["i"]: r["total"] for r in ranked.groupBy("i").agg(F.sum("n").alias("total")).collect()}  # one row a column
    out: dict[str, list[float]] = {c: [] for c in columns}
    if not totals:
        return out
    places = [(i, [max(1, math.ceil(p * n)) for p in probs]) for i, n in totals.items()]
    asked = df.sparkSession.createDataFrame(places, "i int, places array<long>")
    here = F.filter("places", lambda at: (at > F.col("n_before")) & (at <= F.col("n_before") + F.col("n")))
    met = ranked.join(F.broadcast(asked), "i").select("i", "value", F.explode(here).alias("place"))
    at = {(r["i"], r["place"]): float(r["value"]) for r in met.collect()}  # one value for each column and share
    return out | {columns[i]: [at[i, spot] for spot in own] for i, own in places}
