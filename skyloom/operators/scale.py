"""Building blocks that keep hot keys and global orders off a single task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import materialise

# Rows of one key that a single join task takes before the key is split.
KEY_ROWS_PER_TASK = 20_000


def split_join(left: DataFrame, right: DataFrame, keys: list[str],
               rows_per_task: int = KEY_ROWS_PER_TASK) -> DataFrame:
    """Inner equi-join that cuts hot keys into a grid of smaller tasks.

    Rows per key are counted on both sides (map-side combined).  A key above
    the limit is cut into ``a`` parts on the left and ``b`` on the right; each
    left part meets each right part exactly once, so no pair is lost or doubled.
    Keys below the limit pass through unchanged.  The table of hot keys has at
    most rows/limit entries; AQE decides from its real size how to join it.

    Both sides are shuffled: the planner sizes them by their files, which tells
    nothing of rows that an explode has multiplied, and must not broadcast them.
    """

    def sized(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    def parts(n: str) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(rows_per_task)).cast("int"))

    hot = (
        sized(left, "__nl").join(sized(right, "__nr"), keys)
        .where((F.col("__nl") > rows_per_task) | (F.col("__nr") > rows_per_task))
        .select(*keys, parts("__nl").alias("__pl"), parts("__nr").alias("__pr"))
    )

    def prepared(df: DataFrame, own: str, other: str) -> DataFrame:
        whole = [F.col(f"`{c}`") for c in df.columns]
        salted = (
            df.join(hot, keys, "left")
            .withColumn(own, F.pmod(F.xxhash64(*whole), F.coalesce(F.col(f"__p{own[-1]}"), F.lit(1))).cast("int"))
            .withColumn(
                other,
                F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"__p{other[-1]}"), F.lit(1)) - 1)),
            )
        )
        return salted.drop("__pl", "__pr")

    return (
        prepared(left, "__l", "__r").hint("merge")
        .join(prepared(right, "__r", "__l"), [*keys, "__l", "__r"])
        .drop("__l", "__r")
    )


def enrich(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame | None = None,
           rows_per_task: int = 1_000_000) -> DataFrame:
    """Left join with a table that has one row per key, safe for hot keys.

    ``counts`` (keys, ``n``) says how often each key occurs on the left; it is
    computed when not given.  Keys above the limit, at most rows/limit of them,
    are spread over several copies of their one right-hand row.
    """
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") > rows_per_task).select(
        *keys, F.ceil(F.col("n") / F.lit(rows_per_task)).cast("int").alias("__p")
    )
    parts = F.coalesce(F.col("__p"), F.lit(1))
    whole = [F.col(f"`{c}`") for c in left.columns]
    salted = left.join(hot, keys, "left").withColumn(
        "__s", F.pmod(F.xxhash64(*whole), parts).cast("int")
    ).drop("__p")
    copies = right.join(hot, keys, "left").withColumn(
        "__s", F.explode(F.sequence(F.lit(0), parts - 1))
    ).drop("__p")
    return salted.join(copies, [*keys, "__s"], "left").drop("__s")


# Rows that one task ranks when a quota runs out inside a level.
RANKED_ROWS_PER_TASK = 100_000


def take_lowest(df: DataFrame, groups: list[str], order: Column, ties: list[str],
                quota: Column | int, order_range: int,
                ranked_rows: int = RANKED_ROWS_PER_TASK) -> DataFrame:
    """The ``quota`` rows of each group with the lowest ``order``, exactly.

    ``order`` is a whole number in [0, order_range), spread evenly (a hash).
    Each group's order is cut into as many levels as its size asks for, and a
    histogram of the levels tells in which one the quota runs out: lower levels
    are kept whole, higher ones dropped, and only the rows of that one level,
    about ``ranked_rows`` of them, are ranked.
    """
    out = df.columns
    quota_col = quota if isinstance(quota, Column) else F.lit(int(quota))
    base = df.withColumns({"__o": order.cast("long"), "__q": quota_col.cast("long")})

    def levels(n: Column) -> Column:
        return F.greatest(F.lit(1), F.least(F.lit(1 << 20), F.ceil(n / F.lit(ranked_rows)))).cast("long")

    if groups:
        sizes = base.groupBy(*groups).agg(F.count(F.lit(1)).alias("__size"))
        marked = base.join(sizes, groups)
    else:
        marked = base.withColumn("__size", F.lit(df.count()))
    marked = marked.withColumn(
        "__v", F.floor(F.col("__o") * levels(F.col("__size")) / F.lit(order_range)).cast("int")
    ).drop("__size")
    w = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__v")
    plan = (
        marked.groupBy(*groups, "__v")
        .agg(F.count(F.lit(1)).alias("__n"), F.first("__q").alias("__quota"))
        .withColumn("__before", F.sum("__n").over(w) - F.col("__n"))
        .where(F.col("__before") < F.col("__quota"))
        .select(
            *groups, "__v",
            (F.col("__quota") - F.col("__before")).alias("__left"),
            (F.col("__before") + F.col("__n") <= F.col("__quota")).alias("__all"),
        )
    )
    on = [*groups, "__v"]
    kept = marked.join(plan, on)
    rank = Window.partitionBy(*on).orderBy("__o", *ties)
    edge = (
        kept.where(~F.col("__all"))
        .withColumn("__k", F.row_number().over(rank))
        .where(F.col("__k") <= F.col("__left"))
    )
    return kept.where("__all").select(*out).unionByName(edge.select(*out))


def hash_order(*columns: str, seed: int = 42) -> tuple[Column, int]:
    """A reproducible random order over rows, with its range."""
    size = 1 << 31
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns], F.lit(seed)), F.lit(size)), size


# Rows of a global order that one task handles.
ORDERED_ROWS_PER_TASK = 1_000_000


def cut_points(df: DataFrame, column: str, rows_per_task: int = ORDERED_ROWS_PER_TASK) -> list[float]:
    """Values that cut a column into parts of about ``rows_per_task`` rows.

    Approximate and held by the driver, a few thousand numbers at most.  They
    only balance work: every user of the cuts is exact for any cuts.
    """
    parts = min(8192, df.count() // rows_per_task + 1)
    if parts == 1:
        return []
    probs = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(F.col(column).cast("double"), probs, 10 * parts).alias("q")).first()
    return sorted(set(row["q"] or []))


def with_part(df: DataFrame, column: str, cuts: list[float], name: str = "__part") -> DataFrame:
    """Number the part each value falls in, by binary search over the cuts."""
    if not cuts:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    marked = df.withColumn("__cut", F.col(column).cast("double"))
    return Bucketizer(
        splits=splits, inputCol="__cut", outputCol=name, handleInvalid="keep"
    ).transform(marked).drop("__cut")


def running_total(df: DataFrame, order: str, amounts: list[str], groups: list[str] | None = None,
                  cuts: list | None = None) -> DataFrame:
    """Exclusive running sums over a global order, one row per order value.

    ``df`` must have unique ``order`` values per group.  The order is cut into
    parts; sums inside a part and the sums of earlier parts are added up, so
    that no single task sorts everything.  Adds ``<amount>_before``.
    """
    groups = groups or []
    cuts = cut_points(df, order) if cuts is None else cuts
    parted = with_part(df, order, cuts)
    across = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        parted.groupBy(*groups, "__part")
        .agg(*[F.sum(a).alias(f"__t_{a}") for a in amounts])
        .select(
            *groups, "__part",
            *[F.coalesce(F.sum(f"__t_{a}").over(across), F.lit(0)).alias(f"__s_{a}") for a in amounts],
        )
    )
    inside = Window.partitionBy(*groups, "__part").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    out = parted.join(starts, [*groups, "__part"])
    return out.select(
        *df.columns,
        *[
            (F.coalesce(F.sum(a).over(inside), F.lit(0)) + F.col(f"__s_{a}")).alias(f"{a}_before")
            for a in amounts
        ],
    )


def value_ranks(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """(value, n, n_before, rank): average ranks from 1, one row per distinct value.

    With ``weight`` each row stands for that many equal rows.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = materialise(
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(n.alias("n")),
        "values",
    )
    return running_total(counts, "value", ["n"]).select(
        "value", "n", "n_before",
        (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"),
    )


def exact_quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours."""
    ranked = value_ranks(df, column)
    total = ranked.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(probs)
    spots = {p: p * (total - 1) for p in probs}
    wanted = sorted({int(s) for s in spots.values()} | {min(int(s) + 1, total - 1) for s in spots.values()})
    hit = F.filter(
        F.array(*[F.lit(i).cast("long") for i in wanted]),
        lambda i: (i >= F.col("n_before")) & (i < F.col("n_before") + F.col("n")),
    )
    rows = ranked.select("value", F.explode(hit).alias("spot")).collect()  # at most 2 per prob
    at = {r["spot"]: float(r["value"]) for r in rows}
    out = []
    for p in probs:
        low = int(spots[p])
        frac = spots[p] - low
        a, b = at[low], at[min(low + 1, total - 1)]
        out.append(a + (b - a) * frac)
    return out


def numbered(df: DataFrame, groups: list[str], hashed: str, tie: str, parts: int = 1024) -> DataFrame:
    """Add ``place``: position from 0 of each row in its group by a hash column.

    The hash is cut into even parts; positions count within a part and start at
    the number of rows in earlier parts, so no group is sorted in one task.
    """
    width = 1 << 16
    parted = df.withColumn(
        "__part", F.floor(F.shiftrightunsigned(hashed, 48) * F.lit(parts) / F.lit(width)).cast("int")
    )
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = parted.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n")).select(
        *groups, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy(*groups, "__part").orderBy(hashed, tie)
    return (
        parted.join(starts, [*groups, "__part"])
        .withColumn("place", F.row_number().over(inside) - 1 + F.col("__start"))
        .drop("__part", "__start")
    )
