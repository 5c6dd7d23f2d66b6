"""Statistics, histograms, profiles and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import derive
from skyloom.functions.bins import DIMENSIONS
from skyloom.operators import catalog, sampling
from skyloom.operators.scale import exact_quantiles
from skyloom.queries.base import OBS_TIES, ORDER_RANGE, ORDER_SQL, dbl, query, r
from skyloom.session import materialise
from skyloom.sources import derived

_T = "coalesce(aster_lst, modis_lst, ndvi)"


def _obs(spark, sf):
    return derived.obs(spark, sf).withColumn("temperature", derive.temperature("any"))


def _bin_sql(name: str) -> str:
    d = DIMENSIONS[name]
    value = {"temperature": _T}.get(name, name)
    if d.kind == "quarter":
        raw = f"(year - {d.edges[0][:4]}) * 4 + floor((month_of_year - 1) / 3e0)"
    elif d.kind == "breaks":
        raw = f"len(list_filter({list(d.edges)}, lambda e: e <= {value})) - 1"
    else:
        raw = f"floor(({value} - {dbl(d.edges[0])}) / {dbl(d.edges[1] - d.edges[0])})"
    return f"greatest(0, least({d.n_bins - 1}, cast({raw} as int)))"


def _hist_sql(name: str, groups: str) -> str:
    where = f"where {_T} is not null" if name == "temperature" else ""
    return (
        f"select {groups}, {_bin_sql(name)} as bin, count(*) as n from obs {where} "
        f"group by {groups}, bin"
    )


_ROW_DIMS = [n for n, d in DIMENSIONS.items() if d.kind != "extent"]


def _dense_sql(name: str) -> str:
    return f"""{name}_d as (select partition_key, tile_id, list(coalesce(n, 0) order by i) as {name}_counts
      from (select g.partition_key, g.tile_id, i, n from stats g cross join range({DIMENSIONS[name].n_bins}) r(i)
        left join ({_hist_sql(name, 'partition_key, tile_id')}) h
        on g.partition_key = h.partition_key and g.tile_id = h.tile_id and r.i = h.bin) group by 1, 2)"""


def _occupied_sql(name: str, lo: str, hi: str) -> str:
    d = DIMENSIONS[name]
    edge, width = dbl(d.edges[0]), dbl(d.edges[1] - d.edges[0])

    def at(v: str) -> str:
        return f"greatest(0, least({d.n_bins - 1}, cast(floor(({v} - {edge}) / {width}) as int)))"

    return f"list_transform(range({d.n_bins}), lambda i: case when i between {at(lo)} and {at(hi)} then 1 else 0 end) as {name}_counts"


_STATS = f"""stats as (select partition_key, tile_id, count(*) as row_count, min({_T}) as value_min, max({_T}) as value_max,
  avg({_T}) as value_mean, min(longitude) as lon_min, max(longitude) as lon_max, min(latitude) as lat_min, max(latitude) as lat_max
  from obs group by 1, 2)"""


@query(
    "A3",
    f"with {_STATS} select * exclude (value_mean), round(value_mean / pi(), 6) as value_mean_by_pi from stats",
    ("obs",),
)
def tile_statistics(spark, sf):
    out = catalog.partition_statistics(_obs(spark, sf), ["year"])
    return out.withColumn("value_mean_by_pi", r(F.col("value_mean") / F.pi())).drop(
        "year_counts", "value_mean"
    )


@query(
    "A4 J11 J12 A6",
    f"with {_STATS}, " + ", ".join(_dense_sql(n) for n in _ROW_DIMS)
    + " select partition_key, tile_id, row_count, "
    + ", ".join(f"array_to_string({n}_counts, ',') as {n}_counts" for n in _ROW_DIMS)
    + ", array_to_string(longitude_counts, ',') as longitude_counts, array_to_string(latitude_counts, ',') as latitude_counts"
    + f" from (select *, {_occupied_sql('longitude', 'lon_min', 'lon_max')}, {_occupied_sql('latitude', 'lat_min', 'lat_max')} from stats"
    + "".join(f" join {n}_d using (partition_key, tile_id)" for n in _ROW_DIMS) + ")",
    ("obs",),
)
def tile_histograms(spark, sf):
    out = catalog.partition_statistics(_obs(spark, sf))
    return out.select(
        "partition_key", "tile_id", "row_count",
        *[F.array_join(F.col(f"{n}_counts").cast("array<string>"), ",").alias(f"{n}_counts") for n in DIMENSIONS],
    )


@query(
    "A4",
    " union all ".join(
        f"select '{n}' as dimension, cast(bin as int) as bin, n from ({_hist_sql(n, 'year > 0')}) q"
        for n in _ROW_DIMS
    ).replace("select year > 0, ", "select ").replace("group by year > 0, ", "group by "),
    ("obs",),
)
def dimension_histograms(spark, sf):
    parts = [
        catalog.histogram_rows(_obs(spark, sf), n, []).select(F.lit(n).alias("dimension"), "bin", "n")
        for n in _ROW_DIMS
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "J11",
    f"""select partition_key, array_to_string(list(coalesce(n, 0) order by i), ',') as counts from (
      select g.partition_key, i, n from (select distinct partition_key from obs) g cross join range(31) r(i)
      left join ({_hist_sql('day_of_month', 'partition_key')}) h on g.partition_key = h.partition_key and r.i = h.bin) group by 1""",
    ("obs",),
)
def dense_histogram(spark, sf):
    counts = catalog.histogram_rows(derived.obs(spark, sf), "day_of_month", ["partition_key"])
    out = catalog.densify(counts, ["partition_key"], DIMENSIONS["day_of_month"].n_bins)
    return out.select("partition_key", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query(
    "A7 J13",
    f"""with h as ({_hist_sql('month_of_year', 'partition_key')}), g as (select distinct partition_key from obs),
      d as (select g.partition_key, i, coalesce(n, 0) as n from g cross join range(12) r(i) left join h on g.partition_key = h.partition_key and h.bin = r.i)
      select partition_key, array_to_string(list(n order by i), ',') as month_of_year_counts from d group by 1
      union all select null, array_to_string(list(n order by i), ',') from (select i, sum(n)::bigint as n from d group by i)""",
    ("obs",),
)
def summed_histograms(spark, sf):
    stats = catalog.partition_statistics(_obs(spark, sf), ["month_of_year"])
    out = catalog.sum_arrays_rollup(stats, "partition_key", "month_of_year_counts")
    return out.select(
        "partition_key",
        F.array_join(F.col("month_of_year_counts").cast("array<string>"), ",").alias("month_of_year_counts"),
    )


@query(
    "A8",
    f"""with {_STATS} select partition_key, count(distinct tile_id) as n_tiles, sum(row_count)::bigint as n_rows,
      round(min(value_min), 2) as value_min, round(max(value_max), 2) as value_max, round(avg(value_mean), 2) as value_mean
      from stats group by 1""",
    ("obs",),
)
def month_summary(spark, sf):
    return catalog.partition_summary(catalog.partition_statistics(_obs(spark, sf), ["year"]))


@query(
    "A9",
    f"""select count(*) as n_rows, count(distinct tile_id) as n_tiles, min(year) as year_min, max(year) as year_max,
      min(month_of_year) as month_of_year_min, max(month_of_year) as month_of_year_max, round(min(hour_of_day), 2) as hour_of_day_min,
      round(max(hour_of_day), 2) as hour_of_day_max, round(avg({_T}), 3) as temperature_mean, round(stddev_samp({_T}), 3) as temperature_std,
      round(min({_T}), 3) as temperature_min, round(max({_T}), 3) as temperature_max, count(aster_lst) as n_aster, count(modis_lst) as n_modis,
      round(count(ndvi) / count(*)::double, 4) as ndvi_coverage_frac from obs""",
    ("obs",),
)
def dataset_profile(spark, sf):
    return catalog.dataset_profile(_obs(spark, sf))


_PROFILED = ["conv_id", "turn", "role"]


@query(
    "A10",
    " union all ".join(
        f"""select '{c}' as "column", count(*) as n_rows, count({c}) as n_filled, min(cast({c} as varchar)) as value_min,
        max(cast({c} as varchar)) as value_max from conversations""" for c in _PROFILED
    ),
)
def column_profile(spark, sf):
    return catalog.column_profile(derived.table(spark, sf, "conversations"), _PROFILED).drop(
        "n_distinct_approx"
    )


@query("A10", "select distinct c_mktsegment from customer where c_mktsegment is not null order by 1 limit 100")
def value_sample(spark, sf):
    return catalog.value_sample(derived.table(spark, sf, "customer"), "c_mktsegment")


@query("A12", "select lang, source, count(*) as n from documents group by 1, 2")
def value_counts(spark, sf):
    return catalog.value_counts(derived.table(spark, sf, "documents"), ["lang", "source"])


@query(
    "A13",
    f"""select count(*) as n, count(*) - count({_T}) as n_missing, round(avg({_T}), 6) as mean, median({_T}) as median,
      round(stddev_samp({_T}), 6) as std, min({_T}) as min, max({_T}) as max, quantile_cont({_T}, 0.25) as q25,
      quantile_cont({_T}, 0.75) as q75 from obs""",
    ("obs",),
)
def preprocessing_stats(spark, sf):
    from skyloom.operators.transforms import column_stats

    return column_stats(_obs(spark, sf), "temperature")


@query(
    "A14",
    """select event_type, cast(least(9, floor(value / 5e0)) as int) as bin, count(*) as n from events
       where value >= 0 and value <= 50 group by 1, 2""",
)
def equal_width_histogram(spark, sf):
    return catalog.equal_width_histogram(
        derived.table(spark, sf, "events"), "value", [5.0 * i for i in range(11)], ["event_type"]
    )


@query(
    "J10 W5",
    """with s as (select tile_id, round(avg(ndvi), 6) as ndvi_struct_mean, round(stddev_samp(ndvi), 6) as ndvi_struct_std
        from obs where ndvi is not null group by 1)
      select l_orderkey, l_linenumber, loc_id, image_id, ndvi_struct_mean, ndvi_struct_std from obs left join s using (tile_id)""",
    ("obs",),
)
def structural_ndvi(spark, sf):
    return catalog.tile_mean_and_spread(derived.obs(spark, sf)).select(
        "l_orderkey", "l_linenumber", "loc_id", "image_id",
        r(F.col("ndvi_struct_mean")).alias("ndvi_struct_mean"),
        r(F.col("ndvi_struct_std")).alias("ndvi_struct_std"),
    )


@query(
    "T13",
    """select 'year' as dimension, year as value, count(*) as n from obs group by 2
       union all select 'month', month_of_year, count(*) from obs group by 2
       union all select 'hour', cast(floor(hour_of_day) as int), count(*) from obs group by 2""",
    ("obs",),
)
def distribution_report(spark, sf):
    return catalog.distribution_report(derived.obs(spark, sf))


# --- sampling ------------------------------------------------------------------------

_TARGETS = {"month_of_year": {}, "temperature": {20: 0.3, 25: 0.4, 31: 0.3}}


def _month_histograms(spark, sf, names):
    stats = materialise(catalog.partition_statistics(_obs(spark, sf), names), "catalog")
    out = None
    for n in names:
        part = catalog.sum_arrays(stats, ["partition_key"], f"{n}_counts")
        out = part if out is None else out.join(part, "partition_key")
    return out


def _score_sql(name: str, target: dict) -> str:
    shares = sampling.target_vector(name, target)
    values = ", ".join(f"({i}, {dbl(v)})" for i, v in enumerate(shares))
    return f"""{name}_s as (select h.partition_key, sum(least(h.n / t.total::double, v.w)) as s
      from ({_hist_sql(name, 'partition_key')}) h
      join (select partition_key, sum(n) as total from ({_hist_sql(name, 'partition_key')}) group by 1) t using (partition_key)
      join (values {values}) v(i, w) on v.i = h.bin group by 1)"""


_WEIGHTS_SQL = (
    "with " + ", ".join(_score_sql(n, t) for n, t in _TARGETS.items())
    + ", weights as (select partition_key, a.s * b.s as weight from month_of_year_s a join temperature_s b using (partition_key) where a.s * b.s > 0)"
)


@query("T1 T3 T4", _WEIGHTS_SQL + " select partition_key, round(weight, 9) as weight from weights", ("obs",))
def month_weights(spark, sf):
    histograms = _month_histograms(spark, sf, list(_TARGETS))
    return sampling.score_partitions(histograms, _TARGETS).withColumn("weight", r(F.col("weight"), 9))


_QUOTA_SQL = """ranked as (select *, floor(weight / sum(weight) over () * {rows})::bigint as base,
    row_number() over (order by weight desc, partition_key) as place, count(*) over () as k from weights),
  quota as (select partition_key, base + floor(({rows} - sum(base) over ()) / k)::bigint
    + case when place <= ({rows} - sum(base) over ()) % k then 1 else 0 end as quota from ranked)"""


@query(
    "T5",
    """with weights as (select partition_key, count(*)::double as weight from obs group by 1), """
    + _QUOTA_SQL.format(rows=1000)
    + " select partition_key, quota::bigint as quota from quota where quota > 0",
    ("obs",),
)
def month_quotas(spark, sf):
    weights = derived.obs(spark, sf).groupBy("partition_key").agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    )
    return sampling.quotas(weights, 1000).drop("weight")


@query(
    "T5 T7",
    """with weights as (select partition_key, count(*)::double as weight from obs group by 1), """
    + _QUOTA_SQL.format(rows=1000)
    + f""" select l_orderkey, l_linenumber, loc_id, image_id, partition_key from (select o.*, q.quota, row_number() over (
        partition by o.partition_key order by {ORDER_SQL}, {', '.join(OBS_TIES)}) as k from obs o join quota q using (partition_key)) where k <= quota""",
    ("obs",),
)
def quota_sample(spark, sf):
    obs = derived.obs(spark, sf)
    weights = obs.groupBy("partition_key").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    out = sampling.sample_by_quota(
        obs, sampling.quotas(weights, 1000), F.expr(ORDER_SQL), ORDER_RANGE, OBS_TIES
    )
    return out.select("l_orderkey", "l_linenumber", "loc_id", "image_id", "partition_key")


@query(
    "T6 F3 S15",
    f"""select l_orderkey, l_linenumber, loc_id, image_id, partition_key from obs
      order by partition_key, {ORDER_SQL}, {', '.join(OBS_TIES)} limit 2500""",
    ("obs",),
)
def sequential_sample(spark, sf):
    out = sampling.sequential_cap(
        derived.obs(spark, sf), 2500, F.expr(ORDER_SQL), ORDER_RANGE, OBS_TIES
    )
    return out.select("l_orderkey", "l_linenumber", "loc_id", "image_id", "partition_key")


_PERIODS_SQL = """periods as (select distinct concat(o_orderstatus, '_', cast(year(o_orderdate) as varchar)) as label, o_orderstatus as s, year(o_orderdate) as y from orders),
  spans as (select label, make_date(y::bigint, case s when 'F' then 6 when 'O' then 1 else 12 end, 1) as a,
    case s when 'F' then make_date(y::bigint, 9, 1) when 'O' then make_date(y::bigint, 2, 1) else make_date(y::bigint + 1, 2, 1) end as b from periods),
  months as (select label, strftime(unnest(generate_series(a, b - interval 1 month, interval 1 month)), '%Y-%m') as partition_key from spans)"""


def _periods(spark, sf):
    return derived.table(spark, sf, "orders").selectExpr("o_orderstatus as s", "year(o_orderdate) as y").distinct().selectExpr(
        "concat(s, '_', cast(y as string)) as label",
        "make_date(y, case s when 'F' then 6 when 'O' then 1 else 12 end, 1) as start",
        "case s when 'F' then make_date(y, 9, 1) when 'O' then make_date(y, 2, 1) else make_date(y + 1, 2, 1) end as end",
    )


@query("T8", f"with {_PERIODS_SQL} select * from months")
def period_months(spark, sf):
    return sampling.expand_months(_periods(spark, sf))


@query("U3", f"with {_PERIODS_SQL} select distinct partition_key from months")
def excluded_months(spark, sf):
    return sampling.excluded_months(sampling.expand_months(_periods(spark, sf)))


@query(
    "U2 T7",
    f"with {_PERIODS_SQL} select distinct partition_key from obs where partition_key not in (select partition_key from months)",
    ("obs",),
)
def training_months(spark, sf):
    keys = derived.obs(spark, sf).select("partition_key").distinct()
    return sampling.months_outside(keys, sampling.expand_months(_periods(spark, sf)))


@query(
    "T7",
    f"with {_PERIODS_SQL}, " + ", ".join(_score_sql(n, {}) for n in ("year", "month_of_year", "hour_of_day"))
    + """, weights as (select partition_key, a.s * b.s * c.s as weight from year_s a join month_of_year_s b using (partition_key)
        join hour_of_day_s c using (partition_key) where a.s * b.s * c.s > 0 and partition_key not in (select partition_key from months)), """
    + _QUOTA_SQL.format(rows=1000)
    + " select partition_key, round(weight, 9) as weight, quota from ranked join quota using (partition_key) where quota > 0",
    ("obs",),
)
def representative_quotas(spark, sf):
    """Uniform year, month and hour over the months outside the periods."""
    histograms = _month_histograms(spark, sf, ["year", "month_of_year", "hour_of_day"])
    excluded = sampling.expand_months(_periods(spark, sf))
    return sampling.representative_plan(histograms, excluded, 1000).withColumn("weight", r(F.col("weight"), 9))


_NEAR = """longitude between 3.72e0 - 0.1e0 and 3.72e0 + 0.1e0 and latitude between 51.05e0 - 0.1e0 and 51.05e0 + 0.1e0
       and year = 1997 and month_of_year = 6"""


@query("F2", f"select l_orderkey, l_linenumber, loc_id, image_id from obs where {_NEAR} and hour_of_day between 9.5e0 and 15.5e0 - 5e0", ("obs",))
def point_time_slice(spark, sf):
    out = sampling.point_time_filter(
        derived.obs(spark, sf), 3.72, 51.05, 1997, 6, hour=10.0, tol_deg=0.1
    )
    return out.select("l_orderkey", "l_linenumber", "loc_id", "image_id")


@query(
    "F3",
    f"select l_orderkey, l_linenumber, loc_id, image_id from obs where {_NEAR} order by {', '.join(OBS_TIES)} limit 25",
    ("obs",),
)
def point_time_rows(spark, sf):
    """The first 25 rows of a slice: the cap comes after the filter."""
    out = sampling.point_time_filter(
        derived.obs(spark, sf), 3.72, 51.05, 1997, 6, tol_deg=0.1, max_rows=25, ties=OBS_TIES
    )
    return out.select("l_orderkey", "l_linenumber", "loc_id", "image_id")


@query(
    "F9",
    """select 'hour_midday' as label, count(*) as n from obs where hour_of_day between 10 and 11
       union all select 'hour_midnight', count(*) from obs where hour_of_day between 22 and 23
       union all select 'single_day', count(*) from obs where partition_key = '1997-06' and day_of_month = 15
       union all select 'single_year', count(*) from obs where year = 1997""",
    ("obs",),
)
def named_slices(spark, sf):
    from skyloom.plans.slices import hour_slice, slice_counts

    conditions = {
        "hour_midday": hour_slice(10.5), "hour_midnight": hour_slice(22.5),
        "single_day": (F.col("partition_key") == "1997-06") & (F.col("day_of_month") == 15),
        "single_year": F.col("year") == 1997,
    }
    return slice_counts(derived.obs(spark, sf), conditions)


@query(
    "T2",
    """with top as (select tile_id, ts from obs group by 1, 2 order by count(*) desc, 1, 2 limit 1)
       select l_orderkey, l_linenumber, loc_id, image_id, o.tile_id from obs o join top using (tile_id, ts)""",
    ("obs",),
)
def dominant_scene(spark, sf):
    out = sampling.dominant_group(derived.obs(spark, sf), ["tile_id", "ts"])
    return out.select("l_orderkey", "l_linenumber", "loc_id", "image_id", "tile_id")


@query(
    "T10 J16",
    """with t as (select tile_id, count(*) as n, (split_part(tile_id, '_', 1)::int * 7919 + split_part(tile_id, '_', 2)::int * 104729) % 1009 as o from obs group by 1),
       c as (select tile_id, sum(n) over (order by o, tile_id rows between unbounded preceding and 1 preceding) as before from t)
       select tile_id, count(*) as n from obs join c using (tile_id) where coalesce(before, 0) < 2000 group by 1""",
    ("obs",),
)
def whole_tile_cap(spark, sf):
    obs = derived.obs(spark, sf)
    order = F.expr("(cast(split(tile_id, '_')[0] as int) * 7919 + cast(split(tile_id, '_')[1] as int) * 104729) % 1009")
    return sampling.whole_group_cap(obs, "tile_id", 2000, order).groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "T11",
    """select supplier, round(rmse, 6) as rmse, round(r2, 6) as r2, place from (
        select l_suppkey as supplier, sqrt(avg(l_discount * l_discount)) as rmse, avg(l_tax) as r2,
          row_number() over (order by round(sqrt(avg(l_discount * l_discount)), 9), round(avg(l_tax), 9) desc, l_suppkey) as place
        from lineitem group by 1) where place <= 20""",
)
def leaderboard(spark, sf):
    from skyloom.operators.models import leaderboard as board

    scores = derived.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(
        r(F.sqrt(F.avg(F.col("l_discount") * F.col("l_discount"))), 9).alias("rmse"),
        r(F.avg("l_tax"), 9).alias("r2"),
    )
    return board(scores, 20, ["supplier"]).select(
        "supplier", r(F.col("rmse")).alias("rmse"), r(F.col("r2")).alias("r2"), "place"
    )


@query(
    "T12",
    """with c as (select quantile_disc(year, 0.8) as cut from obs)
       select case when year <= cut then 'train' else 'test' end as part, count(*) as n, min(year) as first_year, max(year) as last_year
       from obs, c group by 1""",
    ("obs",),
)
def time_split(spark, sf):
    train, test = sampling.time_split(derived.obs(spark, sf), "year", 0.8)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return both.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


@query(
    "T12",
    """select cast(event_id * 7919 % 5 as int) as fold, count(*) as n, round(sum(value), 2) as total from events group by 1""",
)
def hash_folds(spark, sf):
    fold = sampling.fold_of(F.col("event_id") * 7919, 5)
    return derived.table(spark, sf, "events").groupBy(fold.alias("fold")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total")
    )


@query(
    "A13 X8",
    "select round(quantile_cont(value, 0.01), 9) as q01, round(quantile_cont(value, 0.5), 9) as q50, round(quantile_cont(value, 0.99), 9) as q99 from events",
)
def distributed_quantiles(spark, sf):
    q = exact_quantiles(materialise(derived.table(spark, sf, "events").select("value")), "value", [0.01, 0.5, 0.99])
    return spark.range(1).select(*[r(F.lit(v), 9).alias(n) for n, v in zip(("q01", "q50", "q99"), q)])
