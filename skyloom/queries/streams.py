"""Streaming jobs over the event and observation tables, run to their present end."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.plans.features import RadiusFeature, Registry, Sides, place_features
from skyloom.queries.base import OBS_TIES, ORDER_RANGE, ORDER_SQL, query, r
from skyloom.session import materialise, new_table_path
from skyloom.sources import derived
from skyloom.streaming import jobs, online

_PART = "case when event_id % 5 < 2 then 0 when event_id % 5 < 4 then 1 else 2 end"


def _as_events_arrive(spark, sf, partial, path: str, prepare=lambda stream: stream) -> None:
    """Run a job over the events in three arrivals, each written by as many tasks as the table has and taken as one batch."""
    folder = new_table_path(spark, "arrivals")
    events = derived.table(spark, sf, "events").withColumn("part", F.expr(_PART))
    for i in range(3):
        events.where(F.col("part") == i).drop("part").write.mode("append").parquet(folder)
        jobs.run_partials(prepare(jobs.file_stream(spark, folder, None)), partial, path)


def _obs_files(spark, sf) -> str:
    """The observations as files, four at least and otherwise one for every split, so that none grows with the table."""
    path = new_table_path(spark, "obs")
    obs = derived.obs(spark, sf)
    if obs.rdd.getNumPartitions() < 4:
        obs = obs.repartition(4, "l_orderkey", "l_linenumber")
    obs.write.parquet(path)
    return path


def _obs_stream(spark, sf):
    """A stream over those files in two batches, however many there are."""
    path = _obs_files(spark, sf)
    files = len(spark.read.parquet(path).inputFiles())
    return jobs.file_stream(spark, path, -(-files // 2))


@query(
    "Q1",
    """with places as (select distinct longitude, latitude from obs),
      n as (select p.longitude, p.latitude, count(*) as n from places p join trees t on
        sqrt(((t.latitude - p.latitude) * 111320e0) ** 2 + ((t.longitude - p.longitude) * 111320e0 * cos(radians(p.latitude))) ** 2) <= 300
        and abs(t.latitude - p.latitude) < 0.004 and abs(t.longitude - p.longitude) < 0.006 group by 1, 2)
      select partition_key, count(*) as n_rows, sum(coalesce(n, 0))::bigint as trees from obs left join n using (longitude, latitude) group by 1""",
    ("obs", "trees"),
)
def stream_with_features(spark, sf):
    reg = Registry([RadiusFeature("trees", 300)])
    sides = Sides(points={"trees": derived.trees(spark, sf)})
    features = materialise(place_features(derived.obs(spark, sf), reg, sides), "features")
    path = new_table_path(spark, "stream")
    jobs.attach_features(_obs_stream(spark, sf), features, path)
    out = spark.read.parquet(f"{path}/rows")
    return out.groupBy("partition_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("trees_count300m_count").alias("trees")
    )


@query(
    "Q2",
    """select 'value' as "column", count(value) as n, round(avg(value), 6) as mean, round(var_pop(value), 4) as var, min(value) as min, max(value) as max from events""",
)
def stream_scaler(spark, sf):
    path = new_table_path(spark, "scaler")
    _as_events_arrive(spark, sf, jobs.scaler_partial(["value"]), path)
    out = jobs.merged_scaler(jobs.partials(spark, path))
    return out.withColumns({"mean": r(F.col("mean")), "var": r(F.col("var"), 4)})


@query(
    "Q3",
    f"""with m as (select {_PART} as part, median(value) as m from events group by 1)
      select 'value' as "column", round(max(case when part = 0 then m end) * 0.81e0 + max(case when part = 1 then m end) * 0.09e0 + max(case when part = 2 then m end) * 0.1e0, 6) as median from m""",
)
def stream_medians(spark, sf):
    path = new_table_path(spark, "medians")
    _as_events_arrive(spark, sf, jobs.median_partial(["value"]), path)
    return jobs.smoothed_medians(jobs.partials(spark, path)).withColumn("median", r(F.col("median")))


@query(
    "Q4",
    f"""with e as (select {_PART} as part, value as y, event_id % 100 as p from events)
      select cast(part as int) as batch, count(*) as n_rows, round(sqrt(avg((p - y) ** 2)), 6) as rmse, round(avg(abs(p - y)), 6) as mae,
        round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) as r2 from e group by 1
      union all select -1, count(*), round(sqrt(avg((p - y) ** 2)), 6), round(avg(abs(p - y)), 6), round(1 - sum((p - y) ** 2) / (var_pop(y) * count(*)), 6) from e""",
)
def stream_metrics(spark, sf):
    path = new_table_path(spark, "metrics")
    _as_events_arrive(spark, sf, jobs.metric_partial("p", "value"), path, lambda s: s.withColumn("p", F.col("event_id") % 100))
    rows = jobs.partials(spark, path)
    total = jobs.running_metrics(rows).select(F.lit(-1).alias("batch"), "*")
    out = jobs.metric_history(rows).withColumn("batch", F.col("batch").cast("int")).unionByName(total)
    return out.withColumns({c: r(F.col(c)) for c in ("rmse", "mae", "r2")})


@query(
    "Q5 T9",
    f"""select l_orderkey, l_linenumber, loc_id, image_id from obs order by {ORDER_SQL}, {', '.join(OBS_TIES)} limit 500""",
    ("obs",),
)
def stream_reservoir(spark, sf):
    path = new_table_path(spark, "reservoir")
    order = F.expr(ORDER_SQL)
    jobs.run_partials(
        _obs_stream(spark, sf),
        jobs.reservoir_partial(order, ORDER_RANGE, OBS_TIES, 500), path,
    )
    out = jobs.reservoir(jobs.partials(spark, path), order, ORDER_RANGE, OBS_TIES, 500)
    return out.select("l_orderkey", "l_linenumber", "loc_id", "image_id")


@query(
    "Q6",
    """select partition_key, tile_id, month_of_year - 1 as bin, count(*) as n from obs group by 1, 2, 3""",
    ("obs",),
)
def stream_histograms(spark, sf):
    path = new_table_path(spark, "histograms")
    groups = ["partition_key", "tile_id"]
    counts = jobs.histogram_counts(_obs_stream(spark, sf), "month_of_year", groups)
    jobs.run_partials(counts, lambda batch, _: batch, path, mode="update")
    return jobs.latest_counts(jobs.partials(spark, path), groups)


@query(
    "Q7 A16",
    """select count(*) as n, round(sum(l_quantity * l_quantity), 6) as qq, round(sum(l_quantity * l_tax), 6) as qt, round(sum(l_tax * l_tax), 6) as tt from obs""",
    ("obs",),
)
def stream_products(spark, sf):
    path = new_table_path(spark, "products")
    columns = ["l_quantity", "l_tax"]
    jobs.run_partials(_obs_stream(spark, sf), jobs.gram_partial(columns), path)
    g = jobs.merged_gram(jobs.partials(spark, path), columns)
    m = g.matrix
    return spark.range(1).select(
        F.lit(g.n).cast("long").alias("n"),
        *[r(F.lit(float(v)), 6).alias(n) for n, v in (("qq", m[0, 0]), ("qt", m[0, 1]), ("tt", m[1, 1]))],
    )


_BY_PARTS = f"e as (select {_PART} as part, value as y, event_id % 100 as x from events where value is not null)"


@query(
    "M20 Q4",
    f"""with {_BY_PARTS}, m as (select p.part, regr_slope(y, x) as b, regr_intercept(y, x) as a from e join (select unnest([1, 2]) as part) p on e.part < p.part group by 1),
      f as (select e.part, a + b * x - y as d from e join m using (part)),
      h as (select part, count(*) as n, sum(d * d) as sse, sum(abs(d)) as sae, sum(d) as sd from f group by 1)
      select h.part::int as batch, h.n, round(sqrt(sse / h.n), 6) as rmse, round(sae / h.n, 6) as mae, round(sd / h.n, 6) as bias,
        round(sqrt((select sum(sse) / sum(n) from h g where g.part <= h.part)), 6) as running_rmse, round((select sum(sae) / sum(n) from h g where g.part <= h.part), 6) as running_mae from h""",
)
def stream_linear_model(spark, sf):
    """A linear model learned as events arrive, scored on every batch before it learns from it."""
    path = new_table_path(spark, "online")
    _as_events_arrive(spark, sf, online.online_partial(["x"], "value", path), path, lambda s: s.withColumn("x", F.col("event_id") % 100))
    out = online.error_history(jobs.partials(spark, path)).where("n > 0").withColumn("batch", F.col("batch").cast("int"))
    return out.withColumns({c: r(F.col(c)) for c in ("rmse", "mae", "bias", "running_rmse", "running_mae")})
