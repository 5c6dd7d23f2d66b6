"""Transforms, statistics, panel models and regression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions import derive, geo
from skyloom.operators import association, attribution, gram, information, models, panel, spatial_models, stability, trees
from skyloom.operators import transforms as tf
from skyloom.operators.autocorrelation import morans_i
from skyloom.operators.coverage import Grid
from skyloom.operators.scale import take_lowest, value_ranks
from skyloom.plans.features import (
    ClassFraction, CustomFeature, FrameFeature, NearestFeature, RadiusFeature, Registry, Sides,
    SurfaceFraction, attach,
)
from skyloom.plans.registry import build_registry
from skyloom.queries.base import OBS_TIES, ORDER_RANGE, ORDER_SQL, query, r
from skyloom.queries.ingest import _hex_sql
from skyloom.queries.projected_sql import LAEA, LAMBERT, rect_sql
from skyloom.queries.spatial import GRID, _timed
from skyloom.session import materialise, new_table_path
from skyloom.sources import derived

IDS = ["l_orderkey", "l_linenumber", "loc_id", "image_id"]
ID_SQL = ", ".join(IDS)
_T = "coalesce(aster_lst, modis_lst, ndvi)"
FEATURES = ["dhm_avg50m_elevation", "trees_count50m", "ua_vegetation_50m_frac", "ua_dense_50m_frac", "wis_kws_50m_frac"]
_FEATURE_SQL = {
    "dhm_avg50m_elevation": "case when loc_id % 7 <> 0 then l_tax * 100e0 + l_quantity / 10e0 end",
    "trees_count50m": "case when loc_id % 5 <> 0 then floor(l_extendedprice / 5000e0) end",
    "ua_vegetation_50m_frac": "l_discount * 10e0",
    "ua_dense_50m_frac": "1e0 - l_discount * 5e0 - l_tax",
    "wis_kws_50m_frac": "case when l_linenumber <> 4 then l_tax * 10e0 end",
}
FRAME = (
    "frame as (select *, " + _T + " as temperature, "
    + ", ".join(f"{v} as {k}" for k, v in _FEATURE_SQL.items()) + " from obs)"
)


def frame(spark, sf):
    """Observations with a temperature and one feature per source group."""
    obs = derived.obs(spark, sf)
    return obs.select(
        "*", F.expr(_T).alias("temperature"), *[F.expr(v).cast("double").alias(k) for k, v in _FEATURE_SQL.items()]
    )


# --- transforms ------------------------------------------------------------------------


@query(
    "X1 X2 X3 X4 X5 X6 X10 X11 D4",
    f"""with {FRAME} select {ID_SQL}, round(l_quantity * l_quantity, 6) as "l_quantity²",
      round(sin(2 * pi() * hour_of_day / 24), 9) as hour_of_day_sin, round(cos(2 * pi() * hour_of_day / 24), 9) as hour_of_day_cos,
      round(l_quantity * l_discount, 9) as "l_quantity×l_discount", round(l_quantity - l_tax, 9) as "l_quantity−l_tax",
      round(l_quantity / (l_tax + 1e-6), 4) as "l_quantity÷l_tax", l_discount, l_tax, round(l_discount * l_discount, 9) as "l_discount^2",
      round(l_discount * l_tax, 9) as "l_discount l_tax", round(l_tax * l_tax, 9) as "l_tax^2",
      round(ln(1 + greatest(l_extendedprice, 0)), 9) as "l_extendedprice㏒", round(sqrt(greatest(l_extendedprice, 0)), 9) as "l_extendedprice√"
      from frame""",
    ("obs",),
)
def feature_transforms(spark, sf):
    steps = [
        tf.func(["l_quantity"], lambda v: v * v, "²"), tf.cyclical("hour_of_day", 24),
        tf.interaction([("l_quantity", "l_discount")]), tf.delta("l_quantity", "l_tax"),
        tf.ratio("l_quantity", "l_tax"), tf.polynomial(["l_discount", "l_tax"], 2),
        tf.log1p(["l_extendedprice"]), tf.sqrt(["l_extendedprice"]),
    ]
    base = derived.obs(spark, sf).select(*IDS, "hour_of_day", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    keep = base.withColumns({"d": F.col("l_discount"), "t": F.col("l_tax")})
    out = tf.apply_transforms(keep, steps)
    digits = {"l_quantity²": 6, "l_quantity÷l_tax": 4}
    fresh = [c for c in out.columns if c not in [*IDS, "d", "t"]]
    return out.select(
        *IDS, F.col("d").alias("l_discount"), F.col("t").alias("l_tax"),
        *[r(F.col(f"`{c}`"), digits.get(c, 9)).alias(c) for c in fresh],
    )


@query(
    "X7 X11",
    f"""select {ID_SQL}, round(l_tax * l_tax, 9) as "l_tax²" from obs""",
    ("obs",),
)
def pipeline_drops_inputs(spark, sf):
    """A dropped intermediate, a removed raw column and a step skipped for the model."""
    steps = [
        tf.func(["l_quantity"], lambda v: v + 1, "'"), tf.remove("l_quantity'"), tf.remove("l_discount"),
        tf.func(["l_tax"], lambda v: v * v, "²"),
        tf.func(["l_extendedprice"], lambda v: v, "!", skip_models={"forest"}), tf.remove("l_extendedprice"),
    ]
    base = derived.obs(spark, sf).select(*IDS, "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return tf.apply_transforms(base, steps, model="forest").withColumn("l_tax²", r(F.col("`l_tax²`"), 9))


@query(
    "X8",
    f"""with q as (select quantile_cont(l_extendedprice, 0.05) as lo, quantile_cont(l_extendedprice, 0.95) as hi from obs)
       select {ID_SQL}, round(greatest(lo, least(hi, l_extendedprice)), 6) as clipped from obs, q""",
    ("obs",),
)
def clipped_outliers(spark, sf):
    base = derived.obs(spark, sf).select(*IDS, "l_extendedprice")
    out = tf.apply_transforms(base, [tf.clip_outliers(["l_extendedprice"], 5, 95)])
    return out.select(*IDS, r(F.col("`l_extendedprice⌈⌋`")).alias("clipped"))


@query(
    "X9",
    f"""with s as (select avg(l_extendedprice) as m, stddev_samp(l_extendedprice) as sd from obs)
       select {ID_SQL}, round((l_extendedprice - m) / (sd + 1e-9), 7) as z from obs, s""",
    ("obs",),
)
def global_zscore(spark, sf):
    base = derived.obs(spark, sf).select(*IDS, "l_extendedprice")
    out = tf.apply_transforms(base, [tf.zscore(["l_extendedprice"])])
    return out.select(*IDS, r(F.col("l_extendedpricez"), 7).alias("z"))


@query(
    "W6 X9",
    """select event_id, round((value - avg(value) over w) / (coalesce(stddev_samp(value) over w, 0) + 1e-9), 5) as z
       from events window w as (order by event_id rows between unbounded preceding and current row)""",
)
def running_zscore(spark, sf):
    events = materialise(derived.table(spark, sf, "events").select("event_id", "value"))
    return tf.running_zscore(events, "value", "event_id").select("event_id", r(F.col("valuez"), 5).alias("z"))


@query(
    "X12",
    """select unnest(['l_orderkey', 'l_linenumber', 'loc_id', 'year', 'month_of_year', 'day_of_month', 'day_of_year', 'hour_of_day',
       'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as feature, (select count(*) from obs) as n_rows""",
    ("obs",),
)
def auto_features(spark, sf):
    obs = derived.obs(spark, sf).withColumn("image_id", F.col("image_id").cast("string"))
    names = tf.feature_columns(obs)
    return obs.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"), "n_rows"
    )


@query(
    "F12",
    """select count(*) as n_rows, 'l_quantity,l_tax' as kept from obs""",
    ("obs",),
)
def constant_columns_dropped(spark, sf):
    base = derived.obs(spark, sf).select("l_quantity", "l_tax").withColumns(
        {"same": F.lit(3.0), "empty": F.lit(None).cast("double")}
    )
    out = tf.drop_empty_or_constant(base, base.columns)
    return out.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("kept", F.lit(",".join(out.columns)))


@query(
    "F11",
    f"with {FRAME} select {ID_SQL} from frame where temperature is not null and dhm_avg50m_elevation is not null and trees_count50m is not null and wis_kws_50m_frac is not null",
    ("obs",),
)
def complete_cases(spark, sf):
    return tf.complete_cases(frame(spark, sf), [*FEATURES, "temperature"], ["tile_id"]).select(*IDS)


@query(
    "X13",
    f"with {FRAME}, m as (select median(ndvi) as m, median(modis_lst) as k from obs) select {ID_SQL}, coalesce(ndvi, m) as ndvi, coalesce(modis_lst, k) as modis_lst from obs, m",
    ("obs",),
)
def median_imputed(spark, sf):
    base = derived.obs(spark, sf).select(*IDS, "ndvi", "modis_lst")
    return tf.impute(base, tf.medians(base, ["ndvi", "modis_lst"]))


@query(
    "X14",
    f"""with s as (select avg(l_quantity) as m, stddev_pop(l_quantity) as sd, min(l_tax) as lo, max(l_tax) as hi, max(abs(l_discount)) as top from obs)
      select {ID_SQL}, round((l_quantity - m) / sd, 7) as l_quantity, round((l_tax - lo) / (hi - lo), 7) as l_tax,
        round(l_discount / top, 7) as l_discount, l_extendedprice from obs, s""",
    ("obs",),
)
def scaled_features(spark, sf):
    base = derived.obs(spark, sf).select(*IDS, "l_quantity", "l_tax", "l_discount", "l_extendedprice")
    scaler = tf.fit_scaler(
        base, ["l_quantity", "l_tax", "l_discount", "l_extendedprice"],
        overrides={"l_tax": "minmax", "l_discount": "maxabs", "l_extendedprice": "none"},
    )
    out = scaler.transform(base)
    return out.withColumns({c: r(F.col(c), 7) for c in ("l_quantity", "l_tax", "l_discount")})


@query(
    "X14",
    f"select {ID_SQL}, l_quantity, l_tax from obs",
    ("obs",),
)
def scaled_and_back(spark, sf):
    base = derived.obs(spark, sf).select(*IDS, "l_quantity", "l_tax")
    scaler = tf.fit_scaler(base, ["l_quantity", "l_tax"], "minmax")
    back = scaler.inverse(scaler.transform(base))
    return back.withColumns({c: r(F.col(c), 9) for c in ("l_quantity", "l_tax")})


@query(
    "X15",
    """select concat('ua_', lower(p_type), '_', radius, 'm_frac') as feature, 'minmax' as scaler
       from (select distinct p_type from part), (values ('50'), ('100')) v(radius)""",
)
def scaler_hints(spark, sf):
    types = sorted(row[0] for row in derived.table(spark, sf, "part").select("p_type").distinct().collect())
    reg = Registry([ClassFraction(x, tuple((t.lower(), (t,)) for t in types)) for x in (50, 100)])
    reg.add(RadiusFeature("trees", 50))
    return spark.createDataFrame(list(reg.scaler_hints().items()), "feature string, scaler string")


@query(
    "X16",
    """select 'l_quantity' as "column", 'standard' as scaler, count(l_quantity)::double as n, round(avg(l_quantity), 6) as mean,
         round(var_pop(l_quantity), 5) as var, min(l_quantity) as min, max(l_quantity) as max from obs
       union all select 'l_tax', 'minmax', count(l_tax)::double, round(avg(l_tax), 6), round(var_pop(l_tax), 5), min(l_tax), max(l_tax) from obs""",
    ("obs",),
)
def scaler_summary(spark, sf):
    base = derived.obs(spark, sf)
    out = tf.fit_scaler(base, ["l_quantity", "l_tax"], overrides={"l_tax": "minmax"}).summary(spark)
    return out.drop("offset", "scale").withColumns({"mean": r(F.col("mean")), "var": r(F.col("var"), 5)})


@query(
    "X17",
    """select 'feature_too_large' as "check", 'l_extendedprice' as "column", max(l_extendedprice) as value, 'error' as level from obs
       union all select 'feature_non_finite', 'ndvi', count(*) filter (where ndvi is null), 'error' from obs
       union all select 'zero_variance', 'same', min(0), 'warn' from obs
       union all select 'target_too_large', 'big', max(l_extendedprice) * 10, 'error' from obs""",
    ("obs",),
)
def quality_findings(spark, sf):
    base = derived.obs(spark, sf).withColumns(
        {"same": F.lit(1.0), "big": F.col("l_extendedprice") * 10}
    )
    return tf.check_inputs(base, ["l_quantity", "l_extendedprice", "ndvi", "same"], "big")


@query(
    "X17",
    """select 'prediction_too_large' as "check", 'l_extendedprice' as "column", round(max(l_extendedprice), 4) as value, 'error' as level from obs
       union all select 'bias_too_large', 'l_extendedprice', round(avg(l_extendedprice) - avg(l_quantity), 4), 'warn' from obs""",
    ("obs",),
)
def prediction_findings(spark, sf):
    out = tf.check_predictions(derived.obs(spark, sf), "l_extendedprice", "l_quantity")
    return out.withColumn("value", r(F.col("value"), 4))


# --- scalars -----------------------------------------------------------------------------


@query(
    "§2.9",
    "select event_id, substr(sha256(concat('[\"', event_type, '\", ', user_id, ']')), 1, 16) as fingerprint from events",
)
def row_fingerprints(spark, sf):
    """The fingerprint of a small configuration, for every row."""
    events = derived.table(spark, sf, "events")
    text = F.concat(F.lit('["'), F.col("event_type"), F.lit('", '), F.col("user_id").cast("string"), F.lit("]"))
    return events.select("event_id", derive.fingerprint_of(text).alias("fingerprint"))


@query(
    "§2.9",
    """select event_id, upper(event_type) as up, replace(concat(event_type, ' x/y'), ' ', '_') as safe, substr(cast(ts as varchar), 1, 7) as ym,
       year(ts) * 12 + month(ts) as scene_ym, cast(floor(epoch(ts)) as bigint) as epoch, cast(dayofyear(ts) as int) as doy,
       round(ln(1 + value), 9) as log1p, round(sqrt(value), 9) as root, round_even(value / 2, 0) as half_even,
       cast(regexp_extract(props, '[0-9]+', 0) as int) as k, coalesce(nullif(event_type, 'view'), 'none') as kind,
       case event_type when 'click' then 'act' when 'purchase' then 'act' when 'view' then 'see' end as class from events""",
)
def scalar_functions(spark, sf):
    lookup = F.create_map(*[F.lit(x) for x in ("click", "act", "purchase", "act", "view", "see")])
    return derived.table(spark, sf, "events").select(
        "event_id", F.upper("event_type").alias("up"),
        F.replace(F.concat("event_type", F.lit(" x/y")), F.lit(" "), F.lit("_")).alias("safe"),
        F.substring(F.col("ts").cast("string"), 1, 7).alias("ym"),
        derive.scene_month(F.year("ts"), F.month("ts")).cast("long").alias("scene_ym"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"), F.dayofyear("ts").alias("doy"),
        r(F.log1p("value"), 9).alias("log1p"), r(F.sqrt("value"), 9).alias("root"), F.rint(F.col("value") / 2).alias("half_even"),
        F.from_json("props", "k int")["k"].alias("k"),
        F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("none")).alias("kind"),
        F.try_element_at(lookup, F.col("event_type")).alias("class"),
    )


# --- association ---------------------------------------------------------------------------


def _ranked(x: str, y: str) -> str:
    def rank(c: str) -> str:
        return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2e0"

    return f"(select {rank(x)} as rx, {rank(y)} as ry from frame where {x} is not null and {y} is not null)"


@query(
    "M1",
    f"with {FRAME} " + " union all ".join(
        f"""select '{f}' as feature, '{derive.source_of(f)}' as source, count(*) as n_valid, round(corr({f}, temperature), 5) as pearson_r,
        (select round(corr(rx, ry), 5) from {_ranked(f, 'temperature')}) as spearman_r,
        round(corr({f}, temperature) * stddev_samp(temperature) / stddev_samp({f}), 5) as slope_per_unit,
        round(corr({f}, temperature) * stddev_samp(temperature), 5) as slope_per_std, round(avg({f}), 5) as feature_mean,
        round(stddev_samp({f}), 5) as feature_std, round(avg(temperature), 5) as target_mean, round(stddev_samp(temperature), 5) as target_std
        from frame where {f} is not null and temperature is not null"""
        for f in association.greening(FEATURES)
    ),
    ("obs",),
)
def simple_associations(spark, sf):
    out = association.simple_associations(
        materialise(frame(spark, sf).select("temperature", *FEATURES)), association.greening(FEATURES),
        "temperature", with_mi=False, digits=12,
    ).drop("pearson_p", "spearman_p", "mi")
    return out.withColumns({c: r(F.col(c), 5) for c in out.columns if c not in ("feature", "source", "n_valid")})


@query("M1 M3")
def simple_associations_with_mi(spark, sf):
    return association.simple_associations(
        materialise(frame(spark, sf).select("temperature", *FEATURES)), association.greening(FEATURES), "temperature"
    )


def _shared(x: str, y: str) -> str:
    """Mutual information over deciles of both columns."""
    return f"""(with f as (select {x} as x, {y} as y from frame where {x} is not null and {y} is not null),
      q as (select quantile_cont(x, {_MI_PROBS}) as qx, quantile_cont(y, {_MI_PROBS}) as qy from f),
      b as (select len(list_filter(qx, lambda e: e <= x)) as bx, len(list_filter(qy, lambda e: e <= y)) as by_ from f, q),
      j as (select bx, by_, count(*) as n from b group by 1, 2), t as (select sum(n) as total from j),
      mx as (select bx, sum(n) as nx from j group by 1), my as (select by_, sum(n) as ny from j group by 1)
      select round(sum(n / total::double * ln(n * total::double / (nx * ny))), 7) from j join mx using (bx) join my using (by_), t)"""


_MI_PROBS = [i / 10 for i in range(1, 10)]
_CROSS = [("dhm_avg50m_elevation", "trees_count50m"), ("dhm_avg50m_elevation", "wis_kws_50m_frac"), ("trees_count50m", "wis_kws_50m_frac")]


@query(
    "M2 W7",
    f"with {FRAME} " + " union all ".join(
        f"""select '{a}' as feature_a, '{derive.source_of(a)}' as source_a, '{b}' as feature_b, '{derive.source_of(b)}' as source_b,
        count(*) as n_valid, round(corr({a}, {b}), 5) as pearson_r, (select round(corr(rx, ry), 5) from {_ranked(a, b)}) as spearman_r, {_shared(a, b)} as mi
        from frame where {a} is not null and {b} is not null""" for a, b in _CROSS
    ),
    ("obs",),
)
def cross_correlations(spark, sf):
    chosen = ["dhm_avg50m_elevation", "trees_count50m", "wis_kws_50m_frac"]
    out = association.cross_correlations(materialise(frame(spark, sf).select(*chosen)), chosen)
    return out.select(
        "feature_a", "source_a", "feature_b", "source_b", "n_valid",
        r(F.col("pearson_r"), 5).alias("pearson_r"), r(F.col("spearman_r"), 5).alias("spearman_r"), r(F.col("mi"), 7).alias("mi"),
    )


@query(
    "W7",
    """select value, count(*) as n, min(k) + (count(*) - 1) / 2e0 as rank from (select value, rank() over (order by value) as k from events) group by 1""",
)
def average_ranks(spark, sf):
    return value_ranks(derived.table(spark, sf, "events"), "value").select("value", "n", "rank")


@query(
    "M3",
    f"""with {FRAME}, f as (select trees_count50m as x, temperature as y from frame where trees_count50m is not null and temperature is not null),
      q as (select quantile_cont(x, {_MI_PROBS}) as qx, quantile_cont(y, {_MI_PROBS}) as qy from f),
      b as (select len(list_filter(qx, lambda e: e <= x)) as bx, len(list_filter(qy, lambda e: e <= y)) as by_ from f, q),
      j as (select bx, by_, count(*) as n from b group by 1, 2), t as (select sum(n) as total from j),
      mx as (select bx, sum(n) as nx from j group by 1), my as (select by_, sum(n) as ny from j group by 1)
      select round(sum(n / total::double * ln(n * total::double / (nx * ny))), 9) as mi from j join mx using (bx) join my using (by_), t""",
    ("obs",),
)
def mutual_information(spark, sf):
    mi = association.mutual_information(frame(spark, sf), "trees_count50m", "temperature")
    return spark.range(1).select(r(F.lit(mi), 9).alias("mi"))


@query("M3")
def neighbour_information(spark, sf):
    """Mutual information of the temperature with two columns from nearest neighbours, over all rows."""
    rows = materialise(frame(spark, sf).select("temperature", "trees_count50m", "l_quantity"))
    found = [(f, information.neighbour_information(rows, f, "temperature")) for f in ("trees_count50m", "l_quantity")]
    return spark.createDataFrame(found, "feature string, mi double")


@query(
    "M4",
    f"""with {FRAME}, c as (select count(*) as n, corr(trees_count50m, temperature) as xy, corr(trees_count50m, hour_of_day) as xz,
      corr(temperature, hour_of_day) as yz from frame where trees_count50m is not null and temperature is not null)
      select 'trees_count50m' as feature, n as n_valid, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 7) as partial_r from c""",
    ("obs",),
)
def partial_correlation_one(spark, sf):
    rows = frame(spark, sf).withColumns({"z_one": F.lit(1.0), "z_hour": F.col("hour_of_day")})
    out = association.partial_correlations(rows, ["trees_count50m"], "temperature", ["z_one", "z_hour"])
    return out.select("feature", "n_valid", r(F.col("partial_r"), 7).alias("partial_r"))


@query("M4 M5 P10")
def partial_correlations(spark, sf):
    z = derive.confounders()
    rows = materialise(frame(spark, sf).withColumns(z))
    return association.partial_correlations(
        rows, association.greening(FEATURES), "temperature", list(z), association.morphology(FEATURES)
    )


@query(
    "A16",
    """select tile_id, count(*) as n, round(sum(l_quantity * l_quantity), 4) as qq, round(sum(l_quantity * l_discount), 4) as qd,
       round(sum(l_quantity * l_tax), 4) as qt, round(sum(l_discount * l_discount), 4) as dd, round(sum(l_discount * l_tax), 4) as dt,
       round(sum(l_tax * l_tax), 4) as tt from obs group by 1""",
    ("obs",),
)
def products_per_tile(spark, sf):
    out = gram.gram_by(derived.obs(spark, sf), ["l_quantity", "l_discount", "l_tax"], ["tile_id"])
    names = ["qq", "qd", "qt", "dd", "dt", "tt"]
    return out.select("tile_id", "n", *[r(F.get("products", F.lit(i)), 4).alias(n) for i, n in enumerate(names)])


@query(
    "A16",
    "select cast(floor(pos / 64) as int) as i, cast(pos % 64 as int) as j, round(sum(e[floor(pos / 64)::int + 1]::double * e[pos % 64 + 1]::double), 6) as v"
    " from (select embedding as e, unnest(range(4096)) as pos from embeddings) where pos // 64 <= pos % 64 group by 1, 2",
)
def wide_products(spark, sf):
    """Products of all 64 vector components, formed per Arrow batch."""
    names = [f"e{i}" for i in range(64)]
    wide = derived.table(spark, sf, "embeddings").select(
        *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]
    )
    out = gram.gram_by(wide, names).select(F.posexplode("products").alias("pos", "v"))
    rows = spark.createDataFrame(
        [(k, i, j) for k, (i, j) in enumerate(gram.triangle(64))], "pos int, i int, j int"
    )
    return out.join(rows, "pos").select("i", "j", r(F.col("v"), 6).alias("v"))


def _complete(spark, sf):
    return frame(spark, sf).dropna("any", subset=["temperature", "ua_vegetation_50m_frac"]).withColumn(
        "z_one", F.lit(1.0)
    )


_RESIDUALS = f"""rows_ as (select tile_id, temperature as y, ua_vegetation_50m_frac as x from frame where temperature is not null),
  fit as (select regr_slope(y, x) as b, regr_intercept(y, x) as a from rows_),
  res as (select tile_id as tile, avg(y) - (any_value(a) + any_value(b) * avg(x)) as value, count(*) as n from rows_, fit group by 1)"""


@query(
    "M6",
    f"with {FRAME}, {_RESIDUALS} select tile, n, round(value, 6) as value from res where n >= 5",
    ("obs",),
)
def tile_residuals(spark, sf):
    rows = _complete(spark, sf)
    fit = gram.ols(rows, ["z_one", "ua_vegetation_50m_frac"], "temperature")
    out = gram.tile_residuals(rows, fit, "temperature", "tile_id", 5)
    return out.select(F.col("tile_id").alias("tile"), "n", r(F.col("value")).alias("value"))


def _with_axial(residuals):
    parts = F.split("tile", "_")
    return residuals.select("tile", "value", parts[0].cast("int").alias("q"), parts[1].cast("int").alias("r"))


@query(
    "M7 J15",
    f"""with {FRAME}, {_RESIDUALS}, t as (select tile, split_part(tile, '_', 1)::int as q, split_part(tile, '_', 2)::int as r, value - avg(value) over () as z from res where n >= 5),
      e as (select a.tile as src, b.z as zj, a.z as zi from t a join t b on (b.q - a.q, b.r - a.r) in ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))),
      w as (select *, 1e0 / count(*) over (partition by src) as w from e)
      select (select count(*) from t) as n_tiles, (select count(*) from e) as n_edges,
       round((select count(*) from t) / (select sum(w) from w) * (select sum(w * zi * zj) from w) / (select sum(z * z) from t), 7) as morans_i,
       round(-1e0 / ((select count(*) from t) - 1), 9) as expected_i""",
    ("obs",),
)
def morans_i_of_residuals(spark, sf):
    rows = _complete(spark, sf)
    fit = gram.ols(rows, ["z_one", "ua_vegetation_50m_frac"], "temperature")
    res = gram.tile_residuals(rows, fit, "temperature", "tile_id", 5).withColumnRenamed("tile_id", "tile")
    out = morans_i(_with_axial(res), n_perm=9)
    return out.select("n_tiles", "n_edges", r(F.col("morans_i"), 7).alias("morans_i"), r(F.col("expected_i"), 9).alias("expected_i"))


@query("M7")
def morans_i_permutations(spark, sf):
    res = frame(spark, sf).where("temperature is not null").groupBy(F.col("tile_id").alias("tile")).agg(
        F.avg("temperature").alias("value")
    )
    return morans_i(_with_axial(res), n_perm=999)


@query("M6 M8")
def nested_spatial_models(spark, sf):
    z = derive.confounders()
    rows = materialise(frame(spark, sf).withColumns(z))
    null = list(z)
    morph = [*null, *association.morphology(FEATURES)]
    full = [*morph, "ua_vegetation_50m_frac", "trees_count50m"]
    parts = F.split("tile", "_")
    tiles = rows.select(F.col("tile_id").alias("tile")).distinct().select(
        "tile", parts[0].cast("int").alias("q"), parts[1].cast("int").alias("r")
    )
    out = materialise(
        spatial_models.nested_morans(
            rows, {"null": null, "morphology": morph, "full": full}, "temperature", "tile_id", tiles, 5
        )
    )
    deltas = spatial_models.moran_deltas(out, [("null", "morphology"), ("morphology", "full")])
    return out.select(F.col("model").alias("step"), F.col("morans_i").alias("value"), F.lit(None).cast("string").alias("verdict")).unionByName(
        deltas.select("step", F.col("delta_i").alias("value"), "verdict")
    )


# --- block validation --------------------------------------------------------------------

_LOO = f"""base as (select image_id % 10 as block, temperature as y, ua_vegetation_50m_frac as x from frame where temperature is not null),
  s as (select block, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from base group by 1),
  t as (select sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(sxy) as sxy from s),
  f as (select block, t.n - s.n as n, t.sx - s.sx as sx, t.sy - s.sy as sy, t.sxx - s.sxx as sxx, t.sxy - s.sxy as sxy from s, t),
  b as (select block, n as n_train, (n * sxy - sx * sy) / (n * sxx - sx * sx) as b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n as a from f),
  e as (select base.block, n_train, y, y - (a + b * x) as e from base join b using (block)),
  scores as (select block, any_value(n_train) as n_train, count(*) as n_test, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse,
    greatest(-1, least(1, 1 - sum(e * e) / (var_pop(y) * count(*)))) as r2 from e group by 1)"""


def _loo(spark, sf):
    rows = materialise(_complete(spark, sf).withColumn("block", (F.col("image_id") % 10).cast("long")))
    return spatial_models.leave_block_out(
        rows, ["z_one", "ua_vegetation_50m_frac"], "temperature", "block", rows, ridge=0.0
    )


@query(
    "M9",
    f"with {FRAME}, {_LOO} select block, n_train::bigint as n_train, n_test, round(mae, 6) as mae, round(rmse, 6) as rmse, round(r2, 6) as r2 from scores",
    ("obs",),
)
def leave_block_out(spark, sf):
    return _loo(spark, sf).withColumns({c: r(F.col(c)) for c in ("mae", "rmse", "r2")})


@query(
    "M10",
    f"""with {FRAME}, {_LOO} select count(*) as n_blocks, round(avg(mae), 4) as mae_mean, round(stddev_pop(mae), 4) as mae_std,
      round(avg(rmse), 4) as rmse_mean, round(stddev_pop(rmse), 4) as rmse_std, round(avg(r2), 4) as r2_mean, round(stddev_pop(r2), 4) as r2_std,
      round(median(r2), 4) as r2_median, round(quantile_cont(r2, 0.1), 4) as r2_q10, round(quantile_cont(r2, 0.9), 4) as r2_q90 from scores""",
    ("obs",),
)
def block_score_summary(spark, sf):
    return spatial_models.cv_summary(_loo(spark, sf))


@query(
    "W2",
    f"""select {ID_SQL} from (select *, row_number() over (partition by image_id order by {ORDER_SQL}, {', '.join(OBS_TIES)}) as k from obs) where k <= 20""",
    ("obs",),
)
def first_rows_per_block(spark, sf):
    return take_lowest(
        derived.obs(spark, sf), ["image_id"], F.expr(ORDER_SQL), OBS_TIES, 20, ORDER_RANGE
    ).select(*IDS)


@query(
    "M11",
    f"""with {FRAME}, base as (select ({ORDER_SQL}) % 5 as fold, temperature as y, ua_vegetation_50m_frac as x from frame where temperature is not null),
      s as (select fold, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from base group by 1),
      t as (select sum(n) as n, sum(sx) as sx, sum(sy) as sy, sum(sxx) as sxx, sum(sxy) as sxy from s),
      f as (select fold, t.n - s.n as n, t.sx - s.sx as sx, t.sy - s.sy as sy, t.sxx - s.sxx as sxx, t.sxy - s.sxy as sxy from s, t),
      b as (select fold, (n * sxy - sx * sy) / (n * sxx - sx * sx) as b, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n as a from f),
      e as (select base.fold, y, y - (a + b * x) as e from base join b using (fold))
      select cast(fold as int) as fold, count(*) as n_test, round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse,
        round(greatest(-1, least(1, 1 - sum(e * e) / (var_pop(y) * count(*)))), 6) as r2 from e group by 1""",
    ("obs",),
)
def random_folds(spark, sf):
    fold = F.expr(f"cast(({ORDER_SQL}) % 5 as int)")
    out = spatial_models.random_folds(
        _complete(spark, sf), ["z_one", "ua_vegetation_50m_frac"], "temperature", fold, ridge=0.0
    )
    return out.withColumns({c: r(F.col(c)) for c in ("mae", "rmse", "r2")})


@query(
    "M12",
    f"""with places as (select longitude, latitude, row_number() over () as loc_id from (select distinct longitude, latitude from obs)),
      source as (select loc_id as id, longitude as lon, latitude as lat from places), {LAMBERT},
      keyed as (select 'rect_1km' as kind, {rect_sql(1000)} as block from lambert union all select 'rect_2km', {rect_sql(2000)} from lambert
        union all select 'hex_r8', concat('h8_', cast(cast(q as int) as varchar), '_', cast(cast(r as int) as varchar)) from ({_hex_sql(8).replace('from obs', 'from places')})
        union all select 'hex_r7', concat('h7_', cast(cast(q as int) as varchar), '_', cast(cast(r as int) as varchar)) from ({_hex_sql(7).replace('from obs', 'from places')}))
      select kind, block, count(*) as n from keyed group by 1, 2""",
    ("obs",),
)
def block_keys(spark, sf):
    places = derived.obs(spark, sf).select("longitude", "latitude").distinct()
    out = None
    for kind in ("hex_r8", "hex_r7", "rect_1km", "rect_2km"):
        got = spatial_models.with_block(places, kind).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        got = got.select(F.lit(kind).alias("kind"), "block", "n")
        out = got if out is None else out.unionByName(got)
    return out


# --- scenarios -------------------------------------------------------------------------------


@query(
    "M13",
    f"""with {FRAME} select 'ua_vegetation_50m_frac' as feature, round(regr_slope(temperature, ua_vegetation_50m_frac), 6) as beta,
      round((select avg(ua_vegetation_50m_frac) from frame), 6) as mean, round((select stddev_pop(ua_vegetation_50m_frac) from frame), 6) as std,
      count(*) as n_rows from frame where temperature is not null""",
    ("obs",),
)
def scenario_fit(spark, sf):
    rows = frame(spark, sf).withColumn("z_one", F.lit(1.0))
    out = spatial_models.fit_scenario_model(rows, ["z_one"], [], ["ua_vegetation_50m_frac"], "temperature")
    return out.withColumns({c: r(F.col(c)) for c in ("beta", "mean", "std")})


@query(
    "M14",
    f"""with {FRAME}, fit as (select regr_slope(temperature, ua_vegetation_50m_frac) as b, (select avg(ua_vegetation_50m_frac) from frame) as m from frame where temperature is not null)
      select concat('veg_', event_type) as scenario, round(b * (v - m), 4) as delta_t, round(0.5e0 * b * (v - m), 4) as delta_t_air, 1::bigint as n_terms
      from (select event_type, avg(value) / 100e0 as v from events group by 1), fit""",
    ("obs",),
)
def scenario_effects(spark, sf):
    rows = frame(spark, sf).withColumn("z_one", F.lit(1.0))
    fit = spatial_models.fit_scenario_model(rows, ["z_one"], [], ["ua_vegetation_50m_frac"], "temperature")
    scenarios = derived.table(spark, sf, "events").groupBy("event_type").agg((F.avg("value") / 100).alias("value")).select(
        F.concat(F.lit("veg_"), "event_type").alias("scenario"), F.lit("ua_vegetation_50m_frac").alias("feature"), "value"
    )
    return spatial_models.evaluate_scenarios(fit, scenarios)


@query("M13 M14")
def scenario_joint_model(spark, sf):
    z = derive.confounders()
    rows = materialise(frame(spark, sf).withColumns(z))
    fit = spatial_models.fit_scenario_model(
        rows, list(z), ["dhm_avg50m_elevation", "ua_dense_50m_frac"], ["ua_vegetation_50m_frac", "trees_count50m"], "temperature"
    )
    levels = fit.select(
        F.explode(F.expr("sequence(1, 3)")).alias("k"), "feature", (F.col("mean") + F.col("k") * F.col("std")).alias("value")
    ).select(F.concat(F.lit("plus_"), F.col("k").cast("string"), F.lit("_sd")).alias("scenario"), "feature", "value")
    return spatial_models.evaluate_scenarios(fit, levels)


# --- stability -------------------------------------------------------------------------------

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1:]]
_RESULTS = "results as (" + " union all ".join(
    f"""select cast(year as varchar) as dataset, count(*) as n_rows, '{a}' as feature_a, '{a[2:4]}' as source_a, '{b}' as feature_b, '{b[2:4]}' as source_b,
    corr({a}, {b}) as pearson_r, corr({b}, {a}) / 2 as spearman_r, abs(corr({a}, {b})) / 3 as mi from obs group by 1""" for a, b in _PAIRS
) + ")"


def _results(spark, sf):
    obs = derived.obs(spark, sf)
    entries = [
        F.struct(
            F.lit(a).alias("feature_a"), F.lit(a[2:4]).alias("source_a"), F.lit(b).alias("feature_b"),
            F.lit(b[2:4]).alias("source_b"), F.corr(a, b).alias("pearson_r"),
            (F.corr(b, a) / 2).alias("spearman_r"), (F.abs(F.corr(a, b)) / 3).alias("mi"),
        )
        for a, b in _PAIRS
    ]
    return obs.groupBy(F.col("year").cast("string").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.array(*entries).alias("e")
    ).select("dataset", "n_rows", F.inline("e"))


def _spread_sql(value: str, prefix: str) -> str:
    sd = f"case when count({value}) > 0 then coalesce(stddev_samp({value}), 0) end"
    return f"""round(avg({value}), 6) as {prefix}_mean, round({sd}, 6) as {prefix}_std, round({sd} / (avg({value}) + 1e-6), 4) as {prefix}_cv,
      round(min({value}), 6) as {prefix}_min, round(max({value}), 6) as {prefix}_max, count({value}) as {prefix}_n"""


def _stable_sql(value: str) -> str:
    sd = f"case when count({value}) > 0 then coalesce(stddev_samp({value}), 0) end"
    return f"round(greatest(0, 1 - {sd} / (avg({value}) + 1e-6)), 4) as stability"


def _sign_sql(value: str) -> str:
    return f"round(greatest(count(*) filter (where {value} > 0), count({value}) - count(*) filter (where {value} > 0)) / nullif(count({value}), 0)::double, 6) as sign_share"


def _rounded(df, keys):
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.withColumns(
        {
            c: r(F.col(c), 4 if c.endswith("_cv") or c == "stability" else 6)
            for c in df.columns if c not in keys and kinds[c] == "double"
        }
    )


_SMALL = 0  # every year counts as a full dataset unless a query says otherwise


@query(
    "M18",
    f"""with {_RESULTS}, c as (select *, n_rows >= (select max(n_rows) / 2 from results) as full_ from results),
      v as (select *, case when full_ then abs(pearson_r) end as pf, case when full_ then pearson_r end as pr, case when full_ then abs(spearman_r) end as sf,
        case when full_ then mi end as mf, case when not full_ then pearson_r end as ps from c)
      select feature_a, source_a, feature_b, source_b, count(*) filter (where full_) as n_full, count(*) filter (where not full_) as n_spatial,
        {_spread_sql('pf', 'pearson')}, {_spread_sql('sf', 'spearman')}, {_spread_sql('mf', 'mi')}, {_sign_sql('pr')}, {_stable_sql('pf')},
        round(case when count(ps) > 0 and sum(pr) is not null then case when sum(pr) > 0 then count(*) filter (where ps > 0) else count(ps) - count(*) filter (where ps > 0) end / count(ps)::double end, 6) as spatial_agree
      from v group by 1, 2, 3, 4""",
    ("obs",),
)
def pair_stability(spark, sf):
    results = materialise(_results(spark, sf))
    most = results.agg(F.max("n_rows")).first()[0]
    return _rounded(stability.pair_stability(results, full_rows=math.ceil(most / 2)), [])


@query(
    "M31",
    f"""with {_RESULTS} select concat(feature_a, '~', feature_b) as feature, round(avg(pearson_r), 6) as mean_r, {_spread_sql('abs(pearson_r)', 'abs_r')},
      {_sign_sql('pearson_r')}, {_stable_sql('abs(pearson_r)')} from results group by 1""",
    ("obs",),
)
def feature_stability(spark, sf):
    results = _results(spark, sf).withColumn("feature", F.concat_ws("~", "feature_a", "feature_b"))
    return _rounded(stability.feature_stability(results, _SMALL), [])


@query(
    "M19",
    f"""with {_RESULTS}, v as (select feature_a as feature, coalesce(case when n_rows % 2 = 0 then pearson_r / 2 end, pearson_r) as v, mi as cf from results)
      select feature, count(v) as n_full, {_spread_sql('abs(v)', 'abs_r')}, {_sign_sql('v')}, round(avg(cf), 6) as mean_confounding, {_stable_sql('abs(v)')}
      from v group by 1""",
    ("obs",),
)
def partial_stability(spark, sf):
    results = _results(spark, sf).select(
        "dataset", "n_rows", F.col("feature_a").alias("feature"), F.col("pearson_r").alias("partial_r"),
        F.when(F.col("n_rows") % 2 == 0, F.col("pearson_r") / 2).alias("partial_r_adj"),
        F.col("mi").alias("confounding_fraction"),
    )
    return _rounded(stability.partial_stability(results, _SMALL), [])


@query(
    "M19",
    f"with {_RESULTS} select source_a as model, {_spread_sql('mi', 'mi')}, {_stable_sql('mi')} from results group by 1",
    ("obs",),
)
def statistic_stability(spark, sf):
    results = _results(spark, sf).withColumn("model", F.col("source_a"))
    return _rounded(stability.value_stability(results, ["model"], "mi", _SMALL), [])


@query(
    "M30",
    f"""with {_RESULTS} select least(source_a, source_b) as source_1, greatest(source_a, source_b) as source_2, round(avg(abs(pearson_r)), 6) as pearson_r
      from results group by 1, 2""",
    ("obs",),
)
def source_matrix(spark, sf):
    return _rounded(stability.source_matrix(_results(spark, sf), "pearson_r"), [])


@query(
    "M32",
    f"""with {_RESULTS} select dataset, feature_a, feature_b, round(pearson_r, 6) as pearson_r, cast(k as int) as place from (select *, row_number() over
      (partition by dataset order by abs(pearson_r) desc, feature_a, feature_b) as k from results) where k <= 3""",
    ("obs",),
)
def top_pairs(spark, sf):
    return stability.top_pairs(_results(spark, sf)).select(
        "dataset", "feature_a", "feature_b", r(F.col("pearson_r")).alias("pearson_r"), "place"
    )


# --- panel -------------------------------------------------------------------------------

# A tile is treated from its own start year on.
_DOSE = "case when loc_id % 3 = 0 and year >= 1996 + loc_id % 4 then 1e0 + loc_id % 2 else 0e0 end"
_PANEL = f"""pan as (select cast(loc_id as varchar) as tile, year * 12 + month_of_year as scene_ym, {_T} as y, {_DOSE} as d, ua_vegetation_50m_frac from frame where {_T} is not null),
  ok as (select tile from pan group by 1 having max(d) > 0 and count(*) >= 3),
  el as (select * from pan where tile in (select tile from ok))"""


def _panel(spark, sf):
    rows = frame(spark, sf).withColumns({"dose": F.expr(_DOSE), "tile_id": F.col("loc_id").cast("string")})
    return panel.build_panel(rows, "temperature", "dose", controls=["ua_vegetation_50m_frac"])


@query("M17", f"with {FRAME}, {_PANEL} select * from pan", ("obs",))
def panel_rows(spark, sf):
    return _panel(spark, sf)


@query("F13 J16", f"with {FRAME}, {_PANEL} select * from el", ("obs",))
def eligible_panel(spark, sf):
    return panel.eligible(_panel(spark, sf))


@query(
    "J14 W4",
    f"""with {FRAME}, {_PANEL}, y as (select *, (scene_ym - 1) // 12 as scene_year from el),
      o as (select tile, min(scene_year) as onset_year from y where d > 0 group by 1)
      select tile, scene_ym, y, cast(scene_year as int) as scene_year, cast(onset_year as int) as onset_year,
        cast(greatest(-5, least(10, scene_year - onset_year)) as int) as k_bin from y join o using (tile)""",
    ("obs",),
)
def event_time(spark, sf):
    return panel.event_time(panel.eligible(_panel(spark, sf))).select(
        "tile", "scene_ym", "y", "scene_year", "onset_year", "k_bin"
    )


@query(
    "W3",
    f"""with {FRAME}, {_PANEL}, m as (select tile, avg(y) as my, avg(d) as md from el group by 1)
      select count(*) as n, round(sum((d - md) * (y - my)) / sum((d - md) * (d - md)), 6) as within_effect from el join m using (tile)""",
    ("obs",),
)
def within_tile_effect(spark, sf):
    rows = panel.demean(panel.eligible(_panel(spark, sf)), ["y", "d"], "tile")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(F.col("d") * F.col("y")) / F.sum(F.col("d") * F.col("d"))).alias("within_effect")
    )


@query("M15 W3")
def difference_in_differences(spark, sf):
    rows = materialise(panel.eligible(_panel(spark, sf)))
    return panel.difference_in_differences(rows, ["ua_vegetation_50m_frac"])[0]


@query("M16")
def event_study(spark, sf):
    rows = materialise(panel.eligible(_panel(spark, sf)))
    table, p = panel.event_study(rows)
    return table.withColumn("pre_period_p", F.lit(p))


# --- models ---------------------------------------------------------------------------------


@query(
    "A15",
    """select partition_key, count(*) as n_rows, round(avg((modis_lst - aster_lst) ** 2), 5) as mse, round(sqrt(avg((modis_lst - aster_lst) ** 2)), 6) as rmse,
       round(avg(abs(modis_lst - aster_lst)), 6) as mae, round(1 - sum((modis_lst - aster_lst) ** 2) / nullif(var_pop(aster_lst) * count(*), 0), 5) as r2,
       round(100 * avg(abs((modis_lst - aster_lst) / case when abs(aster_lst) > 1e-6 then aster_lst else 1 end)), 5) as mape,
       round(avg(modis_lst - aster_lst), 6) as bias, round(max(abs(modis_lst - aster_lst)), 6) as max_error
       from obs where modis_lst is not null and aster_lst is not null group by 1""",
    ("obs",),
)
def regression_metrics(spark, sf):
    out = models.regression_metrics(derived.obs(spark, sf), "modis_lst", "aster_lst", ["partition_key"])
    five = {"mse", "r2", "mape"}
    return out.withColumns(
        {c: r(F.col(c), 5 if c in five else 6) for c in out.columns if c not in ("partition_key", "n_rows")}
    )


_LABEL = "case when year = 1997 then 'y1997' when month_of_year in (6, 7) then 'summer' when hour_of_day < 3 then 'night' end"


@query(
    "M29",
    f"""with {FRAME}, l as (select *, {_LABEL} as label from frame where temperature is not null),
      fit as (select regr_slope(temperature, ua_vegetation_50m_frac) as b, regr_intercept(temperature, ua_vegetation_50m_frac) as a from l where label is null)
      select label, count(*) as n_rows, round(sqrt(avg((a + b * ua_vegetation_50m_frac - temperature) ** 2)), 5) as rmse,
        round(avg(a + b * ua_vegetation_50m_frac - temperature), 5) as bias from l, fit where label is not null group by 1""",
    ("obs",),
)
def metrics_per_label(spark, sf):
    rows = materialise(
        frame(spark, sf).withColumn("label", F.expr(_LABEL)).where("temperature is not null")
        .select("label", "temperature", "ua_vegetation_50m_frac")
    )
    names = ["ua_vegetation_50m_frac"]
    model = models.fit_model("linear", rows.where("label is null"), names, "temperature", regParam=0.0)
    out = models.evaluate_per_label(model, rows.where("label is not null"), names, "temperature")
    return out.select("label", "n_rows", r(F.col("rmse"), 5).alias("rmse"), r(F.col("bias"), 5).alias("bias"))


@query(
    "M20",
    f"""with {FRAME} select round(regr_slope(temperature, ua_vegetation_50m_frac), 5) as slope,
      round(regr_intercept(temperature, ua_vegetation_50m_frac), 5) as intercept from frame where temperature is not null""",
    ("obs",),
)
def linear_regression(spark, sf):
    rows = frame(spark, sf).where("temperature is not null")
    model = models.fit_model("linear", rows, ["ua_vegetation_50m_frac"], "temperature", regParam=0.0)
    return spark.range(1).select(
        r(F.lit(float(model.coefficients[0])), 5).alias("slope"), r(F.lit(float(model.intercept)), 5).alias("intercept")
    )


_NUMERIC = ["ua_vegetation_50m_frac", "ua_dense_50m_frac", "l_quantity", "hour_of_day"]


def _model_rows(spark, sf):
    return derived.spread(
        frame(spark, sf).where("temperature is not null").select(*IDS, "l_extendedprice", "temperature", *_NUMERIC)
    )


def _parts(spark, sf):
    """Training and test rows for what reads each of them once."""
    rows = _model_rows(spark, sf)
    fold = F.expr(f"cast(({ORDER_SQL}) % 5 as int)")
    return rows.where(fold > 0), rows.where(fold == 0)


def _split(spark, sf):
    train, test = _parts(spark, sf)
    return materialise(train), materialise(test)


@query("M20 M24")
def linear_family(spark, sf):
    train, test = _parts(spark, sf)
    return models.train_all(train, test, _NUMERIC, "temperature", ["linear", "ridge", "elastic_net", "huber"])


@query("M21")
def kernel_regression(spark, sf):
    train, test = _parts(spark, sf)
    return models.train_all(train, test, _NUMERIC, "temperature", ["nystroem"], {"nystroem": {"n_components": 50}})


@query("M22")
def random_forest(spark, sf):
    train, test = _parts(spark, sf)
    small = {"random_forest": {"numTrees": 20, "maxDepth": 6}}
    return models.train_all(train, test, _NUMERIC, "temperature", ["random_forest"], small)


@query("M23")
def gradient_boosting(spark, sf):
    train, test = _parts(spark, sf)
    small = {"boosting": {"maxIter": 10, "maxDepth": 4},
             "second_order": {"rounds": 10, "depth": 4, "rate": 0.3}, "extra_trees": {"trees": 10, "depth": 6}}
    return models.train_all(train, test, _NUMERIC, "temperature", ["boosting"], small)


@query("M23")
def second_order_boosting(spark, sf):
    """Boosted trees with gradients and hessians: ten trees, then ten more on top of the first model."""
    train, test = _split(spark, sf)
    settings = trees.Boosting(rounds=10, depth=4, rate=0.2)
    first = trees.fit_boosted(train, _NUMERIC, "temperature", settings)
    path = new_table_path(spark, "boosted")
    first.save(spark, path)
    second = trees.fit_boosted(train, _NUMERIC, "temperature", settings, start=trees.Ensemble.load(spark, path))
    out = None
    test = models.equal_rows(test, [*_NUMERIC, "temperature"])
    for model in (first, second):
        row = models.regression_metrics(model.transform(test), "prediction", "temperature", weight=models.EQUAL).select(F.lit(len(model.trees)).alias("trees"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("M22")
def extremely_random_trees(spark, sf):
    train, test = _parts(spark, sf)
    return models.train_all(train, test, _NUMERIC, "temperature", ["extra_trees"], {"extra_trees": {"trees": 20, "depth": 8}})


@query(
    "M24 M20",
    f"""with {FRAME}, f as (select *, ({ORDER_SQL}) % 5 as fold, l_quantity * l_quantity as q2 from frame where temperature is not null),
      t as (select regr_slope(temperature, q2) as b, regr_intercept(temperature, q2) as a from f where fold > 0)
      select 'linear' as model, count(*) as n_rows, round(sqrt(avg((a + b * q2 - temperature) ** 2)), 5) as rmse, round(avg(a + b * q2 - temperature), 5) as bias from f, t where fold = 0""",
    ("obs",),
)
def prepared_training(spark, sf):
    """Transforms and scalers in training: the square of the quantity takes its place, scaled on the training rows."""
    train, test = _split(spark, sf)
    square = tf.func(["l_quantity"], lambda x: x * x, "²", drop_inputs=True)
    out = models.train_all(
        train, test, ["l_quantity"], "temperature", ["linear"], {"linear": {"regParam": 0.0}}, [square], "standard", {"l_quantity²": "minmax"}
    )
    return out.select("model", "n_rows", r(F.col("rmse"), 5).alias("rmse"), r(F.col("bias"), 5).alias("bias"))


_TEST_ROWS = f"(select count(*) from frame where temperature is not null and ({ORDER_SQL}) % 5 = 0)"
_SETTINGS = {"nystroem": {"n_components": 50}, "random_forest": {"numTrees": 20, "maxDepth": 6}, "boosting": {"maxIter": 10, "maxDepth": 4},
             "second_order": {"rounds": 10, "depth": 4, "rate": 0.3}, "extra_trees": {"trees": 10, "depth": 6}}


@query(
    "M20 M21 M22 M23 M24",
    f"""with {FRAME} select unnest({sorted(models.MODELS)}) as model, {_TEST_ROWS} as n_rows, true as beats_mean, true as unbiased""",
    ("obs",),
)
def models_on_all_rows(spark, sf):
    """Every model scores every held-out row, with less error than the mean has, and without a large bias."""
    train, test = _parts(spark, sf)
    out = models.train_all(train, test, _NUMERIC, "temperature", settings=_SETTINGS)
    return out.select("model", "n_rows", (F.col("r2") > 0.1).alias("beats_mean"), (F.abs("bias") < F.col("rmse") / 2).alias("unbiased"))


@query(
    "M25 T11 T12",
    "select 'regParam=0.0001' as params, 3::bigint as n_splits, true as fits, false as failed "
    "union all select 'regParam=-1.0', 0, false, true",
)
def searched_settings(spark, sf):
    """A setting that fits has a score from every split, one that is refused has its reason."""
    rows = materialise(_model_rows(spark, sf))
    out = models.half_split_search("ridge", rows, _NUMERIC, "temperature", {"regParam": [1e-4, -1.0]}, IDS)
    return out.select("params", "n_splits", F.coalesce(F.col("r2") > 0.1, F.lit(False)).alias("fits"), F.col("error").isNotNull().alias("failed"))


@query(
    "M26 M27",
    "select 'forest' as kind, 4::bigint as n, true as shares, 'l_quantity' as first union all select 'permutation', 4, true, 'l_quantity'",
)
def importance_checks(spark, sf):
    """Importances of the forest sum to one, permutation ones are not negative, and both name the quantity first."""
    train, test = _split(spark, sf)
    forest = models.fit_model("random_forest", train, _NUMERIC, "temperature", numTrees=10, maxDepth=5)
    shares = models.feature_importance(forest, _NUMERIC, train)
    moved = permutation_importance(spark, sf)
    first = lambda v: F.max_by("feature", v).alias("first")
    return shares.agg(
        F.lit("forest").alias("kind"), F.count(F.lit(1)).alias("n"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("shares"), first("importance")
    ).unionByName(moved.agg(F.lit("permutation").alias("kind"), F.count(F.lit(1)).alias("n"), (F.min("delta_mse") >= 0).alias("shares"), first("delta_mse")))


@query("M25 T11")
def grid_search(spark, sf):
    """Two penalties that fit and one that is refused and recorded."""
    train, test = _split(spark, sf)
    out = models.grid_search("ridge", train, test, _NUMERIC, "temperature", {"regParam": [1e-4, 1e-1, -1.0]})
    return models.leaderboard(out, 10, ["params"])


@query("M25 T12")
def half_split_search(spark, sf):
    rows = materialise(_model_rows(spark, sf))
    return models.half_split_search("ridge", rows, _NUMERIC, "temperature", {"regParam": [1e-4, 1e-1]}, IDS)


@query("M26")
def forest_importance(spark, sf):
    rows = materialise(_model_rows(spark, sf))
    model = models.fit_model("random_forest", rows, _NUMERIC, "temperature", numTrees=10, maxDepth=5)
    return models.feature_importance(model, _NUMERIC, rows)


@query(
    "M26",
    f"""with {FRAME}, f as (select temperature as y, l_quantity as a, l_tax as b from frame where temperature is not null),
      s as (select covar_samp(a, y) as ay, covar_samp(b, y) as by_, covar_samp(a, b) as ab, var_samp(a) as aa, var_samp(b) as bb from f),
      c as (select abs((ay * bb - by_ * ab) / (aa * bb - ab * ab)) * sqrt(aa) as ca, abs((by_ * aa - ay * ab) / (aa * bb - ab * ab)) * sqrt(bb) as cb from s)
      select 'l_quantity' as feature, round(ca / (ca + cb), 5) as importance from c union all select 'l_tax', round(cb / (ca + cb), 5) from c""",
    ("obs",),
)
def linear_importance(spark, sf):
    rows = frame(spark, sf).where("temperature is not null")
    names = ["l_quantity", "l_tax"]
    model = models.fit_model("linear", rows, names, "temperature", regParam=0.0)
    shares = models.feature_importance(model, names, rows)
    return shares.select("feature", r(F.col("importance"), 5).alias("importance"))


@query("M27")
def permutation_importance(spark, sf):
    train, test = _split(spark, sf)
    model = models.fit_model("ridge", train, _NUMERIC, "temperature")
    keyed = test.withColumn("row_id", F.xxhash64(*IDS, "l_extendedprice"))
    return models.permutation_importance(
        lambda f: models.predict(model, f), keyed, _NUMERIC, "temperature", "row_id"
    )


_HAND_TREE = attribution.Tree(
    feature=np.array([0, 1, -1, -1, 0, -1, -1]), cut=np.array([25.0, 0.04, 0, 0, 40.0, 0, 0]), left=np.array([1, 2, -1, -1, 5, -1, -1]),
    right=np.array([4, 3, -1, -1, 6, -1, -1]), value=np.array([0, 0, 1.0, 3.0, 0, 5.0, 9.0]), cover=np.array([100, 50, 30, 20, 50, 30, 20.0]),
)


@query(
    "M28",
    f"""with v as (select {ID_SQL}, case when l_quantity <= 25 then 1.8e0 when l_quantity <= 40 then 5e0 else 9e0 end as q,
        case when l_tax <= 0.04e0 then 0.5e0 else 1.5e0 end + 3.3e0 as t,
        case when l_quantity > 40 then 9e0 when l_quantity > 25 then 5e0 when l_tax <= 0.04e0 then 1e0 else 3e0 end as both_, 4.2e0 as base from obs)
      select {ID_SQL}, base, round(((q - base) + (both_ - t)) / 2e0, 9) as l_quantity_effect, round(((t - base) + (both_ - q)) / 2e0, 9) as l_tax_effect from v""",
    ("obs",),
)
def tree_attribution(spark, sf):
    """Shapley values of a tree of three splits, one feature splitting twice, for every observation."""
    rows = derived.obs(spark, sf).select(*IDS, "l_quantity", "l_tax")
    out = attribution.tree_attribution(rows, [_HAND_TREE], ["l_quantity", "l_tax"])
    return out.select(*IDS, r(F.col("base"), 9).alias("base"), r(F.col("l_quantity_effect"), 9).alias("l_quantity_effect"), r(F.col("l_tax_effect"), 9).alias("l_tax_effect"))


@query("M28 M22 M23")
def ensemble_attribution(spark, sf):
    """What each feature adds to a forest's and a boosted model's predictions of the held-out rows: means, and the gap to the prediction."""
    train, test = _split(spark, sf)
    test = models.equal_rows(test, _NUMERIC)  # explained once, whatever their number
    n, out = F.col(models.EQUAL), None
    for kind in ("random_forest", "boosting"):
        model = models.fit_model(kind, train, _NUMERIC, "temperature", **_SETTINGS[kind])
        explained = attribution.tree_attribution(models.predict(model, test), attribution.saved_trees(model, spark), _NUMERIC)
        total = F.col("base") + sum(F.col(f"{f}_effect") for f in _NUMERIC)
        found = explained.agg(
            F.lit(kind).alias("model"), F.sum(n).alias("n_rows"), F.max(F.abs(total - F.col("prediction"))).alias("largest_gap"),
            *[(F.sum(n * F.abs(f"{f}_effect")) / F.sum(n)).alias(f) for f in _NUMERIC],
        )
        out = found if out is None else out.unionByName(found)
    return out


@query(
    "M28",
    f"""with m as (select avg(l_quantity) as q, avg(l_tax) as t from obs) select {ID_SQL}, round(0.5e0 * (l_quantity - q), 6) as l_quantity_effect,
      round(-2e0 * (l_tax - t), 6) as l_tax_effect from obs, m""",
    ("obs",),
)
def linear_attribution(spark, sf):
    out = models.linear_attribution(derived.obs(spark, sf), {"l_quantity": 0.5, "l_tax": -2.0})
    return out.select(*IDS, r(F.col("l_quantity_effect")).alias("l_quantity_effect"), r(F.col("l_tax_effect")).alias("l_tax_effect"))


# --- features --------------------------------------------------------------------------------


def _sides(spark, sf):
    polys = derived.polys(spark, sf)
    return Sides(
        points={"trees": derived.trees(spark, sf), "dhm": derived.dhm(spark, sf)},
        point_ids={"trees": "tree_id", "dhm": "point_id"}, survey_columns={"dhm": "dhm_year"},
        land_use=polys, surfaces=polys.join(_materials(spark, sf), "poly_id"),
    )


def _materials(spark, sf):
    """What each polygon is made of: the last word of the part's name."""
    return derived.table(spark, sf, "part").select(
        F.col("p_partkey").alias("poly_id"), F.substring_index("p_name", " ", -1).alias("material")
    )


def _values(df, column):
    """The values of a categorical column, a few dozen, in order."""
    return sorted(row[0] for row in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


@query(
    "D1 D2",
    f"""select {ID_SQL}, round(l_quantity * l_tax, 6) as mine_load, case when hour_of_day >= 6 and hour_of_day < 18 then 1 else 0 end as mine_day,
      round(l_extendedprice - (select avg(l_extendedprice) from obs), 4) as centred from obs""",
    ("obs",),
)
def custom_features(spark, sf):
    def centred(df):
        mean = df.agg(F.avg("l_extendedprice")).first()[0]
        return df.withColumn("centred", r(F.col("l_extendedprice") - F.lit(mean), 4))

    reg = Registry(
        [
            CustomFeature(
                "load", ("load", "day"),
                lambda df: {
                    "load": r(F.col("l_quantity") * F.col("l_tax")),
                    "day": F.when((F.col("hour_of_day") >= 6) & (F.col("hour_of_day") < 18), 1).otherwise(0),
                },
                prefix="mine_",
            ),
            FrameFeature("centred", ("centred",), centred),
        ]
    )
    return attach(derived.obs(spark, sf), reg, Sides()).select(*IDS, *reg.columns())


@query(
    "J4 J5 D2",
    "select a.*, b.next_tree_id, b.next_girth from (select longitude, latitude, day, tree_id as past_tree_id, girth as past_girth, dist_m as past_dist_m from ("
    + _timed("tree_ts desc").format(where="where tree_ts <= ts")
    + ")) a join (select longitude, latitude, day, tree_id as next_tree_id, girth as next_girth from ("
    + _timed("abs(epoch(tree_ts) - epoch(ts))").format(where="")
    + ")) b using (longitude, latitude, day)",
    ("obs", "trees"),
)
def registered_timed_nearest(spark, sf):
    """The nearest tree in time as a registered feature, in both modes."""
    reg = Registry(
        [
            NearestFeature("trees", ("tree_id", "girth", "dist_m"), 500.0, "past_", "last_previous"),
            NearestFeature("trees", ("tree_id", "girth"), 500.0, "next_", "nearest"),
        ]
    )
    out = attach(derived.obs(spark, sf), reg, _sides(spark, sf))
    return out.select(
        "longitude", "latitude", F.date_format("ts", "yyyy-MM-dd").alias("day"), "past_tree_id", "past_girth",
        r(F.col("past_dist_m")).alias("past_dist_m"), "next_tree_id", "next_girth",
    ).distinct()


@query("D2 D3 R5")
def feature_run(spark, sf):
    """The standard set over every type, surface and material, on observations of all months and the default grid."""
    sides = _sides(spark, sf)
    types = {t.lower(): (t,) for t in _values(sides.land_use, "class_code")}
    reg = build_registry(
        (50, 70, 100), ("young", "mature", "veteran"), types, _values(sides.surfaces, "surface"),
        _values(sides.surfaces, "material"), use_column="surface", material_column="material", phase_column="phase",
    )
    reg.add(NearestFeature("trees", ("tree_id", "girth")))
    out = attach(derived.obs(spark, sf), reg, sides, Grid())
    return out.select(*IDS, "partition_key", *reg.columns())


@query(
    "§5",
    "select 'count_falls_with_radius' as broken, 0::bigint as n union all select 'fraction_outside_0_1', 0 union all select 'fraction_null', 0",
)
def feature_invariants(spark, sf):
    """Counts never fall with the radius and fractions stay in [0, 1]."""
    reg = Registry()
    for radius in (50, 100):
        reg.add(RadiusFeature("trees", radius)).add(RadiusFeature("trees", radius, planted_by=True))
        reg.add(ClassFraction(radius, (("promo", ("PROMO",)), ("rest", ("SMALL", "LARGE")))))
        reg.add(SurfaceFraction("surface", "Brand#1", radius))
    out = attach(derived.obs(spark, sf), reg, _sides(spark, sf), GRID)
    fracs = [c for c in reg.columns() if c.endswith("_frac")]
    falls = (F.col("trees_count100m_count") < F.col("trees_count50m_count")) | (
        F.col("trees_plantedby_100m_count") < F.col("trees_plantedby_50m_count")
    )
    outside, empty = F.lit(False), F.lit(False)
    for c in fracs:
        outside |= (F.col(c) < 0) | (F.col(c) > 1)
        empty |= F.col(c).isNull()
    counts = out.agg(
        F.count_if(falls).alias("a"), F.count_if(outside).alias("b"), F.count_if(empty).alias("c")
    )
    names = ("count_falls_with_radius", "fraction_outside_0_1", "fraction_null")
    return counts.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("broken"), F.col(c).alias("n")) for n, c in zip(names, "abc")]))
    )


@query(
    "P3 P7",
    f"""with places as (select longitude, latitude, row_number() over () as loc_id from (select distinct longitude, latitude from obs)),
      source as (select loc_id as id, longitude as lon, latitude as lat from places), {LAEA}
      select concat('h9_', cast(cast(q as int) as varchar), '_', cast(cast(r as int) as varchar)) as hex, round(x, 2) as x_m, round(y, 2) as y_m
      from ({_hex_sql(9).replace('from obs', 'from places')}) h join laea on h.loc_id = laea.id""",
    ("obs",),
)
def hex_and_plane(spark, sf):
    places = derived.obs(spark, sf).select("longitude", "latitude").distinct()
    plane = geo.with_projection(places, geo.laea_steps())
    return plane.select(geo.hex_key("longitude", "latitude", 9).alias("hex"), r(F.col("x_m"), 2).alias("x_m"), r(F.col("y_m"), 2).alias("y_m"))
