"""Joins on the location dimension and coverage fractions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import derive, geo
from skyloom.operators import coverage, shapes, spatial
from skyloom.operators.spatial import Measure
from skyloom.queries.base import dbl, query, r
from skyloom.session import materialise
from skyloom.sources import derived, raster

# Means of short decimals are compared divided by pi: none then sits on a rounding tie.
PLACES = "places as (select distinct loc_id, longitude, latitude from obs)"


def _dist(p: str, t: str) -> str:
    north = f"({t}.latitude - {p}.latitude) * 111320e0"
    east = f"({t}.longitude - {p}.longitude) * 111320e0 * cos(radians({p}.latitude))"
    return f"sqrt({north} * ({north}) + {east} * ({east}))"


def _pairs(side: str, radius: float, columns: str, places: str = "places") -> str:
    box = radius / 111320.0 * 1.1
    return f"""pairs as (select p.*, {columns}, {_dist('p', 't')} as dist_m from {places} p join {side} t
      on t.longitude between p.longitude - {box * 1.7:.8f} and p.longitude + {box * 1.7:.8f}
      and t.latitude between p.latitude - {box:.8f} and p.latitude + {box:.8f} where {_dist('p', 't')} <= {radius}e0)"""


def _places(spark, sf):
    return spatial.location_dimension(derived.obs(spark, sf), ["loc_id"])


@query(
    "J2 A1 P8",
    f"""with {PLACES}, {_pairs('trees', 300.0, 't.tree_id')},
      n as (select p.loc_id, count(tree_id) as n_trees from places p left join pairs using (loc_id) group by 1)
      select least(n_trees, 20) as tree_bucket, count(*) as n_obs,
        round(avg(coalesce(aster_lst, modis_lst, ndvi)), 6) as mean_temperature
      from obs join n using (loc_id) where coalesce(aster_lst, modis_lst, ndvi) is not null group by 1""",
    ("obs", "trees"),
)
def temperature_by_tree_count(spark, sf):
    obs = derived.obs(spark, sf).withColumn("temperature", derive.temperature("any"))
    places = spatial.location_dimension(obs)
    counts = spatial.radius_aggregate(
        places, derived.trees(spark, sf), [Measure("n_trees", "count", 300)]
    )
    return (
        obs.select("longitude", "latitude", "temperature").where(F.col("temperature").isNotNull())
        .join(counts, ["longitude", "latitude"])
        .groupBy(F.least("n_trees", F.lit(20)).alias("tree_bucket"))
        .agg(F.count(F.lit(1)).alias("n_obs"), r(F.avg("temperature")).alias("mean_temperature"))
    )


@query(
    "J2 A1 F5",
    f"""with {PLACES}, {_pairs('trees', 500.0, 't.girth')},
      a as (select loc_id, count(*) filter (where dist_m <= 200) as n_200, count(*) as n_500,
        round(avg(girth) filter (where dist_m <= 200) / pi(), 6) as diameter_avg_200, round(avg(girth) / pi(), 6) as diameter_avg_500,
        round(sum(girth), 6) as girth_sum_500, min(girth) as girth_min_500, max(girth) as girth_max_500 from pairs group by 1)
      select p.loc_id, coalesce(n_200, 0) as n_200, coalesce(n_500, 0) as n_500, diameter_avg_200, diameter_avg_500,
        girth_sum_500, girth_min_500, girth_max_500 from places p left join a using (loc_id)""",
    ("obs", "trees"),
)
def trees_within_radius(spark, sf):
    out = spatial.radius_aggregate(
        _places(spark, sf), derived.trees(spark, sf),
        [
            Measure("n_200", "count", 200), Measure("n_500", "count", 500),
            Measure("girth_avg_200", "avg", 200, "girth"), Measure("girth_avg_500", "avg", 500, "girth"),
            Measure("girth_sum_500", "sum", 500, "girth"), Measure("girth_min_500", "min", 500, "girth"),
            Measure("girth_max_500", "max", 500, "girth"),
        ],
    )
    return out.select(
        "loc_id", "n_200", "n_500", r(F.col("girth_avg_200") / F.pi()).alias("diameter_avg_200"),
        r(F.col("girth_avg_500") / F.pi()).alias("diameter_avg_500"), r(F.col("girth_sum_500")).alias("girth_sum_500"),
        "girth_min_500", "girth_max_500",
    )


@query(
    "A2 F6",
    f"""with {PLACES}, {_pairs('trees', 500.0, 't.phase')},
      a as (select loc_id, count(*) filter (where phase = 'mature' and dist_m <= 300) as mature_300,
        count(*) filter (where phase = 'young' and dist_m <= 300) as young_300,
        count(*) filter (where phase = 'veteran') as veteran_500 from pairs group by 1)
      select p.loc_id, coalesce(mature_300, 0) as mature_300, coalesce(young_300, 0) as young_300,
        coalesce(veteran_500, 0) as veteran_500 from places p left join a using (loc_id)""",
    ("obs", "trees"),
)
def trees_by_phase(spark, sf):
    def phase(name: str, radius: int) -> Measure:
        return Measure(f"{name}_{radius}", "count", radius, match=(("phase", name),))

    return spatial.radius_aggregate(
        _places(spark, sf), derived.trees(spark, sf),
        [phase("mature", 300), phase("young", 300), phase("veteran", 500)],
    ).drop("longitude", "latitude")


@query(
    "A5 F7 J6",
    f"""with places as (select distinct longitude, latitude from obs),
      years as (select distinct longitude, latitude, year from obs),
      {_pairs('trees', 500.0, 't.planting_year, t.phase')},
      a as (select y.longitude, y.latitude, y.year, count(*) filter (where dist_m <= 300) as planted_300, count(*) as planted_500,
        count(*) filter (where phase = 'young') as planted_500_young
        from years y join pairs p on y.longitude = p.longitude and y.latitude = p.latitude and p.planting_year <= y.year group by 1, 2, 3)
      select y.*, coalesce(planted_300, 0) as planted_300, coalesce(planted_500, 0) as planted_500,
        coalesce(planted_500_young, 0) as planted_500_young from years y left join a using (longitude, latitude, year)""",
    ("obs", "trees"),
)
def trees_planted_by_scene(spark, sf):
    years = materialise(derived.obs(spark, sf).select("longitude", "latitude", "year").distinct())
    return spatial.planted_by(
        years, derived.trees(spark, sf),
        [
            Measure("planted_300", "count", 300), Measure("planted_500", "count", 500),
            Measure("planted_500_young", "count", 500, match=(("phase", "young"),)),
        ],
    )


@query(
    "A1 J6",
    f"""with places as (select distinct longitude, latitude from obs),
      years as (select distinct longitude, latitude, year from obs),
      {_pairs('dhm', 800.0, 't.elevation, t.dhm_year')},
      s as (select longitude, latitude, dhm_year, count(*) as n, avg(elevation) as e_avg, max(elevation) as e_max, min(elevation) as e_min
        from pairs group by 1, 2, 3),
      k as (select *, (select max(dhm_year) from dhm where dhm_year <= years.year) as dhm_year from years)
      select k.longitude, k.latitude, k.year, coalesce(n, 0) as dhm_count, round(e_avg / pi(), 6) as dhm_avg_by_pi, e_max as dhm_max, e_min as dhm_min
      from k left join s using (longitude, latitude, dhm_year)""",
    ("obs", "dhm"),
)
def elevation_last_survey(spark, sf):
    years = materialise(derived.obs(spark, sf).select("longitude", "latitude", "year").distinct())
    out = spatial.radius_as_of_survey(
        years, derived.dhm(spark, sf),
        [
            Measure("dhm_count", "count", 800), Measure("dhm_avg", "avg", 800, "elevation"),
            Measure("dhm_max", "max", 800, "elevation"), Measure("dhm_min", "min", 800, "elevation"),
        ],
        survey_year="dhm_year",
    )
    return out.withColumn("dhm_avg_by_pi", r(F.col("dhm_avg") / F.pi())).drop("dhm_avg")


@query(
    "A1",
    f"""with {PLACES}, {_pairs('dhm', 800.0, 't.elevation')},
      a as (select loc_id, count(*) as n, round(avg(elevation) / pi(), 6) as e_avg_by_pi from pairs group by 1)
      select p.loc_id, coalesce(n, 0) as n, e_avg_by_pi from places p left join a using (loc_id)""",
    ("obs", "dhm"),
)
def elevation_all_surveys(spark, sf):
    return spatial.radius_aggregate(
        _places(spark, sf), derived.dhm(spark, sf),
        [Measure("n", "count", 800), Measure("e_avg", "avg", 800, "elevation")],
    ).select("loc_id", "n", r(F.col("e_avg") / F.pi()).alias("e_avg_by_pi"))


@query(
    "J3 W1",
    f"""with {PLACES}, {_pairs('trees', 500.0, 't.tree_id, t.girth, t.phase')},
      k as (select *, row_number() over (partition by loc_id order by dist_m, tree_id) as k from pairs)
      select p.loc_id, k.tree_id as near_tree_id, k.girth as near_girth, k.phase as near_phase, round(k.dist_m, 6) as near_dist_m
      from places p left join (select * from k where k = 1) k using (loc_id)""",
    ("obs", "trees"),
)
def nearest_tree(spark, sf):
    out = spatial.nearest(
        _places(spark, sf), derived.trees(spark, sf), ["tree_id", "girth", "phase"], 500, "tree_id", "near_"
    )
    return out.drop("longitude", "latitude").withColumn("near_dist_m", r(F.col("near_dist_m")))


def _timed(order: str) -> str:
    return f"""with places as (select distinct longitude, latitude, ts from obs),
      {_pairs('trees', 500.0, 't.tree_id, t.girth, t.ts as tree_ts')},
      k as (select *, row_number() over (partition by longitude, latitude, ts order by {order}, dist_m, tree_id) as k
        from pairs {{where}})
      select p.longitude, p.latitude, strftime(p.ts, '%Y-%m-%d') as day, k.tree_id, k.girth, round(k.dist_m, 6) as dist_m,
        strftime(k.tree_ts, '%Y-%m-%d') as tree_day
      from places p left join (select * from k where k = 1) k using (longitude, latitude, ts)"""


def _timed_nearest(spark, sf, temporal):
    driving = materialise(derived.obs(spark, sf).select("longitude", "latitude", "ts").distinct())
    out = spatial.nearest_as_of(
        driving, derived.trees(spark, sf), ["tree_id", "girth"], 500, "tree_id", temporal, prefix="hit_"
    )
    return out.select(
        "longitude", "latitude", F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("hit_tree_id").alias("tree_id"), F.col("hit_girth").alias("girth"),
        r(F.col("hit_dist_m")).alias("dist_m"), F.date_format("hit_ts", "yyyy-MM-dd").alias("tree_day"),
    )


@query("J4 F8", _timed("tree_ts desc").format(where="where tree_ts <= ts"), ("obs", "trees"))
def nearest_tree_last_previous(spark, sf):
    return _timed_nearest(spark, sf, "last_previous")


@query(
    "J5",
    _timed("abs(epoch(tree_ts) - epoch(ts))").format(where=""),
    ("obs", "trees"),
)
def nearest_tree_in_time(spark, sf):
    return _timed_nearest(spark, sf, "nearest")


@query(
    "J7",
    f"""with {PLACES}, hit as (select p.loc_id, min(q.poly_id) as poly_id from places p join polys q
        on p.longitude >= x0 and p.longitude < x1 and p.latitude >= y0 and p.latitude < y1 group by 1)
      select p.loc_id, poly_id from places p left join hit using (loc_id)""",
    ("obs", "polys"),
)
def containing_polygon(spark, sf):
    return spatial.within_polygon(_places(spark, sf), derived.polys(spark, sf), "poly_id").select(
        "loc_id", "poly_id"
    )


@query(
    "J1",
    """with pix as (select l_suppkey as scene_id, l_partkey % 97 as cx, l_partkey % 83 as cy,
        case l_linenumber % 3 when 0 then 'ASTER' when 1 then 'MODIS' else 'NDVI' end as product, l_quantity as value from lineitem)
      select scene_id, 3.57e0 + cx * 0.003e0 as longitude, 50.96e0 + cy * 0.003e0 as latitude,
        max(value) filter (where product = 'ASTER') as aster_lst, max(value) filter (where product = 'MODIS') as modis_lst,
        max(value) filter (where product = 'NDVI') as ndvi from pix group by scene_id, cx, cy""",
)
def merged_products(spark, sf):
    pixels = derived.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as scene_id", "3.57e0 + (l_partkey % 97) * 0.003e0 as longitude",
        "50.96e0 + (l_partkey % 83) * 0.003e0 as latitude",
        "case l_linenumber % 3 when 0 then 'ASTER' when 1 then 'MODIS' else 'NDVI' end as product",
        "l_quantity as value",
    )
    return raster.merge_products(
        pixels, ["scene_id"], {"ASTER": "aster_lst", "MODIS": "modis_lst", "NDVI": "ndvi"}
    )


# --- coverage ----------------------------------------------------------------------

GRID = coverage.Grid()


def _kernel_values(radius: float) -> str:
    rows = []
    for dy, steps in GRID.kernel(radius).items():
        reach = max(h for h, _ in steps)
        rows += [
            f"({dx},{dy},{sum(n for h, n in steps if abs(dx) <= h)})" for dx in range(-reach, reach + 1)
        ]
    return ", ".join(rows)


def _index(value: str, origin: float, step: float) -> str:
    return f"cast(ceil(({value} - {dbl(origin)}) / {dbl(step / GRID.supersample)}) as int)"


_TARGETS = f"""targets as (select distinct
  greatest(0, least({GRID.n_lon - 1}, cast(round_even((longitude - {dbl(GRID.lon0)}) / {dbl(GRID.step_lon)}, 0) as int))) as ix,
  greatest(0, least({GRID.n_lat - 1}, cast(round_even((latitude - {dbl(GRID.lat0)}) / {dbl(GRID.step_lat)}, 0) as int))) as iy from obs)"""
_CELLED = f"""celled as (select *, {_index('x0', GRID.lon0, GRID.step_lon)} as xa, {_index('x1', GRID.lon0, GRID.step_lon)} - 1 as xb,
  {_index('y0', GRID.lat0, GRID.step_lat)} as ya, {_index('y1', GRID.lat0, GRID.step_lat)} - 1 as yb from polys)"""


def _fractions_sql(radius: float, layer: str = "class_code, survey_year") -> str:
    k = GRID.kernel(radius)
    reach = max(max(abs(d) for d in k), max(h for s in k.values() for h, _ in s))
    total = coverage.kernel_total(k)
    return f"""near as (select t.ix, t.iy, {layer}, xa, xb, ya, yb from targets t join celled c
        on c.xb >= t.ix * {GRID.supersample} - {reach} and c.xa <= t.ix * {GRID.supersample} + {reach}
        and c.yb >= t.iy * {GRID.supersample} - {reach} and c.ya <= t.iy * {GRID.supersample} + {reach}),
      touched as (select distinct ix, iy, {layer}, dx, dy, w from near join
        (select * from (values {_kernel_values(radius)}) as k(dx, dy, w)) k
        on ix * {GRID.supersample} + dx between xa and xb and iy * {GRID.supersample} + dy between ya and yb),
      fracs as (select ix, iy, {layer}, least(1e0, sum(w) / {dbl(float(total))}) as frac from touched group by ix, iy, {layer})"""


def _targets(spark, sf):
    return derived.obs(spark, sf).select("longitude", "latitude").distinct().select(
        *[c.alias(n) for n, c in GRID.snap().items()]
    ).distinct()


@query(
    "R1 R3 R4 R5 J8",
    f"with {_TARGETS}, {_CELLED}, {_fractions_sql(60.0)} select ix, iy, class_code, survey_year, round(frac, 9) as frac_60 from fracs",
    ("obs", "polys"),
)
def class_coverage(spark, sf):
    out = coverage.coverage(
        derived.polys(spark, sf), ["class_code", "survey_year"], "poly_id", _targets(spark, sf), [60.0], GRID
    )
    return out.withColumn("frac_60", r(F.col("frac_60"), 9))


@query(
    "R3",
    f"""with {_CELLED} select class_code, survey_year, sum(least(yb, {GRID.n_lat * GRID.supersample + 256}) - greatest(ya, -256) + 1) as n_runs,
      sum((least(xb, {GRID.n_lon * GRID.supersample + 256}) - greatest(xa, -256) + 1) * (least(yb, {GRID.n_lat * GRID.supersample + 256}) - greatest(ya, -256) + 1)) as n_cells
      from celled where yb >= ya and xb >= xa group by 1, 2""",
    ("polys",),
)
def rasterised_polygons(spark, sf):
    runs = coverage.polygon_runs(
        derived.polys(spark, sf), ["class_code", "survey_year"], "poly_id", GRID
    )
    return runs.groupBy("class_code", "survey_year").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("xb") - F.col("xa") + 1).alias("n_cells")
    )


@query(
    "R10",
    f"""with {_TARGETS}, {_CELLED}, {_fractions_sql(60.0)} select class_code, survey_year, count(*) as n_cells,
      round(max(frac), 9) as max_frac from fracs where frac > 1e-6 group by 1, 2""",
    ("obs", "polys"),
)
def coverage_summary(spark, sf):
    out = coverage.coverage(
        derived.polys(spark, sf), ["class_code", "survey_year"], "poly_id", _targets(spark, sf), [60.0], GRID
    )
    return coverage.layer_summary(out, ["class_code", "survey_year"], "frac_60").withColumn(
        "max_frac", r(F.col("max_frac"), 9)
    )


CLASSES = {"small_kind": ["SMALL", "MEDIUM"], "large_kind": ["LARGE", "PROMO"], "plain": ["STANDARD"]}
_CLASS_CASE = "case class_code " + " ".join(
    f"when '{c}' then '{k}'" for k, v in CLASSES.items() for c in v
) + " end"


@query(
    "R6 J6 J9",
    f"""with {_TARGETS}, {_CELLED}, {_fractions_sql(60.0)},
      asked as (select distinct greatest(0, least({GRID.n_lon - 1}, cast(round_even((longitude - {dbl(GRID.lon0)}) / {dbl(GRID.step_lon)}, 0) as int))) as ix,
        greatest(0, least({GRID.n_lat - 1}, cast(round_even((latitude - {dbl(GRID.lat0)}) / {dbl(GRID.step_lat)}, 0) as int))) as iy, year from obs),
      years as (select distinct survey_year from polys),
      s as (select a.*, (select max(survey_year) from years where survey_year <= a.year) as survey_year from asked a)
      select s.ix, s.iy, s.year, round(coalesce(frac, 0), 9) as ua_luc_promo_60m_frac from s left join
        (select * from fracs where class_code = 'PROMO') f on s.ix = f.ix and s.iy = f.iy and s.survey_year = f.survey_year""",
    ("obs", "polys"),
)
def class_fraction_as_of(spark, sf):
    """Share of one class in the last survey not after the scene; 0 before the first."""
    from skyloom.plans.features import fraction_as_of

    promo = derived.polys(spark, sf).where(F.col("class_code") == "PROMO")
    fractions = coverage.coverage(
        promo, ["class_code", "survey_year"], "poly_id", _targets(spark, sf), [60.0], GRID
    )
    asked = derived.obs(spark, sf).select("longitude", "latitude", "year").distinct().select(
        *[c.alias(n) for n, c in GRID.snap().items()], "year"
    ).distinct()
    years = [row[0] for row in derived.polys(spark, sf).select("survey_year").distinct().collect()]
    out = fraction_as_of(asked, fractions, "survey_year", years, ["frac_60"])
    return out.select("ix", "iy", "year", r(F.col("frac_60"), 9).alias("ua_luc_promo_60m_frac"))


@query(
    "R7",
    f"""with {_TARGETS}, {_CELLED}, {_fractions_sql(60.0)}
      select ix, iy, survey_year, {_CLASS_CASE} as class, round(least(1, sum(frac)), 9) as frac_60 from fracs
      where {_CLASS_CASE} is not null group by 1, 2, 3, 4""",
    ("obs", "polys"),
)
def grouped_class_fractions(spark, sf):
    out = coverage.coverage(
        derived.polys(spark, sf), ["class_code", "survey_year"], "poly_id", _targets(spark, sf), [60.0], GRID
    )
    grouped = coverage.group_codes(out, "class_code", CLASSES, ["ix", "iy", "survey_year"], ["frac_60"])
    return grouped.withColumn("frac_60", r(F.col("frac_60"), 9))


@query(
    "R8 J9",
    f"""with {_TARGETS}, {_CELLED}, {_fractions_sql(60.0, 'surface')} select ix, iy,
      concat('wis_', replace(surface, '#', '_'), '_60m_frac') as feature, round(frac, 9) as frac_60 from fracs""",
    ("obs", "polys"),
)
def road_fractions(spark, sf):
    out = coverage.coverage(
        derived.polys(spark, sf), ["surface"], "poly_id", _targets(spark, sf), [60.0], GRID
    )
    return out.select(
        "ix", "iy", F.concat(F.lit("wis_"), F.translate("surface", " /#", "___"), F.lit("_60m_frac")).alias("feature"),
        r(F.col("frac_60"), 9).alias("frac_60"),
    )


def _disk_part(x: str, y: str, radius: float) -> str:
    """Area of a disk around the origin left of ``x`` and below ``y``, less that of its lower half there."""
    x, y, rr = f"greatest({-radius}e0, least({radius}e0, {x}))", f"greatest({-radius}e0, least({radius}e0, {y}))", f"{radius * radius}e0"
    left = f"(-sqrt({rr} - ({y}) * ({y})))"
    right = f"sqrt({rr} - ({y}) * ({y}))"
    chord = lambda v: f"(({v}) * sqrt(greatest(0e0, {rr} - ({v}) * ({v}))) + {rr} * asin(({v}) / {radius}e0)) / 2e0"
    low, high, flat = f"least({x}, {left})", f"greatest({x}, {right})", f"greatest({left}, least({x}, {right}))"
    curved = f"({chord(low)} - {chord(f'{-radius}e0')} + {chord(high)} - {chord(right)})"
    return f"(sign({y}) * {curved} + ({y}) * ({flat} - {left}))"


def _exact_sql(radius: float) -> str:
    """The exact share of each disk and rectangle: four corners of the integral of the height."""
    corner = {(i, j): _disk_part(f"u{i}", f"v{j}", radius) for i in (0, 1) for j in (0, 1)}
    area = f"({corner[1, 1]} - {corner[0, 1]} - {corner[1, 0]} + {corner[0, 0]})"
    sx, sy = dbl(geo.LON_DEG_PER_M), dbl(geo.LAT_DEG_PER_M)
    lon, lat = f"({dbl(GRID.lon0)} + ix * {dbl(GRID.step_lon)})", f"({dbl(GRID.lat0)} + iy * {dbl(GRID.step_lat)})"
    return f"""offsets as (select ix, iy, poly_id, (x0 - {lon}) / {sx} as u0, (x1 - {lon}) / {sx} as u1, (y0 - {lat}) / {sy} as v0, (y1 - {lat}) / {sy} as v1
        from targets join polys on x0 <= {lon} + {radius}e0 * {sx} and x1 >= {lon} - {radius}e0 * {sx} and y0 <= {lat} + {radius}e0 * {sy} and y1 >= {lat} - {radius}e0 * {sy}),
      exact as (select ix, iy, poly_id, {area} / (pi() * {radius * radius}e0) as share from offsets)"""


def _exact(spark, sf, polys, targets, radius):
    centres = targets.withColumns({
        "longitude": F.lit(GRID.lon0) + F.col("ix") * F.lit(GRID.step_lon), "latitude": F.lit(GRID.lat0) + F.col("iy") * F.lit(GRID.step_lat),
    })
    return coverage.exact_shares(polys, "poly_id", centres, ["ix", "iy"], [radius])


@query(
    "R2 J8",
    f"with {_TARGETS}, {_exact_sql(60.0)} select ix, iy, poly_id, round(share, 6) as share_60 from exact where round(share, 6) > 0",
    ("obs", "polys"),
)
def exact_disk_shares(spark, sf):
    """The share of every disk that every polygon covers, by closed-form areas of its edges."""
    out = _exact(spark, sf, derived.polys(spark, sf), _targets(spark, sf), 60.0)
    return out.withColumn("share_60", r(F.col("share_60"), 6)).where("share_60 > 0")


@query(
    "R2 R9",
    f"""with {_TARGETS}, {_CELLED}, {_fractions_sql(60.0, 'poly_id')}, {_exact_sql(60.0)},
      both_ as (select coalesce(f.frac, 0) as approx, coalesce(e.share, 0) as truth from fracs f full join (select * from exact where share > 1e-12) e using (ix, iy, poly_id))
      select case when approx > 0 then 'nonzero' else 'zero' end as kind, count(*) as n,
        count(*) filter (case when approx > 0 then abs(approx - truth) <= 0.01e0 else truth <= 0.005e0 and approx <= 0.005e0 end) as n_pass,
        round(avg(abs(approx - truth)), 6) as err_mean, round(max(abs(approx - truth)), 6) as err_max from both_ group by 1""",
    ("obs", "polys"),
)
def coverage_accuracy(spark, sf):
    """Rasterised against exact shares, on every disk that a polygon touches."""
    polys, targets = materialise(derived.polys(spark, sf)), materialise(_targets(spark, sf))
    rough = coverage.coverage(polys, ["poly_id"], "poly_id", targets, [60.0], GRID)
    truth = _exact(spark, sf, polys, targets, 60.0).withColumnRenamed("share_60", "frac_60")
    out = coverage.accuracy_report(rough, truth, ["poly_id", "ix", "iy"], "frac_60", by=[])
    return out.select("kind", "n", "n_pass", r(F.col("err_mean"), 6).alias("err_mean"), r(F.col("err_max"), 6).alias("err_max"))


@query(
    "J9",
    f"""select distinct longitude, latitude,
      greatest(0, least({GRID.n_lon - 1}, cast(round_even((longitude - {dbl(GRID.lon0)}) / {dbl(GRID.step_lon)}, 0) as int))) as ix,
      greatest(0, least({GRID.n_lat - 1}, cast(round_even((latitude - {dbl(GRID.lat0)}) / {dbl(GRID.step_lat)}, 0) as int))) as iy from obs""",
    ("obs",),
)
def snapped_locations(spark, sf):
    places = derived.obs(spark, sf).select("longitude", "latitude").distinct()
    return places.withColumns(GRID.snap())


@query(
    "J15",
    """with tiles as (select distinct split_part(tile_id, '_', 1)::int as q, split_part(tile_id, '_', 2)::int as r from obs)
      select concat(a.q, '_', a.r) as tile, count(*) as n_neighbours from tiles a join tiles b
      on (b.q - a.q, b.r - a.r) in ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) group by 1""",
    ("obs",),
)
def ring_one_neighbours(spark, sf):
    from skyloom.operators.autocorrelation import neighbour_edges

    parts = F.split("tile_id", "_")
    tiles = derived.obs(spark, sf).select("tile_id").distinct().select(
        F.col("tile_id").alias("tile"), parts[0].cast("int").alias("q"), parts[1].cast("int").alias("r")
    )
    return neighbour_edges(tiles).groupBy(F.col("src").alias("tile")).agg(
        F.count(F.lit(1)).alias("n_neighbours")
    )


# --- shapes ------------------------------------------------------------------------

# Points on a whole-number grid, so that no turn is a matter of rounding.
_SPOTS = "select c_nationkey as g, ((c_custkey * 6151) % 9700)::double as x, ((c_custkey * 3571) % 8300)::double as y from customer"
_HULLS = f"""spots as (select distinct g, x, y from ({_SPOTS})),
  edges as (select a.g, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from spots a join spots b on a.g = b.g and (a.x <> b.x or a.y <> b.y)
    where not exists (select 1 from spots c where c.g = a.g and ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
      or ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 and (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0))))"""


def _hulls(spark, sf):
    spots = derived.table(spark, sf, "customer").selectExpr(
        "c_nationkey as g", "cast((c_custkey * 6151) % 9700 as double) as x", "cast((c_custkey * 3571) % 8300 as double) as y"
    )
    return shapes.convex_hulls(spots, ["g"], "x", "y")


@query(
    "S3 P14",
    f"""with {_HULLS}, sides as (select *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) as len from edges),
      boxes as (select e.g, e.ax, e.ay, e.bx, e.by_, (max(s.x * (e.bx - e.ax) + s.y * (e.by_ - e.ay)) - min(s.x * (e.bx - e.ax) + s.y * (e.by_ - e.ay)))
          * max((s.y - e.ay) * (e.bx - e.ax) - (s.x - e.ax) * (e.by_ - e.ay)) / (e.len * e.len) as area
        from sides e join spots s on s.g = e.g group by e.g, e.ax, e.ay, e.bx, e.by_, e.len)
      select g, (select count(*) from edges e where e.g = b.g) as n_corners, (select round(sum(ax * by_ - ay * bx) / 2e0, 3) from edges e where e.g = b.g) as hull_area,
        round(min(area), 3) as rectangle_area from boxes b group by g""",
)
def boundary_hulls(spark, sf):
    """The hull of every nation's points, its corners and area, and its least rotated rectangle."""
    out = _hulls(spark, sf)
    return out.select(
        "g", (F.size("ring") - 1).cast("long").alias("n_corners"), r(geo.ring_area(F.col("ring")), 3).alias("hull_area"),
        r(shapes.rectangle_of(F.col("ring"))["area"], 3).alias("rectangle_area"),
    )


@query(
    "S3 J10",
    f"""with {_HULLS}, pixels as (select o_orderkey, (o_orderkey % 9700)::double as px, ((o_orderkey * 7) % 8300)::double as py from orders)
      select g, count(*) as n from pixels, (select distinct g from spots where g % 5 = 0) h
      where not exists (select 1 from edges e where e.g = h.g and (bx - ax) * (py - ay) - (by_ - ay) * (px - ax) < 0) group by 1""",
)
def pixels_in_hull(spark, sf):
    """Pixels that lie in each boundary's hull, as the vegetation index is clipped."""
    pixels = derived.table(spark, sf, "orders").selectExpr("cast(o_orderkey % 9700 as double) as px", "cast((o_orderkey * 7) % 8300 as double) as py")
    held = shapes.points_in_hulls(pixels, _hulls(spark, sf).where("g % 5 = 0"), "px", "py", 1000.0)
    return held.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("S3")
def hulls_of_few_corners(spark, sf):
    """Hulls cut down to five corners: how many each has, and how much larger it is."""
    rings = _hulls(spark, sf).select("g", "ring", shapes.simplified(F.col("ring"), 5).alias("few"))
    return rings.select("g", (F.size("few") - 1).alias("n_corners"), (geo.ring_area(F.col("few")) / geo.ring_area(F.col("ring"))).alias("growth"))
