"""Scans, sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import derive, geo
from skyloom.operators import spatial
from skyloom.queries.projected_sql import LAEA, LAMBERT, rect_sql
from skyloom.queries.base import OBS_TIES, ORDER_RANGE, ORDER_SQL, dbl, query, r
from skyloom.session import new_table_path
from skyloom.sources import derived, polygons, raster, tables, tiff, trees



def _month_table(spark: SparkSession, sf: str) -> str:
    """Observations written as a table with one directory per month."""
    path = new_table_path(spark, "months")
    tables.clustered_write(derived.obs(spark, sf), path)
    return path


@query(
    "S1 F1",
    """select l_orderkey, l_linenumber, loc_id, partition_key, longitude, latitude, aster_lst
       from obs where partition_key in ('1996-03', '1997-07')""",
    ("obs",),
)
def partition_scan(spark, sf):
    return tables.scan(
        spark, _month_table(spark, sf), ["1996-03", "1997-07"],
        ["l_orderkey", "l_linenumber", "loc_id", "partition_key", "longitude", "latitude", "aster_lst"],
    )


_CELLS_SQL = """
cells as (select l_suppkey as scene_id,
  case l_linenumber % 3 when 0 then 'ASTER' when 1 then 'MODIS' else 'NDVI' end as product,
  l_partkey % 83 as row, l_partkey % 97 as col,
  case when l_quantity < 5 then -9999e0 when l_quantity < 8 then 0e0 else l_quantity end as value
  from lineitem),
geot as (select s_suppkey as scene_id, 3.5685e0 as x0, 51.2105e0 as y0, 0.003e0 as dx, 0.003e0 as dy from supplier)
"""
_PIXEL_SQL = """select scene_id, product, value, x0 + (col + 0.5e0) * dx as longitude,
  y0 - (row + 0.5e0) * dy as latitude from cells join geot using (scene_id)"""


def _cells(spark, sf) -> tuple[DataFrame, DataFrame]:
    cells = derived.table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as scene_id",
        "case l_linenumber % 3 when 0 then 'ASTER' when 1 then 'MODIS' else 'NDVI' end as product",
        "l_partkey % 83 as row", "l_partkey % 97 as col",
        "case when l_quantity < 5 then -9999e0 when l_quantity < 8 then 0e0 else l_quantity end as value",
    )
    geot = derived.table(spark, sf, "supplier").selectExpr(
        "s_suppkey as scene_id", "3.5685e0 as x0", "51.2105e0 as y0", "0.003e0 as dx", "0.003e0 as dy"
    )
    return cells, geot


@query("S2", f"with {_CELLS_SQL} {_PIXEL_SQL} where value <> -9999e0 and value <> 0e0")
def raster_pixels(spark, sf):
    cells, geot = _cells(spark, sf)
    out = raster.pixel_rows(cells, geot, ["scene_id"], nodata=-9999.0)
    return out.select("scene_id", "product", "value", "longitude", "latitude")


@query(
    "S2 S8",
    f"""with {_CELLS_SQL}, best as (select scene_id, row, col, max(value) as value from cells where row between 20 and 60 group by 1, 2, 3)
      select scene_id, value, 3.5685e0 + (col + 0.5e0) * 0.003e0 as longitude, 51.2105e0 - (row + 0.5e0) * 0.003e0 as latitude from best where value <> -9999e0""",
)
def raster_files(spark, sf):
    """Cells written as raster files, one a scene, and some of their rows read back as a table."""
    cells, _ = _cells(spark, sf)
    folder = new_table_path(spark, "rasters")
    tiff.write_rasters(cells, "scene_id", folder, (83, 97), (3.5685, 51.2105), (0.003, 0.003)).write.format("noop").mode("overwrite").save()
    read = tiff.read_rasters(spark, folder).where("row >= 20 and row <= 60 and value is not null")
    scene = F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long")
    return read.select(scene.alias("scene_id"), "value", F.col("x").alias("longitude"), F.col("y").alias("latitude"))


# A concave boundary with a hole.
_BOUNDARY = [
    [(3.60, 50.98), (3.80, 50.99), (3.83, 51.15), (3.72, 51.06), (3.62, 51.18), (3.60, 50.98)],
    [(3.66, 51.02), (3.70, 51.02), (3.70, 51.05), (3.66, 51.05), (3.66, 51.02)],
]


def _boundary():
    return F.array(
        *[
            F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
            for ring in _BOUNDARY
        ]
    )


_EDGES_SQL = "edges(xa, ya, xb, yb) as (values {})".format(
    ", ".join(
        f"({dbl(a[0])}, {dbl(a[1])}, {dbl(b[0])}, {dbl(b[1])})"
        for ring in _BOUNDARY for a, b in zip(ring, ring[1:])
    )
)
_INSIDE_SQL = """(select count(*) from edges where (ya > latitude) <> (yb > latitude)
  and longitude < (xb - xa) * (latitude - ya) / (yb - ya) + xa) % 2 = 1"""


@query(
    "S3 F4",
    f"with {_CELLS_SQL}, {_EDGES_SQL}, pix as ({_PIXEL_SQL} where value <> -9999e0 and value <> 0e0) "
    f"select * from pix where {_INSIDE_SQL}",
)
def raster_pixels_in_boundary(spark, sf):
    cells, geot = _cells(spark, sf)
    out = raster.masked_pixel_rows(cells, geot, ["scene_id"], _boundary(), nodata=-9999.0)
    return out.select("scene_id", "product", "value", "longitude", "latitude")


@query(
    "F4",
    f"with {_EDGES_SQL}, places as (select distinct loc_id, longitude, latitude from obs) "
    f"select * from places where {_INSIDE_SQL}",
    ("obs",),
)
def points_in_boundary(spark, sf):
    places = derived.obs(spark, sf).select("loc_id", "longitude", "latitude").distinct()
    return spatial.polygon_filter(places, _boundary())


_TREE_TEXT = """select o_orderkey as tree_id,
  case when o_orderkey % 11 = 0 then null else concat(cast(50.96e0 + (o_orderkey % 83) * 0.003e0 as string), ', ', cast(3.57e0 + (o_orderkey % 97) * 0.003e0 as string)) end as Geo_Point_2D,
  case o_orderkey % 6 when 0 then 'Tilia cordata' when 1 then 'Ulmaceae zelkova' when 2 then 'Te Bepalen' when 3 then '' when 4 then 'nan' else concat('  ', upper(o_orderpriority), ' alba') end as Sortiment,
  case when o_orderkey % 5 = 0 then 'None' else cast(o_orderkey % 40 as string) end as HOOGTE,
  case when o_orderkey % 4 = 0 then concat(cast(year(o_orderdate) as string), '.0') when o_orderkey % 4 = 1 then '0' else 'unknown' end as aanlegjaar,
  case when o_orderkey % 3 = 0 then 'nan' else cast(o_totalprice as string) end as stamomtrek,
  case o_orderstatus when 'F' then 'Volwassenfase' when 'O' then 'Jeugdfase' else '' end as beheerfase
from {orders}"""


@query(
    "S4 S5 P9",
    """select o_orderkey as tree_id, 3.57e0 + (o_orderkey % 97) * 0.003e0 as longitude,
         50.96e0 + (o_orderkey % 83) * 0.003e0 as latitude,
         case o_orderkey % 6 when 0 then 'Tilia cordata' when 1 then 'Ulmaceae zelkova' when 2 then 'Te Bepalen'
           when 5 then concat('  ', upper(o_orderpriority), ' alba') end as species,
         case when o_orderkey % 5 <> 0 then cast(o_orderkey % 40 as varchar) end as height,
         case when o_orderkey % 4 = 0 then cast(year(o_orderdate) as int) end as planting_year,
         case when o_orderkey % 3 <> 0 then o_totalprice end as girth,
         case o_orderstatus when 'F' then 'Volwassenfase' when 'O' then 'Jeugdfase' end as phase,
         case o_orderkey % 6 when 0 then 'Tilia' when 1 then 'Zelkova'
           when 5 then concat(substr(o_orderpriority, 1, 1), lower(substr(split_part(o_orderpriority, ' ', 1), 2))) end as genus
       from orders where o_orderkey % 11 <> 0""",
)
def tree_inventory(spark, sf):
    raw = spark.sql(_TREE_TEXT, orders=derived.table(spark, sf, "orders"))
    return trees.parse_trees(raw, keep=["tree_id"])


@query(
    "S5",
    """select p_partkey as luc_id, p_type as luc_code, p_name as luc_name, cast(null as varchar) as luc_note from part""",
)
def candidate_columns(spark, sf):
    shouting = derived.table(spark, sf, "part").selectExpr(
        "p_partkey as FID", "p_type as CODE_2018", "p_name as Class_Name"
    )
    return tables.rename_candidates(
        shouting,
        {
            "luc_id": ["objectid", "fid"],
            "luc_code": polygons.LAND_USE_CODE_COLUMNS,
            "luc_name": ["class_name", "name"],
            "luc_note": ["note", "comment"],
        },
    )


def _road_lines(spark, sf):
    """GeoJSON feature text."""
    return derived.polys(spark, sf).selectExpr(
        "poly_id",
        """to_json(struct('Feature' as type,
             map('bestemming', case when poly_id % 7 = 0 then '' else surface end, 'materiaalsoort', case when poly_id % 5 = 0 then '' else class_code end, 'id', cast(poly_id as string)) as properties,
             struct(if(poly_id % 2 = 0, 'Polygon', 'MultiPolygon') as type,
               if(poly_id % 2 = 0, to_json(array(array(array(x0,y0),array(x1,y0),array(x1,y1),array(x0,y1),array(x0,y0)))),
                  to_json(array(array(array(array(x0,y0),array(x1,y0),array(x1,y1),array(x0,y1),array(x0,y0)))))) as coordinates) as geometry)) as line""",
    )


def _road_features(spark, sf):
    """GeoJSON feature text, parsed back."""
    return _road_lines(spark, sf).select(
        "poly_id", F.from_json("line", f"struct<{polygons.FEATURE_FIELDS}>").alias("f")
    ).select("poly_id", "f.*")


@query(
    "S6 P13",
    """select cast(poly_id as varchar) as id, case when poly_id % 7 <> 0 then surface end as bestemming,
         case when poly_id % 5 <> 0 then class_code end as materiaalsoort, 1 as n_rings, 5 as n_points from polys""",
    ("polys",),
)
def road_features(spark, sf):
    """Features from files that Spark wrote, each a collection, read in splits."""
    path = new_table_path(spark, "features")
    _road_lines(spark, sf).select(F.concat("line", F.lit(",")).alias("line")).write.text(path)
    out = polygons.features_to_polygons(polygons.read_feature_collection(spark, path), ["id", "bestemming", "materiaalsoort"])
    return out.select(
        "id", "bestemming", "materiaalsoort", F.size("rings").alias("n_rings"),
        F.size(F.flatten("rings")).alias("n_points"),
    )


@query(
    "A11",
    """select property, n_features, n_filled from (
         select 'bestemming' as property, count(*) as n_features, count(*) filter (where poly_id % 7 <> 0) as n_filled from polys
         union all select 'materiaalsoort', count(*), count(*) filter (where poly_id % 5 <> 0) from polys
         union all select 'id', count(*), count(*) from polys)""",
    ("polys",),
)
def property_frequency(spark, sf):
    return polygons.property_frequency(_road_features(spark, sf)).drop("n_values_approx")


@query(
    "A11",
    """select case when poly_id % 2 = 0 then 'Polygon' else 'MultiPolygon' end as geometry_type,
       count(*) as n_features from polys group by 1""",
    ("polys",),
)
def geometry_types(spark, sf):
    return polygons.geometry_types(_road_features(spark, sf))


@query(
    "S7 U1",
    """select class_code as luc_code, survey_year as ua_year, count(*) as n,
         round(sum(x1 - x0), 6) as width from polys group by 1, 2""",
    ("polys",),
)
def land_use_union(spark, sf):
    p = derived.polys(spark, sf)
    names = {1994: "CODE_2006", 1996: "code_2012", 1998: "Code_2018", 2000: "code_2021"}
    surveys = {
        y: p.where(F.col("survey_year") == y).select(F.col("class_code").alias(n), "rings")
        for y, n in names.items()
    }
    box = geo.rings_bbox("rings")
    return polygons.land_use_union(surveys).groupBy("luc_code", "ua_year").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(box["x1"] - box["x0"])).alias("width")
    )


@query(
    "S8",
    """select longitude, latitude, elevation, is_water, cast(dhm_year as smallint) as dhm_year from dhm""",
    ("dhm",),
)
def elevation_rows(spark, sf):
    pixels = derived.dhm(spark, sf).withColumn(
        "value", F.when(F.col("is_water"), F.lit(-9999.0)).otherwise(F.col("elevation"))
    )
    return raster.elevation_rows(pixels, F.col("dhm_year"))


@query("S9", "select doc_id, quality, toxic, cast(null as double) as note from labels where quality = 1")
def slice_written(spark, sf):
    path = new_table_path(spark, "slice")
    labels = derived.table(spark, sf, "labels").where("quality = 1").withColumn("note", F.lit(None))
    tables.write_slice(labels, path)
    return spark.read.parquet(path)


SLICES_SQL = {
    "hour_midday": "hour_of_day >= 10e0 and hour_of_day <= 11e0",
    "hour_midnight": "hour_of_day >= 22e0 and hour_of_day <= 23e0",
    "point_a": "abs(longitude - 3.72e0) <= 0.02e0 and abs(latitude - 51.05e0) <= 0.02e0",
    "single_year": "year = 1997",
    "months": "partition_key in ('1996-06', '1996-07', '1996-08')",
}


@query(
    "S10",
    " union all ".join(
        f"select '{k}' as label, count(*) as n, round(sum(l_quantity), 2) as quantity from obs where {v} having count(*) > 0"
        for k, v in SLICES_SQL.items()
    ),
    ("obs",),
)
def fan_out_written(spark, sf):
    path = new_table_path(spark, "fanout")
    tables.write_fan_out(derived.obs(spark, sf), {k: F.expr(v) for k, v in SLICES_SQL.items()}, path)
    return spark.read.parquet(path).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("quantity")
    )


@query(
    "S11",
    "select partition_key, count(*) as n, count(distinct tile_id) as n_tiles from obs group by 1",
    ("obs",),
)
def clustered_rewrite(spark, sf):
    out = spark.read.parquet(_month_table(spark, sf))
    return out.groupBy(F.col("partition_key").cast("string").alias("partition_key")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("tile_id").alias("n_tiles")
    )


@query(
    "S12 P5",
    """select l_orderkey, l_linenumber, loc_id, image_id,
         concat(cast(cast(floor((longitude - 3.57e0) / 0.01e0) as int) as varchar), '_', cast(cast(floor((latitude - 50.96e0) / 0.01e0) as int) as varchar)) as tile_deg
       from obs""",
    ("obs",),
)
def backfill_keys(spark, sf):
    obs = derived.obs(spark, sf)
    keys = spatial.location_dimension(obs).withColumn(
        "tile_deg",
        F.concat_ws(
            "_",
            F.floor((F.col("longitude") - 3.57) / 0.01).cast("int"),
            F.floor((F.col("latitude") - 50.96) / 0.01).cast("int"),
        ),
    )
    return tables.backfill(obs, keys).select("l_orderkey", "l_linenumber", "loc_id", "image_id", "tile_deg")


@query(
    "S13",
    """select 'elevation' as dataset, 'written,skipped' as actions, count(*) as n from customer
       union all select 'trees', 'written,skipped', count(*) from orders""",
)
def incremental_ingest(spark, sf):
    root = new_table_path(spark, "ingest")
    jobs = {
        "trees": (f"{root}/trees", lambda: derived.trees(spark, sf)),
        "elevation": (f"{root}/elevation", lambda: derived.dhm(spark, sf)),
    }
    first = tables.ingest_datasets(spark, jobs, skip_existing=True)
    again = tables.ingest_datasets(spark, jobs, skip_existing=True)
    actions = (
        first.alias("a").join(again.alias("b"), "dataset")
        .select("dataset", F.concat_ws(",", "a.action", "b.action").alias("actions"))
    )
    sizes = spark.read.parquet(f"{root}/trees").select(F.lit("trees").alias("dataset")).unionAll(
        spark.read.parquet(f"{root}/elevation").select(F.lit("elevation").alias("dataset"))
    ).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return actions.join(sizes, "dataset")


@query(
    "S14",
    """select c_mktsegment as segment, count(*) as n, round(avg(c_acctbal), 4) as mean_balance
       from customer group by 1""",
)
def result_written(spark, sf):
    out = derived.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("c_acctbal"), 4).alias("mean_balance")
    )
    as_csv, as_json = new_table_path(spark, "csv"), new_table_path(spark, "json")
    tables.write_result(out, as_csv, "csv")
    tables.write_result(out, as_json, "json")
    schema = "segment string, n long, mean_balance double"
    return spark.read.csv(as_csv, header=True, schema=schema).intersect(
        spark.read.json(as_json, schema=schema)
    )


@query(
    "S16 T9",
    f"""select l_orderkey, l_linenumber, loc_id, image_id from obs
        order by {ORDER_SQL}, l_orderkey, l_linenumber, loc_id, image_id limit 2000""",
    ("obs",),
)
def representative_rows(spark, sf):
    out = tables.representative_sample(derived.obs(spark, sf), 2000, F.expr(ORDER_SQL), ORDER_RANGE, OBS_TIES)
    return out.select("l_orderkey", "l_linenumber", "loc_id", "image_id")


# --- projections ---------------------------------------------------------------------


@query(
    "P1",
    """select event_id, strftime(ts, '%Y-%m') as partition_key, cast(year(ts) as int) as year,
         cast(month(ts) as int) as month_of_year, cast(day(ts) as int) as day_of_month,
         cast(dayofyear(ts) as int) as day_of_year,
         round(hour(ts) + minute(ts) / 60e0 + second(ts) / 3600e0, 9) as hour_of_day from events""",
)
def time_parts(spark, sf):
    parts = derive.time_parts("ts")
    return derived.table(spark, sf, "events").select(
        "event_id", *[(r(c, 9) if n == "hour_of_day" else c).alias(n) for n, c in parts.items()]
    )


_SCENE_TEXT = """case when event_id % 9 = 0 then concat('bad_', cast(event_id as string))
  else concat('L', cast(5 + event_id % 3 as string), '_', case event_id % 3 when 0 then 'ASTER' when 1 then 'MODIS' else 'NDVI' end,
  '_20000301_20010301_LT5', cast(event_id as string), 'FUI00_', {day}, '_', {clock}) end"""


@query(
    "P2 P1",
    """select event_id, concat('L', cast(5 + event_id % 3 as varchar)) as satellite,
         case event_id % 3 when 0 then 'ASTER' when 1 then 'MODIS' else 'NDVI' end as product,
         concat('LT5', cast(event_id as varchar), 'FUI00') as image_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') as timestamp, strftime(ts, '%Y-%m') as partition_key,
         cast(dayofyear(ts) as int) as day_of_year,
         round(hour(ts) + minute(ts) / 60e0 + second(ts) / 3600e0, 9) as hour_of_day
       from events where event_id % 9 <> 0""",
)
def scene_names(spark, sf):
    name = _SCENE_TEXT.format(day="date_format(ts, 'yyyyMMdd')", clock="date_format(ts, 'HHmmss')")
    named = derived.table(spark, sf, "events").selectExpr("event_id", f"{name} as scene")
    parts = derive.scene_parts("scene")
    wanted = ["satellite", "product", "image_id", "timestamp", "partition_key", "day_of_year"]
    return named.where(F.col("scene").rlike(derive.SCENE_ID)).select(
        "event_id", *[parts[w].alias(w) for w in wanted], r(parts["hour_of_day"], 9).alias("hour_of_day")
    )


def _hex_sql(res: int) -> str:
    edge = geo.HEX_EDGE_M[res]
    import math

    return f"""select loc_id, case when dq > dr and dq > ds then -rr - rs else rq end as q,
      case when not (dq > dr and dq > ds) and dr > ds then -rq - rs else rr end as r from (
      select *, abs(rq - q) as dq, abs(rr - r) as dr, abs(rs - s) as ds from (
      select *, round_even(q, 0) as rq, round_even(r, 0) as rr, round_even(s, 0) as rs from (
      select *, -q - r as s from (
      select loc_id, (x * {dbl(math.sqrt(3.0) / 3.0)} - y * {dbl(1.0 / 3.0)}) / {dbl(edge)} as q, y * {dbl(2.0 / 3.0)} / {dbl(edge)} as r from (
      select distinct loc_id, (longitude - 3.57e0) / {dbl(geo.LON_DEG_PER_M)} as x, (latitude - 50.96e0) / {dbl(geo.LAT_DEG_PER_M)} as y from obs)))))"""


@query(
    "P3 P4",
    "select a.loc_id, "
    + ", ".join(
        f"concat('h{n}_', cast(cast({a}.q as int) as varchar), '_', cast(cast({a}.r as int) as varchar)) as tile_h{n}"
        for n, a in ((9, "a"), (8, "b"), (7, "c"))
    )
    + f" from ({_hex_sql(9)}) a join ({_hex_sql(8)}) b using (loc_id) join ({_hex_sql(7)}) c using (loc_id)",
    ("obs",),
)
def hex_keys(spark, sf):
    places = derived.obs(spark, sf).select("loc_id", "longitude", "latitude").distinct()
    return places.select(
        "loc_id", *[geo.hex_key("longitude", "latitude", n).alias(f"tile_h{n}") for n in (9, 8, 7)]
    )


@query(
    "P5 P7",
    f"""with source as (select distinct loc_id as id, longitude as lon, latitude as lat from obs), {LAMBERT}
      select id as loc_id, round(x, 3) as x_m, round(y, 3) as y_m, {rect_sql(1000)} as tile_rect_1km, {rect_sql(2000)} as tile_rect_2km from lambert""",
    ("obs",),
)
def rect_tiles(spark, sf):
    places = derived.obs(spark, sf).select("loc_id", "longitude", "latitude").distinct()
    plane = geo.with_projection(places, geo.lambert72_steps())
    return plane.select(
        "loc_id", r(F.col("x_m"), 3).alias("x_m"), r(F.col("y_m"), 3).alias("y_m"),
        geo.rect_key("x_m", "y_m", 1000).alias("tile_rect_1km"),
        geo.rect_key("x_m", "y_m", 2000).alias("tile_rect_2km"),
    )


@query(
    "P6 J7",
    """with places as (select distinct loc_id, longitude, latitude from obs),
       sheets as (select n_nationkey, 3.55e0 + (n_nationkey % 5) * 0.06e0 as x0, 50.94e0 + floor(n_nationkey / 5e0) * 0.05e0 as y0 from nation),
       hit as (select loc_id, min(concat('sheet', lpad(cast(n_nationkey as varchar), 2, '0'))) as tile_ngi from places join sheets
         on longitude >= x0 and longitude < x0 + 0.061e0 and latitude >= y0 and latitude < y0 + 0.045e0 group by 1)
       select p.loc_id, tile_ngi from places p left join hit using (loc_id)""",
    ("obs",),
)
def map_sheet_keys(spark, sf):
    places = derived.obs(spark, sf).select("loc_id", "longitude", "latitude").distinct()
    sheets = derived.table(spark, sf, "nation").selectExpr(
        "concat('sheet', lpad(cast(n_nationkey as string), 2, '0')) as tile_ngi",
        "3.55e0 + (n_nationkey % 5) * 0.06e0 as x0", "50.94e0 + floor(n_nationkey / 5e0) * 0.05e0 as y0",
    ).withColumn(
        "rings",
        F.array(geo.rectangle_ring("x0", "y0", F.col("x0") + 0.061, F.col("y0") + 0.045)),
    )
    return spatial.within_polygon(places, sheets, "tile_ngi", cell_m=3000).select("loc_id", "tile_ngi")


@query(
    "P8",
    """select l_orderkey, l_linenumber, loc_id, image_id,
         coalesce(aster_lst, modis_lst, ndvi) as t_any, coalesce(aster_lst, modis_lst) as t_fallback,
         aster_lst as t_aster, modis_lst as t_modis, ndvi as t_ndvi,
         coalesce(aster_lst, modis_lst) as t_aster_imputed, coalesce(modis_lst, aster_lst) as t_modis_imputed
       from obs""",
    ("obs",),
)
def temperature_modes(spark, sf):
    modes = ["any", "fallback", "aster", "modis", "ndvi"]
    return derived.obs(spark, sf).select(
        "l_orderkey", "l_linenumber", "loc_id", "image_id",
        *[derive.temperature(m).alias(f"t_{m}") for m in modes],
        *[derive.temperature(m, "impute").alias(f"t_{m}_imputed") for m in ("aster", "modis")],
    )


@query(
    "P8 F10",
    """select partition_key, count(*) as n, round(avg(coalesce(aster_lst, modis_lst)), 6) as mean_t
       from obs where coalesce(aster_lst, modis_lst) is not null group by 1""",
    ("obs",),
)
def temperature_skip_nulls(spark, sf):
    t = derived.obs(spark, sf).withColumn("temperature", derive.temperature("fallback", "skip"))
    return t.dropna(subset=["temperature"]).groupBy("partition_key").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("temperature")).alias("mean_t")
    )


@query(
    "P10 X2",
    """select l_orderkey, l_linenumber, loc_id, image_id, 1e0 as z_one, round((year - 2012.5e0) / 6.25e0, 9) as z_year,
         round(sin(month_of_year * pi() / 6), 9) as z_sin_month, round(cos(month_of_year * pi() / 6), 9) as z_cos_month,
         round(sin(hour_of_day * pi() / 12), 9) as z_sin_hour, round(cos(hour_of_day * pi() / 12), 9) as z_cos_hour,
         round((latitude - 51e0) / 0.1e0, 9) as z_lat, round((longitude - 3.71e0) / 0.1e0, 9) as z_lon from obs""",
    ("obs",),
)
def confounder_columns(spark, sf):
    z = derive.confounders(lat="latitude", lon="longitude")
    return derived.obs(spark, sf).select(
        "l_orderkey", "l_linenumber", "loc_id", "image_id", *[r(c, 9).alias(n) for n, c in z.items()]
    )


@query(
    "P11",
    """with names as (select distinct concat(prefix, lower(p_type), '_50m_frac') as feature, prefix, lower(p_type) as t
         from part, (values ('dhm_'), ('trees_'), ('ua_'), ('ua_green_urban_'), ('wis_'), ('other_')) as v(prefix))
       select feature, case prefix when 'dhm_' then 'DHM' when 'trees_' then 'Trees' when 'ua_' then 'UA' when 'ua_green_urban_' then 'UA'
           when 'wis_' then 'WIS' end as source,
         case prefix when 'trees_' then 'greening' when 'ua_green_urban_' then 'greening' when 'dhm_' then 'morphology' when 'ua_' then 'morphology' end as role
       from names""",
)
def feature_roles(spark, sf):
    prefixes = F.array(*[F.lit(p) for p in ("dhm_", "trees_", "ua_", "ua_green_urban_", "wis_", "other_")])
    names = (
        derived.table(spark, sf, "part").select("p_type").distinct()
        .select(F.explode(prefixes).alias("prefix"), "p_type")
        .select(F.concat("prefix", F.lower("p_type"), F.lit("_50m_frac")).alias("feature"))
    )
    return names.select(
        "feature", derive.source_column("feature").alias("source"), derive.role_column("feature").alias("role")
    )


@query(
    "P12 P13",
    f"""with source as (select struct_pack(p := poly_id, k := k) as id, case when k in (1, 2) then x1 else x0 end as lon,
        case when k in (2, 3) then y1 else y0 end as lat from polys, (select unnest([0, 1, 2, 3]) as k)), {LAEA},
      corners as (select id.p as poly_id, list(x order by id.k) as xs, list(y order by id.k) as ys from laea group by 1),
      own as (select poly_id, list_transform(xs, lambda x: x - xs[1]) as xs, list_transform(ys, lambda y: y - ys[1]) as ys from corners)
      select poly_id, round(abs((xs[2] * ys[3] - xs[3] * ys[2]) + (xs[3] * ys[4] - xs[4] * ys[3])) / 2e0, 1) as area_m2 from own""",
    ("polys",),
)
def polygon_areas(spark, sf):
    return derived.polys(spark, sf).select(
        "poly_id", r(geo.rings_area_m2(geo.valid_rings("rings")), 1).alias("area_m2")
    )


@query(
    "P12",
    """select class_code, count(*) as n, count(*) as n_within_one_percent from polys group by 1""",
    ("polys",),
)
def polygon_area_check(spark, sf):
    """Equal-area sizes agree with width times height on the ground."""
    area = geo.rings_area_m2("rings")
    side = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    mid = F.cos(F.radians((F.col("y0") + F.col("y1")) / 2))
    rough = side * mid * F.lit(111319.49 * 111250.0)
    return derived.polys(spark, sf).groupBy("class_code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(area / rough - 1) < 0.01).alias("n_within_one_percent")
    )


@query(
    "P13",
    """select poly_id, 1 as n_rings from polys where poly_id % 3 <> 0""",
    ("polys",),
)
def valid_polygons(spark, sf):
    """Open rings are dropped; polygons without a valid ring vanish."""
    p = derived.polys(spark, sf)
    ring = F.get("rings", F.lit(0))
    mixed = F.when(F.col("poly_id") % 3 == 0, F.array(F.slice(ring, 1, 4))).otherwise(
        F.array(ring, F.slice(ring, 1, 3))
    )
    kept = p.select("poly_id", geo.valid_rings(mixed).alias("rings")).where(F.col("rings").isNotNull())
    return kept.select("poly_id", F.size("rings").alias("n_rings"))


@query(
    "P14",
    "select class_code, min(x0) as west, min(y0) as south, max(x1) as east, max(y1) as north from polys group by 1",
    ("polys",),
)
def boundary_boxes(spark, sf):
    box = geo.rings_bbox("rings")
    return derived.polys(spark, sf).groupBy("class_code").agg(
        F.min(box["x0"]).alias("west"), F.min(box["y0"]).alias("south"),
        F.max(box["x1"]).alias("east"), F.max(box["y1"]).alias("north"),
    )
