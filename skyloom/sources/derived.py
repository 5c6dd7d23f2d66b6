"""Observation, tree, elevation, land-use and road tables from the given tables.

The same expressions serve Spark and the SQL oracles: coordinates come from
whole-number arithmetic followed by one multiply and one add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import geo

_OBS = """
  l_orderkey, l_linenumber, l_partkey as loc_id,
  3.57e0 + (l_partkey % 97) * 0.003e0 as longitude,
  50.96e0 + (l_partkey % 83) * 0.003e0 as latitude,
  case when l_linenumber % 3 <> 0 then l_quantity end as aster_lst,
  case when l_linenumber % 2 = 0 then l_extendedprice / 2500e0 end as modis_lst,
  case when l_discount > 0.05e0 then l_discount * 10e0 end as ndvi,
  l_suppkey as image_id, l_shipdate as ts,
  concat(cast(year(l_shipdate) as string), '-', lpad(cast(month(l_shipdate) as string), 2, '0')) as partition_key,
  concat(cast(cast(floor((l_partkey % 97) / 4e0) as int) as string), '_', cast(cast(floor((l_partkey % 83) / 4e0) as int) as string)) as tile_id,
  cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month_of_year,
  cast(day(l_shipdate) as int) as day_of_month, cast(dayofyear(l_shipdate) as int) as day_of_year,
  cast((l_orderkey * 7 + l_partkey * 13 + l_suppkey) % 96 as double) / 4e0 as hour_of_day,
  l_quantity, l_extendedprice, l_discount, l_tax
"""
_TREES = """
  o_orderkey as tree_id,
  3.57e0 + ((o_orderkey * 7919) % 9700) * 0.00003e0 as longitude,
  50.96e0 + ((o_orderkey * 104729) % 8300) * 0.00003e0 as latitude,
  case when o_orderkey % 4 = 0 then cast(year(o_orderdate) as int) end as planting_year,
  o_totalprice / 1000e0 as girth,
  case o_orderstatus when 'F' then 'mature' when 'O' then 'young' else 'veteran' end as phase,
  o_orderdate as ts
"""
_DHM = """
  c_custkey as point_id,
  3.57e0 + ((c_custkey * 6151) % 9700) * 0.00003e0 as longitude,
  50.96e0 + ((c_custkey * 3571) % 8300) * 0.00003e0 as latitude,
  case when c_acctbal < 0e0 then 0e0 else c_acctbal / 100e0 end as elevation,
  c_acctbal < 0e0 as is_water,
  case when c_custkey % 2 = 0 then 1993 else 1998 end as dhm_year
"""
_POLYS = """
  p_partkey as poly_id, p_type as class_code,
  1994 + 2 * cast(p_partkey % 4 as int) as survey_year,
  p_brand as surface,
  3.57e0 + ((p_partkey * 7919) % 9700) * 0.00003e0 as x0,
  50.96e0 + ((p_partkey * 104729) % 8300) * 0.00003e0 as y0,
  3.57e0 + ((p_partkey * 7919) % 9700) * 0.00003e0 + p_size * 0.0002e0 as x1,
  50.96e0 + ((p_partkey * 104729) % 8300) * 0.00003e0 + p_size * 0.0002e0 as y1
"""

VIEWS = {"obs": (_OBS, "lineitem"), "trees": (_TREES, "orders"), "dhm": (_DHM, "customer"),
         "polys": (_POLYS, "part")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table stored as fewer row groups than there are cores.

    Such a table is small, so dealing its rows out is cheap; a large one has
    more splits than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, base = VIEWS[name]
    return spark.sql(f"select {text} from {{base}}", base=table(spark, sf_dir, base))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "obs")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "trees")


def dhm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "dhm")


def polys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "polys").withColumn(
        "rings", F.array(geo.rectangle_ring("x0", "y0", "x1", "y1"))
    )


def with_views(body: str, *names: str) -> str:
    """Prefix a SQL body with the derived tables it uses."""
    ctes = ",\n".join(f"{n} as (select {VIEWS[n][0]} from {VIEWS[n][1]})" for n in names)
    if not ctes:
        return body
    text = body.lstrip()
    if text.lower().startswith("with "):
        return f"with {ctes},\n{text[5:]}"
    return f"with {ctes}\n{text}"
