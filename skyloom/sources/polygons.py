"""Polygon tables: road surfaces from GeoJSON and land use per survey year."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.sources.tables import resolve_column

# Names a land-use code column goes by, and survey years.
LAND_USE_CODE_COLUMNS = ["code_2021", "code_2018", "code_2012", "code_2006", "code", "luc_code"]
LAND_USE_YEARS = (2006, 2012, 2018, 2021)

FEATURE_FIELDS = (
    "type:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>"
)
_MULTI = "array<array<array<array<double>>>>"
_SINGLE = "array<array<array<double>>>"


def rings_of_geometry(geometry: Column) -> Column:
    """Rings of a GeoJSON (multi)polygon held as type and coordinate text."""
    single = F.from_json(geometry["coordinates"], _SINGLE)
    many = F.flatten(F.from_json(geometry["coordinates"], _MULTI))
    rings = F.when(geometry["type"] == "MultiPolygon", many).when(geometry["type"] == "Polygon", single)
    return F.transform(
        rings,
        lambda ring: F.transform(
            ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
        ),
    )


def features_to_polygons(features: DataFrame, properties: list[str]) -> DataFrame:
    """Feature structs to valid polygons; empty property text becomes null."""
    return (
        features.select(
            *[F.nullif(F.col("properties")[p], F.lit("")).alias(p) for p in properties],
            geo.valid_rings(rings_of_geometry(F.col("geometry"))).alias("rings"),
        )
        .where(F.col("rings").isNotNull())
        .withColumn("area_m2", geo.rings_area_m2("rings"))
    )


# What stands between two features: the text that opens each of them, quotes included.
_FEATURE = '"Feature"'


def read_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """``properties`` and ``geometry`` of every feature of GeoJSON files, one row a feature.

    Files are cut where features begin and not read as one value, so a large
    file is read by as many tasks as it has splits.  A piece runs from behind
    one ``"Feature"`` to the next; its JSON ends with the feature, whatever
    follows.  Features must name their type first, as writers do; a file where
    one does not, or is no JSON, is an error and not a loss.
    """
    value = F.col("value")
    begins = value.rlike(r"^\s*,")
    misplaced = F.raise_error(F.concat(F.lit("a feature does not begin with its type: "), F.substring(value, 1, 200)))
    kept = F.when(begins, F.lit(True)).when(value.contains('"geometry"'), misplaced.cast("boolean")).otherwise(F.lit(False))
    pieces = spark.read.option("lineSep", _FEATURE).text(path).where(kept)
    text = F.concat(F.lit("{"), F.regexp_replace(value, r"^\s*,", ""))
    fields = FEATURE_FIELDS.split(", ", 1)[1]
    return pieces.select(F.from_json(text, f"struct<{fields}>", {"mode": "FAILFAST"}).alias("f")).select("f.*")


def read_road_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Road surfaces with their use and material."""
    return features_to_polygons(read_feature_collection(spark, path), ["bestemming", "materiaalsoort"])


def property_frequency(features: DataFrame) -> DataFrame:
    """How often each property is present, and with how many distinct values."""
    entry = features.select(
        F.explode(F.map_entries("properties")).alias("e")
    ).select(F.col("e.key").alias("property"), F.col("e.value").alias("value"))
    return entry.groupBy("property").agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.col("value").isNotNull() & (F.col("value") != "")).alias("n_filled"),
        F.approx_count_distinct("value").alias("n_values_approx"),
    )


def geometry_types(features: DataFrame) -> DataFrame:
    return features.groupBy(F.col("geometry.type").alias("geometry_type")).agg(
        F.count(F.lit(1)).alias("n_features")
    )


def land_use_union(surveys: dict[int, DataFrame]) -> DataFrame:
    """One table from per-year polygon tables with differing code columns."""

    def normal(year: int, df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c not in ("rings", "geometry")]
        code = resolve_column(others, LAND_USE_CODE_COLUMNS, fallback=True)
        return (
            df.select(
                F.col(code).cast("string").alias("luc_code"),
                F.lit(year).alias("ua_year"),
                geo.valid_rings("rings").alias("rings"),
            )
            .where(F.col("rings").isNotNull())
            .withColumn("area_m2", geo.rings_area_m2("rings"))
        )

    return reduce(DataFrame.unionByName, [normal(y, d) for y, d in sorted(surveys.items())])
