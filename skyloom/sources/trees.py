"""Tree inventory files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions.derive import clean_text, genus
from skyloom.sources.tables import resolve_column

# Column names seen in the inventory's releases.
TREE_COLUMNS = {
    "position": ["geo_point_2d", "geopoint", "position"],
    "longitude": ["longitude", "lon", "x", "lng"],
    "latitude": ["latitude", "lat", "y"],
    "species": ["sortiment", "species", "soort", "boomsoort"],
    "height": ["hoogte", "height", "height_m", "kroonhoogte"],
    "planting_year": ["aanlegjaar", "planting_year", "plantjaar", "jaar"],
    "girth": ["stamomtrek", "diameter", "trunk_diameter_cm", "omtrek"],
    "phase": ["beheerfase", "management_phase", "phase", "fase"],
}


def parse_trees(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Typed tree rows from a raw text table; rows without a position are dropped.

    ``keep`` carries further columns through.
    """
    source = {name: resolve_column(raw.columns, names) for name, names in TREE_COLUMNS.items()}

    def text(name: str):
        col = source[name]
        return clean_text(F.col(f"`{col}`")) if col else F.lit(None).cast("string")

    halves = F.split(text("position"), r",\s*")
    lat = F.coalesce(F.get(halves, F.lit(0)), text("latitude")).try_cast("double")
    lon = F.coalesce(F.get(halves, F.lit(1)), text("longitude")).try_cast("double")
    year = F.floor(text("planting_year").try_cast("double")).try_cast("int")
    girth = text("girth").try_cast("double")
    typed = raw.select(
        *(keep or []),
        lon.alias("longitude"), lat.alias("latitude"), text("species").alias("species"),
        text("height").alias("height"), F.when(year > 0, year).alias("planting_year"),
        F.when(~F.isnan(girth), girth).alias("girth"), text("phase").alias("phase"),
        genus(text("species")).alias("genus"),
    )
    return typed.where(
        F.col("longitude").isNotNull() & ~F.isnan("longitude")
        & F.col("latitude").isNotNull() & ~F.isnan("latitude")
    )


def read_tree_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """The newest inventory file below ``path``, parsed."""
    raw = spark.read.csv(path, sep=sep, header=True).withColumn("__file", F.input_file_name())
    newest = raw.agg(F.max("__file")).first()[0]
    return parse_trees(raw.where(F.col("__file") == F.lit(newest)).drop("__file"))
