"""Raster cells as pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.derive import no_nan
from skyloom.operators.spatial import polygon_filter


def pixel_rows(cells: DataFrame, geotransform: DataFrame, on: list[str], nodata: float | None = None,
               skip_zeros: bool = True) -> DataFrame:
    """Cells (row, col, value) of any raster to pixel centres.

    ``geotransform`` gives x0, y0 (north-west corner), dx and dy per raster.
    Missing, nodata and, if asked, zero values are dropped.
    """
    value = F.col("value").cast("double")
    keep = no_nan(value).isNotNull()
    if nodata is not None:
        keep &= value != F.lit(float(nodata))
    if skip_zeros:
        keep &= value != F.lit(0.0)
    return (
        cells.where(keep)
        .join(geotransform, on)
        .withColumns(
            {
                "longitude": F.col("x0") + (F.col("col") + F.lit(0.5)) * F.col("dx"),
                "latitude": F.col("y0") - (F.col("row") + F.lit(0.5)) * F.col("dy"),
            }
        )
        .drop("x0", "y0", "dx", "dy", "row", "col")
    )


def masked_pixel_rows(cells: DataFrame, geotransform: DataFrame, on: list[str], boundary: Column,
                      **options) -> DataFrame:
    """Pixels whose centre lies inside a boundary (array of rings)."""
    return polygon_filter(pixel_rows(cells, geotransform, on, **options), boundary)


def merge_products(pixels: DataFrame, scene: list[str], products: dict[str, str]) -> DataFrame:
    """One row per (scene, pixel) with a column per product.

    A full outer join of the product rasters, written as one aggregation.
    ``products`` maps a product code to its column name.
    """
    return pixels.groupBy(*scene, "longitude", "latitude").agg(
        *[
            F.max(F.when(F.col("product") == code, F.col("value"))).alias(name)
            for code, name in products.items()
        ]
    )


def elevation_rows(pixels: DataFrame, survey_year: int | Column, nodata: float = -9999.0) -> DataFrame:
    """Open water is coded as nodata: it becomes a flag and elevation zero."""
    year = survey_year if isinstance(survey_year, Column) else F.lit(survey_year)
    water = F.col("value") == F.lit(nodata)
    return pixels.select(
        "longitude", "latitude",
        F.when(water, F.lit(0.0)).otherwise(F.col("value")).alias("elevation"),
        water.alias("is_water"),
        year.cast("short").alias("dhm_year"),
    )
