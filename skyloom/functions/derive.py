"""Derived columns: time parts, scene ids, temperature, genus, confounders, roles."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


# --- time -----------------------------------------------------------------------


def time_parts(ts) -> dict[str, Column]:
    """Calendar columns of an observation time; the hour is fractional."""
    ts = _c(ts)
    return {
        "partition_key": F.date_format(ts, "yyyy-MM"),
        "year": F.year(ts),
        "month_of_year": F.month(ts),
        "day_of_month": F.dayofmonth(ts),
        "day_of_year": F.dayofyear(ts),
        "hour_of_day": F.hour(ts)
        + F.minute(ts) / F.lit(60.0)
        + F.floor(F.second(ts)).cast("double") / F.lit(3600.0),
    }


# Fixed value: satellite, product, two range dates, image id, date and time.
SCENE_ID = r"^(L\w+)_([A-Z]+)_\d{8}_\d{8}_(\w+)_(\d{8})_(\d{6})$"


def scene_parts(name) -> dict[str, Column]:
    """Fields of a scene name; filter with ``name.rlike(SCENE_ID)`` first."""
    name = _c(name)

    def group(i: int) -> Column:
        return F.regexp_extract(name, SCENE_ID, i)

    stamp = F.try_to_timestamp(F.concat(group(4), group(5)), F.lit("yyyyMMddHHmmss"))
    return {
        "satellite": group(1),
        "product": F.upper(group(2)),
        "image_id": group(3),
        "timestamp": F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"),
        **time_parts(stamp),
    }


def scene_month(year, month) -> Column:
    """Consecutive month number, ``year * 12 + month``."""
    return (_c(year) * 12 + _c(month)).cast("int")


def scene_year(scene_ym) -> Column:
    """Year of a month number; December stays in its own year."""
    return F.floor((_c(scene_ym) - 1) / 12).cast("int")


# --- temperature ----------------------------------------------------------------

# Which products feed the temperature, in order of preference.
TEMPERATURE_SOURCES = {
    "any": ("aster_lst", "modis_lst", "ndvi"),
    "fallback": ("aster_lst", "modis_lst"),
    "aster": ("aster_lst",),
    "modis": ("modis_lst",),
    "ndvi": ("ndvi",),
}


def no_nan(value) -> Column:
    """NaN becomes null, so that one kind of missing value is left."""
    value = _c(value)
    return F.when(~F.isnan(value), value)


def temperature(mode: str = "any", nulls: str = "keep") -> Column:
    """One temperature from the product columns.

    ``nulls='impute'`` lets the single modes ``aster`` and ``modis`` fall back
    on each other; ``'skip'`` is the caller's filter on the result.
    """
    if mode not in TEMPERATURE_SOURCES:
        raise ValueError(f"unknown emissivity mode {mode!r}")
    if nulls not in ("keep", "skip", "impute"):
        raise ValueError(f"unknown null handling {nulls!r}")
    sources = list(TEMPERATURE_SOURCES[mode])
    if nulls == "impute" and mode in ("aster", "modis"):
        sources.append("modis_lst" if mode == "aster" else "aster_lst")
    return F.coalesce(*[F.col(s).cast("double") for s in sources])


# --- names ----------------------------------------------------------------------

NULL_TEXTS = ("", "nan", "None")


def clean_text(value) -> Column:
    """Empty strings and textual nulls become null."""
    value = _c(value).cast("string")
    return F.when(~value.isin(*NULL_TEXTS), value)


def compatible(text) -> Column:
    """Unicode compatibility form: wide letters, ligatures and odd spaces as their plain equals."""

    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore").astype(object)

    return normal(_c(text).cast("string"))


def genus(botanical_name) -> Column:
    """Genus of a botanical name, best effort; null for placeholders."""
    text = F.trim(compatible(botanical_name))
    words = F.split(text, r"\s+")

    def strip(word: Column, marks: str) -> Column:
        return F.btrim(word, F.lit(marks))

    first = strip(F.get(words, F.lit(0)), "'\"().,;:")
    family = first.rlike("(?i)aceae$") & (F.size(words) >= 2)
    head = F.when(family, strip(F.get(words, F.lit(1)), "'\"().,×x")).otherwise(first)
    head = F.when((F.lower(first) != "te") & (head != ""), head)
    return F.concat(F.upper(F.substring(head, 1, 1)), F.lower(F.substr(head, F.lit(2))))


def safe_name(value: str) -> str:
    return value.replace(" ", "_").replace("/", "_")


def fingerprint(config) -> str:
    """Sixteen hex digits that identify a configuration."""
    text = json.dumps(config, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def fingerprint_of(text: Column) -> Column:
    """The same of a configuration that is a column of JSON text."""
    return F.substring(F.sha2(text, 256), 1, 16)


# --- confounders ----------------------------------------------------------------

# Centring of the confounders.
YEAR_CENTRE, YEAR_SCALE = 2012.5, 6.25
LAT_CENTRE, LAT_SCALE = 51.0, 0.1
LON_CENTRE, LON_SCALE = 3.71, 0.1


def cycle(value, period: float) -> tuple[Column, Column]:
    angle = _c(value).cast("double") * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def confounders(year="year", month="month_of_year", hour="hour_of_day",
                lat=None, lon=None) -> dict[str, Column]:
    """Intercept, scaled year and cyclical month and hour; optionally position."""
    sm, cm = cycle(month, 12.0)
    sh, ch = cycle(hour, 24.0)
    out = {
        "z_one": F.lit(1.0),
        "z_year": (_c(year) - F.lit(YEAR_CENTRE)) / F.lit(YEAR_SCALE),
        "z_sin_month": sm, "z_cos_month": cm, "z_sin_hour": sh, "z_cos_hour": ch,
    }
    if lat is not None:
        out["z_lat"] = (_c(lat) - F.lit(LAT_CENTRE)) / F.lit(LAT_SCALE)
        out["z_lon"] = (_c(lon) - F.lit(LON_CENTRE)) / F.lit(LON_SCALE)
    return out


# --- roles of feature columns -----------------------------------------------------

# Name rules of feature groups.
LST_COLUMNS = ("temperature", "aster_lst", "modis_lst", "ndvi")
SOURCE_PREFIXES = (("dhm_", "DHM"), ("trees_", "Trees"), ("ua_", "UA"), ("wis_", "WIS"))
GREEN_WORDS = (
    "14100", "green_urban", "greenurban", "31000", "forest", "32000", "herbaceous",
    "40000", "wetland", "21000", "22000", "23000", "arable", "pasture", "agricultural",
    "vegetation",
)


def source_column(name) -> Column:
    """Source group of a feature name held in a column; null when it has none."""
    name = _c(name)
    out = F.when(name.isin(*LST_COLUMNS), F.lit("LST"))
    for prefix, group in SOURCE_PREFIXES:
        out = out.when(name.startswith(prefix), F.lit(group))
    return out


def role_column(name) -> Column:
    """``greening``, ``morphology`` or null for a feature name held in a column."""
    name = _c(name)
    green_class = name.startswith("ua_") & F.lower(name).rlike("|".join(GREEN_WORDS))
    greening = name.startswith("trees_") | (name == "ndvi") | name.startswith("ndvi_struct") | green_class
    morphology = name.startswith("dhm_") | (name.startswith("ua_") & ~greening)
    return F.when(greening, F.lit("greening")).when(morphology, F.lit("morphology"))


def source_of(name: str) -> str | None:
    if name in LST_COLUMNS:
        return "LST"
    return next((g for p, g in SOURCE_PREFIXES if name.startswith(p)), None)


def role_of(name: str) -> str | None:
    if name.startswith(("trees_", "ndvi_struct")) or name == "ndvi":
        return "greening"
    if name.startswith("ua_") and any(w in name.lower() for w in GREEN_WORDS):
        return "greening"
    return "morphology" if name.startswith(("dhm_", "ua_")) else None
