"""Feature specifications and the plan that attaches them to observations.

Specs of one side dataset share a single join at their largest radius.  Results
live on distinct (longitude, latitude, year) rows, written once, and the
observations pick them up with one equi-join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.derive import fingerprint, safe_name
from skyloom.operators import coverage, spatial
from skyloom.operators.coverage import Grid
from skyloom.operators.spatial import LOC, Measure
from skyloom.operators.scale import enrich
from skyloom.session import materialise

PLACE = (*LOC, "year")


def _suffix(match: dict[str, str] | None) -> str:
    return "".join(f"_{k}={str(v).replace(' ', '_')}" for k, v in (match or {}).items())


@dataclass(frozen=True)
class Feature:
    """Base of all specs: output columns and a scaler hint."""

    def columns(self) -> list[str]:
        raise NotImplementedError

    def scaler_hint(self) -> str | None:
        return None


@dataclass(frozen=True)
class RadiusFeature(Feature):
    """Aggregate of a point dataset within a radius."""

    dataset: str
    radius_m: float
    agg: str = "count"
    fields: tuple[str, ...] = ()
    match: tuple[tuple[str, str], ...] = ()
    temporal: str = "none"
    planted_by: bool = False
    prefix: str = ""

    def __post_init__(self):
        if self.temporal == "nearest":
            raise ValueError("an aggregate has no nearest time; use last_previous or none")
        if self.temporal not in ("none", "last_previous"):
            raise ValueError(f"unknown temporal mode {self.temporal!r}")
        if self.planted_by and self.agg != "count":
            raise ValueError("planted-by features count trees")

    def base(self) -> str:
        r = int(self.radius_m)
        kind = f"plantedby_{r}m" if self.planted_by else f"{self.agg}{r}m"
        return self.prefix or f"{self.dataset}_{kind}{_suffix(dict(self.match))}_"

    def measures(self) -> list[Measure]:
        """The number of points, and the aggregate of every field."""
        base = self.base()
        out = [Measure(f"{base}count", "count", self.radius_m, None, self.match)]
        if self.agg != "count":
            out += [
                Measure(f"{base}{f}_{self.agg}", self.agg, self.radius_m, f, self.match) for f in self.fields
            ]
        return out

    def columns(self) -> list[str]:
        return [m.name for m in self.measures()]


@dataclass(frozen=True)
class NearestFeature(Feature):
    """Columns of the nearest point of a dataset.

    ``temporal`` of ``last_previous`` or ``nearest`` chooses by the
    observation's time first, and by distance among the points of one time.
    """

    dataset: str
    fields: tuple[str, ...]
    radius_m: float = 500.0
    prefix: str = ""
    temporal: str = "none"

    def columns(self) -> list[str]:
        return [f"{self.prefix or self.dataset + '_'}{c}" for c in self.fields]


@dataclass(frozen=True)
class ClassFraction(Feature):
    """Disk share per class of dated land use, last survey not after the scene."""

    radius_m: float
    classes: tuple[tuple[str, tuple[str, ...]], ...] = ()
    code: str | None = None
    survey_year: int | None = None
    prefix: str = "ua_"

    def columns(self) -> list[str]:
        r = int(self.radius_m)
        if self.code is not None:
            return [f"{self.prefix}luc{self.code}_{r}m_frac"]
        return [f"{self.prefix}{c}_{r}m_frac" for c, _ in self.classes]

    def groups(self) -> dict[str, tuple[str, ...]]:
        return {f"luc{self.code}": (self.code,)} if self.code is not None else dict(self.classes)

    def scaler_hint(self) -> str:
        return "minmax"


@dataclass(frozen=True)
class SurfaceFraction(Feature):
    """Disk share of one attribute value of an undated polygon table."""

    attribute: str
    value: str
    radius_m: float
    prefix: str = "wis_"

    def columns(self) -> list[str]:
        return [f"{self.prefix}{safe_name(self.value)}_{int(self.radius_m)}m_frac"]

    def scaler_hint(self) -> str:
        return "minmax"


@dataclass(frozen=True)
class CustomFeature(Feature):
    """Any function of the frame: ``fn(df) -> {column: Column}``.

    Column functions cover what row functions did; lookups of other datasets
    are features of their own whose columns the function may use.
    """

    name: str
    outputs: tuple[str, ...]
    fn: Callable[[DataFrame], dict[str, Column]] = field(compare=False)
    prefix: str = ""

    def columns(self) -> list[str]:
        return [f"{self.prefix}{o}" for o in self.outputs]


@dataclass(frozen=True)
class FrameFeature(Feature):
    """A function from frame to frame that adds the named columns."""

    name: str
    outputs: tuple[str, ...]
    fn: Callable[[DataFrame], DataFrame] = field(compare=False)

    def columns(self) -> list[str]:
        return list(self.outputs)


class Registry:
    """An ordered set of feature specs."""

    def __init__(self, features: list[Feature] | None = None):
        self.features: list[Feature] = []
        for f in features or []:
            self.add(f)

    def add(self, feature: Feature) -> Registry:
        clash = set(self.columns()) & set(feature.columns())
        if clash:
            raise ValueError(f"columns already registered: {sorted(clash)}")
        self.features.append(feature)
        return self

    def columns(self) -> list[str]:
        return [c for f in self.features for c in f.columns()]

    def of(self, kind: type) -> list:
        return [f for f in self.features if isinstance(f, kind)]

    def scaler_hints(self) -> dict[str, str]:
        return {c: f.scaler_hint() for f in self.features if f.scaler_hint() for c in f.columns()}

    def key(self) -> str:
        return fingerprint([repr(f) for f in self.features])

    def __len__(self) -> int:
        return len(self.features)


@dataclass
class Sides:
    """Side tables and the columns the plan needs from them."""

    points: dict[str, DataFrame] = field(default_factory=dict)
    point_ids: dict[str, str] = field(default_factory=dict)
    survey_columns: dict[str, str] = field(default_factory=dict)
    planting_year: str = "planting_year"
    land_use: DataFrame | None = None
    land_use_code: str = "class_code"
    land_use_year: str = "survey_year"
    surfaces: DataFrame | None = None
    polygon_id: str = "poly_id"


def fraction_as_of(asked: DataFrame, fractions: DataFrame, survey: str, years: list[int],
                   columns: list[str], year: str = "year", missing: float | None = 0.0) -> DataFrame:
    """Fractions of the last survey not after the scene year.

    ``asked`` has ix, iy and the scene year; absent cells and scenes before the
    first survey give ``missing``.
    """
    known = F.array(*[F.lit(int(y)) for y in sorted(years)])
    last = F.array_max(F.filter(known, lambda y: y <= F.col(year)))
    out = asked.withColumn(survey, last).join(
        fractions.select("ix", "iy", survey, *columns), ["ix", "iy", survey], "left"
    )
    return out.drop(survey) if missing is None else out.fillna(missing, columns).drop(survey)


def _wide(fractions: DataFrame, keys: list[str], name: str, wanted: dict[str, dict[float, str]]) -> DataFrame:
    """Long fractions to one row per key with a column per (name, radius)."""
    aggs = []
    for value, per_radius in wanted.items():
        for radius, column in per_radius.items():
            hit = F.when(F.col(name) == value, F.col(f"frac_{int(radius)}"))
            aggs.append(F.coalesce(F.max(hit), F.lit(0.0)).alias(column))
    return fractions.groupBy(*keys).agg(*aggs)


def _land_use(places: DataFrame, specs: list[ClassFraction], sides: Sides, grid: Grid) -> DataFrame:
    code, year = sides.land_use_code, sides.land_use_year
    radii = sorted({s.radius_m for s in specs})
    used = sorted({c for s in specs for codes in s.groups().values() for c in codes})
    source = sides.land_use.where(F.col(code).isin(used))
    targets = places.select("ix", "iy").distinct()
    layer = [code, year]
    fractions = materialise(
        coverage.coverage(source, layer, sides.polygon_id, targets, radii, grid), "fractions"
    )
    years = [row[0] for row in source.select(year).distinct().collect()]  # survey years: a handful
    out = places
    by_mode: dict[int | None, list[ClassFraction]] = {}
    for s in specs:
        by_mode.setdefault(s.survey_year, []).append(s)
    for fixed, group in by_mode.items():
        rows = fractions if fixed is None else fractions.where(F.col(year) == fixed)
        names: dict[str, dict[float, str]] = {}
        lookup: dict[str, list] = {}
        for s in group:
            for (cls, codes), column in zip(s.groups().items(), s.columns()):
                lookup[cls] = list(codes)
                names.setdefault(cls, {})[s.radius_m] = column
        keys = ["ix", "iy", year]
        columns = []
        for cls, codes in lookup.items():
            for radius, column in names[cls].items():
                cell = F.when(F.col(code).isin(codes), F.col(f"frac_{int(radius)}"))
                columns.append(F.least(F.lit(1.0), F.coalesce(F.sum(cell), F.lit(0.0))).alias(column))
        wide = rows.groupBy(*keys).agg(*columns)
        cols = [c for s in group for c in s.columns()]
        if fixed is None:
            out = fraction_as_of(out, wide, year, years, cols)
        else:
            out = out.join(wide.drop(year), ["ix", "iy"], "left").fillna(0.0, cols)
    return out


def _surfaces(places: DataFrame, specs: list[SurfaceFraction], sides: Sides, grid: Grid) -> DataFrame:
    targets = places.select("ix", "iy").distinct()
    out = places
    by_attr: dict[str, list[SurfaceFraction]] = {}
    for s in specs:
        by_attr.setdefault(s.attribute, []).append(s)
    for attribute, group in by_attr.items():
        radii = sorted({s.radius_m for s in group})
        wanted: dict[str, dict[float, str]] = {}
        for s in group:
            wanted.setdefault(s.value, {})[s.radius_m] = s.columns()[0]
        source = sides.surfaces.where(F.col(attribute).isin(list(wanted)))
        fractions = coverage.coverage(source, [attribute], sides.polygon_id, targets, radii, grid)
        wide = _wide(fractions, ["ix", "iy"], attribute, wanted)
        cols = [c for s in group for c in s.columns()]
        out = out.join(wide, ["ix", "iy"], "left").fillna(0.0, cols)
    return out


def place_features(obs: DataFrame, registry: Registry, sides: Sides, grid: Grid | None = None) -> DataFrame:
    """All spatial features on distinct (longitude, latitude, year)."""
    grid = grid or Grid()
    places = materialise(obs.select(*PLACE).distinct().withColumns(grid.snap()), "places")
    return features_of_places(places, registry, sides, grid)


def features_of_places(places: DataFrame, registry: Registry, sides: Sides, grid: Grid) -> DataFrame:
    """Feature columns for a written table of places with their grid points."""
    spots = spatial.location_dimension(places)
    out = places
    points = registry.of(RadiusFeature)
    for dataset in dict.fromkeys(f.dataset for f in points):
        mine = [f for f in points if f.dataset == dataset]
        side = sides.points[dataset]
        still = [m for f in mine if not f.planted_by and f.temporal == "none" for m in f.measures()]
        dated = [m for f in mine if not f.planted_by and f.temporal == "last_previous" for m in f.measures()]
        planted = [m for f in mine if f.planted_by for m in f.measures()]
        if still:
            out = out.join(spatial.radius_aggregate(spots, side, still), list(LOC), "left")
        if dated:
            got = spatial.radius_as_of_survey(
                places.select(*PLACE), side, dated, sides.survey_columns[dataset]
            )
            out = out.join(got, list(PLACE), "left")
        if planted:
            got = spatial.planted_by(places.select(*PLACE), side, planted, sides.planting_year)
            out = out.join(got, list(PLACE), "left")
    for f in registry.of(NearestFeature):
        if f.temporal != "none":
            continue  # depends on the observation's time, see timed_features
        prefix = f.prefix or f"{f.dataset}_"
        got = spatial.nearest(
            spots, sides.points[f.dataset], list(f.fields), f.radius_m, sides.point_ids[f.dataset], prefix
        ).drop(*[c for c in [f"{prefix}dist_m"] if "dist_m" not in f.fields])
        out = out.join(got, list(LOC), "left")
    if registry.of(ClassFraction):
        out = _land_use(out, registry.of(ClassFraction), sides, grid)
    if registry.of(SurfaceFraction):
        out = _surfaces(out, registry.of(SurfaceFraction), sides, grid)
    return out.drop("ix", "iy")


def timed_features(obs: DataFrame, registry: Registry, sides: Sides, ts: str = "ts") -> DataFrame:
    """``obs`` with the nearest features that look at its time, from distinct places and times."""
    out = obs
    timed = [f for f in registry.of(NearestFeature) if f.temporal != "none"]
    if not timed:
        return out
    key = [*LOC, ts]
    driving = materialise(obs.select(*key).distinct(), "places-and-times")
    for f in timed:
        mark = "__timed_"
        fields = [c for c in f.fields if c not in ("dist_m", ts)]
        got = spatial.nearest_as_of(
            driving, sides.points[f.dataset], fields, f.radius_m, sides.point_ids[f.dataset], f.temporal, ts=ts, prefix=mark
        )
        named = got.select(*key, *[F.col(f"{mark}{c}").alias(n) for c, n in zip(f.fields, f.columns())])
        out = out.join(materialise(named, "timed"), key, "left")
    return out


def attach(obs: DataFrame, registry: Registry, sides: Sides, grid: Grid | None = None) -> DataFrame:
    """Observations with every registered feature, lazily.

    The feature table has one row per place and year and is written once; AQE
    broadcasts it when it is small and otherwise shuffles both sides by key,
    with places that hold very many observations spread over several tasks.
    """
    spatial_kinds = (RadiusFeature, NearestFeature, ClassFraction, SurfaceFraction)
    out = obs
    if any(isinstance(f, spatial_kinds) for f in registry.features):
        grid = grid or Grid()
        counted = materialise(
            obs.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n")).withColumns(grid.snap()), "places"
        )
        features = materialise(features_of_places(counted.drop("n"), registry, sides, grid), "features")
        out = enrich(obs, features, list(PLACE), counted.select(*PLACE, "n"))
        out = timed_features(out, registry, sides)
    for f in registry.features:
        if isinstance(f, CustomFeature):
            out = out.withColumns({f"{f.prefix}{n}": c for n, c in f.fn(out).items()})
        elif isinstance(f, FrameFeature):
            out = f.fn(out)
            missing = set(f.columns()) - set(out.columns)
            if missing:
                raise ValueError(f"feature {f.name} did not add {sorted(missing)}")
    return out
