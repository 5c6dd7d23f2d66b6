"""Radius, nearest, as-of and containment joins on a location dimension.

Spatial results depend on where a pixel is, not on the scene it was seen in,
so every operator here runs on distinct locations; the caller joins the result
back to the observations by key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import geo
from skyloom.operators.scale import split_join
from skyloom.session import materialise

LOC = ("longitude", "latitude")


def location_dimension(observations: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Distinct coordinates, with any columns that depend on them, written once.

    The joins below read it several times; the observations are scanned once.
    """
    return materialise(observations.select(*(extra or []), *LOC).distinct(), "locations")


def _spots(locations: DataFrame) -> DataFrame:
    """Distinct coordinates of locations that carry other keys: results depend on nothing else."""
    return locations if set(locations.columns) == set(LOC) else location_dimension(locations)


def near_pairs(locations: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """All (location, point) pairs within the radius, with ``dist_m``.

    Points keep their columns under a ``p_`` prefix.  Cells of the size of the
    radius turn the range condition into an equi-join: each location looks into
    its own cell and those around it that its circle reaches at its latitude,
    and the distance is the residual.
    """
    cx, cy = geo.search_cell(*LOC, radius_m)
    left = geo.cells_around(locations.withColumns({"__cx": cx, "__cy": cy}), radius_m, "__cx", "__cy")
    right = points.withColumns({"__cx": cx, "__cy": cy}).select(
        "__cx", "__cy", *[F.col(c).alias(f"p_{c}") for c in points.columns]
    )
    return (
        split_join(left, right, ["__cx", "__cy"])
        .withColumn("dist_m", geo.distance_m(*LOC, "p_longitude", "p_latitude"))
        .where(F.col("dist_m") <= F.lit(float(radius_m)))
        .drop("__cx", "__cy")
    )


# --- aggregates within a radius ----------------------------------------------------


@dataclass(frozen=True)
class Measure:
    """One aggregate of points within a radius.

    ``match`` restricts to points whose attributes equal the given values.
    """

    name: str
    agg: str
    radius_m: float
    column: str | None = None
    match: tuple[tuple[str, str], ...] = field(default=())

    def __post_init__(self):
        if self.agg not in ("count", "avg", "sum", "min", "max"):
            raise ValueError(f"unknown aggregate {self.agg!r}")
        if self.agg != "count" and not self.column:
            raise ValueError(f"{self.agg} needs a column")


def _collapse(points: DataFrame, measures: list[Measure], by: list[str]) -> DataFrame:
    """One row per coordinate, attributes in use and ``by`` columns.

    Any number of points on one spot becomes a single row before the join.
    """
    attrs = sorted({k for m in measures for k, _ in m.match} - set(by))
    values = sorted({m.column for m in measures if m.column})
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in values:
        value = F.col(v).cast("double")
        aggs += [
            F.count(value).alias(f"n_{v}"), F.sum(value).alias(f"sum_{v}"),
            F.min(value).alias(f"min_{v}"), F.max(value).alias(f"max_{v}"),
        ]
    return points.groupBy(*LOC, *attrs, *by).agg(*aggs)


def _merge(m: Measure) -> Column:
    cond = F.col("dist_m") <= F.lit(float(m.radius_m))
    for key, value in m.match:
        cond &= F.col(f"p_{key}").eqNullSafe(F.lit(value))

    def pick(name: str) -> Column:
        return F.when(cond, F.col(f"p_{name}"))

    if m.agg == "count":
        return F.coalesce(F.sum(pick("n")), F.lit(0)).cast("long")
    if m.agg == "avg":
        return F.try_divide(F.sum(pick(f"sum_{m.column}")), F.sum(pick(f"n_{m.column}")))
    merge = {"sum": F.sum, "min": F.min, "max": F.max}[m.agg]
    return merge(pick(f"{m.agg}_{m.column}"))


# Distinct coordinates per cell that are compared one by one.
LEAF_POINTS = 512


def _near_collapsed(locations: DataFrame, points: DataFrame, extra: list[str], radii: list[float],
                    leaf_points: int) -> DataFrame:
    """(location, collapsed point or cell, ``dist_m``) rows within the largest radius.

    Crowded cells are halved again and again into a quadtree whose nodes carry
    the sums of their points and the box around them.  A location takes a node
    as a whole when every radius has all of it inside or all of it outside: the
    node then stands for its points at the distance of the box's far corner.
    Only nodes that a circle cuts are opened.  Distances grow with each
    coordinate difference, in floating point too, so the result is exact.
    """
    reach = max(radii)
    width, height = geo.search_cell_size(reach)

    def cell(level: int) -> dict[str, Column]:
        return {
            f"x{level}": F.floor(F.col("longitude") / F.lit(width / 2**level)).cast("int"),
            f"y{level}": F.floor(F.col("latitude") / F.lit(height / 2**level)).cast("int"),
        }

    crowd = points.withColumns(cell(0)).groupBy("x0", "y0").agg(F.count(F.lit(1)).alias("m"))
    most = crowd.agg(F.max("m")).first()[0] or 0
    depth = 0
    while depth < 12 and most / 4**depth > leaf_points:
        depth += 1
    if depth == 0:
        return near_pairs(locations, points, reach)

    values = [c for c in points.columns if c not in (*LOC, *extra)]
    # One text per attribute combination: join keys must not be null.
    label = F.to_json(F.struct(*extra)) if extra else F.lit("")
    located = points.withColumn("__g", label)
    for level in range(depth + 1):
        located = located.withColumns(cell(level))
    located = materialise(located, "points")
    carried = [*values, *extra]

    def nodes(level: int) -> DataFrame:
        merge = {"min": F.min, "max": F.max}
        cells = [f"x{level}", f"y{level}", *([f"x{level - 1}", f"y{level - 1}"] if level else []), "__g"]
        return located.groupBy(*cells).agg(
            *[merge.get(v.split("_")[0], F.sum)(v).alias(f"p_{v}") for v in values],
            *[F.first(c).alias(f"p_{c}") for c in extra],
            F.min("longitude").alias("__w"), F.max("longitude").alias("__e"),
            F.min("latitude").alias("__s"), F.max("latitude").alias("__t"), F.count(F.lit(1)).alias("__m"),
        )

    keys = list(locations.columns)
    result = [*keys, *[f"p_{c}" for c in carried], "dist_m"]
    frontier = geo.cells_around(locations.withColumns(cell(0)), reach, "x0", "y0")

    def farther(a: str, b: str, at: str) -> Column:
        return F.when(F.abs(F.col(a) - F.col(at)) > F.abs(F.col(b) - F.col(at)), F.col(a)).otherwise(F.col(b))

    found = []
    for level in range(depth + 1):
        above = max(level - 1, 0)
        on = [f"x{above}", f"y{above}", *(["__g"] if level else [])]
        met = split_join(frontier, nodes(level), on).withColumns(
            {
                "dist_m": geo.distance_m(
                    *LOC, farther("__w", "__e", "longitude"), farther("__s", "__t", "latitude")
                ),
                "__near": geo.distance_m(
                    *LOC, F.greatest("__w", F.least("__e", "longitude")), F.greatest("__s", F.least("__t", "latitude"))
                ),
            }
        ).where(F.col("__near") <= F.lit(float(reach)))
        cut = F.lit(False)
        for radius in radii:
            cut |= (F.col("__near") <= F.lit(float(radius))) & (F.col("dist_m") > F.lit(float(radius)))
        small = F.col("__m") <= leaf_points if level < depth else F.lit(True)
        here = [f"x{level}", f"y{level}", "__g"]
        # Written once per level: the next level and both outputs read it.
        met = materialise(
            met.withColumns({"__cut": cut, "__open": cut & small}).select(*result, *here, "__cut", "__open"),
            "nodes",
        )
        side = located.select(*here, *[F.col(c).alias(f"p_{c}") for c in [*LOC, *carried]])
        opened = split_join(met.where("__open").select(*keys, *here), side, here).withColumn(
            "dist_m", geo.distance_m(*LOC, "p_longitude", "p_latitude")
        )
        found += [
            met.where("not __cut").select(*result),
            opened.where(F.col("dist_m") <= F.lit(float(reach))).select(*result),
        ]
        frontier = met.where("__cut and not __open").select(*keys, *here)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def radius_aggregate(locations: DataFrame, points: DataFrame, measures: list[Measure],
                     by: list[str] | None = None, keep_empty: bool = True,
                     leaf_points: int = LEAF_POINTS) -> DataFrame:
    """All measures of all radii from one join at the largest radius.

    Without ``by``: one row per location; a location without points has count 0
    and null otherwise.  With ``by`` (columns of the points, such as a survey
    year): one row per location and value that occurs near it.
    """
    by = by or []
    spots, keys = _spots(locations), list(LOC)
    attrs = sorted({k for m in measures for k, _ in m.match} - set(by))
    near = _near_collapsed(
        spots, materialise(_collapse(points, measures, by), "points"), [*attrs, *by],
        sorted({m.radius_m for m in measures}), leaf_points,
    )
    found = near.groupBy(*keys, *[F.col(f"p_{b}").alias(b) for b in by]).agg(
        *[_merge(m).alias(m.name) for m in measures]
    )
    if by or not keep_empty:
        return found if spots is locations else locations.join(found, keys)
    zero = {m.name: 0 for m in measures if m.agg == "count"}
    out = locations.join(found, keys, "left").select(*locations.columns, *[m.name for m in measures])
    return out.fillna(zero) if zero else out


# --- timelines: what was known up to a year ------------------------------------------


def timeline(per_year: DataFrame, keys: list[str], year: str, values: list[str],
             name: str = "timeline") -> DataFrame:
    """Collect (year, values) per key; there are at most as many as years."""
    entry = F.struct(F.col(year).cast("int").alias("year"), *[F.col(v) for v in values])
    return per_year.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias(name))


def sum_up_to_year(line: Column, year: Column, value: str) -> Column:
    """Total of the entries not after ``year``; 0 when there is none."""
    reached = F.filter(line, lambda e: e["year"] <= year)
    return F.coalesce(
        F.aggregate(reached, F.lit(0).cast("long"), lambda acc, e: acc + e[value]),
        F.lit(0).cast("long"),
    )


def planted_by(location_years: DataFrame, trees: DataFrame, measures: list[Measure],
               planting_year: str = "planting_year", year: str = "year") -> DataFrame:
    """Counts of trees within the radius whose known planting year has come.

    ``location_years`` holds distinct (longitude, latitude, year).  Trees are
    counted once per location and planting year; each scene year then adds up
    its part of that short list, so no (observation, tree) pair is ever formed.
    """
    if any(m.agg != "count" for m in measures):
        raise ValueError("planted_by counts trees; aggregate attributes with radius_aggregate")
    known = trees.where(F.col(planting_year).isNotNull())
    places = location_dimension(location_years)
    names = [m.name for m in measures]
    per_year = radius_aggregate(places, known, measures, by=[planting_year])
    lines = timeline(per_year, list(LOC), planting_year, names)
    out = location_years.join(lines, list(LOC), "left")
    return out.select(
        *location_years.columns,
        *[sum_up_to_year(F.col("timeline"), F.col(year), n).alias(n) for n in names],
    )


def radius_as_of_survey(location_years: DataFrame, points: DataFrame, measures: list[Measure],
                        survey_year: str, year: str = "year") -> DataFrame:
    """Aggregates over the last survey not after the scene year.

    The survey is chosen from the years of the whole dataset, so that a column
    does not depend on which other radii are computed along with it.
    """
    places = location_dimension(location_years)
    names = [m.name for m in measures]
    per_survey = radius_aggregate(places, points, measures, by=[survey_year])
    lines = timeline(per_survey, list(LOC), survey_year, names)
    years = sorted(row[0] for row in points.select(survey_year).distinct().collect())  # a handful
    known = F.array(*[F.lit(int(y)) for y in years]).cast("array<int>")
    joined = location_years.join(lines, list(LOC), "left").withColumn(
        "__survey", F.array_max(F.filter(known, lambda y: y <= F.col(year)))
    )
    entry = F.get(F.filter("timeline", lambda e: e["year"] == F.col("__survey")), F.lit(0))
    out = joined.withColumn("__e", entry).select(
        *location_years.columns, *[F.col(f"__e.{n}").alias(n) for n in names]
    )
    zero = {m.name: 0 for m in measures if m.agg == "count"}
    return out.fillna(zero) if zero else out


# --- nearest ----------------------------------------------------------------------

# Points of a node that are compared one by one; halvings of a search cell, at most.
OPEN_POINTS, HALVINGS = 64, 20


def _crowded(points: DataFrame, radius_m: float) -> bool:
    cx, cy = geo.search_cell(*LOC, radius_m)
    most = points.groupBy(cx.alias("x"), cy.alias("y")).agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0]
    return (most or 0) > LEAF_POINTS


def descended_pairs(rows: DataFrame, points: DataFrame, radius_m: float, temporal: str | None = None,
                    open_points: int = OPEN_POINTS) -> DataFrame:
    """(row, point) pairs within the radius, few of them, among which each row's best point is.

    Branch and bound over a tree of cells, and of time bins when ``temporal``
    is given: ``rows`` then have ``__t`` and points ``__pt``, in microseconds.
    A node knows its number of points, the box around them and their first and
    last time.  So it tells the best it may hold (the near side of the box, the
    time closest to the row's) and what it holds for sure (the far corner, a
    time that one of its points has).  In every step each row keeps the best
    sure thing so far and drops nodes that cannot reach it; the others are
    split, and nodes of few points are opened at the end, if they still compete.
    """
    keys = list(rows.columns)
    width, height = geo.search_cell_size(radius_m)
    bits = 2 if temporal is None else 1
    low, span = 0, 0
    if temporal is not None:
        first, last = points.agg(F.min("__pt"), F.max("__pt")).first()
        if first is not None:
            low, span = first, (last - first).bit_length()

    def shift(step: int) -> int:
        return max(0, span - 2 * step)

    def cell(step: int) -> dict[str, Column]:
        fine = 2 ** (bits * step)
        time = F.lit(0).cast("long") if temporal is None else F.shiftright(F.col("__pt") - F.lit(low), shift(step))
        return {
            "__x": F.floor(F.col("longitude") / F.lit(width / fine)).cast("long"),
            "__y": F.floor(F.col("latitude") / F.lit(height / fine)).cast("long"), "__b": time,
        }

    def nodes(step: int) -> DataFrame:
        times = [] if temporal is None else [F.min("__pt").alias("__t0"), F.max("__pt").alias("__t1")]
        grouped = points.withColumns(cell(step)).groupBy("__x", "__y", "__b").agg(
            F.count(F.lit(1)).alias("__m"), F.min("longitude").alias("__w"), F.max("longitude").alias("__e"),
            F.min("latitude").alias("__s"), F.max("latitude").alias("__n"), *times,
        )
        up, back = (bits, shift(step - 1) - shift(step)) if step else (0, 0)
        return grouped.withColumns(
            {"__px": F.shiftright("__x", up), "__py": F.shiftright("__y", up), "__pb": F.shiftright("__b", back)}
        )

    def farther(a: str, b: str, at: str) -> Column:
        return F.when(F.abs(F.col(a) - F.col(at)) > F.abs(F.col(b) - F.col(at)), F.col(a)).otherwise(F.col(b))

    near = geo.distance_m(
        *LOC, F.greatest("__w", F.least("__e", "longitude")), F.greatest("__s", F.least("__n", "latitude"))
    )
    far = geo.distance_m(*LOC, farther("__w", "__e", "longitude"), farther("__s", "__n", "latitude"))
    if temporal is None:
        usable, hope, sure = F.lit(True), F.lit(0).cast("long"), F.lit(0).cast("long")
        certain = F.lit(True)
    elif temporal == "last_previous":
        usable = F.col("__t0") <= F.col("__t")
        hope = -F.least("__t1", "__t")
        sure = -F.when(F.col("__t1") <= F.col("__t"), F.col("__t1")).otherwise(F.col("__t0"))
        certain = F.col("__far") <= F.lit(float(radius_m))
    else:
        usable = F.col("__t").isNotNull()
        hope = F.greatest(F.col("__t0") - F.col("__t"), F.col("__t") - F.col("__t1"), F.lit(0).cast("long"))
        sure = F.least(F.abs(F.col("__t0") - F.col("__t")), F.abs(F.col("__t1") - F.col("__t")))
        certain = F.col("__far") <= F.lit(float(radius_m))

    cx, cy = geo.search_cell(*LOC, radius_m)
    frontier = geo.cells_around(rows.withColumns({"__px": cx.cast("long"), "__py": cy.cast("long")}), radius_m, "__px", "__py")
    frontier = frontier.withColumns({"__pb": F.lit(0).cast("long"), "__best": F.lit(None).cast("struct<k:bigint,d:double>")})
    own = Window.partitionBy(*keys)
    opened = []
    for step in range(HALVINGS // bits + 1):
        met = split_join(frontier, nodes(step), ["__px", "__py", "__pb"]).withColumns({"__near": near, "__far": far})
        met = met.where((F.col("__near") <= F.lit(float(radius_m))) & usable)
        met = met.withColumns({
            "__hope": F.struct(hope.alias("k"), F.col("__near").alias("d")),
            "__sure": F.when(certain, F.struct(sure.alias("k"), F.col("__far").alias("d"))),
        })
        met = met.withColumn("__best", F.array_min(F.array("__best", F.min("__sure").over(own))))
        met = met.where(F.col("__best").isNull() | (F.col("__hope") <= F.col("__best")))
        met = materialise(met.select(*keys, "__x", "__y", "__b", "__m", "__hope", "__best"), "nodes")
        few = F.col("__m") <= open_points if step < HALVINGS // bits else F.lit(True)
        opened.append(met.where(few).withColumn("__step", F.lit(step)))
        frontier = met.where(~few).select(*keys, F.col("__x").alias("__px"), F.col("__y").alias("__py"), F.col("__b").alias("__pb"), "__best")
        if frontier.isEmpty():
            break
    every = opened[0]
    for part in opened[1:]:
        every = every.unionByName(part)
    # what a later step made sure of closes nodes that an earlier one left open
    every = every.withColumn("__best", F.min("__best").over(own)).where(F.col("__best").isNull() | (F.col("__hope") <= F.col("__best")))
    every = materialise(every.select(*keys, "__x", "__y", "__b", "__step"), "open-nodes")
    side = points.select("*", *[F.col(c).alias(f"p_{c}") for c in points.columns])
    out = None
    for step in range(len(opened)):
        there = side.withColumns(cell(step)).select("__x", "__y", "__b", *[f"p_{c}" for c in points.columns])
        pairs = split_join(every.where(F.col("__step") == step).drop("__step"), there, ["__x", "__y", "__b"])
        out = pairs if out is None else out.unionByName(pairs)
    return (
        out.withColumn("dist_m", geo.distance_m(*LOC, "p_longitude", "p_latitude"))
        .where(F.col("dist_m") <= F.lit(float(radius_m)))
        .drop("__x", "__y", "__b")
    )


def nearest(locations: DataFrame, points: DataFrame, columns: list[str], radius_m: float,
            point_id: str, prefix: str = "") -> DataFrame:
    """Columns of the nearest point, null when none is within the radius.

    Equal distances are settled by the lower id.  Where cells are crowded, a
    bounded descent keeps the pairs few.
    """
    spots, keys = _spots(locations), list(LOC)
    others = [c for c in columns if c != point_id and c not in LOC]
    # Of the points on one spot only the lowest id can win.
    side = materialise(
        points.groupBy(*LOC).agg(
            F.min(point_id).alias(point_id), *[F.min_by(c, point_id).alias(c) for c in others]
        ),
        "points",
    )
    pairs = descended_pairs(spots, side, radius_m) if _crowded(side, radius_m) else near_pairs(spots, side, radius_m)
    best = (
        pairs.groupBy(*keys)
        .agg(
            F.min_by(
                F.struct(*[F.col(f"p_{c}").alias(c) for c in columns], F.col("dist_m")),
                F.struct("dist_m", F.col(f"p_{point_id}")),
            ).alias("hit")
        )
    )
    found = best.select(
        *keys, *[F.col(f"hit.{c}").alias(f"{prefix}{c}") for c in [*columns, "dist_m"]]
    )
    return locations.join(found, keys, "left").select(*locations.columns, *found.columns[len(keys):])


def nearest_as_of(driving: DataFrame, points: DataFrame, columns: list[str], radius_m: float,
                  point_id: str, temporal: str, ts: str = "ts", point_ts: str = "ts",
                  prefix: str = "") -> DataFrame:
    """Nearest point in time, then in space.

    ``last_previous`` takes the latest point not after the driving time,
    ``nearest`` the smallest time difference.  ``driving`` holds distinct
    (longitude, latitude, ts).  Per location the best point of every timestamp
    is kept and merged with the driving times in one ordered pass, so that work
    grows with timestamps per location and not with their product.  Where cells
    are crowded and pairs of locations and points outnumber what is asked and
    what is there, a bounded descent through places and times takes its place.
    """
    if temporal not in ("last_previous", "nearest"):
        raise ValueError(f"unknown temporal mode {temporal!r}")
    keys = list(LOC)
    side = materialise(
        points.groupBy(*LOC, F.col(point_ts).alias("__t")).agg(
            F.min(point_id).alias("__id"), *[F.min_by(c, point_id).alias(f"v_{c}") for c in columns]
        ),
        "points",
    )
    places = location_dimension(driving)
    if _crowded(side, radius_m) and not _few_places(places, driving, side, radius_m):
        return _descended_as_of(driving, side, columns, radius_m, temporal, ts, prefix)
    value = F.struct(
        F.col("p___t").alias("t"), F.col("dist_m").alias("dist"), F.col("p___id").alias("id"),
        *[F.col(f"p_v_{c}").alias(f"v_{c}") for c in columns],
    )
    best = (
        near_pairs(places, side, radius_m)
        .groupBy(*keys, F.col("p___t").alias("__t"))
        .agg(F.min_by(value, F.struct("dist_m", "p___id")).alias("hit"))
    )
    wanted = driving.select(*keys, F.col(ts).alias("__t")).withColumns(
        {"hit": F.lit(None).cast(best.schema["hit"].dataType), "__drive": F.lit(1)}
    )
    merged = wanted.unionByName(best.withColumn("__drive", F.lit(0)))
    # Points sort before driving rows of the same time in both directions.
    past = Window.partitionBy(*keys).orderBy("__t", "__drive").rowsBetween(
        Window.unboundedPreceding, 0
    )
    picked = merged.withColumn("__past", F.last("hit", True).over(past))
    if temporal == "nearest":
        future = Window.partitionBy(*keys).orderBy(F.desc("__t"), "__drive").rowsBetween(
            Window.unboundedPreceding, 0
        )
        picked = picked.withColumn("__next", F.last("hit", True).over(future))

        def score(name: str) -> Column:
            gap = F.abs(
                F.unix_micros(F.col("__t").cast("timestamp"))
                - F.unix_micros(F.col(f"{name}.t").cast("timestamp"))
            )
            return F.struct(gap.alias("g"), F.col(f"{name}.dist").alias("d"), F.col(f"{name}.id").alias("i"))

        both = F.col("__past").isNotNull() & F.col("__next").isNotNull()
        chosen = F.when(
            both, F.when(score("__past") <= score("__next"), F.col("__past")).otherwise(F.col("__next"))
        ).otherwise(F.coalesce("__past", "__next"))
    else:
        chosen = F.col("__past")
    return picked.where(F.col("__drive") == 1).withColumn("hit", chosen).select(
        *keys, F.col("__t").alias(ts),
        *[F.col(f"hit.v_{c}").alias(f"{prefix}{c}") for c in columns],
        F.col("hit.dist").alias(f"{prefix}dist_m"), F.col("hit.t").alias(f"{prefix}ts"),
    )


#: Pairs of a location and a point that cost about as much as one driving row's descent.
PAIRS_PER_ROW = 32


def _few_places(places: DataFrame, driving: DataFrame, points: DataFrame, radius_m: float) -> bool:
    """Whether locations and points around them make few pairs for the rows that ask and the points there are."""
    cx, cy = geo.search_cell(*LOC, radius_m)
    held = points.groupBy(cx.alias("__cx"), cy.alias("__cy")).agg(F.count(F.lit(1)).alias("m"))
    asked = places.groupBy(cx.alias("__cx"), cy.alias("__cy"), *LOC).agg(F.count(F.lit(1)).alias("a"))
    pairs = geo.cells_around(asked, radius_m, "__cx", "__cy").join(held, ["__cx", "__cy"]).agg(F.sum(F.col("a") * F.col("m"))).first()[0]
    return (pairs or 0) <= PAIRS_PER_ROW * (driving.count() + points.count())


def _descended_as_of(driving: DataFrame, side: DataFrame, columns: list[str], radius_m: float, temporal: str,
                     ts: str, prefix: str) -> DataFrame:
    keys = [*LOC, ts]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = materialise(driving.select(*keys).withColumn("__t", micros(ts)), "driving")
    timed = materialise(side.where(F.col("__t").isNotNull()).withColumn("__pt", micros("__t")), "points")
    pairs = descended_pairs(rows, timed, radius_m, temporal)
    gap = F.col("__t") - F.col("p___pt") if temporal == "last_previous" else F.abs(F.col("__t") - F.col("p___pt"))
    if temporal == "last_previous":
        pairs = pairs.where(F.col("p___pt") <= F.col("__t"))
    hit = F.struct(
        *[F.col(f"p_v_{c}").alias(f"{prefix}{c}") for c in columns], F.col("dist_m").alias(f"{prefix}dist_m"),
        F.col("p___t").alias(f"{prefix}ts"),
    )
    best = pairs.groupBy(*keys).agg(F.min_by(hit, F.struct(gap, "dist_m", "p___id")).alias("hit")).select(*keys, "hit.*")
    return rows.drop("__t").join(best, keys, "left")


# --- containment -------------------------------------------------------------------


def within_polygon(locations: DataFrame, polygons: DataFrame, code: str,
                   cell_m: float = 1000.0) -> DataFrame:
    """Lowest code among the polygons that hold each location, or null.

    ``polygons`` has ``rings``.  A polygon
    registers its number and box in the cells that the box touches; a location
    looks into its own cell, and the rings are joined to what passes the box.
    """
    spots, keys = _spots(locations), list(LOC)
    width, height = geo.search_cell_size(cell_m)

    def span(lo: Column, hi: Column, size: float) -> Column:
        return F.explode(
            F.sequence(F.floor(lo / F.lit(size)).cast("int"), F.floor(hi / F.lit(size)).cast("int"))
        )

    named = materialise(polygons.select(F.col(code).alias("__code"), F.col("rings").alias("__rings"), F.monotonically_increasing_id().alias("__row")), "polygons")
    box = geo.rings_bbox("__rings")
    right = (
        named.select("__row", *[v.alias(f"__{k}") for k, v in box.items()])
        .withColumn("__cx", span(F.col("__x0"), F.col("__x1"), width))
        .withColumn("__cy", span(F.col("__y0"), F.col("__y1"), height))
    )
    cx, cy = geo.search_cell(*LOC, cell_m)
    left = spots.withColumns({"__cx": cx, "__cy": cy})
    hits = (
        split_join(left, right, ["__cx", "__cy"])
        .where(
            F.col("longitude").between(F.col("__x0"), F.col("__x1"))
            & F.col("latitude").between(F.col("__y0"), F.col("__y1"))
        )
        .select(*keys, "__row")
        .join(named, "__row")
        .where(geo.in_rings("longitude", "latitude", "__rings"))
        .groupBy(*keys)
        .agg(F.min("__code").alias(code))
    )
    return locations.join(hits, keys, "left").select(*locations.columns, code)


def polygon_filter(df: DataFrame, rings: Column, lon: str = "longitude",
                   lat: str = "latitude") -> DataFrame:
    """Rows inside one boundary: bounding box first, then the exact test."""
    box = geo.rings_bbox(rings)
    return df.where(
        F.col(lon).between(box["x0"], box["x1"])
        & F.col(lat).between(box["y0"], box["y1"])
        & geo.in_rings(lon, lat, rings)
    )
