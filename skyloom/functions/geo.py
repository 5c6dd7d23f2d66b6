"""Geometry as column expressions: distances, cell keys, projections, rings.

Distances are flat-earth: degrees scaled to metres, longitude shrunk by the
cosine of the first point's latitude.  Degree-sized boxes use the cosine of the
fixed reference latitude instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the study area.
METRES_PER_DEGREE = 111320.0
REFERENCE_LATITUDE = 51.0
STUDY_LON = (3.57, 3.86)
STUDY_LAT = (50.96, 51.21)

LAT_DEG_PER_M = 1.0 / METRES_PER_DEGREE
LON_DEG_PER_M = 1.0 / (METRES_PER_DEGREE * math.cos(math.radians(REFERENCE_LATITUDE)))

# Mean edge lengths in metres of the three hexagon sizes in use.
HEX_EDGE_M = {9: 200.786, 8: 531.414, 7: 1406.476}
# Ring-1 neighbours in axial coordinates.
HEX_NEIGHBOURS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def distance_m(lon1, lat1, lon2, lat2) -> Column:
    """Flat-earth distance from point 1 to point 2 in metres."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    north = (lat2 - lat1) * F.lit(METRES_PER_DEGREE)
    east = (lon2 - lon1) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat1))
    return F.sqrt(north * north + east * east)


def search_cell_size(radius_m: float) -> tuple[float, float]:
    """Width and height in degrees of a search cell: the radius at the reference latitude and one per cent.

    A circle reaches one cell north and south, and as many east and west as
    ``columns_around`` says for its latitude.
    """
    return radius_m * LON_DEG_PER_M * 1.01, radius_m * LAT_DEG_PER_M * 1.01


def search_cell(lon, lat, radius_m: float) -> tuple[Column, Column]:
    width, height = search_cell_size(radius_m)
    return (
        F.floor(_c(lon) / F.lit(width)).cast("int"),
        F.floor(_c(lat) / F.lit(height)).cast("int"),
    )


def columns_around(lat, radius_m: float) -> Column:
    """How many cells to either side a circle around a point at this latitude reaches.

    Longitude distances shrink with the cosine of the point's own latitude, so
    circles widen in degrees towards the poles.  Half way round is enough.
    """
    width, _ = search_cell_size(radius_m)
    shrink = F.greatest(F.cos(F.radians(_c(lat))), F.lit(1e-9))
    # the margin covers the rounding of the distance formula
    reach = F.lit(radius_m * LAT_DEG_PER_M * (1 + 1e-9)) / shrink
    return F.least(F.ceil(reach / F.lit(width)), F.lit(math.ceil(360.0 / width)).cast("long")).cast("int")


def cells_around(df: DataFrame, radius_m: float, x: str, y: str, lat: str = "latitude") -> DataFrame:
    """``df`` once for each cell that its circle may reach, in place of its own cell ``x, y``."""
    across = columns_around(lat, radius_m)
    return (
        df.withColumn("__i", F.explode(F.sequence(-across, across)))
        .withColumn("__j", F.explode(F.expr("sequence(-1, 1)")))
        .withColumns({x: F.col(x) + F.col("__i"), y: F.col(y) + F.col("__j")})
        .drop("__i", "__j")
    )


def local_metres(lon, lat) -> tuple[Column, Column]:
    """Equirectangular metres from the study area's south-west corner."""
    return (
        (_c(lon) - F.lit(STUDY_LON[0])) / F.lit(LON_DEG_PER_M),
        (_c(lat) - F.lit(STUDY_LAT[0])) / F.lit(LAT_DEG_PER_M),
    )


def hex_axial(lon, lat, edge_m: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon that holds the point."""
    x, y = local_metres(lon, lat)
    q = (x * F.lit(math.sqrt(3.0) / 3.0) - y * F.lit(1.0 / 3.0)) / F.lit(edge_m)
    r = y * F.lit(2.0 / 3.0) / F.lit(edge_m)
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    fix_r = ~fix_q & (dr > ds)
    return (
        F.when(fix_q, -rr - rs).otherwise(rq).cast("int"),
        F.when(fix_r, -rq - rs).otherwise(rr).cast("int"),
    )


def hex_key(lon, lat, resolution: int = 9) -> Column:
    """``h<res>_<q>_<r>``: a planar hexagon key, not an H3 index."""
    q, r = hex_axial(lon, lat, HEX_EDGE_M[resolution])
    return F.concat(F.lit(f"h{resolution}_"), q.cast("string"), F.lit("_"), r.cast("string"))


def hex_parts(key) -> tuple[Column, Column]:
    parts = F.split(_c(key), "_")
    return parts[1].cast("int"), parts[2].cast("int")


def rect_key(x, y, size_m: float) -> Column:
    """``ix_iy`` of the square tile of the given edge in projected metres."""
    return F.concat_ws(
        "_",
        F.floor(_c(x) / F.lit(float(size_m))).cast("string"),
        F.floor(_c(y) / F.lit(float(size_m))).cast("string"),
    )


def _lit(v: float) -> Column:
    return F.lit(float(v))


# --- projections ---------------------------------------------------------------
# A projection is a list of steps.  Each step maps the values so far (a name ->
# Column lookup) to new named values, so that a step can be a ``withColumns`` on a
# frame or a ``transform`` over the points of a ring, and no formula is repeated
# inside another.


def lambert72_steps() -> list:
    """WGS-84 degrees to Belgian Lambert 72 metres.

    Seven-parameter datum shift, then the two-parallel conformal conic.  All
    steps are closed form; the result is within a metre of the official grid.
    """
    # Ellipsoids, datum shift and projection parameters.
    a_w, f_w = 6378137.0, 1.0 / 298.257223563
    a_i, f_i = 6378388.0, 1.0 / 297.0
    tx, ty, tz = -106.8686, 52.2978, -103.7239
    rx, ry, rz, ppm = 0.3366, -0.457, 1.8422, -1.2747
    lat_1, lat_2 = 51.16666723333333, 49.8333339
    lon_0, x_0, y_0 = 4.367486666666666, 150000.013, 5400088.438

    e2, e2_i = f_w * (2 - f_w), f_i * (2 - f_i)
    wx, wy, wz = (math.radians(v / 3600.0) for v in (rx, ry, rz))
    k = 1.0 / (1.0 + ppm * 1e-6)
    b_i, e = a_i * (1 - f_i), math.sqrt(e2_i)
    ep2 = e2_i / (1 - e2_i)

    def m_of(angle: float) -> float:
        return math.cos(angle) / math.sqrt(1 - e2_i * math.sin(angle) ** 2)

    def t_of(angle: float) -> float:
        es = e * math.sin(angle)
        return math.tan(math.pi / 4 - angle / 2) / ((1 - es) / (1 + es)) ** (e / 2)

    p1, p2 = math.radians(lat_1), math.radians(lat_2)
    cone = (math.log(m_of(p1)) - math.log(m_of(p2))) / (math.log(t_of(p1)) - math.log(t_of(p2)))
    scale = a_i * m_of(p1) / (cone * t_of(p1) ** cone)

    def trig(v):
        lam, phi = F.radians(v("lon")), F.radians(v("lat"))
        return {"sp": F.sin(phi), "cp": F.cos(phi), "sl": F.sin(lam), "cl": F.cos(lam)}

    def normal(v):
        return {"n": _lit(a_w) / F.sqrt(_lit(1.0) - _lit(e2) * v("sp") * v("sp"))}

    def shift(v):
        return {
            "gx": v("n") * v("cp") * v("cl") - _lit(tx),
            "gy": v("n") * v("cp") * v("sl") - _lit(ty),
            "gz": v("n") * _lit(1 - e2) * v("sp") - _lit(tz),
        }

    def rotate(v):  # inverse of a small rotation: its transpose
        gx, gy, gz = v("gx"), v("gy"), v("gz")
        return {
            "bx": (gx + _lit(wz) * gy - _lit(wy) * gz) * _lit(k),
            "by": (gy - _lit(wz) * gx + _lit(wx) * gz) * _lit(k),
            "bz": (gz + _lit(wy) * gx - _lit(wx) * gy) * _lit(k),
        }

    def radius(v):
        return {"p": F.sqrt(v("bx") * v("bx") + v("by") * v("by"))}

    def parametric(v):  # Bowring's closed form for geodetic latitude
        theta = F.atan2(v("bz") * _lit(a_i), v("p") * _lit(b_i))
        return {"st": F.sin(theta), "ct": F.cos(theta)}

    def geodetic(v):
        return {
            "phi": F.atan2(
                v("bz") + _lit(ep2 * b_i) * v("st") * v("st") * v("st"),
                v("p") - _lit(e2_i * a_i) * v("ct") * v("ct") * v("ct"),
            ),
            "gamma": _lit(cone) * (F.atan2(v("by"), v("bx")) - _lit(math.radians(lon_0))),
        }

    def eccentric(v):
        return {"es": _lit(e) * F.sin(v("phi"))}

    def cone_radius(v):
        t = F.tan(_lit(math.pi / 4) - v("phi") / _lit(2.0)) / F.pow(
            (_lit(1.0) - v("es")) / (_lit(1.0) + v("es")), _lit(e / 2)
        )
        return {"rho": _lit(scale) * F.pow(t, _lit(cone))}

    def plane(v):
        return {
            "x": _lit(x_0) + v("rho") * F.sin(v("gamma")),
            "y": _lit(y_0) - v("rho") * F.cos(v("gamma")),
        }

    return [trig, normal, shift, rotate, radius, parametric, geodetic, eccentric, cone_radius, plane]


def laea_steps() -> list:
    """European equal-area metres (ellipsoidal azimuthal), used for areas."""
    # Ellipsoid and projection centre.
    a, f = 6378137.0, 1.0 / 298.257222101
    lat_0, lon_0, x_0, y_0 = math.radians(52.0), math.radians(10.0), 4321000.0, 3210000.0
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q_of(s: float) -> float:
        return (1 - e2) * (
            s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e)
        )

    q_p = q_of(1.0)
    beta_0 = math.asin(q_of(math.sin(lat_0)) / q_p)
    r_q = a * math.sqrt(q_p / 2)
    d = a * math.cos(lat_0) / math.sqrt(1 - e2 * math.sin(lat_0) ** 2) / (r_q * math.cos(beta_0))
    sb0, cb0 = math.sin(beta_0), math.cos(beta_0)

    def start(v):
        return {
            "s": F.sin(F.radians(v("lat"))), "dl": F.radians(v("lon")) - _lit(lon_0),
        }

    def authalic(v):
        s = v("s")
        q = _lit(1 - e2) * (
            s / (_lit(1.0) - _lit(e2) * s * s)
            - F.log((_lit(1.0) - _lit(e) * s) / (_lit(1.0) + _lit(e) * s)) / _lit(2 * e)
        )
        return {"beta": F.asin(q / _lit(q_p))}

    def trig(v):
        return {
            "sb": F.sin(v("beta")), "cb": F.cos(v("beta")),
            "sd": F.sin(v("dl")), "cd": F.cos(v("dl")),
        }

    def stretch(v):
        return {
            "b": _lit(r_q) * F.sqrt(
                _lit(2.0)
                / (_lit(1.0) + _lit(sb0) * v("sb") + _lit(cb0) * v("cb") * v("cd"))
            )
        }

    def plane(v):
        return {
            "x": _lit(x_0) + v("b") * _lit(d) * v("cb") * v("sd"),
            "y": _lit(y_0)
            + (v("b") / _lit(d)) * (_lit(cb0) * v("sb") - _lit(sb0) * v("cb") * v("cd")),
        }

    return [start, authalic, trig, stretch, plane]


def with_projection(df: DataFrame, steps: list, lon="longitude", lat="latitude",
                    x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Add projected coordinates ``x`` and ``y`` to a frame."""
    mark = "__proj_"
    kept = df.columns
    out = df.withColumns({f"{mark}lon": _c(lon), f"{mark}lat": _c(lat)})
    for step in steps:
        out = out.withColumns(
            {f"{mark}{n}": c for n, c in step(lambda n: F.col(mark + n)).items()}
        )
    return out.select(*kept, F.col(f"{mark}x").alias(x), F.col(f"{mark}y").alias(y))


def project_ring(ring: Column, steps: list) -> Column:
    """Project every point of a ring of (x = lon, y = lat)."""
    def advancing(step, kept: list[str]):
        def advance(p: Column) -> Column:
            fresh = step(lambda n: p[n])
            return F.struct(
                *[p[n].alias(n) for n in kept if n not in fresh],
                *[c.alias(n) for n, c in fresh.items()],
            )

        return advance

    out = F.transform(ring, lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))
    names = ["lon", "lat"]
    for step in steps:
        out = F.transform(out, advancing(step, names))
        added = list(step(lambda n: F.lit(0.0)))
        names = [n for n in names if n not in added] + added
    return F.transform(out, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


# --- rings: array<array<struct<x,y>>>, first point repeated at the end ---------


def in_rings(lon, lat, rings) -> Column:
    """Even-odd test over all rings, so holes and parts need no special case."""
    px, py, rings = _c(lon), _c(lat), _c(rings)

    def crossings(ring: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(ring) - 1)

        def flip(inside: Column, i: Column) -> Column:
            a, b = F.get(ring, i - 1), F.get(ring, i)
            spans = (a["y"] > py) != (b["y"] > py)
            at = F.try_divide((b["x"] - a["x"]) * (py - a["y"]), b["y"] - a["y"]) + a["x"]
            return inside != (spans & F.coalesce(px < at, F.lit(False)))

        return F.when(F.size(ring) < 2, F.lit(False)).otherwise(
            F.aggregate(steps, F.lit(False), flip)
        )

    return F.aggregate(rings, F.lit(False), lambda acc, ring: acc != crossings(ring))


def rings_bbox(rings) -> dict[str, Column]:
    """West, south, east and north of all rings."""
    points = F.flatten(_c(rings))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {
        "x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys),
    }


def rectangle_ring(x0, y0, x1, y1) -> Column:
    x0, y0, x1, y1 = map(_c, (x0, y0, x1, y1))

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def valid_rings(rings) -> Column:
    """Keep closed rings of at least four points; null when none is left."""
    kept = F.filter(
        _c(rings),
        lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)),
    )
    return F.when(F.size(kept) > 0, kept)


def ring_area(flat: Column) -> Column:
    """Shoelace area of one ring in plane coordinates, taken from its first point so that large coordinates lose no digits."""
    x0, y0 = F.get(flat, F.lit(0))["x"], F.get(flat, F.lit(0))["y"]
    pairs = F.zip_with(
        F.slice(flat, F.lit(1), F.greatest(F.size(flat) - 1, F.lit(0))),
        F.slice(flat, F.lit(2), F.greatest(F.size(flat) - 1, F.lit(0))),
        lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0),
    )
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)) / F.lit(2.0)


def rings_area_m2(rings) -> Column:
    """Equal-area size: the first ring minus the following ones (holes)."""
    # the area names its ring in every term: as a lambda's argument it is projected once
    projected = F.transform(_c(rings), lambda r: project_ring(r, laea_steps()))
    areas = F.transform(projected, ring_area)
    return F.aggregate(
        areas,
        F.struct(F.lit(0.0).alias("area"), F.lit(1.0).alias("sign")),
        lambda acc, v: F.struct(
            (acc["area"] + acc["sign"] * v).alias("area"), F.lit(-1.0).alias("sign")
        ),
        lambda acc: acc["area"],
    )


def ring_signs(rings) -> Column:
    """1 for rings that bound area, -1 for holes: rings within an odd number of others, as the even-odd test has it."""
    rings = _c(rings)

    def sign(ring: Column, i: Column) -> Column:
        first = F.get(ring, F.lit(0))
        others = F.filter(rings, lambda other, j: j != i)
        return F.when(in_rings(first["x"], first["y"], others), F.lit(-1)).otherwise(F.lit(1))

    return F.transform(rings, sign)


def edge_area_in_circle(x1, y1, x2, y2, radius: float) -> Column:
    """Signed area between the origin and the part of an edge within a circle around the origin.

    Added over a closed ring this is the area that the ring and the circle
    share: triangles where the edge is inside, sectors where it is outside.
    """
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    r2 = F.lit(radius * radius)
    dx, dy = x2 - x1, y2 - y1
    a, b, c = dx * dx + dy * dy, x1 * dx + y1 * dy, x1 * x1 + y1 * y1 - r2
    root = b * b - a * c
    cut = (a > 0) & (root > 0)
    half = F.sqrt(F.when(cut, root).otherwise(F.lit(0.0)))
    over = F.when(a > 0, a).otherwise(F.lit(1.0))
    t1, t2 = (-b - half) / over, (-b + half) / over

    def sector(ux, uy, vx, vy) -> Column:
        return F.atan2(ux * vy - uy * vx, ux * vx + uy * vy) * r2 / F.lit(2.0)

    lo, hi = F.greatest(t1, F.lit(0.0)), F.least(t2, F.lit(1.0))
    px, py, qx, qy = x1 + dx * lo, y1 + dy * lo, x1 + dx * hi, y1 + dy * hi
    inside = (px * qy - py * qx) / F.lit(2.0)
    before = F.when(t1 > 0, sector(x1, y1, px, py)).otherwise(F.lit(0.0))
    after = F.when(t2 < 1, sector(qx, qy, x2, y2)).otherwise(F.lit(0.0))
    return F.when(cut & (t1 < 1) & (t2 > 0), before + inside + after).otherwise(sector(x1, y1, x2, y2))
