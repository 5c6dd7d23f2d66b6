"""Map projections as SQL, for the queries that show projected metres.

Each text is a chain of common table expressions from ``source`` (an ``id``
with ``lon`` and ``lat`` in degrees) to the named table with ``id, x, y``.  The
formulas are written out from the projections' definitions; what depends on the
projection's parameters alone is a number worked out in SQL as well.
"""

#: European equal-area metres: GRS 80, centre 10 east and 52 north.
LAEA = """
laea_p as (select 6378137e0 as a, 1e0 / 298.257222101e0 * (2e0 - 1e0 / 298.257222101e0) as e2),
laea_e as (select a, e2, sqrt(e2) as e, sin(radians(52e0)) as s0 from laea_p),
laea_q as (select *, (1e0 - e2) * (1e0 / (1e0 - e2) - ln((1e0 - e) / (1e0 + e)) / (2e0 * e)) as qp,
  (1e0 - e2) * (s0 / (1e0 - e2 * s0 * s0) - ln((1e0 - e * s0) / (1e0 + e * s0)) / (2e0 * e)) as q0 from laea_e),
laea_c as (select *, asin(q0 / qp) as b0, a * sqrt(qp / 2e0) as rq,
  a * cos(radians(52e0)) / sqrt(1e0 - e2 * s0 * s0) / (a * sqrt(qp / 2e0) * cos(asin(q0 / qp))) as d from laea_q),
laea_b as (select id, radians(lon) - radians(10e0) as dl, asin((1e0 - e2) * (sin(radians(lat)) / (1e0 - e2 * sin(radians(lat)) ** 2)
  - ln((1e0 - e * sin(radians(lat))) / (1e0 + e * sin(radians(lat)))) / (2e0 * e)) / qp) as beta, b0, rq, d from source, laea_c),
laea_s as (select *, rq * sqrt(2e0 / (1e0 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(dl))) as b from laea_b),
laea as (select id, 4321000e0 + b * d * cos(beta) * sin(dl) as x,
  3210000e0 + b / d * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(dl)) as y from laea_s)"""

#: Belgian Lambert 72 metres: seven-parameter shift to the 1924 ellipsoid, then the conic with two parallels.
LAMBERT = """
lam_p as (select 6378137e0 as aw, 1e0 / 298.257223563e0 as fw, 6378388e0 as ai, 1e0 / 297e0 as fi, 1e0 / (1e0 - 1.2747e-6) as k,
  radians(0.3366e0 / 3600e0) as wx, radians(-0.457e0 / 3600e0) as wy, radians(1.8422e0 / 3600e0) as wz,
  radians(51.16666723333333e0) as p1, radians(49.8333339e0) as p2),
lam_e as (select *, fw * (2e0 - fw) as e2w, fi * (2e0 - fi) as e2, sqrt(fi * (2e0 - fi)) as e, ai * (1e0 - fi) as bi from lam_p),
lam_m as (select *, cos(p1) / sqrt(1e0 - e2 * sin(p1) ** 2) as m1, cos(p2) / sqrt(1e0 - e2 * sin(p2) ** 2) as m2,
  tan(pi() / 4e0 - p1 / 2e0) / pow((1e0 - e * sin(p1)) / (1e0 + e * sin(p1)), e / 2e0) as t1,
  tan(pi() / 4e0 - p2 / 2e0) / pow((1e0 - e * sin(p2)) / (1e0 + e * sin(p2)), e / 2e0) as t2 from lam_e),
lam_c as (select *, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) as cone from lam_m),
lam_n as (select id, lam_c.*, radians(lon) as l, radians(lat) as f, aw / sqrt(1e0 - e2w * sin(radians(lat)) ** 2) as n from source, lam_c),
lam_g as (select *, n * cos(f) * cos(l) + 106.8686e0 as gx, n * cos(f) * sin(l) - 52.2978e0 as gy, n * (1e0 - e2w) * sin(f) + 103.7239e0 as gz from lam_n),
lam_r as (select *, (gx + wz * gy - wy * gz) * k as bx, (gy - wz * gx + wx * gz) * k as by_, (gz + wy * gx - wx * gy) * k as bz from lam_g),
lam_t as (select *, sqrt(bx * bx + by_ * by_) as p, atan2(bz * ai, sqrt(bx * bx + by_ * by_) * bi) as theta from lam_r),
lam_l as (select *, atan2(bz + e2 / (1e0 - e2) * bi * sin(theta) ** 3, p - e2 * ai * cos(theta) ** 3) as phi,
  cone * (atan2(by_, bx) - radians(4.367486666666666e0)) as gamma from lam_t),
lam_o as (select *, ai * m1 / (cone * pow(t1, cone)) * pow(tan(pi() / 4e0 - phi / 2e0)
  / pow((1e0 - e * sin(phi)) / (1e0 + e * sin(phi)), e / 2e0), cone) as rho from lam_l),
lambert as (select id, 150000.013e0 + rho * sin(gamma) as x, 5400088.438e0 - rho * cos(gamma) as y from lam_o)"""


def rect_sql(size: float) -> str:
    """The tile of a projected point, as text."""
    return f"concat(cast(floor(x / {size}e0) as bigint), '_', cast(floor(y / {size}e0) as bigint))"
