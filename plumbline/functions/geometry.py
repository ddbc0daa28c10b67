"""Look geometry, distances, pixel coordinates and the quadratic surface, as
column expressions that stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import as_col, is_finite

HEADING_CONVENTION = "satellite_flight_heading_clockwise_from_north"
DIRECTIONS = ("toward_satellite", "away_from_satellite")
EARTH_RADIUS_M = 6_371_008.8
#: Terms of the quadratic surface, in the order of its coefficients.
BASIS = ("x", "y", "1", "x*y", "x^2", "y^2")

Num = Column | str | float


def _num(v: Num) -> Column:
    return F.lit(float(v)) if isinstance(v, int | float) else as_col(v)


def los_unit_vector(incidence_deg: Num, heading_deg: Num, *, heading_convention: str = HEADING_CONVENTION, positive_direction: str = "toward_satellite") -> tuple[Column, Column, Column]:
    """East, north and up coefficients of the line of sight.

    Null where an angle is null or not finite. An incidence outside [0, 90]
    degrees stops the job with an error.
    """
    if heading_convention != HEADING_CONVENTION:
        raise ValueError(f"heading convention {heading_convention!r} is not {HEADING_CONVENTION!r}")
    if positive_direction not in DIRECTIONS:
        raise ValueError(f"positive direction {positive_direction!r} is none of {DIRECTIONS}")
    sign = 1.0 if positive_direction == "toward_satellite" else -1.0
    inc, head = _num(incidence_deg), _num(heading_deg)
    known = is_finite(inc) & is_finite(head)
    checked = F.when(known & ~inc.between(0.0, 90.0), F.raise_error(F.lit("incidence must lie in [0, 90] degrees")).cast("double")).when(known, F.radians(inc))
    turn = F.when(known, F.radians(head))
    s = F.lit(sign)
    return s * -F.cos(turn) * F.sin(checked), s * F.sin(turn) * F.sin(checked), s * F.cos(checked)


def enu_to_los(east: Num, north: Num, up: Num, incidence_deg: Num, heading_deg: Num, **convention: str) -> Column:
    """A rate in east, north and up, seen along the line of sight."""
    le, ln, lu = los_unit_vector(incidence_deg, heading_deg, **convention)
    return le * _num(east) + ln * _num(north) + lu * _num(up)


def _sigma(v: Num) -> Column:
    s = _num(v)
    return F.when(s < 0, F.raise_error(F.lit("sigma must not be negative")).cast("double")).when(is_finite(s), s)


def project_diagonal_sigma(sigma_east: Num, sigma_north: Num, sigma_up: Num, incidence_deg: Num, heading_deg: Num, **convention: str) -> Column:
    """One sigma along the line of sight from independent components."""
    parts = zip(los_unit_vector(incidence_deg, heading_deg, **convention), (sigma_east, sigma_north, sigma_up), strict=True)
    squares = [(c * _sigma(s)) * (c * _sigma(s)) for c, s in parts]
    return F.sqrt(squares[0] + squares[1] + squares[2])


def project_full_sigma(sigma_east: Num, sigma_north: Num, sigma_up: Num, cov_en: Num, cov_eu: Num, cov_nu: Num, incidence_deg: Num, heading_deg: Num, **convention: str) -> Column:
    """One sigma along the line of sight from the full covariance; null where
    rounding or an impossible covariance makes the variance negative."""
    le, ln, lu = los_unit_vector(incidence_deg, heading_deg, **convention)
    se, sn, su = (_sigma(s) for s in (sigma_east, sigma_north, sigma_up))
    variance = le * le * se * se + ln * ln * sn * sn + lu * lu * su * su + F.lit(2.0) * (le * ln * _num(cov_en) + le * lu * _num(cov_eu) + ln * lu * _num(cov_nu))
    return F.when(variance >= 0, F.sqrt(variance))


def decompose_two_looks(los_a: Num, los_d: Num, inc_a: Num, head_a: Num, inc_d: Num, head_d: Num, north: Num, *, least_determinant: float = 0.05, **convention: str) -> tuple[Column, Column]:
    """East and up rates from an ascending and a descending look after the
    north rate is taken out; null where the geometry is too weak."""
    ae, an, au = los_unit_vector(inc_a, head_a, **convention)
    de, dn, du = los_unit_vector(inc_d, head_d, **convention)
    a, d = _num(los_a) - an * _num(north), _num(los_d) - dn * _num(north)
    det = ae * du - au * de
    ok = F.abs(det) >= least_determinant
    return F.when(ok, F.try_divide(a * du - au * d, det)), F.when(ok, F.try_divide(ae * d - de * a, det))


def haversine_m(lon1: Num, lat1: Num, lon2: Num, lat2: Num, *, earth_radius_m: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres; null where a coordinate is missing or a
    latitude exceeds 90 degrees."""
    if not (earth_radius_m > 0 and math.isfinite(earth_radius_m)):
        raise ValueError("the radius must be positive and finite")
    x1, y1, x2, y2 = (_num(v) for v in (lon1, lat1, lon2, lat2))
    half_lat, half_lon = F.sin(F.radians(y2 - y1) / 2), F.sin(F.radians(x2 - x1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * half_lon * half_lon
    known = is_finite(x1) & is_finite(x2) & (F.abs(y1) <= 90) & (F.abs(y2) <= 90)
    return F.when(known, F.lit(2 * earth_radius_m) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))))


def normalize_pixel(column: Num, row: Num, width: Num, height: Num) -> tuple[Column, Column]:
    """Pixel index to [-1, 1] about the middle of the raster, (x, y); null outside it."""

    def one(i: Column, n: Column) -> Column:
        return F.when((i >= 0) & (i < n), F.try_divide((i + 1.0) - (n + 1.0) / 2.0, n / 2.0))

    return one(_num(column).cast("double"), _num(width).cast("double")), one(_num(row).cast("double"), _num(height).cast("double"))


def quadratic_basis(x: Num, y: Num) -> Column:
    """The six terms of the surface, in the order of BASIS."""
    a, b = _num(x), _num(y)
    return F.array(a, b, F.lit(1.0), a * b, a * a, b * b)


def predict_quadratic(coefficients: Column | str, x: Num, y: Num) -> Column:
    c, a, b = as_col(coefficients), _num(x), _num(y)
    return c[0] * a + c[1] * b + c[2] + c[3] * (a * b) + c[4] * (a * a) + c[5] * (b * b)
