"""Angles, sky coordinates and line geometry as column expressions (degrees in and out)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: north galactic pole (J2000) and longitude of the celestial pole
NGP_RA, NGP_DEC, L_NCP = 192.85948, 27.12825, 122.932


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def _rad(x) -> Column:
    return F.radians(col(x))


def galactic(ra, dec) -> tuple[Column, Column]:
    """Galactic longitude (0 to 360) and latitude."""
    a, d = _rad(ra) - math.radians(NGP_RA), _rad(dec)
    sp, cp = math.sin(math.radians(NGP_DEC)), math.cos(math.radians(NGP_DEC))
    b = F.asin(sp * F.sin(d) + cp * F.cos(d) * F.cos(a))
    turn = F.atan2(F.cos(d) * F.sin(a), cp * F.sin(d) - sp * F.cos(d) * F.cos(a))
    return (F.lit(L_NCP) - F.degrees(turn) + 360.0) % 360.0, F.degrees(b)


def equatorial(l, b) -> tuple[Column, Column]:
    """Right ascension (0 to 360) and declination of galactic coordinates."""
    g, d = F.lit(math.radians(L_NCP)) - _rad(l), _rad(b)
    sp, cp = math.sin(math.radians(NGP_DEC)), math.cos(math.radians(NGP_DEC))
    dec = F.asin(sp * F.sin(d) + cp * F.cos(d) * F.cos(g))
    turn = F.atan2(F.cos(d) * F.sin(g), cp * F.sin(d) - sp * F.cos(d) * F.cos(g))
    return (F.degrees(turn) + NGP_RA + 360.0) % 360.0, F.degrees(dec)


def separation(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance by the haversine form, well-behaved at any distance."""
    d1, d2 = _rad(dec1), _rad(dec2)
    sd, sa = F.sin((d2 - d1) / 2), F.sin((_rad(ra2) - _rad(ra1)) / 2)
    a = sd * sd + F.cos(d1) * F.cos(d2) * sa * sa
    return F.degrees(2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


great_circle_distance = separation


def separation_acos(ra1, dec1, ra2, dec2) -> Column:
    """Great-circle distance by the spherical law of cosines, clamped."""
    d1, d2 = _rad(dec1), _rad(dec2)
    c = F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(_rad(ra1) - _rad(ra2))
    return F.degrees(F.acos(clip(c, -1.0, 1.0)))


def gnomonic(ra, dec, ra0, dec0) -> tuple[Column, Column, Column]:
    """Patch coordinates phi and lambda (arc tangents of the tangent plane's x and y) and the distance from the centre."""
    d, d0, da = _rad(dec), _rad(dec0), _rad(ra) - _rad(ra0)
    c = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(da)
    phi = F.degrees(F.atan(F.cos(d) * F.sin(da) / c))
    lam = F.degrees(F.atan((F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(da)) / c))
    return phi, lam, F.sqrt(phi * phi + lam * lam)


def patch_motion(ra, dec, pmra, pmdec, ra0, dec0) -> tuple[Column, Column]:
    """Proper motion turned by the position angle from the star to the centre."""
    d, d0, da = _rad(dec), _rad(dec0), _rad(ra0) - _rad(ra)
    pa = F.atan2(F.sin(da) * F.cos(d0), F.cos(d) * F.sin(d0) - F.sin(d) * F.cos(d0) * F.cos(da))
    m, n = col(pmra), col(pmdec)
    return m * F.cos(pa) + n * F.sin(pa), n * F.cos(pa) - m * F.sin(pa)


def normalize_360(a) -> Column:
    return F.pmod(col(a), F.lit(360.0))


def normalize_180(a) -> Column:
    return F.pmod(col(a) + 180.0, F.lit(360.0)) - 180.0


def clip(x, low: float, high: float) -> Column:
    """x held between low and high; NaN stays NaN."""
    x = col(x)
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def lerp(a, b, t) -> Column:
    return col(a) + col(t) * (col(b) - col(a))


def is_finite(x) -> Column:
    x = col(x)
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def is_nan(x) -> Column:
    return F.isnan(col(x))


def line_distance(x, y, theta, rho) -> Column:
    """Distance of a point from the line x cos(theta) + y sin(theta) = rho (theta in radians)."""
    return F.abs(col(x) * F.cos(col(theta)) + col(y) * F.sin(col(theta)) - col(rho))


def lines_compatible(theta1, rho1, theta2, rho2, theta_limit: float, rho_limit: float) -> Column:
    """Lines of nearly equal angle and offset; a line turned by half a circle has the opposite offset."""
    gap = F.abs(col(theta1) - col(theta2))
    gap = F.when(gap > math.pi, 2 * math.pi - gap).otherwise(gap)
    turned = F.abs(gap - math.pi) < theta_limit
    gap = F.when(turned, F.abs(gap - math.pi)).otherwise(gap)
    other = F.when(turned, -col(rho2)).otherwise(col(rho2))
    return (gap < theta_limit) & (F.abs(col(rho1) - other) < rho_limit)


def stream_frame(ra0: float, dec0: float, phi1, phi2) -> tuple[Column, Column]:
    """Equatorial coordinates of a frame whose origin lies at (ra0, dec0) and whose first axis points east."""
    p, q, d0 = _rad(phi1), _rad(phi2), math.radians(dec0)
    x, y, z = F.cos(q) * F.cos(p), F.cos(q) * F.sin(p), F.sin(q)
    dec = F.asin(clip(x * math.sin(d0) + z * math.cos(d0), -1.0, 1.0))
    ra = F.degrees(F.atan2(y, x * math.cos(d0) - z * math.sin(d0))) + ra0
    return normalize_360(ra), F.degrees(dec)


def rv_valid(rv="rv") -> Column:
    return (F.abs(col(rv)) > 0.001) & (F.abs(col(rv)) < 1000.0)


def dist_valid(distance="distance") -> Column:
    return (col(distance) > 0.1) & (col(distance) < 500.0)


def parallax_distance(parallax, distance=None) -> Column:
    """Distance in kpc: the given one, else 1/parallax above 0.01 mas, else 100; 0 without either."""
    by_plx = F.when(col(parallax) > 0.01, 1.0 / col(parallax)).otherwise(100.0)
    return by_plx if distance is None else F.coalesce(col(distance), by_plx)


def flux_magnitude(flux) -> Column:
    """22.5 - 2.5 log10(flux) for positive flux, else null."""
    return F.when(col(flux) > 0, 22.5 - 2.5 * F.log10(col(flux)))


def flux_magnitude_error(flux, ivar) -> Column:
    return F.when((col(flux) > 0) & (col(ivar) > 0), 2.5 / (math.log(10) * col(flux) * F.sqrt(col(ivar))))
