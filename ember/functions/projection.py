"""Map projections as Column math (WGS84 ellipsoid).

Only the two projections the imagery needs: transverse Mercator (UTM zones)
and the cylindrical equal-area grid used for hectares.  All formulas are the
published series / closed forms and stay in generated code.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 ellipsoid, UTM scale and offsets, standard parallel.
A = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING = 10000000.0
STANDARD_PARALLEL = math.radians(30.0)

E2 = FLATTENING * (2 - FLATTENING)
E = math.sqrt(E2)
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Krueger series to third order in n (better than a millimetre inside a zone).
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
CEA_K0 = math.cos(STANDARD_PARALLEL) / math.sqrt(1 - E2 * math.sin(STANDARD_PARALLEL) ** 2)


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def central_meridian(epsg: Column) -> Column:
    """Degrees; EPSG 326zz is north, 327zz south."""
    return (epsg % 100) * F.lit(6.0) - F.lit(183.0)


def _is_north(epsg: Column) -> Column:
    return F.floor(epsg / 100) == 326


def _normal(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Map metres to the unit transverse Mercator plane (xi, eta)."""
    y0 = F.when(_is_north(epsg), F.lit(0.0)).otherwise(F.lit(FALSE_NORTHING))
    return (y - y0) / F.lit(RECTIFYING * UTM_SCALE), (x - F.lit(FALSE_EASTING)) / F.lit(RECTIFYING * UTM_SCALE)


def _straighten(xi: Column, eta: Column) -> tuple[Column, Column]:
    xi1, eta1 = xi, eta
    for j, beta in enumerate(BETA, 1):
        xi1 = xi1 - F.lit(beta) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - F.lit(beta) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return xi1, eta1


def _conformal(xi1: Column, eta1: Column) -> Column:
    return F.asin(F.sin(xi1) / F.cosh(eta1))


def _geodetic(xi1: Column, eta1: Column, chi: Column, epsg: Column) -> tuple[Column, Column]:
    lat = chi
    for j, delta in enumerate(DELTA, 1):
        lat = lat + F.lit(delta) * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + central_meridian(epsg), F.degrees(lat)


def utm_to_lonlat(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """One point as a pair of expressions; use ``with_lonlat`` for many."""
    xi1, eta1 = _straighten(*_normal(x, y, epsg))
    return _geodetic(xi1, eta1, _conformal(xi1, eta1), epsg)


def with_lonlat(df: DataFrame, points: Mapping[str, tuple[Column, Column]], epsg: str = "epsg", digits: int | None = None) -> DataFrame:
    """Add ``<name>_lon, <name>_lat`` for several map points of a row.

    The series is laid out as four projections, each reading the previous one,
    so intermediate angles are computed once per point; EPSG 4326 passes
    through.
    """
    code = F.col(epsg)
    plain = code == 4326
    one = {f"_{n}_{k}": v for n, (x, y) in points.items() for k, v in (("x", x), ("y", y))}
    df = df.withColumns(one)
    at = lambda n, k: F.col(f"_{n}_{k}")
    step = {}
    for n in points:
        step[f"_{n}_xi"], step[f"_{n}_eta"] = _normal(at(n, "x"), at(n, "y"), code)
    df, step = df.withColumns(step), {}
    for n in points:
        step[f"_{n}_p"], step[f"_{n}_q"] = _straighten(at(n, "xi"), at(n, "eta"))
    df, step = df.withColumns(step), {}
    df = df.withColumns({f"_{n}_chi": _conformal(at(n, "p"), at(n, "q")) for n in points})
    for n in points:
        lon, lat = _geodetic(at(n, "p"), at(n, "q"), at(n, "chi"), code)
        lon, lat = F.when(plain, at(n, "x")).otherwise(lon), F.when(plain, at(n, "y")).otherwise(lat)
        if digits is not None:
            unit = F.lit(float(10**digits))
            lon, lat = F.rint(lon * unit) / unit, F.rint(lat * unit) / unit
        step[f"{n}_lon"], step[f"{n}_lat"] = lon, lat
    helpers = [f"_{n}_{k}" for n in points for k in ("x", "y", "xi", "eta", "p", "q", "chi")]
    return df.withColumns(step).drop(*helpers)


def lonlat_to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    phi = F.radians(lat)
    lam = F.radians(lon - central_meridian(epsg))
    s = F.sin(phi)
    k = 2 * math.sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(s) - F.lit(k) * F.atanh(F.lit(k) * s))
    xi1 = F.atan2(t, F.cos(lam))
    eta1 = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    xi, eta = xi1, eta1
    for j, alpha in enumerate(ALPHA, 1):
        xi = xi + F.lit(alpha) * F.sin(2 * j * xi1) * F.cosh(2 * j * eta1)
        eta = eta + F.lit(alpha) * F.cos(2 * j * xi1) * F.sinh(2 * j * eta1)
    north = F.floor(epsg / 100) == 326
    y0 = F.when(north, F.lit(0.0)).otherwise(F.lit(FALSE_NORTHING))
    return F.lit(FALSE_EASTING) + F.lit(UTM_SCALE * RECTIFYING) * eta, y0 + F.lit(UTM_SCALE * RECTIFYING) * xi


def lonlat_to_cea(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area metres with standard parallel 30 degrees."""
    s = F.sin(F.radians(lat))
    es = F.lit(E) * s
    q = F.lit(1 - E2) * (s / (1 - es * es) - F.lit(1 / (2 * E)) * F.log((1 - es) / (1 + es)))
    return F.lit(A * CEA_K0) * F.radians(lon), F.lit(A / (2 * CEA_K0)) * q


def to_lonlat(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """UTM codes are unprojected; 4326 passes through."""
    lon, lat = utm_to_lonlat(x, y, epsg)
    plain = epsg == 4326
    return F.when(plain, x).otherwise(lon), F.when(plain, y).otherwise(lat)


def pixel_xy(rw: Column, cl: Column, transform: Sequence[Column], centre: bool = True) -> tuple[Column, Column]:
    """Affine pixel -> map coordinates; ``transform`` is (a, b, c, d, e, f)."""
    a, b, c, d, e, f = transform
    shift = 0.5 if centre else 0.0
    col, row = cl + F.lit(shift), rw + F.lit(shift)
    return c + a * col + b * row, f + d * col + e * row


def shoelace(points: Sequence[tuple[Column, Column]]) -> Column:
    """Absolute area of a closed ring given as a fixed list of corners.

    Coordinates are taken relative to the first corner: absolute map metres
    would cost several digits on a 20 m cell.
    """
    x0, y0 = points[0]
    total = F.lit(0.0)
    shifted = [(x - x0, y - y0) for x, y in points]
    for (x1, y1), (x2, y2) in zip(shifted, shifted[1:] + shifted[:1]):
        total = total + (x1 * y2 - x2 * y1)
    return F.abs(total) / 2


def ring_area_ha(ring: Column) -> Column:
    """Hectares of a lon/lat ring (array of structs ``lon, lat``)."""

    def project(p: Column) -> Column:
        x, y = lonlat_to_cea(p["lon"], p["lat"])
        return F.struct(x.alias("x"), y.alias("y"))

    metres = F.transform(ring, project)
    x0, y0 = metres[0]["x"], metres[0]["y"]
    following = F.concat(F.slice(metres, 2, F.size(metres)), F.slice(metres, 1, 1))
    terms = F.zip_with(
        metres,
        following,
        lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0),
    )
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)) / 2 / 10000


def cell_area_ha(corners: Sequence[tuple[Column, Column]]) -> Column:
    return shoelace([lonlat_to_cea(lon, lat) for lon, lat in corners]) / 10000


def ring_to_lonlat(ring: Column, epsg: Column) -> Column:
    """Array of ``x, y`` structs to an array of ``lon, lat`` structs.

    Nested transforms carry each point's intermediate angles in a struct, so
    they are computed once per point.
    """

    def first(p: Column) -> Column:
        xi, eta = _normal(p["x"], p["y"], epsg)
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), xi.alias("xi"), eta.alias("eta"))

    def second(p: Column) -> Column:
        xi1, eta1 = _straighten(p["xi"], p["eta"])
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), xi1.alias("p"), eta1.alias("q"))

    def third(p: Column) -> Column:
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), p["p"].alias("p"), p["q"].alias("q"), _conformal(p["p"], p["q"]).alias("chi"))

    def fourth(p: Column) -> Column:
        lon, lat = _geodetic(p["p"], p["q"], p["chi"], epsg)
        plain = epsg == 4326
        return F.struct(F.when(plain, p["x"]).otherwise(lon).alias("lon"), F.when(plain, p["y"]).otherwise(lat).alias("lat"))

    return F.transform(F.transform(F.transform(F.transform(ring, first), second), third), fourth)


def with_footprint(df: DataFrame, out: Sequence[str] = ("fw", "fs", "fe", "fn"), points: int = 21) -> DataFrame:
    """Add west, south, east, north of the map rectangle ``x_min .. y_max``.

    Each edge is cut into ``points + 1`` parts before projection so that the
    bulge of a projected edge is inside the envelope.
    """
    x_min, y_min, x_max, y_max = (F.col(c).cast("double") for c in ("x_min", "y_min", "x_max", "y_max"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(points + 1)), lambda i: i / F.lit(float(points + 1)))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    across = lambda y: F.transform(steps, lambda t: point(x_min + (x_max - x_min) * t, y))
    up = lambda x: F.transform(steps, lambda t: point(x, y_min + (y_max - y_min) * t))
    ring = F.concat(across(y_min), across(y_max), up(x_min), up(x_max))
    placed = df.withColumn("_ring", ring_to_lonlat(ring, F.col("epsg")))
    lons, lats = F.col("_ring.lon"), F.col("_ring.lat")
    bounds = (F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats))
    return placed.withColumns(dict(zip(out, bounds))).drop("_ring")
