"""WGS84 geodesics for the azimuthal-equidistant frame, and UTM as column expressions.

The geodesics iterate, which column expressions can only do by repeating themselves, so they run as Arrow-batched
functions over whole columns; the number of iterations is fixed, and a point that has not converged by then (close to the
antipode of the centre) is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the UTM grid.
A = 6378137.0
FLATTENING = 1 / 298.257223563
B = A * (1 - FLATTENING)
UTM_SCALE = 0.9996
UTM_EAST = 500000.0
UTM_SOUTH = 10000000.0
ROUNDS = 12


def _series(cos2_alpha):
    u2 = cos2_alpha * (A**2 - B**2) / B**2
    big = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    small = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    return big, small


def _delta(small, sin_s, cos_s, cos_2m):
    inner = cos_s * (2 * cos_2m**2 - 1) - small / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)
    return small * sin_s * (cos_2m + small / 4 * inner)


def inverse(lat0: float, lon0: float, lat, lon):
    """Distance and azimuth from the centre to each point."""
    u1 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat0)))
    u2 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat)))
    gap = np.radians((np.asarray(lon) - lon0 + 540.0) % 360.0 - 180.0)
    lam = gap
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    with np.errstate(all="ignore"):
        for _ in range(ROUNDS):
            sin_s = np.hypot(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
            cos_s = s1 * s2 + c1 * c2 * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * np.sin(lam) / sin_s)
            cos2_a = 1 - sin_a**2
            cos_2m = np.where(cos2_a == 0, 0.0, cos_s - 2 * s1 * s2 / cos2_a)
            c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
            before = lam
            lam = gap + (1 - c) * FLATTENING * sin_a * (
                sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1))
            )
        big, small = _series(cos2_a)
        away = B * big * (sigma - _delta(small, sin_s, cos_s, cos_2m))
    azimuth = np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam))
    lost = np.abs(lam - before) > 1e-11
    if np.any(lost):
        raise ValueError("a point near the antipode of the centre has no place in its frame")
    return away, azimuth


def direct(lat0: float, lon0: float, away, azimuth):
    """Point at a distance and azimuth from the centre."""
    u1 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat0)))
    s1, c1 = np.sin(u1), np.cos(u1)
    sin_z, cos_z = np.sin(azimuth), np.cos(azimuth)
    sigma1 = np.arctan2(np.tan(u1), cos_z)
    sin_a = c1 * sin_z
    cos2_a = 1 - sin_a**2
    big, small = _series(cos2_a)
    sigma = away / (B * big)
    for _ in range(ROUNDS):
        cos_2m = np.cos(2 * sigma1 + sigma)
        sigma = away / (B * big) + _delta(small, np.sin(sigma), np.cos(sigma), cos_2m)
    cos_2m = np.cos(2 * sigma1 + sigma)
    sin_s, cos_s = np.sin(sigma), np.cos(sigma)
    lat = np.arctan2(
        s1 * cos_s + c1 * sin_s * cos_z, (1 - FLATTENING) * np.hypot(sin_a, s1 * sin_s - c1 * cos_s * cos_z)
    )
    lam = np.arctan2(sin_s * sin_z, c1 * cos_s - s1 * sin_s * cos_z)
    c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
    gap = lam - (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m**2 - 1)))
    return np.degrees(lat), lon0 + np.degrees(gap)


def aeqd_forward(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Metres east and north of the centre (struct x, y)."""

    @F.pandas_udf("x double, y double")
    def project(lons: pd.Series, lats: pd.Series) -> pd.DataFrame:
        away, azimuth = inverse(lat0, lon0, lats.to_numpy(), lons.to_numpy())
        return pd.DataFrame({"x": away * np.sin(azimuth), "y": away * np.cos(azimuth)})

    return project(lon, lat)


def aeqd_inverse(x: Column, y: Column, lon0: float, lat0: float) -> Column:
    """Longitude and latitude of a position in the frame (struct lon, lat)."""

    @F.pandas_udf("lon double, lat double")
    def unproject(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        lats, lons = direct(lat0, lon0, np.hypot(xs, ys).to_numpy(), np.arctan2(xs, ys).to_numpy())
        return pd.DataFrame({"lon": lons, "lat": lats})

    return unproject(x, y)


def aeqd_inverse_lines(line: Column, lon0: float, lat0: float) -> Column:
    """Lines of positions (array of x, y) as lines of longitude and latitude (array of lon, lat).

    All points of a batch of lines are solved together and cut into lines again; a null line stays null, a null point is a
    point without coordinates.
    """

    @F.arrow_udf("array<struct<lon double, lat double>>")
    def unproject(lines: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
        points = lines.flatten()
        xs, ys = (pc.cast(pc.struct_field(points, [i]), pa.float64()).to_numpy(zero_copy_only=False) for i in (0, 1))
        lats, lons = direct(lat0, lon0, np.hypot(xs, ys), np.arctan2(xs, ys))
        gone = np.isnan(xs) | np.isnan(ys)
        solved = pa.StructArray.from_arrays([pa.array(lons, mask=gone), pa.array(lats, mask=gone)], ["lon", "lat"])
        return pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), ends]), solved, mask=lines.is_null())

    return unproject(line)


def aeqd_definition(lon0: Column, lat0: Column, digits: int = 9) -> Column:
    return F.format_string(f"+proj=aeqd +lat_0=%.{digits}f +lon_0=%.{digits}f +datum=WGS84 +units=m", lat0, lon0)


def utm_zone(lon: Column, lat: Column) -> Column:
    """Zone number with the exceptions for south-west Norway and Svalbard."""
    plain = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    svalbard = (
        F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    )
    return (
        F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), F.lit(32))
        .when((lat >= 72) & (lat <= 84) & (lon >= 0) & (lon < 42), svalbard)
        .otherwise(plain)
        .cast("int")
    )


def utm_definition(zone: Column, lat: Column) -> Column:
    south = F.when(lat < 0, F.lit(" +south")).otherwise(F.lit(""))
    return F.concat(F.lit("+proj=utm +zone="), zone.cast("string"), south, F.lit(" +datum=WGS84 +units=m"))


def utm_forward(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series, third order in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    skew = 2 * n**0.5 / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(skew) * F.atanh(F.lit(skew) * s))
    gap = F.radians(lon - (zone * 6 - 183))
    xi = F.atan2(t, F.cos(gap))
    eta = F.atanh(F.sin(gap) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = F.lit(UTM_SCALE * radius)
    y = scale * north + F.when(lat < 0, F.lit(UTM_SOUTH)).otherwise(F.lit(0.0))
    return scale * east + F.lit(UTM_EAST), y


def utm_inverse(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude of an easting and northing; the series that undo `utm_forward`."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    scale = F.lit(UTM_SCALE * radius)
    xi = (y - F.when(south, F.lit(UTM_SOUTH)).otherwise(F.lit(0.0))) / scale
    eta = (x - F.lit(UTM_EAST)) / scale
    up, across = xi, eta
    for j, b in enumerate(beta, start=1):
        up = up - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        across = across - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(up) / F.cosh(across))
    lat = chi
    for j, d in enumerate(delta, start=1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    lon = zone * 6 - 183 + F.degrees(F.atan2(F.sinh(across), F.cos(up)))
    return F.pmod(lon + 540.0, F.lit(360.0)) - 180.0, F.degrees(lat)


# How WGS84 and its UTM zones are named.
DEGREES = r"(?i)(EPSG:(?:[0-9.]*:)?4326|CRS:?84)$"
UTM_CODE = r"(?i)EPSG:(?:[0-9.]*:)?32([67])(0[1-9]|[1-5][0-9]|60)$"
UTM_TEXT = r"(?i)^\+proj=utm .*\+zone=([1-9]|[1-5][0-9]|60)( |$)"
OTHER_EARTH = r"(?i)\+(datum|ellps)=(?!WGS84( |$))|\+towgs84=|\+to_meter=|\+units=(?!m( |$))"


def to_wgs84(x: Column, y: Column, crs: Column) -> tuple[Column, Column]:
    """Longitude and latitude of coordinates whose reference system `crs` names, row by row.

    WGS84 degrees stay as they are, WGS84 / UTM positions (by EPSG code or definition) are converted. Any other system, and
    none, is an error.
    """
    code = F.regexp_extract(crs, UTM_CODE, 2)
    text = F.when(~crs.rlike(OTHER_EARTH), F.regexp_extract(crs, UTM_TEXT, 1)).otherwise(F.lit(""))
    zone = F.when(code != "", code).when(text != "", text).cast("int")
    south = F.when(code != "", F.regexp_extract(crs, UTM_CODE, 1) == "7").otherwise(crs.contains("+south"))
    lon, lat = utm_inverse(x, y, zone, south)
    known, placed = crs.rlike(DEGREES), zone.isNotNull()
    wrong = F.raise_error(
        F.concat(F.lit("neither longitude and latitude nor UTM on WGS84: "), F.coalesce(crs, F.lit("no reference system")))
    ).cast("double")
    return F.when(known, x).when(placed, lon).otherwise(wrong), F.when(known, y).when(placed, lat).otherwise(wrong)
