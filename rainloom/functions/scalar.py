"""Scalar physics and geometry as Column expressions; NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the haversine package and of the azimuthal equidistant projection.
EARTH_KM, AEQD_RADIUS_M = 6371.0088, 6370997.0


def rate_from_reflectivity(dbz: Column, a: float = 200.0, b: float = 1.6, offset: float = 0.0) -> Column:
    """Rain rate in mm/h from reflectivity in dBZ by Z = a * R**b."""
    return F.pow(F.pow(F.lit(10.0), (dbz + offset) / 10.0) / a, F.lit(1.0 / b))


def reflectivity_from_rate(rate: Column, a: float = 200.0, b: float = 1.6) -> Column:
    """Reflectivity in dBZ from a rate; a ten-thousandth keeps dry cells finite.  NULL below minus that."""
    wet = rate + 1e-4
    return F.when(wet > 0, 10.0 * F.log10(a * F.pow(wet, F.lit(b))))


def echelon_down(x: Column, offset: float = 0.0, speed: float = 5.0) -> Column:
    return (1.0 + F.tanh(-speed * (x - offset))) / 2.0


def echelon_up(x: Column, offset: float = 0.0, speed: float = 5.0) -> Column:
    return 1.0 - echelon_down(x, offset, speed)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def degrees_to_center(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Euclidean distance in degrees."""
    return F.sqrt(F.pow(lat - lat0, F.lit(2)) + F.pow(lon - lon0, F.lit(2)))


def aeqd_to_geographic(x: Column, y: Column, lon0: float, lat0: float, radius: float = AEQD_RADIUS_M) -> tuple[Column, Column]:
    """(lon, lat) in degrees of azimuthal equidistant coordinates in metres; the centre maps to itself."""
    rho = F.sqrt(x * x + y * y)
    c, p = rho / radius, F.radians(F.lit(lat0))
    sine = F.cos(c) * F.sin(p) + F.try_divide(y * F.sin(c) * F.cos(p), rho)
    lat = F.when(rho == 0, F.lit(float(lat0))).otherwise(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine)))))
    lon = lon0 + F.degrees(F.atan2(x * F.sin(c), rho * F.cos(p) * F.cos(c) - y * F.sin(p) * F.sin(c)))
    lon = F.when(rho == 0, F.lit(float(lon0))).otherwise(lon)
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon), lat


def antenna_to_cartesian(azimuth: Column, rng: Column, elevation: Column, site_alt: Column | float = 0.0) -> tuple[Column, Column, Column]:
    """(x, y, z) in metres of a radar gate under the four-thirds earth model; z includes the site's height."""
    k = 4.0 / 3.0 * 6371000.0
    e, a = F.radians(elevation), F.radians(azimuth)
    z = F.sqrt(rng * rng + k * k + 2.0 * rng * k * F.sin(e)) - k
    s = k * F.asin(rng * F.cos(e) / (k + z))
    return s * F.sin(a), s * F.cos(a), z + site_alt


def georeferenced(azimuth: Column, rng: Column, elevation: Column, site_lon: float, site_lat: float, site_alt: float) -> tuple[Column, Column, Column]:
    """(lon, lat, alt) of a radar gate."""
    x, y, z = antenna_to_cartesian(azimuth, rng, elevation, site_alt)
    lon, lat = aeqd_to_geographic(x, y, site_lon, site_lat)
    return lon, lat, z


def destination(lat: Column, lon: Column, bearing: Column, km: Column | float) -> tuple[Column, Column]:
    """(lat, lon) reached from a point after ``km`` on a great circle; circles are sequences of bearings."""
    d = F.lit(km) / EARTH_KM if not isinstance(km, Column) else km / EARTH_KM
    a, t = F.radians(lat), F.radians(bearing)
    lat2 = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    lon2 = F.radians(lon) + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(lat2))
    return F.degrees(lat2), F.pmod(F.degrees(lon2) + 540, F.lit(360.0)) - 180


def timedelta_label(seconds: Column) -> Column:
    """Length of a step as nDAY, nHOUR or nMIN: the count of its largest unit."""
    s = seconds.cast("long")
    label = lambda width, name: F.concat(F.floor(s / width).cast("string"), F.lit(name))
    return F.when(s >= 86400, label(86400, "DAY")).when(s >= 3600, label(3600, "HOUR")).otherwise(label(60, "MIN"))


def filename_time(name: Column) -> Column:
    """Time that a product's file name tells, TIMESTAMP_NTZ; NULL for other names.

    The first kind whose mark the name contains decides, in this order: IMERG, gsmap, Romuald, .RAW, .vol, L1_, L2_.
    """
    ts = lambda text, fmt: F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    dots, under = F.split(name, r"\."), F.split(name, "_")
    digits = F.regexp_replace(F.get(dots, F.lit(0)), "[^0-9]", "")
    imerg = F.split(F.get(dots, F.lit(4)), "-")
    imerg = F.regexp_replace(F.concat(F.get(imerg, F.lit(0)), F.get(imerg, F.lit(1))), "S", "")
    second_last = F.get(under, F.size(under) - 2)
    return (
        F.when(name.contains("IMERG"), ts(imerg, "yyyyMMddHHmmss"))
        .when(name.contains("gsmap"), ts(F.concat(F.get(dots, F.lit(1)), F.get(dots, F.lit(2))), "yyyyMMddHHmm"))
        .when(name.contains("Romuald"), ts(second_last, "yyyyMMddHHmmss"))
        .when(name.contains(".RAW"), ts(digits, "yyMMddHHmmss"))
        .when(name.contains(".vol"), ts(F.substring(digits, F.lit(1), F.length(digits) - 2), "yyyyMMddHHmmss"))
        .when(name.contains("L1_") | name.contains("L2_"), ts(second_last, "'S'yyyyMMdd'T'HHmm"))
    )
