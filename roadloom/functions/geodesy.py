"""Map projections and ground resolution as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84 and the UTM grid; the sphere that ground resolution uses (fixed values).
A, FLATTENING, K0, EAST0, NORTH0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
SPHERE = 6371007.0
E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)


def gd(tau: Column) -> Column:
    """Gudermannian."""
    return 2 * F.atan(F.exp(tau)) - math.pi / 2


def gd_inv(rho: Column) -> Column:
    return F.ln(1 / F.cos(rho) + F.tan(rho))


def mercator_from_latlon(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(y, x) in the unit square, north at 0."""
    return (math.pi - gd_inv(F.radians(lat))) / (2 * math.pi), (math.pi + F.radians(lon)) / (2 * math.pi)


def latlon_from_mercator(y: Column, x: Column) -> tuple[Column, Column]:
    return F.degrees(gd(math.pi - 2 * math.pi * y)), F.degrees(2 * math.pi * x - math.pi)


def pixel_from_latlon(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Pixel coordinates at a zoom level, truncated."""
    y, x = mercator_from_latlon(lat, lon)
    return tuple((c * (256 * 2**zoom)).cast("bigint") for c in (y, x))


def latlon_from_pixel(y: Column, x: Column, zoom: int) -> tuple[Column, Column]:
    """The middle of a pixel, which maps back to it."""
    return latlon_from_mercator((y + 0.5) / (256 * 2**zoom), (x + 0.5) / (256 * 2**zoom))


def ground_resolution(lat: Column, zoom: Column) -> Column:
    """Metres a pixel."""
    return 2 * math.pi * SPHERE * F.cos(F.radians(lat)) / (256 * F.pow(F.lit(2.0), zoom))


def derive_zoom(lat: Column, goal: float, deviation: float = 0.0) -> Column:
    """The smallest of three levels about the ideal one whose resolution is at most ``goal + deviation``."""
    ideal = F.log2(2 * math.pi * SPHERE * F.cos(F.radians(lat)) / (256 * goal))
    low = F.floor(ideal)
    fits = lambda z: ground_resolution(lat, z) <= goal + deviation
    return F.when(fits(low - 1), low - 1).when(fits(low), low).otherwise(F.ceil(ideal)).cast("int")


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_from_latlon(lat: Column, lon: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """(northing, easting) by the transverse Mercator series; the zone is the point's own unless given."""
    zone = utm_zone(lon) if zone is None else zone
    phi, n2 = F.radians(lat), E2
    lam = F.radians(lon - ((zone - 1) * 6 - 177))
    n = A / F.sqrt(1 - n2 * F.pow(F.sin(phi), 2))
    t, c, a = F.pow(F.tan(phi), 2), EP2 * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    m = A * (
        (1 - n2 / 4 - 3 * n2**2 / 64 - 5 * n2**3 / 256) * phi - (3 * n2 / 8 + 3 * n2**2 / 32 + 45 * n2**3 / 1024) * F.sin(2 * phi)
        + (15 * n2**2 / 256 + 45 * n2**3 / 1024) * F.sin(4 * phi) - 35 * n2**3 / 3072 * F.sin(6 * phi)
    )
    east = K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * F.pow(a, 5) / 120) + EAST0
    north = K0 * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * F.pow(a, 6) / 720))
    return F.when(lat < 0, north + NORTH0).otherwise(north), east


def latlon_from_utm(north: Column, east: Column, zone: int | Column, southern: bool = False) -> tuple[Column, Column]:
    """The inverse series, in a given zone."""
    zone = F.lit(zone) if isinstance(zone, int) else zone
    x, y = east - EAST0, north - (NORTH0 if southern else 0.0)
    mu = y / K0 / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    e = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    p = mu + (3 * e / 2 - 27 * e**3 / 32) * F.sin(2 * mu) + (21 * e**2 / 16 - 55 * e**4 / 32) * F.sin(4 * mu) + 151 * e**3 / 96 * F.sin(6 * mu) + 1097 * e**4 / 512 * F.sin(8 * mu)
    c, t = EP2 * F.pow(F.cos(p), 2), F.pow(F.tan(p), 2)
    root = 1 - E2 * F.pow(F.sin(p), 2)
    n, r = A / F.sqrt(root), A * (1 - E2) / F.pow(root, 1.5)
    d = x / (n * K0)
    lat = p - n * F.tan(p) / r * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * F.pow(d, 6) / 720)
    lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * F.pow(d, 5) / 120) / F.cos(p)
    return F.degrees(lat), F.degrees(lon) + ((zone - 1) * 6 - 177)


def translate(lat: Column, lon: Column, north: float = 0.0, east: float = 0.0) -> tuple[Column, Column]:
    """A point moved by metres within its UTM zone (northern hemisphere)."""
    zone = utm_zone(lon)
    n, e = utm_from_latlon(lat, lon, zone)
    return latlon_from_utm(n + north, e + east, zone)


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in degrees with longitudes shortened by latitude."""
    dx = (lon1 - lon2) * F.cos(F.radians(lat1))
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(dx, 2))


#: Fixed values of the satellite windows, in pixels: what is added around a region, and the step of which its size is a multiple.
PADDING, STRIDE = 100, 88


def image_bounds(north: Column, west: Column, south: Column, east: Column, zoom: int) -> Column:
    """Pixels ``(top, left, bottom, right)`` of a padded region cut to whole steps, the odd pixel taken off at the top and left."""
    (top, left), (bottom, right) = pixel_from_latlon(north, west, zoom), pixel_from_latlon(south, east, zoom)

    def fitted(low: Column, high: Column) -> tuple[Column, Column]:
        over = F.pmod(high - low + 2 * PADDING, F.lit(STRIDE))
        return low - PADDING + F.ceil(over / 2), high + PADDING - F.floor(over / 2)

    (top, bottom), (left, right) = fitted(top, bottom), fitted(left, right)
    return F.struct(*[c.cast("bigint").alias(n) for n, c in (("top", top), ("left", left), ("bottom", bottom), ("right", right))])


def image_statistics(regions: DataFrame, goal: float = 0.5, deviation: float = 0.25, levels: range = range(10, 23)) -> DataFrame:
    """Zoom, resolution, pixels and square metres of the image of each of ``regions(place, north, west, south, east)``.

    The zoom level follows from a region's middle latitude; a level outside ``levels`` gives null bounds.
    """
    middle = (F.col("north") + F.col("south")) / 2
    out = regions.withColumn("zoom", derive_zoom(middle, goal, deviation)).withColumn("gsd", ground_resolution(middle, F.col("zoom")))
    box = F.coalesce(*[F.when(F.col("zoom") == z, image_bounds(F.col("north"), F.col("west"), F.col("south"), F.col("east"), z)) for z in levels])
    out = out.withColumn("box", box)
    corner = lambda y, x: [F.coalesce(*[F.when(F.col("zoom") == z, latlon_from_pixel(F.col(f"box.{y}"), F.col(f"box.{x}"), z)[k]) for z in levels]) for k in (0, 1)]
    (n1, e1), (n2, e2) = (utm_from_latlon(*corner(y, x)) for y, x in (("top", "left"), ("bottom", "right")))
    return out.select("place", "zoom", "gsd", (F.col("box.bottom") - F.col("box.top")).alias("height"), (F.col("box.right") - F.col("box.left")).alias("width"), (F.abs(n1 - n2) * F.abs(e2 - e1)).alias("area"))
