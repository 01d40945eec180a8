"""Coordinates as expressions: UTM, affine grids, distances and bearings."""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, pi, radians, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 and the UTM scale factor.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Krüger's series, third order in n: millimetres within a zone.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


@dataclass(frozen=True)
class Grid:
    """A north-up raster frame; rows increase southward."""

    epsg: int
    west: float
    north: float
    resolution: float
    width: int
    height: int

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    def describe(self) -> str:
        return f"EPSG:{self.epsg} {self.width} x {self.height} px at {self.resolution:g} m"


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / F.lit(6.0)) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def utm_forward(lon: Column, lat: Column, zone: Column | int) -> tuple[Column, Column]:
    """(easting, northing) in a zone; the southern false northing is not added."""
    zone = zone if isinstance(zone, Column) else F.lit(zone)
    e = 2 * sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500000.0) + _K0 * _RECT * x, _K0 * _RECT * y


def utm_inverse(x: Column, y: Column, zone: Column | int) -> tuple[Column, Column]:
    """(lon, lat) of northern UTM coordinates."""
    zone = zone if isinstance(zone, Column) else F.lit(zone)
    xi, eta = y / (_K0 * _RECT), (x - 500000.0) / (_K0 * _RECT)
    xi0, eta0 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + (zone * 6 - 183)
    return lon, F.degrees(lat)


def utm_forward_sql(source: str, zone: int) -> str:
    """The forward series as a query over (id, lon, lat)."""
    e = 2 * sqrt(_N) / (1 + _N)
    term = lambda f, g: " + ".join(f"{a!r}::DOUBLE * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(_ALPHA, 1))
    k = _K0 * _RECT
    return f"""SELECT id, 500000 + {k!r}::DOUBLE * (eta + {term("cos", "sinh")}) AS x, {k!r}::DOUBLE * (xi + {term("sin", "cosh")}) AS y
        FROM (SELECT id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta
        FROM (SELECT id, lam, sinh(atanh(s) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * s)) AS t
        FROM (SELECT id, radians(lon - {zone * 6 - 183}) AS lam, sin(radians(lat)) AS s FROM {source})))"""


def utm_inverse_sql(source: str, zone: int) -> str:
    """The inverse series as a query over (x, y)."""
    term = lambda f, g: " + ".join(f"{b!r}::DOUBLE * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, b in enumerate(_BETA, 1))
    k = _K0 * _RECT
    lat = " + ".join(f"{d!r}::DOUBLE * sin({2 * j} * chi)" for j, d in enumerate(_DELTA, 1))
    return f"""SELECT degrees(atan2(sinh(eta0), cos(xi0))) + {zone * 6 - 183} AS lon, degrees(chi + {lat}) AS lat
        FROM (SELECT xi0, eta0, asin(sin(xi0) / cosh(eta0)) AS chi
        FROM (SELECT xi - ({term("sin", "cosh")}) AS xi0, eta - ({term("cos", "sinh")}) AS eta0
        FROM (SELECT y / {k!r}::DOUBLE AS xi, (x - 500000) / {k!r}::DOUBLE AS eta FROM {source})))"""


def snapped(west: Column, south: Column, east: Column, north: Column, res: float) -> dict[str, Column]:
    """A projected box widened to whole pixels, and its size in pixels."""
    w, s = F.floor(west / res) * res, F.floor(south / res) * res
    e, n = F.ceil(east / res) * res, F.ceil(north / res) * res
    return {
        "west": w.cast("double"),
        "south": s.cast("double"),
        "east": e.cast("double"),
        "north": n.cast("double"),
        "width": F.bround((e - w) / res).cast("long"),
        "height": F.bround((n - s) / res).cast("long"),
    }


def to_pixel(x: Column, y: Column, west: float, north: float, res: float) -> tuple[Column, Column]:
    """(column, row) of a projected point, fractional, from the grid's corner."""
    return (x - west) / F.lit(res), (F.lit(north) - y) / F.lit(res)


def pixel_centre(row: Column, col: Column, origin: tuple[float, float], step: tuple[float, float]) -> tuple[Column, Column]:
    """(lon, lat) of pixel centres under an affine frame."""
    return F.lit(origin[0]) + (col + 0.5) * step[0], F.lit(origin[1]) + (row + 0.5) * step[1]


def compass(dx: Column, dy: Column) -> Column:
    """Bearing of a displacement, degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))


def equirect(lon: Column, lat: Column, lon0: float, lat0: float, kx: float = 74.0, ky: float = 111.0) -> tuple[Column, Column]:
    """(kilometres, bearing) from a point, on a local equirectangular plane."""
    dx, dy = (lon - lon0) * kx, (lat - lat0) * ky
    return F.hypot(dx, dy), compass(dx, dy)


def planar_metres(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column, lat0: float = 48.38) -> Column:
    k = 111320.0
    return F.hypot((lon_a - lon_b) * k * cos(radians(lat0)), (lat_a - lat_b) * k)


def opposite(bearing: Column) -> Column:
    return F.pmod(bearing + 180, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def block_id(row: Column, col: Column, res: float = 10.0, size: float = 1000.0) -> Column:
    return (F.floor(row * res / size) * 100000 + F.floor(col * res / size)).cast("long")


DEGREES = 180 / pi
