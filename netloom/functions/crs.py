"""Coordinates: WGS84 to UTM zone 37 north and back, a rotated city system, and grid cells. All are column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import UTM_EASTING, UTM_MERIDIAN, UTM_SCALE, WGS84_A, WGS84_F

_E2 = WGS84_F * (2 - WGS84_F)
_EP2 = _E2 / (1 - _E2)
_E1 = (1 - math.sqrt(1 - _E2)) / (1 + math.sqrt(1 - _E2))
#: Coefficients of the meridian arc: of the latitude itself, then of the sines of its 2nd, 4th and 6th multiples.
_ARC = (
    1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256,
    -(3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024),
    15 * _E2**2 / 256 + 45 * _E2**3 / 1024,
    -(35 * _E2**3 / 3072),
)
#: Of the footpoint latitude: sines of the 2nd, 4th, 6th and 8th multiples.
_FOOT = (3 * _E1 / 2 - 27 * _E1**3 / 32, 21 * _E1**2 / 16 - 55 * _E1**4 / 32, 151 * _E1**3 / 96, 1097 * _E1**4 / 512)


def _horner(x: Column, *coefficients) -> Column:
    """Coefficients from the highest power of x down."""
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


#: The projections as steps: each gives names to what the next ones use more than once.
_TO_UTM = (
    lambda v: {"phi": F.radians(v["y"]), "lam": F.radians(v["x"]) - math.radians(UTM_MERIDIAN)},
    lambda v: {"sin": F.sin(v["phi"]), "cos": F.cos(v["phi"]), "tan": F.tan(v["phi"])},
    lambda v: {"nu": WGS84_A / F.sqrt(1 - _E2 * v["sin"] * v["sin"]), "t": v["tan"] * v["tan"], "c": _EP2 * v["cos"] * v["cos"], "a": v["cos"] * v["lam"]},
    lambda v: {"a2": v["a"] * v["a"], "arc": WGS84_A * (_ARC[0] * v["phi"] + sum((k * F.sin(2 * (i + 1) * v["phi"]) for i, k in enumerate(_ARC[1:])), F.lit(0.0)))},
    lambda v: {
        "x": UTM_EASTING + UTM_SCALE * v["nu"] * v["a"] * _horner(v["a2"], (5 - 18 * v["t"] + v["t"] * v["t"] + 72 * v["c"] - 58 * _EP2) / 120, (1 - v["t"] + v["c"]) / 6, 1.0),
        "y": UTM_SCALE * (v["arc"] + v["nu"] * v["tan"] * v["a2"] * _horner(v["a2"], (61 - 58 * v["t"] + v["t"] * v["t"] + 600 * v["c"] - 330 * _EP2) / 720, (5 - v["t"] + 9 * v["c"] + 4 * v["c"] * v["c"]) / 24, 0.5)),
    },
)
_FROM_UTM = (
    lambda v: {"mu": v["y"] / (UTM_SCALE * WGS84_A * _ARC[0])},
    lambda v: {"foot": v["mu"] + sum((k * F.sin(2 * (i + 1) * v["mu"]) for i, k in enumerate(_FOOT)), F.lit(0.0))},
    lambda v: {"sin": F.sin(v["foot"]), "cos": F.cos(v["foot"]), "tan": F.tan(v["foot"])},
    lambda v: {"w": 1 - _E2 * v["sin"] * v["sin"], "t": v["tan"] * v["tan"], "c": _EP2 * v["cos"] * v["cos"]},
    lambda v: {"nu": WGS84_A / F.sqrt(v["w"]), "rho": WGS84_A * (1 - _E2) / (v["w"] * F.sqrt(v["w"]))},
    lambda v: {"d": (v["x"] - UTM_EASTING) / (v["nu"] * UTM_SCALE)},
    lambda v: {"d2": v["d"] * v["d"]},
    lambda v: {
        "x": UTM_MERIDIAN + F.degrees(v["d"] / v["cos"] * _horner(v["d2"], (5 - 2 * v["c"] + 28 * v["t"] - 3 * v["c"] * v["c"] + 8 * _EP2 + 24 * v["t"] * v["t"]) / 120, -(1 + 2 * v["t"] + v["c"]) / 6, 1.0)),
        "y": F.degrees(v["foot"] - v["nu"] * v["tan"] / v["rho"] * v["d2"] * _horner(v["d2"], (61 + 90 * v["t"] + 298 * v["c"] + 45 * v["t"] * v["t"] - 252 * _EP2 - 3 * v["c"] * v["c"]) / 720, -(5 + 3 * v["t"] + 10 * v["c"] - 4 * v["c"] * v["c"] - 9 * _EP2) / 24, 0.5)),
    },
)


def _of_columns(x: Column, y: Column, steps) -> tuple[Column, Column]:
    v = {"x": x, "y": y}
    for step in steps:
        v |= step(v)
    return v["x"], v["y"]


def _of_points(points: Column, steps) -> Column:
    """The steps as passes over an array of points (x, y). Lambdas are interpreted and share no common parts, so written as one
    expression a projection would compute its sines some hundred times a point; in passes each is computed once."""
    names = ["x", "y"]

    def named(step, keep, added):
        def one(p):
            more = step(p)
            added.extend(more)
            return F.struct(*(p[n].alias(n) for n in keep), *(c.alias(n) for n, c in more.items()))

        return one

    for step in steps:
        added: list[str] = []
        last = step is steps[-1]
        points = F.transform(points, named(step, [] if last else list(names), added))
        names += added
    return points


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    return _of_columns(lon, lat, _TO_UTM)


def from_utm(x: Column, y: Column) -> tuple[Column, Column]:
    return _of_columns(x, y, _FROM_UTM)


def points_to_utm(points: Column) -> Column:
    """An array of points (x: longitude, y: latitude) in metres, as ``to_utm`` gives them."""
    return _of_points(points, _TO_UTM)


def points_from_utm(points: Column) -> Column:
    """An array of points in metres as points (x: longitude, y: latitude), as ``from_utm`` gives them."""
    return _of_points(points, _FROM_UTM)


def rotate(x: Column, y: Column, origin: tuple[float, float], angle: float) -> tuple[Column, Column]:
    """Into the system whose first axis lies at ``angle``. An angle of (nearly) zero leaves points where they are."""
    if abs(angle) < 1e-12:
        return x, y
    cos, sin = math.cos(angle), math.sin(angle)
    dx, dy = x - origin[0], y - origin[1]
    return cos * dx + sin * dy, cos * dy - sin * dx


def unrotate(x: Column, y: Column, origin: tuple[float, float], angle: float) -> tuple[Column, Column]:
    if abs(angle) < 1e-12:
        return x, y
    cos, sin = math.cos(angle), math.sin(angle)
    return cos * x - sin * y + origin[0], sin * x + cos * y + origin[1]


def cell_of(v: Column, step: float, rounded: bool = True) -> Column:
    """Grid coordinate of a position: fractional, or the nearest cell (halves to even)."""
    return F.bround(v / step).cast("long") if rounded else v / step


def cell_center(cell: Column, step: float, override: Column | None = None) -> Column:
    center = cell * step
    return center if override is None else F.coalesce(override, center)
