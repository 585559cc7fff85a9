"""Pieces of SQL that several oracles share."""

from __future__ import annotations

from ..functions.constants import CROSSINGS, SIZES

SIZES_CTE = "sizes(dn, cap, max_len, price, width, height) AS (VALUES " + ", ".join(f"({a}, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE, {f}::DOUBLE)" for a, b, c, d, e, f in SIZES) + ")"
KINDS_CTE = "kinds(kind, factor) AS (VALUES " + ", ".join(f"('{k}', {v[0]}::DOUBLE)" for k, v in CROSSINGS.items()) + ")"


def dn_of(flow: str, length: str = "0") -> str:
    return f"(SELECT min(z.dn) FROM sizes z WHERE z.cap + 1e-9 >= {flow} AND z.max_len + 1e-9 >= {length})"


def chamber(dn: str) -> str:
    return f"CASE WHEN {dn} <= 200 THEN 3000000 WHEN {dn} <= 500 THEN 5000000 WHEN {dn} <= 1000 THEN 8000000 ELSE 12000000 END"


def dist(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({ax}-{bx})*({ax}-{bx})+({ay}-{by})*({ay}-{by}))"


def point_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    sq = f"(({bx}-{ax})*({bx}-{ax})+({by}-{ay})*({by}-{ay}))"
    t = f"coalesce(least(1.0, greatest(0.0, (({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay}))/CASE WHEN {sq} > 1e-12 THEN {sq} END)), 0.0)"
    return dist(px, py, f"({ax}+{t}*({bx}-{ax}))", f"({ay}+{t}*({by}-{ay}))")


def segments_meet(a: str, b: str, c: str, d: str) -> str:
    """Prefixes of the four points' columns: ax, ay and so on."""
    cross = lambda p, q, r: f"(({q}x-{p}x)*({r}y-{p}y)-({q}y-{p}y)*({r}x-{p}x))"
    return f"(greatest({a}x,{b}x) >= least({c}x,{d}x) AND greatest({c}x,{d}x) >= least({a}x,{b}x) AND greatest({a}y,{b}y) >= least({c}y,{d}y) AND greatest({c}y,{d}y) >= least({a}y,{b}y) AND {cross(a, b, c)}*{cross(a, b, d)} <= 0 AND {cross(c, d, a)}*{cross(c, d, b)} <= 0)"


def segment_segment(a: str, b: str, c: str, d: str) -> str:
    ps = lambda p, q, r: point_segment(f"{p}x", f"{p}y", f"{q}x", f"{q}y", f"{r}x", f"{r}y")
    return f"CASE WHEN {segments_meet(a, b, c, d)} THEN 0.0 ELSE least({ps(a, c, d)}, {ps(b, c, d)}, {ps(c, a, b)}, {ps(d, a, b)}) END"


def turn(a: str, b: str, c: str) -> str:
    u, v = (f"({b}x-{a}x)", f"({b}y-{a}y)"), (f"({c}x-{b}x)", f"({c}y-{b}y)")
    lu, lv = f"sqrt({u[0]}*{u[0]}+{u[1]}*{u[1]})", f"sqrt({v[0]}*{v[0]}+{v[1]}*{v[1]})"
    return f"degrees(acos(least(1.0, greatest(-1.0, ({u[0]}*{v[0]}+{u[1]}*{v[1]})/CASE WHEN {lu} > 1e-9 AND {lv} > 1e-9 THEN {lu}*{lv} END))))"
