"""Lookups and prices as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import BUILDINGS, CHAMBER_STEPS, COST_UNIT, COST_WEIGHT, CROSSINGS, FIT, LENGTH_UNIT, LENGTH_WEIGHT, NORMAL_DEPTH, PENALTY_BASE, PENALTY_PER_TPH, SIZES, SLOPE, TIE_IN_COST


def size_table(spark: SparkSession) -> DataFrame:
    """dn, cap, max_len, price, width, height: 18 rows, safe to broadcast."""
    return spark.createDataFrame([(a, b, float(c), float(d), e, f) for a, b, c, d, e, f in SIZES], "dn int, cap double, max_len double, price double, width double, height double")


def crossing_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in CROSSINGS.items()], "kind string, factor double, width double, height double, top double, v_gap double, h_gap double, window double")


def id_key(raw: Column, numeric: bool) -> Column:
    """Identifiers of different types stay apart: ``n:`` and the integer value, or ``s:`` and the text."""
    if not numeric:
        return F.concat(F.lit("s:"), raw.cast("string"))
    whole = raw == F.floor(raw)
    return F.concat(F.lit("n:"), F.when(whole, raw.cast("bigint").cast("string")).otherwise(raw.cast("string")))


def variant_id_key(v: Column) -> Column:
    """The same for a VARIANT: strings and numbers only, anything else is an error."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(kind == "STRING", F.concat(F.lit("s:"), F.try_variant_get(v, "$", "string")))
        .when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.when(number == F.floor(number), F.concat(F.lit("n:"), number.cast("bigint").cast("string"))).otherwise(F.concat(F.lit("n:"), number.cast("string"))))
        .otherwise(F.raise_error(F.lit("Identifiers must be strings or finite numbers")))
    )


def _stepped(value: Column, pairs) -> Column:
    out = None
    for bound, result in pairs:
        test = F.lit(True) if bound is None else value <= bound
        out = F.when(test, result) if out is None else out.when(test, result)
    return out


def chamber_price(dn: Column) -> Column:
    return _stepped(dn, CHAMBER_STEPS).cast("long")


def select_dn(flow: Column, length: Column | None = None, strict: bool = False) -> Column:
    """The least size whose capacity and longest run suffice. None fits: null, or an error if ``strict``.

    The table is a literal of 18 rows, so this is one expression in generated code: no join, no shuffle.
    """
    length = F.lit(0.0) if length is None else length
    out = None
    for dn, cap, longest, *_ in SIZES:
        fits = (F.lit(cap + FIT) >= flow) & (F.lit(longest + FIT) >= length)
        out = F.when(fits, dn) if out is None else out.when(fits, dn)
    valid = (flow >= 0) & (length >= 0) & ~F.isnan(flow) & ~F.isnan(length)
    bad = F.raise_error(F.lit("no supported size")) if strict else F.lit(None)
    return F.when(valid, out.otherwise(bad.cast("int"))).otherwise(bad.cast("int"))


def _of_size(dn: Column, i: int) -> Column:
    out = None
    for row in SIZES:
        out = F.when(dn == row[0], float(row[i])) if out is None else out.when(dn == row[0], float(row[i]))
    return out


def pipe_price(dn: Column) -> Column:
    return _of_size(dn, 3)


def capacity(dn: Column) -> Column:
    return _of_size(dn, 1)


def longest_run(dn: Column) -> Column:
    return _of_size(dn, 2)


def envelope_width(dn: Column) -> Column:
    return _of_size(dn, 4)


def envelope_height(dn: Column) -> Column:
    return _of_size(dn, 5)


def disconnection_penalty(flow: Column) -> Column:
    return PENALTY_BASE + PENALTY_PER_TPH * flow


def clearance(kind: Column, dn: Column) -> Column:
    """Distance of a pipe's axis from an impassable object: 5, 7 or 9 m from buildings, 1 m from others, and half its width."""
    margin = F.when(kind.isin(*BUILDINGS), F.when(dn < 500, 5.0).when(dn <= 800, 7.0).otherwise(9.0)).otherwise(1.0)
    return margin + envelope_width(dn) / 2


def depth_factor(depth: Column) -> Column:
    return 1 + SLOPE * F.greatest(F.lit(0.0), depth - NORMAL_DEPTH)


def piece_depth_factor(start: Column, end: Column) -> Column:
    """Mean of the factors at the ends; 1 where there is no depth."""
    return F.coalesce((depth_factor(start) + depth_factor(end)) / 2, F.lit(1.0))


def crossing_factor(kind: Column) -> Column:
    out = None
    for k, v in CROSSINGS.items():
        out = F.when(kind == k, v[0]) if out is None else out.when(kind == k, v[0])
    return out


def opening_price(is_chamber: Column, dn: Column, existing_dn: Column) -> Column:
    """A tie into an existing chamber has one price; a new chamber has that of the larger of the two sizes."""
    return F.when(is_chamber, F.lit(TIE_IN_COST).cast("long")).otherwise(chamber_price(F.greatest(dn, existing_dn)))


def edge_key(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def turn_price(ax: Column, ay: Column, bx: Column, by: Column, price_of_right_angle: float) -> Column:
    """In proportion to the angle between two headings; under 8 degrees free."""
    cosine = (ax * bx + ay * by) / (F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
    return F.when(angle < F.radians(F.lit(8.0)), 0.0).otherwise(price_of_right_angle * angle / (F.pi() / 2))


def score(cost: Column, length: Column) -> Column:
    return COST_WEIGHT * cost / COST_UNIT + LENGTH_WEIGHT * length / LENGTH_UNIT
