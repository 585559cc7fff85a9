"""GeoJSON in and out.

Features are read as VARIANT, so identifiers 1 and "1" stay apart and no schema is inferred. A path may name many
collections (one a file) or files with a feature a line; each file is a territory. Geometry becomes an array of parts
(polygon number, ring number, points), projected to UTM metres.
"""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import crs
from ..functions import geometry as G
from ..functions import pricing as P
from ..functions.constants import BUILDINGS, CHAMBER_REUSE_RADIUS, CROSSINGS, MAX_DEGREE, SIZES, TOUCH
from ..operators import rank, spatial

#: Geometry types that each object type may have.
GEOMETRY_OF = {
    "source": ("Point",),
    "oks_connection_point": ("Point",),
    "heat_chamber": ("Point",),
    "heat_network": ("LineString",),
    "restriction": ("LineString", "MultiLineString", "Polygon", "MultiPolygon"),
}
_PARTS = "array<struct<poly:int,ring:int,points:array<struct<x:double,y:double>>>>"


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _parts(geometry: Column) -> Column:
    """Parts of a geometry in longitude and latitude; null coordinates give none, other types an error."""
    kind = _text(geometry, "$.type")
    nested = lambda depth: F.try_variant_get(geometry, "$.coordinates", "array<" * depth + "double" + ">" * depth)
    xy = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    part = lambda poly, ring, line: F.struct(poly.cast("int").alias("poly"), ring.cast("int").alias("ring"), F.transform(line, xy).alias("points"))
    zero = F.lit(0)
    return (
        F.when(kind == "Point", F.array(F.struct(zero.alias("poly"), zero.alias("ring"), F.array(xy(nested(1))).alias("points"))))
        .when(kind == "LineString", F.array(part(zero, zero, nested(2))))
        .when(kind == "MultiLineString", F.transform(nested(3), lambda line, i: part(i, F.lit(0), line)))
        .when(kind == "Polygon", F.transform(nested(3), lambda ring, i: part(F.lit(0), i, ring)))
        .when(kind == "MultiPolygon", F.flatten(F.transform(nested(4), lambda poly, i: F.transform(poly, lambda ring, j: part(i, j, ring)))))
        .when(kind.isNull(), F.array().cast(_PARTS))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported geometry "), kind)).cast(_PARTS))
    )


def projected(parts: Column, forward: Callable[[Column], Column] = crs.points_to_utm) -> Column:
    return F.transform(parts, lambda r: F.struct(r.poly.alias("poly"), r.ring.alias("ring"), forward(r.points).alias("points")))


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """territory, id_raw, id_key, object_type, restriction_type, diameter, flow_tph, geom_type, lonlat, parts, properties.

    ``lines``: a feature a line, which splits; otherwise each file is one collection, read whole. What isn't a collection is
    an error.
    """
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("territory"), F.parse_json("value").alias("doc"))
    if lines:
        # a filter of a generator's output stays above it; pushed into the scan it would parse each line again for every part of its test
        each = raw.select("territory", F.explode_outer(F.array("doc")).alias("f"))
    else:
        features = F.try_variant_get("doc", "$.features", "array<variant>")
        bad = (_text(F.col("doc"), "$.type") != "FeatureCollection") | features.isNull()
        each = raw.select("territory", F.explode(F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("Input must be a GeoJSON FeatureCollection")).cast("array<variant>")).otherwise(features)).alias("f"))
    f = each.select("territory", F.try_variant_get("f", "$.properties", "variant").alias("properties"), F.try_variant_get("f", "$.geometry", "variant").alias("geometry"))
    p, g = F.col("properties"), F.col("geometry")
    raw_id = F.try_variant_get(p, "$.id", "variant")
    return f.select(
        "territory",
        raw_id.alias("id_raw"),
        P.variant_id_key(raw_id).alias("id_key"),
        _text(p, "$.object_type").alias("object_type"),
        _text(p, "$.restriction_type").alias("restriction_type"),
        F.try_variant_get(p, "$.diameter", "int").alias("diameter"),
        F.try_variant_get(p, "$.flow_tph", "double").alias("flow_tph"),
        _text(g, "$.type").alias("geom_type"),
        _parts(g).alias("lonlat"),
        "properties",
    ).withColumn("parts", projected(F.col("lonlat")))


def input_violations(features: DataFrame) -> DataFrame:
    """(territory, id_key, rule) of features that the model can't take."""
    kind = F.col("object_type")
    wrong = F.lit(False)
    for k, allowed in GEOMETRY_OF.items():
        wrong = wrong | ((kind == k) & ~F.coalesce(F.col("geom_type").isin(*allowed), F.lit(False)))
    flow = F.col("flow_tph")
    rules = F.array(
        F.when(wrong, "invalid geometry"),
        F.when((kind == "oks_connection_point") & flow.isNull(), "missing flow_tph"),
        F.when((kind == "oks_connection_point") & ((flow < 0) | F.isnan(flow) | (flow > SIZES[-1][1] + 1e-9)), "unsupported flow_tph"),
        F.when((kind == "heat_network") & ~F.coalesce(F.col("diameter").isin(*(s[0] for s in SIZES)), F.lit(False)), "missing or unsupported diameter"),
        F.when((kind == "restriction") & F.col("restriction_type").isNull(), "missing restriction_type"),
    )
    own = features.select("territory", "id_key", F.explode(F.array_compact(rules)).alias("rule"))
    twice = features.groupBy("territory", "id_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("territory", "id_key", F.lit("duplicate identifier").alias("rule"))
    return own.unionByName(twice)


def checked(features: DataFrame) -> DataFrame:
    """The features, or an error that names the first rule that they break."""
    bad = input_violations(features).orderBy("territory", "id_key", "rule").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].rule}: {bad[0].id_key}")
    return features


def _rings(features: DataFrame, *more: str) -> DataFrame:
    """(territory, id_key, …, r): a row a part. Of ``explode`` the optimizer would infer a test of the parts' number, which projects all
    positions once more, in the scan."""
    return features.select("territory", "id_key", *more, F.explode_outer("parts").alias("r")).filter("r is not null")


def vertices(features: DataFrame) -> DataFrame:
    """(territory, id_key, object_type, poly, ring, pos, x, y): a row a position."""
    rings = _rings(features, "object_type")
    return rings.select("territory", "id_key", "object_type", "r.poly", "r.ring", F.posexplode("r.points").alias("pos", "p")).select("territory", "id_key", "object_type", "poly", "ring", "pos", "p.x", "p.y")


def legs(features: DataFrame, *more: str) -> DataFrame:
    """(territory, id_key, …, poly, ring, leg, cx, cy, dx, dy): a row a side of each line or ring."""
    rings = _rings(features, *more)
    sides = rings.select("territory", "id_key", *more, "r.poly", "r.ring", F.posexplode(G.legs(F.col("r.points"))).alias("leg", "s"))
    return sides.select("territory", "id_key", *more, "poly", "ring", "leg", F.col("s.a.x").alias("cx"), F.col("s.a.y").alias("cy"), F.col("s.b.x").alias("dx"), F.col("s.b.y").alias("dy"))


def _point(features: DataFrame) -> DataFrame:
    first = F.get(F.get("parts", F.lit(0)).points, F.lit(0))
    return features.withColumns({"x": first.x, "y": first.y})


def terminals(features: DataFrame) -> DataFrame:
    return _point(features.filter("object_type = 'oks_connection_point'")).select("territory", F.col("id_key").alias("id"), "id_raw", "x", "y", F.col("flow_tph").alias("flow"))


def _kind() -> Column:
    return F.when(F.col("object_type") == "restriction", F.col("restriction_type")).otherwise(F.col("object_type"))


def obstacles(features: DataFrame) -> DataFrame:
    """Impassable features with their kind; kinds that may be crossed at a price aren't among them."""
    f = features.filter(F.col("object_type").isin("restriction", "oks_existing", "oks_future")).withColumn("kind", _kind())
    return f.filter(~F.col("kind").isin(*CROSSINGS))


def crossings(features: DataFrame) -> DataFrame:
    """Features that may be crossed at a price, with the parameters of their kind; existing pipes have their size's envelope."""
    f = features.withColumn("kind", _kind()).filter(F.col("kind").isin(*CROSSINGS))
    table = F.broadcast(P.crossing_table(features.sparkSession))  # five rows
    dn = F.col("diameter")
    return f.join(table, "kind").withColumns({"width": F.coalesce("width", P.envelope_width(dn)), "height": F.coalesce("height", P.envelope_height(dn))})


def existing_legs(features: DataFrame) -> DataFrame:
    n = features.filter("object_type = 'heat_network'")
    ends = lambda i: F.get(F.get("parts", F.lit(0)).points, i)
    last = F.size(F.get("parts", F.lit(0)).points) - 1
    n = n.withColumns({"first_x": ends(F.lit(0)).x, "first_y": ends(F.lit(0)).y, "last_x": ends(last).x, "last_y": ends(last).y})
    return legs(n, "diameter", "first_x", "first_y", "last_x", "last_y").withColumnsRenamed({"id_key": "line", "diameter": "dn"})


def tie_candidates(features: DataFrame, spacing: float = 25.0) -> DataFrame:
    """Roots that plans may use: existing chambers of degree 1 to 3, and samples of existing pipes.

    A pipe is sampled every 25 m and where a terminal of its territory projects on it; samples on a chamber go, and of the
    samples in one cell of 2 m the first stays. Columns: territory, tie, x, y, existing_dn, is_chamber, existing_degree, nearby.
    """
    ex = existing_legs(features)
    ch = _point(features.filter("object_type = 'heat_chamber'")).select("territory", F.col("id_key").alias("chamber"), F.col("diameter").alias("own_dn"), F.col("x").alias("px"), F.col("y").alias("py"))
    met = spatial.incidence(ch.withColumn("at", F.concat_ws("\u0001", "territory", "chamber")), ex, "at", "line")
    ch = ch.withColumn("at", F.concat_ws("\u0001", "territory", "chamber")).join(met, "at", "left").withColumns({"degree": F.coalesce("degree", F.lit(0)), "dn": F.coalesce("own_dn", "max_dn", F.lit(500))})
    own = ch.filter(F.col("degree").between(1, MAX_DEGREE - 1)).select("territory", F.concat(F.lit("tie_chamber_"), "chamber").alias("tie"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("dn").alias("existing_dn"), F.lit(True).alias("is_chamber"), F.col("degree").alias("existing_degree"), F.lit("").alias("line"), F.lit(0).alias("leg"), F.lit(0.0).alias("t"))
    length = G.distance(F.col("cx"), F.col("cy"), F.col("dx"), F.col("dy"))
    n = F.greatest(F.lit(1), F.floor(length / spacing)).cast("int")
    even = ex.select("territory", "line", "dn", "leg", "cx", "cy", "dx", "dy", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: i / n)).alias("t"))
    seen = terminals(features).select("territory", F.col("x").alias("tx"), F.col("y").alias("ty"))
    across = ex.filter(length > 1e-8).join(seen, "territory").select("territory", "line", "dn", "leg", "cx", "cy", "dx", "dy", G.projection(*(F.col(c) for c in ("tx", "ty", "cx", "cy", "dx", "dy"))).alias("t"))
    s = even.unionByName(across).distinct().withColumns({"x": F.col("cx") + (F.col("dx") - F.col("cx")) * F.col("t"), "y": F.col("cy") + (F.col("dy") - F.col("cy")) * F.col("t")})
    s = s.withColumn("at", F.concat_ws("\u0001", "territory", "line", "leg", "t")).select("territory", "at", "line", "dn", "leg", "t", "x", "y")
    near = spatial.within(s.select("at", "territory", "x", "y"), ch.select(F.col("territory").alias("ct"), "chamber", F.col("degree").alias("cd"), "px", "py"), CHAMBER_REUSE_RADIUS, ("x", "y"), ("px", "py")).filter("territory = ct")
    around = near.groupBy("at").agg(F.min("d").alias("closest"), F.collect_list(F.struct(F.col("chamber").alias("id"), F.col("cd").cast("int").alias("degree"))).alias("nearby"))
    touch = spatial.incidence(s.select("at", F.col("x").alias("px"), F.col("y").alias("py")), ex, "at", "line")
    s = s.join(around, "at", "left").filter(F.col("closest").isNull() | (F.col("closest") >= TOUCH)).join(touch, "at", "left")
    none = F.array().cast("array<struct<id:string,degree:int>>")
    new = s.select("territory", F.concat(F.lit("tie_net_"), "line", F.lit("_"), F.col("leg").cast("string"), F.lit("_"), F.round("t", 9).cast("string")).alias("tie"), "x", "y", F.greatest("dn", F.coalesce("max_dn", F.lit(500))).alias("existing_dn"), F.lit(False).alias("is_chamber"), F.coalesce("degree", F.lit(2)).alias("existing_degree"), "line", "leg", "t", F.coalesce("nearby", none).alias("nearby"))
    every = own.withColumn("nearby", none).unionByName(new)
    kept = rank.near_distinct(every.withColumn("_c", (~F.col("is_chamber")).cast("int")), "x", "y", ["_c", "line", "leg", "t", "tie"], 2.0, F.col("is_chamber"))
    return kept.select("territory", "tie", "x", "y", "existing_dn", "is_chamber", "existing_degree", "nearby")


def input_audit(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(territory, object_type, features, penalty, sha256): counts, the cost of connecting nobody, and the files' hashes."""
    f = read_features(spark, path, lines)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("territory"), F.sha2("content", 256).alias("sha256"))
    counts = f.groupBy("territory", "object_type").agg(F.count(F.lit(1)).alias("features"), F.sum(F.when(F.col("object_type") == "oks_connection_point", P.disconnection_penalty(F.col("flow_tph")))).alias("penalty"))
    return counts.join(files, "territory", "left")


# ---------------------------------------------------------------- sinks


def lonlat_json(points: Column, back: Callable[[Column], Column] = crs.points_from_utm, digits: int = 12) -> Column:
    """[[lon, lat], …] of an array of points in UTM metres."""
    return F.transform(back(points), lambda p: F.array(F.bround(p.x, digits), F.bround(p.y, digits)))


def geometry_json(points: Column, line: Column) -> Column:
    """GeoJSON text of a line, or of a point, by the flag; null for null points."""
    c = lonlat_json(points)
    return F.when(points.isNull(), F.lit("null")).when(line, F.concat(F.lit('{"type":"LineString","coordinates":'), F.to_json(c), F.lit("}"))).otherwise(F.concat(F.lit('{"type":"Point","coordinates":'), F.to_json(F.get(c, 0)), F.lit("}")))


def safe_properties(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns for strict GIS programs: lists become text with commas, other nested values JSON."""
    out = {}
    for n in names:
        kind = df.schema[n].dataType
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
            out[n] = F.array_join(F.transform(F.col(n), lambda v: v.cast("string")), ",")
        elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            out[n] = F.to_json(F.col(n))
    return df.withColumns(out) if out else df


def as_features(df: DataFrame, geometry: str, names: list[str], nulls: bool = True) -> DataFrame:
    """One text column ``feature``: GeoJSON of each row, with these properties; nulls left out unless wanted."""
    properties = F.to_json(F.struct(*names), {"ignoreNullFields": str(not nulls).lower()})
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.col(geometry), F.lit(',"properties":'), properties, F.lit("}")).alias("feature"))


def write_collection(features: DataFrame, path: str, with_crs: bool = True) -> None:
    """One FeatureCollection in one text file: for a plan's export, which is small by nature."""
    head = '{"type":"FeatureCollection",' + ('"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},' if with_crs else "")
    whole = features.agg(F.array_join(F.collect_list("feature"), ",\n").alias("f"))
    whole.select(F.concat(F.lit(head + '"features":[\n'), F.col("f"), F.lit("\n]}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_lines(features: DataFrame, path: str) -> None:
    """A feature a line, written in parallel: for exports of any size."""
    features.select(F.col("feature").alias("value")).write.mode("overwrite").text(path)


#: Layers for GIS programs: filter, and properties (None: all).
LAYERS = {
    "lines": ("object_type = 'heat_network'", None),
    "points": ("object_type IN ('heat_chamber', 'technical_node')", None),
    "spatial": ("object_type != 'variant_summary'", None),
    "minimal": ("object_type != 'variant_summary'", ["id", "variant_id", "object_type", "diameter", "length", "cost"]),
}


def write_layers(export: DataFrame, folder: str, best: str) -> None:
    """Layers of the best and of all ranked variants, a folder each; the summary row has no geometry and is left out."""
    names = [c for c in export.columns if c != "geometry"]
    for scope, rows in (("best", export.filter(F.col("variant_id") == best)), ("ranked", export)):
        for layer, (test, some) in LAYERS.items():
            keep = [c for c in (some or names) if c in names]
            write_collection(as_features(safe_properties(rows.filter(test), keep), "geometry", keep, nulls=False), f"{folder}/{scope}_{layer}", with_crs=False)


def report(summaries: DataFrame, k: int = 3) -> str:
    """Markdown of the best variants: at most ``k`` rows reach the driver."""
    rows = rank.top(summaries, rank.search_key("missing", bends="bends", cost="cost"), k).collect()
    out = ["# Ranked variants", "", "| rank | variant | missing | score | cost RUB | length m |", "|--:|---|--:|--:|--:|--:|"]
    out += [f"| {i} | {r.plan} | {r.missing} | {r.score:.9f} | {r.cost:.2f} | {r.length:.3f} |" for i, r in enumerate(rows, 1)]
    return "\n".join([*out, "", "Best found within the budget; a global optimum isn't claimed."]) + "\n"


def preview(lines: list[tuple[str, list[tuple[float, float]]]], points: list[tuple[str, float, float]], width: int = 900, margin: int = 20) -> str:
    """SVG of one plan: lines (class, points) and labelled points, scaled to fit."""
    every = [p for _, ps in lines for p in ps] + [(x, y) for _, x, y in points] or [(0.0, 0.0)]
    x0, y0, x1, y1 = min(p[0] for p in every), min(p[1] for p in every), max(p[0] for p in every), max(p[1] for p in every)
    k = (width - 2 * margin) / max(x1 - x0, y1 - y0, 1e-9)
    at = lambda x, y: (margin + (x - x0) * k, margin + (y1 - y) * k)
    height = round(2 * margin + (y1 - y0) * k)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">', "<style>polyline{fill:none;stroke:#888}.heat_network{stroke:#c00}.restriction{stroke:#555}</style>"]
    out += [f'<polyline class="{html.escape(c)}" points="{" ".join(f"{u:.1f},{v:.1f}" for u, v in (at(*p) for p in ps))}"/>' for c, ps in lines]
    for label, x, y in points:
        u, v = at(x, y)
        out.append(f'<circle cx="{u:.1f}" cy="{v:.1f}" r="3"/><text x="{u + 4:.1f}" y="{v:.1f}" font-size="10">{html.escape(str(label))}</text>')
    return "\n".join([*out, "</svg>"])


def obstacle_sides(features: DataFrame) -> DataFrame:
    """Boundary legs of obstacles with their kind, for the distance operators."""
    return legs(obstacles(features), "kind")


def buildings(features: DataFrame) -> DataFrame:
    return obstacles(features).filter(F.col("kind").isin(*BUILDINGS))


def areas(features: DataFrame) -> DataFrame:
    """(territory, obstacle, kind, area): obstacles as arrays of polygons, a polygon an array of rings, its shell first. A line is
    a ring that goes there and back: it has sides and holds nothing."""
    line = F.col("geom_type").isin("LineString", "MultiLineString")
    ring = lambda r: F.when(line, F.concat(r.points, F.slice(F.reverse(r.points), 2, F.greatest(F.size(r.points) - 2, F.lit(0))))).otherwise(r.points)
    polygons = F.array_sort(F.array_distinct(F.transform("parts", lambda r: r.poly)))
    area = F.transform(polygons, lambda p: F.transform(F.filter("parts", lambda r: r.poly == p), ring))
    return obstacles(features).select("territory", F.col("id_key").alias("obstacle"), "kind", area.alias("area"))
