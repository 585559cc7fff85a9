"""Independent audit of exported plans: every rule as rows (plan, rule, object, expected, actual). A valid export has none.

Figures are derived again from the exported geometry and the source; nothing of the search is used. All plans of all exports
are audited at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import polyline as L
from ..functions import pricing as P
from ..functions.constants import CONTINUOUS_FIT_AUDIT, ENVELOPE_TOLERANCE_AUDIT, FIT, PENALTY_BASE, TIE_IN_COST, TOUCH
from ..functions.geometry import distance, legs
from ..sources import geojson
from . import graph, linear, routes, spatial
from .base import cut

#: Absolute tolerances of the audit.
TOLERANCE = {"flow": 1e-6, "length": 0.002, "pipe_cost": 30.0, "chamber_cost": 0.01, "chamber_total": 0.1, "construction": 0.2, "penalty": 0.01, "total": 0.2, "total_length": 0.02, "score": 1e-8, "turn": 2e-5}


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Finite, and within a relative 1e-9 or the absolute tolerance."""
    finite = ~(F.isnan(a) | F.isnan(b)) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return F.coalesce(finite & (F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))), F.lit(False))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Pipes, chambers, nodes and summaries of exported collections, a row each, with typed columns."""
    f = geojson.read_features(spark, path)
    v = lambda name, kind: F.try_variant_get("properties", f"$.{name}", kind)
    key = lambda name: F.when(v(name, "variant").isNotNull(), P.variant_id_key(v(name, "variant")))
    numbers = ("length", "cost", "depth_start", "depth_end", "depth_factor", "special_factor", "score", "construction_cost", "pipe_construction_cost", "chamber_construction_cost", "unconnected_penalty", "calculated_cost", "new_network_length", "existing_chamber_tie_in_cost")
    out = f.select("territory", "id_key", "object_type", v("variant_id", "string").alias("plan"), key("start_node_id").alias("start"), key("end_node_id").alias("end"), "flow_tph", "diameter", *(v(n, "double").alias(n) for n in numbers), v("rank", "int").alias("rank"), v("mode", "string").alias("mode"), v("existing_chamber_tie_in_count", "int").alias("tie_count"), v("connected_oks_count", "int").alias("connected"), v("unconnected_oks_ids", "array<variant>").alias("missing"), v("crossing_object_ids", "array<string>").alias("crossing_ids"), v("laying_method", "string").alias("laying"), F.get("parts", F.lit(0)).points.alias("points"))
    return out


def _bad(df: DataFrame, rule: str, obj: Column | str, expected: Column | None = None, actual: Column | None = None) -> DataFrame:
    obj = F.col(obj) if isinstance(obj, str) else obj
    none = F.lit(None).cast("double")
    return df.select(F.col("plan").cast("string").alias("plan"), F.lit(rule).alias("rule"), obj.cast("string").alias("object"), (none if expected is None else expected.cast("double")).alias("expected"), (none if actual is None else actual.cast("double")).alias("actual"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def files(export: DataFrame) -> DataFrame:
    """Rules of a file: unique identifiers, one to three variants with one summary each, one mode, ranks that follow scores."""
    s = export.filter("object_type = 'variant_summary'")
    twice = export.groupBy("territory", "id_key").agg(F.count(F.lit(1)).alias("n"), F.first("plan").alias("plan")).filter("n > 1")
    plans = export.groupBy("territory").agg(F.count_distinct("plan").alias("n"), F.min("plan").alias("plan")).filter("n > 3")
    one = export.groupBy("territory", "plan").agg(F.count_if(F.col("object_type") == "variant_summary").alias("n")).filter("n != 1")
    modes = s.groupBy("territory").agg(F.count_distinct("mode").alias("n"), F.min("plan").alias("plan")).filter("n > 1")
    w = Window.partitionBy("territory").orderBy("rank", "score")
    order = s.withColumns({"_r": F.lag("rank").over(w), "_s": F.lag("score").over(w)})
    kinds = export.filter(~F.col("object_type").isin("heat_network", "heat_chamber", "technical_node", "variant_summary"))
    return _union([
        _bad(twice, "duplicate identifier", "id_key"),
        _bad(plans, "more than three variants", "territory"),
        _bad(one, "one summary a variant", "plan"),
        _bad(modes, "mixed modes", "territory"),
        _bad(order.filter("rank = _r"), "duplicate ranks", "id_key"),
        _bad(order.filter("score < _s - 1e-9"), "rank contradicts score", "id_key", F.col("_s"), F.col("score")),
        _bad(kinds, "unexpected output type", "id_key"),
    ])


def pipes(export: DataFrame) -> DataFrame:
    """Rules of a pipe by itself: real geometry, length, cost, size, turns and 2D depths."""
    p = export.filter("object_type = 'heat_network'")
    length = L.length(F.col("points"))
    cost = length * P.pipe_price(F.col("diameter")) * P.piece_depth_factor(F.col("depth_start"), F.col("depth_end")) * F.col("special_factor")
    p = p.withColumns({"_length": length}).withColumn("_cost", cost)
    step = F.when(F.size("points") > 2, F.sequence(F.lit(1), F.size("points") - 2)).otherwise(F.array().cast("array<int>"))

    def sharp(i):
        a, b, c = (F.get("points", i + k) for k in (-1, 0, 1))
        u, v = (b.x - a.x, b.y - a.y), (c.x - b.x, c.y - b.y)
        return (u[0] * v[0] + u[1] * v[1]) / (F.sqrt(u[0] * u[0] + u[1] * u[1]) * F.sqrt(v[0] * v[0] + v[1] * v[1])) < -TOLERANCE["turn"]

    deep = F.col("depth_start").isNotNull() | F.col("depth_end").isNotNull()
    return _union([
        _bad(p.filter((F.size("points") < 2) | (F.col("_length") <= 1e-6)), "pipe without length", "id_key"),
        _bad(p.filter(~close(F.col("length"), F.col("_length"), TOLERANCE["length"])), "pipe length", "id_key", F.col("_length"), F.col("length")),
        _bad(p.filter(~close(F.col("cost"), F.col("_cost"), TOLERANCE["pipe_cost"])), "pipe cost", "id_key", F.col("_cost"), F.col("cost")),
        _bad(p.filter(~(P.capacity(F.col("diameter")) + FIT >= F.col("flow_tph")) | P.capacity(F.col("diameter")).isNull()), "undersized pipe", "id_key", P.capacity(F.col("diameter")), F.col("flow_tph")),
        _bad(p.filter(F.exists(step, sharp)), "turn exceeds 90 degrees", "id_key"),
        _bad(p.filter((F.abs(F.col("depth_start") - F.col("depth_end")) > 0.1 * F.col("_length") + 2e-5) | (F.least("depth_start", "depth_end") < 0.7 - 1e-6)), "depth profile", "id_key"),
        _bad(p.filter(deep & (F.least("depth_start", "depth_end") < 3 - 1e-6) & (F.greatest("depth_start", "depth_end") > 3 + 1e-6)), "missing cut at depth 3", "id_key"),
        _bad(p.filter(F.col("laying") != F.when(F.size("crossing_ids") > 0, "special").otherwise("base")), "laying method", "id_key"),
        _bad(p.filter(~close(F.col("depth_factor"), P.piece_depth_factor(F.col("depth_start"), F.col("depth_end")), 1e-7)), "depth coefficient", "id_key"),
    ])


def endpoints(export: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """References to nodes, and pipes' ends at them. Without a source, nodes that the export lacks are taken as the source's."""
    p = export.filter("object_type = 'heat_network'")
    first, last = F.get("points", F.lit(0)), F.element_at("points", -1)
    ends = p.select("plan", "id_key", F.explode(F.array(F.struct(F.col("start").alias("node"), first.alias("p")), F.struct(F.col("end").alias("node"), last.alias("p")))).alias("e")).select("plan", "id_key", "e.node", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"))
    own = export.filter(F.col("object_type").isin("heat_chamber", "technical_node")).select("plan", F.col("id_key").alias("node"), F.get("points", F.lit(0)).x.alias("nx"), F.get("points", F.lit(0)).y.alias("ny"))
    met = ends.join(own, ["plan", "node"], "left")
    out = [_bad(p.filter(F.col("start") == F.col("end")), "identical endpoints", "id_key")]
    if source is not None:
        given = source.filter(F.col("object_type").isin("oks_connection_point", "heat_chamber")).select(F.col("id_key").alias("node"), F.get(F.get("parts", F.lit(0)).points, F.lit(0)).alias("s"))
        met = met.join(given, "node", "left").withColumns({"nx": F.coalesce("nx", "s.x"), "ny": F.coalesce("ny", "s.y")})
        out.append(_bad(met.filter("nx is null"), "dangling endpoint", "id_key"))
        out.append(_bad(own.join(source.select(F.col("id_key").alias("node")), "node", "left_semi"), "output identifier shadows input", "node"))
    gap = distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    out.append(_bad(met.filter(gap >= TOUCH), "endpoint mismatch", "id_key", F.lit(0.0), gap))
    out.append(_bad(own.join(ends.select("plan", "node").distinct(), ["plan", "node"], "left_anti"), "isolated output node", "node"))
    return _union(out)


def topology(export: DataFrame, roots: DataFrame, terminals: DataFrame) -> DataFrame:
    """Forest, degrees, subtree flows and sizes. ``roots`` (plan, node), ``terminals`` (plan, node, flow)."""
    p = export.filter("object_type = 'heat_network'")
    edges = p.select("plan", F.col("start").alias("a"), F.col("end").alias("b"))
    tree = graph.orient(edges, roots)
    out = [graph.forest_violations(edges, roots, tree, terminals.select("plan", "node")).select(F.col("plan").cast("string").alias("plan"), "rule", F.lit(None).cast("string").alias("object"), F.lit(None).cast("double").alias("expected"), F.lit(None).cast("double").alias("actual"))]
    flow = graph.subtree_flow(tree, terminals).filter("parent is not null").select("plan", "node", "parent", "depth", F.col("flow").alias("_flow"), F.least("node", "parent").alias("_a"), F.greatest("node", "parent").alias("_b"))
    way = p.withColumns({"_a": F.least("start", "end"), "_b": F.greatest("start", "end")}).join(flow, ["plan", "_a", "_b"]).select("plan", "id_key", "flow_tph", "diameter", "length", "parent", "node", "depth", "_flow", F.col("points"))
    out.append(_bad(way.filter(~close(F.col("flow_tph"), F.col("_flow"), TOLERANCE["flow"])), "subtree flow", "id_key", F.col("_flow"), F.col("flow_tph")))
    # runs of one flow: chains between branching nodes, ties and consumers; their least size again, from below
    keep = roots.unionByName(terminals.select("plan", "node"))
    tree, way = cut(tree), cut(way)
    runs = graph.chains(tree, keep).select("plan", "top", "bottom", F.explode("nodes").alias("node"))
    each = runs.join(way.select("plan", "node", "diameter", "_flow", L.length(F.col("points")).alias("len")), ["plan", "node"]).filter(F.col("node") != F.col("top"))
    run = each.groupBy("plan", "top", "bottom").agg(F.sum("len").alias("length"), F.max("_flow").alias("flow"), F.min("diameter").alias("lo"), F.max("diameter").alias("hi"))
    run = run.join(tree.select("plan", F.col("node").alias("top"), "depth"), ["plan", "top"])
    out.append(_bad(run.filter("lo != hi"), "size changes at constant flow", "bottom", F.col("lo"), F.col("hi")))
    sized = graph.size_chains(run.withColumn("length", F.col("length") - CONTINUOUS_FIT_AUDIT / 4))  # the audit allows 2 mm for whole runs
    out.append(_bad(sized.filter(~F.coalesce(F.col("dn") == F.col("lo"), F.lit(False))), "not the least size", "bottom", F.col("dn"), F.col("lo")))
    return _union(out)


def totals(export: DataFrame, roots: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Sums of the summary against its rows: lengths, costs, penalties and the score."""
    rows = export.filter("object_type != 'variant_summary'")
    line = F.col("object_type") == "heat_network"
    sums = rows.groupBy("plan").agg(F.sum(F.when(line, F.col("cost"))).alias("_pipes"), F.sum(F.when(line, L.length(F.col("points")))).alias("_length"), F.coalesce(F.sum(F.when(F.col("object_type") == "heat_chamber", F.col("cost"))), F.lit(0.0)).alias("_chambers"))
    ends = export.filter(line).select("plan", F.explode(F.array("start", "end")).alias("node"))
    own = export.filter("object_type = 'heat_chamber'").select("plan", F.col("id_key").alias("node"))
    old = ends.join(roots.join(own, ["plan", "node"], "left_anti"), ["plan", "node"]).groupBy("plan").agg(F.count(F.lit(1)).alias("_ties"))
    s = export.filter("object_type = 'variant_summary'").join(sums, "plan", "left").join(old, "plan", "left").withColumn("_ties", F.coalesce("_ties", F.lit(0)))
    s = s.withColumns({"_pipes": F.coalesce("_pipes", F.lit(0.0)), "_length": F.coalesce("_length", F.lit(0.0)), "_chambers": F.coalesce("_chambers", F.lit(0.0))})
    built = F.col("_pipes") + F.col("_chambers") + F.col("_ties") * TIE_IN_COST
    checks = [
        ("chamber subtotal", F.col("_chambers"), F.col("chamber_construction_cost"), TOLERANCE["chamber_total"]),
        ("existing chamber tie count", F.col("_ties").cast("double"), F.col("tie_count").cast("double"), 0.0),
        ("tie subtotal", F.col("_ties") * float(TIE_IN_COST), F.col("existing_chamber_tie_in_cost"), 0.01),
        ("construction subtotal", built, F.col("construction_cost"), TOLERANCE["construction"]),
        ("total cost", built + F.col("unconnected_penalty"), F.col("calculated_cost"), TOLERANCE["total"]),
        ("total length", F.col("_length"), F.col("new_network_length"), TOLERANCE["total_length"]),
        ("score", P.score(F.col("calculated_cost"), F.col("new_network_length")), F.col("score"), TOLERANCE["score"]),
    ]
    out = [_bad(s.filter(~close(a, b, t)), rule, "id_key", a, b) for rule, a, b, t in checks]
    chambers = export.filter("object_type = 'heat_chamber'")
    out.append(_bad(chambers.filter(~close(F.col("cost"), P.chamber_price(F.col("diameter")).cast("double"), TOLERANCE["chamber_cost"])), "chamber cost", "id_key", P.chamber_price(F.col("diameter")), F.col("cost")))
    if source is not None:
        flows = source.filter("object_type = 'oks_connection_point'").select(F.col("id_key").alias("node"), F.col("flow_tph").alias("f"))
        gone = s.select("plan", "id_key", "unconnected_penalty", F.explode_outer(F.transform("missing", P.variant_id_key)).alias("node"))
        due = gone.join(flows, "node", "left").groupBy("plan", "id_key", "unconnected_penalty").agg(F.coalesce(F.sum(PENALTY_BASE + 500_000 * F.col("f")), F.lit(0.0)).alias("_due"))
        out.append(_bad(due.filter(~close(F.col("unconnected_penalty"), F.col("_due"), TOLERANCE["penalty"])), "penalty subtotal", "id_key", F.col("_due"), F.col("unconnected_penalty")))
        out.append(_bad(gone.filter("node is not null").join(flows, "node", "left_anti"), "unknown missing target", "node"))
    return _union(out)


def crossings_and_conflicts(export: DataFrame) -> DataFrame:
    """Pairs of a plan's pipes that touch other than at a shared node."""
    p = export.filter("object_type = 'heat_network'").filter(F.size("points") > 1)
    rows = p.select("plan", F.col("id_key").alias("line"), F.get("points", F.lit(0)).alias("f"), F.element_at("points", -1).alias("l"), F.explode(legs(F.col("points"))).alias("s"))
    rows = rows.select("plan", "line", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"), F.col("f.x").alias("first_x"), F.col("f.y").alias("first_y"), F.col("l.x").alias("last_x"), F.col("l.y").alias("last_y"))
    return _bad(spatial.conflicts(rows, 1e-7), "pipes cross or overlap", F.concat_ws(" ", "i", "j"))


def clearances(export: DataFrame, source: DataFrame) -> DataFrame:
    """Pipes within the envelope of an obstacle. A pipe that ends at a consumer may enter the consumer's own building, straight
    through the nearest facade, and must leave its envelope for good."""
    home = geojson.terminals(source).select(F.col("id").alias("node"), F.struct("x", "y").alias("home"))
    p = export.filter("object_type = 'heat_network'").select("plan", F.col("id_key").alias("line"), F.col("diameter").alias("dn"), "points", F.array("start", "end").alias("ends")).withColumn("route", F.xxhash64("plan", "line"))
    homes = p.select("route", F.explode("ends").alias("node")).join(home, "node").groupBy("route").agg(F.collect_set("home").alias("homes"))
    ways = p.join(homes, "route", "left")
    area = geojson.areas(source)
    bad = routes.entries(routes.too_close(ways, area, ENVELOPE_TOLERANCE_AUDIT), ways, area)
    return _bad_rows(bad.join(p.select("route", "plan", "line"), "route"), F.concat_ws(" ", "line", "object"))


def _bad_rows(df: DataFrame, obj: Column) -> DataFrame:
    """Rows that have their rule already."""
    none = F.lit(None).cast("double")
    return df.select(F.col("plan").cast("string").alias("plan"), "rule", obj.alias("object"), none.alias("expected"), none.alias("actual"))


def crossing_prices(export: DataFrame, source: DataFrame) -> DataFrame:
    """Pipes that cross an object at a price without naming it, and special coefficients that aren't the largest of the objects
    that the pipe names."""
    p = export.filter("object_type = 'heat_network'").select("plan", F.col("id_key").alias("line"), "points", "crossing_ids", "special_factor", "start", "end").withColumn("key", F.xxhash64("plan", "line"))
    objects = geojson.crossings(source)
    named = F.transform(F.coalesce("crossing_ids", F.array().cast("array<string>")), lambda v: F.concat(F.lit("s:"), v))
    raw = lambda c: F.regexp_replace(c, "^[sn]:", "")
    steps = p.select("key", F.posexplode(legs(F.col("points"))).alias("leg", "s")).select("key", F.lit(0.0).alias("station"), F.lit(1.0).alias("len"), F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    sides = geojson.legs(objects, "kind", "factor").select(F.col("id_key").alias("id"), "kind", "factor", "cx", "cy", "dx", "dy")
    hits = linear.line_hits(steps, sides.filter("kind != 'heat_network'"), "key").select("key", "id").distinct()
    silent = hits.join(p.select("key", "plan", "line", named.alias("named")), "key").filter(~F.exists("named", lambda v: raw(v) == raw(F.col("id"))))
    factors = objects.select(raw(F.col("id_key")).alias("id"), "factor")
    due = p.select("key", "plan", "line", "special_factor", F.explode_outer("crossing_ids").alias("id")).join(factors, "id", "left").groupBy("key", "plan", "line", "special_factor").agg(F.coalesce(F.max("factor"), F.lit(1.0)).alias("due"))
    return _bad(silent, "crossing without a price", F.concat_ws(" ", "line", "id")).unionByName(_bad(due.filter(~close(F.col("special_factor"), F.col("due"), 1e-9)), "special coefficient", "line", F.col("due"), F.col("special_factor")))


def audit(export: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """All violations of an export. With the source, roots are existing chambers and chambers on existing pipes, and consumers
    come from it; without, chambers with a null parent aren't known, so roots are the nodes that no pipe ends at."""
    export = cut(export)
    source = source if source is None else cut(source.drop("properties").withColumn("id_raw", F.col("id_key")))
    lines = export.filter("object_type = 'heat_network'")
    out = [files(export), pipes(export), endpoints(export, source), crossings_and_conflicts(export)]
    if source is None:
        roots = lines.select("plan", F.col("start").alias("node")).distinct().join(lines.select("plan", F.col("end").alias("node")).distinct(), ["plan", "node"], "left_anti")
        starts = lines.select("plan", F.col("start").alias("node")).distinct()
        terminals = lines.select("plan", F.col("end").alias("node"), F.col("flow_tph").alias("flow")).join(starts, ["plan", "node"], "left_anti")
    else:
        given = geojson.terminals(source).select(F.col("id").alias("node"), "flow")
        plans = export.select("plan").distinct()
        missing = export.filter("object_type = 'variant_summary'").select("plan", F.explode(F.transform("missing", P.variant_id_key)).alias("node"))
        terminals = plans.crossJoin(F.broadcast(given)).join(missing, ["plan", "node"], "left_anti").select("plan", "node", "flow")  # at most three plans a file
        old = source.filter("object_type = 'heat_chamber'").select(F.col("id_key").alias("node"))
        used = lines.select("plan", F.explode(F.array("start", "end")).alias("node")).distinct().join(old, "node", "left_semi")
        own = export.filter("object_type = 'heat_chamber'").select("plan", "id_key", F.get("points", F.lit(0)).x.alias("px"), F.get("points", F.lit(0)).y.alias("py")).withColumn("at", F.concat_ws("\u0001", "plan", "id_key"))
        on = spatial.incidence(own, geojson.existing_legs(source), "at", "line")
        roots = used.select("plan", "node").unionByName(own.join(on, "at").select("plan", F.col("id_key").alias("node")))
        out += [clearances(export, source), crossing_prices(export, source)]
    out += [topology(export, roots, terminals), totals(export, roots, source)]
    return _union([cut(part) for part in out])  # violations are few; one plan of all rules would take longer to plan than to run
