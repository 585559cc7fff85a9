"""From the features of an input to the graph that searches run on: nodes and edges of every territory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import pricing as P
from ..functions.constants import SIZES
from ..operators import grid, planning, routes, spatial
from ..operators.base import cut
from . import geojson

#: Metres beyond the widest envelope at which nodes stand around corners.
BEYOND = 0.05


def graph(features: DataFrame, radius: float, per_sector: int, dn: int = SIZES[0][0]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as ``planning.designs`` takes them.

    Nodes are consumers, ties, the ports of consumers in buildings, places on free stretches of rays from the other consumers, places on
    both sides of what may be crossed, and the corners of obstacles moved out of their envelopes; of
    each node's neighbours the nearest in each of 16 sectors that it sees count, and a consumer in a building sees its ports.
    Ids are numbers, unique among all territories; ``name`` is a consumer's or tie's identifier.
    """
    areas = geojson.areas(features)
    homes = geojson.terminals(features).select("territory", F.col("id").alias("name"), "x", "y", "flow")
    ties = geojson.tie_candidates(features).select("territory", F.col("tie").alias("name"), "x", "y", "is_chamber", "existing_dn", "existing_degree")
    keyed = areas.withColumn("key", F.concat_ws("\u0001", "territory", "obstacle"))
    walls = keyed.select(F.col("key").alias("obstacle"), "kind", "area")
    ports = cut(grid.ports(homes.select(F.concat_ws("\u0001", "territory", "name").alias("point"), "x", "y"), walls, dn))
    part = lambda c, i: F.split(c, "\u0001")[i]
    outer = ports.select(part("point", 0).alias("territory"), F.concat(F.lit("port "), part("point", 1), F.lit(" "), F.row_number().over(_by("point"))).alias("name"), "x", "y", "obstacle", part("point", 1).alias("of"))
    sides = routes.obstacle_sides(walls.withColumn("gap", P.clearance(F.col("kind"), F.lit(dn)) + BEYOND), "gap").withColumnsRenamed({"obstacle": "block"})
    corners = planning.corner_nodes(sides.withColumn("side", F.monotonically_increasing_id()).select("block", "side", "cx", "cy", "dx", "dy"), 1.0)
    # a node at one metre tells the direction; its distance is the envelope's
    out = sides.select("block", F.col("dx").alias("mx"), F.col("dy").alias("my"), "gap").distinct()
    corners = corners.join(out, "block").filter(G.distance(F.col("x"), F.col("y"), F.col("mx"), F.col("my")) < 1.5)
    bends = corners.select(part("block", 0).alias("territory"), F.concat(F.lit("corner "), F.col("block"), F.lit(" "), F.col("side").cast("string"), F.lit(" "), F.round("x", 3).cast("string")).alias("name"), (F.col("mx") + (F.col("x") - F.col("mx")) * F.col("gap")).alias("x"), (F.col("my") + (F.col("y") - F.col("my")) * F.col("gap")).alias("y"))
    rays, beside = outside(homes, walls, geojson.crossings(features), dn)
    none = {"flow": "double", "is_chamber": "boolean", "existing_dn": "int", "existing_degree": "int", "obstacle": "string", "of": "string"}
    every = [df.select("territory", "name", "x", "y", *(F.col(c).cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in none.items()), F.lit(kind).alias("role")) for kind, df in (("home", homes), ("tie", ties), ("port", outer), ("corner", bends.dropDuplicates(["territory", "name"])), ("ray", rays), ("crossing", beside))]
    nodes = reduce(DataFrame.unionByName, every)
    nodes = cut(nodes.withColumn("id", F.xxhash64("territory", "name")))
    seen = spatial.sector_neighbours(nodes.select("id", "x", "y"), radius, per_sector)
    a = nodes.select(F.col("id").alias("a"), "territory", F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("id").alias("b"), F.col("territory").alias("t2"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pairs = seen.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct().join(a, "a").join(b, "b").filter("territory = t2").withColumn("edge", F.xxhash64("a", "b"))
    owners = nodes.filter("obstacle is not null").select(F.col("id").alias("node"), "obstacle")
    free = routes.clear_pairs(pairs.select("edge", "territory", "a", "b", "ax", "ay", "bx", "by"), walls, owners, F.lit(dn)).select("territory", "a", "b", G.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("w"))
    home_ids = nodes.filter("role = 'home'").select("territory", F.col("name").alias("of"), F.col("id").alias("h"), F.col("x").alias("hx"), F.col("y").alias("hy"))
    leads = nodes.filter("role = 'port'").join(home_ids, ["territory", "of"]).select("territory", F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b"), G.distance(F.col("x"), F.col("y"), F.col("hx"), F.col("hy")).alias("w"))
    edges = free.unionByName(leads).dropDuplicates(["territory", "a", "b"])
    return nodes.select("territory", "id", "name", "x", "y", "flow", (F.col("role") == "tie").alias("is_tie"), F.coalesce("is_chamber", F.lit(False)).alias("is_chamber"), F.coalesce("existing_dn", F.lit(500)).alias("existing_dn"), F.coalesce("existing_degree", F.lit(2)).alias("existing_degree")), cut(edges)


def outside(homes: DataFrame, walls: DataFrame, crossings: DataFrame, dn: int) -> tuple[DataFrame, DataFrame]:
    """(territory, name, x, y) of places on rays from consumers outside of buildings, and beside objects that may be crossed."""
    keyed = homes.select(F.concat_ws("\u0001", "territory", "name").alias("point"), "x", "y")
    housed = routes.owned(keyed, walls).select("point")
    at = grid.ray_ports(keyed.join(housed, "point", "left_anti"), walls, P.clearance(F.col("kind"), F.lit(dn)) + BEYOND)
    place = lambda kind, *of: F.concat_ws(" ", F.lit(kind), *of, F.round("x", 3).cast("string"), F.round("y", 3).cast("string")).alias("name")
    rays = at.select(F.split("point", "\u0001")[0].alias("territory"), place("ray", F.split("point", "\u0001")[1]), "x", "y")
    lines = geojson.legs(crossings, "kind", "width").join(F.broadcast(P.crossing_table(homes.sparkSession).select("kind", F.col("h_gap").alias("gap"))), "kind")
    beside = grid.crossing_ports(lines.withColumn("id", F.concat_ws("\u0001", "territory", "id_key")), F.lit(dn))
    beside = beside.select(F.split("id", "\u0001")[0].alias("territory"), place("beside", F.split("id", "\u0001")[1]), "x", "y")
    return rays.dropDuplicates(["territory", "name"]), beside.dropDuplicates(["territory", "name"])


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy("x", "y")
