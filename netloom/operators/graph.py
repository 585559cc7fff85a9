"""Forests as edge tables, for many plans at once.

What goes along paths goes by pointer doubling: a table of jumps, of 1, 2, 4, … steps towards the root, is joined with itself, so
depths, ancestors and subtree sums take as many rounds as the depth has binary digits, and no row grows with the depth.
``orient`` takes the first levels by frontier joins, which touch only the frontier; what lies deeper is oriented by a tour around
the trees, whose arcs are ranked by doubling. Shortest paths are in ``paths``, spanning and Steiner trees in ``trees``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing
from ..functions.constants import CONTINUOUS_FIT, FIT, MAX_DEGREE, SIZES
from .base import cut

#: Levels that are taken by frontier joins; arcs of a node that one task puts in a ring, about.
LEVELS, RING = 16, 1_000_000
#: Nodes in a row, a power of two: a node and its next ancestors.
CHAIN = 32


def symmetric(edges: DataFrame, *more: str) -> DataFrame:
    """Both directions of edges (plan, a, b, …)."""
    cols = ["plan", *more]
    return edges.select("a", "b", *cols).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *cols))


# ---------------------------------------------------------------- pointer doubling


def ends(links: DataFrame) -> DataFrame:
    """(plan, node, last, hops): where the links (plan, node, next) lead in the end, a node without a link, and in how many
    steps. As many rounds as the longest way has binary digits; a ring of links is an error."""
    now = cut(links.select("plan", "node", F.col("next").alias("last"), F.lit(1).cast("long").alias("hops")))
    most = now.count()
    while True:
        on = now.select("plan", F.col("node").alias("last"), F.col("last").alias("_last"), F.col("hops").alias("_hops"))
        after = now.join(on, ["plan", "last"], "left").select("plan", "node", F.coalesce("_last", "last").alias("last"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"), F.col("_last").isNotNull().alias("moved"))
        now = cut(after, now)
        if now.filter("moved").isEmpty():
            return now.drop("moved")
        if not now.filter(F.col("hops") > most).isEmpty():
            raise ValueError("the links go round in a ring")


def _deepest(oriented: DataFrame) -> int:
    return oriented.agg(F.max("depth")).first()[0] or 0


def _steps(oriented: DataFrame) -> DataFrame:
    """(plan, node, up, depth): jumps of one level."""
    return oriented.filter("parent is not null").select("plan", "node", F.col("parent").alias("up"), "depth")


def _jumps(now: DataFrame, deepest: int, step: int = 1):
    """Tables (plan, node, up, depth) of jumps of 1, 2, 4, … times ``step`` levels, of the nodes that lie that deep, from those of
    ``step``. Nodes that jump to a root have no longer jump, so they don't meet in the root's row."""
    while step <= deepest:
        yield step, now
        on = now.select("plan", F.col("node").alias("up"), F.col("up").alias("_up"))
        now = now.filter(F.col("depth") >= 2 * step).join(on, ["plan", "up"]).select("plan", "node", F.col("_up").alias("up"), "depth")
        step *= 2
        if step <= deepest // 2:  # it is joined again
            now = cut(now)


def ancestors(oriented: DataFrame, starts: DataFrame, *keep: str, values: tuple[str, ...] = ()) -> DataFrame:
    """(plan, start, keep, node, hops, values): each start (plan, node, keep) and all its ancestors, up to the root, with these
    columns of ``oriented``.

    Nodes gather chains of themselves and up to ``CHAIN`` - 1 ancestors; a start finds the nodes at which its chains begin, and what is
    joined and shuffled is a row a chain. They open into ancestors at the end.
    """
    deepest, step = _deepest(oriented), 1
    chain = oriented.select("plan", "node", "depth", F.col("parent").alias("up"), F.array(F.struct("node", *values)).alias("chain"))
    while step < CHAIN and step <= deepest:
        on = chain.select("plan", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("chain").alias("_chain"))
        after = chain.filter("up is not null").join(on, ["plan", "up"]).select("plan", "node", "depth", F.col("_up").alias("up"), F.concat("chain", "_chain").alias("chain"))
        chain = cut(chain.filter("up is null").select(*after.columns).unionByName(after), *([chain] if step > 1 else []))
        step *= 2
    out = starts.select("plan", F.col("node").alias("start"), *keep, "node", F.lit(0).cast("long").alias("hops"))
    for jump, jumps in _jumps(chain.filter("up is not null").select("plan", "node", "up", "depth"), deepest, step):
        if jump > step:
            out = cut(out)
        out = out.unionByName(out.join(jumps.select("plan", "node", "up"), ["plan", "node"]).select("plan", "start", *keep, F.col("up").alias("node"), (F.col("hops") + jump).alias("hops")))
    out = out.join(chain.select("plan", "node", "chain"), ["plan", "node"], "left").select("plan", "start", *keep, "node", "hops", F.posexplode_outer("chain").alias("_at", "_c"))
    return out.select("plan", "start", *keep, F.coalesce("_c.node", "node").alias("node"), (F.col("hops") + F.coalesce("_at", F.lit(0))).alias("hops"), *(F.col(f"_c.{v}") for v in values))


def descendants(oriented: DataFrame, starts: DataFrame) -> DataFrame:
    """(plan, start, node): each start (plan, node) and all nodes below it."""
    out = starts.select("plan", F.col("node").alias("start"), "node")
    for step, jump in _jumps(_steps(oriented), _deepest(oriented)):
        if step > 1:
            out = cut(out)
        out = out.unionByName(out.withColumnRenamed("node", "up").join(jump.select("plan", "node", "up"), ["plan", "up"]).select("plan", "start", "node"))
    return out


def subtree_sums(oriented: DataFrame, values: DataFrame, *cols: str) -> DataFrame:
    """``oriented`` with the sums of the values (plan, node, cols) in each node's subtree; without any, 0.

    After the round of jumps of 2^k levels a node has the sum of what lies less than 2^(k+1) levels below it.
    """
    own = values.groupBy("plan", "node").agg(*(F.sum(c).alias(c) for c in cols))
    out = oriented.join(own, ["plan", "node"], "left").select(*oriented.columns, *(F.coalesce(c, F.lit(0)).alias(c) for c in cols))
    for _, jump in _jumps(_steps(oriented), _deepest(oriented)):
        out = cut(out)
        up = out.select("plan", "node", *cols).join(jump.select("plan", "node", "up"), ["plan", "node"]).groupBy("plan", F.col("up").alias("node")).agg(*(F.sum(c).alias(f"_{c}") for c in cols))
        out = out.join(up, ["plan", "node"], "left").select(*oriented.columns, *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in cols))
    return out


# ---------------------------------------------------------------- orientation


def orient(edges: DataFrame, roots: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(plan, node, parent, depth) from edges (plan, a, b) and roots (plan, node).

    Nodes that no root reaches are absent. ``forest_violations`` reports what isn't a forest; of nodes that several ways reach
    within the first ``levels`` the least parent counts, and deeper, parts of what isn't a forest may be absent.
    """
    both = cut(symmetric(edges).distinct().select("plan", "a", "b"))
    kind = both.schema["a"].dataType
    front = seen = cut(roots.select("plan", "node").distinct().select("plan", "node", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth")))
    parts = [seen]
    for depth in range(1, levels + 1):
        step = front.select("plan", F.col("node").alias("a")).join(both, ["plan", "a"]).groupBy("plan", F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        # in a forest only the parent's parent could come up again; in anything else, any node seen so far
        step = cut(step.join(seen.select("plan", "node"), ["plan", "node"], "left_anti").select("plan", "node", "parent", F.lit(depth).alias("depth")))
        if step.isEmpty():
            return seen
        parts.append(step)
        seen, front = seen.unionByName(step), step
    rest = both.join(seen.select("plan", F.col("node").alias("a")), ["plan", "a"], "left_anti").join(seen.exceptAll(front).select("plan", F.col("node").alias("b")), ["plan", "b"], "left_anti")
    rest = cut(rest.select("plan", "a", "b"))
    if rest.isEmpty():
        return seen
    down = rest.unionByName(rest.join(front.select("plan", F.col("node").alias("b")), ["plan", "b"]).select("plan", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    parents = toured(down, front.select("plan", "node"))
    deeper = ends(parents.select("plan", "node", F.col("parent").alias("next"))).join(front.select("plan", F.col("node").alias("last")), ["plan", "last"])
    found = deeper.join(parents, ["plan", "node"]).select("plan", "node", "parent", (F.col("hops") + levels).cast("int").alias("depth"))
    return seen.unionByName(cut(found))


def toured(arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """(plan, node, parent) of the trees of arcs (plan, a, b), both directions of each edge, that hold a root (plan, node).

    A tour takes, after the arc a → b, the arc from b to the neighbour that follows a in the ring of b's neighbours; it goes
    round a whole tree. Cut at the root it is a list, in which doubling tells each arc how many follow; of an edge's two arcs the
    first one goes down. Arcs of no root's tree stay in rings and are left out.
    """
    n = arcs.count()
    rings = max(1, n // RING)
    dealt = arcs.withColumn("ring", F.pmod(F.xxhash64("b"), F.lit(rings)).cast("int"))
    within = Window.partitionBy("plan", "a", "ring").orderBy("b")
    between = Window.partitionBy("plan", "a").orderBy("ring")  # at most a row a ring
    starts = dealt.groupBy("plan", "a", "ring").agg(F.min("b").alias("least"))
    starts = starts.select("plan", "a", "ring", F.lead("least").over(between).alias("then"), F.first("least").over(between).alias("first"))
    after = dealt.withColumn("inner", F.lead("b").over(within))
    inner = after.filter("inner is not null").select("plan", F.col("b").alias("x"), F.col("a").alias("y"), F.col("a").alias("nx"), F.col("inner").alias("ny"))
    last = after.filter("inner is null").join(starts, ["plan", "a", "ring"]).join(roots.select("plan", F.col("node").alias("a"), F.lit(True).alias("root")), ["plan", "a"], "left")
    over = F.col("then").isNull() & F.col("root").isNotNull()
    last = last.select("plan", F.col("b").alias("x"), F.col("a").alias("y"), F.when(~over, F.col("a")).alias("nx"), F.when(~over, F.coalesce("then", "first")).alias("ny"))
    now = cut(inner.unionByName(last).withColumn("left", F.when(F.col("nx").isNull(), 0).otherwise(1).cast("long")))
    for _ in range(n.bit_length()):
        on = now.select("plan", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("nx").alias("_x"), F.col("ny").alias("_y"), F.col("left").alias("_left"))
        going = now.filter("nx is not null").join(on, ["plan", "nx", "ny"]).select("plan", "x", "y", F.col("_x").alias("nx"), F.col("_y").alias("ny"), (F.col("left") + F.col("_left")).alias("left"))
        now = cut(now.filter("nx is null").unionByName(going), now)
    ranked = now.filter("nx is null").select("plan", "x", "y", "left")
    back = ranked.select("plan", F.col("y").alias("x"), F.col("x").alias("y"), F.col("left").alias("_left"))
    return cut(ranked.join(back, ["plan", "x", "y"]).filter(F.col("left") > F.col("_left")).select("plan", F.col("y").alias("node"), F.col("x").alias("parent")), now)


def subtree_flow(oriented: DataFrame, demand: DataFrame) -> DataFrame:
    """(plan, node, parent, depth, flow): demand (plan, node, flow) summed up from each node's subtree."""
    return subtree_sums(oriented, demand.withColumn("flow", F.col("flow").cast("double")), "flow")


def subtree_members(oriented: DataFrame, members: DataFrame) -> DataFrame:
    """(plan, node, members): sorted ids (plan, node, id) in each node's subtree."""
    below = ancestors(oriented, members.join(oriented.select("plan", "node"), ["plan", "node"]), "id")
    return below.groupBy("plan", "node").agg(F.array_sort(F.collect_set("id")).alias("members"))


def forest_violations(edges: DataFrame, roots: DataFrame, oriented: DataFrame, consumers: DataFrame) -> DataFrame:
    """(plan, rule): what keeps a plan from being a forest with at most four pipes a node and consumers as its leaves."""
    degree = symmetric(edges).groupBy("plan", F.col("a").alias("node")).agg(F.count_distinct("b").alias("degree"))
    n_edges = edges.select("plan", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().groupBy("plan").agg(F.count(F.lit(1)).alias("edges"))
    n_nodes = oriented.groupBy("plan").agg(F.count_if(F.col("depth") > 0).alias("reached"))
    rules = [
        degree.filter(F.col("degree") > MAX_DEGREE).select("plan", F.lit("a chamber has more than four pipes").alias("rule")),
        consumers.join(degree, ["plan", "node"], "left").filter(F.coalesce("degree", F.lit(0)) != 1).select("plan", F.lit("a consumer isn't a leaf").alias("rule")),
        consumers.join(oriented, ["plan", "node"], "left_anti").select("plan", F.lit("a consumer has no path to a tie-in").alias("rule")),
        n_edges.join(n_nodes, "plan", "full").filter(F.coalesce("edges", F.lit(0)) != F.coalesce("reached", F.lit(0))).select("plan", F.lit("not an acyclic forest with one tie-in each").alias("rule")),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.distinct()


def chains(oriented: DataFrame, keep: DataFrame) -> DataFrame:
    """(plan, top, bottom, hops, nodes): runs of nodes with one child that aren't in ``keep`` (plan, node), as one edge each.

    The bottom of a chain is a kept, branching or leaf node; its top is the nearest such ancestor or root. Nodes inside point to
    their only child, and doubling leads them to their bottom.
    """
    kids = oriented.filter("parent is not null").groupBy("plan", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"), F.min("node").alias("kid"))
    marked = keep.select("plan", "node").distinct().withColumn("kept", F.lit(True))
    nodes = cut(oriented.join(kids, ["plan", "node"], "left").join(marked, ["plan", "node"], "left").withColumn("end", F.coalesce("kept", F.lit(False)) | (F.coalesce("kids", F.lit(0)) != 1) | F.col("parent").isNull()))
    inside = nodes.filter("not end")
    led = ends(inside.select("plan", "node", F.col("kid").alias("next"))).select("plan", "node", F.col("last").alias("bottom"), "hops")
    low = nodes.filter("end and parent is not null").select("plan", "node", F.col("node").alias("bottom"), F.lit(0).cast("long").alias("hops"))
    run = led.unionByName(low).join(nodes.select("plan", "node", "parent"), ["plan", "node"])
    run = run.groupBy("plan", "bottom").agg(F.max_by("parent", "hops").alias("top"), (F.max("hops") + 1).cast("int").alias("hops"), F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("at"), "node"))).alias("members"))
    return run.select("plan", "top", "bottom", "hops", F.concat(F.array("top"), F.transform("members", lambda m: m.node)).alias("nodes"))


def size_chains(segments: DataFrame, depth: str = "depth") -> DataFrame:
    """Sizes for segments (plan, top, bottom, depth of top, flow, length): adds dn and run.

    Downstream segments first: the least size that isn't under the children's, carries the flow, and whose uninterrupted run
    (its own length and the longest run of children of the same size) is allowed. One round a level, for all plans at once;
    null where no size fits.
    """
    segments = cut(segments)
    levels = sorted((r[0] for r in segments.select(depth).distinct().collect()), reverse=True)
    done = None
    options = pricing.size_table(segments.sparkSession).select(F.col("dn").alias("s"), "cap", "max_len")
    for level in levels:
        now = segments.filter(F.col(depth) == level)
        if done is None:
            kids = now.select("plan", "bottom").withColumn("kids", F.array().cast("array<struct<dn:int,run:double>>"))
        else:
            under = done.groupBy("plan", F.col("top").alias("bottom")).agg(F.collect_list(F.struct("dn", "run")).alias("kids"))  # at most four pipes a node
            kids = now.select("plan", "bottom").join(under, ["plan", "bottom"], "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<struct<dn:int,run:double>>")))
        least = F.coalesce(F.array_max(F.transform("kids", lambda k: k.dn)), F.lit(SIZES[0][0]))
        tried = now.join(kids, ["plan", "bottom"]).crossJoin(F.broadcast(options))  # 18 sizes a segment
        run = F.col("length") + F.coalesce(F.array_max(F.transform(F.filter("kids", lambda k: k.dn == F.col("s")), lambda k: k.run)), F.lit(0.0))
        fits = tried.withColumn("run", run).filter((F.col("s") >= least) & (F.col("cap") + FIT >= F.col("flow")) & (F.col("run") <= F.col("max_len") + CONTINUOUS_FIT))
        best = fits.groupBy("plan", "bottom").agg(F.min(F.struct(F.col("s").alias("dn"), "run")).alias("b"))
        sized = now.join(best, ["plan", "bottom"], "left").select(*now.columns, F.col("b.dn").alias("dn"), F.col("b.run").alias("run"))
        done = cut(sized) if done is None else done.unionByName(cut(sized))
    return done


def families(oriented: DataFrame, terminals: DataFrame) -> DataFrame:
    """(plan, family): a plan's structure, as the sorted sets of terminals below its nodes."""
    sets = subtree_members(oriented, terminals).filter(F.size("members") > 1).select("plan", F.array_join("members", ",").alias("m")).distinct()
    return sets.groupBy("plan").agg(F.array_join(F.array_sort(F.collect_list("m")), ";").alias("family"))


def signatures(edges: DataFrame) -> DataFrame:
    """(plan, signature): a hash of the sorted set of undirected edges; equal plans have equal ones."""
    pair = F.concat_ws("-", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"))
    return edges.groupBy("plan").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(pair)), ";"), 256).alias("signature"))


def prune_leaves(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges (plan, a, b) without branches that end at a node outside ``keep``: leaves go until none is left to go."""
    now = edges
    while True:
        degree = symmetric(now).groupBy("plan", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        gone = cut(degree.filter("n = 1").join(keep, ["plan", "node"], "left_anti").select("plan", "node"))
        if gone.limit(1).count() == 0:
            return now
        now = now.join(gone.withColumnRenamed("node", "a"), ["plan", "a"], "left_anti").join(gone.withColumnRenamed("node", "b"), ["plan", "b"], "left_anti").select(*edges.columns)
        now = cut(now)
