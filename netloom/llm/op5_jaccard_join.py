"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

A text is the set of its shingles of ``n`` words (five). Texts with one set are a class of copies; only classes are joined.

1. A class has a path of ``MAX_DEPTH`` digits in each of ``trees`` prefix tries: a digit is 16 bits of a MinHash value, but
   the first one is the whole hash of the shingle of least value, so that paths rarely match by chance at any number of rows.
   The paths of a trie are sorted, by ranges of (tree, path, class), so that a hot path is shared between tasks; equal
   prefixes are then neighbours, and the longer prefix that a path shares with its neighbours is its longest match.
2. A class begins with whole paths and shortens them, a digit at a time in all tries, until its recall is enough
   (``stops``). A partner at the threshold shares d digits of a path with probability threshold**d, and a path's longest
   match is no shorter than what it shares with that partner. So the sum of a class's longest matches tells how far to go:
   the smaller it is, the less likely it hides a partner that longer prefixes miss. A class that nothing resembles keeps
   whole paths and meets nobody; one among near copies shortens to the depth that the target recall asks of all paths.
3. A class asks at its depth; those with its prefix in a trie are its candidates. Groups of one depth with the same members
   in several tries are verified once. A group is cut into blocks of bounded size and the pairs of blocks are units of work,
   so a very large group is shared between tasks and no list of pairs is made.
4. A unit gets its members' whole sets and verifies the pairs of which the one that shortens more asks at this depth and for
   which its trie is the first with a common prefix, so that a pair is counted once. It returns a row per linked member: its
   links, and a tree of links that joins it to others.
5. Classes that links join, directly or by others, get one class id: the least key of all their rows.

Sets are made again from the texts for candidates only, found by a Bloom filter of fixed size and then an exact join.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, MIX2, batches_of, bit_filter, columns, components, dropped, filtered, in_filter, mixed, over_text, row_key, schema_of, staged

WORDS, THRESHOLD, TREES, RECALL, MAX_DEPTH = 5, 0.8, 24, 0.99999, 8
#: Members and shingles of a block, at most (a longer single set makes a block of its own).
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1_000_000
#: Distinct words whose hashes a task remembers.
KNOWN_WORDS = 120_000

_word = re.compile(r"\w+")


class WordHashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str, n: int = WORDS, known: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct hashes of runs of ``n`` lower-case words. Fewer words make one shingle; a text without words is its
    own shingle, so equal ones match; null counts as empty."""
    known = WordHashes() if known is None else known
    words = _word.findall(text.lower())
    if not words:
        return np.array([xxhash.xxh3_64_intdigest(b"\0" + text.encode("utf-8", "surrogatepass"))], dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = h[: len(h) - n + 1] * MIX
    for i in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * MIX2 + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(out))


def least_depth(threshold: float, trees: int, recall: float, deepest: int = MAX_DEPTH) -> int:
    """The longest prefix with which all tries together match a pair at the threshold with the wanted recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def tree_paths(x: np.ndarray, trees: int, depth: int = MAX_DEPTH) -> np.ndarray:
    """For each tree the path of the set, as records of ``_digits``; high bytes first so that bytes sort as digits do."""
    a, b, back = _permutations(trees * depth)
    h = (x >> np.uint64(32)).astype(np.uint32)  # ascending as x is
    low = np.full(trees * depth, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), 512):
        part = h[i : i + 512, None] * a
        part += b
        np.minimum(low, part.min(0), out=low)
    low = low.reshape(depth, trees)
    out = np.zeros(trees, dtype=_digits(depth))
    out["first"] = x[np.searchsorted(h, (low[0] - b[:trees]) * back[:trees])]
    out["more"] = (low[1:] & np.uint32(0xFFFF)).T
    return out


def _digits(depth: int) -> np.dtype:
    return np.dtype([("first", ">u8"), ("more", ">u2", (depth - 1,))])


def _bytes(depth: int) -> int:
    """Length of a prefix."""
    return 6 + 2 * depth


@lru_cache(8)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h -> a * h + b modulo 2**32 with odd factors, and the factors that undo them."""
    rng = np.random.default_rng(20)
    a, b = (rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) for _ in range(2))
    a |= np.uint32(1)
    return a, b, np.array([pow(int(v), -1, 1 << 32) for v in a], dtype=np.uint32)


def _neighbours(depth: int):
    """Task over sorted paths: each path's longest match, the digits that it shares with one of its neighbours. The edge rows
    of a task, whose other neighbour is elsewhere, count as matched whole. Paths that share no digit are left out."""
    schema = schema_of("node binary, tree int, path binary, m int")

    def matched(tree, path, above, below):
        """above, below: matches of the first row with the one before it and of the last one with the one after it"""
        digits = np.frombuffer(b"".join(path.to_pylist()), dtype=_digits(depth))
        first, more = digits["first"], digits["more"]
        same = np.column_stack([(first[1:] == first[:-1]) & (tree[1:] == tree[:-1]), more[1:] == more[:-1]])
        lcp = np.concatenate([[above], np.logical_and.accumulate(same, axis=1).sum(1), [below]])
        return np.maximum(lcp[:-1], lcp[1:]).astype(np.int32)

    def run(batches):
        held, above = None, depth  # a batch waits for the first row of the next one

        def result(batch, last):
            tree = np.asarray(batch.column("tree"))
            m = matched(tree, batch.column("path"), above, last)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "tree", "path")), pa.array(m)], schema=schema)
            return out.filter(pa.array(m > 0))

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                p, q = held.column("path")[-1].as_py(), batch.column("path")[0].as_py()
                shared = next((i for i in range(len(p)) if p[i] != q[i]), len(p)) if held.column("tree")[-1] == batch.column("tree")[0] else 0
                link = max(0, (shared - 6) // 2)
                yield result(held, link)
                above = link
            held = batch
        if held is not None:
            yield result(held, depth)

    return run


def stops(threshold: float, trees: int, recall: float, deepest: int = MAX_DEPTH) -> dict[int, int]:
    """For each depth, deepest first, the greatest sum of longest matches with which a class may stop there.

    The shortest depth misses a partner at the threshold with probability q = (1 - threshold**depth)**trees. What is left of
    the misses that the recall allows is shared by the longer ones: at each, the probability that all shared prefixes of a
    partner are shorter than the depth and their sum is within the bound. A closer partner is missed less.
    """
    least = least_depth(threshold, trees, recall, deepest)
    share = max(0.0, 1 - recall - (1 - threshold**least) ** trees) / max(1, deepest - least)
    out = {}
    for depth in range(deepest, least, -1):
        one = (1 - threshold) * threshold ** np.arange(depth)
        sums = np.ones(1)
        for _ in range(trees):
            sums = np.convolve(sums, one)
        out[depth] = int(np.searchsorted(np.cumsum(sums), share, side="right")) - 1
    return out | {least: trees * deepest}


def depth_of(matches: DataFrame, bounds: dict[int, int]) -> DataFrame:
    """(node, depth) of nodes with matches (node, m): the longest prefix with which the node's recall is enough."""
    depth = F.lit(None)
    for d, most in reversed(bounds.items()):
        depth = F.when(F.col("total") <= most, F.lit(d)).otherwise(depth)
    return matches.groupBy("node").agg(F.sum("m").alias("total")).select("node", depth.cast("int").alias("depth"))


def _node(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def signatures(docs: DataFrame, key: str, text: str, n: int, trees: int, deepest: int = MAX_DEPTH) -> DataFrame:
    """(key, row_key, node, size, paths) of every row. ``node`` identifies the set of shingles, ``row_key`` equal rows."""
    rows = columns(docs, key, text).toDF("key", "text").withColumn("row_key", row_key("key", "text"))

    def kernel(known, piece, texts):
        sets = [shingles(t, n, known) for t in texts]
        return {"key": piece.column("key"), "row_key": piece.column("row_key"), "node": [_node(x) for x in sets], "size": [len(x) for x in sets], "paths": [tree_paths(x, trees, deepest).tobytes() for x in sets]}

    return over_text(rows, "text", kernel, f"key {docs.schema[key].dataType.simpleString()}, row_key long, node binary, size int, paths binary", make=WordHashes)


def _sets(docs: DataFrame, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted nodes, one row each. The filter of fixed size spares the others the shuffle."""
    head = F.conv(F.substring(F.hex("node"), 1, 15), 16, 10).cast("long").alias("head")
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(head), "head"))

    def kernel(state, piece, texts):
        known, done = state
        out, sets = [], [shingles(t, n, known) for t in texts]
        nodes = [_node(x) for x in sets]
        hits = in_filter(sent.value, np.array([int(v.hex()[:15], 16) for v in nodes], dtype=np.int64))
        for i in np.flatnonzero(hits):
            if nodes[i] not in done:
                if len(done) < KNOWN_WORDS:  # copies in one task; the others go at the aggregation that follows
                    done.add(nodes[i])
                out.append((nodes[i], sets[i].tobytes()))
        return {"node": [a for a, _ in out], "set": [b for _, b in out]} if out else None

    return over_text(columns(docs, text).toDF("text"), "text", kernel, "node binary, set binary", make=lambda: (WordHashes(), set())).groupBy("node").agg(F.first("set").alias("set"))


def _intersections(a: list[np.ndarray], b: list[np.ndarray], want: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of wanted pairs: pair by pair if there are few, else by products of 0-1 matrices over
    slices of the shingles that several sets hold."""
    out = np.zeros(want.shape)
    i, j = np.nonzero(want)
    if len(i) * 4000 < len(a) * len(b) * 100 or len(i) < 64:
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            x, y = (a[p], b[q]) if len(a[p]) <= len(b[q]) else (b[q], a[p])
            at = np.searchsorted(y, x)
            out[p, q] = np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)
        return out
    names = [np.unique(np.concatenate(s)) for s in (a, b)]
    both = np.intersect1d(*names, assume_unique=True)

    def located(sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        x = np.concatenate(sets)
        at = np.searchsorted(both, x)
        ok = both[np.minimum(at, len(both) - 1)] == x if len(both) else np.zeros(len(x), bool)
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    (ra, ca), (rb, cb) = located(a), located(b)
    width = 2048
    for lo in range(0, len(both), width):
        part = []
        for r, c, k in ((ra, ca, len(a)), (rb, cb, len(b))):
            s, e = np.searchsorted(c, [lo, lo + width])
            m = np.zeros((k, width), dtype=np.float32)
            m[r[s:e], c[s:e] - lo] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def _prefixes(paths: list[bytes], trees: int, depth: int) -> np.ndarray:
    """A number for each member's prefix of ``depth`` digits in each of the first ``trees`` tries."""
    digits = np.stack([np.frombuffer(p, dtype=_digits(MAX_DEPTH), count=trees) for p in paths])
    out = mixed(digits["first"].astype(np.uint64))
    for d in range(depth - 1):
        out = mixed(out * MIX + digits["more"][:, :, d].astype(np.uint64) + np.uint64(1))
    return out


def _verified(tree: int, depth: int, same: bool, blocks: tuple, threshold: float) -> list[tuple]:
    """Rows (node, links, linked copies, root) of the members that have a link in this unit."""
    (na, ka, da, sa, ca), (nb, kb, db, sb, cb) = blocks
    la, lb = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
    p, q = Fraction(threshold).limit_denominator(10**9).as_integer_ratio()  # whole numbers, so that pairs at the threshold are links
    want = (q * np.minimum(la[:, None], lb[None]) >= p * np.maximum(la[:, None], lb[None])) & (ka[:, tree][:, None] == kb[:, tree][None])
    want &= np.minimum(da[:, None], db[None]) == depth
    if same:
        want &= np.triu(np.ones(want.shape, bool), 1)
    for t in range(tree):
        want &= ka[:, t][:, None] != kb[:, t][None]
    if not want.any():
        return []
    inter = _intersections(sa, sb, want).astype(np.int64)
    link = want & (inter * (p + q) >= p * (la[:, None] + lb[None]))
    i, j = np.nonzero(link)
    if not len(i):
        return []
    j = j if same else j + len(na)
    names, copies = (na, ca) if same else (na + nb, np.concatenate([ca, cb]))
    count = np.bincount(i, minlength=len(names)) + np.bincount(j, minlength=len(names))
    linked = np.bincount(i, weights=copies[j], minlength=len(names)) + np.bincount(j, weights=copies[i], minlength=len(names))
    root = np.arange(len(names))
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    return [(names[x], int(count[x]), int(linked[x]), names[root[x]]) for x in np.flatnonzero(count)]


def _verifier(threshold: float):
    schema = schema_of("node binary, links long, linked long, root binary")

    def run(batches):
        at, rows = None, []

        def close():
            tree, depth, bi, bj = at[0], at[1], at[3], at[4]
            sides = []
            for b in (bi, bj):
                own = [r for r in rows if r[1] == b]
                if not own:  # few members can leave a block empty
                    return []
                sides.append(([r[0] for r in own], _prefixes([r[2] for r in own], tree + 1, depth), np.array([r[3] for r in own]), [np.frombuffer(r[5], dtype=np.uint64) for r in own], np.array([r[4] for r in own], dtype=np.int64)))
            return _verified(tree, depth, bi == bj, tuple(sides), threshold)

        out = []
        for batch in batches:
            units = list(zip(*(batch.column(c).to_pylist() for c in ("tree", "d", "key", "bi", "bj")), strict=True))
            cells = [batch.column(c) for c in ("node", "block", "paths", "depth", "copies", "set")]
            for i, u in enumerate(units):
                if u != at:
                    if len(rows) > 1:
                        out += close()
                    at, rows = u, []
                rows.append(tuple(c[i].as_py() for c in cells))
            if len(out) >= 5000:
                yield _rows(out, schema)
                out = []
        if len(rows) > 1:
            out += close()
        if out:
            yield _rows(out, schema)

    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """A row for every row of ``docs``: key, row_key, class_id, n_links, n_text_links, keeper.

    ``class_id`` is the least key among all rows that links join (null only if all their keys are null). ``n_links``
    counts other rows with a Jaccard similarity of at least ``threshold``, copies included; ``n_text_links`` counts other
    sets of shingles. ``keeper`` is the row_key of the one row of the class to keep (least key, nulls last). Repeated rows
    count as copies and each has its row. Null and empty texts are copies of one another. An empty table gives an empty one.
    """
    return _joined(docs, key, text, n, threshold, trees, recall, block_rows, block_shingles)[0]


def _joined(docs: DataFrame, key: str, text: str, n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, list[DataFrame]]:
    """The join and the staged tables that it reads."""
    spark = docs.sparkSession
    sig = staged(signatures(docs, key, text, n, trees), "forest-signatures")
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("row_key"))
    nodes = staged(sig.groupBy("node").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("paths").alias("paths")), "forest-classes")
    least = least_depth(threshold, trees, recall)
    entries = nodes.select("node", "paths", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("node", "tree", F.expr(f"substring(paths, tree * {_bytes(MAX_DEPTH)} + 1, {_bytes(MAX_DEPTH)})").alias("path"))
    with batches_of(spark, 10_000):  # narrow rows
        tries = entries.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path").mapInArrow(_neighbours(MAX_DEPTH), "node binary, tree int, path binary, m int")
        matched = staged(tries, "forest-tries")
    depths = depth_of(matched, stops(threshold, trees, recall))
    asked = matched.filter(F.col("m") >= least).join(depths, "node").join(nodes.select("node", "size"), "node")
    paths = asked.select("node", "size", "depth", "tree", F.explode(F.sequence(F.lit(least), F.col("m"))).alias("d"), "path").withColumn("path", F.expr("xxhash64(tree, d, substring(path, 1, 6 + 2 * d))"))
    paths = staged(paths, "forest-prefixes")
    groups = paths.groupBy("tree", "d", "path").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("shingles"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("also"), F.max(F.col("depth") == F.col("d")).alias("asks")).filter("rows > 1 and asks")
    once = groups.groupBy("d", "rows", "members", "also").agg(F.min(F.struct("tree", "path", "shingles")).alias("g")).select("g.tree", "d", "g.path", F.greatest(F.ceil(F.col("rows") / block_rows), F.ceil(F.col("g.shingles") / block_shingles)).cast("int").alias("blocks"))
    member = paths.join(once, ["tree", "d", "path"]).select("node", "depth", "tree", "d", "path", "blocks", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int").alias("block"))
    member = staged(member, "forest-members")
    units = member.select("node", "depth", "tree", "d", F.col("path").alias("key"), "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).select("node", "depth", "tree", "d", "key", "block", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"))
    wanted = member.select("node").distinct()
    whole = nodes.join(wanted, "node", "left_semi").select("node", "paths", "copies").join(_sets(docs, text, n, wanted), "node")
    unit = ("tree", "d", "key", "bi", "bj")
    work = units.join(whole, "node").repartition(*unit).sortWithinPartitions(*unit)
    links = staged(work.select(*unit, "node", "block", "paths", "depth", "copies", "set").mapInArrow(_verifier(threshold), "node binary, links long, linked long, root binary"), "forest-links")
    for done in (matched, paths, member):
        dropped(spark, done)
    sums = links.groupBy("node").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    temporary = [sig, nodes, links, roots]
    known = nodes.join(sums, "node", "left").join(roots, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked", F.lit(0)).alias("linked"))
    linked = known.filter("links > 0")
    first = linked.groupBy("root").agg(F.min("least").alias("top"))
    linked = linked.join(first, "root").select("node", "top", "copies", "links", "linked")
    alone = known.filter("links = 0").select("node", F.col("least").alias("top"), "copies", "links", "linked")
    out = sig.select("key", "row_key", "node").join(linked.unionByName(alone), "node")
    out = out.select(F.col("key").alias(key), "row_key", F.col("top.key").alias("class_id"), (F.col("copies") - 1 + F.col("linked")).alias("n_links"), F.col("links").alias("n_text_links"), F.col("top.row_key").alias("keeper"))
    return out, temporary


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: the one of least key. All columns stay.

    Rows that go, and kept rows that occur more than once, are found by their row keys. A row meets the exact join only if
    its class has several rows; the others pass by a filter of fixed size.
    """
    found, temporary = _joined(docs, key, text, **options)
    found = staged(found, "forest-join")
    for done in temporary:
        dropped(docs.sparkSession, done)
    return filtered(docs, key, text, found.filter("n_links > 0").groupBy("row_key").agg(F.max((F.col("row_key") == F.col("keeper")).cast("int")).alias("stays")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_text_links")
