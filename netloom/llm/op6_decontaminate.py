"""Benchmark decontamination by template canonicalisation.

A text becomes a row of template tokens: numbers, names (title-case words; those that begin a sentence are read both as names
and as words) and units (fixed words after a number) turn into typed placeholders, other words into their lower case. Windows of ``window`` template
tokens of benchmark items and of documents are hash-joined; what stood in the placeholders are the slots. On each diagonal
(document position less item position) of a document and an item the longest run of windows counts in which a value of the
item meets one value of the document (two values may become one), and so do all windows with unchanged slots. A document is
contaminated by an item if these cover at least ``enough`` of its windows (or all, if it has fewer). So a question with other numbers or names is found.

Documents' windows pass a filter of fixed size made of the items' windows before the join, so that only likely matches are
shuffled. Items shorter than a window are matched as one window of their own length. Windows less than half literal, and items
of fewer than four tokens, would meet too much as templates: they are matched token by token, so that verbatim copies of any
item are found. In scripts without spaces each character is a token.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, MIX2, bit_filter, columns, filtered, in_filter, over_text, row_key, staged

WINDOW, ENOUGH, SHORTEST = 8, 6, 4
#: Words that count as units after a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent mph kmh w kw v a hz c f k".split())
_token = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:;\n]")
#: Scripts without spaces (Thai to Tibetan, Burmese, Khmer, kana, Han), of which each character is a token.
_SPACELESS = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_spaceless = re.compile(f"[{_SPACELESS}]")
_character = re.compile(rf"\d+(?:[.,]\d+)*|(?=[^\W\d_])[{_SPACELESS}]|[^\W\d_{_SPACELESS}]+|[.!?:;\n]")
LITERAL, NAME, NUMBER, STOP, UNIT = range(5)
_PLACE = {NAME: np.uint64(0x1111), NUMBER: np.uint64(0x2222), UNIT: np.uint64(0x3333)}
KNOWN_WORDS = 120_000


class Tokens(dict):
    """Token -> hash of its lower case, with the kind, as far as the token alone tells, in the low three bits."""

    def __missing__(self, w: str):
        if len(self) >= KNOWN_WORDS:
            self.clear()
        low = w.lower()
        if w.islower():
            kind = UNIT if low in UNITS else LITERAL
        else:
            kind = STOP if w in ".!?:;\n" else NUMBER if w[0].isdigit() else NAME if w[0].isupper() and w[1:] == low[1:] else UNIT if low in UNITS else LITERAL
        v = self[w] = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) & ~7 | kind
        return v


def tokens(text: str) -> list[str]:
    return (_token if text.isascii() or not _spaceless.search(text) else _character).findall(text)


def template(text: str, known: Tokens) -> tuple[list[str], np.ndarray, list[tuple], np.ndarray]:
    """Tokens of a text, and what ``read`` tells of them."""
    raw = tokens(text)
    return raw, *read(raw, known)


def read(raw: list[str], known: Tokens) -> tuple[np.ndarray, list[tuple], np.ndarray]:
    """Which of the tokens aren't stops; readings (template hashes, kinds, tokens that the first reading takes otherwise); hashes
    without placeholders. Tokens of several texts have a stop between two texts.
    Kinds are LITERAL, NAME, NUMBER or UNIT. A title-case word that begins a sentence may be a name or not: the first reading
    takes it as literal, a second one as a name."""
    if not raw:
        return np.zeros(0, np.int64), [(np.zeros(0, np.uint64), np.zeros(0, np.int8), None)], np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, raw), np.uint64, len(raw))
    kind = (h & np.uint64(7)).astype(np.int8)
    h ^= kind.astype(np.uint64)
    before = np.concatenate([[STOP], kind[:-1]])
    plain = h.copy()
    first = (kind == NAME) & (before == STOP)
    kind[first] = LITERAL
    kind[(kind == UNIT) & (before != NUMBER)] = LITERAL
    for k, v in _PLACE.items():
        h[kind == k] = v
    keep = np.flatnonzero(kind != STOP)
    h, kind, first = h[keep], kind[keep], first[keep]
    readings = [(h, kind, None)]
    if first.any():
        readings.append((np.where(first, _PLACE[NAME], h), np.where(first, np.int8(NAME), kind), first))
    return keep, readings, plain[keep]


def likely(kind: np.ndarray, size: int, among: np.ndarray | None = None) -> np.ndarray:
    """Which windows have at least half of their tokens literal, and, if it is given, a token of ``among``."""
    if len(kind) < size:
        return np.zeros(0, bool)
    literal = np.zeros(len(kind) + 1, np.int32)
    np.cumsum(kind == LITERAL, out=literal[1:])
    ok = 2 * (literal[size:] - literal[:-size]) >= size
    if among is not None:
        seen = np.zeros(len(kind) + 1, np.int32)
        np.cumsum(among, out=seen[1:])
        ok &= seen[size:] > seen[:-size]
    return ok


def windows(h: np.ndarray, kind: np.ndarray, size: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows of which at least half the tokens are literal; only those with a token of ``among``."""
    at = np.flatnonzero(likely(kind, size, among))
    return at, hashes(h, size)[at]


def hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows: polynomials of mixed token hashes, from those of windows of 1, 2, 4, … tokens."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    part, width, out, done = (h ^ (h >> np.uint64(31))) * MIX, 1, None, 0
    while True:
        power = np.uint64(pow(int(MIX2), width, 1 << 64))
        if size & width:
            out = part[:n] if out is None else out * power + part[done : done + n]
            done += width
        if done == size:
            break
        part = part[:-width] * power + part[width:]
        width *= 2
    out = out + np.uint64(size)
    out ^= out >> np.uint64(32)
    out *= MIX2
    out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _alone(raw: list[str], at: int) -> bool:
    """Whether the token makes a sentence of its own."""
    return all(x in ".!?:;\n" for x in (*raw[max(at - 1, 0) : at], *raw[at + 1 : at + 2]))


_FIELDS = ("own", "pos", "hash", "tokens", "exact", "told", "slots")


def _held(rows: dict, piece: pa.RecordBatch) -> dict:
    own = pa.array(rows.pop("own"), pa.int64())
    return {"key": piece.column("key").take(own), "row_key": piece.column("row_key").take(own), **rows}


def _slots(raw: list[str], place: np.ndarray, kind: np.ndarray, size: int, p: int) -> list[str]:
    return [raw[place[q]].lower() for q in range(p, p + size) if kind[q] != LITERAL]


def _of_items(window: int):
    """Windows of items. An item's windows that no reading takes, and items under ``SHORTEST`` tokens, are exact: of the tokens
    without placeholders."""

    def kernel(known, piece, texts):
        rows = {c: [] for c in _FIELDS}

        def add(i, n, at, v, exact, slot, told=()):
            for p, x in zip(at.tolist(), v.tolist(), strict=True):
                for c, y in zip(_FIELDS, (i, p, x, n, exact, not exact or p in told, slot(p)), strict=True):
                    rows[c].append(y)

        for i, t in enumerate(texts):
            raw, place, readings, plain = template(t, known)
            n = len(place)
            if not n:
                continue
            size, told = min(n, window), ()
            if n >= SHORTEST:
                if readings[0][1][0] == LITERAL and raw[place[0]].lower() in UNITS:  # what stands before it isn't known
                    (h, kind, _), begin = readings[0], np.arange(n) == 0
                    readings.append((np.where(begin, _PLACE[UNIT], h), np.where(begin, np.int8(UNIT), kind), begin))
                for h, kind, among in readings:
                    add(i, n, *windows(h, kind, size, among), False, lambda p, kind=kind, size=size: _slots(raw, place, kind, size, p))
            at = np.arange(n - size + 1)
            if n >= SHORTEST:
                told = windows(*readings[0][:2], size)[0]
                at = np.setdiff1d(at, told)
                if any(among is not None and among[0] and 0 not in windows(h, kind, size, among)[0] for h, kind, among in readings):
                    at = np.union1d([0], at)  # a copy within a sentence may read the first token so
            add(i, n, at, _exact(plain, size)[at], True, lambda p: [], told)
        return _held(rows, piece)

    return kernel


def _exact(plain: np.ndarray, size: int) -> np.ndarray:
    return hashes(plain ^ MIX if size > 1 else plain, size)


def _of_documents(wanted, bits):
    """Windows of documents that may meet the items', which are of the (size, exact) ``wanted`` and in the filter. All texts of a
    slice are read at once; no window reaches from one into the next."""

    def kernel(known, piece, texts):
        raw, ends = [], []
        for t in texts:
            raw += tokens(t)
            raw.append("\n")
            ends.append(len(raw))
        place, readings, plain = read(raw, known)
        of = np.searchsorted(ends, place, side="right")
        begin = np.searchsorted(place, [0, *ends])
        rows = {c: [] for c in _FIELDS}
        for size, exact in wanted:
            if len(place) < size:
                continue
            whole = of[size - 1 :] == of[: len(of) - size + 1]
            for h, kind, among in [(plain, None, None)] if exact else readings:
                v = _exact(h, size) if exact else hashes(h, size)
                at = np.flatnonzero(in_filter(bits.value, v))
                at = at[whole[at]] if exact else at[(whole & likely(kind, size, among))[at]] if len(at) else at
                for p in at.tolist():
                    if exact and size == 1 and not _alone(raw, place[p]):  # a lone word must be a sentence of its own
                        continue
                    i = int(of[p])
                    for c, y in zip(_FIELDS, (i, p - int(begin[i]), int(v[p]), int(begin[i + 1] - begin[i]), exact, not exact, [] if exact else _slots(raw, place, kind, size, p)), strict=True):
                        rows[c].append(y)
        return _held(rows, piece) if rows["own"] else None

    return kernel


def consistent(met: list[dict]) -> set[int]:
    """Positions of the windows of a diagonal that count: the longest run in which a value of the item meets one value of the
    document, and all windows whose slots are unchanged."""
    best: dict[int, list[tuple]] = {}
    for w in sorted(met, key=lambda w: -len(w["pairs"])):  # of several readings the one with the fewest slots
        best[w["at"]] = [(p["a"], p["b"]) for p in w["pairs"]]
    ats = sorted(best)
    found, lo, top = {at for at in ats if all(a == b for a, b in best[at])}, 0, range(0)
    values: dict[str, dict[str, int]] = {}
    for hi, at in enumerate(ats):
        for a, b in best[at]:
            of = values.setdefault(a, {})
            of[b] = of.get(b, 0) + 1
        while any(len(values[a]) > 1 for a, _ in best[at]):  # only the newest window's values can be in conflict
            for a, b in best[ats[lo]]:
                values[a][b] -= 1
                if not values[a][b]:
                    del values[a][b]
            lo += 1
        if hi + 1 - lo > len(top):
            top = range(lo, hi + 1)
    return found | {ats[i] for i in top}


def _consistent(batches):
    for batch in batches:
        own, ats, told = [], [], []
        for i, met in enumerate(batch.column("met").to_pylist()):
            at = sorted(consistent(met))
            own += [i] * len(at)
            ats += at
            by = {w["at"]: w["told"] for w in met}
            told += [by[p] for p in at]
        rows = pa.array(own, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("row_key", "item", "item_row")), pa.array(ats, pa.int32()), pa.array(told, pa.bool_())], names=["row_key", "item", "item_row", "at", "told"])


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, enough: int = ENOUGH) -> DataFrame:
    """(row_key, item, covered): a row for each distinct document row and benchmark item that contaminates it. ``covered``
    is the share of the item's windows that were found.

    Texts without a word or number match nothing. An item of one token matches where it makes a sentence of its own. Items with one text each match. Repeated document rows share their row_key.
    """
    schema = "key {}, row_key long, pos int, hash long, tokens int, exact boolean, told boolean, slots array<string>"
    named = columns(items, item, item_text).toDF("key", "text").filter("key is not null").dropDuplicates().withColumn("row_key", row_key("key", "text"))
    kind = items.schema[item].dataType.simpleString()
    bench = staged(over_text(named, "text", _of_items(window), schema.format(kind), make=Tokens), "template-windows")
    wanted = sorted((r.size, r.exact) for r in bench.select(F.least("tokens", F.lit(window)).alias("size"), "exact").distinct().collect())
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(bench, "hash"))
    rows = columns(docs, key, text).toDF("key", "text").withColumn("row_key", row_key("key", "text"))
    found = over_text(rows, "text", _of_documents(wanted, bits), schema.format(docs.schema[key].dataType.simpleString()), make=Tokens).select("row_key", "pos", "hash", F.col("slots").alias("mine")).distinct()
    asked = bench.select(F.col("key").alias("item"), F.col("row_key").alias("item_row"), F.col("pos").alias("at"), "told", "hash", F.col("slots").alias("theirs"))
    pairs = F.transform(F.arrays_zip("theirs", "mine"), lambda z: F.struct(z.theirs.alias("a"), z.mine.alias("b")))
    met = found.join(asked, "hash").select("row_key", "item", "item_row", (F.col("pos") - F.col("at")).alias("diagonal"), "at", "told", pairs.alias("pairs"))
    lines = met.groupBy("row_key", "item", "item_row", "diagonal").agg(F.collect_set(F.struct("at", "told", "pairs")).alias("met"))  # at most an item's windows
    held = lines.mapInArrow(_consistent, f"row_key long, item {kind}, item_row long, at int, told boolean").distinct().groupBy("row_key", "item", "item_row").agg(F.count(F.lit(1)).alias("n"), F.count_if("told").alias("n_told"))
    whole = bench.groupBy(F.col("row_key").alias("item_row")).agg(F.countDistinct("pos").alias("of"), F.countDistinct(F.when(F.col("told"), F.col("pos"))).alias("of_told"))
    found = (F.col("n") >= F.least("of", F.lit(enough))) | (F.col("of_told") > 0) & (F.col("n_told") >= F.least("of_told", F.lit(enough)))
    return held.join(whole, "item_row").filter(found).groupBy("row_key", "item").agg(F.max(F.col("n") / F.col("of")).alias("covered"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, contaminated, item_ids, covered) of every row; ``item_ids`` ascending, empty if clean. A document's items are
    gathered in one array: at most the items whose windows it holds."""
    hits = matches(docs, items, key, text, **options).groupBy("row_key").agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max("covered").alias("covered"))
    rows = columns(docs, key, text).select(F.col(f"`{key}`"), row_key(key, text).alias("row_key"))
    return rows.join(hits, "row_key", "left").select(key, F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast(hits.schema["item_ids"].dataType)).alias("item_ids"), F.coalesce("covered", F.lit(0.0)).alias("covered"))


def cleaned(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay."""
    hits = staged(matches(docs, items, key, text, **options).select("row_key", F.lit(0).alias("stays")).distinct(), "template-hits")
    return filtered(docs, key, text, hits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontaminate(docs, items)
