"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

The patterns give the base spans. Beside them every run of identifier characters is looked at, and of a run that base spans
cover in part, what they leave. The log-likelihood ratios of its characters' transitions under the two models are summed: a
piece of ``LEAST_RUN`` characters or more is a span of kind ``markov`` if the sum exceeds ``EVIDENCE`` and the mean
``MEAN``. Digits aren't asked for, nor any length beyond that: what is short must be odd enough to reach the sum.

Learned from labelled samples. Random: seeded random strings, and what the patterns matched in a bounded sample of
``per_sample`` texts by a hash of the text. Ordinary: the other runs of these texts, and seeded identifiers in the usual styles.
What reaches the driver is a table of transition counts of fixed size.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, over_text

#: The base patterns and the lengths under which a match is dropped.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is maximal, so the length can be asked for at once
MIN_ASSIGN, MIN_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "markov")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
LEAST_RUN = 8
LONG_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_RUN)
PER_SAMPLE, EVIDENCE, MEAN, BACKOFF = 4000, 30.0, 1.5, 10.0
#: Runs whose verdict a task remembers.
KNOWN_RUNS = 120_000
#: Words of ordinary identifiers.
ORDINARY = """get set user name session max min connection per host server push enabled class factory request response http https
utf general local lib python application form encoded base encode decode sum hash key value file path index count list array
string number type code test data table column row query select insert update delete create drop config option default error
warning info debug log level time date year month day hour id uuid version build release main master branch commit merge pull
event handler listener click button input output stream buffer cache memory thread process queue task job worker node edge
graph tree root parent child left right top bottom width height size length offset page url link image html css script json
xml yaml sql api client service account email address phone country city street order item price total tax invoice payment
customer product stock report summary internal external public private static const function return module""".split()


@dataclass
class Model:
    ratio: np.ndarray  # 128 x 128 log-likelihood ratios of transitions
    evidence: float = EVIDENCE
    mean: float = MEAN

    def score(self, run: str) -> tuple[float, float]:
        """Sum and mean of the ratios."""
        c = np.frombuffer(run.encode("ascii"), dtype=np.uint8)
        x = self.ratio[c[:-1], c[1:]]
        return float(x.sum()), float(x.mean())

    def random(self, run: str) -> bool:
        total, mean = self.score(run)
        return total > self.evidence and mean > self.mean


class Verdicts(dict):
    """run -> whether it is random, for the last ``KNOWN_RUNS`` runs."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, run: str) -> bool:
        if len(self) >= KNOWN_RUNS:
            self.clear()
        v = self[run] = self.model.random(run)
        return v


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns' matches, leftmost and non-overlapping for each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def left_over(text: str, base: list[tuple[int, int, int]], runs: re.Pattern = LONG_RUN):
    """(start, end) of the runs' pieces outside the base spans, in one pass over both."""
    taken, i = sorted((s, e) for s, _, e in base), 0
    for m in runs.finditer(text):
        at, end = m.span()
        while i < len(taken) and taken[i][1] <= at:
            i += 1
        j = i
        while j < len(taken) and taken[j][0] < end:
            if taken[j][0] > at:
                yield at, taken[j][0]
            at = max(at, taken[j][1])
            j += 1
        if at < end:
            yield at, end


def all_spans(text: str, verdicts: Verdicts) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + [(s, 3, e) for s, e in left_over(text, base) if e - s >= LEAST_RUN and verdicts[text[s:e]]])


def _counts(runs: list[str]) -> np.ndarray:
    out = np.zeros((128, 128), dtype=np.int64)
    if runs:
        c = np.frombuffer("\0".join(runs).encode("ascii"), dtype=np.uint8)
        np.add.at(out, (c[:-1], c[1:]), 1)
        out[0], out[:, 0] = 0, 0
    return out


def random_strings(n: int = 3000, seed: int = 9) -> list[str]:
    """Labelled random samples: keys and tokens over the usual alphabets."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = ("0123456789abcdef", lower + digits, upper + digits, lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "-_")
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 48))) for _ in range(n)]


def ordinary_identifiers(n: int = 20_000, seed: int = 10) -> list[str]:
    """Labelled ordinary samples: identifiers, paths, versions and dates."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = rng.choices(ORDINARY, k=rng.randint(1, 5))
        if rng.random() < 0.3:
            w.insert(rng.randint(1, len(w)), str(rng.choice([rng.randrange(10), rng.randrange(100), rng.randrange(1000), rng.randint(1970, 2030)])))
        day = f"{rng.randint(1970, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
        out.append(rng.choice(["_".join(w), "-".join(w), w[0] + "".join(x.capitalize() for x in w[1:]), "".join(x.capitalize() for x in w), "_".join(w).upper(), "/" + "/".join(w), day, f"{day}T{rng.randrange(24):02d}", f"{day}-{w[0]}"]))
    return out


def train(docs: DataFrame, text: str = "text", per_sample: int = PER_SAMPLE) -> Model:
    """Two smoothed first-order models. Without any text only the seeded strings count."""
    rows = columns(docs, text).toDF("text").filter("text is not null")
    n = rows.count()
    sample = rows.filter(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1_000_000)) < 1_000_000 * per_sample / max(1, n))

    def kernel(_, piece, texts):
        found: tuple[list, list] = ([], [])
        for t in texts:
            base = base_spans(t)
            found[0].extend(re.split(r"[\"'\x20:=]+", t[s:e])[-1] for s, k, e in base if t[s:e].isascii())
            found[1].extend(t[s:e] for s, e in left_over(t, base, RUN))
        tables = [_counts(f) for f in found]
        kind, a, b = np.nonzero(np.stack(tables))
        return {"kind": kind.astype(np.int32), "a": a.astype(np.int32), "b": b.astype(np.int32), "n": np.stack(tables)[kind, a, b]}

    table = np.zeros((2, 128, 128))
    table[0] += _counts(random_strings())
    table[1] += _counts(ordinary_identifiers())
    for r in over_text(sample, "text", kernel, "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        table[r.kind, r.a, r.b] += r.n
    single = table.sum(1, keepdims=True) + 0.5  # how often a character comes at all, for transitions that were hardly seen
    single /= single.sum(2, keepdims=True)
    logs = np.log((table + BACKOFF * single) / (table.sum(2, keepdims=True) + BACKOFF))
    return Model(logs[0] - logs[1])


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array of (kind, start, end)) of every row, by start, then kind; code points, end exclusive. Null and
    empty texts have none. Repeated rows are scanned each."""
    rows = columns(docs, key, text).toDF("key", "text")

    def kernel(verdicts, piece, texts):
        spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t, verdicts)] for t in texts]
        return {"key": piece.column("key"), "spans": spans}

    kind = docs.schema[key].dataType.simpleString()
    return over_text(rows, "text", kernel, f"key {kind}, spans array<struct<kind:string,start:long,end:long>>", make=lambda: Verdicts(model)).withColumnRenamed("key", key)


def redacted(docs: DataFrame, model: Model, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by ``mark``; other columns as they were."""
    names = docs.columns

    def kernel(verdicts, piece, texts):
        out = []
        for t, raw in zip(texts, piece.column(text), strict=True):
            parts, at = [], 0
            for s, _, e in all_spans(t, verdicts):
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append("".join([*parts, t[at:]]) if raw.is_valid else None)
        return {c: pa.array(out, pa.string()) if c == text else piece.column(c) for c in names}

    return over_text(docs, text, kernel, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), make=lambda: Verdicts(model))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter("spans", lambda s: s.kind != "markov")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
