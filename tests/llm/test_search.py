"""Hard negatives, license scans and lexical search against brute force, and their defined results on odd input."""

import math
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import op11_hard_negatives as op11
from netloom.llm import op12_licenses as op12
from netloom.llm import op13_lexical as op13
from netloom.llm import queries

DATA = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string"


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_license_scan", "op13_lexical_search"])
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, str(DATA))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert want


# ---------------------------------------------------------------- 11


def mined(rows, anchor, positives=5, negatives=10):
    """Brute force over whole vectors, of (key, label, whole components)."""
    rows = sorted({k: min((x[1], x[2]) for x in rows if x[0] == k) for k in {r[0] for r in rows}}.items())
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))  # noqa: E731  shorter ones end in zeros
    out = []
    for a, (label, q) in rows:
        if not anchor(a):
            continue
        scored = sorted((-dot(q, v), k, own == label) for k, (own, v) in rows if k != a)
        for minus, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [(k, -s) for s, k, same in scored if not same and 30 * -minus <= 100 * -s <= 90 * -minus][:negatives]
            out += [(a, p, i + 1, k, -minus, s) for i, (k, s) in enumerate(fits)]
    return sorted(out)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op11, "PIECE_ROWS", 40)
    monkeypatch.setattr(op11, "BLOCK_ROWS", 8)
    monkeypatch.setattr(op11.centroids, "__defaults__", (200, 30, 1024, 4))
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(4, 6))
    rows = [(i, (middle[i % 4] * (i % 9 != 0) + 0.4 * rng.normal(size=6)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(600)]
    rows += [(600 + i, rows[5][1], i % 2) for i in range(150)]  # a hot list, of ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"key": F.lit("x"), "list": F.lit(1), "q": F.lit(None).cast("string")})
    got = op11.mine(df, F.pmod("vec_id", F.lit(20)) == 0)
    want = mined([(k, label, [math.floor(256 * x) for x in v]) for k, v, label in rows], lambda k: k % 20 == 0)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 500


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (1, [2.0], 1), (2, [0.5, 0.25, 9.0], 2), (3, [], 2), (4, None, 2), (5, [1.0, 1.0], None), (6, [nan, 1.0], 2), (7, [inf, 1.0], 2), (8, [None, 1.0], 2), (None, [1.0, 1.0], 2), (9, [1e30, 1.0], 2), (-100, [-1.0, 0.0], 2), (10, [0.5, 0.75], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    taken = [(k, label, [math.floor(256 * x) for x in v]) for k, v, label in rows if k is not None and k < 4 or k in (100, 10) if v is not None]
    got = op11.mine(df, F.pmod("vec_id", F.lit(100)) == 0)
    assert sorted(map(tuple, got.collect())) == mined(taken, lambda k: k % 100 == 0)
    assert op11.mine(df.limit(0), F.pmod("vec_id", F.lit(100)) == 0).count() == 0
    assert op11.mine(df.filter("vec_id = 4"), F.lit(True)).count() == 0


def test_hard_negatives_skip_lists(spark):
    """Far lists aren't visited: their bounds lie below the k-th score."""
    c = np.array([[1000.0, 0.0], [-1000.0, 0.0], [0.0, 1000.0]])
    rows = spark.createDataFrame([(i, i % 2, [[1000, -1000, 0][i % 3] + i % 5, [0, 0, 1000][i % 3]]) for i in range(90)], "key long, label long, q array<int>")
    dealt = op11.lists(rows, c)
    assert {(r.key % 3, r.list) for r in dealt.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert max(r.d for r in dealt.collect()) <= 4


# ---------------------------------------------------------------- 12


def licensed(text, templates=op12.TEMPLATES, threshold=op12.THRESHOLD):
    """Labels by templates, from every window of the text."""
    words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out, best = set(), 0.0
    for label, t in templates:
        stride = next((s for s in op12.STRIDES if len(t.split()) <= s), op12.STRIDES[-1])
        tokens = set(t.split())
        for at in range(0, len(words), stride):
            common = len(tokens & set(words[at : at + 2 * stride]))
            if tokens and common >= op12.least_common(len(tokens), threshold):
                out.add(label)
                best = max(best, common / len(tokens))
    return words, out, best


def test_license_scan_against_every_window(spark):
    rng = random.Random(12)
    some = "the of river stone software and license any under mit free 2 4 gnu cc notice".split()
    texts = []
    for _ in range(200):
        words = rng.choices(some, k=rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(op12.TEMPLATES)[1].split()
            if rng.random() < 0.6:
                t.pop(rng.randrange(len(t)))
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() if rng.random() < 0.2 else w for w in t]
        texts.append(rng.choice([" ", "\n", ", ", "  -"]).join(words))
    odd = [None, "", "MIT License", "MIT--LICENSE mit license", "mit license", "mit licenſe mit LİCENSE mit licenKe", "Apache License GNU General Public License", "Kelvin mit", "license " * 5000 + "mit license"]
    rows = list(enumerate(odd + texts)) + [(6, odd[6]), (None, "Released under the MIT License")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit("x"), "words": F.lit(1), "row_hash": F.lit(2), "n": F.lit(0), "label": F.lit("y")})
    got = op12.scan(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[6]) == 2
    for i, text in rows:
        words, more, best = licensed(text)
        r = by[i][0]
        base = [(at, label) for phrase, label in op12.PHRASES for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        assert r.n_words == len(words)
        assert (r.n_base, r.first_word, r.last_word) == (len(base), min(base)[0] if base else None, max(base)[0] if base else None)
        assert r.base_labels == ",".join(sorted({b for _, b in base}))
        assert r.labels == ",".join(sorted({b for _, b in base} | more))
        assert r.score == pytest.approx(1.0 if base else best)
    assert sum(bool(r.labels) and not r.base_labels for r in got) > 20
    assert op12.scan(df.limit(0)).count() == 0


def test_license_blocks_of_given_templates(spark):
    df = spark.createDataFrame([(1, "w " * 70 + "alpha beta gamma delta"), (1, "w " * 70 + "alpha beta gamma delta"), (2, "alpha w beta"), (3, None)], DOCS)
    got = op12.matches(df, templates=(("x", "alpha beta gamma delta"), ("y", "alpha beta"), ("none", "")), threshold=0.75).collect()
    assert {(r.doc_id, r.label, r.start) for r in got} == {(1, "x", 48), (1, "y", 48), (2, "y", 0), *((1, x, 64) for x in "xy" if 64 + 16 < 74)}
    assert op12.matches(df, templates=()).count() == 0


# ---------------------------------------------------------------- 13


def tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def ranked(docs, items, k=10):
    found = [(i, tokens(t)) for i, t in docs if tokens(t)]
    n_docs, n_words = len(found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item in {i for i, _ in items}:
        asked = {w for i, t in items if i == item for w in tokens(t)}
        scores = []
        for doc, t in found:
            m = 10 + 90 * len(t) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * t.count(w) // (1000 * t.count(w) + 8 * m)) for w in asked if w in t)
            if s:
                scores.append((-s, math.inf if doc is None else doc, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2])[:k])]
    return sorted(out, key=repr)


def test_lexical_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op13, "BLOCK_DOCS", 17)
    monkeypatch.setattr(op13, "BLOCK_POSTINGS", 120)
    rng = random.Random(13)
    words = [f"w{i}" for i in range(40)] + ["Élan", "élan", "İx", "东京", "a_b", "NaÏve"]
    say = lambda n: " ".join(rng.choices(words, weights=[60 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, say(rng.randint(1, 60))) for i in range(300)] + [(300 + i, docs_copy) for i, docs_copy in enumerate([say(20)] * 40)]
    docs += [(None, say(10)), (None, say(30)), (7, say(9)), (901, None), (902, ""), (903, " --- !"), (904, "w3 " * 9000), (905, "x퟿W1")]
    items = [(i, say(rng.randint(1, 25))) for i in range(30)] + [(3, "w1 w2 W39"), (None, "w5 élan"), (50, None), (51, ""), (52, "unheard words"), (53, docs[310][1])]
    a = spark.createDataFrame(docs, DOCS).withColumns({"key": F.lit("x"), "q": F.lit(1), "score": F.lit(2.0)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({"batch": F.lit(9), "texts": F.lit("t")})
    want = ranked(docs, items)
    assert sorted(map(tuple, op13.search(a, b).collect()), key=repr) == want
    assert sorted(map(tuple, op13.search(a, b, batch_bytes=300).collect()), key=repr) == want  # in batches
    assert op13.search(a.limit(0), b).count() == op13.search(a, b.limit(0)).count() == 0


def test_impacts_fit_a_byte():
    tf, m = np.array([1, 5, 10**6]), np.array([10, 10, 10])
    byte = -(-op13._impact(tf, m) // op13.UNIT)
    assert byte.max() <= 255
    assert (op13._impact(tf, m) > (byte - 1) * op13.UNIT).all()
    assert (op13._impact(tf, m) <= byte * op13.UNIT).all()
