"""Queries over rankings, near duplicates and audits. Orders stand for plans: a customer's orders compete."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank as R
from ..operators.audit import close
from ..operators.base import table


def _plans(spark, d):
    o = table(spark, d, "orders")
    missing = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("plan"), missing.alias("missing"), F.col("o_totalprice").alias("score"), (F.col("o_orderkey") % 7).cast("int").alias("bends"), (F.col("o_totalprice") * 2).alias("cost"), F.col("o_orderstatus").alias("family"))


def rank_variants(spark, d):
    return R.ranked(_plans(spark, d), R.search_key(), within=["cust"]).select("cust", "plan", "rank")


def diverse_topk(spark, d):
    return R.diverse_top(_plans(spark, d), ["cust"], "family", R.search_key(), 3).select("cust", "plan", "family", "pick")


def best_per_family(spark, d):
    return R.best_of(_plans(spark, d), ["cust", "family"], R.search_key()).select("cust", "family", "plan", "missing", "score")


def top_plans(spark, d):
    return R.top(_plans(spark, d), R.price_key(), 24).select("plan", "score")


def anytime_best(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return R.anytime(e, ["user_id"], ["event_id"], "value")


def near_dedup(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 97).cast("double").alias("x"), "value", (F.col("event_type") == "purchase").alias("always"))
    return R.near_distinct(e, "x", "value", ["event_id"], 2.0, F.col("always")).select("event_id", "x", "value")


def audit_refs(spark, d):
    """References without a target: twice the keys of lines as orders, three times the keys of orders as customers, and customers
    of no nation."""
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    rule = lambda df, key, text: df.select(F.lit(text).alias("rule"), F.col(key).cast("long").alias("object"))
    out = rule(li.select((F.col("l_orderkey") * 2).alias("k")).distinct().join(o, F.col("k") == o.o_orderkey, "left_anti"), "k", "line without order")
    out = out.unionByName(rule(o.select((F.col("o_custkey") * 3).alias("k")).distinct().join(c, F.col("k") == c.c_custkey, "left_anti"), "k", "order without customer"))
    return out.unionByName(rule(c.join(n, c.c_nationkey == n.n_nationkey, "left_anti"), "c_custkey", "customer without nation"))


def audit_rank(spark, d):
    """Customers whose orders, ranked by key, have falling prices."""
    r = _plans(spark, d).select("cust", F.col("plan").alias("rank"), "score")
    return R.rank_violations(r, ["cust"]).groupBy("cust", "rule").agg(F.count(F.lit(1)).alias("n"))


def audit_close(spark, d):
    """Recomputed figures against recorded ones, rounded to three decimals: a relative 1e-9 or an absolute 0.0004."""
    li = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 3).alias("computed"))
    return li.groupBy(close(F.round("computed", 3), F.col("computed"), 0.0004).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


def rejection_reasons(spark, d):
    e = table(spark, d, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 5).cast("string")).alias("reason"))
    return R.rejections(e)


def coverage(spark, d):
    """Reachable share: sums over all, and a penalty bound."""
    o = table(spark, d, "orders")
    ok = F.col("o_orderstatus") != "P"
    return o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("connected"), F.round(F.count_if(ok) / F.count(F.lit(1)), 6).alias("share"))


_P = "p AS (SELECT o_custkey AS cust, o_orderkey AS plan, substr(o_orderpriority, 1, 1)::INTEGER AS missing, o_totalprice AS score, (o_orderkey % 7)::INTEGER AS bends, o_totalprice * 2 AS cost, o_orderstatus AS family FROM orders)"
_K = "missing, score, bends, cost, plan"

QUERIES = {
    "rank_variants": (rank_variants, f"WITH {_P} SELECT cust, plan, row_number() OVER (PARTITION BY cust ORDER BY {_K})::INTEGER AS rank FROM p"),
    "diverse_topk": (diverse_topk, f"WITH {_P}, f AS (SELECT *, row_number() OVER (PARTITION BY cust, family ORDER BY {_K}) > 1 AS later FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY later, {_K})::INTEGER AS pick FROM f) SELECT cust, plan, family, pick FROM r WHERE pick <= 3"),
    "best_per_family": (best_per_family, f"WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY cust, family ORDER BY {_K}) AS rn FROM p) SELECT cust, family, plan, missing, score FROM r WHERE rn = 1"),
    "top_plans": (top_plans, f"WITH {_P} SELECT plan, score FROM p ORDER BY score, bends, cost, plan LIMIT 24"),
    "anytime_best": (anytime_best, "WITH e AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) SELECT user_id, event_id, value FROM e WHERE b IS NULL OR value < b"),
    "near_dedup": (near_dedup, "WITH e AS (SELECT event_id, (event_id % 97)::DOUBLE AS x, value, event_type = 'purchase' AS always, row_number() OVER (PARTITION BY round_even((event_id % 97) / 2.0::DOUBLE, 0), round_even(value / 2.0::DOUBLE, 0) ORDER BY event_id) AS rn FROM events) SELECT event_id, x, value FROM e WHERE rn = 1 OR always"),
    "audit_refs": (audit_refs, "SELECT DISTINCT 'line without order' AS rule, l_orderkey * 2 AS object FROM lineitem WHERE l_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT DISTINCT 'order without customer', o_custkey * 3 FROM orders WHERE o_custkey * 3 NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'customer without nation', c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)"),
    "audit_rank": (audit_rank, f"WITH {_P}, r AS (SELECT cust, plan, score, lag(plan) OVER w AS lp, lag(score) OVER w AS ls FROM p WINDOW w AS (PARTITION BY cust ORDER BY plan, score)) SELECT cust, CASE WHEN plan = lp THEN 'rank repeats' ELSE 'score falls' END AS rule, count(*) AS n FROM r WHERE plan = lp OR score < ls - 1e-9 GROUP BY 1, 2"),
    "audit_close": (audit_close, "WITH l AS (SELECT round(l_extendedprice / 3, 3) AS r, l_extendedprice / 3 AS c FROM lineitem) SELECT abs(r - c) <= greatest(1e-9 * greatest(abs(r), abs(c)), 0.0004) AS ok, count(*) AS n FROM l GROUP BY 1"),
    "rejections": (rejection_reasons, "SELECT event_type || '/' || (user_id % 5) AS reason, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, reason LIMIT 15"),
    "coverage": (coverage, "SELECT o_orderpriority, count(*) AS n, count_if(o_orderstatus <> 'P')::BIGINT AS connected, round(count_if(o_orderstatus <> 'P')::DOUBLE / count(*), 6) AS share FROM orders GROUP BY 1"),
}
