"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over host and path, with the literal tokens (runs of a-z and 0-9) that each URL that it
matches must hold whole. Tokens' frequencies among the distinct URLs choose each rule's rarest token; a URL's tokens fetch
candidate rules by a join, and only those run their expressions. A rule without a literal token is fetched by every URL.

Host rules (``host/path``) come first, the longest that fits; where none fits, token rules block known spam hosts and
pages without prose, and what no rule blocks is allowed. All of it is DataFrame operations. Equal URLs are judged once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns

#: Host rules as (verdict, host and path).
HOST_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Words whose presence as a whole token of the host blocks a URL that no host rule fits.
SPAM_WORDS = tuple("casino casinos poker roulette blackjack bet bets betting bookmaker jackpot slots gambling lottery viagra cialis levitra pharma porn porno xxx sex nude adult escort escorts hentai payday forex bitcoins warez torrent torrents keygen crack cracked spam spamfarm linkfarm replica replicas clickbait".split())
#: Paths (from one slash to the next, or the end) of pages without prose, which block a URL that no host rule fits.
EMPTY_PATHS = ("cgi-bin", "wp-login.php", "wp-admin", "wp-json", "xmlrpc.php", "phpmyadmin", "ad/click", "ads/click", "adserver", "affiliate/redirect", "cart/checkout", "user/login", "account/login", "oauth/authorize", "password/reset", "print/preview", "feed/atom", "sitemap.xml", "robots.txt", "favicon.ico")
#: Up to so many rules the index is broadcast. Beyond, the join shuffles by token and a number that deals a token's URLs to tasks
#: of at most so many, since nearly all URLs hold tokens like "com" (and the empty one, of rules without a literal).
BROADCAST_RULES, URLS_OF_A_TASK = 10_000, 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_rule(verdict: str, rule: str) -> tuple[str, str, list[str], str, int]:
    """(rule, pattern, tokens, verdict, rank) of a host rule: the host itself or a subdomain, and a prefix of the path."""
    host, _, path = rule.partition("/")
    whole = re.sub(r"[^a-z0-9]*[a-z0-9]*\Z", "", f"/{path}".lower()) if path and path[-1].isalnum() else path.lower()
    return rule, rf"\A(?:[^/?#]*\.)?{_quoted(host)}{_quoted('/' + path)}", sorted(set(re.findall(r"[a-z0-9]+", f"{host}/{whole}"))), verdict, len(rule)


def word_rule(verdict: str, word: str) -> tuple[str, str, list[str], str, int]:
    return f"*{word}*", rf"\A(?:[^/?#]*[^a-z0-9/?#])?{word}(?:[^a-z0-9]|\z)", [word], verdict, 0


def path_rule(verdict: str, part: str) -> tuple[str, str, list[str], str, int]:
    return f"*/{part}", rf"\A[^/]*(?:/[\s\S]*)?/{_quoted(part)}(?:/|\z)", sorted(set(re.findall(r"[a-z0-9]+", part))), verdict, 0


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)


def host_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.translate(F.regexp_extract(F.substring(u, at + 3, F.length(u)), r"\A[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(u, at + 3, F.length(u)), r"\A[^/?#]*([^?#]*)", 1)).otherwise("")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple] | None = None, broadcast_rules: int = BROADCAST_RULES, urls_of_a_task: int = URLS_OF_A_TASK) -> DataFrame:
    """(key, host, path, rule, verdict) of every row. A null URL or one without ``://`` has an empty host and path, no rule,
    and is allowed. Repeated rows are judged each; other columns don't matter."""
    spark = pages.sparkSession
    rules = rules if rules is not None else [host_rule(*r) for r in HOST_RULES] + [word_rule("block", w) for w in SPAM_WORDS] + [path_rule("block", x) for x in EMPTY_PATHS]
    rows = columns(pages, key, url).toDF("key", "url")
    rows = rows.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("target", F.concat("host", "path"))
    targets = rows.select("target").distinct()
    words = targets.select("target", F.explode(F.array_distinct(F.concat(F.split(F.lower("target"), "[^a-z0-9]+"), F.array(F.lit(""))))).alias("token"))
    book = spark.createDataFrame(rules, "rule string, pattern string, tokens array<string>, verdict string, rank int")
    small = len(rules) <= broadcast_rules
    sized = F.broadcast if small else (lambda df: df)
    literal = book.select("rule", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    seen = words.join(sized(literal.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = literal.join(seen, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("t")).select("rule", F.col("t.token").alias("token"))
    index = book.join(rarest, "rule").select("token", "rule", "pattern", "verdict", "rank")
    if small:
        met = words.join(F.broadcast(index), "token")
    else:
        deals = -(-targets.count() // urls_of_a_task)
        dealt = index.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(max(0, deals - 1)))))
        met = words.withColumn("deal", F.pmod(F.xxhash64("target"), F.lit(max(1, deals))).cast("int")).join(dealt, ["token", "deal"])
    hits = met.filter(F.expr("target rlike pattern"))
    best = hits.groupBy("target").agg(F.max(F.when(F.col("rank") > 0, F.struct("rank", "rule", "verdict"))).alias("fits"), F.max(F.when(F.col("rank") == 0, F.col("verdict"))).alias("other"))
    return rows.join(best, "target", "left").select(F.col("key").alias(key), "host", "path", F.col("fits.rule").alias("rule"), F.coalesce("fits.verdict", "other", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    fits = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{{{i}}}'" for i, (_, r) in sorted(enumerate(HOST_RULES), key=lambda x: -len(x[1][1])))
    rule = re.sub(r"\{(\d)\}", lambda m: HOST_RULES[int(m[1])][1], fits)
    verdict = re.sub(r"\{(\d)\}", lambda m: HOST_RULES[int(m[1])][0], fits)
    spam, empty = "|".join(SPAM_WORDS), "|".join(re.escape(x) for x in EMPTY_PATHS)
    return rf"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN regexp_matches(host, '(^|[^a-z0-9])({spam})([^a-z0-9]|$)') OR regexp_matches(path, '/({empty})(/|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


SQL = _sql()
