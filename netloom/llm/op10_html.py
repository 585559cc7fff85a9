"""HTML main text by nearest-URL page differencing.

Pages of one host are sorted by URL path; a page is paired with the neighbour whose path shares the longer prefix. Each page
is read into lines: the text of its blocks, with the element that each stands in. The units of the pair, which are whole marked
articles or, on pages without any, open lines, are aligned by a longest common subsequence, and those that both hold are
deleted as the site's frame.

The difference of lines alone can't give the article: neighbours may share a paragraph (which must stay), and a
site's menus may differ from page to page (which must go). So what is compared follows plain markup: an ``article``
or ``main`` is one unit, and lines within menus, headers, footers, asides, forms, adverts, notices and comments are none. An exact
check follows: neighbours may carry the same article, so articles that both hold go only if each page has another of its own.

Pages are dealt by ranges of (host, path, id), with the edge rows of the neighbouring ranges as ghosts, so a host with a
third of all pages is shared between tasks and every page meets the same neighbour however rows are dealt.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, modest_batches, ordered_parts, schema_of
from .op4_urls import host_of, path_of

#: Fixed values of HTML: elements without content, with raw text, and that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that aren't part of an article, and words that name such parts in class, id or role.
FRAME = frozenset("nav header footer aside form menu dialog noscript template svg button select script style head title textarea iframe object".split())
FRAME_WORDS = frozenset("ad ads advert adverts advertisement banner banners sponsor sponsored promo cookie cookies consent notice notices gdpr popup modal newsletter subscribe sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs header footer masthead comment comments reply replies disqus respond share sharing social related recommended widget".split())
#: Those of them that name texts beside the article, which may be marked as articles themselves.
BESIDE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo comment comments reply replies disqus respond related recommended widget".split())
#: WRAP and ASIDE are dropped, but an article in them is kept if the page marks no other: first WRAPPED, at last ASIDE_KEPT ones.
KEEP, NEUTRAL, DROP, WRAP, ASIDE, WRAPPED, ASIDE_KEPT = range(7)
_ARTICLE = {NEUTRAL: KEEP, WRAP: WRAPPED, ASIDE: ASIDE_KEPT}

_markup = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(>|\Z)|</[^>]*(?:>|\Z)", re.S)
_attribute = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_space = re.compile(r"\s+")


def _role(tag: str, attributes: str, above: int) -> int:
    marked = above in _ARTICLE.values()
    if above == DROP or tag in FRAME and (marked or tag != "form"):
        return DROP
    now = WRAP if tag == "form" and above == NEUTRAL else above
    if attributes:
        words = {w for m in _attribute.findall(attributes) for w in re.split(r"[^a-z0-9]+", "".join(m).lower())}
        if words & FRAME_WORDS and tag not in ("html", "body", "article", "main"):
            return DROP if marked else ASIDE if words & BESIDE or above == ASIDE else WRAP
        if "main" in words and "role" in attributes.lower():
            return _ARTICLE.get(now, now)
    return _ARTICLE.get(now, now) if tag in ("article", "main") else now


def lines(html: str) -> list[tuple[int, str, int]]:
    """(role, text, article) of the blocks in page order: character references decoded, white space single, empty blocks left out.
    Marked articles have numbers from 1; one within another has the outer one's."""
    out: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int, int]] = []
    parts: list[str] = []
    role, article, articles, at, end = NEUTRAL, 0, 0, 0, len(html)

    def close() -> None:
        text = _space.sub(" ", unescape("".join(parts))).strip() if parts else ""
        if text:
            out.append((role, text, article))
        parts.clear()

    while at < end:
        m = _markup.search(html, at)
        if not m:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[5], m[6], m[7])
        if not tag or at == end and html[-1] != ">":  # a comment, or a tag cut off by the end
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK or tag in RAW or tag in FRAME:
            close()
        if slash:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(_role(t, "", NEUTRAL) != NEUTRAL for t, *_ in stack[i + 1 :]) and tag not in BLOCK:
                        break  # an inline end tag doesn't close the parts of a page
                    if tag not in BLOCK and stack[-1][1] != (stack[i - 1][1] if i else NEUTRAL):
                        close()
                    del stack[i:]
                    break
            role, article = stack[-1][1:] if stack else (NEUTRAL, 0)
        elif tag in VOID:
            continue
        elif tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at = stop.end() if stop else end
        else:
            if tag in BLOCK:  # a block ends an open paragraph, with what is open in it
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK:
                        break
                if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            del stack[i:]
                            break
                        if stack[i][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                            break
            above, within = stack[-1][1:] if stack else (NEUTRAL, 0)
            now = _role(tag, attributes, above)
            if now != above and tag not in BLOCK:
                close()
            if not within and now in _ARTICLE.values():
                within = articles = articles + 1
            stack.append((tag, now, within))
            role, article = now, within
    close()
    return out


def common(a: list, b: list) -> list[bool]:
    """Which items of ``a`` belong to a longest common subsequence with ``b`` (Hunt and Szymanski's method, after equal ends
    are set aside)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    mark = [i < lo or i >= len(a) - hi for i in range(len(a))]
    places: dict = {}
    for j in range(lo, len(b) - hi):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list = []
    for i in range(lo, len(a) - hi):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        mark[link[0]] = True
        link = link[1]
    return mark


def units(page: list[tuple[int, str, int]], role: int) -> list[tuple[str, ...]]:
    """The page's open lines, each alone, or the lines of each of its articles of a role."""
    out: dict[int, list[str]] = {}
    for i, (r, t, article) in enumerate(page):
        if r == role:
            out.setdefault(-i if role == NEUTRAL else article, []).append(t)
    return [tuple(u) for u in out.values()]


def main_text(page: list[tuple[int, str, int]], other: list[tuple[int, str, int]] | None) -> str:
    """The page's units without those of its frame, given the lines of its neighbour (None: it has no neighbour)."""
    role = next((r for r in (KEEP, WRAPPED) if any(x[0] == r for x in page)), NEUTRAL)
    mine, theirs = units(page, role), units(other or [], role)
    shared = common(mine, theirs)
    own = [u for u, s in zip(mine, shared, strict=True) if not s]
    if role != NEUTRAL and not (own and sum(shared) < len(theirs)):  # the pair carries the same article
        own = mine
    return "\n".join([t for u in own for t in u] or [t for r, t, _ in page if r == ASIDE_KEPT])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row.

    A null or empty page gives the empty text. A neighbour with the very same lines tells nothing; the next one with others is
    used (as far as the task's range of URLs goes). A page without such a neighbour keeps its open lines, frame and all. Pages without a host (null URLs too) are one host. Repeated rows are neighbours of one another.
    """
    modest_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}
    rows = columns(pages, key, url, html).toDF("key", "url", "html")
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    place = F.concat_ws("\u0001", "host", "path", F.lpad(F.coalesce(F.col("key").cast("string"), F.lit("")), 20, "0"), F.coalesce("url", F.lit("")))
    dealt = ordered_parts(rows.withColumn("place", place), "place", ghosts_before=True, ghosts_after=True)
    dealt = dealt.sortWithinPartitions("part", "place", F.xxhash64("html")).select("key", "url", "html", "host", "path", "part", "ghost")
    schema = f"key {kinds[key]}, url string, text string, n_chars long"
    arrow = schema_of(schema)

    def run(batches):
        """Pages of one host with the same lines that follow one another are a run; the runs beside it are its neighbours."""
        before = here = None  # (part, host), lines, rows of (path, ghost, key, url)
        out: list[tuple] = []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        def close(after):
            near = [(x[1], x[2][at][0]) for x, at in ((before, -1), (after, 0)) if x and x[0] == here[0]]
            made: dict[int, str] = {}
            for path, ghost, k, u in here[2]:
                if not ghost:
                    best = max(range(len(near)), key=lambda i: len(commonprefix([near[i][1], path])), default=-1)
                    if best not in made:
                        made[best] = main_text(here[1], near[best][0] if near else None)
                    out.append((k, u, made[best], len(made[best])))

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                for k, u, h, host, path, p, g in zip(*(part.column(c).to_pylist() for c in ("key", "url", "html", "host", "path", "part", "ghost")), strict=True):
                    now = ((p, host), lines(h or ""), [(path, g, k, u)])
                    if here and here[:2] == now[:2]:
                        here[2].extend(now[2])
                        continue
                    if here:
                        close(now)
                    before, here = here, now
                if len(out) >= 256:
                    yield batch_of()
                    out.clear()
        if here:
            close(None)
        if out:
            yield batch_of()

    return dealt.mapInArrow(run, schema).withColumnRenamed("key", key).withColumnRenamed("url", url)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
