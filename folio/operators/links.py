"""Links: scan, resolution, breadth-first crawl, and rewriting between written pages."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import urls
from folio.functions.dom import parse
from folio.storage import materialize

LINK = r"\[([^\]]*)\]\(([^)]+)\)"


def _joined(base: str | None, href: str | None) -> str | None:
    if base is None or href is None:
        return None
    try:
        return urljoin(base, href)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """Any reference against its page."""
    return pd.Series([_joined(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


# computed once though a filter and later columns read it
resolve = resolve.asNondeterministic()


@F.pandas_udf(T.ArrayType(T.StringType()))
def hrefs(html: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute targets, without fragments, of all links of any page, in document order."""
    out = []
    for h, b in zip(html, base, strict=True):
        found = [_joined(b, a.attrs["href"]) for a in parse(h or "").find_all("a") if "href" in a.attrs]
        out.append([urldefrag(u)[0] for u in found if u])
    return pd.Series(out)


def scan_links(pages: DataFrame) -> DataFrame:
    """(src, pos, dst) of pages (url, html); general references, by the DOM."""
    return pages.select(F.col("url").alias("src"), F.posexplode(hrefs(F.col("html"), F.col("url"))).alias("pos", "dst"))


def scan_rooted_links(pages: DataFrame) -> DataFrame:
    """As scan_links where hrefs are absolute or root-relative: expressions alone."""
    found = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    links = pages.select(F.col("url").alias("src"), F.posexplode(found).alias("pos", "href"))
    return links.select("src", "pos", urls.resolve_rooted(F.col("src"), F.col("href")).alias("dst"))


def crawl(links: DataFrame, start: str, max_depth: int = 3, max_pages: int = 0, base: str = "", include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(url, depth, pos) by levels over links (src, pos, dst): what a queue would visit, in its order.

    Pages that are no documentation or that the patterns refuse are neither given nor followed. A level is one join
    of the frontier with the links and one anti-join with what was visited; both are cut off in the shared folder.
    """
    spark = links.sparkSession
    edges = links.select(urls.normalize(F.col("src")).alias("src"), F.col("pos").alias("_pos"), F.col("dst")).where(F.col("dst").isNotNull())
    edges = edges.where(urls.base_domain(F.col("dst")) == F.lit(re.match(urls.RFC, start)[2].lower()))
    edges = materialize(edges.withColumn("url", urls.normalize(F.col("dst"))).drop("dst").distinct(), "crawl-links")
    frontier = spark.createDataFrame([(start,)], "url string").select(urls.normalize(F.col("url")).alias("url"), F.array(F.lit(0)).alias("_order"))
    visited = None
    for depth in range(max_depth + 1):
        ok = urls.is_doc(F.col("url")) & urls.should_include(F.col("url"), base, include, exclude)
        level = materialize(frontier.select("url", F.lit(depth).alias("depth"), "_order", ok.alias("_ok")), "crawl-level")
        if level.isEmpty():
            break
        visited = level if visited is None else visited.unionByName(level)
        if depth < max_depth:
            steps = level.where("_ok").join(edges, F.col("src") == level["url"]).select(edges["url"], F.concat("_order", F.array(F.col("_pos").cast("int"))).alias("_order"))
            # discovery order: of the page's own place, then of the link in it
            frontier = steps.groupBy("url").agg(F.min("_order").alias("_order")).join(visited.select("url"), "url", "left_anti")
    given = visited.where("_ok")
    if max_pages > 0:
        given = given.orderBy("depth", "_order").limit(max_pages)
    return given.select("url", "depth", F.col("_order").alias("pos"))


def link_targets(pages: DataFrame) -> DataFrame:
    """(url, href, path, target): each written link whose page was written too, and that page's file; once for pages of
    the same URL."""
    keys = pages.groupBy(urls.match_key(F.col("url")).alias("_key")).agg(F.max_by(urls.output_path(F.col("url")), F.col("pos")).alias("target"))
    found = pages.select("url", urls.output_path(F.col("url")).alias("path"), F.explode(F.array_distinct(F.regexp_extract_all("markdown", F.lit(LINK), F.lit(2)))).alias("href"))
    open_ = found.where(~F.col("href").rlike("^(#|mailto:|tel:)")).distinct().withColumn("_to", resolve(F.col("url"), F.col("href")))
    inside = open_.where((urls.authority(F.col("_to")) == "") | (urls.authority(F.col("_to")) == urls.authority(F.col("url"))))
    return inside.join(keys, urls.match_key(F.regexp_replace("_to", "#.*$", "")) == keys["_key"]).select("url", "href", "path", "target", "_to")


def _rewritten(body: str, at: str, found: dict[str, tuple[str, str]]) -> str:
    def new(m: re.Match) -> str:
        if m[2] not in found:
            return m[0]
        target, to = found[m[2]]
        mark = "#" + to.split("#", 1)[1] if "#" in to else ""
        return f"[{m[1]}]({posixpath.relpath(target, posixpath.dirname(at) or '.')}{mark})"

    return re.sub(LINK, new, body)


@F.pandas_udf(T.StringType())
def _rewrite(body: pd.Series, at: pd.Series, found: pd.Series) -> pd.Series:
    rows = zip(body, at, found, strict=True)
    return pd.Series([b if f is None or not len(f) else _rewritten(b, a, {x["href"]: (x["target"], x["to"]) for x in f}) for b, a, f in rows], dtype=object)


def rewrite_links(pages: DataFrame, document: Column | None = None) -> DataFrame:
    """pages (url, pos, markdown) with path and body: links to other written pages lead to their files.

    The links of one page are gathered, never those of a site; targets meet by an equi-join on the match key.
    """
    body = F.col("markdown") if document is None else document
    found = link_targets(pages.withColumn("markdown", body)).groupBy("url").agg(F.collect_list(F.struct("href", "target", F.col("_to").alias("to"))).alias("_found"))
    joined = pages.join(found, "url", "left")
    path = urls.output_path(F.col("url"))
    return joined.withColumn("path", path).withColumn("body", _rewrite(body, path, F.col("_found"))).drop("_found")

