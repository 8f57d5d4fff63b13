"""Fetching over HTTP and what rests on it: sitemap trees and live crawls.

A fetch is a function from URLs (url, ...) to fetched pages (SCHEMA), run by executors in as many partitions as requests
may be in flight. A lost executor's URLs are fetched again, so each level is written down before it is read twice.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import astuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text, urls
from folio.operators.links import scan_links
from folio.sources.config import Settings
from folio.sources.fetch import SCHEMA, Fetched, Pacer, retry_after_seconds, with_retries
from folio.sources.urls import fallback_sitemaps, parse_list, parse_sitemaps, read_lines
from folio.storage import materialize

Fetch = Callable[[DataFrame], DataFrame]
AGENT = "folio/0.1"
DEEPEST_SITEMAP = 10


def http_get(url: str, seconds: float = 30.0, agent: str = AGENT) -> Fetched:
    """One GET, redirects followed. Any answer is a result with its body; no answer is status 0 with the error's text."""
    try:
        answer = urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=seconds)
    except urllib.error.HTTPError as e:
        answer = e
    except (OSError, ValueError) as e:
        return Fetched(url, url, error=str(e) or type(e).__name__)
    try:
        with answer:
            body = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
            wait = retry_after_seconds(answer.headers.get("Retry-After"), time.time()) if answer.status == 429 else None
            return Fetched(url, answer.geturl(), body, answer.status, None, wait)
    except (OSError, LookupError) as e:
        return Fetched(url, url, error=str(e) or type(e).__name__)


def http_fetch(settings: Settings) -> Fetch:
    """The fetch of a site's settings. Each of n partitions starts its requests n delays apart, one delay after the
    partition before it; a 429 that outlives its retries doubles the partition's delay, a success halves it back."""
    rate, seconds = settings.rate_limit, settings.fetcher.timeout_ms / 1000
    n = rate.max_concurrent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pacer = Pacer(rate.delay_seconds * n)
        time.sleep(rate.delay_seconds * TaskContext.get().partitionId())
        for pdf in batches:
            for url in pdf["url"]:
                pacer.wait()
                found = with_retries(lambda u: http_get(u, seconds), url, rate.max_retries, rate.retry_base_delay)
                pacer.back_off() if found.status_code == 429 else pacer.ease_off() if found.success else None
                yield pd.DataFrame([astuple(found)], columns=list(Fetched.__dataclass_fields__))[[c.split()[0] for c in SCHEMA.split(", ")]]

    return lambda found: found.select("url").repartition(n).mapInPandas(run, SCHEMA)


def fetcher(settings: Settings) -> Fetch:
    if settings.fetcher.use_js:
        raise NotImplementedError("no browser here: fetch pages that need one elsewhere and pass them as --fetched")
    return http_fetch(settings)


def _answered() -> Column:
    return F.col("status_code").between(200, 299) & (F.coalesce("error", F.lit("")) == "")


def probe(spark: SparkSession, base_url: str, fetch: Fetch) -> DataFrame:
    """The base URL's fetched page, one row, with its length, whether its final URL ends in a slash, the site's
    framework and whether it seems to need a browser. A page that fails is an error."""
    page = materialize(fetch(spark.createDataFrame([(base_url,)], "url string")), "probe")
    row = page.select("status_code", "error").first()
    if row.error or not 200 <= row.status_code < 400:
        raise RuntimeError(f"{base_url}: {row.error or f'HTTP {row.status_code}'}")
    about = {"length": F.length("html"), "trailing_slash": F.col("final_url").endswith("/"), "pattern": text.pattern_name(F.col("final_url"), F.col("html"))}
    return page.withColumns({**about, "needs_js": text.needs_js(F.col("html"))})


def reusing(fetch: Fetch, probed: DataFrame) -> Fetch:
    """A fetch that takes the probe's page as it is where it is asked for."""
    pages = probed.select(*[c.split()[0] for c in SCHEMA.split(", ")])

    def run(found: DataFrame) -> DataFrame:
        return fetch(found.join(pages.select("url"), "url", "left_anti")).unionByName(pages.join(found.select("url"), "url", "left_semi"))

    return run


def sitemap_tree(spark: SparkSession, base_url: str, fetch: Fetch, deepest: int = DEEPEST_SITEMAP) -> DataFrame:
    """(url, title, priority, depth, pos) of all pages in a site's sitemaps: those that robots.txt names, else those
    at the usual places, and what indexes lead to, level by level, each document once.

    pos is the way through the tree, an array. A document that isn't there, or no XML, has no pages.
    """
    robots = fetch(spark.createDataFrame([(fallback_sitemaps(base_url)[0].rsplit("/", 1)[0] + "/robots.txt",)], "url string")).where(_answered())
    lines = robots.select(F.posexplode(F.split("html", r"\r?\n")).alias("at", "line")).where(F.lower("line").startswith("sitemap:"))
    level = materialize(lines.groupBy(text.strip(F.substring("line", 9, 1 << 20)).alias("url")).agg(F.array(F.min("at")).alias("way")), "sitemap-level")
    if level.isEmpty():
        level = spark.createDataFrame([(u, [k]) for k, u in enumerate(fallback_sitemaps(base_url))], "url string, way array<int>")
    seen, pages = level.select("url"), []
    for _ in range(deepest):
        docs = materialize(fetch(level).where(_answered()).join(level, "url").select(F.col("url").alias("path"), "way", F.col("html").alias("xml")), "sitemaps")
        if docs.isEmpty():
            break
        entries = parse_sitemaps(docs, tree=True).join(docs.select("path", "way"), "path")
        pages.append(entries.select("url", "title", "priority", "depth", F.concat("way", F.array(F.col("pos").cast("int"))).alias("pos")))
        index = docs.select("way", F.from_xml("xml", "STRUCT<sitemap: ARRAY<STRUCT<loc: STRING>>>", {"mode": "PERMISSIVE"}).alias("x"))
        below = index.select("way", F.posexplode("x.sitemap").alias("at", "s")).select(text.strip(F.col("s.loc")).alias("url"), F.concat("way", F.array("at")).alias("way"))
        level = materialize(below.where("url <> ''").groupBy("url").agg(F.min("way").alias("way")).join(seen, "url", "left_anti"), "sitemap-level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("url"))
    if not pages:
        return spark.createDataFrame([], "url string, title string, priority double, depth int, pos array<int>")
    out = pages[0]
    for more in pages[1:]:
        out = out.unionByName(more)
    return out


def crawl_live(spark: SparkSession, settings: Settings, fetch: Fetch) -> DataFrame:
    """(url, depth, pos) of a site's pages by levels from its base URL, each fetched and scanned for links once.

    As `links.crawl`, with the pages of a level fetched as it is reached; pages that fail are given but lead nowhere.
    """
    d, base = settings.discovery, settings.base_url
    ok = urls.is_doc(F.col("url")) & urls.should_include(F.col("url"), base, d.include, d.exclude)
    start = spark.createDataFrame([(base,)], "url string").select(urls.normalize(F.col("url")).alias("url"), F.array(F.lit(0)).alias("pos"))
    level, visited = materialize(start.withColumn("depth", F.lit(0)).withColumn("ok", ok), "crawl-level"), None
    for depth in range(1, d.max_depth + 2):
        visited = level if visited is None else visited.unionByName(level)
        if depth > d.max_depth or level.where("ok").isEmpty():
            break
        pages = fetch(level.where("ok")).where(_answered()).select("url", "html")
        found = scan_links(pages).join(level.select(F.col("url").alias("src"), F.col("pos").alias("way")), "src")
        found = found.where(urls.base_domain(F.col("dst")) == urls.base_domain(F.lit(base)))
        steps = found.groupBy(urls.normalize(F.col("dst")).alias("url")).agg(F.min(F.concat("way", F.array(F.col("pos").cast("int")))).alias("pos"))
        fresh = steps.join(visited.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)).withColumn("ok", ok)
        level = materialize(fresh, "crawl-level")
    return visited.where("ok").select("url", "depth", "pos")


def _listed(spark: SparkSession, settings: Settings, _: Fetch) -> DataFrame:
    if not settings.discovery.urls_file:
        raise ValueError("manual discovery needs a file of URLs")
    return parse_list(read_lines(spark, settings.discovery.urls_file))


DISCOVERERS = {"sitemap": lambda spark, settings, fetch: sitemap_tree(spark, settings.base_url, fetch), "crawl": crawl_live, "manual": _listed}


def discoverer(mode: str) -> Callable[[SparkSession, Settings, Fetch], DataFrame]:
    """The function that finds a site's URLs in a discovery mode."""
    if mode not in DISCOVERERS:
        raise ValueError(f"unknown discovery mode: {mode}")
    return DISCOVERERS[mode]
