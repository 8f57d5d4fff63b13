"""Queries over URLs. Each page's URL comes in seven forms, so that every rule has work at every scale."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import constants as C
from folio.functions import urls
from folio.operators import links, urlset
from folio.plans import sql as S

_FORMS = ["", "#top", "/", "/category/Guide.html?a=1", "/img/logo.PNG", "/docs/api/v2/use.htm#x", "//"]
ROWS = f"""urlset AS (
  SELECT page_id * {len(_FORMS)} + k AS pos, CASE WHEN k < 2 THEN url ELSE regexp_replace(url, '[?#].*$', '') END || [{", ".join(S.quoted(f) for f in _FORMS)}][k + 1] AS url
  FROM pages, (SELECT unnest(range({len(_FORMS)})) AS k))"""
_BASE, _INCLUDE, _EXCLUDE = "https://h.example/docs/", r"[a-m]\.example", r"/\d*7\d*(/|$)"


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def url_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, url) of all pages and forms."""
    bare = F.regexp_replace("url", "[?#].*$", "")
    forms = [F.concat(F.col("url") if k < 2 else bare, F.lit(form)) for k, form in enumerate(_FORMS)]
    rows = read_pages(spark, sf_dir).select("page_id", F.posexplode(F.array(*forms)).alias("k", "url"))
    return rows.select((F.col("page_id") * len(_FORMS) + F.col("k")).alias("pos"), "url")


def _scalar(make: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: url_rows(spark, sf_dir).select("pos", make(F.col("url")).alias("value"))


_P = S.path("url")
_SCALARS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "url_normalize": (urls.normalize, S.normalize("url")),
    "url_base_domain": (urls.base_domain, f"lower({S.part('url', 2)})"),
    "url_is_doc": (urls.is_doc, S.is_doc("url")),
    "url_scope": (lambda u: urls.in_scope(u, _BASE), f"starts_with(rtrim({_P}, '/'), '/docs')"),
    "url_include_exclude": (
        lambda u: urls.should_include(u, "", _INCLUDE, _EXCLUDE),
        f"regexp_matches(url, {S.quoted(_INCLUDE)}) AND NOT regexp_matches(url, {S.quoted(_EXCLUDE)})",
    ),
    "url_category": (urls.is_category, f"contains(lower({_P}), '/category/')"),
    "url_match_key": (urls.match_key, S.match_key("url")),
    "url_output_path": (urls.output_path, S.output_path("url")),
    "url_filename": (urls.file_name, S.file_name("url")),
    "url_truncate": (lambda u: urls.truncated(u, 12), S.truncated("url", 12)),
    "site_name": (urls.site_name, S.site_name("url", C.SITE_PREFIXES)),
    "site_name_index": (urls.index_site_name, S.site_name("url", C.INDEX_PREFIXES)),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _scalar(f) for k, (f, _) in _SCALARS.items()}
ORACLE = {k: f"WITH {ROWS} SELECT pos, {e} AS value FROM urlset" for k, (_, e) in _SCALARS.items()}


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return url_rows(spark, sf_dir).select("pos", urls.scheme(u).alias("scheme"), urls.authority(u).alias("authority"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.fragment(u).alias("fragment"))


ORACLE["url_parts"] = f"WITH {ROWS} SELECT pos, lower({S.part('url', 1)}) AS scheme, {S.part('url', 2)} AS authority, {_P} AS path, {S.part('url', 4)} AS query, {S.part('url', 5)} AS fragment FROM urlset"


def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlset.first_by_url(url_rows(spark, sf_dir))


_FIRST = f"SELECT pos, url FROM (SELECT *, row_number() OVER (PARTITION BY {S.normalize('url')} ORDER BY pos) AS r FROM %s) WHERE r = 1"
ORACLE["url_dedup"] = f"WITH {ROWS} {_FIRST % 'urlset'}"
_SKIP = f"(SELECT {S.normalize('url')} FROM pages WHERE page_id % 7 = 0)"


def _skip_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's skip list: every seventh page."""
    return read_pages(spark, sf_dir).where("page_id % 7 = 0").select(F.concat("url", F.lit("#skip")).alias("url"))


def url_skip_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlset.without_skipped(url_rows(spark, sf_dir), _skip_list(spark, sf_dir))


ORACLE["url_skip_antijoin"] = f"WITH {ROWS} SELECT pos, url FROM urlset WHERE {S.normalize('url')} NOT IN {_SKIP}"


def url_limit_before_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature: max_pages counts before duplicates and skipped URLs go."""
    return urlset.discovered(url_rows(spark, sf_dir), _skip_list(spark, sf_dir), exclude=_EXCLUDE, max_pages=60)


ORACLE["url_limit_before_dedup"] = f"""WITH {ROWS}, kept AS (SELECT * FROM urlset WHERE {S.is_doc('url')} AND NOT regexp_matches(url, {S.quoted(_EXCLUDE)}) ORDER BY pos LIMIT 60)
SELECT pos, url FROM ({_FIRST % 'kept'}) WHERE {S.normalize('url')} NOT IN {_SKIP}"""


def url_prefix_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlset.prefix_counts(url_rows(spark, sf_dir))


ORACLE["url_prefix_top10"] = f"""WITH {ROWS} SELECT {S.prefix('url')} AS prefix, count(*) AS pages, min(pos) AS first_pos, '--include "' || rtrim({S.prefix('url')}, '/') || '"' AS filter
FROM urlset GROUP BY {S.prefix('url')} ORDER BY pages DESC, first_pos LIMIT 10"""

_HREFS = "SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<a\\s[^>]*?href=\"([^\"]*)\"', 1), 1) - 1 AS pos FROM pages"
_TO = f"regexp_replace({S.unescaped('href')}, '#.*$', '')"


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the DOM, for references of any kind."""
    return links.scan_links(read_pages(spark, sf_dir)).select("src", F.col("pos").cast("long").alias("pos"), "dst")


ORACLE["link_extract"] = f"SELECT url AS src, pos::BIGINT AS pos, {S.site('url')} || {_TO} AS dst FROM ({_HREFS})"


def link_extract_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By expressions alone, for root-relative and absolute references."""
    return links.scan_rooted_links(read_pages(spark, sf_dir)).select("src", F.col("pos").cast("long").alias("pos"), "dst")


ORACLE["link_extract_native"] = f"SELECT url AS src, pos::BIGINT AS pos, {S.site('url')} || regexp_replace(href, '#.*$', '') AS dst FROM ({_HREFS})"


def same_domain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per host: links that stay on it, to pages that aren't there yet."""
    found = links.scan_rooted_links(read_pages(spark, sf_dir)).where(urls.same_domain(F.col("src"), F.col("dst")))
    known = read_pages(spark, sf_dir).select(urls.normalize(F.col("url")).alias("known")).distinct()
    new = found.select(urls.base_domain(F.col("dst")).alias("domain"), urls.normalize(F.col("dst")).alias("dst")).join(known, F.col("dst") == F.col("known"), "left_anti")
    return new.groupBy("domain").agg(F.count("*").alias("links"), F.countDistinct("dst").alias("targets"))


ORACLE["same_domain_links"] = f"""WITH l AS (SELECT lower({S.part('url', 2)}) AS domain, {S.site('url')} || regexp_replace(href, '#.*$', '') AS dst FROM ({_HREFS}))
SELECT domain, count(*) AS links, count(DISTINCT {S.normalize('dst')}) AS targets FROM l WHERE {S.normalize('dst')} NOT IN (SELECT {S.normalize('url')} FROM pages) GROUP BY domain"""


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site over the page ids: page i links to 3i + 1, i div 2 and, outside the scope, an asset."""
    ids = read_pages(spark, sf_dir).select(F.col("page_id").alias("i"))
    at = lambda n: F.concat(F.lit("http://h.example/docs/"), n.cast("string"))
    targets = F.array(at(F.expr("3 * i + 1")), at(F.expr("i div 2")), F.concat(at(F.col("i")), F.lit(".png")))
    return ids.select(at(F.col("i")).alias("src"), F.posexplode(targets).alias("pos", "dst"))


def crawl_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.crawl(_graph(spark, sf_dir), "http://h.example/docs/5", max_depth=4, base="http://h.example/docs", exclude="/1.$")
    return found.select("url", F.col("depth").cast("long").alias("depth"))


ORACLE["crawl_levels"] = """WITH RECURSIVE edges AS (SELECT page_id AS i, unnest([3 * page_id + 1, page_id // 2]) AS j FROM pages),
walk(i, depth) AS (SELECT 5::BIGINT, 0::BIGINT UNION SELECT j, depth + 1 FROM walk JOIN edges USING (i) WHERE depth < 4 AND NOT regexp_matches(j::VARCHAR, '^1.$'))
SELECT 'http://h.example/docs/' || i AS url, min(depth) AS depth FROM walk GROUP BY i"""

QUERIES |= {f.__name__: f for f in (url_parts, url_dedup, url_skip_antijoin, url_limit_before_dedup, url_prefix_top10, link_extract, link_extract_native, same_domain_links, crawl_levels)}
