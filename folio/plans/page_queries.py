"""Queries over page contents and Markdown.

The pages hold no Markdown; `drafts` makes some of each page's own title, text and URL, with one of everything that the
clean-up rules are about. The same draft is made in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import constants as C
from folio.functions import text, urls
from folio.operators import documents, links, patterns
from folio.operators import pages as P
from folio.plans import sql as S
from folio.plans.url_queries import read_pages

_AT = datetime(2024, 1, 2, 3, 4, 5)
_BASE = "https://docs.my-site.example/start"


def _unescaped(x: Column) -> Column:
    for code, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&#39;", "'")):
        x = F.replace(x, F.lit(code), F.lit(char))
    return F.regexp_replace(x, "&amp;?", "&")


def native_title(html: Column) -> Column:
    return text.strip(_unescaped(F.regexp_extract(html, "(?s)<title[^>]*>(.*?)</title>", 1)))


def native_article(html: Column) -> Column:
    body = F.regexp_replace(F.regexp_extract(html, "(?s)<article[^>]*>(.*?)</article>", 1), "<[^>]*>", " ")
    return F.trim(F.regexp_replace(_unescaped(body), r"\s+", " "))


def with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, sf_dir).select("page_id", "url", "html", native_title(F.col("html")).alias("title"), native_article(F.col("html")).alias("body"))


_TEXT = f"texts AS (SELECT page_id, url, html, {S.page_title('html')} AS title, {S.article_text('html')} AS body FROM pages)"


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, title, body, draft)"""
    t, u, b = F.col("title"), F.col("url"), F.col("body")
    n = F.col("page_id")
    parts = [
        F.lit("# "), t, F.lit("\n\n\n\n​"), t, F.lit("\n[ ]("), u, F.lit(") [  "), F.left(b, F.lit(30)), F.lit("]("), u, F.lit(")word   x\n##\n\n"), b,
        F.lit("\n# "), t, F.lit("\n# Other \U0001f4c1\n"), F.repeat(F.concat(F.lit("- ["), t, F.lit("]("), u, F.lit(")\n")), (n % 9).cast("int")), F.lit("---\n    four  spaces\n"),
        F.when(n % 5 == 0, F.lit("see /api/v3/users\n")).otherwise(""), F.when(n % 11 == 0, F.lit("Please sign in")).otherwise(""),
    ]
    return with_text(spark, sf_dir).withColumn("draft", F.concat(*parts))


_DRAFTS = f"""{_TEXT}, drafts AS (SELECT *, '# ' || title || chr(10) || chr(10) || chr(10) || chr(10) || chr(8203) || title || chr(10) || '[ ](' || url || ') [  ' || left(body, 30) || '](' || url || ')word   x' || chr(10) || '##' || chr(10) || chr(10) || body
  || chr(10) || '# ' || title || chr(10) || '# Other ' || chr(128193) || chr(10) || repeat('- [' || title || '](' || url || ')' || chr(10), page_id % 9) || '---' || chr(10) || '    four  spaces' || chr(10)
  || CASE WHEN page_id % 5 = 0 THEN 'see /api/v3/users' || chr(10) ELSE '' END || CASE WHEN page_id % 11 = 0 THEN 'Please sign in' ELSE '' END AS draft FROM texts)"""


def _scalar(make: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: drafts(spark, sf_dir).select("page_id", make().alias("value"))


_VERSION = r"/api/(v?\d+(?:\.\d+)?)/"
_FOUND = f"regexp_extract(url || '/api/' || page_id % 4 || '.1/x', '(?i){_VERSION}', 1)"
_LINES = f"list_filter(list_transform(string_split(draft, chr(10)), lambda x: {S.strip('x')}), lambda x: x <> '' AND NOT starts_with(x, '#') AND x <> '---')"
_LINKS = f"list_filter({_LINES}, lambda x: regexp_matches(x, '^[-*]{S.WS}+(\\*\\*)?(\\[.+?\\]\\(.+?\\))(\\*\\*)?{S.WS}*$'))"
_HTML = "html || CASE page_id % 9 WHEN 0 THEN ' gitbook' WHEN 1 THEN 'x docusaurus' WHEN 2 THEN ' DOCUSAURUS openapi-explorer' WHEN 3 THEN 'vp-doc' WHEN 4 THEN 'md-content' WHEN 5 THEN 'Sphinx' WHEN 6 THEN 'id=\"app\"' WHEN 7 THEN 'This page crashed openapi-schema__property' ELSE '' END"
_TAILS = [" gitbook", "x docusaurus", " DOCUSAURUS openapi-explorer", "vp-doc", "md-content", "Sphinx", 'id="app"', "This page crashed openapi-schema__property", ""]


def _marked() -> Column:
    return F.concat(F.col("html"), F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("page_id") % 9 + 1).cast("int")))


def _any(x: str, options: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {S.quoted(o)})" for o in options) + ")"


def _notice() -> Column:
    """What a page behind a login might say, of lengths around the gate's; every third has none of its phrases."""
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("page_id") % 3 + 1).cast("int"))
    return F.concat(F.repeat(F.concat("title", F.lit(" ")), (F.col("page_id") % 23).cast("int")), said)


_SAID = ["Please Sign In", "members: LOGIN REQUIRED", "welcome back"]
_NOTICE = "repeat(title || ' ', page_id % 23) || CASE page_id % 3 WHEN 0 THEN 'Please Sign In' WHEN 1 THEN 'members: LOGIN REQUIRED' ELSE 'welcome back' END"
_LOW = f"lower({_HTML})"
_SCALARS: dict[str, tuple[Callable[[], Column], str]] = {
    "page_title": (lambda: F.col("title"), "title"),
    "article_text": (lambda: F.col("body"), "body"),
    "page_title_clean": (lambda: text.clean_title(F.concat("title", F.lit(" - part | "), "title")), S.clean_title("title || ' - part | ' || title")),
    "anchor": (lambda: text.anchor(F.col("title")), S.anchor("title")),
    "login_gate": (lambda: text.is_login_gate(_notice()), f"length({_NOTICE}) < {C.LOGIN_LENGTH} AND {_any(f'lower({_NOTICE})', C.LOGIN_PHRASES)}"),
    "category_page": (lambda: text.is_category_page(F.col("draft")), f"len({_LINES}) > 0 AND len({_LINKS}) / len({_LINES}) > 0.7"),
    "api_version": (
        lambda: text.api_version(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/api/"), (F.col("page_id") % 4).cast("string"), F.lit(".1/x"))), F.col("draft")),
        f"CASE WHEN page_id % 2 = 1 THEN CASE WHEN starts_with({_FOUND}, 'v') THEN {_FOUND} ELSE 'v' || {_FOUND} END ELSE nullif(regexp_extract(draft, '(?i)(?:public_api|/api)/(v\\d+)/', 1), '') END",
    ),
    "api_page_flag": (lambda: text.is_api_page(F.concat("url", F.lit("/Reference/")), _marked()), f"contains({_HTML}, 'openapi-schema__property')"),
    "pattern_detect": (
        lambda: text.pattern_name(F.col("url"), _marked()),
        f"""CASE WHEN contains(lower(url), 'readthedocs') OR contains(lower(url), '.rtfd.') THEN 'readthedocs'
          WHEN contains({_LOW}, 'docusaurus') AND {_any(_HTML, C.OPENAPI_MARKERS)} THEN 'docusaurus-openapi' WHEN contains({_LOW}, 'docusaurus') THEN 'docusaurus'
          WHEN contains({_LOW}, 'gitbook') OR contains({_HTML}, 'data-testid="page.') THEN 'gitbook' WHEN contains({_LOW}, 'mkdocs') OR contains({_HTML}, 'md-content') THEN 'mkdocs'
          WHEN contains({_LOW}, 'sphinx') THEN 'sphinx' WHEN contains({_LOW}, 'vitepress') OR contains({_HTML}, 'vp-doc') THEN 'vitepress' END""",
    ),
    "js_detect": (lambda: text.needs_js(_marked()), _any(_HTML, C.JS_MARKERS)),
    "crash_detect": (lambda: text.is_crash(_marked()), f"contains({_HTML}, 'This page crashed')"),
    "format_size": (
        lambda: text.format_size(F.length("html") * F.pow(F.lit(7), F.col("page_id") % 6).cast("long")),
        "CASE WHEN {v} < 1024 THEN {v} || ' B' WHEN {v} < 1048576 THEN printf('%.1f KB', {v} / 1024) ELSE printf('%.1f MB', {v} / 1048576) END".format(v="(length(html) * (7 ** (page_id % 6))::BIGINT)"),
    ),
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _scalar(f) for k, (f, _) in _SCALARS.items()}
ORACLE = {k: f"WITH {_DRAFTS} SELECT page_id, {e} AS value FROM drafts" for k, (_, e) in _SCALARS.items()}

# H1 lines as rows, in SQL
_H1 = f"""lines AS (SELECT page_id, unnest(string_split(md, chr(10))) AS x, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM cleaned),
heads AS (SELECT *, {S.strip('x')} AS s, CASE WHEN starts_with({S.strip('x')}, '# ') THEN {S.strip(f'substr({S.strip("x")}, 3)')} END AS t FROM lines),
firsts AS (SELECT page_id, min(i) AS head, arg_min(t, i) AS title FROM heads WHERE t IS NOT NULL GROUP BY page_id),
kept AS (SELECT page_id, x, i FROM heads LEFT JOIN firsts USING (page_id) WHERE head IS NULL OR i <= head OR (coalesce(t, s) <> title) OR (t IS NULL AND title = ''))"""


def h1_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts(spark, sf_dir).select("page_id", text.dedup_h1(F.col("draft")).alias("value"))


def markdown_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts(spark, sf_dir).select("page_id", text.clean_markdown(F.col("draft")).alias("value"))


_CLEANED = f"cleaned AS (SELECT page_id, {S.clean_markdown('draft')} AS md FROM drafts)"
ORACLE["h1_dedup"] = f"WITH {_DRAFTS}, cleaned AS (SELECT page_id, draft AS md FROM drafts), {_H1} SELECT page_id, string_agg(x, chr(10) ORDER BY i) AS value FROM kept GROUP BY page_id"
ORACLE["markdown_clean"] = f"WITH {_DRAFTS}, {_CLEANED}, {_H1} SELECT page_id, {S.strip('string_agg(x, chr(10) ORDER BY i)')} AS value FROM kept GROUP BY page_id"


def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, text and method by the DOM, over every page."""
    c = F.col("content")
    found = P.extract_pages(P.spread(read_pages(spark, sf_dir)))
    return found.select("url", c["title"].alias("title"), F.regexp_replace(c["text"], r"\s+", " ").alias("text"), c["method"].alias("method"))


_SHORT = f"length(body) < {C.MIN_CONTENT_LENGTH}"
ORACLE["extract_pages"] = f"WITH {_TEXT} SELECT url, title, CASE WHEN {_SHORT} THEN '' ELSE body END AS text, CASE WHEN {_SHORT} THEN 'beautifulsoup' ELSE 'css_selector' END AS method FROM texts"


def to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole page as Markdown; golden tests say what it has to look like."""
    return P.spread(read_pages(spark, sf_dir)).select("page_id", P.markdown_of(F.col("html")).alias("markdown"))


def openapi_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.spread(read_pages(spark, sf_dir)).select("page_id", P.openapi_of(F.col("html")).alias("s"))
    return found.select("page_id", "s.title", "s.markdown")


def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted, formatted and gated pages."""
    return P.page_status(P.format_pages(P.extract_pages(P.spread(read_pages(spark, sf_dir)))))


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the page plan, grouped by method, status and size."""
    rows = formatted(spark, sf_dir).select(F.col("content.method").alias("method"), "status", F.coalesce("reason", F.lit("-")).alias("reason"), text.size_bucket(F.length("content.text")).alias("size"))
    return rows.groupBy("method", "status", "reason", "size").agg(F.count("*").alias("pages"))


ORACLE["page_outcomes"] = f"""WITH {_TEXT}, rows AS (SELECT url, CASE WHEN {_SHORT} THEN '' ELSE body END AS text, CASE WHEN {_SHORT} THEN 'beautifulsoup' ELSE 'css_selector' END AS m, contains(lower({S.path('url')}), '/category/') AS cat FROM texts)
SELECT CASE WHEN cat THEN NULL ELSE m END AS method, CASE WHEN cat OR text = '' THEN 'skipped' ELSE 'done' END AS status, CASE WHEN cat THEN 'category url' WHEN text = '' THEN 'no content' ELSE '-' END AS reason,
  CASE WHEN length(text) < 1024 THEN 'tiny' WHEN length(text) < 5120 THEN 'small' WHEN length(text) < 20480 THEN 'normal' ELSE 'large' END AS size, count(*) AS pages FROM rows GROUP BY ALL"""


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts as written pages: pos by URL; every fourth has no title, every fifth an API version."""
    n = F.col("page_id")
    rows = drafts(spark, sf_dir).select(
        "page_id",
        "url",
        F.when(n % 4 != 0, F.col("title")).alias("title"),
        F.when(n % 3 == 0, F.col("draft")).otherwise(F.concat(F.lit("\n\n"), F.col("body"))).alias("markdown"),
        F.when(n % 5 == 0, F.lit("v3")).alias("api_version"),
    )
    return documents.ordered(rows)


_WRITTEN = f"""{_DRAFTS}, written AS (SELECT page_id, url, CASE WHEN page_id % 4 <> 0 THEN title END AS title, CASE WHEN page_id % 3 = 0 THEN draft ELSE chr(10) || chr(10) || body END AS markdown,
  CASE WHEN page_id % 5 = 0 THEN 'v3' END AS api_version, row_number() OVER (ORDER BY url) AS pos FROM drafts)"""
_NAME = "coalesce(nullif(title, ''), 'Page ' || pos)"
_TOC = f"'- [' || {_NAME} || '](#' || {S.anchor(_NAME)} || ')'"


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.toc(_written(spark, sf_dir)).select("url", F.col("pos").cast("long").alias("pos"), "entry")


ORACLE["toc"] = f"WITH {_WRITTEN} SELECT url, pos, {_TOC} AS entry FROM written"


def single_page_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.single_documents(_written(spark, sf_dir)).select("url", "path", "body")


_HAS = f"len(list_filter(string_split(markdown, chr(10)), lambda x: starts_with({S.strip('x')}, '# ') AND {S.strip(f'substr({S.strip("x")}, 3)')} = title)) > 0"
ORACLE["single_page_doc"] = f"""WITH {_WRITTEN} SELECT url, {S.output_path('url')} AS path, '---' || chr(10) || 'source: ' || url || chr(10) || CASE WHEN title <> '' THEN 'title: ' || title || chr(10) ELSE '' END
  || CASE WHEN api_version IS NOT NULL THEN 'api_version: ' || api_version || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || CASE WHEN title <> '' AND NOT ({_HAS}) THEN '# ' || title || chr(10) || chr(10) ELSE '' END || markdown AS body FROM written"""


def combined_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.combined_blocks(_written(spark, sf_dir), _BASE, _AT)
    return found.select(F.col("section").cast("long").alias("section"), F.col("pos").cast("long").alias("pos"), "block")


_FIRST = S.strip(f"string_split(regexp_replace(markdown, '^{S.WS}+', ''), chr(10))[1]")
ORACLE["combined_doc"] = f"""WITH {_WRITTEN}, n AS (SELECT count(*) AS n FROM written)
SELECT 0::BIGINT AS section, 0::BIGINT AS pos, '# My-Site Documentation' || chr(10) || chr(10) || '> Documentation extracted from {_BASE}' || chr(10) || '> Extracted on: {_AT.isoformat()}' || chr(10) || '> Total pages: ' || n || chr(10) AS block FROM n
UNION ALL SELECT 1, 0, '## Table of Contents' || chr(10) FROM n WHERE n > 1
UNION ALL SELECT 1, pos, {_TOC} FROM written, n WHERE n > 1
UNION ALL SELECT 2, 0, '' FROM n WHERE n > 1
UNION ALL SELECT 3, 0, '---' || chr(10)
UNION ALL SELECT 4, pos, '<!-- Page: ' || url || CASE WHEN api_version IS NOT NULL THEN ' | api_version: ' || api_version ELSE '' END || ' -->' || chr(10)
  || CASE WHEN title <> '' AND {_FIRST} <> '# ' || title THEN '# ' || title || chr(10) || chr(10) ELSE '' END || markdown || chr(10) || chr(10) || '---' || chr(10) FROM written"""


def index_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.index_lines(_written(spark, sf_dir), _BASE, _AT)


ORACLE["index_doc"] = f"""WITH {_WRITTEN}, n AS (SELECT count(*) AS n FROM written)
SELECT 0::BIGINT AS pos, '# My-Site Documentation' || chr(10) || chr(10) || '> Extracted from {_BASE}' || chr(10) || '> Extracted on: {_AT.isoformat()}' || chr(10) || '> Total pages: ' || n || chr(10) || chr(10) || '## Pages' || chr(10) AS block FROM n
UNION ALL SELECT pos, '- [' || coalesce(nullif(title, ''), {S.output_path('url')}) || '](' || {S.output_path('url')} || ')' FROM written
UNION ALL SELECT n + 1, '' FROM n"""


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with links to themselves, to the page before by another form of its URL, away, and to an anchor."""
    rows = documents.ordered(with_text(spark, sf_dir).select("page_id", "url", "title"))
    before = rows.select((F.col("page_id") + 1).alias("page_id"), F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit(".html#part")).alias("_before"))
    parts = [F.lit("[own]("), "url", F.lit(") and [before]("), F.coalesce("_before", F.lit("#top")), F.lit(") or ![away](http://else.example/x) [mail](mailto:a@b.c) [top](#top)")]
    return rows.join(before, "page_id", "left").withColumn("markdown", F.concat(*parts)).drop("_before")


def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which written links lead to written pages."""
    return links.link_targets(_linked(spark, sf_dir)).select("url", "href", "target")


ORACLE["link_targets"] = f"""WITH p AS (SELECT page_id, url, row_number() OVER (ORDER BY url) AS pos FROM pages),
keys AS (SELECT {S.match_key('url')} AS k, arg_max({S.output_path('url')}, pos) AS target FROM p GROUP BY ALL),
l AS (SELECT url, url AS href FROM p UNION SELECT p.url, regexp_replace(b.url, '[?#].*$', '') || '.html#part' FROM p JOIN p b ON b.page_id = p.page_id - 1)
SELECT l.url, href, target FROM l JOIN keys ON k = {S.match_key("regexp_replace(href, '#.*$', '')")} WHERE {S.part('href', 2)} = {S.part('l.url', 2)}"""


def _relative(at: str, target: str) -> str:
    here, there = f"list_slice(string_split({at}, '/'), 1, len(string_split({at}, '/')) - 1)", f"string_split({target}, '/')"
    shared = f"least(len(list_filter(range(1, len({here}) + 1), lambda i: list_slice({here}, 1, i) = list_slice({there}, 1, i))), len({there}) - 1)"
    return f"(repeat('../', (len({here}) - {shared})::BIGINT) || array_to_string(list_slice({there}, {shared} + 1, len({there})), '/'))"


_BEFORE = "regexp_replace(b.url, '[?#].*$', '') || '.html'"
ORACLE["link_rewrite"] = f"""WITH p AS (SELECT page_id, url, {S.output_path('url')} AS path, row_number() OVER (ORDER BY url) AS pos FROM pages),
keys AS (SELECT {S.match_key('url')} AS k, arg_max(path, pos) AS target FROM p GROUP BY ALL),
l AS (SELECT p.url, p.path, own.target AS t, {_BEFORE} AS b, CASE WHEN {S.part('p.url', 2)} = {S.part('b.url', 2)} THEN old.target END AS tb
  FROM p JOIN keys own ON own.k = {S.match_key("regexp_replace(p.url, '#.*$', '')")} LEFT JOIN p b ON b.page_id = p.page_id - 1 LEFT JOIN keys old ON old.k = {S.match_key(_BEFORE)})
SELECT url, path, '[own](' || {_relative('path', 't')} || regexp_extract(url, '#.*$') || ') and [before](' || CASE WHEN tb IS NOT NULL THEN {_relative('path', 'tb')} || '#part' ELSE coalesce(b || '#part', '#top') END
  || ') or ![away](http://else.example/x) [mail](mailto:a@b.c) [top](#top)' AS body FROM l"""


def link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.rewrite_links(_linked(spark, sf_dir)).select("url", "path", "body")


def pattern_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many selectors apply to each page by its framework."""
    pages = read_pages(spark, sf_dir).select("page_id", "url", _marked().alias("html"))
    found = patterns.selectors_of(patterns.detect(pages).drop("html"))
    return found.select("page_id", "pattern", F.size("content_selectors").cast("long").alias("content"), F.size("remove_selectors").cast("long").alias("remove"), F.element_at("content_selectors", 1).alias("first"))


_COUNTS = {p.name: p for p in patterns.KNOWN}
_CASE = lambda f: "CASE pattern " + " ".join(f"WHEN '{n}' THEN {f(p)}" for n, p in _COUNTS.items())
ORACLE["pattern_selectors"] = f"""WITH {_TEXT}, found AS (SELECT page_id, {_SCALARS['pattern_detect'][1]} AS pattern FROM texts)
SELECT page_id, pattern, ({_CASE(lambda p: len(p.content_selectors))} ELSE 0 END + {len(C.CONTENT_SELECTORS)})::BIGINT AS content, ({_CASE(lambda p: len(p.remove_selectors))} ELSE 0 END + {len(C.REMOVE_SELECTORS)})::BIGINT AS remove,
  {_CASE(lambda p: S.quoted(p.content_selectors[0]))} ELSE 'article' END AS first FROM found"""

QUERIES |= {
    f.__name__: f
    for f in (h1_dedup, markdown_clean, extract_pages, to_markdown, openapi_schema, page_outcomes, toc, single_page_doc, combined_doc, index_doc, link_targets, link_rewrite, pattern_selectors)
}
