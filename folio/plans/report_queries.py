"""Queries of the run report, over `events` as a run's page timings, and of sources over literal inputs.

An event is a page: its type says how the page ended, its value the seconds it took, its props how often it was tried.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import constants as C
from folio.functions import openapi, text
from folio.operators import pages as P
from folio.operators import patterns, summary
from folio.plans import sql as S
from folio.plans.page_queries import with_text
from folio.plans.url_queries import ROWS as _ROWS
from folio.plans.url_queries import read_pages, url_rows
from folio.sources import urls as sources

_TIMINGS = f"""timings AS (SELECT event_id AS pos, 'http://h.example/' || event_type || '/' || user_id AS url, ts, user_id,
  CASE WHEN event_type IN ('click', 'view') THEN 'done' WHEN event_type = 'error' THEN 'error' ELSE 'skipped' END AS status,
  CASE event_type WHEN 'click' THEN 'css_selector' WHEN 'view' THEN CASE WHEN user_id % 2 = 0 THEN 'trafilatura' ELSE 'readability' END ELSE '' END AS method,
  100.0::DOUBLE AS fetch_start, CASE WHEN user_id % 13 = 0 THEN 0.0 ELSE 100 + value END::DOUBLE AS fetch_end, 600.0::DOUBLE AS extract_start, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE 600 + value / 2 END::DOUBLE AS extract_end,
  900.0::DOUBLE AS convert_start, CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE 900 + value / 4 END::DOUBLE AS convert_end, (1 + event_id % 4)::INTEGER AS retry_attempts, [0, 429, 503, 404, 0, 0][user_id % 6 + 1] AS status_code,
  ['Timed out', 'x', 'x', 'x', 'Connection refused', 'odd'][user_id % 6 + 1] AS error FROM events)"""


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_type"), F.col("user_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id", "value", "ts")
    at = lambda start, part, never: F.when(u % never == 0, 0.0).otherwise(start + F.col("value") / part)
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (u % 6 + 1).cast("int"))
    return rows.select(
        F.col("event_id").alias("pos"),
        F.concat(F.lit("http://h.example/"), e, F.lit("/"), u.cast("string")).alias("url"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.when(e.isin("click", "view"), "done").when(e == "error", "error").otherwise("skipped").alias("status"),
        F.when(e == "click", "css_selector").when(e == "view", F.when(u % 2 == 0, "trafilatura").otherwise("readability")).otherwise("").alias("method"),
        F.lit(100.0).alias("fetch_start"),
        at(100, 1, 13).alias("fetch_end"),
        F.lit(600.0).alias("extract_start"),
        at(600, 2, 3).alias("extract_end"),
        F.lit(900.0).alias("convert_start"),
        at(900, 4, 5).alias("convert_end"),
        (1 + F.col("event_id") % 4).cast("int").alias("retry_attempts"),
        pick(0, 429, 503, 404, 0, 0).alias("status_code"),
        pick("Timed out", "x", "x", "x", "Connection refused", "odd").alias("error"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_TIMED = f"""{_TIMINGS}, timed AS (SELECT *, CASE WHEN fetch_end <> 0 THEN fetch_end - fetch_start ELSE 0 END AS fetch_s, CASE WHEN extract_end <> 0 THEN extract_end - extract_start ELSE 0 END AS extract_s,
  CASE WHEN convert_end <> 0 THEN convert_end - convert_start ELSE 0 END AS convert_s, coalesce(coalesce(nullif(convert_end, 0), nullif(extract_end, 0), nullif(fetch_end, 0)) - fetch_start, 0) AS total_s FROM timings)"""


@_query(f"WITH {_TIMINGS} SELECT count(*) FILTER (WHERE status = 'done') AS pages, count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) AS total FROM timings")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.outcome_counts(timings(spark, sf_dir))


@_query(f"WITH {_TIMED} SELECT pos, round(fetch_s, 6) AS fetch_s, round(extract_s, 6) AS extract_s, round(convert_s, 6) AS convert_s, round(total_s, 6) AS total_s FROM timed")
def derived_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.durations(timings(spark, sf_dir))
    return found.select("pos", *[F.round(c, 6).alias(c) for c in ("fetch_s", "extract_s", "convert_s", "total_s")])


@_query(
    f"WITH {_TIMED}, long AS (SELECT 'fetch' AS stage, fetch_s AS s FROM timed WHERE status = 'done' UNION ALL SELECT 'extract', extract_s FROM timed WHERE status = 'done' UNION ALL SELECT 'convert', convert_s FROM timed WHERE status = 'done') "
    "SELECT stage, count(*) AS pages, round(avg(s), 4) AS avg_s, round(sum(s), 3) AS sum_s FROM long WHERE s <> 0 GROUP BY stage"
)
def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.stage_timing(summary.durations(timings(spark, sf_dir)))
    return found.select("stage", "pages", F.round("avg_s", 4).alias("avg_s"), F.round("sum_s", 3).alias("sum_s"))


@_query(f"WITH {_TIMED} SELECT pos, url, round(total_s, 6) AS total_s FROM timed WHERE status = 'done' ORDER BY timed.total_s DESC, pos LIMIT 5")
def slowest5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.slowest(summary.durations(timings(spark, sf_dir))).select("pos", "url", F.round("total_s", 6).alias("total_s"))


@_query(f"WITH {_TIMINGS} SELECT method, count(*) AS n, min(pos) AS first_pos FROM timings WHERE status = 'done' AND method <> '' GROUP BY method")
def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.histogram(timings(spark, sf_dir).where("status = 'done'"), "method")


@_query(f"WITH {_TIMINGS} SELECT CASE WHEN p > 0 AND s > 0 THEN round(p / s, 9) END AS pages_per_second FROM (SELECT count(*) FILTER (WHERE status = 'done') AS p, epoch(max(ts)) - epoch(min(ts)) AS s FROM timings)")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros("ts")
    rows = timings(spark, sf_dir).agg(F.count_if(F.col("status") == "done").alias("p"), ((F.max(micros) - F.min(micros)) / F.lit(1e6)).alias("s"))
    return rows.select(F.round(summary.throughput(F.col("p"), F.col("s")), 9).alias("pages_per_second"))


@_query(
    f"WITH t AS (SELECT length({S.article_text('html')}) * (1 + page_id % 9) AS n FROM pages) SELECT count(*) AS pages, sum(n)::BIGINT AS total, count(*) FILTER (WHERE n < 1024) AS tiny, count(*) FILTER (WHERE n >= 1024 AND n < 5120) AS small, "
    "count(*) FILTER (WHERE n >= 5120 AND n < 20480) AS normal, count(*) FILTER (WHERE n >= 20480) AS large, (sum(n) // count(*))::BIGINT AS average, count(*) FILTER (WHERE n < 1024) / count(*) > 0.3 AS warning FROM t"
)
def quality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_text(spark, sf_dir).select(F.repeat("body", (1 + F.col("page_id") % 9).cast("int")).alias("markdown"))
    return summary.quality(rows)


@_query(f"WITH {_TIMINGS} SELECT count(*) AS pages_retried, sum(retry_attempts - 1)::BIGINT AS total_retries, arg_max(url, retry_attempts * 1000000000::BIGINT - pos) AS most_retried FROM timings WHERE retry_attempts > 1")
def retry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.retries(timings(spark, sf_dir))


_CATEGORY = """CASE WHEN status_code = 429 THEN 'rate_limited' WHEN status_code >= 500 THEN 'server_error' WHEN status_code >= 400 THEN 'client_error' WHEN regexp_matches(lower(error), 'timeout|timed out') THEN 'timeout'
  WHEN regexp_matches(lower(error), 'connect|refused|dns|network|socket') THEN 'connection' WHEN pos % 2 = 0 THEN 'extraction' ELSE 'unknown' END"""


def _categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("pos") % 2 == 0, "extract").otherwise("fetch")
    return timings(spark, sf_dir).withColumn("category", text.error_category(F.col("status_code"), F.col("error"), stage))


@_query(f"WITH {_TIMINGS} SELECT pos, {_CATEGORY} AS category FROM timings")
def error_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categorised(spark, sf_dir).select("pos", "category")


_HINT = "CASE category " + " ".join(f"WHEN '{k}' THEN {S.quoted(v)}" for k, v in C.ERROR_HINTS.items()) + " END"


@_query(
    f"WITH {_TIMINGS}, c AS (SELECT category, count(*) AS n, min(pos) AS first_pos FROM (SELECT pos, status, {_CATEGORY} AS category FROM timings) WHERE status = 'error' GROUP BY category) "
    f"SELECT category, n, first_pos, CASE WHEN row_number() OVER (ORDER BY n DESC, first_pos) = 1 THEN {_HINT} END AS hint FROM c"
)
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.error_report(_categorised(spark, sf_dir).where("status = 'error'"))


@_query(f"WITH {_TIMINGS} SELECT pos, status_code = 429 OR status_code >= 500 OR (status_code = 0 AND pos % 3 <> 0) AS retryable FROM timings")
def retryable(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("pos") % 3 != 0, F.col("error"))
    return timings(spark, sf_dir).select("pos", text.is_retryable(F.col("status_code"), error).alias("retryable"))


@_query(f"WITH {_TIMINGS} SELECT pos, CASE pos % 4 WHEN 0 THEN greatest(user_id - 20, 0) WHEN 1 THEN 30.5 WHEN 2 THEN greatest(90 - user_id, 0) END::DOUBLE AS v FROM timings")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timings(spark, sf_dir).withColumn("ts", F.date_trunc("second", "ts"))
    until = F.date_format(F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, 90 - user_id)"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    k = F.col("pos") % 4
    header = F.when(k == 0, (F.col("user_id") - 20).cast("string")).when(k == 1, "30.5").when(k == 2, until).otherwise("soon")
    return rows.select("pos", text.retry_after(header, F.col("ts")).alias("v"))


@_query(f"WITH {_TIMINGS} SELECT pos, least(greatest(1.5 * 2 ** (retry_attempts - 1) + 0.25, user_id), 60)::DOUBLE AS wait_s FROM timings")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    wait = text.backoff_seconds((F.col("retry_attempts") - 1).cast("double"), F.lit(1.5), F.col("user_id").cast("double"), F.lit(0.25))
    return timings(spark, sf_dir).select("pos", wait.alias("wait_s"))


@_query(
    f"""WITH RECURSIVE {_TIMINGS}, o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS i, CASE WHEN pos % 3 = 0 THEN '429' ELSE status END AS s FROM timings),
walk(user_id, i, delay, peak, backoffs) AS (SELECT DISTINCT user_id, 0::BIGINT, 0.2::DOUBLE, 0.2::DOUBLE, 0::BIGINT FROM o
  UNION ALL SELECT w.user_id, o.i, d, greatest(peak, d), backoffs + CASE WHEN s = '429' THEN 1 ELSE 0 END FROM walk w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1,
  LATERAL (SELECT CASE s WHEN '429' THEN least(delay * 2, 5.0) WHEN 'done' THEN greatest(delay / 2, 0.2) ELSE delay END AS d))
SELECT user_id, arg_max(delay, i) AS delay, arg_max(peak, i) AS peak, arg_max(backoffs, i) AS backoffs FROM walk GROUP BY user_id"""
)
def adaptive_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events stand for one run's outcomes."""
    rows = timings(spark, sf_dir).select("user_id", "pos", F.when(F.col("pos") % 3 == 0, "429").otherwise(F.col("status")).alias("status"))
    return summary.adaptive_delay(rows, 0.2, ["user_id"])


@_query(f"WITH {_TIMINGS} SELECT url FROM timings WHERE status = 'error'")
def failed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timings(spark, sf_dir).where("status = 'error'").select("url")


# sources over literal inputs
_SITEMAPS = [
    ("a.xml", '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://h/a </loc><priority>0.8</priority></url><url><loc>http://h/b</loc><priority>0</priority></url><url><loc>http://h/c</loc><priority>high</priority></url><url><loc>http://h/d</loc></url></urlset>'),
    ("b.xml", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://h/e</loc><priority> 1.0 </priority></url></urlset>'),
    ("index.xml", '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>http://h/s.xml</loc></sitemap></sitemapindex>'),
    ("bad.xml", "<urlset><url><loc>http://h/x</lo"),
]


@_query("SELECT * FROM (VALUES ('a.xml', 0::BIGINT, 'http://h/a', 0.8::DOUBLE), ('a.xml', 1, 'http://h/b', 0.0), ('a.xml', 2, 'http://h/c', 0.5), ('a.xml', 3, 'http://h/d', 0.5), ('b.xml', 0, 'http://h/e', 1.0)) t(path, pos, url, priority)")
def sitemap_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame(_SITEMAPS, "path string, xml string")
    return sources.parse_sitemaps(docs).select("path", "pos", "url", "priority")


@_query("SELECT * FROM (VALUES ('http://h/a', 0.8::DOUBLE), ('http://h/b', 0.5), ('http://h/c', 0.5), ('http://h/d', 0.5), ('http://h/e', 1.0)) t(url, priority)")
def sitemap_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame(_SITEMAPS, "path string, xml string")
    return sources.parse_sitemaps(docs, tree=True).select("url", "priority")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs as lines: some padded, some comments, some indented comments, some blank."""
    k = F.col("pos") % 5
    line = F.when(k == 0, F.concat(F.lit("  "), "url", F.lit("\t"))).when(k == 1, F.concat(F.lit("# "), "url")).when(k == 2, F.concat(F.lit("  # "), "url")).when(k == 3, F.lit("   ")).otherwise(F.col("url"))
    return url_rows(spark, sf_dir).select("pos", line.alias("line"))


@_query(f"WITH {_ROWS} SELECT pos, url, 0.5::DOUBLE AS priority FROM urlset WHERE pos % 5 IN (0, 4)")
def manual_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.parse_list(_lines(spark, sf_dir)).select("pos", "url", "priority")


@_query(f"WITH {_ROWS} SELECT {S.normalize('CASE WHEN pos % 5 = 2 THEN ' + S.quoted('# ') + ' || url ELSE url END')} AS url FROM urlset WHERE pos % 5 IN (0, 2, 4)")
def skip_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.parse_skip_list(_lines(spark, sf_dir))


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{p.name}', {str(p.requires_js).lower()}, {len(p.content_selectors)}::BIGINT, {len(p.remove_selectors)}::BIGINT, {p.wait_time_ms}::INTEGER)" for p in patterns.KNOWN) + ") t(name, requires_js, content, remove, wait_time_ms)")
def list_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = patterns.PatternRegistry().table(spark)
    return table.select("name", "requires_js", F.size("content_selectors").cast("long").alias("content"), F.size("remove_selectors").cast("long").alias("remove"), "wait_time_ms")


_PIPED = "replace(p_name, ' ', '|')"


@_query(
    f"""WITH f AS (SELECT p_partkey, p_partkey % 4 AS n, p_size % 2 = 0 AS shown, p_size, '| `' || p_partkey || '` | ' || p_brand || ' | ' || replace({_PIPED}, '|', '\\|') || CASE WHEN p_size > 25 THEN ' **(required)**' ELSE '' END || ' |' AS one,
  '| `size` |  |  |' AS two, '| `kind` | string | ' || p_type || ' |' AS three FROM part)
SELECT p_partkey, CASE WHEN n = 0 THEN '' ELSE '| Field | Type | Description |' || CASE WHEN shown AND n > 1 THEN ' Example |' ELSE '' END || chr(10) || '|-------|------|-------------|' || CASE WHEN shown AND n > 1 THEN '---------|' ELSE '' END
  || chr(10) || one || CASE WHEN shown AND n > 1 THEN '  |' ELSE '' END || CASE WHEN n > 1 THEN chr(10) || two || CASE WHEN shown THEN ' `' || p_size || '\\|' || n || '` |' ELSE '' END ELSE '' END
  || CASE WHEN n > 2 THEN chr(10) || three || CASE WHEN shown THEN '  |' ELSE '' END ELSE '' END END AS markdown FROM f"""
)
def fields_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three fields of each part; every other part has an example."""
    part, n = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_partkey") % 4
    field = lambda *x: F.struct(*[c.alias(k) for c, k in zip(x, ("name", "type", "required", "description", "example"), strict=True)])
    none, no = F.lit(None).cast("string"), F.lit(False)
    fields = F.array(
        field(F.col("p_partkey").cast("string"), F.col("p_brand"), F.col("p_size") > 25, F.expr(_PIPED), none),
        field(F.lit("size"), F.lit(""), no, F.lit(""), F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("|"), n.cast("string")))),
        field(F.lit("kind"), F.lit("string"), no, F.col("p_type"), none),
    )
    return part.select("p_partkey", openapi.fields_table_of(F.slice(fields, F.lit(1), n.cast("int"))).alias("markdown"))


@_query(
    """SELECT page_id, unnest(list_filter(['- **Authorization URL:** ' || CASE WHEN page_id % 3 > 0 THEN url || '/auth' END, '- **Token URL:** ' || CASE WHEN page_id % 2 = 0 THEN url END,
  '- **Token URL:** ' || CASE WHEN page_id % 5 = 0 THEN 'http://other/' || page_id END], lambda x: x IS NOT NULL)) AS line FROM pages WHERE page_id % 7 > 0"""
)
def oauth_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two flows for each page, with some of their URLs; every seventh text is no JSON."""
    n, none = F.col("page_id"), F.lit(None).cast("string")
    own = F.struct(F.when(n % 3 > 0, F.concat("url", F.lit("/auth"))).otherwise(none).alias("authorizationUrl"), F.when(n % 2 == 0, F.col("url")).alias("tokenUrl"), F.lit("x").alias("scope"))
    other = F.struct(F.when(n % 5 == 0, F.concat(F.lit("http://other/"), n.cast("string"))).alias("tokenUrl"))
    flows = F.when(n % 7 > 0, F.to_json(F.struct(own.alias("authorizationCode"), other.alias("password")))).otherwise("flows: none")
    return read_pages(spark, sf_dir).select("page_id", F.explode(openapi.oauth_lines_of(flows)).alias("line"))


def _templated(part: DataFrame, template: str) -> Column:
    """The template with each $column of the table in its place; $$ is a line end."""
    pieces = re.split(r"(\$\w+|\$\$)", template)
    return F.concat(*[F.lit("\n") if x == "$$" else F.col(x[1:]).cast("string") if x[:1] == "$" else F.lit(x) for x in pieces if x])


def _rendered(part: DataFrame, template: str) -> DataFrame:
    """(p_partkey, html): the parts are spread, not their pages, which are a hundred times as long."""
    return P.spread(part.select("p_partkey", "p_brand", "p_type", "p_size")).select("p_partkey", _templated(part, template).alias("html"))


def _templated_sql(template: str) -> str:
    pieces = re.split(r"(\$\w+|\$\$)", template)
    return " || ".join("chr(10)" if x == "$$" else x[1:] if x[:1] == "$" else S.quoted(x) for x in pieces if x)


_PAGE = """<h2>Part $p_partkey</h2><script>no()</script><p>Of <b>$p_brand</b>, <i>kind</i> <a href="/t/$p_size">$p_type</a>.</p><ul><li>size $p_size<li>last</ul><ol><li>one<li>two</ol><blockquote><p>said</p></blockquote>
<pre><code class="language-python">x = $p_size$$y = 2</code></pre><p>run <code>go $p_partkey</code></p><table><tr><th>key<th>size</tr><tr><td>$p_partkey<td>$p_size|<ul><li>x<li>y</ul></tr><tr><td>a|b<td>c</tr></table><svg><title>no</title></svg><img src="i$p_size.png" alt="$p_brand"><a href="/c"><h3>Card $p_size</h3><p>about</p></a>"""
_MARKDOWN = """## Part $p_partkey$$$$Of **$p_brand**, *kind* [$p_type](/t/$p_size).$$$$- size $p_size$$- last$$$$1. one$$2. two$$$$> said$$$$```python$$x = $p_size$$y = 2$$```$$$$run `go $p_partkey`$$$$| key | size |$$| --- | --- |$$| $p_partkey | - x<br>- y |$$| a\\|b | c |$$$$![$p_brand](i$p_size.png)$$- **[Card $p_size](/c)** - about"""
_API_PAGE = """<h1 class="openapi__heading">Get $p_partkey</h1><pre class="openapi__method-endpoint"><span class="badge">get</span><h2>/parts/$p_partkey</h2></pre><p>Gives one $p_brand.</p><p>short</p>
<details class="openapi-markdown__details response"><summary>Schema</summary><ul><li class="openapi-schema__list-item"><strong class="openapi-schema__property">size</strong><span class="openapi-schema__name">integer</span><span class="openapi-schema__required">required</span><p>about $p_size|</p></li>
<li class="openapi-schema__list-item"><strong class="openapi-schema__property">box$p_size</strong><p>Holds</p><ul><li class="openapi-schema__list-item"><strong class="openapi-schema__property">in</strong><p>$p_type</p><strong>Example:</strong> <code>$p_size</code></li></ul></li></ul></details>
<div role="tabpanel"><div class="openapi-schema__list-item"><strong class="openapi-schema__property">other$p_partkey</strong></div></div>
<div class="openapi-security__details"><div class="openapi-security__summary-header">Auth: $p_brand</div><pre><span><strong>name:</strong> key$p_size</span></pre></div><div class="openapi-tabs__code-container"><div data-tab-label="requests"><code>get($p_partkey)</code></div></div>"""
_API_MARKDOWN = """# Get $p_partkey$$$$**GET** `/parts/$p_partkey`$$$$Gives one $p_brand.$$$$## Response Schema$$$$| Field | Type | Description | Example |$$|-------|------|-------------|---------|$$| `size` | integer | about $p_size\\| **(required)** |  |$$| `box$p_size` | object | Holds | `$p_size` |$$$$### box$p_size object$$$$| Field | Type | Description | Example |$$|-------|------|-------------|---------|$$| `in` |  | $p_type | `$p_size` |$$$$## Response Schema$$$$| Field | Type | Description |$$|-------|------|-------------|$$| `other$p_partkey` |  |  |$$$$## Authorization$$$$**Auth: $p_brand**$$$$- **name:** key$p_size$$$$## Example$$$$```python$$get($p_partkey)$$```$$$$"""


@_query(f"SELECT p_partkey, {_templated_sql(_MARKDOWN)} AS markdown FROM part")
def markdown_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of each part with one of every element that has a rule of its own."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return _rendered(part, _PAGE).select("p_partkey", P.markdown_of("html").alias("markdown"))


@_query(f"SELECT p_partkey, 'Get ' || p_partkey AS title, {_templated_sql(_API_MARKDOWN)} AS markdown FROM part")
def openapi_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An API page of each part: endpoint, sections, an object, a panel, authorization and a captured tab."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    found = _rendered(part, _API_PAGE).select("p_partkey", P.openapi_of("html").alias("s"))
    return found.select("p_partkey", "s.title", "s.markdown")
