"""Column expressions against plain Python, and the operators over sets of URLs, links and files."""

from __future__ import annotations

import json
from datetime import datetime
from urllib.parse import urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from folio.functions import text, urls
from folio.operators import documents, links, summary, urlset
from folio.sources import config, fetch, http
from folio.sources import urls as sources

URLS = [
    "http://h", "http://h/", "http://h/a/", "http://H:80/A/b//?q=1#f", "https://u@h/a b|c?x#", "mailto:x@y", "//h/p", "/rel/x.html#t",
    "http://h/a/../../b", "http://h/x.PNG", "http://h/static/x", "http://h/a.html", "http://h/Category/x", "HTTP://h/é/ü?#", "", "#only", "?q",
]


def column(spark, values, make):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.select(make(F.col("v")).alias("out"), "k").orderBy("k").collect()]


def normalized(url):
    p = urlparse(url)
    path = p.path if p.path == "/" else p.path.rstrip("/")
    return urlunparse((p.scheme, p.netloc, path, p.params, p.query, ""))


def test_normalize_is_the_parsers_and_idempotent(spark):
    got = column(spark, URLS, urls.normalize)
    assert got == [normalized(u) for u in URLS]
    assert column(spark, got, urls.normalize) == got


def test_output_paths(spark):
    assert column(spark, ["http://h/", "http://h/a/b.html", "http://h/a.php.html", "http://h/../../etc/x", "http://h/a:b*.md", "http://h/a/../b"], urls.output_path) == [
        "index.md", "a/b.md", "a.md", "____etc_x.md", "a_b_.md", "b.md",
    ]


def test_titles(spark):
    assert column(spark, ["Page | Site", "a-b", "x – y — z", "plain", " t  - s "], text.clean_title) == ["Page", "a", "x – y", "plain", "t"]
    assert column(spark, ["Hello, World!  x", "Ünï_cödé-9"], text.anchor) == ["hello-world-x", "ünï_cödé-9"]
    assert column(spark, ["https://docs.my-site.io/x", "http://www.help.a1b.com", "http://localhost"], urls.site_name) == ["My-Site Documentation", "A1B Documentation", "Localhost Documentation"]
    assert column(spark, ["https://developer.acme.io/x"], urls.index_site_name) == ["Acme Documentation"]


@pytest.mark.parametrize(
    ("given", "clean"),
    [
        ("a​b \U0001f4c1️c", "ab c"),
        ("[ ](http://x) t", "t"),
        ("- [ ] task", "- [] task"),
        ("x    y\n    code", "x y\n  code"),
        ("a\n\n\n\nb", "a\n\nb"),
        ("[a](b)word", "[a](b) word"),
        ("##\n\nHead", "## Head"),
        ("# T\n\nT\n# T\n## T\n# U", "# T\n\n## T\n# U"),
        ("", ""),
    ],
)
def test_clean_markdown(spark, given, clean):
    assert column(spark, [given], text.clean_markdown) == [clean]


def test_gates(spark):
    assert column(spark, ["Please sign in" + "x" * 485, "Please sign in" + "x" * 486, None], text.is_login_gate) == [True, False, False]
    mostly = "# h\n" + "- [a](b)\n" * 7 + "text\n" * 3
    assert column(spark, [mostly, mostly + "- **[a](b)**", "# h\n---\n"], text.is_category_page) == [False, True, False]


def test_versions(spark):
    df = spark.createDataFrame([("http://h/api/V2/x", ""), ("http://h/api/1.0/", ""), ("http://h", "see public_api/v7/"), ("http://h", "no")], "u string, m string")
    assert [r[0] for r in df.select(text.api_version(F.col("u"), F.col("m"))).collect()] == ["vV2", "v1.0", "v7", None]


def test_sizes_at_halves_go_to_the_even_digit(spark):
    sizes = [0, 1023, 1024, 1280, 1792, 2304, 12544, 1048575, 2**20, 5 * 2**18, 7 * 2**18, 2**20 + 2**18 + 1, 943 * 2**20 + 2**18, 2**31, 2**50 + 2**18]
    want = [f"{n} B" if n < 1024 else f"{n / 1024:.1f} KB" if n < 2**20 else f"{n / 2**20:.1f} MB" for n in sizes]
    assert column(spark, map(str, sizes), lambda v: text.format_size(v.cast("long"))) == want
    assert column(spark, ["x" * 1280], lambda v: text.format_size(F.length(v))) == ["1.2 KB"]


def test_url_sets(spark):
    found = spark.createDataFrame([(0, "http://h/a/"), (1, "http://h/a#x"), (2, "http://h/b.png"), (3, "http://h/c"), (4, "http://h/d")], "pos int, url string")
    skip = spark.createDataFrame([("http://h/c/",)], "url string")
    assert [r.url for r in urlset.discovered(found, skip).orderBy("pos").collect()] == ["http://h/a/", "http://h/d"]
    assert [r.url for r in urlset.discovered(found, skip, max_pages=3).orderBy("pos").collect()] == ["http://h/a/"]
    scoped = found.select(urls.should_include(F.col("url"), "http://h/a", None, None).alias("x")).collect()
    assert [r.x for r in scoped] == [True, True, False, False, False]


def test_crawl_goes_by_levels(spark):
    pairs = [("a", 0, "b"), ("a", 1, "c"), ("b", 0, "d"), ("c", 0, "d"), ("d", 0, "a"), ("d", 1, "e"), ("c", 1, "x.png"), ("b", 1, "//else/q")]
    at = lambda x: f"http:{x}" if x.startswith("//") else f"http://h/{x}"
    edges = spark.createDataFrame([(at(s), p, at(d)) for s, p, d in pairs], "src string, pos int, dst string")
    got = {r.url[-1]: r.depth for r in links.crawl(edges, "http://h/a", 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.url[-1] for r in links.crawl(edges, "http://h/a", 3, exclude="/b$").collect()} == {"a", "c", "d", "e"}
    assert [r.url[-1] for r in links.crawl(edges, "http://h/a", 3, max_pages=2).orderBy("depth").collect()] == ["a", "b"]


def test_links_are_rewritten(spark):
    body = "[n](../b/two.html#s) [self](#x) [away](http://e/q) ![i](/a/one) [gone](/none)"
    pages = spark.createDataFrame([("http://h/a/one", 1, body), ("http://h/b/two", 2, "")], "url string, pos int, markdown string")
    got = {r.url: r.body for r in links.rewrite_links(pages).collect()}
    assert got["http://h/a/one"] == "[n](../b/two.md#s) [self](#x) [away](http://e/q) ![i](one.md) [gone](/none)"


def test_links_of_equal_urls_are_given_once(spark):
    rows = [("http://h/a", k, "[own](http://h/a) [other](b)") for k in (1, 2)] + [("http://h/b", 3, "")]
    pages = spark.createDataFrame(rows, "url string, pos int, markdown string")
    assert sorted((r.url, r.href, r.target) for r in links.link_targets(pages).collect()) == [("http://h/a", "b", "b.md"), ("http://h/a", "http://h/a", "a.md")]
    assert [r.body for r in links.rewrite_links(pages).where("pos < 3").collect()] == ["[own](a.md) [other](b.md)"] * 2


def test_equal_urls_are_numbered_by_page(spark):
    rows = [(k, f"http://h/{k % 3}", f"t{k:02}") for k in range(60)]
    want = {title: pos for pos, (_, title) in enumerate(sorted((url, title) for _, url, title in rows), 1)}
    for seed in (1, 2):
        pages = spark.createDataFrame(rows, "page_id long, url string, title string").repartition(7).orderBy(F.rand(seed))
        assert {r.title: r.pos for r in documents.ordered(pages).collect()} == want
        assert {r.title: r.pos for r in documents.ordered(pages.drop("page_id")).collect()} == want


def test_combined_document_and_site_files(spark, tmp_path):
    rows = [("http://h/b", None, "text", None), ("http://h/a", "A", "# A\nbody", "v1")]
    pages = documents.ordered(spark.createDataFrame(rows, "url string, title string, markdown string, api_version string"))
    at = datetime(2024, 1, 2)
    path = documents.write_single(documents.combined_blocks(pages, "http://docs.acme.io", at), f"file://{tmp_path}/all.txt", "section", "pos")
    assert path.endswith("all.md")
    assert (tmp_path / "all.md").read_text() == (
        "# Acme Documentation\n\n> Documentation extracted from http://docs.acme.io\n> Extracted on: 2024-01-02T00:00:00\n> Total pages: 2\n\n"
        "## Table of Contents\n\n- [A](#a)\n- [Page 2](#page-2)\n\n---\n\n"
        "<!-- Page: http://h/a | api_version: v1 -->\n# A\nbody\n\n---\n\n<!-- Page: http://h/b -->\ntext\n\n---\n\n"
    )
    documents.write_site(pages, str(tmp_path / "site"), "http://docs.acme.io", at)
    assert (tmp_path / "site/a.md").read_text().startswith("---\nsource: http://h/a\ntitle: A\napi_version: v1\n---\n\n# A")
    assert (tmp_path / "site/index.md").read_text().endswith("## Pages\n\n- [A](a.md)\n- [b.md](b.md)\n\n")
    assert documents.output_size(spark, f"file://{tmp_path}/site")[0] == 3


def test_lists_and_sitemap_fallback(spark, tmp_path):
    lines = spark.createDataFrame([(0, " http://h/a/ "), (1, ""), (2, "# c"), (3, "  # d")], "pos long, line string")
    assert [r.url for r in sources.parse_list(lines).collect()] == ["http://h/a/"]
    assert [r.url for r in sources.parse_skip_list(lines).collect()] == ["http://h/a", ""]
    (tmp_path / "sitemap.xml").write_text("<urlset><url><loc>http://h/z</loc></url></urlset>")
    docs = sources.first_readable(spark, [f"{tmp_path}/none.xml", f"{tmp_path}/sitemap.xml"])
    assert [r.url for r in sources.parse_sitemaps(docs).collect()] == ["http://h/z"]
    assert sources.fallback_sitemaps("https://h:1/x")[0] == "https://h:1/sitemap.xml"
    with pytest.raises(ValueError, match="unknown"):
        http.discoverer("rss")


def test_settings_round_trip(tmp_path):
    made = config.Settings("http://h", pattern="sphinx", discovery=config.Discovery(mode="crawl", include='a"b'), output=config.Output(mode="multi"))
    made.save_toml(str(tmp_path / "c.toml"))
    assert config.Settings.from_toml(str(tmp_path / "c.toml")) == made
    with pytest.raises(ValueError, match="max_depth"):
        config.Discovery(max_depth=11)


def test_fetch_connector(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text("\n".join(json.dumps(x) for x in [{"url": "http://a", "html": "x", "status_code": 200}, {"url": "http://b", "error": "timeout"}]))
    got = {r.url: r for r in fetch.read_fetched(spark, str(tmp_path / "f.jsonl"), 3).collect()}
    assert got["http://a"].status_code == 200 and got["http://b"].error == "timeout"
    tries = iter([fetch.Fetched("u", "u", status_code=503), fetch.Fetched("u", "u", status_code=429, retry_after=90.0), fetch.Fetched("u", "u", status_code=200)])
    waits = []
    assert fetch.with_retries(lambda _: next(tries), "u", wait=waits.append).attempts == 3
    assert 1 <= waits[0] <= 1.5 and waits[1] == 60
    assert fetch.retry_after_seconds("Wed, 21 Oct 2015 07:28:00 GMT", 1445412470.0) == 10 and fetch.retry_after_seconds("x", 0) is None
    pacer = fetch.Pacer(2.0)
    pacer.back_off(), pacer.back_off(), pacer.ease_off()
    assert (pacer.delay, pacer.peak, pacer.backoffs) == (2.5, 5.0, 2)


def test_site_plan(spark):
    from folio.plans.site import SitePlan

    good = "<title>Page | Site</title><article><h1>Page</h1><p>" + "word " * 60 + "</p></article>"
    rows = [
        ("http://h/a", "http://h/final", good, 200, None),
        ("http://h/category/x", "", good, 200, None),
        ("http://h/c", "", "", 429, None),
        ("http://h/d", "", "", 0, "Connection refused"),
        ("http://h/e", "", "<article>" + "please log in " * 9 + "</article>", 200, None),
    ]
    fetched = spark.createDataFrame(rows, "url string, final_url string, html string, status_code int, error string")
    got = {r.url: (r.status, r.reason, r.title) for r in SitePlan(config.Settings("http://h")).plan(fetched).collect()}
    assert got["http://h/final"] == ("done", None, "Page")
    assert got["http://h/category/x"][:2] == ("skipped", "category url")
    assert got["http://h/c"][:2] == ("error", "rate_limited") and got["http://h/d"][:2] == ("error", "connection")
    assert got["http://h/e"][:2] == ("skipped", "login gate")


def test_stream_gives_each_page_once(spark, tmp_path):
    from folio.streaming import pages as stream

    html = "<title>T</title><article>" + "word " * 60 + "</article>"
    rows = [(k, f"http://h/{k % 2}#{k}", html, datetime(2024, 1, 1)) for k in range(4)]
    spark.createDataFrame(rows, "page_id long, url string, html string, ts timestamp").write.parquet(f"{tmp_path}/in")
    query = stream.write_pages(stream.stream_pages(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_report_edges(spark):
    empty = spark.createDataFrame([], "status string")
    assert summary.outcome_counts(empty).first().asDict() == {"pages": 0, "errors": 0, "skipped": 0, "total": 0}


def test_refining(spark):
    found = spark.createDataFrame([(0, "http://h/a"), (1, "http://h/b"), (2, "http://h/c")], "pos int, url string")
    assert [r.pos for r in urlset.refine(found, "[ab]$", "(", 1).collect()] == [0]
    assert urlset.refine(found, None, "/b$").count() == 2


def test_command_line(spark, tmp_path, capsys):
    from folio.__main__ import main

    page = "<title>T{0} | Site</title><article><p>" + "word " * 60 + '<a href="/docs/b">b</a></p></article>'
    rows = [{"url": f"http://docs.acme.io/docs/{x}", "final_url": "", "html": page.format(x), "status_code": 200} for x in ("a", "b", "c.png", "b/")]
    rows.append({"url": "http://docs.acme.io/docs/bad", "final_url": "", "html": "", "status_code": 500})
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "skip.txt").write_text("# none\n")
    given = ["extract", "http://docs.acme.io/docs", "--fetched", f"{tmp_path}/in.json", "--skip-urls", f"{tmp_path}/skip.txt"]
    main([*given, "-o", f"{tmp_path}/all.txt"])
    assert "pages: 2\nerrors: 1" in capsys.readouterr().out
    assert "- [Ta](#ta)\n- [Tb](#tb)" in (tmp_path / "all.md").read_text()
    main([*given, "-m", "multi", "-o", f"{tmp_path}/site"])
    assert "[b](b.md)" in (tmp_path / "site/docs/a.md").read_text()
    main(["list-patterns"])
    assert "vitepress" in capsys.readouterr().out
