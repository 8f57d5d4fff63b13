"""The HTTP connector, sitemap trees, live crawls and the command line against a small server."""

from __future__ import annotations

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from folio.sources import config, http
from folio.sources.urls import parse_skip_list, read_lines

PAGE = "<html><title>{0} | Site</title><body><nav><a href='/docs/a'>a</a></nav><article><h1>{0}</h1><p>" + "word " * 60 + "</p>{1}</article></body></html>"


@pytest.fixture
def site():
    """/docs links to a and b, b to c; c answers 429 once; /docs/gone is listed but not there."""
    seen = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            host = f"http://{self.headers['Host']}"
            seen[self.path] += 1
            loc = lambda *paths: "".join(f"<url><loc> {host}{p} </loc><priority>0</priority></url>" for p in paths)
            pages = {
                "/robots.txt": f"User-agent: *\nSitemap: {host}/index.xml\n",
                "/index.xml": f"<sitemapindex><sitemap><loc>{host}/one.xml</loc></sitemap><sitemap><loc>{host}/two.xml</loc></sitemap><sitemap><loc>{host}/index.xml</loc></sitemap></sitemapindex>",
                "/one.xml": f"<urlset>{loc('/docs/b', '/docs/gone')}</urlset>",
                "/two.xml": f"<urlset>{loc('/docs/a', '/docs/b', '/docs/c', '/img.png')}</urlset>",
                "/docs": PAGE.format("Home", "<a href='/docs/b'>b</a><a href='http://other.example/docs'>o</a>"),
                "/docs/a": PAGE.format("A", ""),
                "/docs/b": PAGE.format("B", "<a href='c#x'>c</a><a href='/img.png'>i</a>"),
                "/docs/c": PAGE.format("C", ""),
            }
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/docs/a")
                self.end_headers()
                return
            once = self.path == "/docs/c" and seen[self.path] == 1
            self.send_response(429 if once else 200 if self.path in pages else 404)
            if once:
                self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(pages.get(self.path, "nothing").encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def settings(base, **discovery):
    rate = config.RateLimit(max_concurrent=2, delay_seconds=0.01, max_retries=2, retry_base_delay=0.1)
    return config.Settings(base, discovery=config.Discovery(**discovery), rate_limit=rate)


def test_get(site):
    found = http.http_get(f"{site}/moved")
    assert (found.final_url, found.status_code, found.success) == (f"{site}/docs/a", 200, True)
    found = http.http_get(f"{site}/none")
    assert (found.status_code, found.html, found.error, found.retryable) == (404, "nothing", None, False)
    found = http.http_get(f"{site}/docs/c")
    assert (found.status_code, found.retry_after, found.retryable) == (429, 0.0, True)
    found = http.http_get("http://127.0.0.1:1/")
    assert found.status_code == 0 and found.error and found.retryable
    assert http.http_get("no url").error


def test_fetch_retries_and_refuses_browsers(spark, site):
    urls = spark.createDataFrame([(f"{site}/docs/{x}",) for x in ("a", "c", "gone")], "url string")
    got = {r.url[-1]: (r.status_code, r.attempts) for r in http.fetcher(settings(site))(urls).collect()}
    assert got == {"a": (200, 1), "c": (200, 2), "e": (404, 1)}
    assert http.fetcher(settings(site))(urls.limit(0)).count() == 0
    with pytest.raises(NotImplementedError):
        http.fetcher(config.Settings(site, fetcher=config.Fetch(use_js=True)))


def test_sitemap_tree(spark, site):
    own = settings(site)
    rows = http.discoverer("sitemap")(spark, own, http.fetcher(own)).orderBy("pos").collect()
    assert [r.url[len(site) :] for r in rows] == ["/docs/b", "/docs/gone", "/docs/a", "/docs/b", "/docs/c", "/img.png"]
    assert {r.priority for r in rows} == {0.5}


def test_sitemap_tree_without_any(spark):
    nothing = lambda found: spark.createDataFrame([], http.SCHEMA)
    assert http.sitemap_tree(spark, "http://h.example/docs", nothing).count() == 0


def test_crawl_live(spark, site):
    own = settings(f"{site}/docs", mode="crawl", max_depth=2)
    rows = http.discoverer("crawl")(spark, own, http.fetcher(own)).orderBy("depth", "pos").collect()
    assert [(r.url[len(site) :], r.depth) for r in rows] == [("/docs", 0), ("/docs/a", 1), ("/docs/b", 1), ("/docs/c", 2)]


def test_probe(spark, site):
    asked = []

    def fetch(found):
        asked.extend(r.url for r in found.select("url").collect())
        return http.http_fetch(settings(site))(found)

    probed = http.probe(spark, f"{site}/docs", fetch)
    row = probed.first()
    assert (row.final_url, row.trailing_slash, row.pattern, row.needs_js) == (f"{site}/docs", False, None, False)
    assert row.length == len(row.html) > 300
    found = spark.createDataFrame([(f"{site}/docs",), (f"{site}/docs/a",)], "url string")
    assert {r.url: r.status_code for r in http.reusing(fetch, probed)(found).collect()} == {f"{site}/docs": 200, f"{site}/docs/a": 200}
    assert asked == [f"{site}/docs", f"{site}/docs/a"]
    with pytest.raises(RuntimeError, match="HTTP 404"):
        http.probe(spark, f"{site}/none", fetch)


def test_manual_needs_a_file(spark):
    with pytest.raises(ValueError, match="file of URLs"):
        http.discoverer("manual")(spark, settings("http://h"), None)


def test_command_line_fetches(spark, site, tmp_path, capsys):
    from folio.__main__ import main

    main(["extract", f"{site}/docs", "--delay", "0.01", "-o", f"{tmp_path}/all.md"])
    out = capsys.readouterr().out
    assert "pages: 3\nerrors: 1" in out and "method css_selector: 3" in out and "error client_error: 1" in out
    assert "](#a)" in (tmp_path / "all.md").read_text()
    failed = tmp_path / ".failed-urls.txt"
    lines = failed.read_text().splitlines()
    assert [x[:1] for x in lines[:2]] == ["#", "#"] and lines[2:] == [f"{site}/docs/gone"]
    assert [r.url for r in parse_skip_list(read_lines(spark, str(failed))).collect()] == [f"{site}/docs/gone"]
    (tmp_path / "list.txt").write_text(f"# some\n{site}/docs/a\n{site}/docs/gone\n")
    main(["extract", f"{site}/docs", "-d", "manual", "-f", f"{tmp_path}/list.txt", "--skip-urls", str(failed), "--delay", "0.01", "-o", f"{tmp_path}/two.md"])
    assert "pages: 1\nerrors: 0" in capsys.readouterr().out
