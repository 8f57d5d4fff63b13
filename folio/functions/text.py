"""Markdown and page text as column expressions.

Python's notions are spelt out for Java's regular expressions: `(?U)` makes \\s and \\w Unicode, `(?d)` makes \\n the only
line end, and U+001C to U+001F are white space as well.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import constants as C
from folio.functions.urls import let

_WS = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_WS}+|{_WS}+\z", "")


def clean_title(title: Column) -> Column:
    """Without the last separator and what follows it."""
    return strip(F.regexp_replace(title, rf"(?Ud){_WS}*[|–—\-]{_WS}*[^|–—\-]+$", ""))


def anchor(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f-]", ""), rf"(?U){_WS}+", "-")


def _h1(line: Column) -> Column:
    """The line's H1 title, else null."""
    return F.when(strip(line).startswith("# "), strip(F.substring(strip(line), 3, 2**31 - 1)))


def dedup_h1(markdown: Column) -> Column:
    """Lines that repeat the first H1, as heading or as text, go."""

    def kept(lines: Column, at: Column) -> Column:
        title = F.get(lines, (at - 1).cast("int"))["t"]
        # before the first H1 nothing goes; a body line goes only if the title isn't empty
        keep = lambda t: F.filter(lines, lambda x, i: (at == 0) | (i < at) | ~F.coalesce(x["t"], F.when(t != "", strip(x["x"]))).eqNullSafe(t))
        return F.array_join(F.transform(let(title, keep), lambda x: x["x"]), "\n")

    titled = F.transform(F.split(markdown, "\n", -1), lambda x: F.struct(x.alias("x"), _h1(x).alias("t")))
    first = lambda lines: F.array_position(F.transform(lines, lambda x: x["t"].isNotNull()), True)
    return let(titled, lambda lines: let(first(lines), lambda at: kept(lines, at)))


def clean_markdown(markdown: Column) -> Column:
    steps = [
        (r"[​‌‍﻿]", ""),
        (r"[\x{1F300}-\x{1F9FF}]\x{FE0F}?", ""),
        (rf"(?U)\[{_WS}*\]\([^)]+\)", ""),
        (rf"(?U)\[{_WS}+", "["),
        (r"([^\n]) {2,}", "$1 "),
        (r"\n{3,}", "\n\n"),
        (r"(\])\(([^)]*)\)([\p{L}\p{N}_])", "$1($2) $3"),
        (rf"(?U)(^|\n)(#{{1,6}}){_WS}*\n+", "$1$2 "),
    ]
    for pattern, new in steps:
        markdown = F.regexp_replace(markdown, pattern, new)
    return strip(dedup_h1(markdown))


def api_version(url: Column, markdown: Column) -> Column:
    """From the URL, else from the text; null where neither has one."""
    own = F.regexp_extract(url, r"(?i)/api/(v?\d+(?:\.\d+)?)/", 1)
    own = F.when(own.startswith("v"), own).otherwise(F.concat(F.lit("v"), own))
    found = F.regexp_extract(markdown, r"(?i)(?:public_api|/api)/(v\d+)/", 1)
    return F.when(url.rlike(r"(?i)/api/(v?\d+(?:\.\d+)?)/"), own).when(found != "", found)


def is_api_page(url: Column, html: Column) -> Column:
    return url.rlike(r"(?i)/docs/api/|/api-reference/|/api/v\d+/|/reference/") & F.coalesce(html.contains("openapi-schema__property"), F.lit(False))


def _contains_any(text: Column, options: list[str]) -> Column:
    return text.rlike("|".join(re.escape(o) for o in options))


def pattern_name(url: Column, html: Column) -> Column:
    """The site framework, by the first test that holds; null for none."""
    u, page = F.lower(url), F.coalesce(html, F.lit(""))
    low = F.lower(page)
    docusaurus = low.contains("docusaurus")
    return (
        F.when(u.contains("readthedocs") | u.contains(".rtfd."), "readthedocs")
        .when(docusaurus & _contains_any(page, C.OPENAPI_MARKERS), "docusaurus-openapi")
        .when(docusaurus, "docusaurus")
        .when(low.contains("gitbook") | page.contains('data-testid="page.'), "gitbook")
        .when(low.contains("mkdocs") | page.contains("md-content"), "mkdocs")
        .when(low.contains("sphinx"), "sphinx")
        .when(low.contains("vitepress") | page.contains("vp-doc"), "vitepress")
    )


def needs_js(html: Column) -> Column:
    return _contains_any(html, C.JS_MARKERS)


def is_crash(html: Column) -> Column:
    return html.contains(C.CRASH_MARKER)


def is_category_page(markdown: Column) -> Column:
    """Over 70 % of the lines that are no headings, rules or blanks are list items of one link."""
    lines = F.filter(F.transform(F.split(markdown, "\n", -1), strip), lambda x: (x != "") & ~x.startswith("#") & (x != "---"))
    links = lambda x: x.rlike(r"(?Ud)^[-*][\s\x1c-\x1f]+(\*\*)?(\[.+?\]\(.+?\))(\*\*)?[\s\x1c-\x1f]*$")
    return let(lines, lambda found: (F.size(found) > 0) & (10 * F.size(F.filter(found, links)) > 7 * F.size(found)))


def is_login_gate(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    return (F.length(body) < C.LOGIN_LENGTH) & _contains_any(F.lower(body), C.LOGIN_PHRASES)


def error_category(status: Column, message: Column, stage: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(status == 429, "rate_limited")
        .when(status >= 500, "server_error")
        .when(status >= 400, "client_error")
        .when(low.rlike("timeout|timed out"), "timeout")
        .when(low.rlike("connect|refused|dns|network|socket"), "connection")
        .when(stage.isin("extract", "pipeline"), "extraction")
        .otherwise("unknown")
    )


def is_retryable(status: Column, error: Column) -> Column:
    return (status == 429) | (status >= 500) | ((status == 0) & F.coalesce(error != "", F.lit(False)))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds from a number or an HTTP date, at least 0; null for anything else."""
    own = header.try_cast("double")
    date = F.try_to_timestamp(F.regexp_extract(header, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    until = (F.unix_micros(date) - F.unix_micros(now)) / F.lit(1e6)
    found = F.coalesce(own, until)
    return F.when(found.isNotNull(), F.greatest(found, F.lit(0.0)))


def backoff_seconds(attempt: Column, base: Column, header_seconds: Column, jitter: Column) -> Column:
    """base * 2^attempt + jitter, no less than what the server asks for, 60 at most."""
    return F.least(F.greatest(base * F.pow(F.lit(2.0), attempt) + jitter, F.coalesce(header_seconds, F.lit(0.0))), F.lit(60.0))


def _tenths(size: Column, bits: int) -> Column:
    """size / 2^bits to one decimal, halves to the even digit as C's printf has it; Java's takes them up."""
    rest = size % 2**bits
    return (F.shiftright(size, bits) * 10 + F.rint(rest * 10 / 2**bits)) / 10


def format_size(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.format_string("%.1f KB", _tenths(size, 10)))
        .otherwise(F.format_string("%.1f MB", _tenths(size, 20)))
    )


def size_bucket(size: Column) -> Column:
    return F.when(size < 1024, "tiny").when(size < 5120, "small").when(size < 20480, "normal").otherwise("large")


def page_document(url: Column, title: Column, version: Column, markdown: Column, metadata: bool = True) -> Column:
    """A page's own document: front matter, H1 unless some line has it, text."""
    some = lambda c: c.isNotNull() & (c != "")
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("source: "), url), F.when(some(title), F.concat(F.lit("title: "), title)), F.when(some(version), F.concat(F.lit("api_version: "), version)), F.lit("---"), F.lit(""))
    has = F.exists(F.split(markdown, "\n", -1), lambda x: _h1(x).eqNullSafe(title))
    h1 = F.when(some(title) & ~has, F.concat(F.lit("# "), title, F.lit("\n")))
    return F.concat_ws("\n", head if metadata else F.lit(None), h1, markdown)


def page_block(url: Column, title: Column, version: Column, markdown: Column) -> Column:
    """A page's part of the combined document."""
    some = lambda c: c.isNotNull() & (c != "")
    mark = F.concat(F.lit("<!-- Page: "), url, F.when(some(version), F.concat(F.lit(" | api_version: "), version)).otherwise(""), F.lit(" -->"))
    first = strip(F.element_at(F.split(F.regexp_replace(markdown, rf"(?U)^{_WS}+", ""), "\n", -1), 1))
    h1 = F.when(some(title) & (first != F.concat(F.lit("# "), title)), F.concat(F.lit("# "), title, F.lit("\n")))
    return F.concat_ws("\n", mark, h1, markdown, F.lit(""), F.lit("---"), F.lit(""))


