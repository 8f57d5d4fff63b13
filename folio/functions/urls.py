"""URLs as column expressions. Parts come from the generic syntax of RFC 3986, appendix B.

`parse_url` isn't used: it fails on blanks and bars, and its host has no port.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import constants as C

RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, RFC, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def _lead(part: Column, before: str = "", after: str = "") -> Column:
    return F.when(part != "", F.concat(F.lit(before), part, F.lit(after))).otherwise("")


def site(url: Column) -> Column:
    """Scheme and authority."""
    return F.concat(_lead(scheme(url), after=":"), _lead(authority(url), before="//"))


def normalize(url: Column) -> Column:
    """Without fragment and without slashes at the path's end, unless the path is one slash."""
    p = path(url)
    return F.concat(site(url), F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", "")), _lead(query(url), before="?"))


def base_domain(url: Column) -> Column:
    return F.lower(authority(url))


def same_domain(a: Column, b: Column) -> Column:
    return base_domain(a) == base_domain(b)


def _any(options: list[str]) -> str:
    return "|".join(re.escape(o).replace("/", "/") for o in options)


def is_doc(url: Column) -> Column:
    """No asset by the path's extension or directories."""
    p = F.lower(path(url))
    return ~p.rlike(rf"(?:{_any(C.ASSET_EXTENSIONS)})(?!\n)$") & ~p.rlike(_any(C.ASSET_DIRECTORIES))


def in_scope(url: Column, base: str) -> Column:
    """The path starts with the base URL's, character by character."""
    found = re.match(RFC, base)
    lead = found[3].rstrip("/") if found else ""
    return F.rtrim(path(url), F.lit("/")).startswith(lead) if lead else F.lit(True)


def should_include(url: Column, base: str = "", include: str | None = None, exclude: str | None = None) -> Column:
    """In the base's scope, not found by `exclude`, found by `include` (each a pattern, or None)."""
    ok = in_scope(url, base)
    if exclude:
        ok &= ~url.rlike(exclude)
    return ok & url.rlike(include) if include else ok


def is_category(url: Column) -> Column:
    return F.contains(F.lower(path(url)), F.lit("/category/"))


def _without_extensions(p: Column) -> Column:
    for ext in C.PAGE_EXTENSIONS:
        p = F.regexp_replace(p, re.escape(ext) + r"(?!\n)$", "")
    return p


def match_key(url: Column) -> Column:
    """By which links and pages meet: without query, fragment and page extension, in lower case."""
    p = _without_extensions(F.regexp_replace(path(url), "/+$", ""))
    return F.lower(F.concat(scheme(url), F.lit("://"), authority(url), p))


def _markdown_name(p: Column) -> Column:
    return F.when(p.endswith(".md"), p).otherwise(F.concat(p, F.lit(".md")))


def output_path(url: Column) -> Column:
    """The page's file below the output folder; paths that would leave it are flattened."""
    p = F.trim(path(url), F.lit("/"))
    p = _without_extensions(F.when(p == "", F.lit("index")).otherwise(p))
    p = _markdown_name(F.translate(p, ':?*<>|"', "_______"))
    # depth after each segment; below 0 is outside
    step = lambda acc, s: F.when(acc < 0, acc).when(s == "..", acc - 1).when(s.isin("", "."), acc).otherwise(acc + 1)
    walk = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    plain = lambda q: ~q.rlike(r"(^|/)\.{0,2}(/|$)")  # noqa: E731  most paths have no dots or empty segments to walk
    outside = lambda q: F.aggregate(F.split(q, "/"), F.lit(0), step) < 0
    flat = lambda q: F.replace(F.replace(q, F.lit(".."), F.lit("_")), F.lit("/"), F.lit("_"))
    inside = lambda q: F.array_join(F.aggregate(F.split(q, "/"), F.array().cast("array<string>"), walk), "/")
    return let(p, lambda q: F.when(plain(q), q).when(outside(q), flat(q)).otherwise(inside(q)))


def file_name(url: Column) -> Column:
    p = F.trim(path(url), F.lit("/"))
    p = F.when(p == "", F.lit("index")).otherwise(p)
    parts = F.filter(F.split(p, "/"), lambda s: ~s.isin("", ".."))
    return _markdown_name(F.regexp_replace(F.array_join(parts, "/"), r'[<>:"|?*]', "_"))


def truncated(url: Column, most: int) -> Column:
    p = path(url)
    return F.when(F.length(p) > most, F.concat(F.lit("..."), F.right(p, F.lit(most - 3)))).when(p != "", p).otherwise(F.left(url, F.lit(most)))


def prefix(url: Column) -> Column:
    """The first two segments of the path, between slashes."""
    parts = F.split(F.trim(path(url), F.lit("/")), "/")
    return F.when(F.trim(path(url), F.lit("/")) == "", F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, 2), "/"), F.lit("/")))


def title_case(text: Column) -> Column:
    """Every letter after a character that is no letter in upper case, the others in lower case."""
    low = F.lower(text)
    pieces = F.regexp_extract_all(low, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1))), "")


def site_name(url: Column, prefixes: list[str] | None = None) -> Column:
    host = authority(url)
    for lead in C.SITE_PREFIXES if prefixes is None else prefixes:
        host = F.regexp_replace(host, "^" + re.escape(lead), "")
    return F.concat(title_case(F.element_at(F.split(host, r"\."), 1)), F.lit(" Documentation"))


def index_site_name(url: Column) -> Column:
    return site_name(url, C.INDEX_PREFIXES)


def resolve_rooted(page: Column, href: Column) -> Column:
    """Absolute and root-relative references, without fragment; null for the other kinds, which `resolve` covers."""
    full = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme(page), F.lit(":"), href)).when(href.startswith("/"), F.concat(site(page), href))
    return F.regexp_replace(full, r"#[\s\S]*$", "")
