"""DuckDB SQL for the same results, written apart from the column expressions."""

from __future__ import annotations

from folio.functions import constants as C
from folio.functions.urls import RFC

#: white space as Python has it, spelt out for RE2
WS = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def part(url: str, group: int) -> str:
    return f"regexp_extract({url}, {quoted(RFC)}, {group})"


def path(url: str) -> str:
    return part(url, 3)


def site(url: str) -> str:
    s, a = f"lower({part(url, 1)})", part(url, 2)
    return f"(CASE WHEN {s} <> '' THEN {s} || ':' ELSE '' END || CASE WHEN {a} <> '' THEN '//' || {a} ELSE '' END)"


def normalize(url: str) -> str:
    p, q = path(url), part(url, 4)
    return f"({site(url)} || CASE WHEN {p} = '/' THEN '/' ELSE rtrim({p}, '/') END || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"


def any_of(options: list[str]) -> str:
    return "|".join("".join("\\" + c if c in ".[]()?*+^$|{}\\" else c for c in o) for o in options)


def is_doc(url: str) -> str:
    p = f"lower({path(url)})"
    return f"(NOT regexp_matches({p}, {quoted(f'(?:{any_of(C.ASSET_EXTENSIONS)})$')}) AND NOT regexp_matches({p}, {quoted(any_of(C.ASSET_DIRECTORIES))}))"


def without_extensions(p: str) -> str:
    for ext in C.PAGE_EXTENSIONS:
        p = f"regexp_replace({p}, {quoted(chr(92) + ext + '$')}, '')"
    return p


def match_key(url: str) -> str:
    return f"lower(lower({part(url, 1)}) || '://' || {part(url, 2)} || {without_extensions(f'rtrim({path(url)}, {quoted("/")})')})"


def _or_index(p: str) -> str:
    return f"coalesce(nullif(trim({p}, '/'), ''), 'index')"


def _md(p: str) -> str:
    return f"regexp_replace({p} || '.md', '(\\.md)\\.md$', '\\1')"


def output_path(url: str) -> str:
    safe = f"regexp_replace({without_extensions(_or_index(path(url)))}, '[:?*<>|\"]', '_', 'g')"
    return f"regexp_replace({_md(safe)}, '/{{2,}}', '/', 'g')"


def file_name(url: str) -> str:
    parts = f"list_filter(string_split({_or_index(path(url))}, '/'), lambda s: s NOT IN ('', '..'))"
    return _md(f"regexp_replace(array_to_string({parts}, '/'), '[<>:\"|?*]', '_', 'g')")


def truncated(url: str, most: int) -> str:
    p = path(url)
    return f"CASE WHEN length({p}) > {most} THEN '...' || right({p}, {most - 3}) WHEN {p} <> '' THEN {p} ELSE left({url}, {most}) END"


def prefix(url: str) -> str:
    p = f"trim({path(url)}, '/')"
    return f"CASE WHEN {p} = '' THEN '/' ELSE '/' || array_to_string(string_split({p}, '/')[1:2], '/') || '/' END"


def title_case(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[\\p{{L}}]+|[^\\p{{L}}]+'), lambda s: upper(s[1]) || s[2:]), '')"


def site_name(url: str, prefixes: list[str]) -> str:
    host = part(url, 2)
    for lead in prefixes:
        host = f"regexp_replace({host}, {quoted('^' + lead.replace('.', chr(92) + '.'))}, '')"
    return f"({title_case(f'string_split({host}, {quoted(".")})[1]')} || ' Documentation')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def clean_title(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}*[|–—\\-]{WS}*[^|–—\\-]+$', '')")


def anchor(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_{WS[1:-1]}-]', '', 'g'), '{WS}+', '-', 'g')"


def unescaped(x: str) -> str:
    for code, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&#39;", "''")):
        x = f"replace({x}, '{code}', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def page_title(html: str) -> str:
    return strip(unescaped(f"regexp_extract({html}, '(?s)<title[^>]*>(.*?)</title>', 1)"))


def article_text(html: str) -> str:
    body = f"regexp_replace(regexp_extract({html}, '(?s)<article[^>]*>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({unescaped(body)}, '\\s+', ' ', 'g'))"


def clean_markdown(x: str) -> str:
    """All steps but the H1 one, which needs rows of lines."""
    steps = [
        (r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", ""),
        (r"[\x{1F300}-\x{1F9FF}]\x{FE0F}?", ""),
        (rf"\[{WS}*\]\([^)]+\)", ""),
        (rf"\[{WS}+", "["),
        (r"([^\n]) {2,}", r"\1 "),
        (r"\n{3,}", "\n\n"),
        (r"(\])\(([^)]*)\)([\p{L}\p{N}_])", r"\1(\2) \3"),
        (rf"(^|\n)(#{{1,6}}){WS}*\n+", r"\1\2 "),
    ]
    for pattern, new in steps:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, 'g')"
    return x
