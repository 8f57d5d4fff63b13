"""Fixed values that results depend on."""

from __future__ import annotations

# Assets by extension and by directory
ASSET_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp",
    ".css", ".js", ".woff", ".woff2", ".ttf", ".eot",
    ".pdf", ".zip", ".tar", ".gz",
    ".xml", ".json", ".yaml", ".yml",
]
ASSET_DIRECTORIES = ["/assets/", "/static/", "/images/", "/img/", "/css/", "/js/", "/fonts/", "/_next/", "/_nuxt/", "/.well-known/"]

# Page extensions that output paths and link keys lose, in this order
PAGE_EXTENSIONS = [".html", ".htm", ".php", ".asp", ".aspx"]

# Host prefixes that site names lose, in this order
SITE_PREFIXES = ["www.", "docs.", "documentation.", "help.", "support."]
INDEX_PREFIXES = ["www.", "docs.", "developers.", "developer.", "documentation.", "help.", "support."]

# Selectors, in order
CONTENT_SELECTORS = ["article", "main", '[role="main"]', ".content", ".documentation", ".docs-content", ".markdown-body"]
CONTENT_FALLBACKS = ['main[class*="docMainContainer"]', ".docPage main", "main .container", "main .col"]
REMOVE_SELECTORS = [
    "nav", "header", "footer", ".navigation", ".nav", ".navbar", ".sidebar", ".toc", ".table-of-contents",
    ".breadcrumb", ".breadcrumbs", ".edit-page", ".edit-on-github", ".page-nav", ".pagination", ".comments",
    ".advertisement", "script", "style", "noscript", '[role="navigation"]', '[role="banner"]',
    '[class*="skipToContent"]', 'a[href="#__docusaurus_skipToContent_fallback"]',
]

# Elements that stay when empty
PRESERVE_TAGS = [
    "details", "summary", "table", "thead", "tbody", "tfoot", "tr", "th", "td",
    "ul", "ol", "li", "dl", "dt", "dd", "pre", "code", "svg", "path",
]
MIN_CONTENT_LENGTH = 100

# Phrases of login gates, and the length from which a text is no gate
LOGIN_PHRASES = [
    "please login", "please log in", "please sign in", "sign in to", "authentication required",
    "log in to continue", "sign in to continue", "you must be logged in", "you need to sign in", "login required",
]
LOGIN_LENGTH = 500

# Signs of pages that need JavaScript, of the OpenAPI plugin, and of a crashed browser
JS_MARKERS = ["__NEXT_DATA__", "__NUXT__", "window.__INITIAL_STATE__", "react-root", 'id="app"', 'id="root"', "<noscript>"]
OPENAPI_MARKERS = [
    "openapi-schema__property", "openapi-left-panel__container", "openapi-markdown__details", "docusaurus-openapi",
    "openapi-explorer", "docusaurus-plugin-openapi", "plugin-content-docs-api",
]
CRASH_MARKER = "This page crashed"

# Class names that are code languages
CODE_LANGUAGES = [
    "python", "py", "javascript", "js", "typescript", "ts", "ruby", "go", "rust", "java", "cpp", "c",
    "bash", "shell", "json", "yaml", "xml", "html", "css", "sql", "graphql",
]

# Hints for the most frequent error category
ERROR_HINTS = {
    "timeout": "Try --delay 2.0 or increase --timeout",
    "rate_limited": "Try --delay 2.0 and reduce --max-concurrent",
    "client_error": "Check the URL is accessible in a browser",
    "server_error": "The server may be overloaded — try again later",
    "connection": "Check your network connection and the site URL",
    "extraction": "Try a different --pattern or use --verbose to debug",
    "unknown": "Rerun with --verbose for details",
}
