"""Site frameworks as a small table: selectors, and what a fetcher needs to know."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import constants as C
from folio.functions import text
from folio.functions.extraction import Extractor


@dataclass(frozen=True)
class SitePattern:
    name: str
    description: str = ""
    content_selectors: tuple[str, ...] = ()
    remove_selectors: tuple[str, ...] = ()
    doc_url_patterns: tuple[str, ...] = ()
    exclude_url_patterns: tuple[str, ...] = ()
    requires_js: bool = False
    wait_selector: str | None = None
    wait_time_ms: int = 0
    click_tabs_selector: str | None = None


_TABS = '.openapi-tabs__code-container [role="tab"]'
# The known frameworks
KNOWN = [
    SitePattern(
        "docusaurus", "Docusaurus documentation sites",
        ("article.markdown", ".docMainContent", 'main[class*="docMainContainer"]', "main .col", "main .container article", '[class*="docItemContainer"]'),
        (
            ".theme-doc-sidebar-container", '[class*="docSidebarContainer"]', "aside", 'nav[aria-label="Main"]', ".navbar", ".theme-doc-breadcrumbs",
            ".pagination-nav", ".theme-doc-toc-mobile", ".theme-doc-footer", ".theme-edit-this-page", '[class*="tocCollapsible"]', "footer",
        ),
        requires_js=True, wait_selector="article.markdown", click_tabs_selector=_TABS,
    ),
    SitePattern(
        "docusaurus-openapi", "Docusaurus sites with docusaurus-openapi-docs plugin",
        ("article .theme-doc-markdown", "article.markdown", 'main[class*="docMainContainer"]', "main .col", "article"),
        (
            ".openapi-explorer__request-form", ".openapi-explorer__response-container", ".theme-doc-sidebar-container", '[class*="docSidebarContainer"]', "aside",
            'nav[aria-label="Main"]', ".navbar", ".theme-doc-breadcrumbs", ".pagination-nav", ".theme-doc-toc-mobile", ".theme-doc-footer", ".theme-edit-this-page",
            ".breadcrumbs", '[class*="tocCollapsible"]', "footer",
        ),
        requires_js=True, wait_selector=".openapi-left-panel__container, article.markdown", wait_time_ms=500, click_tabs_selector=_TABS,
    ),
    SitePattern(
        "gitbook", "GitBook documentation sites",
        ('[data-testid="page.contentEditor"]', ".markdown-section", ".page-inner", "main"),
        (".book-summary", ".navigation", ".page-footer", '[data-testid="page.tableOfContents"]'),
        requires_js=True, wait_selector='[data-testid="page.contentEditor"], .markdown-section',
    ),
    SitePattern(
        "readthedocs", "Read the Docs sites",
        ('[role="main"]', ".document", ".rst-content", ".body"),
        (".wy-nav-side", ".rst-versions", ".wy-breadcrumbs", ".headerlink", '[role="navigation"]'),
    ),
    SitePattern(
        "mkdocs", "MkDocs documentation sites",
        ('[role="main"]', ".md-content", "article", ".content"),
        (".md-sidebar", ".md-header", ".md-footer", ".md-tabs", ".md-source"),
        wait_selector='[role="main"]',
    ),
    SitePattern(
        "sphinx", "Sphinx documentation sites",
        ('[role="main"]', ".document", ".body", ".section"),
        (".sphinxsidebar", ".related", ".footer", ".headerlink"),
    ),
    SitePattern(
        "vitepress", "VitePress documentation sites",
        (".vp-doc", "main .content", ".content-container"),
        (".VPSidebar", ".VPNav", ".VPFooter", ".aside", ".edit-link", ".prev-next"),
        requires_js=True, wait_selector=".vp-doc",
    ),
]


@dataclass
class PatternRegistry:
    """Patterns by name; registering a name again replaces it."""

    patterns: dict[str, SitePattern] = field(default_factory=lambda: {p.name: p for p in KNOWN})

    def register(self, pattern: SitePattern) -> None:
        self.patterns[pattern.name] = pattern

    def get(self, name: str | None) -> SitePattern | None:
        return self.patterns.get(name) if name else None

    def list_patterns(self) -> list[SitePattern]:
        return list(self.patterns.values())

    def table(self, spark: SparkSession) -> DataFrame:
        texts = T.ArrayType(T.StringType())
        kinds = {"requires_js": T.BooleanType(), "wait_time_ms": T.IntegerType()}
        names = list(asdict(KNOWN[0]))
        schema = T.StructType([T.StructField(n, kinds.get(n, texts if n.endswith(("selectors", "patterns")) else T.StringType())) for n in names])
        rows = [tuple(list(v) if isinstance(v, tuple) else v for v in asdict(p).values()) for p in self.list_patterns()]
        return spark.createDataFrame(rows, schema)


def with_pattern(extractor: Extractor, pattern: SitePattern | None) -> Extractor:
    """The pattern's selectors stand before the configured ones."""
    if pattern is None:
        return extractor
    return replace(extractor, content=(*pattern.content_selectors, *extractor.content), remove=(*pattern.remove_selectors, *extractor.remove))


def fetch_settings(settings: dict, pattern: SitePattern | None) -> dict:
    """JavaScript is only ever switched on; other settings follow where the pattern has them."""
    out = dict(settings)
    if pattern is not None:
        out |= {"use_js": True} if pattern.requires_js else {}
        out |= {k: v for k in ("wait_selector", "wait_time_ms", "click_tabs_selector") if (v := getattr(pattern, k))}
    return out


def detect(pages: DataFrame) -> DataFrame:
    """Adds `pattern`, the framework that URL and page show."""
    return pages.withColumn("pattern", text.pattern_name(F.col("url"), F.col("html")))


def selectors_of(pages: DataFrame, registry: PatternRegistry | None = None) -> DataFrame:
    """pages (pattern, ...) with the selector lists that would apply; unknown names get the defaults."""
    known = (registry or PatternRegistry()).table(pages.sparkSession).select(F.col("name").alias("_name"), "content_selectors", "remove_selectors")
    joined = pages.join(known, pages["pattern"] == known["_name"], "left").drop("_name")
    own = lambda c, base: F.concat(F.coalesce(F.col(c), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in base]))
    return joined.withColumns({"content_selectors": own("content_selectors", C.CONTENT_SELECTORS), "remove_selectors": own("remove_selectors", C.REMOVE_SELECTORS)})
