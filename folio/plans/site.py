"""The whole run as one lazy plan: fetched pages in, formatted pages and a report out."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text
from folio.functions.extraction import Extractor
from folio.operators import pages as P
from folio.operators import patterns, urlset
from folio.sources.config import Settings


@dataclass(frozen=True)
class SitePlan:
    """Plans for one site's settings. Detected frameworks change nothing unless `apply_detected` asks for it."""

    settings: Settings
    registry: patterns.PatternRegistry = field(default_factory=patterns.PatternRegistry)

    def extractor(self, detected: str | None = None) -> Extractor:
        x = self.settings.extractor
        own = Extractor(x.content_selectors, x.remove_selectors, x.min_content_length, x.include_tables, x.include_images, x.include_links)
        name = self.settings.pattern or (detected if self.settings.apply_detected else None)
        return patterns.with_pattern(own, self.registry.get(name))

    def discover(self, found: DataFrame, skip: DataFrame | None = None) -> DataFrame:
        d = self.settings.discovery
        return urlset.discovered(found, skip, self.settings.base_url, d.include, d.exclude, d.max_pages)

    def plan(self, fetched: DataFrame, detected: str | None = None) -> DataFrame:
        """fetched (url, final_url, html, status_code, error, ...) with content, Markdown, status and reason.

        The URL gate stands before parsing, so its pages aren't parsed; errors keep their category.
        """
        ok = F.col("status_code").between(200, 399) & (F.coalesce("error", F.lit("")) == "")
        good = fetched.withColumn("requested", F.col("url")).withColumn("url", F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url")))
        done = P.page_status(P.format_pages(P.extract_pages(P.spread(good.where(ok)), self.extractor(detected))))
        message = F.coalesce(F.when(F.col("error") != "", F.col("error")), F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
        failed = good.where(~F.coalesce(ok, F.lit(False))).withColumns({"status": F.lit("error"), "reason": text.error_category(F.col("status_code"), message, F.lit("fetch"))})
        return done.unionByName(failed, allowMissingColumns=True)

    def with_overrides(self, **changes: object) -> SitePlan:
        return replace(self, settings=replace(self.settings, **changes))
