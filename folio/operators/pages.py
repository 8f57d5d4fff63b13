"""From fetched pages to content and Markdown: one Arrow function parses each page once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import text, urls
from folio.functions.extraction import Extractor
from folio.functions.markdown import html_to_markdown, to_markdown
from folio.functions.openapi import extract_schema

_CONTENT = T.StructType([T.StructField(n, T.StringType()) for n in ("html", "title", "description", "text", "method", "markdown", "api_markdown", "api_title")])
_SCHEMA = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("title", T.StringType())])


def _one(extractor: Extractor, html: str | None, api: bool) -> tuple:
    found = extractor.extract(html)
    if found is None:
        return (None,) * len(_CONTENT)
    schema = extract_schema(html) if api else None
    node = found["node"]
    own = (schema["markdown"], schema["title"]) if schema else (None, None)
    return node.html(), found["title"], found["description"], found["text"], found["method"], to_markdown(node), *own


def content_udf(extractor: Extractor | None = None) -> Callable[[Column, Column], Column]:
    """A function of (html, is API page) that gives the content struct; all nulls where nothing was found."""
    chosen = extractor or Extractor()

    @F.pandas_udf(_CONTENT)
    def content(html: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, api in html:
            rows = [_one(chosen, h, bool(a)) for h, a in zip(pages, api, strict=True)]
            yield pd.DataFrame(rows, columns=_CONTENT.names, dtype=object)

    # computed once though several columns are read from it
    return content.asNondeterministic()


@F.pandas_udf(T.StringType())
def markdown_of(html: pd.Series) -> pd.Series:
    return html.map(html_to_markdown)


@F.pandas_udf(_SCHEMA)
def openapi_of(html: pd.Series) -> pd.DataFrame:
    found = [extract_schema(h) or {} for h in html]
    return pd.DataFrame({k: [x.get(k) for x in found] for k in _SCHEMA.names}, dtype=object)


def spread(pages: DataFrame) -> DataFrame:
    """Pages over all cores before the parsing; one file would otherwise be one task's."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages.repartition(max(cores, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def extract_pages(pages: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """pages (url, html, ...) with the struct `content`. Category URLs aren't parsed; their content is null."""
    html = F.when(~urls.is_category(F.col("url")), F.col("html"))
    return pages.withColumn("content", content_udf(extractor)(html, text.is_api_page(F.col("url"), F.col("html"))))


def format_pages(extracted: DataFrame) -> DataFrame:
    """Adds title, markdown and api_version, as they are written out. API pages show their schema."""
    c = F.col("content")
    body = text.clean_markdown(F.coalesce(c["api_markdown"], c["markdown"]))
    title = F.coalesce(F.when(c["api_title"] != "", c["api_title"]), text.clean_title(F.when(c["title"] != "", c["title"])))
    page = extracted.withColumn("markdown", body)
    return page.withColumns({"title": title, "api_version": text.api_version(F.col("url"), F.col("markdown"))})


def page_status(formatted: DataFrame) -> DataFrame:
    """Adds status and reason: which gate, if any, a page was left out at."""
    c = F.col("content")
    reason = (
        F.when(urls.is_category(F.col("url")), "category url")
        .when(F.coalesce(c["html"], F.lit("")) == "", "no content")
        .when(text.is_login_gate(c["text"]), "login gate")
        .when(text.is_category_page(F.col("markdown")), "category page")
    )
    return formatted.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "done").otherwise("skipped"))
