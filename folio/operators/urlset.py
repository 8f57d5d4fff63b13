"""Sets of discovered URLs: scope, first-wins dedup, skip list, limit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import urls


def in_scope(found: DataFrame, base: str = "", include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Documentation pages that the patterns let through."""
    u = F.col("url")
    return found.where(urls.is_doc(u) & urls.should_include(u, base, include, exclude))


def limit_discovered(found: DataFrame, max_pages: int) -> DataFrame:
    """The first max_pages by discovery order; 0 is no limit. Stands before dedup and the skip list."""
    return found.orderBy("pos").limit(max_pages) if max_pages > 0 else found


def first_by_url(found: DataFrame) -> DataFrame:
    """Of URLs that are the same once normalised, the one found first, as it was found."""
    keyed = found.withColumn("_norm", urls.normalize(F.col("url")))
    ranked = keyed.withColumn("_rank", F.row_number().over(W.partitionBy("_norm").orderBy("pos")))
    return ranked.where("_rank = 1").drop("_norm", "_rank")


def without_skipped(found: DataFrame, skip: DataFrame) -> DataFrame:
    """URLs whose normalised form the skip list (url) doesn't have. Spark broadcasts the list if it is small."""
    gone = skip.select(urls.normalize(F.col("url")).alias("_skip")).distinct()
    return found.join(gone, urls.normalize(found["url"]) == gone["_skip"], "left_anti")


def discovered(found: DataFrame, skip: DataFrame | None = None, base: str = "", include: str | None = None, exclude: str | None = None, max_pages: int = 0) -> DataFrame:
    kept = first_by_url(limit_discovered(in_scope(found, base, include, exclude), max_pages))
    return without_skipped(kept, skip) if skip is not None else kept


def prefix_counts(found: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent two-segment prefixes (ties by discovery) with the filter that picks them."""
    counted = found.withColumn("prefix", urls.prefix(F.col("url"))).groupBy("prefix").agg(F.count("*").alias("pages"), F.min("pos").alias("first_pos"))
    best = counted.orderBy(F.desc("pages"), "first_pos").limit(top)
    return best.withColumn("filter", F.concat(F.lit('--include "'), F.rtrim(F.col("prefix"), F.lit("/")), F.lit('"')))


def _valid(pattern: str | None) -> str | None:
    try:
        return pattern if pattern and re.compile(pattern) else None
    except re.error:
        return None


def refine(found: DataFrame, include: str | None = None, exclude: str | None = None, most: int = 0) -> DataFrame:
    """What a user narrows discovered URLs to; a pattern that is none is left out. most: the first so many, 0 for all."""
    include, exclude = _valid(include), _valid(exclude)
    kept = found.where(F.col("url").rlike(include)) if include else found
    kept = kept.where(~F.col("url").rlike(exclude)) if exclude else kept
    return limit_discovered(kept, most)
