"""Fetched pages as a Spark data source.

Fetching itself is an ingest connector: `pages` is registered as a Python data source whose partitions are batches of
URLs, as many as may be in flight at once. Here it reads files that a fetcher left (one JSON object per line with url,
final_url, status_code, html, error, retry_after).
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, final_url string, html string, status_code int, error string, retry_after double, attempts int"
MOST_RETRY_DELAY = 60.0


@dataclass
class Fetched:
    url: str
    final_url: str
    html: str = ""
    status_code: int = 0
    error: str | None = None
    retry_after: float | None = None
    attempts: int = 1

    @property
    def success(self) -> bool:
        return 200 <= self.status_code < 400 and not self.error

    @property
    def retryable(self) -> bool:
        return self.status_code == 429 or self.status_code >= 500 or self.status_code == 0 and bool(self.error)


def retry_after_seconds(header: str | None, now: float) -> float | None:
    if not header:
        return None
    try:
        return max(0.0, float(header))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - now)
    except (TypeError, ValueError):
        return None


def with_retries(fetch: Callable[[str], Fetched], url: str, most: int = 3, base: float = 1.0, wait: Callable[[float], None] = time.sleep) -> Fetched:
    """Up to most + 1 tries; between them base * 2^k and jitter, or what the server asks for, a minute at most."""
    for attempt in range(most + 1):
        found = fetch(url)
        found.attempts = attempt + 1
        if found.success or not found.retryable or attempt == most:
            break
        wait(min(MOST_RETRY_DELAY, max(base * 2**attempt + random.uniform(0, 0.5), found.retry_after or 0.0)))
    return found


class Pacer:
    """Starts at least `delay` apart; doubled after a 429 (5 s at most), halved back after a success."""

    def __init__(self, delay: float) -> None:
        self.delay = self.least = self.peak = delay
        self.backoffs, self._last = 0, 0.0

    def wait(self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if (rest := self.delay - (clock() - self._last)) > 0:
            sleep(rest)
        self._last = clock()

    def back_off(self) -> None:
        self.delay, self.backoffs = min(2 * self.delay, 5.0), self.backoffs + 1
        self.peak = max(self.peak, self.delay)

    def ease_off(self) -> None:
        self.delay = max(self.delay / 2, self.least)


class _Slice(InputPartition):
    def __init__(self, path: str, k: int, n: int) -> None:
        super().__init__((path, k, n))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.n = options["path"], int(options.get("max_concurrent", 5))

    def partitions(self) -> list[InputPartition]:
        return [_Slice(self.path, k, self.n) for k in range(self.n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, k, n = partition.value
        with open(path, encoding="utf-8") as lines:
            for at, line in enumerate(lines):
                if at % n == k and line.strip():
                    x = json.loads(line)
                    yield x["url"], x.get("final_url", x["url"]), x.get("html", ""), int(x.get("status_code", 0)), x.get("error"), x.get("retry_after"), int(x.get("attempts", 1))


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_fetched(spark: SparkSession, path: str, max_concurrent: int = 5) -> DataFrame:
    spark.dataSource.register(PageSource)
    return spark.read.format("fetched_pages").option("path", path).option("max_concurrent", max_concurrent).load()
