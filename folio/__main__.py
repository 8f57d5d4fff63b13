"""python -m folio extract URL [--fetched PAGES] ... | probe URL | list-patterns | --version"""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import documents, summary
from folio.operators.patterns import PatternRegistry
from folio.plans.site import SitePlan
from folio.session import local_session, ship
from folio.sources import config, http
from folio.sources.urls import parse_skip_list, read_lines
from folio.storage import materialize

VERSION = "0.1.0"
FETCHED = "url string, final_url string, html string, status_code int, error string"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="folio")
    out.add_argument("-V", "--version", action="version", version=VERSION)
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list-patterns")
    commands.add_parser("probe").add_argument("url")
    run = commands.add_parser("extract")
    run.add_argument("url")
    run.add_argument("--fetched", help="JSON lines or Parquet of fetched pages; without them pages are discovered and fetched")
    run.add_argument("-d", "--discovery", choices=("sitemap", "crawl", "manual"), default="sitemap")
    run.add_argument("-f", "--urls-file", help="URLs of manual discovery, one a line")
    run.add_argument("--max-depth", type=int, default=3)
    run.add_argument("--delay", type=float, default=1.0, help="seconds between requests")
    run.add_argument("--js", action=argparse.BooleanOptionalAction, default=False)
    run.add_argument("-o", "--output", default="./output/output.md")
    run.add_argument("-m", "--mode", choices=("single", "multi"), default="single")
    run.add_argument("-i", "--include")
    run.add_argument("-e", "--exclude")
    run.add_argument("-p", "--pattern")
    run.add_argument("--max-pages", type=int, default=0)
    run.add_argument("--skip-urls")
    run.add_argument("-c", "--config", help="TOML; other settings than the URL, the skip list and -v are its own")
    run.add_argument("-v", "--verbose", action="store_true")
    return out


def settings_of(args: argparse.Namespace) -> config.Settings:
    if args.config:
        found = config.Settings.from_toml(args.config)
        return replace(found, base_url=args.url, skip_urls=args.skip_urls or found.skip_urls, verbose=args.verbose)
    return config.Settings(
        args.url,
        args.pattern,
        args.skip_urls,
        args.verbose,
        discovery=config.Discovery(args.discovery, args.max_pages, args.max_depth, args.include, args.exclude, args.urls_file),
        fetcher=config.Fetch(use_js=args.js),
        output=config.Output(args.mode, args.output),
        rate_limit=config.RateLimit(delay_seconds=args.delay),
    )


def read_fetched(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.schema(FETCHED).json(path)


def fetch_site(spark: SparkSession, settings: config.Settings) -> DataFrame:
    """Discover a site's pages and fetch them, without those that the skip list has."""
    fetch = http.fetcher(settings)
    found = http.discoverer(settings.discovery.mode)(spark, settings, fetch)
    return fetch(SitePlan(settings).discover(found, skip_list(spark, settings)))


def skip_list(spark: SparkSession, settings: config.Settings) -> DataFrame | None:
    return parse_skip_list(read_lines(spark, settings.skip_urls)) if settings.skip_urls else None


def report(results: DataFrame) -> list[str]:
    """Lines of the run's summary: outcomes, sizes, extraction methods, and errors with a hint."""
    done = results.where("status = 'done'")
    lines = [f"{k}: {v}" for part in (summary.outcome_counts(results), summary.quality(done).drop("pages")) for k, v in part.first().asDict().items()]
    lines += [f"method {r.method}: {r.n}" for r in summary.histogram(done.select("pos", "content.method"), "method").collect()]
    errors = results.where("status = 'error'").select("url", "pos", F.col("reason").alias("category"))
    return lines + [f"error {r.category}: {r.n}{f' ({r.hint})' if r.hint else ''}" for r in summary.error_report(errors).collect()]


def extract(spark: SparkSession, settings: config.Settings, fetched: DataFrame) -> list[str]:
    """Write the site's documents and the list of failed URLs; gives the lines of the run's summary."""
    plan = SitePlan(settings)
    # written down once: the numbers are used twice, and another scan may number rows otherwise
    rows = materialize(fetched.withColumn("pos", F.monotonically_increasing_id()), "fetched")
    results = plan.plan(rows.join(plan.discover(rows.select("pos", "url"), skip_list(spark, settings)).select("pos"), "pos", "left_semi")).cache()
    pages = documents.ordered(results.where("status = 'done'").select("url", "title", "markdown", "api_version"))
    at = datetime.now(UTC).replace(tzinfo=None)
    out = settings.output
    if out.mode == "single":
        blocks = documents.combined_blocks(pages, settings.base_url, at, out.include_metadata, out.include_toc)
        documents.write_single(blocks, out.path, "section", "pos")
    else:
        documents.write_site(pages, out.path, settings.base_url, at, out.include_metadata)
    failed = documents.write_failed(results, out.path, at)
    return report(results) + ([f"failed URLs: {failed}"] if failed else [])


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "list-patterns":
        for p in PatternRegistry().list_patterns():
            print(f"{p.name:<20} {p.description}{' (requires JS)' if p.requires_js else ''}")
        return
    spark = SparkSession.getActiveSession() or local_session()
    ship(spark)
    if args.command == "probe":
        settings = config.Settings(args.url)
        found = http.probe(spark, args.url, http.fetcher(settings)).select("final_url", "length", "trailing_slash", "pattern", "needs_js").first()
        print(*[f"{k}: {v}" for k, v in found.asDict().items()], sep="\n")
        return
    settings = settings_of(args)
    print(*extract(spark, settings, read_fetched(spark, args.fetched) if args.fetched else fetch_site(spark, settings)), sep="\n")


if __name__ == "__main__":
    main()
