"""The run's report: counts, timings, sizes, retries, errors. Rates and folds included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import constants as C
from folio.functions import text

MOST_DELAY = 5.0


def durations(timings: DataFrame) -> DataFrame:
    """Adds fetch_s, extract_s, convert_s and total_s; a stamp of 0 is none."""
    stamp = lambda c: F.when(F.col(c) != 0, F.col(c))
    span = lambda a, b: F.coalesce(stamp(b) - stamp(a), F.lit(0.0))
    end = F.coalesce(stamp("convert_end"), stamp("extract_end"), stamp("fetch_end"))
    parts = {f"{s}_s": span(f"{s}_start", f"{s}_end") for s in ("fetch", "extract", "convert")}
    return timings.withColumns({**parts, "total_s": F.coalesce(end - stamp("fetch_start"), F.lit(0.0))})


def outcome_counts(results: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s)
    return results.agg(of("done").alias("pages"), of("error").alias("errors"), of("skipped").alias("skipped"), F.count("*").alias("total"))


def stage_timing(timed: DataFrame) -> DataFrame:
    """(stage, pages, avg_s, sum_s) over done pages whose stage took any time."""
    stages = ", ".join(f"'{s}', {s}_s" for s in ("fetch", "extract", "convert"))
    long = timed.where("status = 'done'").select(F.expr(f"stack(3, {stages}) AS (stage, s)")).where("s <> 0")
    return long.groupBy("stage").agg(F.count("*").alias("pages"), F.avg("s").alias("avg_s"), F.sum("s").alias("sum_s"))


def slowest(timed: DataFrame, most: int = 5) -> DataFrame:
    return timed.where("status = 'done'").orderBy(F.desc("total_s"), "pos").limit(most)


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, first_pos), most frequent first; ties by first seen."""
    return rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")).orderBy(F.desc("n"), "first_pos")


def quality(pages: DataFrame) -> DataFrame:
    """Sizes of Markdown in characters: total, whole average, buckets, and a warning over 30 % tiny ones."""
    size = F.length("markdown").cast("long")
    of = lambda b: F.count_if(text.size_bucket(size) == b).alias(b)
    counted = pages.agg(F.count("*").alias("pages"), F.sum(size).alias("total"), of("tiny"), of("small"), of("normal"), of("large"))
    return counted.withColumns({"average": F.expr("total div pages"), "warning": F.expr("10 * tiny > 3 * pages")})


def throughput(pages: Column, seconds: Column) -> Column:
    return F.when((pages > 0) & (seconds > 0), pages / seconds)


def retries(timings: DataFrame) -> DataFrame:
    again = F.col("retry_attempts") > 1
    return timings.agg(
        F.count_if(again).alias("pages_retried"),
        F.coalesce(F.sum(F.when(again, F.col("retry_attempts") - 1)), F.lit(0)).cast("long").alias("total_retries"),
        F.max_by(F.when(again, F.col("url")), F.when(again, F.struct("retry_attempts", -F.col("pos")))).alias("most_retried"),
    )


def error_report(errors: DataFrame) -> DataFrame:
    """(category, n, first_pos, hint): the hint stands with the most frequent category."""
    hints = F.create_map(*[F.lit(x) for kv in C.ERROR_HINTS.items() for x in kv])
    best = histogram(errors, "category").limit(len(C.ERROR_HINTS))
    top = best.agg(F.min_by("category", F.struct(-F.col("n"), F.col("first_pos"))).alias("_top"))
    return best.join(F.broadcast(top), best["category"] == top["_top"], "left").withColumn("hint", F.when(F.col("_top").isNotNull(), F.element_at(hints, F.col("category")))).drop("_top")


def first_errors(errors: DataFrame, most: int = 10) -> DataFrame:
    return errors.orderBy("pos").limit(most)


def adaptive_delay(outcomes: DataFrame, start: float, keys: list[str]) -> DataFrame:
    """Per key: a rate limiter's final and peak delay and its back-offs, folded over outcomes (pos, status).

    '429' doubles the delay up to MOST_DELAY; 'done' halves it down to the start. Outcomes of one key are one run's.
    """
    events = F.transform(F.array_sort(F.collect_list(F.struct("pos", "status"))), lambda x: x["status"])
    state = F.struct(F.lit(float(start)).alias("delay"), F.lit(float(start)).alias("peak"), F.lit(0).cast("long").alias("backoffs"))

    def step(acc: Column, status: Column) -> Column:
        up = F.least(acc["delay"] * 2, F.lit(MOST_DELAY))
        delay = F.when(status == "429", up).when(status == "done", F.greatest(acc["delay"] / 2, F.lit(float(start)))).otherwise(acc["delay"])
        return F.struct(delay.alias("delay"), F.greatest(acc["peak"], delay).alias("peak"), (acc["backoffs"] + F.when(status == "429", 1).otherwise(0)).alias("backoffs"))

    return outcomes.groupBy(*keys).agg(F.aggregate(events, state, step).alias("_s")).select(*keys, "_s.delay", "_s.peak", "_s.backoffs")
