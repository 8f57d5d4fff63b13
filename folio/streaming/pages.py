"""An extension: the page plan over a stream of fetched pages. Every per-page step is stateless."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.functions import urls
from folio.operators import pages as P


def stream_pages(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string, ts timestamp") -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def formatted(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Pages once per normalised URL within the watermark, formatted, with status and reason."""
    keyed = stream.withWatermark("ts", delay).withColumn("norm", urls.normalize(F.col("url")))
    return P.page_status(P.format_pages(P.extract_pages(keyed.dropDuplicatesWithinWatermark(["norm"]))))


def write_pages(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    kept = formatted(stream).where("status = 'done'").select("url", "title", "api_version", "markdown")
    return kept.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def outcome_stream(stream: DataFrame, every: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Pages per window, status and reason; late pages count until the watermark passes."""
    return formatted(stream, delay).groupBy(F.window("ts", every), "status", "reason").agg(F.count("*").alias("pages"))
