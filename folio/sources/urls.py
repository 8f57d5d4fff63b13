"""Where URLs come from: sitemaps, lists, skip files. All give (url, title, priority, depth, pos)."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text, urls
from folio.storage import shared_path

#: Where a site's sitemap may be
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap/"]


def _discovered(rows: DataFrame, priority: Column, pos: Column) -> DataFrame:
    return rows.select(F.col("url"), F.lit(None).cast("string").alias("title"), priority.alias("priority"), F.lit(0).alias("depth"), pos.alias("pos"))


def parse_sitemaps(docs: DataFrame, tree: bool = False) -> DataFrame:
    """Entries of sitemap documents (path, xml): location and priority, .5 where it is missing or no number.

    As the tree of a site is walked, a priority of 0 is none (.5 too). Documents that are no XML, and indexes, have
    no entries.
    """
    schema = "STRUCT<url: ARRAY<STRUCT<loc: STRING, priority: STRING>>>"
    found = docs.select("path", F.from_xml("xml", schema, {"mode": "PERMISSIVE"}).alias("x")).select("path", F.posexplode("x.url").alias("pos", "u"))
    rows = found.select("path", "pos", text.strip(F.col("u.loc")).alias("url"), F.coalesce(text.strip(F.col("u.priority")).try_cast("double"), F.lit(0.5)).alias("p")).where("url <> ''")
    priority = F.when(F.col("p") == 0, 0.5).otherwise(F.col("p")) if tree else F.col("p")
    return rows.select("path", "url", F.lit(None).cast("string").alias("title"), priority.alias("priority"), F.lit(0).alias("depth"), F.col("pos").cast("long").alias("pos"))


def fallback_sitemaps(base_url: str) -> list[str]:
    parts = urlsplit(base_url)
    return [f"{parts.scheme}://{parts.netloc}{p}" for p in SITEMAP_PATHS]


def first_readable(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, xml) of the first path that is there; none of them gives no rows. Other errors of the store are raised."""
    for path in paths:
        try:
            found = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("xml"))
            found.head(1)
            return found
        except AnalysisException:  # not there, or in a store that this session has no file system for
            continue
    return spark.createDataFrame([], "path string, xml string")


def parse_list(lines: DataFrame) -> DataFrame:
    """URLs of list lines (pos, line): without blanks around; blank lines and comments go."""
    rows = lines.withColumn("url", text.strip(F.col("line"))).where((F.col("url") != "") & ~F.col("url").startswith("#"))
    return _discovered(rows, F.lit(0.5), F.col("pos"))


def parse_skip_list(lines: DataFrame) -> DataFrame:
    """Normalised URLs of skip-file lines (line); a line is a comment only if # is its very first character."""
    rows = lines.where((text.strip(F.col("line")) != "") & ~F.col("line").startswith("#"))
    return rows.select(urls.normalize(text.strip(F.col("line"))).alias("url"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text file, in file order. Spark's readers pass over names that begin with a dot or an underscore,
    as the list of failed URLs does; such a file is read from a copy in the shared folder."""
    if path.rsplit("/", 1)[-1].startswith((".", "_")):
        path = _plainly_named(spark, path)
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))


def _plainly_named(spark: SparkSession, path: str) -> str:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(shared_path(spark, "lines"))
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    return target.toString()
