"""Written documents: single pages, one combined document, an index, and the files for them.

A combined document is kept as ordered blocks, one row each; written in range partitions, the part files in name order
are the document. Nothing gathers a site's bodies in one task; `write_single` merges part files on the driver, file by
file, for those who need one file.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import text, urls
from folio.operators.links import rewrite_links
from folio.storage import materialize


def ordered(pages: DataFrame, by: str = "url") -> DataFrame:
    """Adds pos, 1 for the first URL of a site by code point; `site` is the column that tells sites apart, if any.

    URLs alone are ranked, without bodies: range-partitioned, counted by partition and numbered within it. A page gets
    its URL's rank by an equi-join; pages with the same URL follow each other by `page_id`, or where there is none by
    what else they have, so that a page has the same pos wherever the plan is run again.
    """
    keys = ["site", by] if "site" in pages.columns else [by]
    then = ["page_id"] if "page_id" in pages.columns else [f.name for f in pages.schema if f.name not in keys and isinstance(f.dataType, T.AtomicType)]
    counted = pages.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranged = materialize(counted.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "url-ranges")
    # one number a partition
    parts = ranged.groupBy("_part").agg(F.sum("_n").alias("_n")).agg(F.sort_array(F.collect_list(F.struct("_part", "_n"))).alias("_parts"))
    parts = parts.select(F.posexplode("_parts").alias("_at", "_p"), "_parts")
    offsets = parts.select(F.col("_p._part").alias("_part"), F.expr("aggregate(slice(_parts, 1, _at), 0L, (s, x) -> s + x._n)").alias("_offset"))
    upto = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(offsets), "_part").withColumn("_first", F.col("_offset") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    if len(keys) > 1:
        placed = placed.join(placed.groupBy("site").agg(F.min("_first").alias("_site_first")), "site").withColumn("_first", F.col("_first") - F.col("_site_first"))
    placed = placed.select(*[F.col(k).alias(f"_{k}") for k in keys], "_first", "_n")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    joined = pages.join(placed, same)
    # only pages that share a URL have to be numbered among themselves
    own = F.when(F.col("_n") > 1, F.row_number().over(W.partitionBy(*keys).orderBy(*(then or keys)))).otherwise(F.lit(1))
    return joined.withColumn("pos", (F.col("_first") + own).cast("int")).drop("_first", "_n", *[f"_{k}" for k in keys])


def _title(page: DataFrame) -> Column:
    return F.coalesce(F.when(F.col("title") != "", F.col("title")), F.concat(F.lit("Page "), F.col("pos").cast("string")))


def toc(pages: DataFrame) -> DataFrame:
    """pages (pos, title, ...) with `entry`, the page's line in the table of contents."""
    title = _title(pages)
    return pages.withColumn("entry", F.concat(F.lit("- ["), title, F.lit("](#"), text.anchor(title), F.lit(")")))


def single_documents(pages: DataFrame, metadata: bool = True) -> DataFrame:
    """pages with path and body: each page's own file."""
    return pages.withColumns(
        {"path": urls.output_path(F.col("url")), "body": text.page_document(F.col("url"), F.col("title"), F.col("api_version"), F.col("markdown"), metadata)}
    )


def combined_blocks(pages: DataFrame, base_url: str, extracted_at: datetime, metadata: bool = True, with_toc: bool = True) -> DataFrame:
    """(section, pos, block) of pages (pos, url, title, markdown, api_version); ordered, the blocks joined by line ends
    are the document."""
    spark = pages.sparkSession
    base = F.lit(base_url)
    counted = pages.agg(F.count("*").alias("n"))
    about = [F.concat(F.lit("> Documentation extracted from "), base), F.lit(f"> Extracted on: {extracted_at.isoformat()}"), F.concat(F.lit("> Total pages: "), F.col("n").cast("string")), F.lit("")]
    head = F.concat_ws("\n", F.concat(F.lit("# "), urls.site_name(base)), F.lit(""), *(about if metadata else []))
    blocks = counted.select(F.lit(0).alias("section"), F.lit(0).alias("pos"), head.alias("block"))
    if with_toc:
        many = counted.where("n > 1")
        blocks = blocks.unionByName(many.select(F.lit(1).alias("section"), F.lit(0).alias("pos"), F.lit("## Table of Contents\n").alias("block")))
        blocks = blocks.unionByName(toc(pages).select(F.lit(1).alias("section"), "pos", F.col("entry").alias("block")).where("pos > 1"))
        first = toc(pages).where("pos <= 2").groupBy().agg(F.count("*").alias("n"), F.min_by("entry", "pos").alias("block")).where("n > 1")
        blocks = blocks.unionByName(first.select(F.lit(1).alias("section"), F.lit(1).alias("pos"), "block"))
        blocks = blocks.unionByName(many.select(F.lit(2).alias("section"), F.lit(0).alias("pos"), F.lit("").alias("block")))
    rule = spark.createDataFrame([(3, 0, "---\n")], "section int, pos int, block string")
    body = text.page_block(F.col("url"), F.col("title"), F.col("api_version"), F.col("markdown"))
    return blocks.unionByName(rule).unionByName(pages.select(F.lit(4).alias("section"), "pos", body.alias("block")))


def index_lines(pages: DataFrame, base_url: str, extracted_at: datetime) -> DataFrame:
    """(pos, block) of the index file: the heading at 0, then a line per page in page order, then the end."""
    base, n = F.lit(base_url), pages.agg(F.count("*").alias("n"))
    parts = [F.concat(F.lit("# "), urls.index_site_name(base)), F.lit(""), F.concat(F.lit("> Extracted from "), base), F.lit(f"> Extracted on: {extracted_at.isoformat()}")]
    head = F.concat_ws("\n", *parts, F.concat(F.lit("> Total pages: "), F.col("n").cast("string")), F.lit(""), F.lit("## Pages"), F.lit(""))
    path = urls.output_path(F.col("url"))
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), path)
    lines = pages.select(F.col("pos").cast("long").alias("pos"), F.concat(F.lit("- ["), title, F.lit("]("), path, F.lit(")")).alias("block"))
    end = n.select((F.col("n") + 1).alias("pos"), F.lit("").alias("block"))
    return n.select(F.lit(0).cast("long").alias("pos"), head.alias("block")).unionByName(lines).unionByName(end)


def write_blocks(blocks: DataFrame, path: str, *order: str) -> None:
    """Part files that in name order are the document."""
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).select("block").write.mode("overwrite").text(path)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def markdown_path(path: str) -> str:
    """A single output file ends in .md, whatever it was called."""
    folder, slash, name = path.rpartition("/")
    stem, dot, _ = name.rpartition(".")
    return f"{folder}{slash}{stem if dot and stem else name}.md"


def write_single(blocks: DataFrame, path: str, *order: str) -> str:
    """One Markdown file of the ordered blocks."""
    return write_file(blocks, markdown_path(path), *order)


def write_file(blocks: DataFrame, target: str, *order: str) -> str:
    """One file of the ordered blocks: Spark writes the parts, which are then appended one to another."""
    spark = blocks.sparkSession
    parts = f"{target}.parts"
    write_blocks(blocks, parts, *order)
    jvm, place, fs = _hadoop(spark, parts)
    out = fs.create(jvm.org.apache.hadoop.fs.Path(target), True)
    try:
        for status in sorted(fs.listStatus(place), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                source = fs.open(status.getPath())
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                source.close()
    finally:
        out.close()
    fs.delete(place, True)
    return target


def write_files(files: DataFrame, folder: str) -> None:
    """Each row's body as the file `path` below a folder that all executors mount; of equal paths the last stays.

    Bodies go from executors to files; none passes through the driver.
    """
    last = files.groupBy("path").agg(F.max("pos").alias("pos"))
    last = files.join(last, ["path", "pos"]).select("path", "body")

    def write(rows) -> None:
        from pathlib import Path

        for row in rows:
            target = Path(folder, row["path"])
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(row["body"], encoding="utf-8")

    last.foreachPartition(write)


def write_site(pages: DataFrame, folder: str, base_url: str, extracted_at: datetime, metadata: bool = True) -> None:
    """A file per page with links between pages rewritten, then index.md over whatever stands there."""
    placed = rewrite_links(single_documents(pages, metadata), F.col("body"))
    write_files(placed.select("path", "body", "pos"), folder)
    write_single(index_lines(pages, base_url, extracted_at), f"{folder}/index.md", "pos")


def failed_urls(results: DataFrame) -> DataFrame:
    """Lines of the list of failed URLs, which can serve as a skip list."""
    return results.where("status = 'error'").select("url")


def write_failed(results: DataFrame, output: str, at: datetime) -> str | None:
    """The failed URLs beside the output, under two comment lines; no file if none failed. It can serve as a skip list."""
    failed = failed_urls(results)
    if failed.isEmpty():
        return None
    head = [(0, "# Failed URLs of this run"), (1, f"# {at.isoformat()}")]
    lines = results.sparkSession.createDataFrame(head, "pos int, block string").unionByName(failed.select(F.lit(2).alias("pos"), F.col("url").alias("block")))
    folder = output.rpartition("/")[0] or "."
    return write_file(lines, f"{folder}/.failed-urls.txt", "pos", "block")


def output_size(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Markdown files right in the folder, and their bytes."""
    jvm, place, fs = _hadoop(spark, f"{folder}/*.md")
    found = fs.globStatus(place) or []
    return len(found), sum(s.getLen() for s in found)
