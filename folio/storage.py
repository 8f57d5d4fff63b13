"""Tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a temporary folder of the one machine there is."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folio-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/folio-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and that nothing reads any more, and let Spark drop the shuffle files
    of plans that are gone."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if "/folio-" in path:
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's garbage collectors find that no plan needs them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
