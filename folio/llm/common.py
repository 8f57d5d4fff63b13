"""What the training-data operators share: shared-folder tables, keys and distributed running totals."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.storage import discard, materialize, release, shared_path

__all__ = ["claim", "discard", "fresh", "given_id", "held_id", "hex_number", "materialize", "read_table", "release", "running_totals", "shared_path", "shuffle_key", "source_key"]

SPACE = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict[str, Callable[[], None]] = {}


def claim(operator: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called by each operator's functions in a Python worker: what other operators remember there is forgotten.

    Spark hands workers on from stage to stage, so without this the caches of all stages add up in each of them.
    `forget` empties this operator's own, once another one claims the worker.
    """
    if others := [x for x in _kept if x != operator]:
        import pyarrow as pa

        for x in others:
            _kept.pop(x)()
        gc.collect()
        pa.default_memory_pool().release_unused()
    _kept[operator] = forget


NO_ID = -(2**63)


def held_id(col: str) -> Column:
    """The id, with the least 64-bit number for null: pandas would make floating-point numbers of ids beside nulls."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID)).alias("doc_id")


def given_id(col: str = "doc_id") -> Column:
    """The id that held_id holds."""
    return F.when(F.col(col) != NO_ID, F.col(col)).alias("doc_id")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def source_key(source: Column) -> Column:
    """A null-free key that sorts as the source does by code point, nulls last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def shuffle_key(seed: int, *cols: Column) -> Column:
    """A seeded uniform key (md5, hexadecimal) that any SQL engine can recompute."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hex_number(key: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(key, start, digits), 16, 10).cast("long")


def running_totals(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, out: str, total: str) -> DataFrame:
    """Add `out`, the sum of `value` over the rows of the same keys before this one in (bucket, *order), and `total`.

    Sums per (keys, bucket) are aggregated map-side and accumulated over the few buckets; rows only meet the rows
    of their own bucket, so no key, however hot, is ordered in one task. `bucket` has to grow with `order`.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    upto = W.partitionBy(*keys).orderBy(bucket) if keys else W.orderBy(bucket)
    whole = W.partitionBy(*keys) if keys else W.partitionBy()
    offsets = sums.select(
        *keys,
        bucket,
        F.coalesce(F.sum("_sum").over(upto.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(whole).alias(total),
    )
    within = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = df.join(offsets, [*keys, bucket])
    return joined.withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_offset")
