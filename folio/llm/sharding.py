"""Sharding by proportional stratified interleaving. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import hex_number, materialize, read_table, running_totals, shuffle_key, source_key

BUCKET_DIGITS = 3


def interleave_shards(docs: DataFrame, n_shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deal all rows into shards whose source mixture matches the whole's.

    Rows are shuffled within their source by a seeded key and ranked; the fractional rank (rank + phase) / rows,
    the phase being a seeded number of the source, spreads each source evenly over [0, 1). Rows sorted by it are
    cut into n_shards runs whose counts differ by one at most (law "rows"). Both rankings go bucket by bucket, so
    a source with a third of all rows is never ordered in one task.

    Null texts have size 1 and the crc32 of no bytes. A null source is a source of its own. Null ids sort as empty.
    Rows that are equal in every column are interchangeable: each gets a slot of its own. An empty table gives no
    rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        source_key(F.col(source_col)).alias("_k"),
        shuffle_key(seed, F.col(id_col)).alias("_h"),
    ).withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    rows = materialize(rows, "shard-rows")
    order = ["_h", "doc_id", "size", "text_crc32"]
    ranked = running_totals(rows, ["_k"], "_b", order, F.lit(1), "_rank", "_n")
    phase = hex_number(shuffle_key(seed, F.col("_k")), 1, 6) / F.lit(float(16**6))
    spread = ranked.withColumn("_f", (F.col("_rank") + phase) / F.col("_n")).withColumn("_g", F.floor(F.col("_f") * 4096))
    placed = running_totals(spread.drop("_b", "_n", "_rank"), [], "_g", ["_f", "_k", *order], F.lit(1), "_pos", "_all")
    shard = F.expr(f"_pos * {n_shards} div _all")
    return placed.withColumn("_shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.expr(f"_pos - (_shard * _all + {n_shards - 1}) div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave_shards(read_table(spark, sf_dir, "documents"))


ORACLE = {
    "op5_stratified_shards": """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), bytes AS (
  SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hx FROM documents
), base AS (
  SELECT doc_id, octet_length(encode(text)) + 1 AS size,
    xor(list_reduce(list_transform(range(octet_length(encode(text))), lambda i: ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) AS text_crc32,
    CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS k,
    md5('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM bytes, crc_table
), ranked AS (
  SELECT *, ((row_number() OVER (PARTITION BY k ORDER BY h, doc_id) - 1)
    + ('0x' || substr(md5('7:' || k), 1, 6))::BIGINT / 16777216.0::DOUBLE) / count(*) OVER (PARTITION BY k) AS f FROM base
), placed AS (
  SELECT *, row_number() OVER (ORDER BY f, k, h, doc_id) - 1 AS pos, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos * 8 // n)::INTEGER AS shard,
  (pos - ((pos * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed"""
}
