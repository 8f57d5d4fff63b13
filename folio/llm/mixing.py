"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import SPACE, materialize, read_table, running_totals, shuffle_key, source_key

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 1024
LEAST_BLOCKS = 256
CELLS = 4096
#: 2^31 and the odd number nearest 2^31 / golden ratio: i * STEP mod MODULUS visits [0, MODULUS) evenly
MODULUS, STEP = 2**31, 1327217885
SEGMENT = 4096


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source (_k, source_size) gets its weight, target and block length.

    Targets are min(weight * level, MOST * size) with the one level at which they add up to SHARE of all sizes:
    what repeated resharing of the excess ends in. Sources ordered by cap / weight fill up first to last.
    """
    ranked = sizes.withColumn("_r", F.row_number().over(W.orderBy("_k")) - 1)
    weighed = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_r") % len(WEIGHTS) + 1).cast("int")))
    capped = weighed.withColumn("_cap", (MOST * F.col("source_size")).cast("double"))
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), "_k")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (SHARE * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    levels = capped.withColumn("_level", level)
    # the level holds from the first source on whose cap it doesn't reach; those before are at their caps
    open_ = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_k", "_level"))).over(W.partitionBy())
    return levels.select(
        "_k",
        "source_size",
        F.least(F.col("_cap"), F.col("_w") * open_["_level"]).alias("target"),
        F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.ceil(F.col("source_size") / LEAST_BLOCKS))).cast("long").alias("_len"),
    )


def schedule(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """The slots (slot, _k, rank, block, pass): which block of which source comes when.

    Slot i has the golden-ratio point i * STEP mod MODULUS; the sources' weights (target / mean block length), laid
    end to end over [0, MODULUS), say whose slot it is. A source's slots are ranked in slot order and go through its
    blocks in turn, so a source's run of slots is within a few blocks of its share at any time. Slots beyond the
    source's MOST passes are left out.
    """
    blocks = F.ceil(F.col("source_size") / F.col("_len"))
    weighed = targets.where(F.col("source_size") > 0).withColumn("_blocks", blocks).withColumn("_p", F.col("target") * F.col("_blocks") / F.col("source_size"))
    cum = weighed.withColumn("_to", F.sum("_p").over(W.orderBy("_k"))).withColumn("_sum", F.sum("_p").over(W.partitionBy()))
    spans = cum.select(
        "_k",
        "_blocks",
        F.coalesce(F.lag(F.round(F.col("_to") / F.col("_sum") * MODULUS).cast("long")).over(W.orderBy("_k")), F.lit(0)).alias("_lo"),
        F.round(F.col("_to") / F.col("_sum") * MODULUS).cast("long").alias("_hi"),
    )
    cell = MODULUS // CELLS
    celled = spans.where(F.col("_hi") > F.col("_lo")).withColumn("_cell", F.explode(F.sequence(F.expr(f"_lo div {cell}"), F.expr(f"(_hi - 1) div {cell}"))))
    n_slots = cum.agg(F.coalesce(F.round(F.max("_sum")), F.lit(0)).cast("long")).first()[0]
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(f"(id % {MODULUS}) * {STEP} % {MODULUS}").alias("_x"))
    slots = slots.withColumn("_cell", F.expr(f"_x div {cell}")).withColumn("_segment", F.expr(f"slot div {SEGMENT}"))
    dealt = slots.join(celled, "_cell").where("_x >= _lo AND _x < _hi").select("slot", "_segment", "_k", "_blocks")
    ranked = running_totals(dealt, ["_k"], "_segment", ["slot"], F.lit(1), "rank", "_slots")
    passed = ranked.withColumn("block", F.col("rank") % F.col("_blocks")).withColumn("pass", F.expr("rank div _blocks"))
    return passed.where(F.col("pass") < MOST).select("slot", "_k", "rank", "block", "pass")


def mix_sources(docs: DataFrame, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document a mix of all sources takes, repeats counted.

    Within a source, documents are shuffled by a seeded key and laid end to end; their words are cut into blocks of
    one length (BLOCK words, shorter in sources with under LEAST_BLOCKS such blocks, so that a block stays a small
    part of the source; the last may be short). `schedule` says how often each block is taken. A document takes its
    words in those blocks as often; never more than MOST times its size.

    Null and empty texts have size 0 and take 0. A null source is a source of its own, last in order. Rows that are
    equal in every column are interchangeable. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.size(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")).cast("long").alias("size"),
        source_key(F.col(source_col)).alias("_k"),
        shuffle_key(seed, F.col(id_col)).alias("_h"),
    ).withColumn("_b", F.substring("_h", 1, 3))
    rows = materialize(rows, "mix-rows")
    targets = materialize(source_targets(rows.groupBy("_k").agg(F.sum("size").alias("source_size"))), "mix-targets")
    times = schedule(spark, targets).groupBy("_k", "block").agg(F.count("*").alias("_times"))
    placed = running_totals(rows, ["_k"], "_b", ["_h", "doc_id", "size"], F.col("size"), "_at", "_total")
    placed = materialize(placed.withColumn("_id", F.monotonically_increasing_id()).select("_id", "doc_id", "size", "_k", "_at"), "mix-placed")
    sized = placed.join(targets, "_k")
    pieces = sized.where("size > 0").withColumn("block", F.explode(F.expr("sequence(_at div _len, (_at + size - 1) div _len)")))
    cut = F.expr("least(_at + size, (block + 1) * _len) - greatest(_at, block * _len)")
    taken = pieces.select("_id", "_k", "block", cut.alias("_cut")).join(times, ["_k", "block"]).groupBy("_id").agg(F.sum(F.col("_cut") * F.col("_times")).alias("_taken"))
    return sized.join(taken, "_id", "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("_taken", F.lit(0)).alias("taken"),
    )


def op6_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


ORACLE = {
    "op6_golden_mix": rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS k, md5('11:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), sizes AS (
  SELECT k, sum(size)::BIGINT AS ss, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM base GROUP BY k
), filling AS (
  SELECT *, 2.0::DOUBLE * ss AS cap, (1.5::DOUBLE * sum(ss) OVER () - coalesce(sum(2.0::DOUBLE * ss) OVER (ORDER BY 2.0::DOUBLE * ss / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2.0::DOUBLE * ss / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sizes
), targets AS (
  SELECT k, ss, least(cap, w * (SELECT arg_min(level, cap / w) FROM filling WHERE level * w <= cap)) AS target,
    greatest(1, least({BLOCK}, ceil(ss / {LEAST_BLOCKS}::DOUBLE)))::BIGINT AS blen FROM filling
), weighed AS (
  SELECT *, target * nb / ss AS p FROM (SELECT *, ceil(ss / blen::DOUBLE)::BIGINT AS nb FROM targets WHERE ss > 0)
), cum AS (
  SELECT *, round(sum(p) OVER (ORDER BY k) / sum(p) OVER () * {MODULUS})::BIGINT AS hi, sum(p) OVER () AS total FROM weighed
), spans AS (
  SELECT *, coalesce(lag(hi) OVER (ORDER BY k), 0) AS lo FROM cum
), slots AS (
  SELECT i, i % {MODULUS} * {STEP} % {MODULUS} AS x FROM (SELECT unnest(range((SELECT round(max(total))::BIGINT FROM cum))) AS i)
), ranked AS (
  SELECT k, nb, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS r FROM slots JOIN spans ON x >= lo AND x < hi
), times AS (
  SELECT k, r % nb AS block, count(*) AS times FROM ranked WHERE r // nb < {MOST} GROUP BY ALL
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM base
), pieces AS (
  SELECT doc_id, size, a, k, blen, unnest(range(a // blen, (a + size - 1) // blen + 1)) AS block FROM placed JOIN targets USING (k) WHERE size > 0
), taken AS (
  SELECT doc_id, sum((least(a + size, (block + 1) * blen) - greatest(a, block * blen)) * times) AS taken FROM pieces JOIN times USING (k, block) GROUP BY doc_id
)
SELECT doc_id, size, ss AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM base JOIN targets USING (k) LEFT JOIN taken USING (doc_id)"""
}
