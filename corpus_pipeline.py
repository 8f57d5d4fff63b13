"""The training-data pipeline: quality rules, near-dedup, personal data, source mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Between stages, rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import fresh, materialize, read_table
from folio.llm.mixing import mix_sources
from folio.llm.near_dedup import near_duplicates
from folio.llm.pii import mask
from folio.llm.quality import adaptive_quality
from folio.llm.sp_dropout import default_model, encode_pieces


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their group's adaptive thresholds reject go.

    A verdict goes with id, language, source and text (by a 64-bit hash), so rows without an id or with the same one get
    their own.
    """
    row, own = fresh(docs, "_row"), fresh(docs, "_kept")
    key = F.struct("doc_id", "lang", "source", F.xxhash64("text").alias("text"))
    keyed = docs.withColumn(row, key)
    kept = adaptive_quality(keyed, row).where("kept").select(F.col("doc_id").alias(own))
    same = [F.col(f"{row}.{c}").eqNullSafe(F.col(f"{own}.{c}")) for c in ("doc_id", "lang", "source", "text")]
    return keyed.join(kept, reduce(Column.__and__, same), "left_semi").drop(row)


def _nodes(docs: DataFrame, node: str) -> DataFrame:
    """docs with a number for each pair of id and text: the id itself, where no other text has it.

    Of several texts with one id, one keeps it; the others and those without an id get numbers from 2**62 up, made of a
    hash of 62 bits.
    """
    key, own, least, most = (fresh(docs, c) for c in ("_text_key", "_own", "_least", "_most"))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    texts = keyed.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own)).agg(F.min(key).alias(least), F.max(key).alias(most))
    joined = keyed.join(texts.where(F.col(least) < F.col(most)).drop(most), F.col("doc_id") == F.col(own), "left")
    other = F.lit(2**62) + F.shiftrightunsigned(F.xxhash64("doc_id", key), 2)
    return joined.withColumn(node, F.when(F.col("doc_id").isNull() | (F.col(key) > F.col(least)), other).otherwise(F.col("doc_id"))).drop(key, own, least)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; of rows with the same id (or none) and text, one."""
    node, own = fresh(docs, "_node"), fresh(docs, "_kept")
    rows = _nodes(docs, node)
    kept = near_duplicates(rows, id_col=node).where("kept").select(F.col("doc_id").alias(own))
    return rows.join(kept, F.col(node) == F.col(own), "left_semi").dropDuplicates([node]).drop(node)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows."""
    masked = mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it, rounded to whole copies (0, 1 or 2)."""
    own, n, copy = (fresh(docs, c) for c in ("_mixed", "_copies", "_copy"))
    taken = mix_sources(docs).where("size > 0").select(F.col("doc_id").alias(own), F.expr("(2 * taken + size) div (2 * size)").cast("int").alias(n))
    copies = taken.groupBy(own).agg(F.max(n).alias(n)).where(F.col(n) > 0)
    joined = docs.join(copies, docs["doc_id"].eqNullSafe(copies[own]))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[c] for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, cut with merge-dropout."""
    return encode_pieces(docs, default_model())


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", pieces),
]

#: SQL can't express the last stage; tests hold run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
