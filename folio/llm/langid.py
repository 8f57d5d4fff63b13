"""Language identification: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import given_id, held_id, read_table

#: hashed presence columns for n-grams of 1, 2 and 3 characters
WIDTHS = (1 << 9, 1 << 12, 1 << 14)
PER_LANG = 300
LANDMARKS = 160
RIDGE = 1e-2
BATCH = 256
BLOCK = 1 << 18
SEED = 23


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """The lower-case code of every letter or mark, 32 for other code points; which of them are letters (category L)."""
    out, letter = np.full(sys.maxunicode + 1, 32, np.uint32), np.zeros(sys.maxunicode + 1, np.bool_)
    for c in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(c))[0]
        letter[c] = category == "L"
        if category in "LM":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out, letter


def presence(text: str | None) -> np.ndarray | None:
    """Which hashed n-grams (1 to 3 characters, any non-letter a blank) the whole text has; None without a letter."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes, letter = (table[points] for table in _letters())
    if not letter.any():
        return None
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    out = np.zeros(sum(WIDTHS), np.bool_)
    for a in range(0, len(codes), BLOCK):  # blocks overlap by two characters; memory is bounded
        part = gram = codes[a : a + BLOCK + len(WIDTHS) - 1].astype(np.uint64)
        base = 0
        for n, width in enumerate(WIDTHS):
            if n:
                gram = (gram[:-1] << np.uint64(21)) ^ part[n:]
            h = gram * np.uint64(0x9E3779B97F4A7C15)
            out[base + (h >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)] = True
            base += width
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised blended-spectrum presence kernel of rows with landmarks, one matrix product."""
    a, b = x.astype(np.float32), landmarks.astype(np.float32)
    return (a @ b.T) / np.sqrt(np.maximum(a.sum(1), 1))[:, None] / np.sqrt(np.maximum(b.sum(1), 1))[None, :]


def fit(x: np.ndarray, labels: np.ndarray, n_landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Landmarks (evenly from the labels), weights from kernel values to label scores, and the labels."""
    langs = sorted(set(labels))
    each = max(4, n_landmarks // max(1, len(langs)))
    chosen = np.concatenate([np.flatnonzero(labels == k)[:each] for k in langs])
    marks = x[chosen]
    value, vector = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    mapped = kernel(x, marks) @ root
    wanted = np.where(labels[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    count = np.array([(labels == k).sum() for k in langs])
    balance = (1 / count[np.searchsorted(langs, labels)])[:, None]
    weights = np.linalg.solve(mapped.T @ (balance * mapped) + ridge * np.eye(len(marks)) / len(marks), mapped.T @ (balance * wanted))
    return marks, root @ weights, langs


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [presence(t) for t in pdf["text"]]
        yield pd.DataFrame({"order": pdf["order"], "lang": pdf["lang"], "bits": [None if r is None else np.packbits(r).tobytes() for r in rows]})


def _scorer(marks: bytes, n: int, weights: np.ndarray, langs: list[str]) -> Callable:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        landmarks = np.unpackbits(np.frombuffer(marks, np.uint8).reshape(n, -1), axis=1, count=sum(WIDTHS)).astype(np.float32) if n else None
        for whole in batches:
            for a in range(0, len(whole), BATCH):
                pdf = whole.iloc[a : a + BATCH]
                rows = [presence(t) for t in pdf["text"]]
                lang, top = np.full(len(rows), "und", object), np.zeros(len(rows))
                known = np.array([r is not None for r in rows], bool)
                if known.any() and n:
                    scores = kernel(np.stack([r for r in rows if r is not None]), landmarks) @ weights
                    best = scores.argmax(1)
                    lang[known] = np.array(langs, object)[best]
                    top[known] = np.clip((1 + scores[np.arange(len(best)), best]) / 2, 0, 1)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "held_out": pdf["held_out"].to_numpy(), "lang_pred": lang, "score": top})

    return score


def identify_language(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each row's id, whether it is held out of training, predicted language and score.

    The classifier is fitted on about per_lang labelled rows of each language (1.5 times as many at most), taken by a
    seeded hash of the id from the rows that are not held out; only their packed presence bits reach the driver.
    All rows are scored over their whole texts. Texts that are null or without letters are `und` with score 0, as are
    all where no row is labelled. A row with a null id is not held out, isn't learnt from, and keeps it. Repeated rows give repeated rows. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = docs.select(
        held_id(id_col),
        F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"),
        F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
    )
    labelled = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & given_id().isNotNull())
    # one number a language, of which the model keeps a column of weights each: texts needn't move to be sampled
    counts = labelled.groupBy("lang").count().collect()
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    most = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 1.5 * per_lang / r["count"])]) if counts else F.lit(None).cast("map<string,double>")
    sample = labelled.withColumn("order", uniform).where(F.col("order") < F.element_at(most, F.col("lang")))
    found = sample.select("order", "lang", "text").mapInPandas(_packed, "order double, lang string, bits binary")
    # the least hashes of each language, per_lang of them: a bounded number of rows of fixed size
    pdf = found.where("bits IS NOT NULL").groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("order", "bits"))), 1, per_lang).alias("s"))
    taken = [(x["lang"], r["bits"]) for x in pdf.collect() for r in x["s"]]
    if taken:
        bits = np.stack([np.frombuffer(b, np.uint8) for _, b in taken])
        marks, weights, langs = fit(np.unpackbits(bits, axis=1, count=sum(WIDTHS)), np.array([k for k, _ in taken]), landmarks)
        scorer = _scorer(np.packbits(marks, axis=1).tobytes(), len(marks), weights, langs)
    else:
        scorer = _scorer(b"", 0, np.zeros((0, 0)), [])
    scored = rows.select("doc_id", "held_out", "text").mapInPandas(scorer, "doc_id long, held_out boolean, lang_pred string, score double")
    return scored.withColumn("doc_id", given_id())


def op10_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read_table(spark, sf_dir, "documents"))
