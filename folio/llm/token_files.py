"""Token-id files: segments of whole documents, coded in checksummed blocks that share one model per segment.

A segment (one binary value, little-endian):
  "FSEG" | version u32 | documents u32 | blocks u32 | doc ids i64 each | ids per document u32 each | blocks
A block: ids u32 | coded bytes u32 | crc32 of the ids as u32 each | crc32 of the coded bytes | coded bytes
Segments are rows (part, place, first_doc, n_ids, data) of a table in the shared folder; in (part, place) order their
documents ascend.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import range_coder
from folio.llm.common import claim, given_id, held_id, read_table, running_totals, shared_path

MAGIC, VERSION = b"FSEG", 2
BLOCK_IDS = 2048
SEGMENT_IDS = 1 << 23
END_ID = 2
MOST_WORDS = 900_000
#: texts encoded at once: at most so many, and so many bytes or one text
BATCH_TEXTS, BATCH_BYTES = 2048, 1 << 24
#: bytes of the longest piece that is cut into units
LONGEST_CUT = 256
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_OF_UNITS = rf"\A ?[{_LETTER}0-9{_MARK}]+(?:\n[{_LETTER}0-9{_MARK}]+)*\z"
_UNIT = rf"( ?[{_LETTER}]+| ?[0-9]+| ?[{_MARK}]+|\n)"
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: the characters by which byte-level vocabularies spell bytes
_BYTE_LEVEL = {b: chr(b) if b in _SHOWN else chr(256 + sum(x not in _SHOWN for x in range(b))) for b in range(256)}
_HEAD, _BLOCK = struct.Struct("<4sIII"), struct.Struct("<IIII")


def _gathered(ids: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """ids[a : a + n] of each start a and number n, one after the other."""
    upto = np.cumsum(many)
    return ids[np.repeat(start - upto + many, many) + np.arange(many.sum())]


class Encoder:
    """A byte-level BPE tokenizer with a bounded cache of words.

    Byte-level BPE never joins across a single space between two other characters, so a text is cut there and each
    distinct piece goes through the tokenizer once. A text with any other run of white space beside a space, or with
    an added token's own spelling in it, is encoded whole. Ids have 16 bits in the files, so a tokenizer with more is refused.

    Where the tokenizer has the common byte-level pattern and nothing else around its model, a piece of Latin letters,
    digits and ASCII marks but the apostrophe is cut as that pattern does, and goes to the model at once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if (size := self.tokenizer.get_vocab_size()) > range_coder.MOST_IDS:
            raise ValueError(f"a tokenizer of {size} ids; token files hold {range_coder.MOST_IDS}")
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        plain = not any(spec[x] for x in ("normalizer", "post_processor", "truncation", "padding"))
        self.by_model = plain and before.get("type") == "ByteLevel" and before.get("use_regex") is True and before.get("add_prefix_space") is False
        self.forget()

    def forget(self) -> None:
        # a word after a space stands under itself, a text's first word under itself with a space before it; the numbers
        # of words are from 1
        self.known: dict[str, int] = {}
        self.start, self.many, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(pieces), 512):
            out += [np.array(x.ids, np.uint16).tobytes() for x in self.tokenizer.encode_batch_fast(pieces[a : a + 512], add_special_tokens=False)]
        return out

    def _keep(self, words: list[str], many: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.many), len(self.many) + len(words)), strict=True))
        self.start = np.append(self.start, len(self.ids) + np.cumsum(many) - many)
        self.many = np.append(self.many, many)
        self.ids = np.append(self.ids, ids)

    def _keep_coded(self, words: list[str], coded: list[bytes]) -> None:
        self._keep(words, np.fromiter(map(len, coded), np.int64, len(coded)) // 2, np.frombuffer(b"".join(coded), np.uint16))

    def _by_units(self, words: list[str], pieces: pa.Array) -> None:
        """Remember these pieces, and the units that they are cut into, which are words too."""
        parts = pc.split_pattern(pc.utf8_rtrim(pc.replace_substring_regex(pieces, _UNIT, "\\1\t"), "\t"), "\t")
        coded = parts.flatten().dictionary_encode()
        units, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        keys, known = [u[1:] if u[0] == " " else " " + u for u in units], self.known
        if new := [u for u, key in zip(units, keys, strict=True) if key not in known]:
            tokenize = self.tokenizer.model.tokenize
            # a text of a byte a character, each shown as the vocabulary spells it; none of the units holds a tab
            spelt = "\t".join(new).encode().decode("latin-1").translate(_BYTE_LEVEL).split(_BYTE_LEVEL[9])
            got = [array("H", [x.id for x in tokenize(y)]).tobytes() for y in spelt]
            self._keep_coded([key for key in keys if key not in known], got)
        sizes = pc.list_value_length(parts).to_numpy()
        several = sizes > 1
        number = np.fromiter([known[key] for key in keys], np.int64, len(keys))[codes[np.repeat(several, sizes)]]
        many = self.many[number]
        ends = np.append(0, np.cumsum(many))[np.append(0, np.cumsum(sizes[several]))]
        self._keep([words[k] for k in np.flatnonzero(several).tolist()], np.diff(ends), _gathered(self.ids, self.start[number], many))

    def _learn(self, words: list[str], given: list[str]) -> None:
        """Remember the ids of these pieces under these words."""
        pieces, fit = pa.array(given, pa.large_string()), np.zeros(len(given), bool)
        if self.by_model:
            fit = pc.match_substring_regex(pieces, _OF_UNITS).to_numpy(zero_copy_only=False) & (pc.binary_length(pieces).to_numpy() <= LONGEST_CUT)
            self._by_units([words[k] for k in np.flatnonzero(fit).tolist()], pieces.filter(pa.array(fit)))
        others = np.flatnonzero(~fit).tolist()
        self._keep_coded([words[k] for k in others], self._encode([given[k] for k in others]))

    def __call__(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        if len(self.known) > MOST_WORDS or len(self.ids) > 8 * MOST_WORDS:
            self.forget()
        texts = pa.array(texts, pa.large_string())
        if not len(texts):
            return []
        parts = pc.split_pattern(texts, " ")
        sizes = pc.list_value_length(parts).to_numpy()
        first = np.cumsum(sizes) - sizes
        flat = parts.flatten()
        coded = flat.dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        codes[first] = len(words) + np.arange(len(texts))
        bare = words + flat.take(pa.array(first)).to_pylist()
        after = len(words)
        words += [" " + w for w in bare[after:]]
        whole = np.zeros(len(texts), bool)
        for x in self.added:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        number = np.fromiter([self.known.get(w, 0) for w in words], np.int32, len(words))
        new = number == 0
        apart = np.zeros(len(words), bool)
        for k in np.flatnonzero(new).tolist():
            apart[k] = not bare[k] or bare[k] != bare[k].strip()
        if apart.any():
            whole |= np.add.reduceat(apart[codes], first, dtype=np.int64) > 0
        if whole.any():
            codes = codes[np.repeat(~whole, sizes)]
            sizes = np.where(whole, 0, sizes)
        new &= np.bincount(codes, minlength=len(words)) > 0
        if new.any():
            at = np.flatnonzero(new).tolist()
            pieces = {words[k]: " " + bare[k] if k < after else bare[k] for k in at}
            self._learn([*pieces], [*pieces.values()])
            number[at] = [self.known[words[k]] for k in at]
        start, many = self.start[number][codes], self.many[number][codes]
        out = np.split(_gathered(self.ids, start, many), np.append(0, np.cumsum(many))[np.cumsum(sizes)[:-1]])
        at = np.flatnonzero(whole)
        for k, got in zip(at.tolist(), self._encode(texts.take(pa.array(at)).to_pylist()), strict=True):
            out[k] = np.frombuffer(got, np.uint16)
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack_segment(doc_ids: list[int], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate([*docs, np.empty(0, np.uint16)])
    blocks = [ids[a : a + BLOCK_IDS] for a in range(0, len(ids), BLOCK_IDS)]
    out = [_HEAD.pack(MAGIC, VERSION, len(docs), len(blocks)), np.array(doc_ids, "<i8").tobytes(), np.array([len(d) for d in docs], "<u4").tobytes()]
    for block, coded in zip(blocks, range_coder.encode(blocks), strict=True):
        out += [_BLOCK.pack(len(block), len(coded), crc_of_ids(block), zlib.crc32(coded)), coded]
    return b"".join(out)


def unpack_segment(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """Doc ids and each document's ids; raises ValueError where a checksum fails."""
    magic, version, n_docs, n_blocks = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this version")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    sizes = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 12 * n_docs
    heads, coded = [], []
    for _ in range(n_blocks):
        heads.append(_BLOCK.unpack_from(data, at))
        at += _BLOCK.size
        coded.append(data[at : at + heads[-1][1]])
        at += heads[-1][1]
    if any(zlib.crc32(c) != h[3] for h, c in zip(heads, coded, strict=True)):
        raise ValueError("a block's coded bytes fail their checksum")
    blocks = range_coder.decode(coded, [h[0] for h in heads])
    if any(crc_of_ids(b) != h[2] for h, b in zip(heads, blocks, strict=True)):
        raise ValueError("a block's ids fail their checksum")
    ids = np.concatenate([*blocks, np.empty(0, np.uint16)])
    return doc_ids, np.split(ids, np.cumsum(sizes)[:-1]) if n_docs else []


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut rows of these many bytes into runs that are encoded at once."""
    upto, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BATCH_BYTES, "right"))
        b = max(min(b, a + BATCH_TEXTS), a + 1)
        yield a, b
        a = b


def _segments(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, names, docs, held = TaskContext.get().partitionId(), 0, [], [], 0
        claim("token_files", encoder.cache_clear)
        encode = encoder(path)

        def flush() -> pa.RecordBatch:
            row = {"part": part, "place": place, "n_ids": held, "data": pack_segment(names, docs)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("place", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            texts = batch.column("text").fill_null("")
            for a, b in _runs(pc.binary_length(texts).to_numpy()):
                for name, ids in zip(batch.column("doc_id")[a:b].to_pylist(), encode(texts[a:b]), strict=True):
                    names.append(name)
                    docs.append(np.append(ids, np.uint16(end_id)))
                    held += len(ids) + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
                        place, names, docs, held = place + 1, [], [], 0
        if names:
            yield flush()

    return write


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    claim("token_files", encoder.cache_clear)
    for pdf in batches:
        for part, place, data in zip(pdf["part"], pdf["place"], pdf["data"], strict=True):
            names, docs = unpack_segment(data)
            sizes = np.array([len(d) for d in docs], np.int64)
            yield pd.DataFrame(
                {
                    "part": part,
                    "place": place,
                    "doc_id": names,
                    "within": np.cumsum(sizes) - sizes,
                    "n_tokens": sizes,
                    "ids_crc32": [crc_of_ids(d) for d in docs],
                }
            )


def write_token_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id, and write segments in ascending id order to the table `out`.

    Null and empty texts are the end id alone. Rows that repeat an id follow each other in any order. Rows with a null
    id come first (kept under the least 64-bit number) and are null again when read. An empty table
    gives an empty table of segments. Other columns are ignored.
    """
    rows = docs.select(held_id(id_col), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(_segments(tokenizer, end_id), "part int, place int, n_ids long, data binary").write.parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the files; start counts the ids of all documents before.

    Ids that were null are null again, and first; an empty table of segments gives no rows. A block or its coded bytes
    that fail their checksum raise ValueError.
    """
    segments = spark.read.parquet(path)
    offsets = running_totals(segments.select("part", "place", "n_ids"), [], "part", ["place"], F.col("n_ids"), "_before", "_all").select("part", "place", "_before")
    rows = segments.select("part", "place", "data").mapInPandas(_documents, "part int, place int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(offsets, ["part", "place"]).select(given_id(), (F.col("_before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    out = shared_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), out, tokenizer)
    return read_token_files(spark, out)
