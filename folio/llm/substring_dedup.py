"""Exact repeats of 100-byte strings across a corpus, by a suffix sort of the places where repeats can be.

1. Anchors. Every WINDOW-byte string has an anchor: the GRAM-byte string in it with the least hash (the leftmost of
   equals). Equal strings have equal anchors at equal offsets, so only windows whose anchor occurs in another text, or
   twice in one, can repeat. Copies of a whole text are found by digest and stay out.
2. Spans. Windows in a row with the same anchor are one span. Of spans with equal bytes only the first goes on; all
   windows of the others are repeats. A first span goes on if its anchor has spans with other bytes as well.
3. Segments. A span is cut into windows whose offset to the anchor falls into one class of CLASS; these share a core
   of WINDOW - CLASS + 1 bytes, by which they are dealt out. So an anchor that half of all texts have is spread over the
   contexts that it stands in. Of equal segments, again, only the first goes on.
4. Suffix sort. The segments that share a core are laid end to end, and their windows' suffixes are merge-sorted. Two
   suffixes are compared by their common extension, found by binary search over prefix polynomial hashes in
   logarithmic steps. Neighbours with an extension of WINDOW bytes are equal; that is verified byte by byte. Each
   window but the first of its equals is a repeat. A core with more than MOST_SEGMENTS kinds of segments isn't held by
   one worker: its windows are dealt out by their own bytes, and of equal ones, again, only the first isn't a repeat.

Whatever is hot is aggregated before it is dealt out; no step emits pairs.

What is taken on trust: equal 128-bit hashes (xxh3, md5 for whole texts) of spans, segments, windows of large cores and
whole texts stand for equal bytes, and an anchor is shared if two 64-bit hashes of the texts that hold it differ. Equality
that the sort finds is confirmed byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import hashing
from folio.llm.common import discard, read_table, release, shared_path

WINDOW = 100
GRAM = 24
CLASS = 8
CORE = WINDOW - CLASS + 1
NO_DOC = 2**63 - 1
#: kinds of segments of one core that a worker sorts
MOST_SEGMENTS = 4096
#: texts are scanned in blocks of so many windows; places within a block have 20 bits
BLOCK = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_SPREAD = WINDOW - GRAM + 1


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each span of data: first window, number of windows, the anchor's place, the anchor's hash."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for a in range(0, len(data) - WINDOW + 1, BLOCK):
        part = data[a : a + BLOCK + WINDOW - 1]
        p = hashing.prefix(part)
        at = np.arange(len(part) - GRAM + 1)
        h = hashing.mix(hashing.spans(p, at, at + GRAM))
        least, width = h & ~_PLACE | at.astype(np.uint64), 1
        while 2 * width <= _SPREAD:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < _SPREAD:
            least = np.minimum(least[: len(least) - (_SPREAD - width)], least[_SPREAD - width :])
        place = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        for store, x in zip(out, (a + first, np.diff(np.append(first, len(place))), a + place[first], h[place[first]].view(np.int64)), strict=True):
            store.append(x)
    kinds = (np.int64,) * 4
    return tuple(np.concatenate(x) if x else np.empty(0, k) for x, k in zip(out, kinds, strict=True))


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [np.unique(anchors(_bytes(t))[3], return_counts=True) for t in pdf["text"]]
        sizes = [len(a) for a, _ in found]
        if sum(sizes):
            a, n = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            th = np.repeat(pdf["th"].to_numpy(), sizes)
            # an anchor that stands twice in a text counts as another text's as well
            yield pd.DataFrame({"a": np.concatenate([a, a[n > 1]]), "th": np.concatenate([th, ~th[n > 1]])})


def _place_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [anchors(_bytes(t)) for t in pdf["text"]]
        sizes = [len(x[0]) for x in found]
        if sum(sizes):
            start, n, place, a = (np.concatenate([x[k] for x in found]) for k in range(4))
            yield pd.DataFrame({"a": a, "d": np.repeat(pdf["d"].to_numpy(), sizes), "v": np.repeat(pdf["v"].to_numpy(), sizes), "at": start << 16 | n << 8 | (place - start)})


def _digest(data: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(data)
    return (x >> 64) - 2**63, (x & 2**64 - 1) - 2**63


def _span_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for d, v, text, at in zip(pdf["d"], pdf["v"], pdf["text"], pdf["at"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for x in np.unique(at):
                start, n, off = int(x) >> 16, int(x) >> 8 & 255, int(x) & 255
                content = data[start : start + n + WINDOW - 1]
                a = data[start + off : start + off + GRAM]
                # the offset tells apart windows whose anchors stand at other places
                rows.append((*_digest(bytes([off, n]) + content), _digest(a)[0], d, v, start, n, off, content))
        yield pd.DataFrame(rows, columns=["h", "g", "a", "d", "v", "s", "n", "off", "data"])


def _segment_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for d, v, s, n, off, data in zip(*(pdf[c] for c in ("d", "v", "s", "n", "off", "data")), strict=True):
            for c in range((off - n + 1) // CLASS, off // CLASS + 1):
                # windows at offsets c * CLASS .. c * CLASS + CLASS - 1, as far as the span has them
                first, last = max(0, off - c * CLASS - CLASS + 1), min(n - 1, off - c * CLASS)
                seg = data[first : last + WINDOW]
                begin = off - c * CLASS  # where the last window of the class starts; all of the class reach CORE bytes on
                core = data[begin : begin + CORE]
                lead = begin - first
                rows.append((*_digest(bytes([c]) + core), *_digest(bytes([lead, last - first + 1]) + seg), d, v, s + first, last - first + 1, lead, seg))
        yield pd.DataFrame(rows, columns=["ch", "cg", "h", "g", "d", "v", "s", "n", "lead", "data"])


class Suffixes:
    """Suffixes of one text, cut at WINDOW bytes, in order by hash-compared extensions."""

    def __init__(self, text: np.ndarray) -> None:
        self.text, self.p = text, hashing.prefix(text)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes, WINDOW at most, the suffixes at i and j have in common: binary search over hashes."""
        size, step = np.zeros(len(i), np.int64), 1 << (WINDOW.bit_length() - 1)
        while step:
            a, b = i + size, j + size
            fits = size + step <= WINDOW
            ea, eb = np.where(fits, a + step, a), np.where(fits, b + step, b)
            same = fits & (hashing.spans(self.p, a, ea) == hashing.spans(self.p, b, eb))
            size += np.where(same, step, 0)
            step >>= 1
        return size

    def before(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at i stands before the one at j; equal ones do if `ties`."""
        size = self.extension(i, j)
        last = np.minimum(size, WINDOW - 1)
        return np.where(size == WINDOW, ties, self.text[i + last] < self.text[j + last])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of the suffixes at `at`, group by group (groups stand together): a bottom-up, stable mergesort.

        In each round, every element finds its place in the neighbouring run by binary search.
        """
        n = len(at)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, np.int64)
        size = np.diff(np.append(first, n))
        base, count = np.repeat(first, size), np.repeat(size, size)
        rank = np.arange(n) - base
        order, width = np.arange(n), 1
        while width < (size.max() if n else 0):
            run = rank // width
            other = run ^ 1
            lo = np.minimum(other * width, count)
            hi = np.minimum(lo + width, count)
            start, left = lo.copy(), run % 2 == 0
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) // 2
                x, y = at[order[live]], at[order[base[live] + mid]]
                # elements of the left run count those before them, of the right run also their equals
                right = self.before(y, x, ~left[live])
                lo[live] = np.where(right, mid + 1, lo[live])
                hi[live] = np.where(right, hi[live], mid)
                live = live[lo[live] < hi[live]]
            pair = (run // 2) * 2 * width
            new = base + pair + (rank - run * width) + (lo - start)
            moved = np.empty(n, np.int64)
            moved[new] = order
            order, width = moved, 2 * width
        return order

    def same(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal for certain: hashes find them, bytes confirm them."""
        out = self.extension(i, j) == WINDOW
        hit = np.flatnonzero(out)
        steps = np.arange(WINDOW)
        for a in range(0, len(hit), 1 << 16):
            k = hit[a : a + (1 << 16)]
            out[k] = (self.text[i[k][:, None] + steps] == self.text[j[k][:, None] + steps]).all(1)
        return out


def repeated_windows(segments: list[bytes], group: np.ndarray, lead: np.ndarray, count: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each segment (with `count` windows, the first at `lead` before the core) a mask of windows that repeat.

    order: the segments' places in the corpus, by rank. Windows are compared within one group and offset.
    """
    sizes = np.array([len(s) for s in segments])
    text = np.frombuffer(b"".join(segments), np.uint8)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(segments)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    offset = lead[owner] - k
    at = begin[owner] + k
    by = np.lexsort((order[owner], offset, group[owner]))
    joint = group[owner][by] * np.int64(4 * CLASS) + offset[by]
    suffixes = Suffixes(text)
    got = by[suffixes.sort(at[by], joint)]
    # stable: of equal suffixes the one that comes first in the corpus stands first
    head, tail = got[:-1], got[1:]
    alike = (group[owner[head]] == group[owner[tail]]) & (offset[head] == offset[tail])
    pairs = np.flatnonzero(alike)
    alike[pairs] = suffixes.same(at[head[pairs]], at[tail[pairs]])
    mask = np.zeros(len(owner), np.bool_)
    mask[tail[alike]] = True
    return mask


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of the runs of set places."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _sorted_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments in order of their cores; what belongs to one core is sorted at once, many cores in a go."""

    def done(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby(["ch", "cg"], sort=False).ngroup().to_numpy(np.int64)
        order = np.empty(len(pdf), np.int64)
        order[np.lexsort((pdf["s"], pdf["v"], pdf["d"]))] = np.arange(len(pdf))
        count = pdf["n"].to_numpy(np.int64)
        mask = repeated_windows(list(pdf["data"]), group, pdf["lead"].to_numpy(np.int64), count, order)
        parts = np.split(mask, np.cumsum(count)[:-1])
        rows = [(d, v, s + a, s + b + WINDOW) for d, v, s, m in zip(pdf["d"], pdf["v"], pdf["s"], parts, strict=True) for a, b in _runs(m)]
        return pd.DataFrame(rows, columns=["d", "v", "b", "e"])

    kept: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        # the last core may go on in the next batch
        last = (pdf["ch"] == pdf["ch"].iloc[-1]) & (pdf["cg"] == pdf["cg"].iloc[-1])
        if last.all():
            kept.append(pdf)
            if len(kept) > 1 and (kept[0]["ch"].iloc[0], kept[0]["cg"].iloc[0]) != (pdf["ch"].iloc[0], pdf["cg"].iloc[0]):
                yield done(pd.concat(kept[:-1]))
                kept = [pdf]
            continue
        yield done(pd.concat([*kept, pdf[~last]]))
        kept = [pdf[last]]
    if kept:
        yield done(pd.concat(kept))


def _final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for d, text, copy, ranges in zip(*(pdf[c] for c in ("d", "text", "copy", "ranges")), strict=True):
            data = _bytes(text)
            cover = np.zeros(len(data) + 1, np.int64)
            for x in [{"b": 0, "e": len(data)}] if copy else ranges if ranges is not None else ():
                cover[x["b"]] += 1
                cover[x["e"]] -= 1
            gone = np.cumsum(cover[: len(data)]) > 0
            rows.append((d, len(data), int(gone.sum()), len(_runs(gone)), hashlib.sha256(data[~gone].tobytes()).hexdigest()))
        yield pd.DataFrame(rows, columns=["d", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """As common.materialize, packed closer; the shuffle files of what was written go at once, not some time later."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def _firsts(rows: DataFrame, keys: list[str], *carried: str) -> DataFrame:
    """Of rows with equal keys, the first place in the corpus, and whether there are others."""
    place = F.struct("d", "v", "s")
    found = rows.groupBy(*keys).agg(F.min(place).alias("first"), (F.min(place) != F.max(place)).alias("many"), *[F.first(c).alias(c) for c in carried])
    return materialize(found, "firsts")


def _later(rows: DataFrame, firsts: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges of the rows that have an equal earlier in the corpus."""
    found = rows.join(firsts.where("many").select(*keys, "first"), keys).where("d <> first.d OR v <> first.v OR s <> first.s")
    return materialize(found.select("d", "v", F.col("s").alias("b"), (F.col("s") + F.col("n") + (WINDOW - 1)).alias("e")), "ranges")


def _leading(rows: DataFrame, firsts: DataFrame, group: list[str]) -> DataFrame:
    """The first of equal rows, where their group has rows with other keys too. Rows' bytes are dealt out once.

    Groups are counted in a table of their own, so that the join after it can split a hot group.
    """
    several = materialize(firsts.groupBy(*group).agg(F.count("*").alias("_n")).where("_n > 1").select(*group), "several")
    places = firsts.join(several, group).select("first.d", "first.v", "first.s")
    return rows.join(materialize(places, "leading"), ["d", "v", "s"], "left_semi")


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for d, v, s, n, lead, data in zip(*(pdf[c] for c in ("d", "v", "s", "n", "lead", "data")), strict=True):
            # the place of the core tells apart windows of other anchors, as a segment's does
            rows += [(*_digest(bytes([lead - k]) + data[k : k + WINDOW]), d, v, s + k, 1) for k in range(n)]
        yield pd.DataFrame(rows, columns=["h", "g", "d", "v", "s", "n"])


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its bytes, how many of them repeat an earlier WINDOW-byte string, in how many runs, and the digest of
    the rest.

    Documents are ordered by id, null ids last; rows that share an id are ordered by their texts' hashes, and rows
    equal in both are one document, with the same result. Null texts are empty. Texts under WINDOW bytes have no
    repeats. An empty table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        # null ids come last
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_DOC)).alias("d"),
        F.xxhash64(text).alias("th"),
        text.alias("text"),
    )
    digests = materialize(rows.select("d", "th", F.when(F.octet_length("text") >= WINDOW, F.md5(F.col("text").cast("binary"))).alias("md5")), "digests")
    # v tells apart rows that share an id; where none do, it needs no room
    alone = digests.groupBy("d").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo < hi").isEmpty()
    version = F.lit(0).cast("long") if alone else F.col("th")
    rows = rows.withColumn("v", version)
    digests_v = digests.where("md5 IS NOT NULL").withColumn("v", version)
    # copies of whole texts
    original = materialize(digests_v.groupBy("md5").agg(F.min(F.struct("d", "v")).alias("o"), F.max(F.struct("d", "v")).alias("_l")).where("o <> _l").select("md5", "o"), "originals")
    copies = digests_v.join(original, "md5").where("d <> o.d OR v <> o.v").select("d", "v").distinct()
    copies = materialize(copies, "copies")
    discard(digests, original)
    # anchors of more than one text, or twice in one
    seen = rows.select("th", "text").mapInPandas(_anchor_rows, "a long, th long")
    shared = seen.groupBy("a").agg(F.min("th").alias("lo"), F.max("th").alias("hi")).where("lo < hi").select("a")
    shared = materialize(shared, "shared-anchors")
    places = rows.select("d", "v", "text").mapInPandas(_place_rows, "a long, d long, v long, at long").join(shared, "a", "left_semi")
    noted = places.groupBy("d", "v").agg(F.collect_list("at").alias("at")).join(copies, ["d", "v"], "left_anti")
    noted = materialize(noted, "places")
    discard(shared)
    spans = rows.join(noted, ["d", "v"]).dropDuplicates(["d", "v"]).select("d", "v", "text", "at")
    spans = materialize(spans.mapInPandas(_span_rows, "h long, g long, a long, d long, v long, s long, n int, off int, data binary"), "spans")
    discard(noted)
    firsts = _firsts(spans.select("h", "g", "a", "d", "v", "s"), ["h", "g"], "a")
    gone = [_later(spans.select("h", "g", "d", "v", "s", "n"), firsts, ["h", "g"])]
    leading = _leading(spans.select("d", "v", "s", "n", "off", "data"), firsts, ["a"])
    segments = leading.mapInPandas(_segment_rows, "ch long, cg long, h long, g long, d long, v long, s long, n int, lead int, data binary")
    segments = materialize(segments, "segments")
    discard(spans, firsts)
    # most cores stand in one place only
    cores = materialize(segments.groupBy("ch", "cg").agg(F.count("*").alias("_n")).where("_n > 1").select("ch", "cg"), "cores")
    contested = materialize(segments.join(cores, ["ch", "cg"], "left_semi"), "contested")
    discard(segments, cores)
    keys = ["ch", "cg", "h", "g"]
    firsts = _firsts(contested.select(*keys, "d", "v", "s"), keys)
    gone.append(_later(contested.select(*keys, "d", "v", "s", "n"), firsts, keys))
    sizes = materialize(firsts.groupBy("ch", "cg").agg(F.count("*").alias("kinds")).where("kinds > 1"), "core-sizes")
    # a span has several segments at one place, so the core is part of the key
    wanted = firsts.join(sizes, ["ch", "cg"]).select(*keys, "first.d", "first.v", "first.s", "kinds")
    leading = contested.join(wanted, [*keys, "d", "v", "s"])
    ordered = leading.where(F.col("kinds") <= MOST_SEGMENTS).select("ch", "cg", "d", "v", "s", "n", "lead", "data").repartition("ch", "cg").sortWithinPartitions("ch", "cg")
    gone.append(materialize(ordered.mapInPandas(_sorted_rows, "d long, v long, b long, e long"), "ranges"))
    if not sizes.where(F.col("kinds") > MOST_SEGMENTS).isEmpty():
        windows = leading.where(F.col("kinds") > MOST_SEGMENTS).select("d", "v", "s", "n", "lead", "data")
        windows = materialize(windows.mapInPandas(_window_rows, "h long, g long, d long, v long, s long, n int"), "windows")
        gone.append(_later(windows, _firsts(windows.select("h", "g", "d", "v", "s"), ["h", "g"]), ["h", "g"]))
    discard(contested, firsts)
    ranges = reduce(DataFrame.unionByName, gone).groupBy("d", "v").agg(F.collect_list(F.struct("b", "e")).alias("ranges"))
    notes = ranges.withColumn("copy", F.lit(False)).unionByName(copies.select("d", "v", F.lit(None).cast("array<struct<b:bigint,e:bigint>>").alias("ranges"), F.lit(True).alias("copy")))
    last = rows.join(notes, ["d", "v"], "left").select("d", "text", "copy", "ranges")
    final = last.mapInPandas(_final, "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return final.select(F.when(F.col("d") != NO_DOC, F.col("d")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(read_table(spark, sf_dir, "documents"))
