"""SentencePiece BPE with seeded merge-dropout, and its lossless decoding.

The model file's pieces and scores are read through the sentencepiece library; segmentation is this module's own. A
text is cut into units (a run of spaces and the letters or other characters behind it): it is checked that no piece of
the model reaches over such a border, so each unit is segmented alone. A unit's agenda holds candidate merges by score,
then place; each candidate taken from it is skipped with the dropout's probability. Which ones are, counted in the order
taken, is drawn for each occurrence: gaps between skips come from the keyed hash of (seed, row, the unit's ordinal),
where a row is its id, its text and its number among equal rows. So every occurrence is cut on its own, and each rerun
cuts it the same way. A cache holds segmentations by unit and skips, never by unit alone; the occurrences of a batch of
texts look theirs up together, as numpy vectors.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import claim, given_id, held_id, read_table

BLANK = "▁"
DROPOUT = 0.1
SEED = 31
#: of a worker's cache, which is emptied beyond them: nodes, and ids that these have
MOST_NODES, MOST_POOL = 400_000, 1 << 22
#: units that are cut in one go
AT_ONCE = 1 << 17
#: up to here units are cached, and new ones segmented in lockstep, ROWS at a time; MOST_SKIPS: no agenda is that long
LONG_UNIT, ROWS, MOST_SKIPS = 64, 4096, 192
NO_RANK = 2**31 - 1
M64, M32 = 2**64 - 1, 2**32 - 1
#: odd constants of the SplitMix64 generator
_STEP, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: of XXH3 for inputs of 8 bytes: two words of its secret, one upon the other, and its multiplier
_SECRET, _RRMXMX = 0x1CAD21F72C81017C ^ 0xDB979083E96DD4DE, 0x9FB21C651E98DF25
#: up to here the agenda is a plain list
SHORT_UNIT = 32
#: whole words; `fine_units` cuts further
_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def fine_units(pieces: list[str]) -> re.Pattern:
    """Letters apart from all else; what the pieces hold of numerals like a superscript two counts as the latter."""
    other = re.escape("".join(sorted({c for p in pieces for c in p if re.match(r"[^\W\d_]", c) and not c.isalpha()})))
    return re.compile(rf"{BLANK}*[^\W\d_{other}]+|{BLANK}*(?:[\d_{other}]|[^\w{BLANK}])+|{BLANK}+")


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's output function."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(_MIX1)
    x = (x ^ x >> np.uint64(27)) * np.uint64(_MIX2)
    return x ^ x >> np.uint64(31)


def drawn(keys: np.ndarray, seed: int) -> np.ndarray:
    """Upper halves of the keys' XXH3 hashes (of 64 bits, little-endian) with a seed below 2**32."""
    flip = (_SECRET - (seed | int.from_bytes(seed.to_bytes(4, "little"), "big") << 32)) & M64
    h = (keys >> np.uint64(32) | keys << np.uint64(32)) ^ np.uint64(flip)
    h ^= (h << np.uint64(49) | h >> np.uint64(15)) ^ (h << np.uint64(24) | h >> np.uint64(40))
    h *= np.uint64(_RRMXMX)
    h ^= (h >> np.uint64(35)) + np.uint64(8)
    h *= np.uint64(_RRMXMX)
    return (h ^ h >> np.uint64(28)) >> np.uint64(32)


def bits(marks: bytes) -> int:
    """Bit k is set if marks[k] is a one."""
    return int.from_bytes(np.packbits(np.frombuffer(marks, np.uint8) == 49, bitorder="little").tobytes(), "little")


class Model:
    """Pieces, merges and a bounded cache of segmented units."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        plain = [p for p, ok in zip(pieces, normal, strict=True) if ok]
        fitting = [u for u in (fine_units(plain), _WORDS) if all(map(u.fullmatch, plain))]
        if not fitting:
            raise ValueError("a piece of this model reaches over a word's border")
        self.units = fitting[0]
        self.ids = {p: i for i, (p, ok) in enumerate(zip(pieces, normal, strict=True)) if ok}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        back = {i: b for b, i in self.bytes.items()}
        self.data = [bytes([back[i]]) if i in back else p.replace(BLANK, " ").encode() if normal[i] else b"" for i, p in enumerate(pieces)]
        self.dropout, self.seed = dropout, seed
        # a gap of g candidates before the next skip has the probability (1 - dropout)**g * dropout
        most = int(-23 / np.log1p(-dropout)) + 1 if 0 < dropout < 1 else 0
        self.gaps = np.array([round((1 - (1 - dropout) ** g) * 2**32) for g in range(1, most + 1)], np.uint64)
        self.gap_list = self.gaps.tolist()
        self._tables()
        #: by the number of candidates taken: the upper half of a key below this skips one of them
        self.least = np.concatenate([[0], self.gaps, [1 << 32]]).astype(np.uint64)
        self._forget()

    def _tables(self) -> None:
        """What the lockstep needs: ids of single characters, and a hash table of the pairs of pieces that make a piece,
        with its rank among all ranks and its id."""
        self.of_char = np.full(0x110000, -1, np.int32)
        pairs, made = [], []
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
            for k in range(1, len(piece)):
                if (a := self.ids.get(piece[:k])) is not None and (b := self.ids.get(piece[k:])) is not None:
                    pairs.append(a << 32 | b)
                    made.append(piece)
        # linear probing; at most one slot in four is used
        self.shift = np.uint64(64 - max(8, (4 * len(pairs)).bit_length()))
        keys, slots_ = np.array(pairs, np.int64), 1 << 64 - int(self.shift)
        orders = np.unique([self.rank[p] for p in made], return_inverse=True)[1].astype(np.int32)
        pieces = np.array([self.ids[p] for p in made], np.int32)
        self.pair, self.order, self.piece = np.full(slots_, -1, np.int64), np.full(slots_, NO_RANK, np.int32), np.zeros(slots_, np.int32)
        at = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.pair[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.pair[at[free]], self.order[at[free]], self.piece[at[free]] = keys[free], orders[free], pieces[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, orders, pieces, at = keys[rest], orders[rest], pieces[rest], at[rest] + 1 & slots_ - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys.view(np.uint64)) >> self.shift).astype(np.int64)

    def _merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair makes, NO_RANK for none; symbols are ids, negative at a unit's ends."""
        keys = left.astype(np.int64) << 32 | right
        slots = self._slots(keys)
        found = self.pair[slots]
        order = np.where(found == keys, self.order[slots], NO_RANK)
        on = np.flatnonzero((found != keys) & (found >= 0))
        while len(on):
            slots[on] = slots[on] + 1 & len(self.pair) - 1
            found = self.pair[slots[on]]
            same = found == keys[on]
            order[on[same]] = self.order[slots[on[same]]]
            on = on[~same & (found >= 0)]
        order[(left < 0) | (right < 0)] = NO_RANK
        return order, self.piece[slots]

    def _in_lockstep(self, symbols: np.ndarray, skips: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates taken and number of ids by row, and all ids, of units of up to LONG_UNIT characters.

        symbols: a row's ids of characters between two columns of -1, with -1 behind them. Each step takes the next
        candidate of every row: the least rank, leftmost first. A merge leaves its symbol in the left one's column.
        """
        n, wide = symbols.shape
        sym, base = symbols.ravel(), np.arange(n) * wide
        after, before = np.tile(np.arange(wide) + 1, n), np.tile(np.arange(wide) - 1, n)
        agenda, made = np.full(n * wide, NO_RANK, np.int32), np.zeros(n * wide, np.int32)
        agenda[:-1], made[:-1] = self._merged(sym[:-1], sym[1:])
        ranks = agenda.reshape(n, wide)
        marks = np.unpackbits(np.frombuffer(b"".join([x.to_bytes(MOST_SKIPS // 8, "little") for x in skips]), np.uint8), bitorder="little")
        taken, live = np.zeros(n, np.int64), np.arange(n)
        while True:
            at = (ranks if len(live) == n else ranks[live]).argmin(1) + base[live]
            if not (going := agenda[at] < NO_RANK).all():
                live, at = live[going], at[going]
            if not len(live):
                break
            skipped = marks[live * MOST_SKIPS + taken[live]] > 0
            taken[live] += 1
            agenda[at[skipped]] = NO_RANK
            at, start = at[~skipped], base[live[~skipped]]
            right = after[at] + start
            beyond = after[right] + start
            piece = made[at]
            sym[at], sym[right], agenda[right] = piece, -1, NO_RANK
            after[at], before[beyond] = beyond - start, at - start
            left = before[at] + start
            agenda[left], made[left] = self._merged(sym[left], piece)
            agenda[at], made[at] = self._merged(piece, sym[beyond])
        return taken, (symbols >= 0).sum(1), sym[sym >= 0]

    def _segments(self, units: list[str], skips: list[int]) -> list[int]:
        """New nodes for units with these skips: in lockstep, except long ones and those with a character that is no piece."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        chars = self.of_char[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum(sizes)
        known = np.concatenate([[0], np.cumsum(chars >= 0)])
        fit = (sizes > 0) & (sizes <= LONG_UNIT) & (known[ends] - known[ends - sizes] == sizes)
        nodes = np.empty(len(units), np.int64)
        for k in np.flatnonzero(~fit).tolist():
            taken, ids = self.segment(units[k], skips[k]) if units[k] else (0, array("i", [self.bytes[b] for b in BLANK.encode()]).tobytes())
            nodes[k] = self._node(units[k], skips[k], taken, ids)
        rows = np.flatnonzero(fit)
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        for a in range(0, len(rows), ROWS):
            some = rows[a : a + ROWS]
            wide = int(sizes[some[-1]]) + 2
            place = np.arange(wide - 2)
            inside = place < sizes[some][:, None]
            symbols = np.full((len(some), wide), -1, np.int32)
            symbols[:, 1:-1][inside] = chars[((ends - sizes)[some][:, None] + place)[inside]]
            of = some.tolist()
            taken, many, ids = self._in_lockstep(symbols, [skips[k] for k in of])
            nodes[some] = len(self.unit) + np.arange(len(some))
            self.unit += [units[k] for k in of]
            self.skips += [skips[k] for k in of]
            self.first.frombytes((len(self.pool) + np.cumsum(many) - many).astype(np.int64).tobytes())
            self.taken.frombytes(taken.astype(np.int32).tobytes())
            self.size.frombytes(many.astype(np.int32).tobytes())
            self.pool.frombytes(ids.tobytes())
        return nodes.tolist()

    def segment(self, unit: str, skips: int = 0) -> tuple[int, bytes]:
        """Candidates taken, and ids (little-endian, 32 bits) of one unit; without skips, what the library's encoder gives.

        Bit k of skips is set if the k-th candidate taken is skipped.
        """
        taken, parts = self._short(unit, skips) if len(unit) <= SHORT_UNIT else self._long(unit, skips)
        ids, out = self.ids, []
        for piece in parts:
            if (i := ids.get(piece)) is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return taken, array("i", out).tobytes()

    def _short(self, unit: str, skips: int = 0) -> tuple[int, list[str]]:
        """The agenda as a list beside the symbols: its least rank, leftmost first, is the next candidate."""
        rank, none, taken = self.rank.get, 1e18, 0
        parts = list(unit)
        agenda = [rank(a + b, none) for a, b in zip(unit, unit[1:])]
        while agenda and (least := min(agenda)) < none:
            k = agenda.index(least)
            taken += 1
            if skips >> taken - 1 & 1:
                agenda[k] = none
                continue
            parts[k] += parts.pop(k + 1)
            del agenda[k]
            if k:
                agenda[k - 1] = rank(parts[k - 1] + parts[k], none)
            if k < len(agenda):
                agenda[k] = rank(parts[k] + parts[k + 1], none)
        return taken, parts

    def _long(self, unit: str, skips: int = 0) -> tuple[int, list[str]]:
        """The same with a heap, for units of any length."""
        rank, n, push, pop, taken = self.rank, len(unit), heapq.heappush, heapq.heappop, 0
        skipped = bin(skips)[:1:-1]
        end = list(range(1, n + 1))  # of the symbol that starts here; 0 once it is part of an earlier one
        before = list(range(-1, n))
        agenda = []
        for left in range(n - 1):
            if (r := rank.get(unit[left : left + 2])) is not None:
                agenda.append((r, left, left + 1, left + 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, stop = pop(agenda)
            if end[left] != right or end[right] != stop:
                continue
            taken += 1
            if skipped[taken - 1 : taken] == "1":
                continue
            end[left], end[right], before[stop] = stop, 0, left
            if left and (r := rank.get(unit[before[left] : stop])) is not None:
                push(agenda, (r, before[left], left, stop))
            if stop < n and (r := rank.get(unit[left : end[stop]])) is not None:
                push(agenda, (r, left, stop, end[stop]))
        out, at = [], 0
        while at < n:
            out.append(unit[at : end[at]])
            at = end[at]
        return taken, out

    def _forget(self) -> None:
        """Empty the cache. A node is a unit with the skips drawn so far; one more skip leads to a child of it."""
        self.known: dict[str, int] = {}
        self.children: dict[int, int] = {}
        self.unit: list[str] = []
        self.skips: list[int] = []
        self.taken, self.first, self.size, self.pool = array("i"), array("q"), array("i"), array("i")

    def _node(self, unit: str, skips: int, taken: int, ids: bytes) -> int:
        self.unit.append(unit)
        self.skips.append(skips)
        self.taken.append(taken)
        self.first.append(len(self.pool))
        self.size.append(len(ids) // 4)
        self.pool.frombytes(ids)
        return len(self.unit) - 1

    def _children(self, nodes: np.ndarray, bits_: np.ndarray) -> np.ndarray:
        """The nodes that skip one candidate more than these; of units up to LONG_UNIT, so a bit is below 256."""
        edges = (nodes << 8 | bits_).tolist()
        out = np.fromiter(map(self.children.get, edges, repeat(-1)), np.int64, len(edges))
        if (new := np.flatnonzero(out < 0)).size:
            distinct = list(dict.fromkeys([edges[k] for k in new.tolist()]))
            made = self._segments([self.unit[e >> 8] for e in distinct], [self.skips[e >> 8] | 1 << (e & 255) for e in distinct])
            self.children.update(zip(distinct, made, strict=True))
            out[new] = [self.children[edges[k]] for k in new.tolist()]
        return out

    def _long_cut(self, unit: str, first: int, second: int, key: int) -> int:
        """A node for this occurrence alone, with all skips at once; an agenda is less than three times as long as its unit."""
        marks, following, k = bytearray(b"0" * 3 * len(unit)), second, 0
        marks[first] = 49
        while following < len(marks):
            marks[following] = 49
            following += 1 + bisect_right(self.gap_list, xxhash.xxh3_64_intdigest(key.to_bytes(8, "little"), k) >> 32)
            k += 1
        return self._node(unit, 0, *self.segment(unit, bits(marks)))

    def _gaps(self, drawn_: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.gaps, drawn_, "right")

    def _skip(self, units: list[str], node: np.ndarray, keys: np.ndarray, long_: list[int]) -> None:
        """Replace the nodes of the occurrences of which a candidate is skipped; keys are the occurrences'."""
        taken = lambda n: np.frombuffer(self.taken, np.int32)[n]
        at = np.flatnonzero(keys >> np.uint64(32) < self.least[np.minimum(taken(node), len(self.least) - 1)])
        key = keys[at]
        bit = self._gaps(key >> np.uint64(32))
        coming = bit + 1 + self._gaps(key & np.uint64(M32))
        if long_:
            apart = np.isin(at, long_)
            for k in np.flatnonzero(apart).tolist():
                node[at[k]] = self._long_cut(units[at[k]], int(bit[k]), int(coming[k]), int(key[k]))
            at, key, bit, coming = (x[~apart] for x in (at, key, bit, coming))
        k = 0
        while len(at):
            node[at] = self._children(node[at], bit)
            more = coming < taken(node[at])
            at, key, bit = at[more], key[more], coming[more]
            coming = bit + 1 + self._gaps(drawn(key, k))
            k += 1

    def _cut(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, one after the other, and how many each has."""
        if len(self.unit) > MOST_NODES or len(self.pool) > MOST_POOL:
            self._forget()
        node = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new, long_ = np.flatnonzero(node < 0).tolist(), []
        if new:  # "" is a blank mark of the text itself, which becomes bytes
            distinct = list(dict.fromkeys([units[k] for k in new]))
            made = dict(zip(distinct, self._segments(distinct, [0] * len(distinct)), strict=True))
            node[new] = [made[units[k]] for k in new]
            long_ = [k for k in new if len(units[k]) > LONG_UNIT]
            self.known.update((u, n) for u, n in made.items() if len(u) <= LONG_UNIT)
        if self.dropout:
            self._skip(units, node, keys, long_)
        first, size = np.frombuffer(self.first, np.int64)[node], np.frombuffer(self.size, np.int32)[node].astype(np.int64)
        upto = np.cumsum(size)
        return np.frombuffer(self.pool, np.int32)[np.repeat(first - upto + size, size) + np.arange(size.sum())], size

    def encode_many(self, rows: list[tuple[str | None, int, int, int]]) -> list[np.ndarray]:
        """Ids of the whole text of each (text, doc_id, text_key, copy)."""
        units, many, marks, names, find = [], [], [], [], self.units.findall
        for text, *name in rows:
            before = len(units)
            if text:
                head, *rest = text.split(BLANK)
                units += find(BLANK + head.replace(" ", BLANK))
                for part in rest:
                    marks.append(len(units))
                    units.append("")
                    units += find(part.replace(" ", BLANK))
            many.append(len(units) - before)
            names.append(xxhash.xxh3_64_intdigest(struct.pack("<qqq", *name), self.seed))
        ends = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        # a unit's ordinal in its text, from 1; marks of the text itself have none
        real = np.ones(len(units), np.int64)
        real[marks] = 0
        ordinal = np.concatenate([[0], np.cumsum(real)])
        ordinal = ordinal[1:] - np.repeat(ordinal[ends[:-1]], many)
        keys = mixed(ordinal.astype(np.uint64) * np.uint64(_STEP) + np.repeat(np.array(names, np.uint64), many))
        parts = [self._cut(units[a : a + AT_ONCE], keys[a : a + AT_ONCE]) for a in range(0, len(units), AT_ONCE)]
        ids = np.concatenate([np.empty(0, np.int32), *(x for x, _ in parts)])
        upto = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *(x for _, x in parts)]))])
        return np.split(ids, upto[ends[1:-1]]) if rows else []

    def encode(self, text: str | None, doc_id: int = 0, text_key: int = 0, copy: int = 0) -> np.ndarray:
        """Ids of the whole text. A blank mark that stands in the text itself becomes bytes, so decoding is lossless."""
        return self.encode_many([(text, doc_id, text_key, copy)])[0]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.data.__getitem__, np.asarray(ids).tolist()))
        return data[1:].decode("utf-8", "surrogatepass")


@lru_cache(4)
def model(path: str, dropout: float = DROPOUT, seed: int = SEED) -> Model:
    return Model(path, dropout, seed)


def encode_pieces(docs: DataFrame, path: str, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): each whole text's piece ids. Null and empty texts have none.

    Repeated rows give repeated rows, each cut on its own: equal ones meet in one task, which numbers them. A null id
    stays null. An empty table gives no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("sp_dropout", model.cache_clear)
        bpe, copies = model(path, dropout, seed), Counter()
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                rows, named = pdf.iloc[a : a + 256], []
                for row in zip(rows["text"], rows["doc_id"].tolist(), rows["text_key"].tolist(), strict=True):
                    named.append((*row, copies[row[1:]]))
                    copies[row[1:]] += 1
                yield pd.DataFrame({"doc_id": rows["doc_id"], "ids": bpe.encode_many(named)})

    rows = docs.select(held_id(id_col), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    if dropout:
        rows = rows.repartition("doc_id", "text_key")
    return rows.mapInPandas(run, "doc_id long, ids array<int>").withColumn("doc_id", given_id())


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, text): the texts of ids that encode_pieces gave, with any dropout and seed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("sp_dropout", model.cache_clear)
        bpe = model(path)
        for pdf in batches:
            ids = pdf["ids"]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "n_pieces": [len(x) for x in ids],
                    "ids_crc32": [zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in ids],
                    "text": [bpe.decode(x) for x in ids],
                }
            )

    held = encoded.select(held_id("doc_id"), "ids")
    return held.mapInPandas(run, "doc_id long, n_pieces long, ids_crc32 long, text string").withColumn("doc_id", given_id())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_merge_dropout(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Per document: pieces, their crc32 and the digest of the text that they decode to."""
    path = path or default_model()
    decoded = decode_pieces(encode_pieces(read_table(spark, sf_dir, "documents"), path), path)
    text = F.col("text").cast("binary")
    return decoded.select("doc_id", "n_pieces", "ids_crc32", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(text, 256).alias("decoded_sha256"))
