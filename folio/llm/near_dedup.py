"""Near-duplicate groups from bottom-k sketches of one hash function.

1. Each document's set of 5-word shingles is hashed; the K smallest hashes are its sketch. Documents with equal sets
   are one class, handled by its smallest doc_id from there on.
2. Inverted lists of retained values: sketches of a linked pair share LEAST_SHARED values of K or more (at the threshold
   about 27 of 32), so the pair meets in the list of at least one of the K - LEAST_SHARED + 1 rarest values of either.
   Only these rarest values are listed: values of passages that many documents share stay out of the lists.
3. Lists of up to SHORT_LIST members give all their pairs. Members of longer ones are listed anew by the rarest values
   of their full sets, as few as a linked pair must share one of. Each such member has U values that no other member
   has, and counts of its other values in parts of the hash space; what intersection and union can be at best, given
   these, rules out nearly all pairs without a link before they become rows. From each list the members with the least
   U are compared with those outside their component; these are what others link to, if to anything. As components
   merge and members are ruled out, lists fall away; the compared members grow sixteenfold a round until none is
   left.
4. The union sketch of a pair estimates its similarity; pairs that may be linked are confirmed on full sets.
5. Components by large-star / small-star rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm import hashing
from folio.llm.common import claim, given_id, held_id, materialize, read_table

SHINGLE = 5
K = 32
PERCENT = 85
#: a pair at the threshold has fewer of the K least values of its union in common with a probability of 8e-13
LEAST_SHARED = 10
LEAST_ESTIMATE = LEAST_SHARED / K
#: words whose hashes a worker remembers
MOST_WORDS = 1 << 18
SHORT_LIST = 8
#: parts of the hash space in which shared values are counted
BLOCKS = 32
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Words(dict):
    """64-bit hashes of words, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word, 1)
        return out


_words = _Words()


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the text's shingles; of the whole word sequence where it is shorter.

    Each word is hashed by its bytes; a shingle's hash is made of its words' hashes, their order and their number.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    each = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(hashing.BASE) + each[k : len(words) - n + 1 + k]
    return np.unique((hashing.mix(h) >> np.uint64(1)).astype(np.int64))


def _sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    claim("near_dedup", _words.clear)
    for pdf in batches:
        sets = [shingle_hashes(t) for t in pdf["text"]]
        yield pd.DataFrame(
            {
                "doc_id": pdf["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "set_id": [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets],
                "sketch": [s[:K] for s in sets],
            }
        )


def _full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    claim("near_dedup", _words.clear)
    for pdf in batches:
        yield pd.DataFrame({"rep": pdf["rep"], "hashes": [shingle_hashes(t) for t in pdf["text"]]})


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable over edges (u, v). Nodes without edges are left out."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, state = materialize(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def _rarest(owners: DataFrame, values: str, room: str) -> DataFrame:
    """Entries (v, rep, n, u, blocks) of each owner's rarest values as far as others have them too: `room` of n
    values, the u that are nobody else's counting first. blocks: how many of the shared values are in each of BLOCKS
    parts of the hash space."""
    entries = owners.select("rep", F.size(values).alias("n"), F.explode(values).alias("v"))
    shared = materialize(entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "shared-values")
    parts = [F.count_if(F.col("v") % BLOCKS == k).cast("int").alias(f"b{k}") for k in range(BLOCKS)]
    mine = entries.join(shared, "v").groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("s"), *parts)
    left = mine.withColumn("u", F.expr("n - size(s)")).withColumn("blocks", F.array(*[f"b{k}" for k in range(BLOCKS)]))
    listed = F.explode(F.expr(f"slice(s, 1, greatest({room} - u, 0))"))
    return left.select("rep", "n", "u", "blocks", listed.alias("e")).select("e.v", "rep", "n", "u", "blocks")


def _estimate() -> Column:
    """Share of the K smallest values of the union sketch that both sketches hold."""
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, K)
    return F.size(F.array_intersect(F.array_intersect(union, "sa"), "sb")) / F.size(union)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's n_shingles, component_id and whether it is its component's kept document.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets; a component's id is the
    smallest id in it. Texts that are null, empty or without words have no shingles and are linked with nothing.
    Rows that share an id are one node and get the same component. Rows with a null id are linked with nothing, have
    a null component and are kept. An empty table gives no rows. Other columns are ignored. Hashes of 63 bits stand for
    shingles, of 128 for whole sets; sets are compared whole. Candidates come from sketches: see LEAST_SHARED.
    """
    rows = docs.select(held_id(id_col), F.col(text_col).alias("text"))
    sketched = rows.mapInPandas(_sketched, "doc_id long, n_shingles long, set_id string, sketch array<long>")
    sketched = materialize(sketched.withColumn("doc_id", given_id()), "sketches")
    linked = sketched.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    reps = linked.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    reps = materialize(reps, "classes")
    lists = materialize(_rarest(reps, "sketch", f"n - greatest(1, {LEAST_SHARED} * n div {K}) + 1").select("v", "rep"), "lists")
    met = materialize(lists.select("rep").distinct(), "met")
    whole = rows.select(F.col("doc_id").alias("rep"), "text").join(met, "rep", "left_semi")
    sets = materialize(whole.mapInPandas(_full_sets, "rep long, hashes array<long>"), "sets")
    sketches = reps.select("rep", "sketch").join(met, "rep", "left_semi")
    sides = lambda t, c: t.select(F.col("rep").alias(c[-1]), F.col(t.columns[1]).alias(c))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links (u, v) among the pairs (a, b)."""
        likely = pairs.distinct().join(sides(sketches, "sa"), "a").join(sides(sketches, "sb"), "b").where(_estimate() >= LEAST_ESTIMATE)
        likely = materialize(likely.select("a", "b"), "likely-pairs")
        both = F.size(F.array_intersect("ha", "hb"))
        equal = likely.join(sides(sets, "ha"), "a").join(sides(sets, "hb"), "b").where(100 * both >= percent * (F.size("ha") + F.size("hb") - both))
        return materialize(equal.select(F.col("a").alias("u"), F.col("b").alias("v")), "links")

    pair = [F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")]
    lengths = lists.groupBy("v").agg(F.count("*").alias("m")).where("m > 1")
    short = lists.join(lengths.where(f"m <= {SHORT_LIST}"), "v")
    short = short.select("v", "rep")
    links = confirmed(short.join(short.select("v", F.col("rep").alias("b")), "v").where("rep < b").select(*pair))
    roots = components(links)
    long_ = lists.join(lengths.where(f"m > {SHORT_LIST}"), "v", "left_semi").select("rep").distinct()
    lists = materialize(_rarest(sets.join(long_, "rep", "left_semi"), "hashes", f"n - ({percent} * n + 99) div 100 + 1"), "long-lists")
    done, pivots = 0, 1
    while True:
        now = lists.join(roots, lists["rep"] == roots["node"], "left").select("v", "rep", "n", "u", "blocks", F.coalesce("root", "rep").alias("c"))
        now = materialize(now, "now")
        # what is known of a list goes into a small table of its own, so that no task needs all of a long list's members
        one = now.groupBy("v").agg(F.count("*").alias("m"), F.min(F.struct("u", "c")).alias("low"), F.min("c").alias("c0"), F.max("c").alias("c1"))
        one = materialize(one.where(f"c0 < c1 AND m > {done}").select("v", "low"), "lists-open")
        if one.isEmpty():
            break
        other = materialize(now.join(one, "v").where("c <> low.c").groupBy("v").agg(F.min("u").alias("u2")), "lists-second")
        # the best that a member can still meet is the least u outside its component
        best = now.join(one.join(other, "v"), "v").where(f"100 * (n - u) >= {percent} * (n + if(c = low.c, u2, low.u))")
        open_ = materialize(best.select("v", "rep", "n", "u", "blocks", "c"), "open-lists")
        if open_.isEmpty():
            break
        rank = F.row_number().over(W.partitionBy("v").orderBy("u", F.xxhash64("rep"), "rep"))
        leads = now.join(one.select("v"), "v", "left_semi").withColumn("_r", rank).where(f"_r <= {pivots}").where(f"_r > {done}")
        leads = leads.select("v", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"), F.col("blocks").alias("bb"), F.col("c").alias("cb"))
        # no pair has more in common than the lesser of its counts in each part
        most = "aggregate(zip_with(blocks, bb, (x, y) -> least(x, y)), 0, (s, x) -> s + x)"
        possible = f"100 * least(n - u, nb - ub) >= {percent} * greatest(n + ub, nb + u) AND {100 + percent} * {most} >= {percent} * (n + nb)"
        found = confirmed(open_.join(leads, "v").where(f"c <> cb AND {possible}").select(*pair))
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
        done, pivots = pivots, 16 * pivots
    classes = reps.join(roots, reps["rep"] == roots["node"], "left").select("set_id", F.coalesce("root", "rep").alias("rep"))
    with_class = sketched.join(classes, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return with_class.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op1_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
