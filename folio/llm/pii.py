"""Personal data: base patterns, and identifiers found by bootstrapped lexical contexts.

Base spans (e-mail, ip, card, phone) are the seeds. Everything identifier-like, seed or not, has contexts. That is each
token with a digit or an @, each run of groups of digits on a line, and each address with a spelt at. A context is the
identifier's class (address, digits, mixed) and one to three words before it, alone, with the word behind it or with the
identifier's shape: the wide ones are sure, the narrow ones general. Spark keeps the bipartite graph of contexts and instances (hashes of the identifiers) and
scores it in rounds: a context's confidence for a kind is the score of its distinct instances over their number, where
unknown ones count half and 1 is the most; an unknown
instance's score is the noisy-or of the accepted contexts it stands in; instances with high scores are seeds of the
next round. Unknown identifiers in accepted contexts become spans of that kind.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folio.llm.common import claim, fresh, given_id, held_id, materialize, read_table

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
LEAST_CONFIDENCE = 0.75
#: what an instance of no known kind counts in a context, against one of another kind
UNKNOWN = 0.5
LEAST_SEEDS = 5

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive, from the start of a run of digits: what the plain pattern finds, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTER = re.compile(r"[^\W\d_]")
_TOKEN = re.compile(r"\S+")
_EDGE = "\"'()[]{}<>.,;:!?*#$%&|"
#: no base kind has more
MOST_DIGITS = 19
_GROUP = re.compile(r"[^\w@]*[0-9](?:[0-9]|[^\w@])*")
_JOINT = re.compile(r"[-\u2013\u2014/.+()\[\]]{1,2}")
_AT = re.compile(r"(?i)[(\[{<]\s?at\s?[)\]}>]|(?<!\S)(?:at|@)(?=\s+[\w-]+(?:\.\w|\s+(?:dot\s|[(\[{<]\s?dot)))")
_DOT = re.compile(r"(?i)[(\[{<]?dot[)\]}>]?")
_SCAN = "doc_id long, text_key long, base array<struct<k:int,s:bigint,e:bigint>>, candidates array<struct<s:bigint,e:bigint,i:bigint,k:int,p:array<string>>>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the plain pattern finds them: a match takes the whole run of local characters before its @."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) in code points, by kind and start."""
    if not text:
        return []
    out = [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def _shape(word: str) -> str:
    """Runs of letters and of digits each as one."""
    return re.sub(r"[0-9]+", "0", re.sub(r"[^\W\d_]+", "a", word))


def _core(text: str, s: int, e: int) -> tuple[int, int]:
    """The span without the marks around it, but with a bracket whose other half is inside."""
    word = text[s:e]
    core = word.strip(_EDGE)
    a = s + len(word) - len(word.lstrip(_EDGE)) if core else s
    b = a + len(core)
    for opening, closing in ("()", "[]"):
        if (more := core.count(closing) - core.count(opening)) > 0 and a > s and text[a - 1] == opening:
            a -= 1
        elif more < 0 and b < e and text[b] == closing:
            b += 1
    return a, b


def _runs(text: str, tokens: list[tuple[int, int]], groups: dict[int, int]) -> Iterator[tuple[int, int]]:
    """From each group of digits (its token: how many) as far as more follow on its line, up to MOST_DIGITS."""
    for first, digits in groups.items():
        last = first
        while text[tokens[last][1] - 1] not in ",;:!?.\"'|":
            follower = last + 1
            if follower not in groups and follower < len(tokens) and _JOINT.fullmatch(text, *tokens[follower]):
                follower += 1
            digits += groups.get(follower, MOST_DIGITS)
            if digits > MOST_DIGITS or follower not in groups or text[tokens[last][1] : tokens[follower][0]].splitlines()[1:]:
                break
            last = follower
        if last > first:
            yield _core(text, tokens[first][0], tokens[last][1])


def _spelt(text: str, tokens: list[tuple[int, int]], starts: list[int]) -> Iterator[tuple[int, int]]:
    """Addresses like `jane (at) mail.example` or `jane at mail dot example`."""
    for m in _AT.finditer(text):
        first, last = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1) - 1
        first -= tokens[first][0] == m.start()
        last += not re.search(r"\w", text[m.end() : tokens[last][1]])
        if first < 0 or last >= len(tokens):
            continue
        while last + 2 < len(tokens) and _DOT.fullmatch(text, *tokens[last + 1]):
            last += 2
        yield _core(text, tokens[first][0], tokens[last][1])


def candidates(text: str | None, base: list[tuple[int, int, int]]) -> list[dict]:
    """Identifiers with their contexts: every base span, and what else is identifier-like and overlaps none.

    Of those with the same start, the longest alone has the contexts of the words before.
    """
    if not text or not (base or "@" in text or _DIGIT.search(text) or _AT.search(text)):
        return []
    taken = sorted((s, e) for _, s, e in base)
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = [s for s, _ in tokens]
    others, groups, nxt = set(), {}, 0
    for k, (s, e) in enumerate(tokens):
        while nxt < len(taken) and taken[nxt][1] <= s:
            nxt += 1
        word = text[s:e]
        digits = len(_DIGIT.findall(word))
        if not digits and "@" not in word or nxt < len(taken) and taken[nxt][0] < e:
            continue
        others.add(_core(text, s, e))
        if digits and _GROUP.fullmatch(word):
            groups[k] = digits
    others.update(_runs(text, tokens, groups))
    ends = list(accumulate((e for _, e in taken), max))
    for s, e in _spelt(text, tokens, starts):
        before = bisect_left(taken, (e,))
        if not before or ends[before - 1] <= s:
            others.add((s, e))
    longest = dict(sorted(others))
    found = [(s, e, k) for k, s, e in base] + [(s, e, -1) for s, e in sorted(others) if s < e]
    out = []
    norm = lambda i: re.sub(r"[0-9]+", "0", text[slice(*tokens[i])].lower()) if 0 <= i < len(tokens) else "^"
    for s, e, k in found:
        at = bisect_right(starts, s) - 1
        after = bisect_right(starts, e - 1)
        lead = text[tokens[at][0] : s].lower()
        one, two = norm(at - 1), norm(at - 2)
        word, one, two = text[s:e], f"{one} {lead}_", f"{two} {one} {lead}_"
        kind = "0" if not _LETTER.search(word) else "@" if "@" in word or _AT.search(word) else "a"
        patterns = [f"{kind}|{two} {norm(after)}", f"{kind}|{one} {norm(after)}"]
        if k >= 0 or longest[s] == e:
            patterns += [f"{kind}|{norm(at - 3)} {two}", f"{kind}|{two}", f"{kind}|{one}{_shape(word)}"]
            # a label that the identifier is joined to, as in `tel=`
            patterns += [f"{kind}|{lead}_"] if _LETTER.search(lead) else []
        out.append({"s": s, "e": e, "i": xxhash.xxh3_64_intdigest(text[s:e]) >> 1, "k": k, "p": patterns})
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    claim("pii")
    for pdf in batches:
        base = [base_spans(t) for t in pdf["text"]]
        yield pd.DataFrame(
            {
                "doc_id": pdf["doc_id"],
                "text_key": pdf["text_key"],
                "base": [[{"k": k, "s": s, "e": e} for k, s, e in b] for b in base],
                "candidates": [candidates(t, b) for t, b in zip(pdf["text"], base, strict=True)],
            }
        )


def bootstrap(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Accepted contexts (p, kind, confidence) of the graph (p, i, k): k is a seed's kind, -1 for unknown."""
    edges = materialize(edges.groupBy("p", "i").agg(F.max("k").alias("k")), "contexts")
    sizes = edges.groupBy("p").agg(F.count("*").alias("n"), F.count_if(F.col("k") < 0).alias("unknown"))
    sizes = sizes.where(f"n >= {LEAST_SEEDS}").select("p", (F.col("n") - (1 - UNKNOWN) * F.col("unknown")).alias("n"))
    sizes = materialize(sizes, "context-sizes")
    seeds = edges.where("k >= 0").select("i", F.col("k").alias("kind"), F.lit(1.0).alias("score")).distinct()
    accepted = None
    for _ in range(rounds):
        scored = edges.join(seeds, "i").groupBy("p", "kind").agg(F.sum("score").alias("score"), F.count("*").alias("m"))
        accepted = scored.where(f"m >= {LEAST_SEEDS}").join(sizes, "p").withColumn("confidence", F.least(F.lit(1.0), F.col("score") / F.col("n")))
        accepted = materialize(accepted.where(f"confidence >= {LEAST_CONFIDENCE}").select("p", "kind", "confidence"), "accepted-contexts")
        if accepted.isEmpty():
            break
        unknown = edges.where("k < 0").join(accepted, "p").groupBy("i", "kind")
        grown = unknown.agg((1 - F.product(1 - F.col("confidence"))).alias("score")).where(f"score >= {LEAST_CONFIDENCE}")
        seeds = materialize(edges.where("k >= 0").select("i", F.col("k").alias("kind"), F.lit(1.0).alias("score")).distinct().unionByName(grown), "seeds")
    return accepted


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, text_key (xxhash64 of the text), `base` and `spans`, arrays of (k, s, e) in order of kind and start; k is a place in KINDS.

    `spans` holds the base spans and what accepted contexts add; an added span overlaps no base span. Null and empty
    texts have none. Repeated rows give repeated rows; an instance counts once in a context however often it is
    repeated. A null id stays null. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(held_id(id_col), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    scanned = rows.mapInPandas(_scan, _SCAN)
    scanned = materialize(scanned.withColumn("doc_id", given_id()).withColumn("_id", F.monotonically_increasing_id()), "pii-scan")
    each = scanned.where("size(candidates) > 0").select("_id", F.explode("candidates").alias("c")).select("_id", "c.*").withColumn("p", F.explode("p"))
    accepted = bootstrap(each.select("p", "i", "k"))
    best = each.where("k < 0").join(accepted, "p").groupBy("_id", "s", "e").agg(F.max_by("kind", F.struct("confidence", F.col("kind"))).alias("kind"))
    added = best.groupBy("_id").agg(F.collect_list(F.struct(F.col("kind").alias("k"), "s", "e")).alias("added"))
    return scanned.join(added, "_id", "left").select(
        "doc_id", "text_key", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added"))).alias("spans")
    )


def hidden_recall(docs: DataFrame, fifths: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, hidden, found): how many distinct seeds of a seeded fifth (or more), treated as unknown, contexts bring back.

    A measure of how far the patterns reach, per place in KINDS. Without seeds there are no rows.
    """
    rows = docs.select(held_id(id_col), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    each = rows.mapInPandas(_scan, _SCAN).select(F.explode("candidates").alias("c")).select("c.i", "c.k", F.explode("c.p").alias("p"))
    edges = materialize(each.withColumn("was", F.col("k")).withColumn("k", F.when(F.col("i") % 5 < fifths, -1).otherwise(F.col("k"))), "hidden-seeds")
    accepted = bootstrap(edges.select("p", "i", "k"))
    found = edges.join(accepted, "p").where("k < 0").groupBy("i").agg(F.max_by("kind", F.struct("confidence", F.col("kind"))).alias("guess"))
    hidden = edges.where("was >= 0 AND k < 0").select("i", F.col("was").alias("kind")).distinct()
    return hidden.join(found, "i", "left").groupBy("kind").agg(F.count("*").alias("hidden"), F.count_if(F.col("guess") == F.col("kind")).alias("found"))


def span_text(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.k], x.s, x.e)), ',')")


def masked_text(text: str, spans: list) -> str:
    """Of spans that overlap, the one that starts first (then the longest) is replaced; linear in the text."""
    out, at = [], 0
    for s, e, k in sorted((x["s"], -x["e"], x["k"]) for x in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = -e
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def _mask(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or s is None else masked_text(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets; columns and rows stay as they are.

    Spans are joined by id and text, so rows that share an id but not a text, and rows without an id, get their own.
    """
    found = find_personal_data(docs, id_col, text_col).where("size(spans) > 0")
    doc, key, own = (fresh(docs, n) for n in ("_doc", "_text", "_spans"))
    spans = found.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(F.first("spans").alias(own))
    joined = docs.join(spans, (F.xxhash64(docs[text_col]) == spans[key]) & docs[id_col].eqNullSafe(spans[doc]), "left")
    some = F.col(own).isNotNull()
    hidden = _mask(F.when(some, docs[text_col]), F.col(own))
    return joined.select(*[F.when(some, hidden).otherwise(docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns])


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, x -> x.k = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text("base").cast("binary"), 256).alias("base_sha256"), span_text("spans").alias("spans"))
