"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.common import SPACE, materialize, read_table, source_key

#: metric: (HIGH, TAIL); the upper fence is the HIGH-th percentile plus TAIL times its distance from the median, so
#: that no more than 100 - HIGH percent of a group lie above it. Measures that most texts have none of take a higher one.
METRICS = {"m_symbols": (90, 3), "m_dup_lines": (98, 1), "m_repeats": (98, 1), "m_stutter": (90, 3), "m_word_len": (90, 3), "m_upper": (90, 3)}
#: metrics that have a lower fence too: as the upper one, from the (100 - HIGH)-th percentile down
BOTH_TAILS = ("m_word_len", "m_upper")
MIN_GROUP = 20
#: stands for all languages; keys of languages begin with a or b
ALL = "*"


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base counts of each whole text; w, g and the like are helper columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.withColumn("_t", text).withColumn("_w", F.filter(F.split("_t", f"[{SPACE}]+"), lambda w: w != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    window = ", ".join(f"get(_w, i + {k})" for k in range(8))
    counted = words.select(
        F.col(id_col).alias("doc_id"),
        "_lang",
        "_source",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.expr("size(filter(_w, (x, i) -> i > 0 AND x = get(_w, i - 1)))").cast("long").alias("n_stutter"),
        lines.alias("_l"),
    )
    hashed = counted.withColumn("_g", F.expr(f"CASE WHEN size(_w) >= 9 THEN transform(sequence(0, size(_w) - 8), i -> xxhash64({window})) END"))
    sorted_ = hashed.drop("_w").withColumn(
        "_s", F.expr("CASE WHEN size(array_distinct(_g)) < size(_g) THEN sort_array(transform(_g, (x, i) -> struct(x AS g, i AS i))) END")
    )
    starts = sorted_.drop("_g").withColumn(
        "_p", F.expr("sort_array(transform(filter(_s, (x, j) -> get(_s, j - 1).g = x.g OR get(_s, j + 1).g = x.g), x -> x.i))")
    )
    covered = F.expr("aggregate(zip_with(_p, slice(_p, 2, size(_p)), (a, b) -> least(8, b - a)), 0, (s, x) -> s + x)")
    return starts.select(
        "doc_id",
        "_lang",
        "_source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_upper",
        "n_stutter",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _metrics() -> dict[str, Column]:
    """Bins of whole numbers per 10,000 words, lines or characters; for the word length, thousandths of a character.

    A bin is named by its least number and is 1/64 of that wide, so all that is compared later has this resolution.
    """
    shares = {
        "m_symbols": "10000 * n_symbols div greatest(n_words, 1)",
        "m_dup_lines": "10000 * n_dup_lines div greatest(n_lines, 1)",
        "m_repeats": "10000 * n_repeat_words div greatest(n_words, 1)",
        "m_stutter": "10000 * n_stutter div greatest(n_words, 1)",
        "m_word_len": "1000 * word_chars div greatest(n_words, 1)",
        "m_upper": "10000 * n_upper div greatest(word_chars, 1)",
    }
    width = "greatest(length(bin({0})) - 7, 0)"
    return {m: F.expr(f"shiftleft(shiftright({v}, {width.format(v)}), {width.format(v)})") for m, v in shares.items()}


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Log-linear histograms (keys, metric, bin, n): a quantile sketch with a relative error of 1/64, merged by adding n."""
    stacked = ", ".join(f"'{m}', {m}" for m in METRICS)
    long = rows.select(*keys, F.expr(f"stack({len(METRICS)}, {stacked}) AS (metric, bin)"))
    return long.groupBy(*keys, "metric", "bin").agg(F.count("*").alias("n"))


def fences(sketched: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys: the rows, each metric's upper fence (_max) and, for BOTH_TAILS, its lower one (_min)."""
    by = W.partitionBy(*keys, "metric")
    cum = sketched.select(*keys, "metric", "bin", F.sum("n").over(by.orderBy("bin")).alias("c"), F.sum("n").over(by).alias("t"))
    high, tail = (F.coalesce(*[F.when(F.col("metric") == m, F.lit(v[k])) for m, v in METRICS.items()]) for k in (0, 1))
    least = lambda percent: F.min(F.when(100 * F.col("c") >= percent * F.col("t"), F.col("bin")))
    q = cum.groupBy(*keys, "metric").agg(F.max("t").alias("rows"), least(100 - high).alias("lo"), least(F.lit(50)).alias("mid"), least(high).alias("hi"))
    upper, lower = F.col("hi") + tail * (F.col("hi") - F.col("mid")), F.col("lo") - tail * (F.col("mid") - F.col("lo"))
    of = lambda m, x, name: F.max(F.when(F.col("metric") == m, x)).alias(name)
    limits = [of(m, upper, f"{m}_max") for m in METRICS] + [of(m, lower, f"{m}_min") for m in BOTH_TAILS]
    return q.groupBy(*keys).agg(F.max("rows").alias("rows"), *limits)


def adaptive_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base counts of every text, the base verdict and the adaptive one.

    Each (language, source) has mergeable quantile sketches of six measures; a document that no base rule fails is
    rejected if a measure lies above its group's upper fence, or below the lower one of those that have it. Fences come
    from the group's own quantiles (see METRICS); bins are compared, not the numbers in them. Groups under MIN_GROUP rows use the sketches merged
    over their language, and those under it the sketches merged over all. Null languages and sources are groups of
    their own. Null and empty texts count 0 words, fail the base rules and stay out of the sketches, as do all rows
    that fail these. Repeated rows give repeated rows; a null id stays null. An empty table gives no rows. Other columns are ignored.
    Equality of 8-word windows is decided on 64-bit hashes within one text.
    """
    keyed = docs.select(F.col(id_col), F.col(text_col), source_key(F.col(lang_col)).alias("_lang"), source_key(F.col(source_col)).alias("_source"))
    rows = _measured(keyed, id_col, text_col)
    rows = rows.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
    rows = materialize(rows.withColumns(_metrics()), "quality-rows")
    fine = materialize(sketch(rows.where(~F.col("base_failed")), ["_lang", "_source"]), "quality-sketch")
    merged = fine.groupBy("_lang", "metric", "bin").agg(F.sum("n").alias("n"))
    total = merged.groupBy("metric", "bin").agg(F.sum("n").alias("n")).withColumn("_lang", F.lit(ALL))
    names = [f"{m}_max" for m in METRICS] + [f"{m}_min" for m in BOTH_TAILS]
    # one small row per language and one for all, which every row gets beside its own
    levels = fences(merged.unionByName(total), ["_lang"]).withColumnRenamed("rows", "_lang_rows")
    overall = [F.max(F.when(F.col("_lang") == ALL, F.col(c))).over(W.partitionBy()).alias(f"_a{c}") for c in names]
    levels = levels.select("_lang", "_lang_rows", *[F.col(c).alias(f"_l{c}") for c in names], *overall)
    pick = lambda c: F.when(F.col("rows") >= MIN_GROUP, F.col(c)).when(F.col("_lang_rows") >= MIN_GROUP, F.col(f"_l{c}")).otherwise(F.col(f"_a{c}"))
    limits = fences(fine, ["_lang", "_source"]).join(levels, "_lang")
    limits = materialize(limits.select("_lang", "_source", *[pick(c).alias(c) for c in names]), "quality-limits")
    outside = [F.col(m) > F.col(f"{m}_max") for m in METRICS] + [F.col(m) < F.col(f"{m}_min") for m in BOTH_TAILS]
    rejected = F.greatest(*[F.coalesce(x.cast("int"), F.lit(0)) for x in outside]) == 1
    return rows.join(limits, ["_lang", "_source"], "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"),
    )


def op7_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_quality(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    metric = {
        "m_symbols": "10000 * n_symbols // greatest(n_words, 1)",
        "m_dup_lines": "10000 * n_dup_lines // greatest(n_lines, 1)",
        "m_repeats": "10000 * n_repeat_words // greatest(n_words, 1)",
        "m_stutter": "10000 * n_stutter // greatest(n_words, 1)",
        "m_word_len": "1000 * word_chars // greatest(n_words, 1)",
        "m_upper": "10000 * n_upper // greatest(word_chars, 1)",
    }
    bin_ = "((v >> greatest(length(bin(v)) - 7, 0)::BIGINT) << greatest(length(bin(v)) - 7, 0)::BIGINT)"
    structs = ", ".join(f"{{'metric': '{m}', 'high': {METRICS[m][0]}, 'tail': {METRICS[m][1]}, 'both_tails': {m in BOTH_TAILS}, 'v': {e}}}" for m, e in metric.items())

    def fence(keys: str, name: str) -> str:
        on = f"{keys}, " if keys else ""
        reach = lambda percent: f"min(bin) FILTER (WHERE 100 * c >= {percent} * t)"
        return f"""{name} AS (
  SELECT *, hi + tail * (hi - mid) AS upper, CASE WHEN both_tails THEN lo - tail * (mid - lo) END AS lower FROM (
    SELECT {on}metric, tail, both_tails, max(t) AS rows, {reach("high")} AS hi, {reach(50)} AS mid, {reach("(100 - high)")} AS lo
    FROM (SELECT {on}metric, high, tail, both_tails, bin, sum(count(*)) OVER (PARTITION BY {on}metric ORDER BY bin) AS c, sum(count(*)) OVER (PARTITION BY {on}metric) AS t
      FROM binned WHERE NOT base_failed GROUP BY {on}metric, high, tail, both_tails, bin)
    GROUP BY {on}metric, tail, both_tails))"""

    pick = lambda c: f"CASE WHEN f.rows >= {MIN_GROUP} THEN f.{c} WHEN l.rows >= {MIN_GROUP} THEN l.{c} ELSE a.{c} END"
    return rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM documents
), grams AS (
  SELECT doc_id, i, w, {" || ' ' || ".join(["w", *[f"lead(w, {k}) OVER o" for k in range(1, 8)]])} AS g, lag(w) OVER o AS p FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), dups AS (
  SELECT doc_id, i, w, p, coalesce(g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1, false) AS d FROM grams
), counted AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE d8) AS n_repeat_words, count(*) FILTER (WHERE w = p) AS n_stutter
  FROM (SELECT *, bool_or(d) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS d8 FROM dups) GROUP BY doc_id
), lined AS (
  SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), base AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN 'b' ELSE 'a' || lang END AS lk, CASE WHEN source IS NULL THEN 'b' ELSE 'a' || source END AS sk,
    coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_stutter, 0)::BIGINT AS n_stutter,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_words, 0) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * coalesce(n_words, 0) AS base_failed
  FROM documents JOIN lined USING (doc_id) LEFT JOIN counted USING (doc_id)
), binned AS (
  SELECT doc_id, lk, sk, base_failed, m.high, m.tail, m.both_tails, m.metric, {bin_} AS bin
  FROM (SELECT *, m.v AS v FROM (SELECT *, unnest([{structs}]) AS m FROM base))
), {fence("lk, sk", "fine")}, {fence("lk", "by_lang")}, {fence("", "overall")}, outside AS (
  SELECT DISTINCT b.doc_id FROM binned b JOIN fine f USING (lk, sk, metric) JOIN by_lang l USING (lk, metric) JOIN overall a USING (metric)
  WHERE b.bin > {pick("upper")} OR b.bin < {pick("lower")}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
FROM base"""


ORACLE = {"op7_adaptive_quality": _oracle()}
