"""The pipeline's stages on a small table, and the registered queries against their SQL."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest
import xxhash

import corpus_pipeline
from folio.llm import near_dedup, pii, quality, sp_dropout
from folio.llm.registry import ORACLE, QUERIES
from tests.llm.test_operators import components, plain_bootstrap, texts
from tests.test_queries import rows

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and rows(got, columns) == rows(want, columns)


@needs_data
def test_every_stage_works_on_what_was_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    assert len(names) == 5

    good = stages[names[0]](spark, docs, DATA)
    verdict = {r.doc_id: r.kept for r in quality.adaptive_quality(docs).collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, ok in verdict.items() if ok}

    unique = stages[names[1]](spark, good, DATA)
    left = {r.doc_id for r in unique.collect()}
    group = components([(i, t) for i, t in given.items() if verdict[i]])
    assert left == {i for i, c in group.items() if i == c} and near_dedup.K == 32

    masked = stages[names[2]](spark, unique, DATA)
    assert {r.doc_id for r in masked.collect()} == left and masked.columns == docs.columns
    assert not any("@mail" in r.text for r in masked.collect())

    mixed = stages[names[3]](spark, masked, DATA)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= left
    per = mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert per <= 2

    ids = stages[names[4]](spark, mixed, DATA)
    assert ids.count() == mixed.count() and ids.columns == ["doc_id", "ids"]


def plain_pieces(model, text, doc_id, copy):
    return tuple(model.encode(text, doc_id, xxhash.xxh64(text.encode(), seed=42).intdigest() - 2**64 * (xxhash.xxh64(text.encode(), seed=42).intdigest() >> 63), copy).tolist())


@needs_data
def test_run_gives_the_rows_of_brute_force(spark, duck):
    """Quality and mixing from SQL, groups, spans and pieces from plain Python."""
    rows = {r[0]: r for r in duck.sql("SELECT doc_id, text, lang, source FROM documents").fetchall()}
    kept = [i for i, ok in duck.sql(f"SELECT doc_id, kept FROM ({ORACLE['op7_adaptive_quality']})").fetchall() if ok]
    group = components([(i, rows[i][1]) for i in sorted(kept)])
    scans = {i: (base := pii.base_spans(rows[i][1]), pii.candidates(rows[i][1], base)) for i in kept if group[i] == i}
    accepted = plain_bootstrap([(p, c["i"], c["k"]) for _, found in scans.values() for c in found for p in c["p"]])
    masked = []
    for i, (base, found) in scans.items():
        spans = [{"k": k, "s": s, "e": e} for k, s, e in base]
        for c in found:
            best = max(((x, k) for p in c["p"] for k in range(4) if (x := accepted.get((p, k)))), default=None) if c["k"] < 0 else None
            spans += [{"k": best[1], "s": c["s"], "e": c["e"]}] if best else []
        text = rows[i][1]
        for x in sorted(spans, key=lambda x: -x["s"]):
            text = text[: x["s"]] + f"[{pii.KINDS[x['k']].upper()}]" + text[x["e"] :]
        masked.append((i, text, rows[i][3]))
    mix = duckdb.connect()
    mix.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    mix.executemany("INSERT INTO documents VALUES (?, ?, ?)", masked)
    times = {i: (2 * taken + size) // (2 * size) for i, size, taken in mix.sql(f"SELECT doc_id, size, taken FROM ({ORACLE['op6_golden_mix']}) WHERE size > 0").fetchall()}
    model = sp_dropout.Model(sp_dropout.default_model())
    want = sorted((i, plain_pieces(model, text, i, copy)) for i, text, _ in masked for copy in range(times.get(i, 0)))
    assert sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect()) == want


def test_pipeline_of_hard_rows(spark, hard, empty):
    for docs in (hard, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").columns == ["doc_id", "ids"]


def test_rows_without_an_id_of_their_own_get_their_own_verdict(spark, make):
    many = texts(12, 8, size=(60, 60))
    stutter = "again " * 60
    rows = [(None, many[0], "en", "s"), (None, stutter, "en", "s"), (None, many[1], "en", "s"), (None, many[1] + " end", "en", "s")]
    rows += [(1, many[2], "en", "s"), (1, stutter, "en", "s"), (2, many[3], "en", "s"), (2, many[4], "en", "s"), (2, many[4], "en", "s")]
    rows += [(3, many[4] + " end", "en", "s"), (4, many[5], "en", "s"), (5, many[5], "en", "s")]
    good = corpus_pipeline.quality(spark, make(rows), "")
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    assert left(good) == sorted(((i, t) for i, t, _, _ in rows if t != stutter), key=repr)
    unique = left(corpus_pipeline.near_dedup(spark, good, ""))
    assert (None, many[0]) in unique and (1, many[2]) in unique and (2, many[3]) in unique and (4, many[5]) in unique
    assert len({t.removesuffix(" end") for _, t in unique}) == len(unique) == 6
