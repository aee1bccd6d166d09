"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: each
operator and stage has a defined result for them."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillmark.llm import chat_format, decontaminate, fingerprint, html_text, jaccard_join, lm_score, mixing, substring_dedup, toxicity, url_rules

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for their own columns.
CLASH = ("score", "items", "spans", "n_words", "n_hit", "size", "taken", "epoch", "key", "block", "guest", "n", "label", "rep", "row", "host", "path", "rule", "verdict", "word", "turns", "loss_spans", "d1", "run", "_k1", "_marks", "_row", "_nth", "_place", "_cut", "_times", "_words", "_more")


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i % 700}" for i in range(20_000))
    rows = [
        (1, "some plain text here", "en", "a", 20),
        (1, "some plain text here", "en", "a", 20),
        (2, None, None, None, None),
        (3, "", "en", "", 0),
        (4, " \t\n", "en", "a", 3),
        (5, long, "en", "b", len(long)),
        (6, "some plain text here", None, "b", 20),
        (None, "a text without an id", "en", None, 20),
        (7, "ÉCOLE naïve 東京   x y", "fr", "c", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.withColumns({c: F.lit(f"mine {c}") for c in CLASH})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def held(d):
    return d.withColumn("held_out", F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)))


def model(spark, docs):
    return toxicity.train(docs, spark.createDataFrame([(1, 0), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int"))


def bench(spark):
    return spark.createDataFrame([(1, "plain text here"), (None, "w1 w2 w3"), (3, None)], "item_id long, text string")


OPERATORS = {
    "fingerprints": lambda s, d: fingerprint.with_edits(d),
    "fingerprint": lambda s, d: fingerprint.fingerprints(d),
    "lm": lambda s, d: lm_score.score_texts(held(d)),
    "dedup": lambda s, d: substring_dedup.dedup_digest(d),
    "remove": lambda s, d: substring_dedup.remove_repeats(d),
    "mixing": lambda s, d: mixing.mix(d),
    "toxicity": lambda s, d: toxicity.score(d, model(s, d)),
    "join": lambda s, d: jaccard_join.near_duplicates(d),
    "hits": lambda s, d: decontaminate.find_hits(d, bench(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(spark, docs, clashing, nothing, name):
    f = OPERATORS[name]
    first = f(spark, docs)
    wanted = first.collect()
    assert len(wanted) == docs.count()
    assert f(spark, nothing).collect() == []
    again = f(spark, clashing).select(*first.columns).collect()
    assert sorted(map(str, again)) == sorted(map(str, wanted))


def test_results_of_edges(spark, docs):
    by = {}
    for r in substring_dedup.dedup_digest(docs, 3, 2).collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_removed for r in by[1]] == [4, 4] and by[6][0].n_removed == 4 and by[2][0].n_words == by[3][0].n_words == by[4][0].n_words == 0
    assert by[7][0].n_words == 5  # only ASCII white space ends words
    joined = {(r.doc_id, r.component_id, r.n_shingles) for r in jaccard_join.near_duplicates(docs).collect()}
    assert {(1, 1, 1), (6, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0)} <= joined
    sizes = {r.doc_id: r.size for r in mixing.mix(docs).collect()}
    assert sizes[2] == sizes[3] == sizes[4] == 0 and sizes[5] == 20_000


def test_one_row_of_each_group_stays(spark):
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    near = lambda words, i: " ".join([*words[:-1], f"end{i}"])
    rows = [
        (1, " ".join(base)), (1, " ".join(base)),  # a clean document twice
        (None, " ".join(base)), (None, near(base, 1)),  # near ones without an id
        (None, "only here " * 3), (None, "only here " * 3),
        (4, " ".join(other)), (5, " ".join(other)), (5, "of id five"),  # one row of 5 is a copy
        (6, "a b c d e f g"), (7, "a b c d e f g"), (7, " ".join(f"u{i}" for i in range(60))), (9, near([f"u{i}" for i in range(60)], 2)),
        (8, ""), (8, ""), (10, ""),
    ]
    docs = spark.createDataFrame([(*r, f"{i}") for i, r in enumerate(rows)], "doc_id long, text string, source string")
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "")[:10]) for r in kept.collect())
    assert got == [(0, "only here "), (1, "w0 w1 w2 w"), (4, "v0 v1 v2 v"), (5, "of id five"), (6, "a b c d e "), (7, "u0 u1 u2 u"), (8, ""), (10, "")]
    joined = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard_join.near_duplicates(docs).collect())
    assert joined == [(0, 0), (0, 0), (0, 1), (0, 1), (1, 1), (1, 1), (4, 4), (5, 4), (5, 5), (6, 6), (7, 6), (7, 7), (8, 8), (8, 8), (9, 7), (10, 10)]


def test_pages(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "http://A.net/x", "<p>t"), (1, "http://A.net/x", "<p>t"), (None, None, None), (2, "", ""), (3, "x", "<p>" + "z " * 50_000)]
    pages = spark.createDataFrame(rows, schema)
    rules = url_rules.rules_frame(spark)
    extra = pages.withColumns({c: F.lit("mine") for c in CLASH})
    for f in (html_text.extract, lambda p: url_rules.judge(p, rules)):
        wanted = sorted(map(str, f(pages).collect()))
        assert len(wanted) == 5 and sorted(map(str, f(extra).collect())) == wanted
        assert f(spark.createDataFrame([], schema)).collect() == []
    no_rules = url_rules.judge(pages, rules.limit(0)).collect()
    assert {r.verdict for r in no_rules} == {"allow"}


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (2, 1, "assistant", "x" * 200_000)]
    turns = spark.createDataFrame(rows, schema)
    got = {r.conv_id: r for r in chat_format.format_chats(turns.withColumns({c: F.lit("mine") for c in CLASH})).collect()}
    assert [t.text for t in got[1].turns] == ["a", "a"] and [(t.role, t.text) for t in got[None].turns] == [("", "")] and len(got[2].turns[0].text) == 200_000
    assert chat_format.format_chats(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("i", range(len(corpus_pipeline.STAGES)))
def test_stage(spark, docs, clashing, nothing, i):
    name, stage = corpus_pipeline.STAGES[i]
    last = i == len(corpus_pipeline.STAGES) - 1
    assert stage(spark, nothing, DATA).collect() == []
    plain, extra = stage(spark, docs, DATA), stage(spark, clashing, DATA)
    if not last:
        assert plain.columns == docs.columns and extra.columns == clashing.columns
        assert all(r[c] == f"mine {c}" for r in extra.collect() for c in CLASH)
    assert sorted(map(str, extra.select(*docs.columns).collect())) == sorted(map(str, plain.select(*docs.columns).collect()))


def test_stage_order_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "mixing sources to target weights"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), stage(spark, docs, DATA).schema)
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(str, docs.collect()))
