"""Stored indexes against the searches that read the whole corpus."""

import random

import pytest
from pyspark.sql import functions as F

from rillmark.operators import cells, dense, inverted, lexical
from rillmark.plans import search, tables

DATA = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


def by_rank(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


@pytest.fixture(scope="module")
def topical(spark):
    """Chunks in order of their topic, whose blocks differ."""
    rng = random.Random(1)
    rows = [(i, f"law{i // 64}", " ".join(rng.choice(["the", "of", f"topic{chr(97 + i // 64)}", f"w{chr(97 + rng.randrange(26))}x"]) for _ in range(30))) for i in range(640)]
    rows += [(1_000, "law0", None), (1_001, "law0", ""), (1_002, None, "topicc topicc")]
    return spark.createDataFrame(rows, "chunk_id long, law_iri string, text string").coalesce(1)


@pytest.fixture(scope="module")
def index(topical, tmp_path_factory):
    return inverted.build(topical, str(tmp_path_factory.mktemp("inverted")), ("law_iri",))


ASKED = [(1, "the topicc", 3, ["law2"]), (2, "of wax wbx", 5, []), (3, "nothing known here", 2, []), (4, "", 2, []), (5, None, 2, ["law1"]), (6, "the of", 4, ["law3", "law4"]), (7, "topica topicb", 700, [])]


def test_same_results_as_a_search_of_the_corpus(spark, topical, index):
    asked = spark.createDataFrame(ASKED, "query_id long, text string, k int, laws array<string>")
    assert by_rank(inverted.search(index, asked, 4)) == by_rank(lexical.search(topical, asked, 4))
    assert by_rank(inverted.search(index, asked, "k")) == by_rank(lexical.search(topical, asked, "k"))
    within = ("laws", "law_iri")
    assert by_rank(inverted.search(index, asked, "k", within=within)) == by_rank(lexical.search(topical, asked, "k", within=within))
    some = F.col("law_iri") == "law5"
    assert by_rank(inverted.search(index, asked, 3, some)) == by_rank(lexical.search(topical, asked, 3, some))
    assert inverted.search(index, asked.limit(0), 3).count() == 0


def test_blocks_and_entries_are_skipped(spark, index):
    asked = spark.createDataFrame([(1, "the of topicc")], "query_id long, text string")
    found = inverted.asked(index, asked)
    first = inverted.probed(found, 1)
    scores = inverted._entries(found.postings, found.terms, first, (), None).groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
    reach = inverted.reached(scores, F.lit(5))
    blocks, left = found.bounds.count(), inverted.possible(found, first, reach).count()
    assert blocks == 11 and left <= 1  # the topic's own block was probed
    terms = inverted.weak_terms(found, reach)
    assert {r.token for r in terms.filter("weak").collect()} == {"the", "of"}


def test_folders_are_pruned_and_no_text_is_read(spark, index, topical):
    asked = spark.createDataFrame([(1, "topicc")], "query_id long, text string")
    found = inverted.asked(index, asked)
    plan = found.postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan.replace("isnotnull(folder#", "[folder") or "folder" in plan.split("PartitionFilters")[1][:80]
    files = found.postings.select(F.input_file_name().alias("f")).distinct().count()
    every = index.postings.select(F.input_file_name().alias("f")).distinct().count()
    assert files == 1 < every
    assert "text" not in index.postings.columns and [f.name for f in index.kept()] == ["chunk_id", "impact", "law_iri"]


def test_an_empty_corpus(spark, topical, tmp_path):
    index = inverted.build(topical.limit(0), str(tmp_path / "none"), ("law_iri",))
    asked = spark.createDataFrame([(1, "the")], "query_id long, text string")
    assert inverted.search(index, asked, 3).count() == 0


def test_hybrid_over_the_index(spark, tmp_path):
    corpus = tables.corpus(spark, DATA)
    asked = tables.queries(spark, DATA).select("query_id", "query").limit(6)
    index = inverted.build(corpus, str(tmp_path / "inverted"), ("law_iri",))
    plain = search.hybrid(corpus, asked, 3, 64)
    assert sorted(map(tuple, search.hybrid(corpus, asked, 3, 64, index).collect())) == sorted(map(tuple, plain.collect()))


# Cells ---------------------------------------------------------------------


def vectors(spark, at):
    rows = spark.read.parquet(f"{at}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("chunk_id"), "embedding"), rows.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def test_recall_of_the_probes(spark, tmp_path):
    rows, asked = vectors(spark, SMALL)
    index = cells.build(rows, str(tmp_path / "cells"))
    assert index.rows.count() == rows.count() and index.cells.agg(F.sum("n")).first()[0] == rows.count()
    want = {r[:2] for r in by_rank(dense.nearest(rows, asked, 10))}
    got = {r[:2] for r in by_rank(cells.search(index, asked, 10))}
    assert len(want & got) / len(want) >= 0.9


def test_exact_search_closes_cells(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [float(i % 8 == j) + rng.random() / 20 for j in range(8)]) for i in range(400)]
    rows += [(900, None), (901, [0.0] * 8), (902, [1.0]), (903, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    index = cells.build(df, str(tmp_path / "cells"), cells=8)
    asked = df.filter("chunk_id % 40 = 0 OR chunk_id > 900").withColumnRenamed("chunk_id", "query_id")
    assert by_rank(cells.search(index, asked, 5, 1, exact=True)) == by_rank(dense.nearest(df, asked, 5))
    near = cells._probes(index, asked.filter("query_id < 900"), 1)
    first = cells._searched(index, near.filter("step = 1"), 5)
    assert cells.needed(index, near, first, 5).count() < near.filter("step = 2").count() / 4
    files = cells._searched(index, near.filter("query_id = 0 AND step = 1"), 5)
    assert files.count() >= 5
    empty = cells.build(df.limit(0), str(tmp_path / "none"))
    assert cells.search(empty, asked, 5).count() == 0


@pytest.mark.parametrize("sizes", [(4_096, 1_024), (3, 2)])
def test_products_within_groups(spark, monkeypatch, sizes):
    monkeypatch.setattr(dense, "GROUP_ROWS", sizes[0])
    monkeypatch.setattr(dense, "GROUP_QUERIES", sizes[1])
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)], rng.choice(["a", "a", "a", "b", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, g string")
    asked = df.filter("chunk_id < 12").withColumnRenamed("chunk_id", "query_id").withColumn("own", F.col("query_id"))
    want = by_rank(dense.nearest(df.filter("g IS NOT NULL"), asked.filter("g IS NOT NULL"), 4, "g", but="own"))
    assert by_rank(lexical.top(dense.within_groups(df, asked, 4, "g", but="own"), 4)) == want
    assert dense.within_groups(df.limit(0), asked, 4, "g").count() == 0


def test_ties_at_the_cut():
    import numpy as np

    score = np.array([[0.5, 0.9, 0.5, 0.5, -np.inf], [-np.inf] * 5])
    row, column, best = dense.best_of(score, np.array([40, 30, 20, 10, 5]), 3)
    assert list(zip(row, column, best, strict=True)) == [(0, 1, 0.9), (0, 3, 0.5), (0, 2, 0.5)]
