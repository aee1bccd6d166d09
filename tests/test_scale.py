"""Steps that must not grow faster than their input: results against plain Python, and what
the plans move."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.operators import batches, dense, lexical
from rillmark.plans import catalogue, q_search, tables
from rillmark.sources import statutes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_rendered_collections_stay_one_row(spark):
    parts = [{"fragmentId": str(i), "typ": "Odstavec_Dc", "hloubka": 1, "xhtml": f"<p>t{i}</p>" if i % 3 else ""} for i in range(400)]
    bodies = {"a.json": json.dumps({"metadata": {"predpisCislo": "1/2000 Sb.", "rocnik": "2000"}, "fragmenty": parts}), "b.json": '{"metadata": [], "fragmenty": [{"xhtml": "x"}]}', "c.json": '{"metadata": {}, "fragmenty": []}'}
    out = statutes.rendered(spark.createDataFrame(list(bodies.items()), "name string, body string"))
    got = {r.name: r.text for r in out.collect()}
    head = "Source file: a.json\nLegal collection item: 1/2000 Sb./2000 Sb."
    assert got["a.json"] == "\n\n".join([head, *(f"[Odstavec_Dc | depth=1 | id={i}]\nt{i}" for i in range(400) if i % 3)])
    assert got["b.json"] == json.dumps(json.loads(bodies["b.json"]), indent=2) and got["c.json"] == "Source file: c.json"
    # no row for each fragment with its collection's body
    assert "Generate" not in plan_of(out) and "Exchange" not in plan_of(out)


def test_bm25_moves_no_counts(spark):
    texts = [(i, f"alpha beta{i % 7} {'gamma ' * (i % 5)}", "ab"[i % 2]) for i in range(300)] + [(300, None, "a"), (301, "", None)]
    rows = spark.createDataFrame(texts, "chunk_id long, text string, law string")
    asked = spark.createDataFrame([(1, "alpha gamma gamma", ["a"]), (2, "beta3 none", []), (3, "none", []), (4, "", [])], "query_id long, text string, laws array<string>")
    found = lexical.matches(rows, asked, keep=("law",))
    got = lexical.ranked(found, asked, 7, ("laws", "law"))
    # the way of batches with too many tokens to be sent
    wanted = lexical.query_terms(asked).select("token").distinct()
    docs = lexical.tokenized(rows, "law").withColumn("ok", F.lit(True))
    tf = docs.select("chunk_id", "ok", "law", F.size("toks").alias("dl"), F.explode("toks").alias("token")).join(wanted, "token", "left_semi").groupBy("chunk_id", "ok", "law", "dl", "token").agg(F.count("*").alias("tf"))
    other = lexical.ranked(lexical.Matches(tf, lexical.stats(docs), None), asked, 7, ("laws", "law"))
    assert sorted(got.collect()) == sorted(other.collect()) and got.count() == 14
    assert found.tf.count() == 302  # a row a chunk, not a row a chunk and token
    assert plan_of(got).count("Exchange") == 1  # of the best hits, by query


def test_best_keeps_ties_by_id_across_batches():
    best = batches.Best(2, 2)
    best.most = 3
    for chunk, score in (([9, 8], [[1.0, 2.0], [0.5, 0.5]]), ([3, 4], [[2.0, 2.0], [0.5, -np.inf]]), ([1], [[0.1], [0.5]])):
        best.add(np.array(score), np.array(chunk))
    row, chunk, score = best.found()
    assert list(zip(row, chunk, score)) == [(0, 3, 2.0), (0, 4, 2.0), (1, 1, 0.5), (1, 3, 0.5)]


def test_embeddings_are_made_where_texts_are_read(spark):
    rows = spark.createDataFrame([(i, f"w{i} same w{i % 3}") for i in range(50)], "chunk_id long, text string")
    for df in (dense.hash_embedding(rows, 32), dense.dense_vectors(rows, 32)):
        assert "Exchange" not in plan_of(df) and df.select("chunk_id").distinct().count() == 50


def test_fingerprint_rows_are_made_once_a_batch(monkeypatch):
    import pyarrow as pa

    from rillmark.llm import fingerprint

    made, real = [], fingerprint._rows
    monkeypatch.setattr(fingerprint, "_rows", lambda hashes, *rest: (made.append(len(hashes)), real(hashes, *rest))[1])
    one, two = (" ".join(f"{x}{i}" for i in range(60_000)) for x in "ab")
    batch = pa.record_batch([pa.array([4, 3, 2, 1]), pa.array([one, two, one, "  "]), pa.array([4, 3, 2, 1]), pa.array([0, 0, 0, 0]), pa.array([False] * 4)], names=["doc_id", "text", "key", "block", "guest"])
    rows = [r for out in fingerprint._edited(iter([batch])) for r in out.to_pylist()]
    # every word of both texts, once, but for the few that an edit cuts
    assert sum(made) < 120_000 + 10
    assert [r["doc_id"] for r in rows] == [4, 3, 2] and rows[0]["fingerprint"] == rows[2]["fingerprint"] != rows[1]["fingerprint"]
    assert [r["near_next"] for r in rows] == [0.0, 0.0, 0.0] and 0.3 < rows[0]["near_edited"] < 0.7


@pytest.mark.parametrize("name", ["hits", "fused", "candidates"])
def test_texts_stay_where_they_are_when_found_rows_take_their_columns(spark, name):
    folder = "/root/testdata/sf0.001"
    made = {"hits": lambda: tables.hits(spark, folder), "fused": lambda: q_search._fused(spark, folder), "candidates": lambda: q_search.candidates(spark, folder, q_search.planned(spark, folder))}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the tables are large
    try:
        plan = plan_of(made[name]())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin [chunk_id" in plan and "SortMergeJoin [chunk_id" not in plan


@pytest.mark.parametrize("name", ["overlap_gate", "answer_pipeline", "keyed_merge", "validate_floors"])
def test_rows_are_dealt_by_request_only(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the tables are large
    try:
        plan = plan_of(catalogue.queries()[name](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # by chunk, or by chunk and token, what is dealt grows with the texts
    dealt = re.findall(r"Exchange hashpartitioning\((\w+?)#", plan)
    assert dealt and set(dealt) == {"query_id"}
