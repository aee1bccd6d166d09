"""Extension points."""

import time

import pytest
from pyspark.sql import functions as F

from rillmark.operators import cache, providers


def test_embedder_and_scorer(spark):
    def lengths():
        class Lengths:
            dimension, revision = 1, "1"

            def embed(self, texts):
                return [[float(len(t))] for t in texts]

            def score(self, queries, texts):
                if "fail" in queries:
                    raise RuntimeError("no model")
                return [float(len(t)) for t in texts]

        return Lengths()

    df = spark.createDataFrame([(1, "q", "abc"), (2, "q", None)], "chunk_id int, query string, text string").coalesce(1)
    assert [r.embedding for r in providers.embedded(df, lengths).orderBy("chunk_id").collect()] == [[3.0], [0.0]]
    assert [r.model_score for r in providers.scored(df, lengths, 2).orderBy("chunk_id").collect()] == [2.0, 0.0]
    assert [r.model_score for r in providers.scored(df.withColumn("query", F.lit("fail")), lengths).collect()] == [None, None]


def test_late_scores_are_null(spark):
    def slow():
        class Slow:
            def score(self, queries, texts):
                time.sleep(1.5)
                return [1.0] * len(texts)

        return Slow()

    df = spark.createDataFrame([("q", "abc"), ("q", "d")], "query string, text string").coalesce(1)
    assert [r.model_score for r in providers.scored(df, slow, seconds=0.2).collect()] == [None, None]
    assert [r.model_score for r in providers.scored(df, slow, seconds=None).collect()] == [1.0, 1.0]


def test_requests_are_checked(spark):
    df = spark.createDataFrame([(1, 3), (2, None)], "query_id int, top_k int")
    assert [r.top_k for r in providers.checked(df).orderBy("query_id").collect()] == [3, 5]
    assert [r.confidence for r in providers.checked(df, 0, 1, "confidence", 0.5).collect()] == [0.5, 0.5]
    with pytest.raises(Exception, match="confidence must be"):
        providers.checked(df.withColumn("confidence", F.lit(1.5)), 0, 1, "confidence", 0.5).collect()
    with pytest.raises(Exception, match="top_k must be"):
        providers.checked(spark.createDataFrame([(1, 26)], "query_id int, top_k int")).collect()


def test_events_feed_counters(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    logged = providers.log_events(rows, "exact", F.when(F.col("x") > 1, "hit").otherwise("miss"))
    assert {(r.bucket, r.event): r.n for r in cache.counters(logged, "bucket", "event").collect()} == {("exact", "hit"): 2, ("exact", "miss"): 1}


def test_profiles_and_models(spark):
    a, b = spark.range(1).select(*[providers.fingerprint(F.lit("hash"), F.lit("m"), F.lit(d), F.lit("v2")) for d in (384, 64)]).first()
    assert len(a) == 12 and a != b
    assert providers.EchoModel().invoke("s", {"a": 1}) == {"a": 1, "model": "echo", "instructed": True}
    assert providers.EchoModel().invoke_structured("", {"a": 1}, ("a", "b", "instructed")) == {"a": 1, "b": None, "instructed": False}
    assert providers.EchoModel().invoke_text("", {"a": "č"}) == '{"a": "č", "instructed": false, "model": "echo"}'
    assert [j.country for j in providers.JURISDICTIONS] == ["czechia", "russia"]
