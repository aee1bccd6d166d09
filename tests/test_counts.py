"""Statistics that follow a keyed table equal those of a rebuild."""

import random

from pyspark.sql import functions as F

from rillmark.operators import counts, lexical, merging

SCHEMA = "chunk_id long, text string"


def made(spark, folder, buckets=8):
    table = merging.create(spark, f"{folder}/table", spark.createDataFrame([], SCHEMA).schema, "chunk_id", buckets)
    return table, counts.Counts(spark, f"{folder}/counts")


def same_as_rebuild(held, table):
    totals = lexical.stats(lexical.tokenized(table.read())).first()
    got = held.totals().first()
    assert (got.n_docs, got.avg_dl) == (totals.n_docs, totals.avg_dl)
    assert sorted(map(tuple, held.idf_table().collect())) == sorted(map(tuple, lexical.idf_table(table.read()).collect()))
    weights = {(r.chunk_id, r.idx): round(r.weight, 9) for r in held.sparse(table.read()).collect()}
    assert weights == {(r.chunk_id, r.idx): round(r.weight, 9) for r in lexical.doc_weights(table.read()).collect()}


def test_follows_inserts_updates_deletions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counts, "MOST", 3)  # several times summed into one
    rng, words = random.Random(5), [f"word{chr(97 + i)}" for i in range(20)]
    table, held = made(spark, tmp_path, 4)
    for batch in range(6):
        rows = {rng.randrange(25): rng.choice([None, "", "§ !", *[" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(6)]]) for _ in range(15)}
        df = spark.createDataFrame([(k, t, rng.random() < 0.25) for k, t in rows.items()], f"{SCHEMA}, gone boolean")
        merging.merge(table, df, deleted=F.col("gone"), source="s", number=batch)
        assert counts.advance(held, table) == batch + 1
        same_as_rebuild(held, table)
    assert len(held.manifest()["folders"]) <= 3
    before = held.manifest()
    merging.merge(table, table.read().withColumn("text", F.lit("again")), source="s", number=2)  # a replay
    assert counts.advance(held, table) == before["version"] and held.manifest() == before
    assert counts.vacuum(held) > 0 and counts.vacuum(held) == 0
    same_as_rebuild(held, table)


def test_reads_changed_buckets_only(spark, tmp_path):
    table, held = made(spark, tmp_path, 32)
    merging.merge(table, spark.range(400).select(F.col("id").alias("chunk_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")))
    counts.advance(held, table)
    merging.merge(table, spark.createDataFrame([(7, "other words")], SCHEMA))
    before, after = merging.changed(table, 1, 2)
    assert 0 < before.count() == after.count() < 40
    counts.advance(held, table)
    same_as_rebuild(held, table)


def test_empty_lost_versions_and_two_writers(spark, tmp_path):
    table, held = made(spark, tmp_path)
    assert held.manifest() is None and held.read().count() == 0 and tuple(held.totals().first()) == (0, 0.0)
    assert counts.advance(held, table) == 0 and held.idf_table().count() == 0 and held.sparse(table.read()).count() == 0
    merging.merge(table, spark.createDataFrame([(1, "some words"), (2, "words again")], SCHEMA))
    assert counts.advance(counts.Counts(spark.newSession(), held.at), table) == counts.advance(held, table) == 1
    merging.merge(table, spark.createDataFrame([(1, None), (3, "some words more")], SCHEMA))
    merging.vacuum(table)  # the version counted last is gone: counted anew
    assert counts.advance(held, table) == 2 and len(held.manifest()["folders"]) == 1
    same_as_rebuild(held, table)
    merging.merge(table, table.read().withColumn("gone", F.lit(True)), deleted=F.col("gone"))
    assert counts.advance(held, table) == 3 and held.read().count() == 0 and tuple(held.totals().first()) == (0, 0.0)
