"""Aliases across sessions: bound readers, refused switches, adoption, retirement."""

import pytest

from rillmark.operators import aliases
from rillmark.operators.aliases import Catalogue, Profile, Refused

SCHEMA = "chunk_id long, text string"
P = Profile("a", "model", 8, "1")


@pytest.fixture
def here(spark, tmp_path):
    return Catalogue(spark, str(tmp_path / "collections"))


def rows(spark, text, n=3):
    return spark.createDataFrame([(i, text) for i in range(n)], SCHEMA)


def texts(df):
    return {r.text for r in df.collect()}


def test_one_session_reads_while_another_switches(spark, here):
    there = Catalogue(spark.newSession(), here.at)
    assert here.reindex("laws", rows(spark, "one"), P) == "laws__v1"
    with there.reading("laws") as bound:
        assert here.reindex("laws", rows(spark, "two"), P, keep=False) == "laws__v2"
        assert texts(bound) == {"one"} and there.active("laws") == here.active("laws") == "laws__v2"
        with there.reading("laws") as new:
            assert texts(new) == {"two"}
        assert not here.retire("laws__v1") and not here.retire("laws__v2")  # read; pointed at
    assert here.retire("laws__v1") and here.versions("laws") == ["laws__v2"]
    assert here.reindex("laws", rows(spark, "three"), P, keep=False) == "laws__v3" and here.versions("laws") == ["laws__v3"]


def test_lost_reader_ends_with_its_time(spark, here, monkeypatch):
    here.reindex("laws", rows(spark, "one"), P)
    lost = here.reading("laws", seconds=60)
    lost.__enter__()
    here.reindex("laws", rows(spark, "two"), P)
    assert not here.retire("laws__v1")
    now = aliases.time.time()
    monkeypatch.setattr(aliases.time, "time", lambda: now + 61)
    assert here.retire("laws__v1")


def test_reader_that_meets_a_switch_takes_the_new_version(spark, here, monkeypatch):
    here.reindex("laws", rows(spark, "one"), P)
    name = here.write("laws", rows(spark, "two"), P)
    put = aliases.work.put

    def late(*of):
        monkeypatch.setattr(aliases.work, "put", put)
        here.switch("laws", name)
        put(*of)

    monkeypatch.setattr(aliases.work, "put", late)
    with here.reading("laws") as bound:
        assert texts(bound) == {"two"} and here.retire("laws__v1")


def test_refused_switches(spark, here):
    here.reindex("laws", rows(spark, "one"), P)
    here.write("laws", rows(spark, "two"), Profile("b", "model", 8, "1"))
    for refused in (lambda: here.switch("laws", "laws__v9"), lambda: here.switch("laws", "laws__v2", P), lambda: here.switch("laws", "laws__v2", expected="laws__v7")):
        with pytest.raises(Refused):
            refused()
    assert here.active("laws") == "laws__v1"


def test_of_two_switches_at_once_one_is_refused(spark, here, monkeypatch):
    here.reindex("laws", rows(spark, "one"), P)
    a, b = here.write("laws", rows(spark, "two"), P), here.write("laws", rows(spark, "three"), P)
    once = aliases.work.put_once

    def late(*of):
        monkeypatch.setattr(aliases.work, "put_once", once)
        here.switch("laws", a)
        return once(*of)

    monkeypatch.setattr(aliases.work, "put_once", late)
    with pytest.raises(Refused):
        here.switch("laws", b)
    assert here.active("laws") == a


def test_ensure_adopts_makes_or_refuses(spark, here):
    schema = rows(spark, "x").schema
    assert here.active("new") is None
    with pytest.raises(Refused), here.reading("new"):
        pass
    assert here.ensure("new", schema, P) == here.ensure("new", schema, P) == "new__v1" and here.rows("new__v1").count() == 0
    # a collection from before there were versions
    rows(spark, "old").write.parquet(f"{here.at}/laws")
    assert here.ensure("laws", schema, P) == here.active("laws") == "laws" and here.profile("laws") == P
    with pytest.raises(Refused):
        here.ensure("laws", schema, Profile("other", "model", 8, "1"))
    with pytest.raises(Refused):
        here.ensure("laws", rows(spark, "x").drop("text").schema, P)
    here.reindex("laws", rows(spark, "newer"), Profile("other", "model", 8, "1"))
    assert here.active("laws") == "laws__v1" and here.ensure("laws", schema, Profile("other", "model", 8, "1")) == "laws__v1"
    # one that is empty is passed over
    spark.createDataFrame([], schema).write.parquet(f"{here.at}/none")
    assert here.ensure("none", schema, P) == "none__v1"


def test_hash_embeddings_serve_by_dimension_and_revision():
    assert Profile("a").serves(Profile("b")) and not Profile("a").serves(Profile("b", dimension=64)) and not Profile("a", "model").serves(Profile("b", "model"))
    assert Profile("a", "model").serves(Profile("a", "other"))
