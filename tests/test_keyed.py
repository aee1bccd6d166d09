"""Keyed state of streams: lifetimes, order, and state that goes."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rillmark.operators import ingest
from rillmark.streaming import keyed

START = datetime.datetime(2026, 3, 29, 0, 30)


@pytest.fixture
def run(spark, tmp_path):
    """Streams batches of rows, a file and a trigger each, through ``build``; the rows that
    came out and the progress of the stream."""

    def go(batches, schema, build):
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            with keyed.kept_in_rocksdb(spark):
                stream = build(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
                q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start()
            q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")), q

    return go


def _recent(rows, lifetime):
    last, out = {}, set()
    for i, g, t, at in sorted((r for r in rows if r[3]), key=lambda r: (r[3], r[0])):
        k = (g, (t or "").strip(" "))
        if k not in last or (at - last[k]).total_seconds() >= lifetime:
            out.add(i)
        last[k] = at
    return out


def test_recent_texts_over_batches(spark, run):
    rng = random.Random(5)
    texts = ["a", "a ", "b", None, "", "c" * 3000]
    rows = [(i, rng.choice(["x", "y", None]), rng.choice(texts), START + datetime.timedelta(seconds=37 * i)) for i in range(400)]
    rows += [(1000 + i, "hot", "h", START + datetime.timedelta(seconds=50 * i)) for i in range(60)] + [(2000, "x", "a", None)]
    rows.sort(key=lambda r: r[3] or START)
    batches = [rows[i : i + 150] for i in range(0, len(rows), 150)]
    out, q = run(batches, "id long, g string, t string, at timestamp", lambda s: keyed.recent_texts(s, "g", "t", "at", 400))
    got = out.collect()
    assert {r.id for r in got} == _recent(rows, 400) and len(got) == len({r.id for r in got})
    assert {(r.id, r.at) for r in got} <= {(r[0], r[3]) for r in rows}


def test_state_of_texts_not_seen_any_more_goes(spark, run):
    hour = datetime.timedelta(hours=1)
    batches = [[(100 * n + i, "g", f"{n} {i}", START + n * hour) for i in range(50)] for n in range(5)]
    out, q = run(batches, "id long, g string, t string, at timestamp", lambda s: keyed.recent_texts(s, "g", "t", "at", 600))
    assert out.count() == 250
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * 100  # two batches' texts and timers, not five


def _fragments():
    rows = []
    for law in ("l1", "l2", None):
        for pos in range(25):
            typ = "Paragraf" if pos % 6 == 2 else "Odstavec_Dc"
            rows.append((f"{law}/{pos}", law, pos, typ, f"§ {pos}a" if pos % 12 == 2 else "x" if pos % 5 else None))
    return rows


def test_paragraphs_are_those_of_the_table(spark, run):
    rows = _fragments()
    table = spark.createDataFrame(rows, "fragment_id string, law_iri string, pos long, typ string, text string")
    wanted = {(r.fragment_id, r.paragraph) for r in ingest.paragraph_context(table).collect()}
    random.Random(3).shuffle(rows)
    extra = [("again", "l1", 3, "Odstavec_Dc", "x"), ("nowhere", "l2", None, "Odstavec_Dc", "x")]
    out, _ = run([rows[:30], rows[30:50], rows[50:] + extra], table.schema, keyed.paragraphs_in_turn)
    got = out.collect()
    assert len(got) == len(rows) + 2
    late = {r.fragment_id for r in got if r.late}
    assert "nowhere" in late and len(late) == 2  # one of the two at place 3 of l1
    assert {(r.fragment_id, r.paragraph) for r in got if not r.late} - {("again", r.paragraph) for r in got} <= wanted


def test_patience_skips_what_never_comes(spark, run):
    minute = datetime.timedelta(minutes=1)
    rows = [(*r, START + n * minute) for n, r in enumerate(_fragments()) if r[1] == "l1" and r[2] != 4]
    stray = [("l9/0", "l9", 0, "x", "x", START + 300 * minute)]  # the stream goes on elsewhere
    back = [("l1/4", "l1", 4, "x", "x", START)]
    schema = "fragment_id string, law_iri string, pos long, typ string, text string, at timestamp"
    out, _ = run([rows[:10], rows[10:], stray, back], schema, lambda s: keyed.paragraphs_in_turn(s, "at", "20 minutes"))
    got = out.collect()
    assert len(got) == 26 and [r.pos for r in got if r.late] == [4]
    paragraphs = {r.pos: r.paragraph for r in got if r.law_iri == "l1" and not r.late}
    assert paragraphs[3] == paragraphs[6] == "2a" and paragraphs[10] is None and paragraphs[19] == "14a" and paragraphs[20] is None
