"""Streams with keyed state that ends: texts seen lately, fragments in their order.

State lies in RocksDB and in the stream's checkpoint, so a lost executor's keys go on
elsewhere.  What a key holds in memory at once is one batch of Arrow rows and what is said at
each function.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rillmark import packaging

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def kept_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state in RocksDB, as those below have to."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def _runs(rows: pd.DataFrame, lifetime: int) -> pd.DataFrame:
    """Rows (x_at, x_until, ...) whose times chain up with gaps below the lifetime, as one: the
    first of them with the end of the last."""
    rows = rows.sort_values(["x_at", "x_tie"], kind="stable")
    reach = rows["x_until"].cummax()
    run = (rows["x_at"] - reach.shift() >= lifetime).cumsum()
    first = rows[~run.duplicated()].copy()
    first["x_until"] = reach.groupby(run).max().to_numpy()
    return first


class _Recent(StatefulProcessor):
    def __init__(self, lifetime: int):
        self.lifetime = lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long")

    def _wake(self) -> None:
        self.handle.registerTimer((self.last.get()[0] + self.lifetime) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = None
        for batch in rows:
            batch = batch.assign(x_until=batch["x_at"])
            runs = _runs(batch if runs is None else pd.concat([runs, batch]), self.lifetime)
        known = self.last.exists()
        held = self.last.get()[0] if known else None
        new = runs if held is None else runs[runs["x_at"] - held >= self.lifetime]
        until = int(runs["x_until"].max())
        self.last.update((until if held is None else max(until, held),))
        if not known:
            self._wake()
        yield new[["x_row"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            if (self.last.get()[0] + self.lifetime) // 1000 < timerValues.getCurrentWatermarkInMs():
                self.last.clear()
            else:
                self._wake()
        yield pd.DataFrame({"x_row": pd.Series([], dtype=object)})

    def close(self) -> None:
        pass


def recent_texts(stream: DataFrame, group: str, text: str, time: str, lifetime: int, late: str = "10 minutes") -> DataFrame:
    """Rows whose text was not seen in its group in the ``lifetime`` seconds before, by the
    stream's own ``time``; every sighting counts, passed on or not.

    Texts are told apart by hash, trimmed, null as empty.  Of equal times the row with the
    least hash of all columns is the first.  A text's state goes once the watermark is past
    its lifetime.  Rows older than the watermark, or without a time, are left out; one that
    comes late, but not too late, is not passed on if a later one was seen.  Of a hot text a
    batch is folded into runs, a row for each lifetime that it spans."""
    packaging.send(stream.sparkSession)
    stamps = [f.name for f in stream.schema if f.dataType.simpleString() == "timestamp"]
    hashed = F.sha1(F.trim(F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    rows = stream.filter(F.col(time).isNotNull()).withWatermark(time, late)
    # Python gets all columns as one, and times as numbers: nulls, names and time zones stay
    row = F.struct(*[F.unix_micros(c).alias(c) if c in stamps else F.col(c) for c in stream.columns])
    rows = rows.select(row.alias("x_row"), F.unix_micros(time).alias("x_at"), F.xxhash64(*stream.columns).alias("x_tie"), hashed.alias("x_hash"), F.col(group).alias("x_group"), F.col(time).alias("x_time"))
    found = rows.groupBy("x_group", "x_hash").transformWithStateInPandas(_Recent(lifetime * 1_000_000), rows.select("x_row").schema, "append", "EventTime")
    return found.select(*[F.timestamp_micros(f"x_row.{c}").alias(c) if c in stamps else F.col(f"x_row.{c}").alias(c) for c in stream.columns])


class _InTurn(StatefulProcessor):
    """Held fragments lie in pages of PAGE places, each one value of the state: a key and
    batch reads and writes a page once, not each fragment.  KEPT pages are open at a time."""

    BATCH, PAGE, KEPT = 1000, 128, 8

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "next long, paragraph string, held long")
        self.held = handle.getMapState("pages", "page long", "rows string")

    def _start(self) -> None:
        self.at, self.paragraph, self.n_held = self.turn.get() or (0, None, 0)
        self.pages: dict[int, dict[int, list]] = {}
        self.changed: set[int] = set()

    def _page(self, page: int) -> dict[int, list]:
        if page not in self.pages:
            while len(self.pages) >= self.KEPT:
                self._put(next(iter(self.pages)))
            found = self.held.getValue((page,))
            self.pages[page] = {} if found is None else {r[0]: r[1:] for r in json.loads(found[0])}
        return self.pages[page]

    def _put(self, page: int) -> None:
        rows = self.pages.pop(page)
        if page in self.changed:
            self.changed.remove(page)
            if rows:
                self.held.updateValue((page,), (json.dumps([[pos, *r] for pos, r in rows.items()]),))
            else:
                self.held.removeKey((page,))

    def _end(self) -> None:
        for page in list(self.pages):
            self._put(page)
        self.turn.update((self.at, self.paragraph, self.n_held))

    def _frame(self, law, rows: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        out = pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(("fragment_id", "pos", "text", "paragraph"), columns, strict=False)})
        return out.assign(pos=out["pos"].astype("Int64"), late=list(columns[4]), law_iri=law)

    def _out(self, fragment: str, text: str, sets: bool, named: str | None) -> tuple:
        self.paragraph = named if sets else self.paragraph
        self.at += 1
        return fragment, self.at - 1, text, self.paragraph, False

    def _advance(self, out: list[tuple]) -> None:
        """Passes on what is held at the next places, until BATCH rows are together."""
        while self.n_held and len(out) < self.BATCH:
            page = self.at // self.PAGE
            row = self._page(page).pop(self.at, None)
            if row is None:
                return
            self.changed.add(page)
            self.n_held -= 1
            out.append(self._out(*row))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._start()
        law, waits, latest = key[0], False, -1
        for batch in rows:
            out: list[tuple] = []
            latest = max(latest, int(batch["seen"].max()))
            columns = ["pos", "fragment_id", "text", "sets", "named"]
            given = [[None if pd.isna(v) else v for v in row] for row in zip(*(batch[c].tolist() for c in columns), strict=True)]
            for pos, fragment, text, sets, named in sorted(given, key=lambda r: (r[0] is None, r[0] or 0)):
                pos = None if pos is None else int(pos)
                # what is held at the next place comes before it is asked whether a place is taken
                if pos is None or pos < self.at:
                    out.append((fragment, pos, text, None, True))
                elif pos == self.at:
                    out.append(self._out(fragment, text, bool(sets), named))
                else:
                    page = self._page(pos // self.PAGE)
                    if pos in page:
                        out.append((fragment, pos, text, None, True))
                        continue
                    page[pos] = [fragment, text, bool(sets), named]
                    self.changed.add(pos // self.PAGE)
                    self.n_held += 1
                    waits = True
                    continue
                while pos == self.at - 1 and self.n_held:
                    before = len(out)
                    self._advance(out)
                    if len(out) < self.BATCH or len(out) == before:
                        break
                    yield self._frame(law, out)
                    out = []
                    pos = self.at - 1
            if out:
                yield self._frame(law, out)
        self._end()
        if waits and latest >= 0:
            self.handle.registerTimer(latest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._start()
        out: list[tuple] = []
        for number in sorted(k[0] for k in self.held.keys()):
            page = self._page(number)
            for pos in sorted(page):
                self.at = pos
                out.append(self._out(*page.pop(pos)))
            self.n_held, self.changed = max(0, self.n_held), self.changed | {number}
            if len(out) >= self.BATCH:
                yield self._frame(key[0], out)
                out = []
        if out:
            yield self._frame(key[0], out)
        self.n_held = 0
        self._end()

    def close(self) -> None:
        pass


def paragraphs_in_turn(stream: DataFrame, time: str | None = None, patience: str = "1 hour", marker: str = "Paragraf") -> DataFrame:
    """The paragraph in force at each fragment, as ``ingest.paragraph_context`` finds it in a
    table, of fragments that arrive in any order: fragment_id, law_iri, pos, text, paragraph,
    late.

    ``stream`` has fragment_id, law_iri, pos (0, 1, 2 ... in each law), typ and text.  A
    fragment is held until all before it have come.  With a ``time``, what a law holds is
    passed on in its order, and the places missing are skipped, once the stream is further
    than its last held batch by ``patience``; without, it waits for ever.  A fragment whose
    place has passed, is taken or is null comes out late, without a paragraph: none is lost."""
    packaging.send(stream.sparkSession)
    named = F.nullif(F.regexp_extract(F.coalesce("text", F.lit("")), r"(?i)§\s*([0-9]+[a-z]?)", 1), F.lit(""))
    sets = F.coalesce((F.col("typ") == marker) | named.isNotNull(), F.lit(False))
    timed = stream.withWatermark(time, patience) if time else stream
    # as a number the time is not the watermark's column, so Spark drops no late row
    seen = F.coalesce(F.unix_millis(time), F.lit(0)) if time else F.lit(-1).cast("long")
    rows = timed.select("law_iri", F.col("pos").cast("long").alias("pos"), F.col("fragment_id").cast("string").alias("fragment_id"), "text", sets.alias("sets"), named.alias("named"), seen.alias("seen"))
    law = stream.schema["law_iri"].dataType.simpleString()
    schema = f"fragment_id string, pos long, text string, paragraph string, late boolean, law_iri {law}"
    return rows.groupBy("law_iri").transformWithStateInPandas(_InTurn(), schema, "append", "EventTime" if time else "None")
