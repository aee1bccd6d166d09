"""Benchmark decontamination with a generalised suffix automaton.

The normalised items make one automaton over words.  Each text is streamed through it:
the state after a word tells the longest run of words, ending there, that occurs in some
item.  Where that run reaches 13 words, the last 13 are a window of an item; an item of
fewer words is a window itself and is found at the state (or a suffix link) that stands
for it.  Words inside any occurrence are hit.

Limits: a text whose hit words make up COVERAGE or more of its words (20 * n_hit >=
n_words in the contract) is contaminated.  ``decontaminate`` drops those, or, with
``cut=True``, removes the spans of at least ``span`` words and keeps the rest.

Scale: one narrow pass over the texts, no shuffle.  Items are read in blocks of about
BLOCK_WORDS words, one automaton each; a block is all that goes to the driver and to a
worker at once.  Each further block scans the texts once more and writes only the hits, by
a hash of the text; they join in the last pass, broadcast where they are counted to be few.

Defined cases: null text or no words: nothing hit, not contaminated; null or empty item:
no window; null item_id counts as the empty string; items equal in id count once; repeated
rows are judged each; empty tables give empty or unhit results; columns of the input that
are named like a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

WINDOW = 13
#: A text is contaminated from one hit word in so many.
COVERAGE = 20
#: Words of items in one automaton, and texts that other blocks hit that may be broadcast.
BLOCK_WORDS, FEW_HITS = 200_000, 20_000

#: ASCII letters lower-cased, digits and bytes of other characters kept, all else a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Automaton:
    """A suffix automaton of several word sequences, with the windows of each item."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.windows: dict[tuple[int, ...], set[str]] = {}
        short: dict[int, dict[int, set[str]]] = {}
        ends = []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if not ids:
                continue
            state = 0
            for i in ids:
                state = self._extend(state, i)
            ends.append((name, ids))
            for at in range(len(ids) - window + 1):
                self.windows.setdefault(tuple(ids[at : at + window]), set()).add(name)
        for name, ids in ends:
            if len(ids) < window:
                state = 0
                for i in ids:
                    state = self.step[state][i]
                short.setdefault(state, {}).setdefault(len(ids), set()).add(name)
        # short[state]: (words, items) of the short items that end wherever the state is met
        self.short: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.step)
        for state in sorted(range(len(self.step)), key=self.length.__getitem__):
            up = self.short[self.link[state]] if state else ()
            self.short[state] = up + tuple((n, frozenset(x)) for n, x in sorted(short.get(state, {}).items()))

    def _extend(self, last: int, symbol: int) -> int:
        step, link, length = self.step, self.link, self.length
        if symbol in step[last]:
            q = step[last][symbol]
            return q if length[q] == length[last] + 1 else self._split(last, q, symbol)
        new = self._state(length[last] + 1, {})
        p = last
        while p != -1 and symbol not in step[p]:
            step[p][symbol] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = step[p][symbol]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
        return new

    def _state(self, length: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.step.append(step)
        self.link.append(0)
        return len(self.length) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """The part of state q that ends what p stands for, as a state of its own."""
        clone = self._state(self.length[p] + 1, dict(self.step[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.step[p].get(symbol) == q:
            self.step[p][symbol] = clone
            p = self.link[p]
        return clone

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """The hit spans [start, end) in order, merged, and the items met."""
        step, link, length, short, window = self.step, self.link, self.length, self.short, self.window
        ids = list(map(self.vocabulary.get, words))
        spans: list[list[int]] = []
        items: set[str] = set()
        state = run = 0
        for at, i in enumerate(ids):
            if i is None:
                state = run = 0
                continue
            while i not in step[state]:
                state = link[state]
                run = length[state]
            state = step[state][i]
            run += 1
            size = 0
            if run >= window:
                size = window
                items |= self.windows[tuple(ids[at - window + 1 : at + 1])]
            for n, names in short[state]:
                if n <= run:
                    size = max(size, n)
                    items |= names
            if size:
                start = at + 1 - size
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, at + 1])
        return spans, items


_built: dict[str, Automaton] = {}


def _automaton(items: list[tuple[str, bytes]], window: int) -> Automaton:
    """One automaton is kept in each Python worker."""
    key = hashlib.sha256(repr((items, window)).encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, window)
    return _built[key]


def _merge(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _spans(spans: list[list[int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans]


def _hits(broadcast, window: int):
    """The texts that a block hits, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(broadcast.value, window)
        for batch in batches:
            found = [automaton.scan(words_of(t)) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            take = pa.array([i for i, (s, _) in enumerate(found) if s], pa.int64())
            hit = [x for x in found if x[0]]
            yield pa.record_batch([*[batch.column(i).take(take) for i in range(2)], pa.array([sorted(i) for _, i in hit], ITEMS), pa.array([_spans(s) for s, _ in hit], SPANS)], names=["h1", "h2", "items", "spans"])

    return run


def _scan(broadcast, window: int, names: list[str]):
    """The rows with the hits of the last block and those known of the others."""
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(broadcast.value, window)
        for batch in batches:
            n_words, spans, items = [], [], []
            known = zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True)
            for t, (old_items, old_spans) in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), known, strict=True):
                words = words_of(t)
                s, i = automaton.scan(words)
                if old_items:
                    s, i = _merge(s, [[x["start"], x["end"]] for x in old_spans]), i | set(old_items)
                n_words.append(len(words))
                spans.append(_spans(s))
                items.append(sorted(i))
            hit = [sum(x["end"] - x["start"] for x in s) for s in spans]
            yield pa.record_batch([*[batch.column(i) for i in range(len(names))], pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, ITEMS), pa.array(spans, SPANS)], names=[*names, *RESULT])

    return run


RESULT = ("n_words", "n_hit", "items", "spans")
ITEMS, SPANS = pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
KNOWN = "array<string>", "array<struct<start:int,end:int>>"


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` with n_words, n_hit, items (ids as strings, sorted) and spans
    (word offsets of the hits)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.regexp_count(shared.lower_ascii(F.col("text")), F.lit(shared.ALNUM))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_words))

    def block(b: int):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).sort("item_id", "text").toLocalIterator()
        return spark.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in rows])

    out, back = shared.aside(docs.drop(*RESULT), ("_items", "_spans", "_h1", "_h2"))
    names = out.columns
    hashes = F.xxhash64("text"), F.hash("text").cast("long")
    known = None
    for b in range(blocks - 1):
        hit = shared.map_arrow(out.select(hashes[0].alias("h1"), hashes[1].alias("h2"), "text"), _hits(block(b), window), f"h1 long, h2 long, items {KNOWN[0]}, spans {KNOWN[1]}")
        hit = shared.table(hit.distinct(), "decontaminate")
        known = hit if known is None else known.unionByName(hit)
    if known is None:
        rows = out.withColumns({"_items": F.lit(None).cast(KNOWN[0]), "_spans": F.lit(None).cast(KNOWN[1])})
    else:
        # a row for each text and block that hits it, then one for each text
        known = known.groupBy("h1", "h2").agg(F.flatten(F.collect_list("items")).alias("_items"), F.flatten(F.collect_list("spans")).alias("_spans"))
        known = shared.table(known.withColumnsRenamed({"h1": "_h1", "h2": "_h2"}), "decontaminate")
        known = F.broadcast(known) if known.count() <= FEW_HITS else known
        rows = out.join(known, (F.col("_h1") == hashes[0]) & (F.col("_h2") == hashes[1]), "left").drop("_h1", "_h2")
    added = ", ".join(f"{n} {t}" for n, t in zip(RESULT, ("long", "long", *KNOWN), strict=True))
    schema = T.StructType([*out.schema.fields, *T.StructType.fromDDL(added).fields])
    return shared.map_arrow(rows, _scan(block(blocks - 1), window, names), schema).withColumnsRenamed(back)


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * COVERAGE >= F.col("n_words"))


def _without_spans(span: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for t, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                drop = [x for x in spans or [] if x["end"] - x["start"] >= span]
                text.append(None if t is None else _cut_words(t, drop) if drop else t.decode())
            new = {"text": pa.array(text, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in text], pa.int64())}
            yield pa.record_batch([new.get(n, batch.column(i)) for i, n in enumerate(names)], names=names)

    return run


def _cut_words(text: bytes, spans: list[dict]) -> str:
    """The text without the bytes from each span's first word to its last."""
    clean = text.translate(_WORDS)
    starts, ends, at = [], [], 0
    for w in clean.split():
        at = clean.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, at = [], 0
    for x in spans:
        out.append(text[at : starts[x["start"]]])
        at = ends[x["end"] - 1]
    out.append(text[at:])
    return b"".join(out).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, cut: bool = False, span: int = WINDOW) -> DataFrame:
    """The documents without the contaminated ones; with ``cut``, all documents without
    hit spans of at least ``span`` words.  Columns stay those of ``docs``."""
    renamed, back = shared.aside(docs, RESULT)
    hits, names = find_hits(renamed, benchmark), renamed.columns
    if not cut:
        return hits.filter(~contaminated()).select(*names).withColumnsRenamed(back)
    return shared.map_arrow(hits.select(*names, "spans"), _without_spans(span, names), renamed.schema).withColumnsRenamed(back)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_hits(shared.read(spark, sf_dir, "documents").select("doc_id", "text"), shared.read(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
             COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w FROM documents),
b AS (SELECT item_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM starts),
met AS (SELECT grams.r, grams.n, grams.p, windows.item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, p + o AS q FROM (SELECT r, n, p, unnest(range(0, n)) AS o FROM met)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, COALESCE(item_id::VARCHAR, '') AS item_id FROM met) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN found ON d.r = found.r
"""
