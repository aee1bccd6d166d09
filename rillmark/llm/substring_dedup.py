"""Substring dedup: repeated windows of 35 words, merged into maximal removal intervals.

Every window of every text gets a Rabin-Karp hash.  Counting all of them would shuffle a
row for each word of the corpus, so windows are first told apart by an anchor: the least
hash among the 24 runs of 12 words inside a window.  Equal windows have equal anchors, so
a window whose anchor occurs once in the corpus is unique.

1. Anchor occurrences (about one in twelve words) are summed in each task, then by key.
   A bitmap of the anchors that occur twice or more, of a size bound by BITMAP_BITS, goes
   to all tasks.  False positives only leave more windows to count.
2. The remaining windows come in runs that share an anchor occurrence.  Where a text has a
   run is one row; the run's window hashes are one row in each task that meets it (so a
   passage in a third of all documents is one row a task from then on).  Dealt by anchor,
   windows are counted by (anchor, window hash), two 64-bit hashes of their words.  An
   anchor with more than HOT_RUNS such rows (a phrase of 12 words in many surroundings) is
   not dealt as one: its windows are summed in each task, then by window.
3. Each distinct run gets a bit mask of its repeated windows; the masks join back to the
   runs, runs of one text are gathered (copies of a text share them) and join the texts.

Scale: rows moved are anchors, candidate runs and, once, the texts.  Every group-by has a
map-side sum; the joins on hot runs, hot windows and hot texts are plain equi-joins that
Spark splits when skewed.  The bitmap is made of 64-bit words by map-side bit_or; it is a
filter alone, so a corpus that fills it counts more windows and loses none.

Defined cases: null text has no words: 0, 0, the digest of the empty string; a text of
fewer than 35 words keeps all; repeated rows are repeats of each other; an empty table
gives an empty result; extra columns are ignored or passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rolling, shared

WINDOW = 35
#: Words in an anchor.
ANCHOR = 12
#: Windows in a row of runs at most: a mask has 63 bits.
RUN = 60
#: Bits of the bitmap of repeated anchors: 64 for each, within these bounds (16 kB, 64 MB).
BITMAP_BITS = (17, 29)
#: Anchors, and runs, that a task holds before it passes their counts on.
HELD, HELD_RUNS = 1_000_000, 60_000
#: Rows of runs beyond which an anchor's windows are not dealt by it.
HOT_RUNS = 1_000


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _anchored(texts: list[bytes], window: int, anchor: int):
    """For a chunk of texts: word hashes, offsets, anchor of every window, and the hashes
    at the places that are some window's anchor."""
    words, offsets = rolling.word_hashes(texts)
    if len(words) < window:
        none = np.empty(0, dtype=np.uint64)
        return words, offsets, none, np.empty(0, dtype=bool), none
    grams = rolling.window_hashes(words, anchor)
    span = window - anchor + 1
    least = rolling.sliding(grams, span)
    valid = rolling.inside(offsets, len(words), window)
    # a place is an anchor if it equals the least hash of a valid window that covers it
    held = np.zeros(len(least) + 2 * (span - 1), dtype=np.uint64)
    held[span - 1 : span - 1 + len(least)] = np.where(valid, least, 0)
    most = rolling.sliding(held, span, np.maximum)
    return words, offsets, least, valid, grams[grams <= most]


def _count_anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["anchor", "n"])

        for batch in batches:
            texts = _texts(batch.column(0))
            for a, b in rolling.chunks(texts):
                held.append(_anchored(texts[a:b], window, anchor)[4])
                size += len(held[-1])
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _bitmap(repeated: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the anchors: a 64-bit word for each 64 slots that has any, or-ed in
    each task, then by word."""
    slot = F.expr(f"shiftrightunsigned(anchor, {64 - bits})")
    words = repeated.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("on")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype="<i8")
    out[words.column("word").to_numpy()] = words.column("on").to_numpy()
    return out.view(np.uint8)


def _find_runs(window: int, anchor: int, bitmap, bits: int):
    """Two kinds of rows: where a text has a run (d1, d2, start, anchor, run), and, once
    for each distinct run that a task has met, its count and window hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bitmap.value
        held: dict[int, list] = {}

        def flush() -> pa.RecordBatch:
            of = list(held.values())
            sizes = np.array([len(x[2]) for x in of], dtype=np.int32)
            none = pa.nulls(len(of), pa.int64())
            out = pa.record_batch(
                [none, none, pa.nulls(len(of), pa.int32()), pa.array([x[0] for x in of], pa.int64()), pa.array(list(held), pa.int64()), pa.array([x[1] for x in of], pa.int64()), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate([x[2] for x in of])))],
                names=RUNS,
            )
            held.clear()
            return out

        for batch in batches:
            texts = _texts(batch.column(0))
            keys = [batch.column(i).to_numpy() for i in (1, 2)]
            for a, b in rolling.chunks(texts):
                words, offsets, least, valid, _ = _anchored(texts[a:b], window, anchor)
                if not len(least):
                    continue
                slot = (least >> rolling.U(64 - bits)).astype(np.int64)
                take = valid & ((marks[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
                at = np.flatnonzero(take)
                if not len(at):
                    continue
                hashes = rolling.window_hashes(words, window)[at]
                text = np.searchsorted(offsets, at, side="right") - 1
                fresh = np.ones(len(at), dtype=bool)
                fresh[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (text[1:] != text[:-1])
                first = np.flatnonzero(fresh)
                sizes = np.diff(np.append(first, len(at)))
                if sizes.max() > RUN:  # long runs (periodic texts) go in pieces
                    first = np.concatenate([np.arange(f, f + s, RUN) for f, s in zip(first, sizes, strict=True)])
                    sizes = np.diff(np.append(first, len(at)))
                place = np.arange(len(at)) - np.repeat(first, sizes)
                ids = rolling.mix(np.add.reduceat(rolling.mix(hashes + place.astype(np.uint64)), first) + sizes.astype(np.uint64)).view(np.int64)
                anchors = least[at[first]].view(np.int64)
                for i, n, f, k in zip(ids.tolist(), anchors.tolist(), first.tolist(), sizes.tolist(), strict=True):
                    known = held.get(i)
                    if known:
                        known[1] += 1
                    else:
                        held[i] = [n, 1, hashes[f : f + k].view(np.int64).copy()]
                of = text[first]
                none = pa.nulls(len(first), pa.list_(pa.int64()))
                yield pa.record_batch(
                    [pa.array(keys[0][a:b][of]), pa.array(keys[1][a:b][of]), pa.array((at[first] - offsets[of]).astype(np.int32)), pa.array(anchors), pa.array(ids), pa.nulls(len(first), pa.int64()), none],
                    names=RUNS,
                )
                if len(held) > HELD_RUNS:
                    yield flush()
        if held:
            yield flush()

    return run


RUNS = ["d1", "d2", "start", "anchor", "run", "n", "windows"]


def _masks_by_anchor(met: DataFrame) -> DataFrame:
    """anchor, run and mask of the repeated windows, for rows that are dealt by anchor."""
    distinct = met.groupBy("anchor", "run").agg(F.sum("n").alias("n"), F.first("windows").alias("windows"))
    each = distinct.select("anchor", "run", "n", F.posexplode("windows").alias("i", "window"))
    counted = each.withColumn("total", F.sum("n").over(Window.partitionBy("anchor", "window")))
    return counted.filter("total > 1").groupBy("anchor", "run").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("mask"))


def _masks_by_window(met: DataFrame) -> DataFrame:
    """The same for hot anchors: no group is gathered, sums and masks are map-side first."""
    distinct = shared.table(met.groupBy("anchor", "run").agg(F.sum("n").alias("n"), F.first("windows").alias("windows")), "dedup-hot-runs")
    each = distinct.select("anchor", "run", "n", F.posexplode("windows").alias("i", "window"))
    # stored, so that Spark can split a hot window of the join
    total = shared.table(each.groupBy("anchor", "window").agg(F.sum("n").alias("total")).filter("total > 1").drop("total"), "dedup-hot-windows")
    return each.join(total, ["anchor", "window"], "left_semi").groupBy("anchor", "run").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("mask"))


def removal_masks(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per distinct text with repeated windows: d1, d2 (hashes of the text) and marks,
    array<struct<start, mask>>: bit i of mask tells that the window at word start + i is
    repeated."""
    spark = docs.sparkSession
    texts = docs.select("text")
    repeated = shared.table(
        shared.map_arrow(texts, _count_anchors(window, anchor), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"),
        "dedup-anchors",
    )
    bits = max(BITMAP_BITS[0], min(BITMAP_BITS[1], (64 * repeated.count()).bit_length()))
    marks = spark.sparkContext.broadcast(_bitmap(repeated, bits))
    runs = shared.table(
        shared.map_arrow(
            docs.select("text", F.xxhash64("text").alias("d1"), F.hash("text").cast("long").alias("d2")),
            _find_runs(window, anchor, marks, bits),
            "d1 long, d2 long, start int, anchor long, run long, n long, windows array<long>",
        ),
        "dedup-runs",
    )
    met = runs.filter("windows IS NOT NULL").select("anchor", "run", "n", "windows")
    hot = shared.table(met.groupBy("anchor").agg(F.count("*").alias("of")).filter(F.col("of") > HOT_RUNS).select("anchor"), "dedup-hot")
    crowded = not hot.isEmpty()
    # dealt by anchor once, the sums by run and by window and the masks need no other shuffle
    few = met.join(hot, "anchor", "left_anti") if crowded else met
    masks = _masks_by_anchor(few.repartition("anchor"))
    if crowded:
        masks = masks.unionByName(_masks_by_window(met.join(hot, "anchor", "left_semi")))
    return (
        runs.filter("windows IS NULL")
        .select("d1", "d2", "start", "anchor", "run")
        .join(masks, ["anchor", "run"])
        .select("d1", "d2", "start", "mask")
        .distinct()
        .groupBy("d1", "d2")
        .agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    )


def _cut(window: int, text_at: int, marks_at: int, names: list[str] | None):
    """names None: the digest columns; else the rows with the kept words as text."""
    bits = np.arange(63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(marks_at)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(marks), 0).to_numpy(zero_copy_only=False)).tolist()
            starts, masks = (x.to_numpy(zero_copy_only=False) for x in marks.flatten().flatten())
            n_words, n_removed, kept = [], [], []
            for t, a, b in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), [0, *ends], ends, strict=False):
                words = (t or b"").split()
                n_words.append(len(words))
                left = words
                if b > a:
                    row, bit = np.nonzero((masks[a:b, None] >> bits) & 1)
                    at = starts[a:b][row] + bit
                    edge = np.zeros(len(words) + 1, dtype=np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                n_removed.append(len(words) - len(left))
                if names is None:
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    kept.append(b" ".join(left).decode() if b > a else (t.decode() if t is not None else None))
            if names is None:
                yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                new = {"text": pa.array(kept, pa.string()), "n_chars": pa.array([None if k is None else len(k) for k in kept], pa.int64())}
                yield pa.record_batch([new.get(n, batch.column(i)) for i, n in enumerate(names)], names=names)

    return run


#: Columns that stand beside the caller's on the way.
OWN = ("_k1", "_k2", "_d1", "_d2", "_marks")


def _marked(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    masks = removal_masks(docs, window, anchor).withColumnsRenamed({"d1": "_d1", "d2": "_d2", "marks": "_marks"})
    keyed = docs.withColumns({"_k1": F.xxhash64("text"), "_k2": F.hash("text").cast("long")})
    return keyed.join(masks, (F.col("_k1") == F.col("_d1")) & (F.col("_k2") == F.col("_d2")), "left")


def dedup_digest(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    rows = _marked(docs.select("doc_id", "text"), window, anchor).select("doc_id", "text", "_marks")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return shared.map_arrow(rows, _cut(window, 1, 2, None), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of ``docs`` with the repeated words gone from text (kept words joined by a
    space; untouched texts stay as they are) and n_chars, where there is one, renewed."""
    docs, back = shared.aside(docs, OWN)
    names = docs.columns
    rows = _marked(docs, window, anchor).select(*[f"`{n}`" for n in names], "_marks")
    return shared.map_arrow(rows, _cut(window, names.index("text"), len(names), names), docs.schema).withColumnsRenamed(back)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(shared.read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, COALESCE(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words FROM documents),
starts AS (SELECT r, words, unnest(range(1, len(words) - 33)) AS p FROM w WHERE len(words) >= 35),
grams AS (SELECT r, p, array_to_string(words[p:p + 34], ' ') AS g FROM starts),
repeated AS (SELECT g FROM grams GROUP BY g HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, p + o AS q FROM (SELECT r, p FROM grams JOIN repeated USING (g)) CROSS JOIN (SELECT unnest(range(0, 35)) AS o)),
removed AS (SELECT r, count(*) AS n, list(q) AS qs FROM covered GROUP BY r),
each AS (SELECT w.r, u.word, u.q FROM w, LATERAL (SELECT unnest(w.words) AS word, unnest(range(1, len(w.words) + 1)) AS q) u),
kept AS (SELECT e.r, string_agg(e.word, ' ' ORDER BY e.q) AS t FROM each e LEFT JOIN covered c ON e.r = c.r AND e.q = c.q WHERE c.q IS NULL GROUP BY e.r)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, COALESCE(removed.n, 0)::BIGINT AS n_removed, sha256(COALESCE(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN removed ON w.r = removed.r LEFT JOIN kept ON w.r = kept.r
"""
