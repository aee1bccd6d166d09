"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is its set of word shingles, in one global order, rare shingles first.  If two
sets reach similarity s, then for every m the first n - ceil(s n) + m shingles of either
share at least m.  Each document chooses its m: a longer prefix costs more postings, but a
partner must share more of it before it is verified.  The choice weighs the estimated
postings against the estimated candidates; a pair must share the smaller m of the two.

Groups are the components of all links.  Not all pairs are made: a prefix shingle's bucket
picks pivots, every other member is compared with them, and a bucket closes once its
members are known to be connected, or each has been a pivot.  The number of pivots grows
fourfold each round, so buckets of documents that do not link end after a few rounds, and
a bucket of n near copies costs about n comparisons.  A pair's sketches, counts of shingles by their
low bits, bound the intersection from above, so that few pairs need their texts.  A bucket
need only find pairs whose first common shingle it is, so what a set has before it in the
order counts as not shared; this ends the search among near copies that do not link.

Scale: documents with equal sets are one class from the start (map-side sums), so a group
of exact copies is one row.  The order needs no exact counts: shingles met twice within a
task are summed over all documents, and the HOT most frequent go, as a table of bounded
size, to the end of the order; any order gives the same links.  Pairs are broadcast to the
texts only when counted to be at most FEW_PAIRS; beyond, the joins shuffle.  Postings of
shingles known to be in SPLIT documents or more go to their buckets without being dealt by
shingle; pivots come from map-side maxima, and hot buckets from equi-joins that Spark
splits, so no bucket is gathered in a task.
Links and components stay in tables of the shared folder.

Defined cases: null text or no words: no shingles, a component of its own; fewer words
than a shingle: the whole sequence is one; rows are told apart by a hash of doc_id and text,
so rows equal in doc_id belong together if their texts do, and rows with null doc_id link as
others do; a component is named by its least doc_id, null if it has none; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rolling, shared

#: Shingles that the order knows to be frequent, at most (two longs each), and the least
#: count of one.
HOT, OFTEN = 1 << 18, 4
#: The longest multi-match, and the postings that a verification is worth.
MOST_MATCHES, VERIFY = 4, 16
#: Pairs, and rows of pivots, that may be broadcast (three longs, seven values each).
FEW_PAIRS, FEW_PIVOTS = 1_000_000, 100_000
#: Shingles a task holds while counting.
HELD = 2_000_000
#: The count from which a shingle's postings are not dealt by the shingle.
SPLIT = 256


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    lowered = [(t or b"").lower() for t in texts]
    out = []
    for a, b in rolling.chunks(lowered):
        words, offsets = rolling.word_hashes(lowered[a:b])
        grams = rolling.window_hashes(words, k)
        for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if e - s >= k:
                out.append(np.unique(grams[s : e - k + 1]))
            elif e > s:
                whole = np.full(1, e - s, dtype=np.uint64)
                for w in words[s:e]:
                    whole = rolling.mix(whole * rolling.U(3) + w)
                out.append(whole)
            else:
                out.append(np.empty(0, dtype=np.uint64))
    return out


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _frequent(k: int):
    """Shingles that occur in several texts of what a task holds, with how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values.sort()
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            counts = np.diff(np.append(first, len(values)))
            often = counts > 1
            return pa.record_batch([pa.array(values[first[often]].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["shingle", "n"])

        for batch in batches:
            for s in shingle_sets(_binary(batch.column(0)), k):
                held.append(s)
                size += len(s)
                if size >= HELD:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


def prefix_of(shingles: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int, float]:
    """The prefix, in order, its multi-match m and the mean count of its shingles."""
    n = len(shingles)
    order = np.lexsort((shingles, counts))
    least = -(-n * num // den)
    others = np.cumsum(np.maximum(counts[order] - 1, 0))
    best = None
    for m in range(1, min(MOST_MATCHES, least) + 1):
        size = min(n, n - least + m)
        cost = size + others[size - 1] * (1 + VERIFY / m)
        if best is None or cost < best[0]:
            best = (cost, m, size)
    _, m, size = best
    return shingles[order[:size]], m, float(counts[order[:size]].mean())


def sketch_of(shingles: np.ndarray) -> bytes:
    """Counts of the shingles by their low bits, in half as many places as shingles or
    fewer, a power of two.  The sum of the lesser counts of two sets, in the places of the
    coarser one, is at least their intersection."""
    places = 1 << max(4, (len(shingles) // 2).bit_length())
    counts = np.bincount((shingles & rolling.U(places - 1)).astype(np.int64), minlength=places)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes) -> int:
    """At least the intersection of two sets, by their sketches."""
    x, y = np.frombuffer(a, dtype=np.uint8).astype(np.int64), np.frombuffer(b, dtype=np.uint8).astype(np.int64)
    if x.max() == 255 or y.max() == 255:  # a count may be larger
        return 1 << 62
    places = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, places).sum(axis=0), y.reshape(-1, places).sum(axis=0)).sum())


def _may_link(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n_u, n_v, a, b = (batch.column(i).to_pylist() for i in range(6))
            take = []
            for i in range(len(u)):
                both = most_common(a[i], b[i])
                if (den + num) * both >= num * (n_u[i] + n_v[i]):
                    take.append(i)
            yield batch.select([0, 1]).take(pa.array(take, pa.int64()))

    return run


def _prefixes(k: int, num: int, den: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, often = hot.value
        for batch in batches:
            rows: list[tuple] = []
            for s in shingle_sets(_binary(batch.column(2)), k):
                if not len(s):
                    rows.append((0, 0, 0, 0, 0.0, [], b""))
                    continue
                counts = np.zeros(len(s), dtype=np.int64)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    known = frequent[at] == s
                    counts[known] = often[at[known]]
                prefix, m, typical = prefix_of(s, counts, num, den)
                one, two = rolling.mix(s).sum(), rolling.mix(s ^ rolling.U(0xA5A5A5A5A5A5A5A5)).sum()
                rows.append((len(s), int(one.view(np.int64)), int(two.view(np.int64)), m, typical, prefix.view(np.int64), sketch_of(s)))
            n, s1, s2, m, typical, prefix, sketch = zip(*rows, strict=True) if rows else ((),) * 7
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(m, pa.int32()), pa.array(typical, pa.float64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["row", "doc_id", "n", "s1", "s2", "m", "typical", "prefix", "sketch"],
            )

    return run


def _verify(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            mine = shingle_sets(_binary(batch.column(2)), k)
            pivots = _binary(batch.column(3))
            keep = []
            for i, p in enumerate(u):
                if last is None or last[0] != p:
                    last = (p, shingle_sets([pivots[i]], k)[0])
                both = len(np.intersect1d(last[1], mine[i], assume_unique=True))
                keep.append(den * both >= num * (len(last[1]) + len(mine[i]) - both))
            take = np.flatnonzero(keep)
            yield pa.record_batch([pa.array(np.array(u)[take], pa.int64()), pa.array(np.array(v)[take], pa.int64())], names=["u", "v"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node reachable) for every node of ``edges`` (u, v): each
    node takes the least label around it, then the label of its label, until none changes."""
    both = shared.table(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "join-edges")
    labels = shared.table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"), "join-labels")
    last = labels
    while True:
        around = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        near = labels.join(around, labels.node == around.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = shared.table(near.join(jump, near.label == jump["at"]).select("node", "old", F.least("label", "further").alias("label")), "join-labels")
        shared.drop(last)
        last = new
        labels = new.select("node", "label")
        if new.filter("label != old").isEmpty():
            labels.stored_at = new.stored_at
            shared.drop(both)
            return labels


def row_key() -> Column:
    """What tells rows apart: repeated rows (equal doc_id and text) have one key."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs`` (doc_id long, text): doc_id, n_shingles, component_id.  Documents
    link when den * intersection >= num * union of their sets of k-word shingles."""
    return _grouped(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Per row of ``docs``: row (its key), doc_id, n, component_id, and label, a row of the
    component that names it also where no doc_id does."""
    spark = docs.sparkSession
    texts = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = shared.map_arrow(texts.select("text"), _frequent(k), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    often = shared.table(counts, "join-frequent")
    hot = shared.most_frequent(often, HOT).toArrow()
    shared.drop(often)
    values = hot.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(values)
    known = spark.sparkContext.broadcast((values[order], hot.column("n").to_numpy()[order]))
    sets = shared.table(
        shared.map_arrow(texts, _prefixes(k, num, den, known), "row long, doc_id long, n long, s1 long, s2 long, m int, typical double, prefix array<long>, sketch binary"),
        "join-sets",
    )
    ids = sets.select("row", "doc_id", "n", "s1", "s2")
    classes = shared.table(ids.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")), "join-classes")
    # the few rows that repeat a set are left out; what stands for a class does not move
    copies = ids.join(classes, ["n", "s1", "s2"]).filter("row != rep").select("row").distinct()
    copies = shared.table(copies, "join-copies")
    reps = sets.filter("n > 0").join(_few(copies), "row", "left_anti").drop("doc_id").withColumnRenamed("row", "rep")
    crowded = spark.createDataFrame(hot.select(["shingle"]).filter(pc.greater_equal(hot.column("n"), SPLIT)).to_pandas(), "shingle long")
    labels = _link(texts.select("row", "text"), reps, crowded, k, num, den)
    named = classes.withColumn("label", F.col("rep"))
    if labels is not None:
        linked = shared.table(classes.join(_few(labels), classes.rep == labels.node).select("rep", "label", "least"), "join-linked")
        least = linked.groupBy("label").agg(F.min("least").alias("least"))
        linked = shared.table(linked.select("rep", "label").join(least, "label"), "join-linked").withColumnsRenamed({"label": "_label", "least": "_least"})
        named = classes.join(_few(linked), "rep", "left").select("n", "s1", "s2", F.coalesce("_label", "rep").alias("label"), F.when(F.col("_label").isNull(), F.col("least")).otherwise(F.col("_least")).alias("least"))
    return ids.join(named, ["n", "s1", "s2"], "left").select("row", "doc_id", "n", F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("label", "row").alias("label"))


def _few(table: DataFrame, most: int | None = None) -> DataFrame:
    """Broadcast a stored table of ids where it is counted to be small."""
    return F.broadcast(table) if table.count() <= (most or FEW_PAIRS) else table


def _link(texts: DataFrame, reps: DataFrame, crowded: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """node and label of the class representatives that link; crowded: at most HOT shingles
    whose postings need no count to be known to meet."""
    # a pair that links shares one of the first n - ceil(s n) + 1; later ones serve the match
    first = F.col("n") - F.ceil(F.col("n") * num / den).cast("long") + 1
    every = reps.select(F.posexplode(F.slice("prefix", F.lit(1), first.cast("int"))).alias("at", "shingle"), "rep").select("shingle", "rep", "at")
    # dealt once: no shingle has SPLIT postings here but those that no task saw twice
    counted = every.join(F.broadcast(crowded), "shingle", "left_anti").withColumn("of", F.count("*").over(Window.partitionBy("shingle")))
    met = counted.filter("of > 1").drop("of").unionByName(every.join(F.broadcast(crowded), "shingle", "left_semi")).withColumnRenamed("rep", "met")
    first_buckets = shared.table(met.join(reps.select("rep", "n", "typical"), F.col("met") == F.col("rep")).select("shingle", "rep", "n", "typical", F.col("at").alias("lack"), F.col("rep").alias("label")), "join-buckets")
    buckets = shared.table(_alive(first_buckets, num, den), "join-buckets")
    shared.drop(first_buckets)
    links = labels = None
    pivots = 1
    while not buckets.isEmpty():
        chosen = shared.table(
            buckets.groupBy("shingle", F.pmod(F.xxhash64("rep"), F.lit(pivots)).alias("part"))
            .agg(F.max(F.struct("typical", (-F.col("rep")).alias("minus"), "n", "label", "lack")).alias("p"))
            .select("shingle", (-F.col("p.minus")).alias("pivot"), *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in ("n", "label", "lack")]),
            "join-pivots",
        )
        pairs = (
            buckets.join(_few(chosen, FEW_PIVOTS), "shingle")
            .filter("label != pivot_label")
            .filter((den + num) * _most_shared() >= num * (F.col("n") + F.col("pivot_n")))
            .select(F.col("pivot").alias("u"), F.col("rep").alias("v"))
            .distinct()
        )
        found = _verified(texts, reps, pairs, k, num, den)
        if found is not None:
            before, old = links, labels
            links = found if links is None else shared.table(links.unionByName(found), "join-links")
            labels = components(links)
            if before is not None:
                shared.drop(before, found, old)
        if labels is not None:
            named = buckets.drop("label").join(_few(labels), F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("label", "rep")).drop("node")
        else:
            named = buckets
        done = chosen.select("shingle", F.col("pivot").alias("rep"))
        rest = shared.table(named.join(done, ["shingle", "rep"], "left_anti"), "join-rest")
        shared.drop(buckets, chosen)
        buckets = shared.table(_alive(rest, num, den), "join-buckets")
        shared.drop(rest)
        pivots *= 4
    return labels


def _most_shared() -> Column:
    """A bound of the intersection of a pair that a bucket must find: one for which its
    shingle is the first that both have.  What either has before it is not shared."""
    return F.least(F.col("n") - F.col("lack"), F.col("pivot_n") - F.col("pivot_lack"))


def _alive(buckets: DataFrame, num: int, den: int) -> DataFrame:
    """Without the buckets of one label, and without the rows that have too many shingles
    before the bucket's to link there with any set as large as the bucket's least."""
    per = buckets.groupBy("shingle").agg(F.min("n").alias("least"), F.min("label").alias("a"), F.max("label").alias("b"))
    dead = (den + num) * (F.col("n") - F.col("lack")) < num * (F.col("n") + F.col("least"))
    return buckets.join(per.filter("a != b"), "shingle").filter(~dead).drop("least", "a", "b")


def _verified(texts: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """The pairs (pivot u, other v) that link, or None if there are none."""
    pairs = shared.table(pairs, "join-met")

    ids = {c: shared.table(pairs.select(F.col(c).alias("rep")).distinct(), "join-side") for c in "uv"}

    def side(c: str) -> DataFrame:
        # a match of one is the bucket's own shingle; shorter marks of the others that are
        # equal by chance within a prefix are counted as common
        mark = F.transform("prefix", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
        prefix = F.when(F.col("m") > 1, mark)
        return reps.join(_few(ids[c]), "rep", "left_semi").select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("m").alias(f"m_{c}"), prefix.alias(f"prefix_{c}"), F.col("sketch").alias(f"sketch_{c}"))

    alike = F.size("prefix_u") - F.size(F.array_distinct("prefix_u"))
    matched = (
        pairs.join(side("u"), "u")
        .join(side("v"), "v")
        .filter((F.least("m_u", "m_v") == 1) | (F.size(F.array_intersect("prefix_u", "prefix_v")) + alike >= F.least("m_u", "m_v")))
        .select("u", "v", "n_u", "n_v", "sketch_u", "sketch_v")
    )
    candidates = shared.table(shared.map_arrow(matched, _may_link(num, den), "u long, v long"), "join-pairs")
    shared.drop(pairs, *ids.values())
    if candidates.isEmpty():
        shared.drop(candidates)
        return None
    v_texts = texts.join(_few(candidates), texts.row == candidates.v).select("u", "v", F.col("text").alias("text_v"))
    u_ids = shared.table(candidates.select("u").distinct(), "join-side")
    u_texts = texts.join(_few(u_ids), texts.row == u_ids.u).select("u", F.col("text").alias("text_u"))
    rows = v_texts.join(u_texts, "u").select("u", "v", "text_v", "text_u")
    found = shared.table(shared.map_arrow(rows, _verify(k, num, den), "u long, v long").distinct(), "join-links")
    shared.drop(candidates, u_ids)
    return None if found.isEmpty() else found


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` for each group: the one of its least doc_id, null last.  Rows
    without a shingle are groups of their own, unless equal in doc_id and text."""
    docs, back = shared.aside(docs, ("_row", "_nth"))
    rows = shared.table(_grouped(docs, k, num, den).select("row", "doc_id", "label"), "join-rows")
    stays = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("s")).select(F.col("s.row").alias("row"))
    gone = shared.table(rows.select("row").distinct().join(stays, "row", "left_anti").withColumnRenamed("row", "_row"), "join-gone")
    again = shared.table(rows.groupBy("row").count().filter("count > 1").select(F.col("row").alias("_row")), "join-again")
    kept = docs.withColumn("_row", row_key()).join(_few(gone), "_row", "left_anti")
    if not again.isEmpty():
        order = Window.partitionBy("_row").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])))
        one = kept.join(_few(again), "_row", "left_semi").withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
        kept = kept.join(_few(again), "_row", "left_anti").unionByName(one)
    return kept.select(*[f"`{c}`" for c in docs.columns]).withColumnsRenamed(back)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.read(spark, sf_dir, "documents"), k=3, num=90, den=100)


#: Links by brute force over an inverted index; the components by repeated reach.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words FROM documents),
grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(words[p:p + 2], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) >= 3)
    UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) IN (1, 2))),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS met FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM common JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * met >= 90 * (x.n + y.n - met)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.v FROM reach JOIN links ON reach.b = links.u)
SELECT d.doc_id, COALESCE(s.n, 0)::BIGINT AS n_shingles, min(r.b)::BIGINT AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id, s.n
"""
