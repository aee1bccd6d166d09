"""Source divergence audit: how far the words of each source are from its language's.

Texts are tokenized as bytes.  A batch of texts is one buffer of UTF-8; a lookup table marks
the bytes that belong to terms, and where the marks change, terms begin and end.  Terms are
grouped by their xxhash, then each is compared byte by byte with the first of its group, so
that no two terms are ever one.  Sorted pairs of document and term are a CSR matrix, whose
rows are summed to counts of each (lang, source).  Spark sums the counts of all batches.

Kept terms stand in LEAST_DOCS documents of a language.  p = 1 + floor(PARTS * (count + 1) /
(N + V)) is a term's smoothed share; a divergence is the sum of floor((p - q)^2 / q).  Pairs
of sources are compared in blocks of terms by blocks of sources: a block is a CSR matrix of
what occurs in it, absent terms count by their number, and reduceat sums the rows.  All
numbers are whole; products are split where 64 bits would not hold them.

Scale: rows of a hot source are dealt by term.  A block has about BLOCK counts and at most
SOURCES x SOURCES pairs.  The ranked terms of a group are cut to MOST in each task before
they are shuffled.

Defined cases: null text, lang and source are empty strings; a group without terms has the
share of absent terms for all; with no kept term at all pairs have the value 0 and no terms
are listed; repeated rows are so many documents; a text's length does not matter, it is read
in pieces that end between terms; an empty table gives an empty result; extra columns are
ignored.  N + V must stay below 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmark.operators.sides import few

from . import shared

LEAST_DOCS, MOST, PARTS = 3, 200, 1_000_000_000
#: Bytes of texts that are tokenized at once.
PIECE = 4 << 20
#: Counts in a block of terms, about, and sources in a block of sources.
BLOCK, SOURCES = 200_000, 256
#: Batch rows of counts that are passed on together.
_ROWS = 100_000

_TERM = np.zeros(256, dtype=bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def terms_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of a buffer begin and end."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _TERM[data], [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def grouped(data: np.ndarray, start: np.ndarray, end: np.ndarray, hash_of: Callable[[bytes], int] = xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice of the buffer, equal for equal bytes only, and for each number
    the place of its first slice."""
    raw = data.tobytes()
    keys = np.array([hash_of(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], dtype=np.uint64)
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    size, own = end - start, first[number]
    same = size == size[own]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), np.uint64, padded, strides=(1,))
    for at in range(0, int(size.max(initial=0)), 8):
        there = np.flatnonzero(same & (size > at))
        mask = _MASK[np.minimum(size[there] - at, 8)]
        same[there] = (words[start[there] + at] & mask) == (words[start[own[there]] + at] & mask)
    unlike = np.flatnonzero(~same)
    if len(unlike):  # one hash, different bytes: these get numbers by their bytes
        known: dict[bytes, int] = {}
        firsts = list(first)
        for i in unlike.tolist():
            term = raw[start[i] : end[i]]
            if term not in known:
                known[term] = len(firsts)
                firsts.append(i)
            number[i] = known[term]
        first = np.array(firsts)
    return number, first


@dataclass
class Matrix:
    """CSR: row i has the entries rows[i] to rows[i + 1] of term and count."""

    rows: np.ndarray
    term: np.ndarray
    count: np.ndarray
    names: pa.Array


def document_matrix(data: np.ndarray, bounds: np.ndarray) -> Matrix:
    """The texts of a buffer, which begin at ``bounds``, by their terms."""
    start, end = terms_of(data)
    number, first = grouped(data, start, end)
    width = max(len(first), 1)
    key, count = np.unique((np.searchsorted(bounds, start, side="right") - 1) * width + number, return_counts=True)
    raw = data.tobytes()
    names = pa.array([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
    return Matrix(np.searchsorted(key // width, np.arange(len(bounds) + 1)), key % width, count, names)


def counts_by_group(of: Matrix, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents, summed over the rows of each group."""
    width = max(len(of.names), 1)
    key = np.repeat(groups, np.diff(of.rows)) * width + of.term
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.diff(np.concatenate([[-1], key[order]])))
    if not len(at):
        return at, at, at, at
    first = key[order][at]
    return first // width, first % width, np.add.reduceat(of.count[order], at), np.diff(np.append(at, len(key)))


def _long(text: bytes) -> Counter:
    """Counts of the terms of a text that is read in pieces."""
    out: Counter = Counter()
    data, at = np.frombuffer(text, dtype=np.uint8), 0
    while at < len(data):
        to = min(at + PIECE, len(data))
        while to < len(data):  # on to the next byte between terms
            gap = np.flatnonzero(~_TERM[data[to : to + PIECE]])
            to = min(to + (int(gap[0]) if len(gap) else PIECE), len(data))
            if len(gap):
                break
        found = document_matrix(_LOWER[data[at:to]], np.zeros(1, np.int64))
        out.update(dict(zip(found.names.take(pa.array(found.term)).to_pylist(), found.count.tolist(), strict=True)))
        at = to
    return out


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text in; lang, source, term, n, docs out, summed over PIECE bytes."""
    groups: dict[tuple[str, str], int] = {}
    texts: list[bytes] = []
    of: list[int] = []
    held = 0

    def rows(group, terms, n, docs) -> Iterator[pa.RecordBatch]:
        group = pa.array(group, pa.int64())
        columns = [pa.array([g[i] for g in groups], pa.string()).take(group) for i in (0, 1)]
        out = pa.record_batch([*columns, terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])
        for at in range(0, out.num_rows, _ROWS):
            yield out.slice(at, _ROWS)

    def flush() -> Iterator[pa.RecordBatch]:
        # a space after each text: no term reaches over two
        data = _LOWER[np.frombuffer(b"".join(t + b" " for t in texts), dtype=np.uint8)]
        found = document_matrix(data, np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]]))
        group, term, n, docs = counts_by_group(found, np.array(of))
        yield from rows(group, found.names.take(pa.array(term, pa.int64())), n, docs)

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            g = groups.setdefault((lang, source), len(groups))
            if len(text) > PIECE:
                long = _long(text)
                yield from rows([g] * len(long), pa.array(list(long), pa.string()), list(long.values()), [1] * len(long))
                continue
            texts.append(text)
            of.append(g)
            held += len(text) + 1
            if held > PIECE:
                yield from flush()
                texts, of, held = [], [], 0
    if texts:
        yield from flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences, and documents that have the term."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = shared.map_arrow(plain, _tokenized, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str):
    return F.expr(f"1 + (cast({count} + 1 as decimal(20, 0)) * {PARTS}) div {total}")


def _shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(PARTS * (count + 1) / total), a thousandfold at a time."""
    rest, out = count + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _apart(p: np.ndarray, q: np.ndarray | int) -> np.ndarray:
    return (p - q) ** 2 // q


def block_divergences(total_of: np.ndarray, own: np.ndarray, guests: np.ndarray, source: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What one block of terms adds to the divergences of ``own`` sources from ``guests``
    (numbers of sources, with N + V in ``total_of``), and how many of its terms neither of
    a pair leaves out.  Entries are counts by source and term, in any order."""
    order = np.lexsort((term, source))
    source, term, count = source[order], np.unique(term[order], return_inverse=True)[1], count[order]
    width = int(term.max(initial=-1)) + 1
    rows = np.searchsorted(source, np.arange(len(total_of) + 1))  # CSR by source
    p = _shares(count, total_of[source])
    nothing = _shares(np.zeros(len(total_of), np.int64), total_of)
    # the entries of the block's own sources, row after row
    mine = np.concatenate([np.arange(rows[g], rows[g + 1]) for g in own]) if len(own) else np.zeros(0, np.int64)
    size = np.array([rows[g + 1] - rows[g] for g in own])
    full = np.flatnonzero(size)
    starts = np.cumsum(np.append(0, size[full]))[:-1]

    def by_row(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(own), np.int64)
        if len(full):
            out[full] = np.add.reduceat(values, starts)
        return out

    absent, of_mine = nothing[own], source[mine]
    value, met = np.zeros((len(own), len(guests)), np.int64), np.zeros((len(own), len(guests)), np.int64)
    for j, h in enumerate(guests):
        theirs = slice(rows[h], rows[h + 1])
        q = np.full(width, nothing[h])
        q[term[theirs]] = p[theirs]
        has = np.zeros(width, bool)
        has[term[theirs]] = True
        at, both = q[term[mine]], has[term[mine]]
        # terms of the own source; those of the guest, as if absent, less those of both
        value[:, j] = by_row(_apart(p[mine], at) - np.where(both, _apart(nothing[of_mine], at), 0))
        for part in np.array_split(p[theirs], max(1, (rows[h + 1] - rows[h]) * len(own) // 4_000_000)):
            value[:, j] += _apart(absent[:, None], part[None, :]).sum(axis=1)
        met[:, j] = size + (rows[h + 1] - rows[h]) - by_row(both.astype(np.int64))
    return value, met


def _block(keys, frame):
    """Rows of a block (source, total, side, term, n; no term: the source itself) in;
    source, item, value, met out, for both orders of the sides."""
    import pandas as pd

    names = frame[frame.term.isna()].sort_values("source", kind="stable")
    number = {s: i for i, s in enumerate(names.source)}
    side = names.side.to_numpy()
    total = names.total.to_numpy().astype(np.int64)
    counts = frame[frame.term.notna()]
    source = counts.source.map(number).to_numpy().astype(np.int64)
    term = pd.factorize(counts.term)[0].astype(np.int64)
    n = counts.n.to_numpy().astype(np.int64)
    out = []
    twice = len(set(side)) > 1
    for own, guests in [(0, 1), (1, 0)] if twice else [(side[0], side[0])]:
        a, b = np.flatnonzero(side == own), np.flatnonzero(side == guests)
        value, met = block_divergences(total, a, b, source, term, n)
        i, j = np.meshgrid(a, b, indexing="ij")
        apart = (i != j).ravel()
        of = names.source.to_numpy()
        out.append(pd.DataFrame({"lang": keys[0], "source": of[i.ravel()[apart]], "item": of[j.ravel()[apart]], "value": value.ravel()[apart], "met": met.ravel()[apart]}))
    return pd.concat(out)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most: int = MOST) -> DataFrame:
    """lang, source, part, item, value, rank: each source's divergence from each other of
    its language (part pair), and the terms it has more of than its language (part term)."""
    counts = shared.table(term_counts(docs), "divergence-counts")
    per_term = Window.partitionBy("lang", "term")
    kept = (
        counts.withColumns({"df": F.sum("docs").over(per_term), "all": F.sum("n").over(per_term), "first": F.row_number().over(per_term.orderBy("source")) == 1})
        .filter(F.col("df") >= least_docs)
        .select("lang", "source", "term", "n", "all", "first")
    )
    kept = shared.table(kept, "divergence-kept")
    shared.drop(counts)
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("big_n"), F.count("*").alias("entries"))
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    groups = plain.groupBy("lang", "source").agg(F.lit(1).alias("_")).drop("_").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n")), ["lang", "source"], "left").join(langs, "lang", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("own_n", "v", "big_n", "entries")}
    groups = groups.withColumns(zero).withColumns({"total": F.greatest(F.col("own_n") + F.col("v"), F.lit(1)), "place": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1})
    groups = shared.table(groups.withColumns({"block": F.expr(f"cast(place div {SOURCES} as int)"), "blocks": F.expr(f"cast((max(place) over (partition by lang)) div {SOURCES} + 1 as int)"), "parts": F.expr(f"cast(entries div {BLOCK} + 1 as int)")}), "divergence-groups")
    return _pairs(kept, groups).unionByName(_terms(kept, groups, most))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    # every unordered pair of source blocks that a source takes part in, and its side there
    blocks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j"), F.when(b < F.col("block"), 1).otherwise(0).alias("side")))
    sides = groups.select("lang", "source", "total", "parts", F.explode(blocks).alias("b"))
    placed = sides.select("lang", "source", "total", "parts", "b.i", "b.j", "b.side")
    named = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("lang", "part", "i", "j", "source", "total", "side", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    held = kept.select("lang", "source", "term", "n").join(few(placed), ["lang", "source"])
    held = held.select("lang", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"), "i", "j", "source", "total", "side", "term", "n")
    shared.small_batches(kept.sparkSession)
    found = named.unionByName(held).groupBy("lang", "part", "i", "j").applyInPandas(_block, "lang string, source string, item string, value long, met long")
    summed = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    one = few(groups.select("lang", "source", "v", _share("0", "total").alias("p")))
    zero = F.expr("((p - q) * (p - q)) div q")
    values = (
        summed.join(one, ["lang", "source"])
        .join(one.select("lang", F.col("source").alias("item"), F.col("p").alias("q")), ["lang", "item"])
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("v") > 0, F.col("value") + (F.col("v") - F.col("met")) * zero).otherwise(F.lit(0)).cast("long").alias("value"))
    )
    return values.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _terms(kept: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    sized = few(groups.select("lang", "source", "total", (F.col("big_n") + F.col("v")).alias("lang_total")))
    both = kept.join(sized, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), _share("n", "total").alias("p"), _share("all", "lang_total").alias("q"))
    values = both.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.filter(F.col("rank") <= most)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(shared.read(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
  regexp_extract_all(translate(COALESCE(text, ''), '{shared.UPPER}', '{shared.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT row) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
g AS (SELECT lang, source, COALESCE(v, 0) AS v, COALESCE((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS own
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, kept.term, COALESCE(n, 0) AS n, 1 + ({PARTS} * (COALESCE(n, 0) + 1)) // (own + v) AS p
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
l AS (SELECT lang, term, 1 + ({PARTS} * (sum(n) + 1)::HUGEINT) // ((sum(sum(n)) OVER (PARTITION BY lang))::HUGEINT + any_value(v)) AS q FROM c JOIN v USING (lang) GROUP BY lang, term),
pairs AS (SELECT g.lang, g.source, h.source AS item FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pv AS (SELECT lang, source, 'pair' AS part, item, COALESCE(value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums USING (lang, source, item)),
tv AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pv UNION ALL SELECT * FROM tv))
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {MOST}"""
