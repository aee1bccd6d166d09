"""Document fingerprints by consistent weighted sampling.

A text is its words, weighed by how often they occur.  For each of SAMPLES samples every
word draws r and c from Gamma(2, 1) and b from U(0, 1), all derived from the word's hash;
with t = floor(ln w / r + b) its value is ln c - r (t - b) - r, and the sample is the word
and t of the least value.  Two texts agree in a sample with the probability of their
generalised Jaccard similarity, sum of min weights over sum of max weights.

A word's values depend on its count only, so texts are taken by the batch: each word and
count that occurs in it is worked out once, a part of them at a time, and a text is the
column-wise least of its words' rows.

Scale: fingerprints are one narrow pass.  The contract's pairing with the next document
needs neighbours in doc_id order: documents are dealt to blocks of the order, with bounds
from quantiles, and the first document of each block also goes to the block before it.
Texts move once; a block is read in order and only two texts are held.

Defined cases: null text is the empty text, whose fingerprint has no words and equals only
itself; documents come in descending doc_id, null last, equal ids by text, and rows that
are wholly equal follow each other; one document is its own next; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .rolling import U, mix

SAMPLES = 128
#: Word rows worked out at once, and held at once, SAMPLES longs each: about 8 MB.
AT_ONCE, PART = 128, 8_192
#: Characters of the texts taken together; a longer text is taken alone.
TOGETHER = 4 << 20
#: Documents in a block of the doc_id order, and blocks at most.
BLOCK_ROWS, MOST_BLOCKS = 4_000, 1 << 16

_SEEDS = (mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) >> U(32)).astype(np.uint32).reshape(2, 1, SAMPLES)
#: The fingerprint of a text without words.
EMPTY = "-"


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at the middles of 65,536 equal shares, by halving: its distribution
    function is 1 - (1 + x) exp(-x)."""
    p = (np.arange(65_536) + 0.5) / 65_536
    low, high = np.zeros(65_536), np.full(65_536, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


GAMMA = _gamma_quantiles().astype(np.float32)
LOG_GAMMA = np.log(GAMMA)


def _draws(seeds: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A random 32-bit number for every word and sample (words x SAMPLES)."""
    x = (seeds ^ low) * np.uint32(0xCC9E2D51)
    x ^= x >> np.uint32(15)
    x += high
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def _rows(hashes: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
    """For every word (rows) and sample one integer: above, the value in an order-keeping
    form; in the last 16 bits, the mark of the word and its t.  A word that occurs once has
    t = 0."""
    for at in range(0, len(hashes), AT_ONCE):
        h, n = hashes[at : at + AT_ONCE], counts[at : at + AT_ONCE]
        rows = out[at : at + len(h)]
        low, high = h.astype(np.uint32)[:, None], (h >> U(32)).astype(np.uint32)[:, None]
        x, y = _draws(_SEEDS[0], low, high), _draws(_SEEDS[1], low, high)
        r = GAMMA.take((x & np.uint32(0xFFFF)).astype(np.intp), mode="clip")
        value = LOG_GAMMA.take((x >> np.uint32(16)).astype(np.intp), mode="clip")
        b = (y & np.uint32(0xFFFF)).astype(np.float32)
        b *= np.float32(2.0**-16)
        if n.max() > 1:
            t = np.floor(np.log(n.astype(np.float32))[:, None] / r + b)
            y += t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1)
            value -= r * (t - b)
        else:
            b *= r
            value += b
        value -= r
        order = value.view(np.int32)
        order ^= (order >> np.int32(31)) & np.int32(0x7FFFFFFF)
        y *= np.uint32(0x85EBCA6B)
        y >>= np.uint32(16)
        rows[...] = order
        rows <<= 16
        rows |= y


class Sampler:
    """Fingerprints of texts."""

    def __init__(self) -> None:
        self.rows = np.empty((PART, SAMPLES), dtype=np.int64)

    def signature(self, text: bytes) -> np.ndarray | None:
        return self._together([text])[0]

    def signatures(self, texts: list[str]) -> list[np.ndarray | None]:
        """Those of a batch of texts, None for one without words."""
        out, group, held = [], [], 0
        for text in texts:
            if group and held + len(text) > TOGETHER:
                out += self._together(group)
                group, held = [], 0
            group.append(text)
            held += len(text)
        return out + (self._together(group) if group else [])

    def _together(self, texts: list) -> list[np.ndarray | None]:
        words = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        row = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
        coded = words.flatten().dictionary_encode()
        vocabulary, word = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if "" in vocabulary:  # white space at an end of a text
            some = word != vocabulary.index("")
            row, word = row[some], word[some]
        size = max(len(vocabulary), 1)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
        key, times = np.unique(row * size + word, return_counts=True)
        row, word = np.divmod(key, size)
        # words that occur once come first
        pair, of = np.unique(times * size + word, return_inverse=True)
        times, word = np.divmod(pair, size)
        order = np.argsort(of // PART, kind="stable")
        row, of = row[order], of[order]
        ends = np.searchsorted(of // PART, np.arange(len(pair) // PART + 2))
        least = np.full((len(texts), SAMPLES), np.iinfo(np.int64).max)
        for i, at in enumerate(range(0, len(pair), PART)):
            _rows(hashes[word[at : at + PART]], times[at : at + PART], self.rows)
            texts_of, places = row[ends[i] : ends[i + 1]], of[ends[i] : ends[i + 1]] - at
            starts = np.flatnonzero(np.diff(texts_of, prepend=-1))
            for text, start, end in zip(texts_of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(places)], strict=True):
                np.minimum(least[text], np.minimum.reduce(self.rows.take(places[start:end], 0, mode="clip"), axis=0), out=least[text])
        marks, found = (least & 0xFFFF).astype(np.uint16), np.bincount(row, minlength=len(texts)) > 0
        return [m if f else None for m, f in zip(marks, found, strict=True)]


_sampler: list[Sampler] = []


def sampler() -> Sampler:
    """One for each Python worker."""
    if not _sampler:
        _sampler.append(Sampler())
    return _sampler[0]


def as_text(signature: np.ndarray | None) -> str:
    return EMPTY if signature is None else signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The share of samples that agree."""
    return float(a is b) if a is None or b is None else float(np.mean(a == b))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint (four hex digits a sample)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [as_text(x) for x in sampler().signatures([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.record_batch([batch.column(0), pa.array(marks, pa.string())], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return shared.map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, fingerprint string")


def in_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text, block and guest: every document in its block of the descending
    doc_id order, and, as guests, the documents that a block's last one has as next.
    Sorted within each partition by block, and there in order."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    keys = docs.select(key.alias("key"))
    n = keys.count()
    blocks = max(1, min(MOST_BLOCKS, n // BLOCK_ROWS))
    bounds = sorted(set(keys.agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)], max(10_000, 10 * blocks))).first()[0] or [])) if blocks > 1 else []
    marks = F.lit(bounds).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    block = F.lit(len(bounds)) - shared.block_of(key, marks, len(bounds))
    # the largest id of each block is the next of the block before it; the largest of all, of the last block
    tops = {r.block: r.top for r in keys.groupBy((F.lit(len(bounds)) - shared.block_of(F.col("key"), marks, len(bounds))).alias("block")).agg(F.max("key").alias("top")).collect()}
    filled = sorted(tops)
    hosts: dict[int, list[int]] = {}
    for i, b in enumerate(filled):
        hosts.setdefault(tops[b], []).append(filled[i - 1])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    own = rows.withColumns({"block": block, "guest": F.lit(False)})
    tops_of = spark.createDataFrame([(k, b) for k, bs in hosts.items() for b in bs], "top long, host int") if hosts else None
    if tops_of is not None:
        guests = rows.join(F.broadcast(tops_of), F.col("key") == F.col("top")).select("doc_id", "text", "key", F.col("host").alias("block"), F.lit(True).alias("guest"))
        own = own.unionByName(guests)
    return own.repartition(max(1, len(filled)), "block").sortWithinPartitions("block", "guest", F.desc("key"), "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    cws = sampler()
    last: list[tuple] = []
    for batch in batches:
        # further guests of a block are equal in id with the first, which alone is next
        rows = last + list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True))
        nexts = [i for i in range(1, len(rows)) if rows[i - 1][2] == rows[i][2] and not rows[i - 1][3]]
        edits = []
        for i in nexts:
            before, cut = rows[i - 1][1], len(rows[i - 1][1]) // 3
            edits.append(before[: len(before) - cut] + rows[i][1][:cut])
        found = cws.signatures([r[1] for r in rows[len(last) :]] + edits)
        own, twins = [r[4] for r in last] + found[: len(found) - len(edits)], found[len(found) - len(edits) :]
        out = [
            (rows[i - 1][0], len(rows[i - 1][1]), hashlib.sha256(edited.encode()).hexdigest(), as_text(own[i - 1]), as_text(twin), likeness(own[i - 1], twin), likeness(own[i - 1], own[i]))
            for i, edited, twin in zip(nexts, edits, twins, strict=True)
        ]
        last = [(*rows[-1][:4], own[-1])] if rows else []
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=names)


def with_edits(docs: DataFrame) -> DataFrame:
    """The contract's row for every document; see the module."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return shared.map_arrow(in_blocks(docs), _edited, schema)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(shared.read(spark, sf_dir, "documents"))
