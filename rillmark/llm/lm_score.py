"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each is predicted in the context of the bytes before it,
0 to DEPTH of them.  A node (a context and the bits so far) counts the zeros and ones that
followed it in the training texts.  With the Krichevsky-Trofimov estimate P_e of a node,
its weighted probability is P_w = P_e at full depth and (P_e + product of the children's
P_w) / 2 above; the prediction of a bit mixes the nodes of all depths along its context by
the posterior these imply.  The tree is frozen after training, and a text's log10
probability is the sum over its bytes and an end mark (a zero byte), after zero bytes.

What is learned is the table of all byte strings of DEPTH + 1, gathered from the whole
corpus and summed in each task and then by string.  The tree over them is built where the
data is, in three tiers that each have a bounded size: subtrees below three context bytes
(at most 2**24 strings), below one (2**24), and the root on the driver (2**16).  Strings
that only held-out texts have are in the table with count 0, so every byte that is scored
finds its string.  Scoring broadcasts the table in blocks of at most BLOCK strings, one
pass over the texts for each block; every string is in one block, so the sums are whole.

The base score is the unigram formula of the contract.  Word counts are a table; the
TOP_WORDS most frequent go to all tasks, and the words beyond them are joined.

Defined cases: null text is the empty text: one end token, and an end mark to score; null
doc_id hashes as the empty string; without training texts every estimate is one half and
the base score is 0; repeated rows are each learned and scored; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .toxicity import fold

DEPTH = 5
#: Context bytes above the first tier of subtrees.
UPPER = 3
#: Words whose counts all tasks know, and strings in a block of the broadcast model.
TOP_WORDS, BLOCK = 1 << 17, 1 << 22
#: Strings and words that a task holds before it passes their counts on.
HELD_STRINGS, HELD_WORDS = 1_500_000, 200_000
#: Bytes whose strings are counted or looked up together, at some 100 bytes of working
#: memory each; a longer text goes in pieces.
CHUNK_BYTES = 1 << 19
#: Strings in a piece of a tier, at about a kilobyte each, but for a longer subtree.
PIECE = 100_000

_U = np.uint64
_HALF = float(np.log(0.5))


def pieces_of(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts in pieces, about ``most`` bytes at a time: the number of each piece's text,
    and the piece, after the DEPTH bytes before it.  A text's last byte is its end mark."""
    owners: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        whole = bytes(DEPTH) + t + b"\0"
        for start in range(0, len(t) + 1, most):
            owners.append(i)
            held.append(whole[start : start + DEPTH + most])
            size += len(held[-1])
            if size >= most:
                yield owners, held
                owners, held, size = [], [], 0
    if held:
        yield owners, held


def strings_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings of the pieces, one for each byte after the first DEPTH: the nearest
    context byte first, the byte itself last.  And where each piece begins."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.array([len(t) - DEPTH for t in pieces])
    starts = np.cumsum(np.append(0, sizes))
    wide = data.astype(np.uint64)
    keys = wide.copy()
    for j in range(1, DEPTH + 1):
        keys[j:] |= wide[:-j] << _U(8 * (DEPTH + 1 - j))
    own = np.ones(len(data), dtype=bool)
    begins = starts[:-1] + DEPTH * np.arange(len(pieces))
    for j in range(DEPTH):
        own[begins + j] = False
    return keys[own], starts


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 8."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3)) - np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1.0)


class Level:
    """The nodes of one context depth.  keys are sorted, distinct strings: the context and
    the byte in the last 8 bits."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys = keys
        self.node, self.first, self.log_pe, self.kt = [], [], [], []
        n = counts.astype(np.float64)
        for k in range(8):
            prefix = keys >> _U(8 - k)
            fresh = np.append(True, prefix[1:] != prefix[:-1])
            node = np.cumsum(fresh) - 1
            bit = (keys >> _U(7 - k)) & _U(1) == 1
            size = int(node[-1]) + 1
            both = np.bincount(node, n, size)
            ones = np.bincount(node, np.where(bit, n, 0), size)
            self.node.append(node)
            self.first.append(np.flatnonzero(fresh))
            self.log_pe.append(_log_kt(both - ones, ones))
            self.kt.append((np.where(bit, ones[node], (both - ones)[node]) + 0.5) / (both[node] + 1))
        self.log_pw = [x.copy() for x in self.log_pe]
        self.stop = [np.ones(len(keys)) for _ in range(8)]

    def weigh(self, k: int, below: np.ndarray) -> None:
        """P_w from the summed logarithms of the children's."""
        self.log_pw[k] = np.logaddexp(_HALF + self.log_pe[k], _HALF + below)
        self.stop[k] = np.exp(_HALF + self.log_pe[k] - self.log_pw[k])[self.node[k]]


def _shorter(keys: np.ndarray, counts: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings without their ``drop`` farthest context bytes, their counts, and the place
    of each given string among them."""
    cut = ((keys >> _U(8 * (drop + 1))) << _U(8)) | (keys & _U(255))
    short, place = np.unique(cut, return_inverse=True)
    return short, np.bincount(place, counts, len(short)), place


def lower_tree(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole subtrees below UPPER context bytes: each string's bit probabilities from
    there down (n x 8), and the strings, counts and log P_w (n x 8) at depth UPPER."""
    level = Level(keys, counts)
    p = np.stack(level.kt, axis=1)
    child_keys, child_counts, child = keys, counts, level
    whole = np.arange(len(keys))
    for _ in range(DEPTH - UPPER):
        short, n, place = _shorter(child_keys, child_counts, 1)
        level = Level(short, n)
        whole = place[whole]
        for k in range(8):
            parent = level.node[k][place[child.first[k]]]
            level.weigh(k, np.bincount(parent, child.log_pw[k], len(level.first[k])))
            p[:, k] = level.stop[k][whole] * level.kt[k][whole] + (1 - level.stop[k][whole]) * p[:, k]
        child_keys, child_counts, child = short, n, level
    return p, child_keys, child_counts, np.stack([child.log_pw[k][child.node[k]] for k in range(8)], axis=1)


def upper_tree(keys: np.ndarray, counts: np.ndarray, log_pw: np.ndarray, depths: int):
    """Of whole subtrees: with p the bit probability from the given depth down, it is
    a + b p from ``depths`` above it (a, b: n x 8); and strings, counts, log P_w there."""
    a, b = np.zeros((len(keys), 8)), np.ones((len(keys), 8))
    whole = np.arange(len(keys))
    at_keys, at_counts, at_pw = keys, counts, log_pw
    for _ in range(depths):
        short, n, place = _shorter(at_keys, at_counts, 1)
        level = Level(short, n)
        whole = place[whole]
        for k in range(8):
            prefix = at_keys >> _U(8 - k)
            first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            parent = level.node[k][place[first]]
            level.weigh(k, np.bincount(parent, at_pw[first, k], len(level.first[k])))
            stop, kt = level.stop[k][whole], level.kt[k][whole]
            a[:, k] = stop * kt + (1 - stop) * a[:, k]
            b[:, k] = (1 - stop) * b[:, k]
        at_keys, at_counts, at_pw = short, n, np.stack([level.log_pw[k][level.node[k]] for k in range(8)], axis=1)
    return a, b, at_keys, at_counts, at_pw


def _pieces(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.Table]:
    """The rows in pieces of about PIECE that end where a subtree ends; a partition's rows
    come sorted by their first column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PIECE:
            table = pa.Table.from_batches(held)
            top = table.column(0).to_numpy() >> shift
            cut = int(np.searchsorted(top, top[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
                size -= cut
    if size:
        yield pa.Table.from_batches(held)


def _eights(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 8, dtype=np.int32)), pa.array(x.ravel()))


def _from_eights(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, 8)


def _lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _pieces(batches, 8 * (DEPTH + 1 - UPPER)):
        keys, counts = t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()
        p, short, n, pw = lower_tree(keys, counts)
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64()), _eights(p)], names=["string", "top", "n", "x"])
        yield pa.record_batch([pa.nulls(len(short), pa.int64()), pa.array(short.view(np.int64)), pa.array(n.astype(np.int64)), _eights(pw)], names=["string", "top", "n", "x"])


def _upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["top", "a", "b", "one", "n", "pw"]
    kind = pa.list_(pa.float64())
    for t in _pieces(batches, 8 * UPPER):
        keys, counts = t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()
        a, b, short, n, pw = upper_tree(keys, counts, _from_eights(t.column(2)), UPPER - 1)
        k, s = len(keys), len(short)
        yield pa.record_batch([pa.array(keys.view(np.int64)), _eights(a), _eights(b), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, kind)], names=names)
        yield pa.record_batch([pa.nulls(s, pa.int64()), pa.nulls(s, kind), pa.nulls(s, kind), pa.array(short.view(np.int64)), pa.array(n.astype(np.int64)), _eights(pw)], names=names)


def _count_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        keys, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        held.clear()
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return pa.record_batch([pa.array(keys[first].view(np.int64)), pa.array(np.add.reduceat(n, first))], names=["string", "n"])

    for batch in batches:
        texts, learn = _texts(batch.column(0)), batch.column(1).to_pylist()
        for wanted in (True, False):
            for _, pieces in pieces_of([t for t, y in zip(texts, learn, strict=True) if y == wanted]):
                keys, n = np.unique(strings_of(pieces)[0], return_counts=True)
                held.append((keys, n if wanted else np.zeros(len(n), dtype=np.int64)))
                size += len(keys)
                if size >= HELD_STRINGS:
                    yield flush()
                    size = 0
    if size:
        yield flush()


def _texts(column: pa.Array) -> list[bytes]:
    """Lower-cased (A-Z), null as empty."""
    return [(t or b"").lower() for t in column.cast(pa.binary()).to_pylist()]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for t in _texts(batch.column(0)):
            held.update(t.split())
        if len(held) >= HELD_WORDS:
            yield flush()
    if held:
        yield flush()


def tree_table(docs: DataFrame) -> DataFrame:
    """string and log10 probability of its last byte after its context, for every string
    of ``docs`` (text, learn)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    strings = shared.map_arrow(docs.select("text", "learn"), _count_strings, "string long, n long").groupBy("string").agg(F.sum("n").alias("n"))
    lower = shared.table(
        shared.map_arrow(strings.repartition(parts, F.shiftright("string", 8 * (DEPTH + 1 - UPPER))).sortWithinPartitions("string"), _lower, "string long, top long, n long, x array<double>"),
        "lm-lower",
    )
    upper = shared.table(
        shared.map_arrow(lower.filter("top IS NOT NULL").select("top", "n", "x").repartition(parts, F.shiftright("top", 8 * UPPER)).sortWithinPartitions("top"), _upper, "top long, a array<double>, b array<double>, one long, n long, pw array<double>"),
        "lm-upper",
    )
    ones = upper.filter("one IS NOT NULL").select("one", "n", "pw").orderBy("one").toArrow()
    root = upper_tree(ones.column("one").to_numpy().view(np.uint64), ones.column("n").to_numpy(), _from_eights(ones.column("pw")), 1) if ones.num_rows else None
    if root is None:
        return lower.filter("string IS NOT NULL").select("string", F.lit(0.0).alias("log10_p"))
    rows = [(int(k), root[0][i].tolist(), root[1][i].tolist()) for i, k in enumerate(ones.column("one").to_numpy())]
    roots = F.broadcast(spark.createDataFrame(rows, "one long, ra array<double>, rb array<double>"))
    coefficients = (
        upper.filter("top IS NOT NULL")
        .select("top", "a", "b", (F.shiftleft(F.shiftright("top", 8 * UPPER), 8) + F.col("top").bitwiseAND(255)).alias("one"))
        .join(roots, "one")
        .select("top", F.expr("transform(sequence(0, 7), i -> ra[i] + rb[i] * a[i])").alias("a"), F.expr("transform(sequence(0, 7), i -> rb[i] * b[i])").alias("b"))
    )
    return (
        lower.filter("string IS NOT NULL")
        .select("string", "x", (F.shiftleft(F.shiftright("string", 8 * (DEPTH + 1 - UPPER)), 8) + F.col("string").bitwiseAND(255)).alias("top"))
        .join(coefficients, "top")
        .select("string", F.expr("aggregate(sequence(0, 7), 0D, (s, i) -> s + log10(a[i] + b[i] * x[i]))").alias("log10_p"))
    )


class Lookup:
    """The strings of a block with their logarithms, found by hashing: an odd multiple of
    the string is its hash, sorted, and the hash's first bits tell where to begin."""

    ODD = _U(0x9E3779B97F4A7C15)

    def __init__(self, strings: np.ndarray, logs: np.ndarray) -> None:
        hashes = strings.view(np.uint64) * self.ODD
        order = np.argsort(hashes)
        self.hashes, self.logs = np.append(hashes[order], _U(2**64 - 1)), np.append(logs[order], 0).astype(np.float32)
        bits = max(1, len(strings).bit_length() - 1)
        self.shift = _U(64 - bits)
        top = self.hashes[:-1] >> self.shift
        self.begin = np.searchsorted(top, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.bincount(top.astype(np.int64)).max()) if len(strings) else 0

    def find(self, strings: np.ndarray) -> np.ndarray:
        """The logarithm of each string, 0 where it is not in the block."""
        wanted = strings * self.ODD
        at = self.begin[(wanted >> self.shift).astype(np.int64)]
        out = np.zeros(len(strings), dtype=np.float64)
        rest = None
        for _ in range(self.steps):
            got = self.hashes[at]
            hit = got == wanted
            if rest is None:
                out[hit] = self.logs[at[hit]]
                rest = np.flatnonzero(got < wanted)
                at, wanted = at[rest], wanted[rest]
            else:
                out[rest[hit]] = self.logs[at[hit]]
                more = got < wanted
                rest, at, wanted = rest[more], at[more], wanted[more]
            if not len(rest):
                break
            at = np.minimum(at + 1, len(self.hashes) - 1)
        return out


def _likelihood(texts: list[bytes], known: Lookup) -> np.ndarray:
    score = np.zeros(len(texts))
    for owners, pieces in pieces_of(texts):
        strings, starts = strings_of(pieces)
        np.add.at(score, owners, np.add.reduceat(known.find(strings), starts[:-1]))
    return score


def _score(model):
    """One more block added to the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch.column(3).to_numpy() + _likelihood(_texts(batch.column(0)), model.value)
            yield pa.record_batch([*[batch.column(i) for i in range(3)], pa.array(score)], names=["text", "doc_id", "held_out", "score"])

    return run


def _score_and_base(model, top):
    """The last block added, and the base score, but for the words beyond the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = top.value
        for batch in batches:
            texts = _texts(batch.column(0))
            score = batch.column(3).to_numpy() + _likelihood(texts, model.value)
            n_tokens, known, total, rare = [], [], [], []
            for t in texts:
                counts = Counter(t.split())
                n_tokens.append(sum(counts.values()) + 1)
                s, k, r = 0.0, 0, []
                for w, n in counts.items():
                    x = logs.get(w)
                    if x is None:
                        r.append({"word": w.decode(), "tf": n})
                    else:
                        s += n * x
                        k += n
                total.append(s)
                known.append(k)
                rare.append(r)
            yield pa.record_batch(
                [batch.column(1), batch.column(2), pa.array(score), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(total, pa.float64()), pa.array(rare, pa.list_(pa.struct([("word", pa.string()), ("tf", pa.int64())])))],
                names=["doc_id", "held_out", "score", "n_tokens", "known", "total", "rare"],
            )

    return run


def score_texts(docs: DataFrame, top_words: int = TOP_WORDS, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.  Rows that are not held out are learned from."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("text", "doc_id", "held_out")
    training = rows.filter("NOT held_out")
    words = shared.table(shared.map_arrow(training.select("text"), _count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    ends = training.count()
    stats = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_tokens, distinct = stats.n + ends, stats.v + (ends > 0)
    frequent = shared.most_frequent(words, top_words).toArrow()
    logs = dict(zip(frequent.column("word").cast(pa.binary()).to_pylist(), np.log10(frequent.column("n").to_numpy() + 1.0).tolist(), strict=True))
    model = shared.table(tree_table(rows.select("text", (~F.col("held_out")).alias("learn"))), "lm-model")
    blocks = max(1, -(-model.count() // block))
    scored = rows.withColumn("score", F.lit(0.0))
    frequent_logs = spark.sparkContext.broadcast(logs)
    for i in range(blocks):
        part = model.filter(F.pmod(F.xxhash64("string"), F.lit(blocks)) == i).toArrow()
        known = spark.sparkContext.broadcast(Lookup(part.column("string").to_numpy(), part.column("log10_p").to_numpy()))
        del part
        if i < blocks - 1:
            scored = shared.table(shared.map_arrow(scored, _score(known), f"text string, doc_id {kind}, held_out boolean, score double"), "lm-scored")
            known.destroy()
    last = shared.map_arrow(scored, _score_and_base(known, frequent_logs), f"doc_id {kind}, held_out boolean, score double, n_tokens long, known long, total double, rare array<struct<word:string,tf:bigint>>")
    numbered = shared.table(last.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    known.destroy()
    frequent_logs.destroy()
    rare = (
        numbered.select("row", F.explode("rare").alias("r"))
        .select("row", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
        .join(words, "word")
        .groupBy("row")
        .agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("rest"))
    )
    end = float(np.log10(ends + 1))
    scale = float(np.log10(train_tokens + distinct + 1))
    return numbered.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("total") + F.coalesce("rest", F.lit(0.0)) + end - F.col("n_tokens") * scale).alias("base_score"),
        "score",
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    return score_texts(docs.select("doc_id", "text", (fold(F.col("doc_id"), 7) == 2).alias("held_out")))
