"""Toxicity: a counterfactual-regularised classifier.

Features are the words of a text and the beginnings of its words, lower-cased, as present
or absent.  Those that mark toxic texts are chosen by their likelihood ratio; a logistic
regression over them is fitted on labelled texts.  For every labelled text that names a
group of people, the identity term is swapped for each other of its kind, and left out, and
the loss adds the squared change of the score between the text and these twins.  The words
around a neutral mention then carry the score, not the mention.

Bounds: the fit uses at most SAMPLE labelled texts of either class, those whose hashed ids
come first, and MOST_FEATURES features.  Only their ids and feature numbers reach the
driver.  Scoring reads every whole text in one narrow pass; the model is a small broadcast.

Defined cases: null text scores as the empty text; null labels and documents without a
label are not learned from; several labels of one document count as toxic if one is; with
labels of one class the score is the smoothed share of toxic labels, at most 0.01 where
none is toxic or there are none; of several texts with one labelled id the least is learned
from; the same where labels of both classes are there but not their texts; repeated rows
score alike; a column named score is replaced; an empty table gives an empty result; extra
columns are ignored or passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Labelled texts of either class in the fit, at most.
SAMPLE = 6_000
#: Features of the model, at most, and the texts a feature must be in.
MOST_FEATURES, LEAST_TEXTS = 4_096, 5
#: Lengths in bytes of the word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6)
THRESHOLD = 0.3
#: Weights of the squared weights and of the squared changes under swapped terms.
RIDGE, FAIRNESS = 1e-6, 1.0
STEPS = 800

#: Fixed word lists: terms for groups of people, by kind; a term is swapped within its kind.
IDENTITY = (
    ("women", "men", "woman", "man", "female", "male", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("gay", "straight", "lesbian", "heterosexual", "homosexual", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "african", "american", "european", "mexican", "arab", "chinese", "indian"),
    ("blind", "deaf", "disabled", "old", "young", "elderly"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "deutsche"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "français"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "españoles"),
)
_KIND = {t.encode(): [x.encode() for x in kind if x != t] for kind in IDENTITY for t in kind}

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(_WORDS).split())


def features_of(word: bytes) -> list[bytes]:
    """The word itself, marked by a space, and its beginnings."""
    return [word + b" ", *[word[:n] for n in BEGINNINGS if len(word) >= n]]


def fold(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


@dataclass
class Model:
    """weights by feature; prior is the score without any."""

    prior: float
    weights: dict[bytes, float] = field(default_factory=dict)

    def scores(self, texts: list[bytes | None]) -> list[float]:
        known: dict[bytes, tuple[bytes, ...]] = {}
        get = self.weights.get
        bias = float(np.log(self.prior / (1 - self.prior)))
        out = []
        for t in texts:
            if len(known) > 500_000:
                known.clear()
            found: set[bytes] = set()
            for w in words_of(t):
                hits = known.get(w)
                if hits is None:
                    hits = known[w] = tuple(f for f in features_of(w) if f in self.weights)
                if hits:
                    found.update(hits)
            z = bias + sum(sorted(map(get, found)))
            out.append(float(1 / (1 + np.exp(-min(max(z, -500), 500)))))
        return out


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of texts by feature and class, summed over what a task has read."""
    held: dict[bytes, list[int]] = {}

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(held, pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["feature", "clean", "toxic"])
        held.clear()
        return out

    for batch in batches:
        for t, y in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for f in {f for w in words_of(t) for f in features_of(w)}:
                held.setdefault(f, [0, 0])[y] += 1
            if len(held) > 1_000_000:
                yield flush()
    if held:
        yield flush()


def _designed(features: dict[bytes, int]):
    """Numbers of the features that a text has, and that its twins have."""

    def numbers(words: set[bytes]) -> list[int]:
        return sorted({features[f] for w in words for f in features_of(w) if f in features})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, twins = [], []
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                words = words_of(t)
                own.append(numbers(words))
                named = sorted(w for w in words if w in _KIND)
                mine = [numbers(words - set(named))] if named else []
                for k in range(max((len(_KIND[w]) for w in named), default=0)):
                    swap = {w: _KIND[w][k % len(_KIND[w])] for w in named}
                    mine.append(numbers({swap.get(w, w) for w in words}))
                twins.append(mine)
            yield pa.record_batch([batch.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(twins, pa.list_(pa.list_(pa.int32())))], names=["toxic", "own", "twins"])

    return run


def _csr(rows: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    return np.repeat(np.arange(len(rows)), sizes), np.array([i for r in rows for i in r], dtype=np.int64)


def fit(own: list, toxic: np.ndarray, twins: list, n: int, share: float, fairness: float = FAIRNESS) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over the whole sample.  Classes are weighed to ``share``."""
    rows, cols = _csr(own)
    pairs = [(r, t) for r, ts in enumerate(twins) for t in ts]
    of = np.array([r for r, _ in pairs], dtype=np.int64)
    trow, tcol = _csr([t for _, t in pairs])
    positive = max(1, int(toxic.sum()))
    weight = np.where(toxic == 1, share / positive, (1 - share) / max(1, len(toxic) - positive))
    w, b = np.zeros(n), float(np.log(share / (1 - share)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(rows, w[cols], len(own))
        error = weight * (1 / (1 + np.exp(-z)) - toxic)
        grad = np.bincount(cols, error[rows], n) + 2 * RIDGE * w
        if pairs:
            p = 1 / (1 + np.exp(-z[of]))
            q = 1 / (1 + np.exp(-(b + np.bincount(trow, w[tcol], len(pairs)))))
            # twice the change of the logit, the slope of its square
            change = fairness * 2 * (np.log(p + 1e-9) - np.log(1 - p + 1e-9) - np.log(q + 1e-9) + np.log(1 - q + 1e-9)) / len(pairs)
            mine = np.bincount(of, change, len(own))
            grad += np.bincount(cols, mine[rows], n) - np.bincount(tcol, change[trow], n)
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fairness: float = FAIRNESS) -> Model:
    """A model from the labelled rows that are given; see the module for the bounds."""
    marked = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    marked = marked.withColumn("order", F.md5(F.col("doc_id").cast("string").cast("binary")))
    counts = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    share = (toxic + 0.5) / (toxic + clean + 1) if toxic + clean else 0.01
    if not toxic or not clean:
        return Model(min(share, 0.01) if not toxic else share)
    chosen = marked.filter("toxic = 1").orderBy("order").limit(sample).unionByName(marked.filter("toxic = 0").orderBy("order").limit(sample)).select("doc_id", "toxic")
    # at most 2 * sample ids: a broadcast of bounded size, so only the chosen texts move
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    texts = shared.table(texts.select("text", "toxic"), "toxicity-sample")
    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    t_all, c_all = sizes.get(1, 0), sizes.get(0, 0)
    if not t_all or not c_all:  # labels, but not the texts, of both classes
        return Model(min(share, 0.01) if not t_all else share)
    found = shared.map_arrow(texts, _present, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    named = [f for w in _KIND for f in features_of(w)]

    def part(x: Column, rate_of: Column, rate: Column) -> Column:
        return F.when(x > 0, x * F.log(rate_of / rate)).otherwise(0.0)

    both = (F.col("toxic") + F.col("clean")) / F.lit(t_all + c_all)
    kept = (
        found.filter(F.col("toxic") + F.col("clean") >= LEAST_TEXTS)
        .withColumn("ratio", part(F.col("toxic"), F.col("toxic") / t_all, both) + part(F.col("clean"), F.col("clean") / c_all, both) + part(t_all - F.col("toxic"), 1 - F.col("toxic") / t_all, 1 - both) + part(c_all - F.col("clean"), 1 - F.col("clean") / c_all, 1 - both))
        .filter((F.col("toxic") / t_all > F.col("clean") / c_all) & (F.col("ratio") > 12))
        .orderBy(F.desc("ratio"), "feature")
        .limit(MOST_FEATURES)
    )
    features = {f: i for i, f in enumerate(dict.fromkeys([*[bytes(r.feature) for r in kept.select("feature").collect()], *named]))}
    design = shared.map_arrow(texts, _designed(features), "toxic int, own array<int>, twins array<array<int>>").toArrow()
    # at most 2 * sample rows, in one order whatever the tasks were
    toxic, own, twins = zip(*sorted(zip(*(design.column(c).to_pylist() for c in ("toxic", "own", "twins")), strict=True)), strict=True)
    w, b = fit(list(own), np.array(toxic), list(twins), len(features), share, fairness)
    prior = float(1 / (1 + np.exp(-b)))
    return Model(min(max(prior, 1e-6), 1 - 1e-6), {f: round(float(w[i]), 9) for f, i in features.items() if abs(w[i]) > 1e-9})


def _score(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.scores(batch.column(names.index("text")).cast(pa.binary()).to_pylist())
            yield pa.record_batch([*[batch.column(i) for i in range(len(names))], pa.array(scores, pa.float64())], names=[*names, "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with their score."""
    docs = docs.drop("score")
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return shared.map_arrow(docs, _score(known, docs.columns), f"{schema}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns."""
    renamed, back = shared.aside(docs, ("score",))
    return score(renamed, model).filter(F.col("score") < threshold).select(*renamed.columns).withColumnsRenamed(back)


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the contract: labels of the fold 2 of 4 are held out."""
    return train(docs, shared.read(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 4) != 2))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, trained(spark, docs, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
