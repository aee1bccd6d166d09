"""Quality: a classifier learned from trusted positives and unlabelled web text.

A text becomes some thirty shares of its bytes, words and lines (capitals, symbols, words
that repeat, ...), read off its UTF-8 bytes with numpy, whatever its length.  Each share is
cut at quantiles of the sample, and a weight for each bin is fitted: a linear score over
bins.

Only label 1 is learned from.  With the class prior p, the loss is the non-negative
unbiased risk: p times the loss of positives as positives, plus what unlabelled texts lose
as negatives less p times what positives lose as negatives, where the difference is kept
from going below zero.  The prior is estimated first: a classifier of positives against
unlabelled texts is fitted on one half of the sample, and on the other half the least ratio
of the two shares above a threshold is taken, with a bound on its error.

Bounds: about SAMPLE positives and SAMPLE unlabelled texts, those whose hashes lie below a
cut; equal ones are one row with a weight.  Only their shares reach the driver.  Scoring
reads every whole text in one narrow pass; the model is some kilobytes.

Defined cases: null text scores as the empty text, an empty text has a score like any
other; several labels of one document count as good if one is; labels that are null, have
no document or stand at a null id are not learned from; without any positive that has a
text, or without an unlabelled text, every score is 0.5; repeated rows score alike; a
column named score is replaced; an empty table gives an empty result; extra columns are
passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.operators.sides import few

from . import shared
from .toxicity import fold

#: Positives and unlabelled texts in the fit, about as many of each.
SAMPLE = 6_000
#: Quantiles at which a share is cut, closer at both ends, where what is bad stands.
AT = np.sort(np.concatenate([np.linspace(0, 1, 22)[1:-1], [0.01, 0.02, 0.03, 0.97, 0.98, 0.99, 0.995]]))
#: Steps and weights of the squared weights, of the fit and of the fits for the prior.
STEPS, PRIOR_STEPS, RIDGE, PRIOR_RIDGE = 1_000, 300, 1e-5, 3e-2
THRESHOLD = 0.3
#: Bytes of a text that are looked at together; more are further pieces.
PIECE = 1 << 20

_SPACE, _UPPER, _LOWER, _HIGH, _DIGIT, _STOP, _PAUSE, _PIPE, _BANG, _QUOTE, _OTHER = range(11)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
for _bytes, _of in (
    (b" \t\n\x0b\x0c\r", _SPACE),
    (bytes(range(65, 91)), _UPPER),
    (bytes(range(97, 123)), _LOWER),
    (bytes(range(128, 256)), _HIGH),
    (b"0123456789", _DIGIT),
    (b".?", _STOP),
    (b",;:-", _PAUSE),
    (b"|", _PIPE),
    (b"!", _BANG),
    (b"'\"()", _QUOTE),
):
    _CLASS[list(_bytes)] = _of
#: Bytes of a long line.
LONG_LINE = 200
#: How far back a word is compared with words before it.
LAGS = 4
#: What is counted, one place each: bytes by class, runs of a mark, words, their bytes, kinds
#: of words, repeats at each distance, lines and their kinds.
COUNTS = 11 + 1 + 2 + 5 + LAGS + 3
_WORDS, _LINES = 12, 19 + LAGS
#: An odd number and its inverse modulo 2^64, for hashes of words.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _counted(data: np.ndarray) -> np.ndarray:
    """The counts of one piece, which begins and ends at a word's edge."""
    kind = _CLASS[data]
    out = np.zeros(COUNTS)
    out[:11] = np.bincount(kind, minlength=11)
    mark = kind >= _STOP
    out[11] = np.count_nonzero(mark[1:] & (data[1:] == data[:-1]))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], kind == _SPACE, [True]])))
    start, end = edge[::2], edge[1::2]
    if len(start):
        size = end - start
        last, first = kind[end - 1], kind[start]
        upper = np.add.reduceat((kind == _UPPER).astype(np.int64), start)
        letters = np.add.reduceat(((kind == _UPPER) | (kind == _LOWER) | (kind == _HIGH)).astype(np.int64), start)
        out[_WORDS : _WORDS + 7] = (
            len(start),
            size.sum(),
            np.count_nonzero((upper > 1) & (upper == letters)),
            np.count_nonzero(last >= _PIPE),
            np.count_nonzero(letters == 0),
            np.count_nonzero(first == _UPPER),
            np.count_nonzero(last == _STOP),
        )
        power = np.cumprod(np.full(len(data), _BASE, np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
        back = np.cumprod(np.full(len(data), _BACK, np.uint64))
        word = (sums[end] - sums[start]) * back[start]
        for lag in range(1, LAGS + 1):
            out[_WORDS + 6 + lag] = np.count_nonzero(word[lag:] == word[:-lag])
    lines = np.flatnonzero(data == 10)
    length = np.diff(np.concatenate([[-1], lines, [len(data)]])) - 1
    out[_LINES :] = len(lines), np.count_nonzero(length[1:-1] == 0), np.count_nonzero(length > LONG_LINE)
    return out


def shares(text: bytes | None) -> np.ndarray:
    """The shares of one text: what is counted, by bytes, words or lines."""
    data = np.frombuffer(text or b"", dtype=np.uint8)
    total, at = np.zeros(COUNTS), 0
    while at < len(data):
        to = at + PIECE
        if to < len(data):
            space = np.flatnonzero(_CLASS[data[to : to + PIECE]] == _SPACE)
            to = to + int(space[0]) if len(space) else to + PIECE
        total += _counted(data[at:to])
        at = to
    seen = max(total[:11].sum() - total[0], 1.0)
    words, lines = max(total[_WORDS], 1.0), total[_LINES] + 1.0
    return np.concatenate([total[1:12] / seen, [total[0] / max(len(data), 1)], total[_WORDS + 1 : _LINES] / words, np.minimum(total[_LINES + 1 :] / lines, 1.0), [words / lines if len(data) else 0.0]])


@dataclass
class Model:
    """weights[i][j] of share i in the bin before cuts[i][j]; without weights, 0.5."""

    cuts: list[np.ndarray]
    weights: list[np.ndarray]
    bias: float = 0.0
    prior: float = 0.5

    def logits(self, rows: np.ndarray) -> np.ndarray:
        z = np.full(len(rows), self.bias)
        for i, (cuts, weights) in enumerate(zip(self.cuts, self.weights, strict=True)):
            z += weights[np.searchsorted(cuts, rows[:, i], side="right")]
        return z

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not self.cuts:
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(np.array([shares(t) for t in texts])), -500, 500)))


def _bins(cuts: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Numbers of the bins of each row, counted through all shares."""
    first = np.cumsum([0, *[len(c) + 1 for c in cuts[:-1]]])
    return np.stack([np.searchsorted(c, rows[:, i], side="right") + first[i] for i, c in enumerate(cuts)], axis=1)


def _descend(slope, n: int, bias: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Adam over weights and bias; ``slope`` gives the gradient of both."""
    w = np.append(np.zeros(n), bias)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        g = slope(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    return w[:-1], float(w[-1])


def _pull(bins: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
    """The gradient of a sum of row losses whose slopes are ``by``."""
    return np.append(np.bincount(bins.ravel(), np.repeat(by, bins.shape[1]), n), by.sum())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def nonnegative_fit(good: np.ndarray, any_: np.ndarray, w_good: np.ndarray, w_any: np.ndarray, n: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; bins of rows, row weights that
    sum to 1."""

    def slope(w: np.ndarray) -> np.ndarray:
        z, u = w[:-1][good].sum(1) + w[-1], w[:-1][any_].sum(1) + w[-1]
        as_negative = w_any @ np.logaddexp(0, u) - prior * (w_good @ np.logaddexp(0, z))
        negative = _pull(any_, w_any * _sigmoid(u), n) - prior * _pull(good, w_good * _sigmoid(z), n)
        ridge = np.append(2 * RIDGE * w[:-1], 0.0)
        if as_negative < 0:  # overfitted: only step back
            return ridge - negative
        return ridge + negative - prior * _pull(good, w_good * _sigmoid(-z), n)

    return _descend(slope, n, float(np.log(prior / (1 - prior))))


def class_prior(good: np.ndarray, any_: np.ndarray, w_good: np.ndarray, w_any: np.ndarray, n: int) -> float:
    """The share of positives among the unlabelled rows, from above: on rows that were not
    fitted, the ratio of unlabelled to positive shares above a threshold, at the threshold
    where the ratio and two standard errors are least.  Either half is held back once."""
    found = []
    for half in (0, 1):
        fg, fa = np.arange(len(good)) % 2 == half, np.arange(len(any_)) % 2 == half
        if not fg.any() or not fa.any() or fg.all() or fa.all():
            return 0.5
        a, b = w_good[fg] / w_good[fg].sum(), w_any[fa] / w_any[fa].sum()

        def slope(w: np.ndarray, fg=fg, fa=fa, a=a, b=b) -> np.ndarray:
            z, u = w[:-1][good[fg]].sum(1) + w[-1], w[:-1][any_[fa]].sum(1) + w[-1]
            return np.append(2 * PRIOR_RIDGE * w[:-1], 0.0) + _pull(any_[fa], b * _sigmoid(u), n) - _pull(good[fg], a * _sigmoid(-z), n)

        w, bias = _descend(slope, n, 0.0, PRIOR_STEPS)
        found.append(_least_ratio(w[good[~fg]].sum(1) + bias, w_good[~fg], w[any_[~fa]].sum(1) + bias, w_any[~fa]))
    return float(np.clip(np.mean(found), 0.01, 0.99))


def _least_ratio(z: np.ndarray, a: np.ndarray, u: np.ndarray, b: np.ndarray) -> float:
    at = np.unique(z)

    def above(scores: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(scores, kind="stable")
        below = np.concatenate([[0], np.cumsum(weights[order])])[np.searchsorted(scores[order], at)]
        share = 1 - below / weights.sum()
        return share, np.sqrt(np.maximum(share * (1 - share), 0) / len(scores))

    (in_good, error_good), (in_any, error_any) = above(z, a), above(u, b)
    bound = (in_any + 2 * error_any) / np.maximum(in_good - 2 * error_good, 1e-9)
    best = int(np.argmin(bound))
    return float(in_any[best] / max(in_good[best], 1e-9))


def fit(good: np.ndarray, any_: np.ndarray, w_good: np.ndarray, w_any: np.ndarray) -> Model:
    """A model of shares of positive and of unlabelled texts, with how often each is there."""
    if not len(good) or not len(any_):
        return Model([], [])
    both = np.concatenate([good, any_])
    cuts = [np.unique(np.quantile(both[:, i], AT, method="lower")) for i in range(both.shape[1])]
    n = sum(len(c) + 1 for c in cuts)
    bg, ba, wg, wa = _bins(cuts, good), _bins(cuts, any_), w_good / w_good.sum(), w_any / w_any.sum()
    prior = class_prior(bg, ba, wg, wa, n)
    w, bias = nonnegative_fit(bg, ba, wg, wa, n, prior)
    return Model(cuts, [np.round(p, 9) for p in np.split(w, np.cumsum([len(c) + 1 for c in cuts])[:-1])], round(bias, 9), prior)


def _shared_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [shares(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
        yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["shares", "good", "any"])


def train(docs: DataFrame, labels: DataFrame, unlabelled: DataFrame | None = None, sample: int = SAMPLE) -> Model:
    """A model from the labels that are given and from ``unlabelled`` texts (all of ``docs``
    where there are none of their own); see the module for the bounds."""
    marked = labels.filter("doc_id IS NOT NULL AND quality = 1").select("doc_id").distinct()

    def below(wanted: int, *of: str):
        """Rows whose hash lies in the share that ``wanted`` rows are expected to have."""
        return lambda n: F.pmod(F.xxhash64(*of, F.lit(11)), F.lit(1 << 40)) < int(min(1.0, wanted / max(n, 1)) * (1 << 40))

    docs = docs.select("doc_id", "text")
    with_text = marked.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = with_text.filter(below(sample, "doc_id")(with_text.count())).withColumn("good", F.lit(True))
    web = docs if unlabelled is None else unlabelled.select("doc_id", "text")
    wanted = below(sample, "doc_id", "text")(web.count())
    if unlabelled is None:
        # one pass for both: the ids are about ``sample`` in number, and counted
        read = docs.join(few(chosen), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"), wanted.alias("any"))
    else:
        read = docs.join(few(chosen), "doc_id").select("text", "good", F.lit(False).alias("any")).unionByName(web.select("text", F.lit(False).alias("good"), wanted.alias("any")))
    found = shared.map_arrow(read.filter("good OR any"), _shared_out, "shares array<double>, good boolean, any boolean")
    rows = sorted((r.shares, r.good, r.any, r.n) for r in found.groupBy("shares", "good", "any").agg(F.count("*").alias("n")).collect())

    def side(at: int) -> tuple[np.ndarray, np.ndarray]:
        mine = [r for r in rows if r[at]]
        return np.array([r[0] for r in mine]), np.array([float(r[3]) for r in mine])

    (good, w_good), (any_, w_any) = side(1), side(2)
    mix = np.random.default_rng(11)  # halves of the sample must not follow the order of shares
    if len(good) and len(any_):
        og, oa = mix.permutation(len(good)), mix.permutation(len(any_))
        good, w_good, any_, w_any = good[og], w_good[og], any_[oa], w_any[oa]
    return fit(good, any_, w_good, w_any)


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


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the contract: labels of the fold 0 of 5 are held out, and so are their
    documents."""
    labels = shared.read(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    return train(docs.filter(fold(F.col("doc_id"), 5) != 0), labels)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, trained(spark, docs, sf_dir))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
