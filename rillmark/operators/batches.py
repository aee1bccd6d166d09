"""Arrow batches of rows: how large they are, the words of their texts, the k best so far."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rillmark import packaging

#: Rows and bytes of a batch, as of the training-data operators; a longer row is a batch.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches.  The plan reads these settings when it runs, so
    they stay set."""
    spark = df.sparkSession
    packaging.send(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(f, schema)


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def schema_of(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {kind_of(df, c)}" for c in columns)


def elements(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each element, and the elements, of an array column."""
    offsets = lists.offsets.to_numpy()
    return np.repeat(np.arange(len(lists)), np.diff(offsets)), lists.values.slice(offsets[0], offsets[-1] - offsets[0])


def lists(row: np.ndarray, values: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    """An array column of values that are sorted by row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(values, kind))


def _counted(names: list[str], vocabulary: list[str]):
    known = pa.array(vocabulary, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = batch.column(batch.num_columns - 1)
            row, token = elements(toks)
            place = pc.index_in(token, value_set=known).fill_null(-1).to_numpy()
            held = place >= 0
            key, tf = np.unique(row[held].astype(np.int64) * max(len(known), 1) + place[held], return_counts=True)
            row, place = np.divmod(key, max(len(known), 1))
            length = pa.array(np.diff(toks.offsets.to_numpy()), pa.int32())
            yield pa.record_batch([*batch.columns[:-1], length, lists(row, place, batch.num_rows, pa.int32()), lists(row, tf, batch.num_rows, pa.int32())], names=[*names, "dl", "places", "tfs"])

    return run


def counted(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """The rows of ``docs`` with, instead of their last column, an array of tokens: its
    length dl, the places in ``vocabulary`` of those that stand there, and how often each
    occurs.  A row stays a row, so nothing is shuffled."""
    names = docs.columns[:-1]
    return map_arrow(docs, _counted(names, vocabulary), f"{schema_of(docs, *names)}, dl int, places array<int>, tfs array<int>")


def best_of(score: np.ndarray, chunk: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best of each row that are not -inf; ties at the cut
    are settled by the smaller id, as in the final order.  Only what reaches the k-th best
    of its row is sorted."""
    n = min(k, score.shape[1])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    cut = -np.partition(-score, n - 1, axis=1)[:, n - 1]
    row, column = np.nonzero((score >= cut[:, None]) & (score > -np.inf))
    best = score[row, column]
    order = np.lexsort((np.unique(chunk, return_inverse=True)[1][column], -best, row))
    row, column, best = row[order], column[order], best[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[keep], column[keep], best[keep]


class Best:
    """The k best rows of each query over the batches of one task: at most about MOST, or
    four times k for each query, are held."""

    MOST = 1 << 16

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.most = k, max(self.MOST, 4 * k * queries)
        self.floor = np.full(queries, -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, score: np.ndarray, chunk: np.ndarray) -> None:
        """Scores of all queries (rows) and chunks (columns); -inf is no hit."""
        score = np.where(score >= self.floor[:, None], score, -np.inf)
        some = np.flatnonzero((score > -np.inf).any(axis=1))
        if len(some):
            row, column, best = best_of(score[some], chunk, self.k)
            self.parts.append((some[row], chunk[column], best))
            self.held += len(best)
        if self.held > self.most:
            self.parts = [self.found()]
            self.held = len(self.parts[0][0])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, chunk and score of the best so far."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, chunk, best = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((np.unique(chunk, return_inverse=True)[1], -best, row))
        row, chunk, best = row[order], chunk[order], best[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        last = nth == self.k - 1
        self.floor[row[last]] = best[last]
        keep = nth < self.k
        return row[keep], chunk[keep], best[keep]

    def batch(self, ids: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
        """query_id, chunk_id, score."""
        row, chunk, best = self.found()
        return pa.record_batch([pa.array(ids[row], pa.int64()), pa.array(chunk, kind), pa.array(best, pa.float64())], names=["query_id", "chunk_id", "score"])
