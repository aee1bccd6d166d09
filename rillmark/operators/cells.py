"""An inverted-file vector index: coarse cells that cover every row, searched by cell.

Cell centres are fitted by spherical k-means on about SAMPLE rows; every row goes to the
cell of its nearest centre and is stored there, normalised, in a folder of its own.  A
search probes the nearest cells of each query, reads only their files and multiplies blocks
of queries with blocks of rows, cell by cell (``dense.within_groups``).

``search`` is approximate by its number of probes.  Building the index measures how many
give a share of WANTED of the true neighbours: some CHECKED rows are searched exactly, and
the places of their neighbours' cells among the nearest cells are counted.  With ``exact``, the k-th score that the
probes found bounds the search: a cell whose centre is further from the query than its
radius and that score allow cannot hold one of the k best, all others are read as well, and
the result is that of ``dense.nearest``.

Bounds: MOST_CELLS centres, and the sample, are all that reaches the driver.  Rows are
written by range of (cell, chunk_id), so a large cell is written by many tasks; while it is
searched, it is cut into blocks.  Rows without a vector, or with a zero vector, have cosine
0 to everything: they are a cell of their own, which every query probes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark import packaging
from rillmark.sources.work import stored

from . import dense
from .lexical import top

#: Rows of the fit, about; centres at most; passes of the fit.
SAMPLE, MOST_CELLS, PASSES = 10_000, 4_096, 8
#: Recall that the probes are chosen for; rows that measure it, about, with so many neighbours.
WANTED, CHECKED, NEIGHBOURS = 0.95, 100, 10
#: The cell of rows without a direction.
NOWHERE = -1


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    at: str

    @property
    def rows(self) -> DataFrame:
        """chunk_id, embedding (normalised), cell."""
        kind = self.spark.read.parquet(f"{self.at}/probes").schema["chunk_id"].dataType.simpleString()
        return self.spark.read.schema(f"chunk_id {kind}, embedding array<double>, cosine double, cell int").parquet(f"{self.at}/rows")

    @property
    def cells(self) -> DataFrame:
        """cell, centre, n, radius: the least cosine of its rows to its centre."""
        return self.spark.read.schema("cell int, centre array<double>, n long, radius double").parquet(f"{self.at}/cells")

    @property
    def probes(self) -> int:
        """Cells that a query probes for the recall WANTED."""
        return self.spark.read.schema("probes int").parquet(f"{self.at}/probes").first().probes


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def centres(sample: np.ndarray, n: int) -> np.ndarray:
    """Centres of at most n cells, from rows in an order that does not matter for them: the
    first ones are spread over the sorted rows."""
    rows = np.unique(_unit(sample[np.linalg.norm(sample, axis=1) > 0]), axis=0)
    if not len(rows):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    out = rows[np.random.default_rng(7).permutation(len(rows))[:n]]
    for _ in range(PASSES):
        of = np.argmax(rows @ out.T, axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, of, rows)
        there = np.bincount(of, minlength=len(out)) > 0
        out = _unit(np.where(there[:, None], sums, out))
    return out


def _nearest_cells(sent, most: int):
    """Each row's nearest cells and the cosines to their centres.  A row without a direction
    has its own cell if one is wanted, else every cell is as near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = sent.value
        for batch in (b.slice(at, dense.ROWS) for b in batches for at in range(0, b.num_rows, dense.ROWS)):
            rows = dense._matrix(batch.column(1))
            wide = max(rows.shape[1] if rows.size else 0, middle.shape[1])
            rows = _unit(dense._widened(rows.reshape(batch.num_rows, rows.size // batch.num_rows), wide))
            near = rows @ dense._widened(middle, wide).T
            n = min(most, near.shape[1])
            order = np.argsort(-near, axis=1, kind="stable")[:, :n]
            cells = [[NOWHERE] if most == 1 and not r.any() else o.tolist() for r, o in zip(rows, order, strict=True)]
            cosines = [[0.0] if c == [NOWHERE] else near[i, c].tolist() for i, c in enumerate(cells)]
            yield pa.record_batch([batch.column(0), pa.array(list(rows), pa.list_(pa.float64())), pa.array(cells, pa.list_(pa.int32())), pa.array(cosines, pa.list_(pa.float64()))], names=["id", "embedding", "cells", "cosines"])

    return run


def _placed(rows: DataFrame, middle: np.ndarray, most: int) -> DataFrame:
    packaging.send(rows.sparkSession)
    kind = rows.schema[rows.columns[0]].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(middle)
    plain = rows.select(F.col(rows.columns[0]).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(_nearest_cells(sent, most), f"id {kind}, embedding array<double>, cells array<int>, cosines array<double>")


def build(vectors: DataFrame, at: str, cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Index ``vectors`` (chunk_id, embedding) into the folder ``at``, in place of what is
    there.  Without a number, there are about as many cells as the root of the rows."""
    spark = vectors.sparkSession
    n = vectors.count()
    cut = int(min(1.0, sample / max(n, 1)) * (1 << 40))
    seen = vectors.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 40)) < cut).select(F.col("embedding").cast("array<double>")).limit(2 * sample).collect()
    rows = dense._matrix(pa.array([r[0] for r in seen], pa.list_(pa.float64()))) if seen else np.zeros((0, 1))
    middle = centres(rows.reshape(len(rows), rows.size // max(len(rows), 1)), min(cells or max(1, round(n**0.5)), MOST_CELLS))
    placed = _placed(vectors.select("chunk_id", "embedding"), middle, 1).select(F.col("id").alias("chunk_id"), "embedding", F.get("cells", F.lit(0)).alias("cell"), F.get("cosines", F.lit(0)).alias("cosine"))
    placed = placed.withColumn("cell", F.coalesce("cell", F.lit(NOWHERE)))
    placed.repartitionByRange("cell", "chunk_id").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{at}/rows")
    index = Index(spark, at)
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(middle)] + [(NOWHERE, [])], "cell int, centre array<double>")

    def noted(probes: int) -> None:
        name = F.lit(None).cast(vectors.schema["chunk_id"].dataType).alias("chunk_id")  # its type
        spark.range(1).select(F.lit(probes).cast("int").alias("probes"), name).coalesce(1).write.mode("overwrite").parquet(f"{at}/probes")

    noted(1)
    met = index.rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("radius"))
    known.join(met, "cell").coalesce(1).write.mode("overwrite").parquet(f"{at}/cells")
    noted(_measured(index, n))
    return index


def _measured(index: Index, n: int) -> int:
    """How many nearest cells hold a share of WANTED of the true neighbours."""
    cut = int(min(1.0, CHECKED / max(n, 1)) * (1 << 40))
    some = index.rows.filter((F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.lit(1 << 40)) < cut) & (F.col("cell") != NOWHERE)).limit(2 * CHECKED)
    asked = stored(some.select(F.monotonically_increasing_id().alias("query_id"), F.col("chunk_id").alias("own"), "embedding"), "cells-checked")
    found = dense.nearest(index.rows.filter(F.col("cell") != NOWHERE), asked, NEIGHBOURS, but="own").join(index.rows.select("chunk_id", "cell"), "chunk_id")
    places = sorted(r.nth for r in found.join(_probes(index, asked, 1), ["query_id", "cell"]).select("nth").collect())
    return places[max(0, int(np.ceil(WANTED * len(places))) - 1)] + 1 if places else 1


def _probes(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, embedding, cell, cosine, step, nth: every cell of every query, nearest first,
    the first ``probes`` of them with step 1."""
    held = {r.cell: r.centre for r in index.cells.select("cell", "centre").collect() if r.cell != NOWHERE}
    names = sorted(held)
    middle = np.array([held[c] for c in names]) if names else np.zeros((0, 0))
    rows = _placed(queries.select("query_id", "embedding"), middle, max(len(names), 2)).select("id", "embedding", F.posexplode(F.arrays_zip("cells", "cosines")))
    real = F.get(F.lit(names).cast("array<int>"), F.col("col.cells"))
    near = rows.select(F.col("id").alias("query_id"), "embedding", F.coalesce(real, F.lit(NOWHERE)).alias("cell"), F.col("col.cosines").alias("cosine"), F.when(F.col("pos") < probes, 1).otherwise(2).alias("step"), F.col("pos").alias("nth"))
    near = near.filter(F.col("cell") != NOWHERE)
    every = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(NOWHERE).alias("cell"), F.lit(0.0).alias("cosine"), F.lit(1).alias("step"), F.lit(-1).alias("nth"))
    return near.unionByName(every)


def _searched(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query in each cell it asks; other cells' files stay closed."""
    cells = [r.cell for r in asked.select("cell").distinct().collect()]  # MOST_CELLS at most
    rows = index.rows.filter(F.col("cell").isin(cells)) if cells else index.rows.filter("false")
    return dense.within_groups(rows.select("chunk_id", "embedding", "cell"), asked.select("query_id", "embedding", "cell"), k, "cell")


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best rows of the probed cells for ``queries``
    (query_id, embedding), or of all cells.  Without a number, as many cells are probed as
    were measured to be needed."""
    near = stored(_probes(index, queries, probes or index.probes), "cells-asked")
    first = stored(_searched(index, near.filter("step = 1"), k), "cells-first")
    if not exact:
        return top(first, k)
    return top(first.unionByName(_searched(index, needed(index, near, first, k), k)), k)


def needed(index: Index, near: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Of the cells not yet searched, those that may hold one of the k best: at the angle a
    from its centre, rows up to the angle r from it score at most cos(a - r)."""
    reached = top(first, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    rows = near.filter("step = 2").join(F.broadcast(index.cells.select("cell", "radius")), "cell").join(reached, "query_id", "left")
    angle = lambda c: F.acos(F.least(F.greatest(F.col(c), F.lit(-1.0)), F.lit(1.0)))
    best = F.cos(F.greatest(angle("cosine") - angle("radius"), F.lit(0.0)))
    # scores are rounded to six places
    return rows.filter(best + 2e-6 >= F.coalesce("reached", F.lit(float("-inf")))).drop("radius", "reached")
