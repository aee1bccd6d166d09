"""What the corpus operators share: word patterns, shared-folder tables and Arrow helpers.

Tables that cut lineage go below ``spark.checkpoint.dir``, which driver and executors
share on a cluster.  Only where that setting is missing and the master is local (tests, a
laptop) is a local folder chosen, once per session.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark import packaging

#: Word patterns of the contracts, for Java and for Python.
WORD = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)

#: Rows and bytes in one Arrow batch; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20

#: While a table is written: its shuffle files go as soon as it is there, and its files are
#: of the advisory size, so that a small table is one file instead of one for each core.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
#: In a shared folder that is a mounted file system, no checksum file beside each file: for
#: every file, executors start a process that sets its mode.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_made: list[tuple[SparkSession, str]] = []


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body and its lambdas
    name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rillmark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost
    executor costs no recomputation.  The files go when the session's Python ends, or
    with ``drop_tables``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillmark/{name}-{uuid.uuid4().hex}"
    packaging.send(spark)
    with _settings(spark, WRITING):
        df.write.options(**PLAIN_FILES).parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def drop(*tables: DataFrame) -> None:
    """Delete tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    if (spark, path) in _made:
        _made.remove((spark, path))
        with contextlib.suppress(Exception):  # the session may be over
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables of this session."""
    for session, path in list(_made):
        if session is spark:
            _delete(session, path)


@atexit.register
def _drop_all() -> None:
    for session in {s for s, _ in _made}:
        with contextlib.suppress(Exception):
            if session.sparkContext._jsc is not None:
                drop_tables(session)


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers: Arrow batches of at most BATCH_ROWS rows and
    about BATCH_BYTES.  The plan reads these settings when it runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: a worker lives on, idle, after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not a GNU system
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches, whose workers keep no memory after a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    small_batches(df.sparkSession)
    packaging.send(df.sparkSession)
    return df.mapInArrow(run, schema)


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of a stored table whose n is so large that at most ``most`` rows have it or
    more.  The cut comes from a histogram of n, so no task gathers candidates."""
    above, cut = 0, None
    for row in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        above += row["count"]
        if above > most:
            break
        cut = row.n
    return counts.filter(F.lit(False)) if cut is None else counts.filter(F.col("n") >= cut)


def aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns that clash with ``names`` (in any case) renamed, and the
    renaming that puts them back."""
    wanted = {n.lower() for n in names}
    moved = {c: f"_kept_{i}" for i, c in enumerate(df.columns) if c.lower() in wanted}
    return df.withColumnsRenamed(moved), {v: k for k, v in moved.items()}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    packaging.send(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def block_of(key: Column, bounds: Column, n: int) -> Column:
    """How many of the sorted ``bounds`` (an array column of n values) are at most ``key``:
    a binary search in n.bit_length() steps, inside the JVM."""
    steps = max(1, n.bit_length())
    return F.aggregate(
        F.array(*[F.lit(1 << i) for i in reversed(range(steps))]),
        F.lit(0),
        lambda lo, s: F.when((lo + s <= n) & (F.get(bounds, lo + s - 1) <= key), lo + s).otherwise(lo),
    )
