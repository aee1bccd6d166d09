"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


#: The setting by which Spark removes the shuffle files of a query that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """Below ``spark.checkpoint.dir``; a local folder only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rillmark-"))
        at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/rillmark"


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go when it has been written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: the plan ends here, and lost executors cost no more than
    reading it anew."""
    spark = df.sparkSession
    path = fresh(spark, name)
    with cleaned(spark):
        df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    _made.remove((df.sparkSession, df.stored_at))
    delete(df.sparkSession, df.stored_at)


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that ``stored`` made in this session."""
    for session, path in list(_made):
        if session is spark:
            _made.remove((session, path))
            with contextlib.suppress(Exception):  # the session may be over
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for session in {s for s, _ in _made}:
        with contextlib.suppress(Exception):
            if session.sparkContext._jsc is not None:
                drop_tables(session)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, written through the file system that holds the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(content)
    finally:
        out.close()


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if it is not there."""
    p, fs = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def get(spark: SparkSession, path: str) -> bytes:
    """The content of a small file."""
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def put_once(spark: SparkSession, path: str, content: bytes) -> bool:
    """A small file that is there whole or not at all: written aside and renamed.  False, and
    no change, if the path is taken."""
    aside = f"{path}.{uuid.uuid4().hex}.new"
    put(spark, aside, content)
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(path).toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # do not overwrite
    try:
        files.rename(jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path), plain)
    except Py4JJavaError as e:
        delete(spark, aside)
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True
