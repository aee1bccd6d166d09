"""What a search index keeps: points with payloads, saved statistics, filters, lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import hashing

from . import lexical
from .sides import few

#: Columns of a chunk that its point does not repeat in the payload.
NOT_PAYLOAD = ("chunk_id", "embedding", "vector", "sparse")


def points(chunks: DataFrame) -> DataFrame:
    """One row a chunk: id (the UUID of its chunk_id), payload (JSON of its other columns,
    nulls left out), and vector and sparse where there are any."""
    payload = F.to_json(F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), *[c for c in chunks.columns if c not in NOT_PAYLOAD]))
    kept = [F.col("embedding").alias("vector")] if "embedding" in chunks.columns else []
    kept += ["sparse"] if "sparse" in chunks.columns else []
    return chunks.select(hashing.uuid5(F.col("chunk_id").cast("string")).alias("id"), payload.alias("payload"), *kept)


def save_idf(corpus: DataFrame, folder: str, min_df: int = lexical.MIN_DF) -> None:
    """Write the corpus's IDF table, replacing the one that is there."""
    lexical.idf_table(corpus, min_df).write.mode("overwrite").parquet(folder)


def load_idf(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("token string, idx long, df long, idf double").parquet(folder)


def within(country: str | None = None, domain: str | None = None, document_ids: Iterable[str] = (), case_id: str | None = None) -> Column:
    """The condition of a request's filters: all that are given must hold."""
    out = F.lit(True)
    for name, value in (("country", country), ("domain", domain), ("case_id", case_id)):
        if value is not None:
            out &= F.col(name).eqNullSafe(F.lit(value))
    ids = list(document_ids)
    return out & F.col("document_id").isin(*ids) if ids else out


def chosen(registry: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The registered documents: those listed (document_id), or all without a list."""
    return registry if ids is None else registry.join(few(ids.select("document_id").distinct()), "document_id", "left_semi")


def page(rows: DataFrame, order: tuple[Column | str, ...], skip: int, limit: int) -> DataFrame:
    """``limit`` rows of the order after the first ``skip``."""
    return rows.orderBy(*order).offset(skip).limit(limit)
