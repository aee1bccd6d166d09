"""Caches and catalogue as tables: exact and semantic lookups, expiry, versions, upserts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions import hashing

from . import dense, lexical

#: Lifetimes in seconds, least similarity, matches looked at.
EXACT_TTL, SEMANTIC_TTL, SIMILAR, MATCHES = 3600, 7200, 0.93, 3
#: Columns that an entry and a request must share.
TAGS = ("jurisdiction", "domain", "query_type", "active_collection", "corpus_fingerprint", "embedding_fingerprint", "response_schema_version", "prompt_version")


def key_of(rows: DataFrame, fields: tuple[str, ...]) -> Column:
    """The exact cache's key: all of what the answer depends on, as canonical JSON."""
    return hashing.canonical_key(**{f: F.col(f) for f in fields if f in rows.columns})


def expires_at(created: Column, seconds: int) -> Column:
    return created + F.make_interval(secs=F.lit(seconds))


def live(entries: DataFrame, now: Column) -> DataFrame:
    return entries.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def exact_lookup(requests: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Requests (query_id, cache_key) that have a live entry, with its payload; of several
    the latest counts."""
    latest = live(entries, now).groupBy("cache_key").agg(F.max_by("response_payload", "created_at").alias("response_payload"))
    return requests.join(latest, "cache_key").select("query_id", "cache_key", "response_payload")


def semantic_lookup(requests: DataFrame, entries: DataFrame, threshold: float = SIMILAR, tags: tuple[str, ...] = TAGS, now: Column | None = None, but: str | None = None) -> DataFrame:
    """The most similar live entry that shares all tags with the request (null-safe), if
    similar enough; of equals the least key.  Blocks of requests are compared with blocks of
    entries of the same tags, and pass on one row a request.
    ``but`` is a request column that names an entry not to be found.  Entries without a key
    and those whose vectors have another length than the request's are not found."""
    entries = entries if now is None else live(entries, now)
    shared = [t for t in tags if t in requests.columns and t in entries.columns]
    kinds = {t: "string" if dict(requests.dtypes)[t] != dict(entries.dtypes)[t] else dict(entries.dtypes)[t] for t in shared}
    tagged = F.to_json(F.struct(F.coalesce(F.size("embedding"), F.lit(-1)).alias("_size"), *[F.col(t).cast(kinds[t]).alias(t) for t in shared])).alias("tagged")
    e = entries.filter("cache_key IS NOT NULL").select(F.col("cache_key").alias("chunk_id"), "embedding", tagged)
    q = requests.select(F.col("query_id").cast("long").alias("query_id"), "embedding", tagged, *([F.col(but).alias("but")] if but else []))
    best = lexical.top(dense.within_groups(e, q, 1, "tagged", but="but" if but else None, least=0.0), 1)
    return best.filter(F.col("score") >= threshold).select("query_id", F.col("chunk_id").alias("entry_key"), F.col("score").alias("similarity"))


def put(entries: DataFrame, new: DataFrame, now: Column, seconds: int) -> DataFrame:
    """The table after ``new`` (cache_key, response_payload, and what else ``entries`` has)
    is set: its entries take the place of those with their keys, and live for ``seconds``."""
    return upserted(entries, new.withColumns({"created_at": now, "expires_at": expires_at(now, seconds)}), "cache_key")


def without(entries: DataFrame, pattern: str) -> DataFrame:
    """The table without the entries whose key fits a pattern of ``*`` and ``?``."""
    fits = "(?s)^" + "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern) + "$"
    return entries.filter(~F.coalesce(F.col("cache_key").rlike(fits), F.lit(False)))


def may_store() -> Column:
    """What the semantic cache keeps: answers without a model, not strategies, with domain."""
    return ~F.col("use_llm") & (F.col("query_type") != "strategy") & (F.col("response_type") != "strategy_answer") & F.col("request_domain").isNotNull()


# Versioned collections -----------------------------------------------------


def version_of(name: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, "__v([0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))


def latest_versions(names: DataFrame) -> DataFrame:
    """For each base name of ``names`` (collection): its latest collection and the next."""
    base = F.regexp_replace("collection", "__v[0-9]+$", "")
    rows = names.select("collection", base.alias("base"), version_of(F.col("collection")).alias("version"))
    per = rows.groupBy("base").agg(F.max(F.struct("version", "collection")).alias("m"))
    return per.select("base", F.col("m.collection").alias("latest"), F.col("m.version").alias("version"), F.concat("base", F.lit("__v"), (F.col("m.version") + 1).cast("string")).alias("next"))


def usable(profile: DataFrame) -> Column:
    """A collection may be searched with embeddings of the same fingerprint, or if both are
    hash embeddings of equal dimension and revision."""
    hashed = (F.col("provider") == "hash") & (F.col("wanted_provider") == "hash") & (F.col("dimension") == F.col("wanted_dimension")) & (F.col("revision") == F.col("wanted_revision"))
    return (F.col("fingerprint") == F.col("wanted_fingerprint")) | hashed


def upserted(existing: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The table after an idempotent upsert: rows of ``new``, one for each key, and those
    of ``existing`` whose keys it does not have."""
    new = new.dropDuplicates([key])
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def write_version(spark: SparkSession, rows: DataFrame, folder: str, base: str, key: str = "chunk_id") -> str:
    """Write the next version of a collection and return its name.  Readers keep the old
    one until ``switch``."""
    names = [r.collection for r in collections(spark, folder).filter(F.col("collection").startswith(f"{base}__v")).collect()]
    name = f"{base}__v{max([int(n.rpartition('__v')[2]) for n in names], default=0) + 1}"
    rows.dropDuplicates([key]).write.parquet(f"{folder}/{name}")
    return name


def ensure(spark: SparkSession, folder: str, base: str, schema: T.StructType) -> str:
    """The latest version of a collection; the first one, empty, is made where there is none.
    A version with other columns is an error."""
    held = latest_versions(collections(spark, folder)).filter(F.col("base") == base).first()
    if held is None:
        return write_version(spark, spark.createDataFrame([], schema), folder, base, schema.names[0])
    have = {(f.name, f.dataType) for f in spark.read.parquet(f"{folder}/{held.latest}").schema}
    if have != {(f.name, f.dataType) for f in schema}:
        raise ValueError(f"{held.latest} has other columns than those asked for")
    return held.latest


def collections(spark: SparkSession, folder: str) -> DataFrame:
    """The collections in a folder, listed by the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return spark.createDataFrame([(n,) for n in names if "__v" in n], "collection string")


def switch(spark: SparkSession, folder: str, alias: str, name: str) -> None:
    """Point the alias, a view of this session, at a version: one replacement."""
    spark.read.parquet(f"{folder}/{name}").createOrReplaceTempView(alias)


def reindex(spark: SparkSession, rows: DataFrame, folder: str, base: str, keep: bool = True) -> str:
    """Write all rows as the next version, then switch the alias to it.  Without ``keep`` the
    version before goes, once nothing points at it."""
    before = latest_versions(collections(spark, folder)).filter(F.col("base") == base).first()
    name = write_version(spark, rows, folder, base)
    switch(spark, folder, base, name)
    if before is not None and not keep:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before.latest}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return name


# Metrics and status --------------------------------------------------------


def counters(events: DataFrame, bucket: str, event: str) -> DataFrame:
    return events.groupBy(F.col(bucket).alias("bucket"), F.col(event).alias("event")).agg(F.count("*").alias("n"))


def status(catalogue: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: the active collection, its fingerprint, and the cache's size."""
    active = catalogue.filter("alias IS NOT NULL").agg(F.max("collection").alias("active_collection"), F.max("embedding_fingerprint").alias("embedding_fingerprint"))
    return active.join(entries.agg(F.count("*").alias("cached")))
