"""Registered queries over the relational tables: joins, windows, caches, catalogue,
streams, and the composite searches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmark.functions import hashing
from rillmark.functions import vectors as V
from rillmark.operators import aliases, answers, cache, counts, ingest, merging, ranking
from rillmark.sources import work
from rillmark.streaming import ingestion, keyed

from . import search
from .tables import DIM, bm25, corpus, hits, queries, read, tok

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Joins and windows ---------------------------------------------------------


@query("""
WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS fragment_id, l_linenumber AS i, l_suppkey AS query_id FROM lineitem),
p AS (SELECT a.query_id, a.chunk_id AS anchor_id, a.fragment_id AS ordinal, n.chunk_id, n.i AS near_i, abs(n.i - a.i) AS gap FROM c a JOIN c n ON a.fragment_id = n.fragment_id AND abs(n.i - a.i) <= 1 AND a.chunk_id <> n.chunk_id WHERE a.i = 3),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY ordinal, anchor_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ordinal, near_i, chunk_id) AS place FROM f)
SELECT query_id, chunk_id, anchor_id, gap::INT AS gap, place::INT AS rank FROM r WHERE place <= 30""")
def neighbor_band_join(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("fragment_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_suppkey").alias("query_id"))
    anchored = li.filter("chunk_index = 3").withColumn("ordinal", F.col("fragment_id"))
    return ranking.neighbors(anchored, li)


@query(r"""
WITH w AS (SELECT i AS query_id, CASE WHEN i % 4 = 0 THEN NULL ELSE 'src' || i END AS law_iri, (i % 20)::VARCHAR AS paragraph FROM range(0, 20) t(i)),
c AS (SELECT doc_id AS chunk_id, 'local:' || source || '/' || doc_id AS fragment_id, doc_id, source AS law_iri, (doc_id % 20)::VARCHAR AS paragraph,
             CASE WHEN doc_id % 3 = 0 THEN '§ ' || (doc_id % 20) WHEN doc_id % 7 = 0 THEN 'podle § ' || (doc_id % 20) || ' platí ' || text ELSE text END AS text, (doc_id % 5)::INT AS chunk_index FROM documents),
m AS (SELECT w.query_id, c.*, trim(c.text) AS t, '§ ' || w.paragraph AS ref FROM w JOIN c ON c.paragraph = w.paragraph AND (w.law_iri IS NULL OR c.law_iri = w.law_iri)),
h AS (SELECT *, t = ref OR starts_with(t, ref || ' ') AS is_heading FROM m),
k AS (SELECT *, min(doc_id) FILTER (is_heading) OVER (PARTITION BY query_id) AS heading_no FROM h),
s AS (SELECT *, CASE WHEN is_heading THEN 0 WHEN t = '' THEN 1 WHEN regexp_matches(t, '§ ' || (doc_id % 20) || '([^0-9a-zA-Z]|$)') THEN 2
        WHEN regexp_matches(t, '(?i)^(?:část|hlava|díl|oddíl|pododdíl|kapitola)([^\p{L}\p{N}_]|$)') OR (length(t) < 60 AND len(regexp_extract_all(t, '[\p{L}\p{M}\p{N}_]+')) <= 7 AND NOT regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '[.;]')) THEN 1
        WHEN doc_id < heading_no THEN 1 ELSE 0 END AS kind FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_heading DESC, kind, chunk_index, fragment_id, chunk_id) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM s)
SELECT query_id, chunk_id, kind::INT AS kind, place::INT AS rank, round(2.0::DOUBLE - (place - 1) / (n + 1)::DOUBLE + CASE WHEN is_heading THEN 1 ELSE 0 END, 6) AS score FROM r""")
def exact_lookup_rank(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.when(n % 3 == 0, F.concat(F.lit("§ "), n % 20)).when(n % 7 == 0, F.concat(F.lit("podle § "), n % 20, F.lit(" platí "), "text")).otherwise(F.col("text"))
    chunks = read(spark, d, "documents").select(n.alias("chunk_id"), F.concat(F.lit("local:"), "source", F.lit("/"), n).alias("fragment_id"), F.col("source").alias("law_iri"), (n % 20).cast("string").alias("paragraph"), text.alias("text"), (n % 5).cast("int").alias("chunk_index"))
    i = F.col("id")
    wanted = spark.range(20).select(i.alias("query_id"), F.when(i % 4 != 0, F.concat(F.lit("src"), i)).alias("law_iri"), (i % 20).cast("string").alias("paragraph"))
    return ranking.exact_lookup(wanted, chunks).select("query_id", "chunk_id", "kind", "rank", "score")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN '§ ' || (event_id % 50) || 'a' ELSE 'x' END AS text FROM events),
v AS (SELECT *, nullif(regexp_extract(text, '(?i)§\\s*([0-9]+[a-z]?)', 1), '') AS named, sum((event_type = 'purchase' OR regexp_matches(text, '§'))::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e)
SELECT event_id, CASE WHEN g = 0 THEN NULL ELSE first_value(named) OVER (PARTITION BY user_id, g ORDER BY event_id) END AS paragraph FROM v""".replace("\\\\", "\\"))
def last_value_paragraph(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    rows = read(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("typ"), F.when(e % 5 == 0, F.concat(F.lit("§ "), e % 50, F.lit("a"))).otherwise("x").alias("text"))
    return ingest.paragraph_context(rows, "user_id", "event_id", "purchase").select("event_id", "paragraph")


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey)")
def antijoin_skip_existing(spark: SparkSession, d: str) -> DataFrame:
    new = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return ingest.not_ingested(new, read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semijoin_law_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(read(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


DEFINITIONS = "SELECT o_orderkey AS id, o_orderkey AS seq, list(l_partkey ORDER BY l_linenumber) AS links FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"


def _definitions(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("law_links"))
    return read(spark, d, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").alias("seq"), "law_links")


@query(f"WITH d AS ({DEFINITIONS}), u AS (SELECT id, seq, unnest(links) AS f, unnest(range(len(links))) AS pos FROM d) SELECT f::VARCHAR AS fragment_id, string_agg(id::VARCHAR, ',' ORDER BY seq, pos) AS refs FROM u GROUP BY f")
def definition_reverse_index(spark: SparkSession, d: str) -> DataFrame:
    return ingest.reverse_index(_definitions(spark, d)).select("fragment_id", F.array_join("definition_refs", ",").alias("refs"))


@query(f"WITH d AS ({DEFINITIONS}), u AS (SELECT unnest(links) AS f FROM d), c AS (SELECT f, count(*) AS n FROM u GROUP BY f) SELECT p_partkey::VARCHAR AS fragment_id, COALESCE(n, 0)::INT AS n_refs FROM part LEFT JOIN c ON f = p_partkey")
def left_lookup(spark: SparkSession, d: str) -> DataFrame:
    parts = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("fragment_id"))
    return ingest.with_definitions(parts, ingest.reverse_index(_definitions(spark, d))).select("fragment_id", F.size("definition_refs").alias("n_refs"))


@query("SELECT event_type AS bucket, (value > 50)::VARCHAR AS event, count(*) AS n FROM events GROUP BY 1, 2")
def metrics_counters(spark: SparkSession, d: str) -> DataFrame:
    return cache.counters(read(spark, d, "events").withColumn("high", (F.col("value") > 50).cast("string")), "event_type", "high")


@query("SELECT source AS law_iri, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY ROLLUP (source)")
def ingest_stats_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ingest.counts_rollup(corpus(spark, d))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id".replace("max(event_id)", "arg_max(event_id, (ts, event_id))"))
def registry_latest(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", at).alias("event_id"), F.max_by("event_type", at).alias("status"))


# Caches and catalogue ------------------------------------------------------


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","prompt_version":null,"user_id":' || user_id || '}') AS cache_key FROM events""")
def exact_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", hashing.canonical_key(user_id=F.col("user_id"), event_type=F.col("event_type"), prompt_version=F.lit(None).cast("string")).alias("cache_key"))


@query("""
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS entry_key, round(greatest(0, list_cosine_similarity(q.e, c.e)), 6) AS similarity FROM v q JOIN v c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, entry_key, similarity FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, entry_key) = 1""")
def semantic_cache_knn(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").withColumnRenamed("label", "domain")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "domain")
    return cache.semantic_lookup(asked, v.select(F.col("vec_id").alias("cache_key"), "embedding", "domain"), 0.3, but="query_id")


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6) AS similarity FROM embeddings")
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.round(V.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("similarity"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 3600 SECOND > (SELECT max(ts) - INTERVAL 1 DAY FROM events)")
def cache_ttl_filter(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").withColumn("expires_at", cache.expires_at(F.col("ts"), cache.EXACT_TTL))
    now = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("now"))
    return cache.live(e.join(F.broadcast(now)), F.col("now")).select("event_id")


ENTRIES = "SELECT 'user:' || user_id || ':' || event_type AS cache_key, arg_max(event_id, (ts, event_id))::VARCHAR AS response_payload, max(ts) AS created_at, max(ts) + INTERVAL 7200 SECOND AS expires_at FROM events GROUP BY 1"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user and type as cache entries."""
    key = F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("cache_key")
    rows = read(spark, d, "events").groupBy(key).agg(F.max_by("event_id", F.struct("ts", "event_id")).cast("string").alias("response_payload"), F.max("ts").alias("created_at"))
    return rows.withColumn("expires_at", cache.expires_at(F.col("created_at"), cache.SEMANTIC_TTL))


@query(f"""WITH e AS (SELECT *, response_payload::BIGINT % 3 = 0 AS again FROM ({ENTRIES}))
SELECT cache_key, CASE WHEN again THEN 'new' ELSE response_payload END AS response_payload, CASE WHEN again THEN 3600 ELSE 7200 END::BIGINT AS seconds FROM e UNION ALL SELECT 'user:none', 'new', 3600""")
def cache_set(spark: SparkSession, d: str) -> DataFrame:
    held = _entries(spark, d)
    now = F.lit("2030-01-01 00:00:00").cast(dict(held.dtypes)["created_at"])
    keys = held.filter(F.col("response_payload").cast("long") % 3 == 0).select("cache_key").unionAll(spark.sql("SELECT 'user:none'"))
    entries = cache.put(held, keys.withColumn("response_payload", F.lit("new")), now, cache.EXACT_TTL)
    return entries.select("cache_key", "response_payload", F.timestamp_diff("SECOND", "created_at", "expires_at").alias("seconds"))


@query(f"WITH e AS ({ENTRIES}) SELECT cache_key, response_payload FROM e WHERE NOT regexp_matches(cache_key, '^user:1.*:c.ick$')")
def cache_pattern_delete(spark: SparkSession, d: str) -> DataFrame:
    return cache.without(_entries(spark, d), "user:1*:c?ick").select("cache_key", "response_payload")


#: A collection's name for each customer: of a nation, with and without a version.
NAMES = "'n' || c_nationkey || CASE WHEN c_custkey % 10 = 0 THEN '' ELSE '__v' || c_custkey END"


@query(f"""
WITH n AS (SELECT {NAMES} AS collection FROM customer), p AS (SELECT collection, regexp_replace(collection, '__v[0-9]+$', '') AS base, COALESCE(TRY_CAST(nullif(regexp_extract(collection, '__v([0-9]+)$', 1), '') AS INT), 0) AS version FROM n)
SELECT base, arg_max(collection, version) AS latest, max(version) AS version, base || '__v' || (max(version) + 1) AS next FROM p GROUP BY base""")
def alias_latest_version(spark: SparkSession, d: str) -> DataFrame:
    return cache.latest_versions(read(spark, d, "customer").select(F.expr(NAMES).alias("collection")))


@query("SELECT doc_id AS chunk_id, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS source FROM documents")
def idempotent_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    changed = rows.filter("chunk_id % 2 = 0").withColumn("source", F.upper("source"))
    return cache.upserted(cache.upserted(rows, changed), changed)


@query("""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN upper(source) || '2' ELSE source END AS source FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT -1 - doc_id, 'late' FROM documents WHERE doc_id % 11 = 0""")
def merged_table(spark: SparkSession, d: str) -> DataFrame:
    """Inserts, then updates that come twice, deletions, late rows and a replayed batch."""
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.lit(0).alias("at"))
    table = merging.create(spark, work.fresh(spark, "merged"), rows.drop("at").schema, "chunk_id")
    merging.merge(table, rows, source="batches", number=0)
    changed = rows.filter("chunk_id % 3 = 0").withColumn("at", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("source", F.concat(F.upper("source"), F.col("at").cast("string")))
    newest = changed.groupBy("chunk_id").agg(F.max_by("source", "at").alias("source"))
    merging.merge(table, newest, source="batches", number=1)
    gone = rows.filter("chunk_id % 7 = 0").withColumn("gone", F.lit(True))
    late = rows.filter("chunk_id % 11 = 0").select((-1 - F.col("chunk_id")).alias("chunk_id"), F.lit("late").alias("source"), F.lit(False).alias("gone"))
    merging.merge(table, gone.drop("at").unionByName(late), deleted=F.col("gone"), source="batches", number=2)
    merging.merge(table, rows.withColumn("source", F.lit("again")), source="batches", number=1)
    return table.read()


#: What the documents are after half of some texts, deletions and texts that come twice.
AFTER = """SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, length(text) // 2) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 11 = 0"""


@query(f"""WITH d AS (SELECT chunk_id, {tok("text")} AS toks FROM ({AFTER})), st AS (SELECT count(*) FILTER (len(toks) > 0) AS n_docs, sum(len(toks)) / (count(*) FILTER (len(toks) > 0))::DOUBLE AS avg_dl FROM d),
df AS (SELECT token, count(*) AS df FROM (SELECT chunk_id, unnest(list_distinct(toks)) AS token FROM d) GROUP BY token)
SELECT token, df, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf, n_docs, round(avg_dl, 6) AS avg_dl FROM df CROSS JOIN st WHERE df >= 2""")
def idf_followed(spark: SparkSession, d: str) -> DataFrame:
    """Statistics that followed a table through inserts, updates, deletions and a replay."""
    at = work.fresh(spark, "followed")
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    table = merging.create(spark, f"{at}/table", rows.schema, "chunk_id")
    held = counts.Counts(spark, f"{at}/counts")
    merging.merge(table, rows, source="batches", number=0)
    counts.advance(held, table)
    merging.merge(table, rows.filter("chunk_id % 3 = 0").withColumn("text", F.expr("substr(text, 1, length(text) div 2)")), source="batches", number=1)
    counts.advance(held, table)
    gone = rows.filter("chunk_id % 7 = 0").withColumn("gone", F.lit(True))
    late = rows.filter("chunk_id % 11 = 0").select((-1 - F.col("chunk_id")).alias("chunk_id"), "text", F.lit(False).alias("gone"))
    merging.merge(table, gone.unionByName(late), deleted=F.col("gone"), source="batches", number=2)
    merging.merge(table, rows, source="batches", number=1)
    counts.advance(held, table)
    return held.idf_table().join(F.broadcast(held.totals())).select("token", "df", F.round("idf", 6).alias("idf"), "n_docs", F.round("avg_dl", 6).alias("avg_dl"))


@query("SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def stream_merge(spark: SparkSession, d: str) -> DataFrame:
    """The last event of every user, kept by a stream that merges."""
    at = work.fresh(spark, "stream")
    rows = _events(spark, d).select("user_id", "event_id", "ts").filter("user_id IS NOT NULL")
    table = merging.create(spark, f"{at}/table", rows.schema, "user_id")
    ingestion.merge_into(rows, table, f"{at}/state", ("ts", "event_id")).awaitTermination()
    return table.read()


#: Seconds for which a registered stream remembers a text.
LIFETIME = 21_600


@query(f"""SELECT event_type, user_id, ts FROM events
QUALIFY COALESCE(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts)) >= {LIFETIME * 1_000_000}, true)""")
def stream_recent_texts(spark: SparkSession, d: str) -> DataFrame:
    """Events whose kind was not seen of their user in the hours before."""
    at = work.fresh(spark, "stream")
    rows = _events(spark, d).select("event_type", "user_id", F.col("user_id").cast("string").alias("who"), F.col("ts").cast("timestamp").alias("ts"))
    with keyed.kept_in_rocksdb(spark):
        found = keyed.recent_texts(rows, "event_type", "who", "ts", LIFETIME)
        done = ingestion.to_files(found, f"{at}/out", f"{at}/state")
    return done.select("event_type", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN '§ ' || (event_id % 50) || 'a' ELSE 'x' END AS text FROM events),
v AS (SELECT *, nullif(regexp_extract(text, '(?i)§\\s*([0-9]+[a-z]?)', 1), '') AS named, sum((event_type = 'purchase' OR regexp_matches(text, '§'))::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e)
SELECT event_id::VARCHAR AS fragment_id, user_id AS law_iri, CASE WHEN g = 0 THEN NULL ELSE first_value(named) OVER (PARTITION BY user_id, g ORDER BY event_id) END AS paragraph, false AS late FROM v""".replace("\\\\", "\\"))
def stream_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The events of each user as fragments in no order, put in turn by a stream."""
    at = work.fresh(spark, "stream")
    e = F.col("event_id")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    text = F.when(e % 5 == 0, F.concat(F.lit("§ "), e % 50, F.lit("a"))).otherwise("x")
    rows = read(spark, d, "events").select(e.cast("string").alias("fragment_id"), F.col("user_id").alias("law_iri"), place.alias("pos"), F.col("event_type").alias("typ"), text.alias("text"))
    rows.repartition(8, F.xxhash64("fragment_id")).write.parquet(f"{at}/in")
    with keyed.kept_in_rocksdb(spark):
        found = keyed.paragraphs_in_turn(ingestion.source(spark, at, "in", spark.read.parquet(f"{at}/in").schema, 3), marker="purchase")
        done = ingestion.to_files(found, f"{at}/out", f"{at}/state")
    return done.select("fragment_id", "law_iri", "paragraph", "late")


@query("SELECT doc_id AS chunk_id, source FROM documents")
def reindex_swap(spark: SparkSession, d: str) -> DataFrame:
    folder = work.fresh(spark, "reindex")
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    cache.reindex(spark, rows.withColumn("source", F.lit("old")), folder, "rillmark_docs")
    cache.reindex(spark, rows, folder, "rillmark_docs")
    return spark.table("rillmark_docs")


@query("SELECT doc_id AS chunk_id, 'old ' || COALESCE(source, '') AS bound, source AS active FROM documents")
def alias_shared(spark: SparkSession, d: str) -> DataFrame:
    """What a reader that was bound before a switch goes on to see, and what another session
    sees after it."""
    here = aliases.Catalogue(spark, work.fresh(spark, "catalogue"))
    there = aliases.Catalogue(spark.newSession(), here.at)
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    profile = aliases.Profile("f", dimension=DIM)
    here.reindex("docs", rows.withColumn("source", F.concat(F.lit("old "), F.coalesce("source", F.lit("")))), profile)
    with here.reading("docs") as bound:
        there.reindex("docs", there.spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "source"), profile, keep=False)
        seen = bound.withColumnRenamed("source", "bound")
        return work.stored(seen.join(here.rows(here.active("docs")).withColumnRenamed("source", "active"), "chunk_id"), "seen")


# Rows the system makes -----------------------------------------------------


#: A paragraph asked for by each customer, half of them with a hint of the law.
HINT = "CASE c_custkey % 4 WHEN 1 THEN 'local:sb/2012/89' WHEN 3 THEN 'local:sb/2009/40' END"


@query(f"""
WITH a AS (SELECT c_custkey AS query_id, c_nationkey AS paragraph, {HINT} AS hint FROM customer), l(i, iri, name) AS (VALUES (0, 'local:sb/2006/262', 'zákoník práce'), (1, 'local:sb/2012/89', 'občanský zákoník'), (2, 'local:sb/2009/40', 'trestní zákoník')),
s AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY (COALESCE(iri = hint, false))::INT DESC, i) AS pos, 'clarification:suggestion:' || iri || ':' || paragraph AS chunk_id, '§ ' || paragraph || ' ' || name AS text FROM a, l
      UNION ALL SELECT query_id, 0, 'clarification:message', CASE WHEN hint IS NULL THEN 'Dotaz je nejednoznačný. Uveď, o jaký zákon se jedná nebo popiš problém.' ELSE 'Upřesni zákon. Na základě kontextu nabízím relevantní možnosti:' END FROM a)
SELECT query_id, chunk_id, text, round(greatest(0, 1 - pos * 0.01), 4)::DOUBLE AS score FROM s WHERE pos < 3""")
def clarification_rows(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "customer").selectExpr("c_custkey AS query_id", "c_nationkey AS paragraph", f"{HINT} AS hint")
    return answers.clarification(asked, 3).select("query_id", "chunk_id", "text", "score")


@query("SELECT item_id AS query_id, 'no_result' AS chunk_id, 'Nepodařilo se najít relevantní výsledek.' AS text, 0.0::DOUBLE AS score FROM benchmark")
def system_rows(spark: SparkSession, d: str) -> DataFrame:
    return answers.system_row(queries(spark, d), "no_result").select("query_id", "chunk_id", "text", "score")


# Answers -------------------------------------------------------------------

FEATURES = """
SELECT doc_id AS query_id, ['exact_statute', 'case_lookup', 'semantic_law', 'strategy'][doc_id % 4 + 1] AS query_type,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id * 7 % 100) / 100.0::DOUBLE END AS top_fused_score, (doc_id * 3 % 10) / 100.0::DOUBLE AS score_gap,
  (doc_id * 13 % 100) / 100.0::DOUBLE AS keyword_coverage, doc_id % 5 = 0 AS phrase_match, doc_id % 3 = 0 AS citation_match, (doc_id % 3)::BIGINT AS supporting_chunks FROM documents"""


@query(f"""
WITH f AS ({FEATURES}), g AS (SELECT *, top_fused_score IS NOT NULL AS found,
  citation_match AND keyword_coverage >= 0.45 AND score_gap >= 0.02 AS statute, (phrase_match OR keyword_coverage >= 0.5) AND score_gap >= 0.02 AS cas, top_fused_score >= 0.7 AND keyword_coverage >= 0.65 AND supporting_chunks >= 1 AS sem FROM f),
l AS (SELECT *, CASE WHEN query_type = 'strategy' THEN 'medium' WHEN NOT found THEN 'low' WHEN query_type = 'exact_statute' THEN CASE WHEN statute THEN 'high' ELSE 'medium' END
  WHEN query_type = 'case_lookup' THEN CASE WHEN cas THEN 'high' ELSE 'medium' END WHEN sem THEN 'high' WHEN top_fused_score >= 0.55 THEN 'medium' ELSE 'low' END AS level,
  list_filter([CASE WHEN citation_match THEN 'citation_match' END, CASE WHEN phrase_match THEN 'phrase_match' END, CASE WHEN keyword_coverage >= 0.6 THEN 'keyword_coverage' END, CASE WHEN score_gap >= 0.03 THEN 'score_gap' END], lambda x: x IS NOT NULL) AS codes FROM g)
SELECT query_id, level, query_type = 'strategy' OR level <> 'high' AS use_llm,
  CASE WHEN query_type = 'strategy' THEN 'strategy_answer' WHEN query_type IN ('exact_statute', 'case_lookup') AND level = 'high' THEN 'citation_answer' ELSE 'semantic_explanation' END AS response_type,
  CASE WHEN query_type = 'strategy' THEN 'strategy_requires_llm' WHEN NOT found THEN 'no_results' WHEN len(codes) > 0 THEN array_to_string(codes, ',')
    WHEN query_type = 'exact_statute' THEN CASE WHEN statute THEN 'exact_statute_match' ELSE 'exact_statute_needs_explanation' END WHEN query_type = 'case_lookup' THEN CASE WHEN cas THEN 'case_lookup_match' ELSE '' END
    WHEN sem THEN 'semantic_high_confidence' WHEN top_fused_score >= 0.55 THEN 'semantic_needs_llm' ELSE 'weak_retrieval' END AS reasons,
  CASE level WHEN 'high' THEN 0.88::DOUBLE WHEN 'medium' THEN 0.64::DOUBLE ELSE 0.38::DOUBLE END AS confidence FROM l""")
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("exact_statute", "case_lookup", "semantic_law", "strategy")])
    rows = read(spark, d, "documents").select(
        n.alias("query_id"), F.get(kinds, (n % 4).cast("int")).alias("query_type"), F.when(n % 11 != 0, (n * 7 % 100) / F.lit(100.0)).alias("top_fused_score"), ((n * 3 % 10) / F.lit(100.0)).alias("score_gap"),
        ((n * 13 % 100) / F.lit(100.0)).alias("keyword_coverage"), (n % 5 == 0).alias("phrase_match"), (n % 3 == 0).alias("citation_match"), (n % 3).alias("supporting_chunks"),
    )
    return answers.gate(rows).select("query_id", "level", "use_llm", "response_type", F.array_join("reason_codes", ",").alias("reasons"), "confidence")


@query(f"""
WITH {bm25()}, n AS (SELECT h.query_id, count(*) FILTER (d.country = 'en') AS laws, count(*) FILTER (d.country <> 'en') AS courts FROM hits h JOIN d USING (chunk_id) GROUP BY 1)
SELECT query_id, round(least(0.95::DOUBLE, 0.25::DOUBLE + 0.08::DOUBLE * laws + 0.08::DOUBLE * courts), 2) AS confidence, (laws < 2)::INT + (courts < 2)::INT AS n_risks, 1 + 2 AS n_missing FROM n""")
def strategy_confidence(spark: SparkSession, d: str) -> DataFrame:
    n = hits(spark, d).groupBy("query_id").agg(F.count_if(F.col("country") == "en").alias("n_laws"), F.count_if(F.col("country") != "en").alias("n_courts"))
    none = F.array().cast("array<string>")
    rows = n.withColumns({"law_points": none, "court_points": none, "has_case": F.lit(False), "has_documents": F.lit(False), "hints": F.array(F.lit("contract"), F.lit("filing"), F.lit("other"))})
    return answers.strategy(rows).select("query_id", "confidence", F.size("risks").alias("n_risks"), F.size("missing_documents").alias("n_missing"))


@query()
def grounding_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.substantive(hits(spark, d)).groupBy("query_id").agg(F.first("query").alias("query"), F.transform(F.sort_array(F.collect_list(F.struct("pick", "filename", "score", "text"))), lambda x: F.struct(x["filename"], x["score"], x["text"])).alias("sources"))
    return rows.select("query_id", answers.prompt(F.col("query"), F.lit("czechia"), F.lit(None).cast("string"), F.col("sources")).alias("prompt"))


# Composite searches --------------------------------------------------------


@query()
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(corpus(spark, d), queries(spark, d).select("query_id", "query"), top_k=5, dimension=DIM)


@query()
def answer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return search.answer(corpus(spark, d).withColumn("source", F.col("law_iri")), queries(spark, d).select("query_id", "query"), top_k=5, dimension=DIM)


@query()
def strategy_chain(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d).withColumn("source", F.col("law_iri"))
    asked = queries(spark, d).select("query_id", "query", F.lit(None).cast("string").alias("case_id"), F.array().cast("array<string>").alias("document_ids"))
    return search.strategy(c.filter("country = 'en'"), c.filter("country != 'en'"), asked, ("contract", "filing"), dimension=DIM)


@query()
def ingest_corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("fragment_id"), F.col("source").alias("law_iri"), "text", F.col("doc_id").alias("pos"))
    return search.ingest_fragments(docs).groupBy("law_iri").agg(F.countDistinct("fragment_id").alias("n_fragments"), F.count("*").alias("n_chunks"))


# Streams -------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    return ingestion.source(spark, d, "events.parquet", read(spark, d, "events").schema)


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type")
def stream_ingest_dedup(spark: SparkSession, d: str) -> DataFrame:
    at = work.fresh(spark, "stream")
    first = ingestion.distinct_texts(_events(spark, d).withColumn("who", F.col("user_id").cast("string")), "event_type", "who")
    ingestion.upsert_into(first, f"{at}/out", f"{at}/state", "event_id").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type AS bucket, (value > 50)::VARCHAR AS event, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    at = work.fresh(spark, "stream")
    running = ingestion.counters(_events(spark, d).withColumn("high", (F.col("value") > 50).cast("string")), "event_type", "high")
    return ingestion.to_memory(running, f"counters_{uuid.uuid4().hex}", "complete", at)


