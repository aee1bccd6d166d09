"""How the driver's tables play the engine's parts, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark import packaging
from rillmark.operators import dense, lexical
from rillmark.operators.sides import few
from rillmark.sources.work import stored

#: Vector size of the registered hash embeddings, and hits of a registered search.
DIM, HITS = 64, 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    packaging.send(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: source is the law, lang the country."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("law_iri"), F.col("lang").alias("country"), "text", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("filename"), F.lit(0).alias("chunk_index"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.col("text").alias("query"))


def hits(spark: SparkSession, sf_dir: str, k: int = HITS) -> DataFrame:
    """BM25 hits of all benchmark items with the chunk's columns and the query."""
    c = corpus(spark, sf_dir)
    found = few(stored(lexical.search(c, queries(spark, sf_dir), k), "hits"))
    return found.join(c, "chunk_id").join(queries(spark, sf_dir).drop("text"), "query_id")


def dense_hits(spark: SparkSession, sf_dir: str, k: int = HITS, asked: DataFrame | None = None) -> DataFrame:
    """Nearest documents of ``asked`` (query_id, text), or of all benchmark items, by hash
    embedding."""
    docs = dense.dense_vectors(corpus(spark, sf_dir), DIM)
    texts = queries(spark, sf_dir) if asked is None else asked
    asked = dense.dense_vectors(texts.withColumnRenamed("query_id", "chunk_id"), DIM).withColumnRenamed("chunk_id", "query_id")
    return dense.nearest(docs, asked, k)


# SQL pieces ----------------------------------------------------------------

TOKENS = "regexp_extract_all(strip_accents(lower({0})), '[0-9]{{1,6}}|[a-z]{{2,}}')"
WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{M}}\p{{N}}_]+')"


def tok(x: str) -> str:
    return TOKENS.format(x)


def word(x: str) -> str:
    return WORDS.format(x)


IDF = "CASE WHEN df >= 2 THEN ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) ELSE ln((n_docs + 0.5) / 1.5 + 1.0) END"
NORM_TF = "(tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avg_dl, 1.0)))"

STATS = f"""
d AS (SELECT doc_id AS chunk_id, source AS law_iri, lang AS country, text, 'doc-' || doc_id AS filename, {tok("text")} AS toks FROM documents),
st AS (SELECT count(*) FILTER (len(toks) > 0) AS n_docs, sum(len(toks)) / (count(*) FILTER (len(toks) > 0))::DOUBLE AS avg_dl FROM d),
tf AS (SELECT chunk_id, len(toks) AS dl, token, count(*) AS tf FROM (SELECT chunk_id, toks, unnest(toks) AS token FROM d) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)"""


def bm25(k: int = HITS, where: str = "true", queries_sql: str = "SELECT item_id AS query_id, text FROM benchmark") -> str:
    """CTEs up to hits: query_id, chunk_id, score, rank."""
    return f"""{STATS},
qs AS ({queries_sql}),
qt AS (SELECT DISTINCT query_id, unnest({tok("text")}) AS token FROM qs),
qi AS (SELECT query_id, qt.token, {IDF} AS idf FROM qt LEFT JOIN df ON qt.token = df.token CROSS JOIN st),
bm AS (SELECT query_id, tf.chunk_id, round(sum(idf * idf * {NORM_TF}), 6) AS score
       FROM qi JOIN tf ON qi.token = tf.token JOIN d ON d.chunk_id = tf.chunk_id CROSS JOIN st WHERE {where} GROUP BY 1, 2),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm QUALIFY rank <= {k})"""


def embedding(rows: str, name: str) -> str:
    """CTEs {name}_parts (chunk_id, bucket, value) and {name}_vec (chunk_id, v)."""
    folded = "strip_accents(lower(trim(COALESCE(text, ''))))"
    return f"""
{name}_tok AS (SELECT chunk_id, token, count(*) AS n FROM (
  SELECT chunk_id, unnest(CASE WHEN {folded} = '' THEN ['__empty__'] WHEN len({word(folded)}) = 0 THEN [{folded}] ELSE {word(folded)} END) AS token FROM ({rows})) GROUP BY ALL),
{name}_b AS (SELECT chunk_id, ('0x' || substr(sha256(token), 1, 8))::BIGINT % {DIM} AS bucket,
  sum(n * (CASE WHEN ('0x' || substr(sha256(token), 9, 2))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * (1 + ('0x' || substr(sha256(token), 11, 2))::BIGINT::DOUBLE / 255.0::DOUBLE)) AS v
  FROM {name}_tok GROUP BY ALL),
{name}_parts AS (SELECT chunk_id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY chunk_id)) AS value FROM {name}_b WHERE v <> 0)"""


def dense_sql(k: int = HITS, queries_sql: str = "SELECT item_id AS chunk_id, text FROM benchmark") -> str:
    """CTEs up to dhits: query_id, chunk_id, score, rank."""
    return f"""{embedding("SELECT doc_id AS chunk_id, text FROM documents", "e")},{embedding(queries_sql, "f")},
dots AS (SELECT f_parts.chunk_id AS query_id, e_parts.chunk_id, round(sum(e_parts.value * f_parts.value), 6) AS score FROM e_parts JOIN f_parts USING (bucket) GROUP BY 1, 2),
dhits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dots QUALIFY rank <= {k})"""
