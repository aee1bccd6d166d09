"""Registered queries over sources, the stored index and its filters.  The files they read
are made from the driver's tables, below the shared folder."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.operators import counts, index, ingest, merging
from rillmark.sources import datasets, statutes, work

from . import search
from .tables import DIM, IDF, NORM_TF, STATS, corpus, read, tok

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Statute collections -------------------------------------------------------

#: A collection for each size of a part: headings with and without a number, texts, a type
#: that carries no text, and empty texts.
FRAGMENTS = """
f AS (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS pos,
  CASE WHEN p_partkey % 7 = 0 THEN 'Paragraf' WHEN p_partkey % 7 = 1 THEN 'Obrazek' ELSE 'Odstavec_Dc' END AS typ,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 14 = 0 THEN '<b>' || p_name || '</b>' WHEN p_partkey % 7 = 0 THEN '<b>§ ' || p_partkey || '</b>' ELSE '<p>' || p_name || '</p>' END AS xhtml,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 14 = 0 THEN p_name WHEN p_partkey % 7 = 0 THEN '§ ' || p_partkey ELSE p_name END AS body FROM part)"""


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """p_size and the collection as JSON, one small collection a row."""
    read(spark, d, "part").createOrReplaceTempView("rillmark_part")
    rows = spark.sql(f"WITH {FRAGMENTS.replace('FROM part', 'FROM rillmark_part')} SELECT * FROM f")
    one = F.struct(F.col("p_partkey").cast("string").alias("fragmentId"), F.lit(1).alias("hloubka"), "typ", "xhtml")
    per = rows.groupBy("p_size").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", one.alias("f")))), lambda x: x["f"]).alias("fragmenty"))
    meta = F.struct(F.concat(F.col("p_size").cast("string"), F.lit("/2000 Sb.")).alias("predpisCislo"), F.lit("2000").alias("rocnik"))
    return per.select("p_size", F.to_json(F.struct(meta.alias("metadata"), "fragmenty")).alias("body"))


@query(f"""WITH {FRAGMENTS},
k AS (SELECT *, regexp_extract(body, '(?i)§\\s*([0-9]+[a-z]?)', 1) AS named FROM f WHERE typ <> 'Obrazek' AND body <> ''),
c AS (SELECT *, last_value(CASE WHEN typ = 'Paragraf' OR named <> '' THEN {{'p': nullif(named, '')}} END IGNORE NULLS) OVER (PARTITION BY p_size ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM k)
SELECT 'local:sb/2000/' || p_size || '/' || p_partkey AS fragment_id, 'local:sb/2000/' || p_size AS law_iri, body AS text, e.p AS paragraph, pos FROM c""")
def json_statute_scan(spark: SparkSession, d: str) -> DataFrame:
    at = work.fresh(spark, "statutes")
    _bodies(spark, d).select(F.col("body").alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    return statutes.fragments(statutes.collections(spark, at)).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH {FRAGMENTS},
b AS (SELECT p_size, string_agg('[' || typ || ' | depth=1 | id=' || p_partkey || ']' || chr(10) || body, chr(10) || chr(10) ORDER BY pos) FILTER (body <> '') AS blocks FROM f GROUP BY 1)
SELECT p_size || '.json' AS name, 'Source file: ' || p_size || '.json' || chr(10) || 'Legal collection item: ' || p_size || '/2000 Sb./2000 Sb.' || COALESCE(chr(10) || chr(10) || blocks, '') AS text FROM b""")
def collection_render(spark: SparkSession, d: str) -> DataFrame:
    return statutes.rendered(_bodies(spark, d).select(F.concat(F.col("p_size").cast("string"), F.lit(".json")).alias("name"), "body"))


def _zip(name: str, content: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def _archives(spark: SparkSession, d: str) -> str:
    """An archive for each nation; every fifth holds no statute."""
    at = work.fresh(spark, "archives")
    for r in read(spark, d, "nation").select("n_nationkey", "n_name").collect():
        body = json.dumps({"metadata": {"predpisCislo": f"{r.n_nationkey}/2000 Sb."}, "fragmenty": [{"fragmentId": "1", "typ": "Odstavec_Dc", "xhtml": f"<p>{r.n_name}</p>"}]})
        name = f"Sb_2000_{r.n_nationkey}/x.txt" if r.n_nationkey % 5 == 0 else f"Sb_2000_{r.n_nationkey}_IZ.json"
        work.put(spark, f"{at}/Sb_2000_{r.n_nationkey}_2026-01-01.zip", _zip(name, body))
    work.put(spark, f"{at}/other.zip", _zip("x_IZ.json", "{}"))
    return at


@query("""SELECT 'local:sb/2000/' || n_nationkey AS law_iri, CASE WHEN n_nationkey % 5 <> 0 THEN 'Sb_2000_' || n_nationkey || '_IZ.json' END AS member, n_nationkey % 5 <> 0 AS has_body FROM nation""")
def zip_scan(spark: SparkSession, d: str) -> DataFrame:
    laws = statutes.archive_laws(statutes.archives(spark, _archives(spark, d)))
    return laws.select("law_iri", "member", F.col("body").isNotNull().alias("has_body"))


@query("""SELECT 'local:sb/2000/' || n_nationkey || '/1' AS fragment_id, n_name AS text FROM nation WHERE n_nationkey % 5 <> 0""")
def zip_fragments(spark: SparkSession, d: str) -> DataFrame:
    laws = statutes.archive_laws(statutes.archives(spark, _archives(spark, d)))
    return statutes.archive_fragments(laws).select("fragment_id", "text")


#: The text of each part's law, and of its second edition.
LAW, AGAIN = "'Nariadenie ' || p_name || ' ' || p_type", "'Zmena ' || p_brand || ' ' || p_type"


def _law_files(parts: DataFrame) -> DataFrame:
    """path and content of an archive for each row (p_partkey, body), made on executors."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f"Sb_2000_{k}_2026.zip", _zip(f"Sb_2000_{k}_IZ.json", json.dumps({"metadata": {"predpisCislo": f"{k}/2000 Sb."}, "fragmenty": [{"fragmentId": "1", "typ": "Odstavec_Dc", "xhtml": f"<p>{t}</p>"}]}))) for k, t in zip(b["p_partkey"], b["body"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "content"])

    return parts.select("p_partkey", "body").mapInPandas(made, "path string, content binary")


@query(f"""WITH d AS (SELECT p_partkey, {tok(f"CASE WHEN p_partkey % 5 = 0 THEN {AGAIN} ELSE {LAW} END")} AS toks FROM part),
st AS (SELECT count(*) AS n_docs, sum(len(toks)) / count(*)::DOUBLE AS avg_dl FROM d),
tf AS (SELECT p_partkey, len(toks) AS dl, token, count(*) AS tf FROM (SELECT p_partkey, toks, unnest(toks) AS token FROM d) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
SELECT 'local:sb/2000/' || p_partkey || '/1' AS fragment_id, count(*) AS n, round(sum({IDF} * {NORM_TF}), 6) AS weight FROM tf JOIN df USING (token) CROSS JOIN st GROUP BY 1""")
def zip_ingested(spark: SparkSession, d: str) -> DataFrame:
    """Archives of all parts ingested in two passes; a fifth of the laws comes again with
    another text, and the weights of all chunks follow."""
    at = work.fresh(spark, "ingested")
    parts = read(spark, d, "part")
    table = merging.create(spark, f"{at}/table", T.StructType.fromDDL("chunk_id string, fragment_id string, text string, embedding array<double>"), "chunk_id")
    held = counts.Counts(spark, f"{at}/counts")
    search.ingest_archives(table, held, _law_files(parts.select("p_partkey", F.expr(LAW).alias("body"))), DIM, "archives", 0)
    _, sparse = search.ingest_archives(table, held, _law_files(parts.filter("p_partkey % 5 = 0").select("p_partkey", F.expr(AGAIN).alias("body"))), DIM, "archives", 1)
    per = sparse.groupBy("chunk_id").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))
    return table.read().select("chunk_id", "fragment_id").join(per, "chunk_id").select("fragment_id", "n", "weight")


def _section(spark: SparkSession, d: str) -> str:
    at = work.fresh(spark, "section")
    good = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name")))
    read(spark, d, "part").select(F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("{no json "), F.col("p_partkey").cast("string"))).otherwise(good).alias("value")).write.text(at)
    return at


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name FROM part WHERE p_partkey % 10 <> 0")
def section_scan(spark: SparkSession, d: str) -> DataFrame:
    return statutes.section(spark, _section(spark, d), "terms")


@query("SELECT '{no json ' || p_partkey AS line FROM part WHERE p_partkey % 10 = 0")
def section_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    return statutes.bad_lines(spark, _section(spark, d), "terms")


#: Files of all five sections that the tables are written to.
DATASETS = 16
#: A name that looks like markup of the file it stands in.
ODD = """p_name || ' } "{ \\ ], "links": ['"""


def _datasets(spark: SparkSession, d: str) -> str:
    """The tables as JSON files of five sections each; every tenth term is no JSON."""
    at = work.fresh(spark, "datasets")

    def rows(table: str, place: int, key: str, *fields: Column) -> DataFrame:
        body = F.to_json(F.struct(*fields, F.struct(F.struct(F.col(key).alias("k")).alias("n")).alias("extra")), {"ignoreNullFields": "false"})
        return read(spark, d, table).select((F.col(key) % DATASETS).alias("part"), F.lit(place).alias("place"), F.col(key).alias("key"), body.alias("body"))

    def key(c: str) -> Column:
        return F.col(c).cast("string")

    sections = (
        ("law_fragments", rows("documents", 0, "doc_id", key("doc_id").alias("id"), F.col("source").alias("law_iri"), "text", F.lit(None).cast("string").alias("paragraph"))),
        ("definitions", rows("supplier", 1, "s_suppkey", key("s_suppkey").alias("id"), F.array("s_name", key("s_nationkey")).alias("law_links"))),
        ("links", rows("nation", 2, "n_nationkey", key("n_nationkey").alias("id"), F.col("n_name").alias("source"), key("n_regionkey").alias("target"))),
        ("terms", rows("part", 3, "p_partkey", key("p_partkey").alias("id"), F.expr(ODD.replace("\\", "\\\\")).alias("name")).withColumn("body", F.when(F.col("key") % 10 == 0, F.concat(F.lit('{"id": '), F.col("key").cast("string"), F.lit(', "name": }'))).otherwise(F.col("body")))),
        ("metadata", rows("customer", 4, "c_custkey", key("c_custkey").alias("law_id"), F.col("c_name").alias("citace"), F.col("c_mktsegment").alias("name"))),
    )
    lines = None
    for place, (name, found) in enumerate(sections):
        head = spark.range(DATASETS).select(F.col("id").alias("part"), F.lit(place).alias("place"), F.lit(None).cast("long").alias("key"), F.lit(("{" if place == 0 else "],") + f'"{name}": [').alias("body"))
        some = head.unionByName(found)
        lines = some if lines is None else lines.unionByName(some)
    end = spark.range(DATASETS).select(F.col("id").alias("part"), F.lit(len(sections)).alias("place"), F.lit(None).cast("long").alias("key"), F.lit("]}").alias("body"))
    # a record follows another one: a comma before it
    after = F.lag("key").over(Window.partitionBy("part").orderBy("place", F.asc_nulls_first("key")))
    lines = lines.unionByName(end).select("part", "place", "key", F.concat(F.when(F.col("key").isNotNull() & after.isNotNull(), ",").otherwise(""), "body").alias("value"))
    with work.cleaned(spark):
        lines.repartition(DATASETS, "part").sortWithinPartitions("part", "place", F.asc_nulls_first("key")).select("part", "value").write.partitionBy("part").text(at)
    return at


@query(f"""SELECT 'law_fragments' AS section, doc_id::VARCHAR AS id, COALESCE(source, '~') || ' ' || COALESCE(md5(text), '~') AS value FROM documents
UNION ALL SELECT 'definitions', s_suppkey::VARCHAR, s_name || ',' || s_nationkey FROM supplier
UNION ALL SELECT 'links', n_nationkey::VARCHAR, n_name || '>' || n_regionkey FROM nation
UNION ALL SELECT 'terms', p_partkey::VARCHAR, {ODD} FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT 'metadata', c_custkey::VARCHAR, c_name || ' ' || c_mktsegment FROM customer""")
def dataset_scan(spark: SparkSession, d: str) -> DataFrame:
    """All records of large files of five sections, cut in parallel."""
    found = datasets.records(spark, _datasets(spark, d))

    def some(name: str, key: str, value: Column) -> DataFrame:
        return datasets.section(found, name).select(F.lit(name).alias("section"), F.col(key).alias("id"), value.alias("value"))

    text = F.concat_ws(" ", F.coalesce("law_iri", F.lit("~")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("~")))
    out = some("law_fragments", "id", text).unionByName(some("definitions", "id", F.array_join("law_links", ",")))
    out = out.unionByName(some("links", "id", F.concat_ws(">", "source", "target"))).unionByName(some("terms", "id", F.col("name")))
    return out.unionByName(some("metadata", "law_id", F.concat_ws(" ", "citace", "name")))


@query("""SELECT 'terms' AS section, '{"id": ' || p_partkey || ', "name": }' AS body FROM part WHERE p_partkey % 10 = 0""")
def dataset_bad_records(spark: SparkSession, d: str) -> DataFrame:
    return datasets.bad(datasets.records(spark, _datasets(spark, d)), "terms")


@query("""
SELECT n_nationkey || '.' || ['txt', 'json', 'zip', 'exe', 'docx'][n_nationkey % 5 + 1] AS filename,
       CASE n_nationkey % 5 WHEN 0 THEN n_name || ' ž' WHEN 3 THEN NULL WHEN 4 THEN n_name || chr(10) || 'end' ELSE '{' || chr(10) || '  "foo": "' || n_name || '"' || chr(10) || '}' END AS text,
       CASE WHEN n_nationkey % 5 = 3 THEN 'unsupported file type: exe' END AS error FROM nation""")
def doc_parse(spark: SparkSession, d: str) -> DataFrame:
    at = work.fresh(spark, "documents")
    for r in read(spark, d, "nation").select("n_nationkey", "n_name").collect():
        foo = json.dumps({"foo": r.n_name})
        word = f"<w:document><w:p><w:t>{r.n_name}</w:t></w:p><w:p><w:t>end</w:t></w:p></w:document>"
        suffix, content = (("txt", f"{r.n_name} ž".encode()), ("json", foo.encode()), ("zip", _zip("a.json", foo)), ("exe", b"x"), ("docx", _zip("word/document.xml", word)))[r.n_nationkey % 5]
        work.put(spark, f"{at}/{r.n_nationkey}.{suffix}", content)
    return statutes.documents(spark, at).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "text", "error")


@query("""SELECT c_custkey || '.' || ['txt', 'pdf', 'exe'][c_custkey % 3 + 1] AS filename, (c_custkey % 4)::BIGINT AS size_bytes, 'uploaded' AS status FROM customer WHERE c_custkey % 3 <> 2 AND c_custkey % 4 > 0""")
def upload_rows(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    files = read(spark, d, "customer").select(F.concat(F.lit("file:/in/"), key.cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("txt", "pdf", "exe")]), (key % 3 + 1).cast("int"))).alias("path"), (key % 4).alias("length"))
    return statutes.uploads(files, F.current_timestamp()).select("filename", "size_bytes", "status")


# Chunks and the index ------------------------------------------------------


@query("SELECT 'doc/' || doc_id AS fragment_id, 0 AS chunk_index, md5(trim(text)) AS text_md5 FROM documents WHERE length(trim(text)) BETWEEN 1 AND 1200")
def chunk_fixed_fastpath(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("fragment_id"), "text")
    whole = ingest.chunks(docs.filter(F.length(F.trim("text")) <= ingest.CHUNK))
    return whole.select("fragment_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""
WITH h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(doc_id::VARCHAR)) AS h FROM documents)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id,
       '{"chunk_id":"' || doc_id || '"' || CASE WHEN source IS NULL THEN '' ELSE ',"law_iri":"' || source || '"' END || ',"chunk_index":0}' AS payload FROM h""")
def index_points(spark: SparkSession, d: str) -> DataFrame:
    return index.points(corpus(spark, d).select("chunk_id", "law_iri", "chunk_index"))


@query(f"""WITH {STATS}
SELECT token, df, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf FROM df CROSS JOIN st WHERE df >= 2""")
def idf_saved(spark: SparkSession, d: str) -> DataFrame:
    at = work.fresh(spark, "idf")
    index.save_idf(corpus(spark, d), at)
    return index.load_idf(spark, at).select("token", "df", F.round("idf", 6).alias("idf"))


@query("SELECT doc_id AS chunk_id FROM documents WHERE lang = 'en' AND source IN ('src0', 'src3', 'src7')")
def composed_filter(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).withColumn("document_id", F.col("law_iri")).filter(index.within(country="en", document_ids=("src0", "src3", "src7"))).select("chunk_id")


@query("SELECT c_custkey AS document_id, c_name AS filename FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def document_lookup(spark: SparkSession, d: str) -> DataFrame:
    registry = read(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename"))
    return index.chosen(registry, read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("document_id")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25")
def ordered_page(spark: SparkSession, d: str) -> DataFrame:
    return index.page(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), (F.desc("o_totalprice"), "o_orderkey"), 25, 50)
