"""Registered queries over texts: folding, tokens, ids, line kinds, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import hashing
from rillmark.functions import text as T
from rillmark.operators import answers, ingest, understanding
from rillmark.sources import html_pages

from .tables import bm25, hits, read, tok, word

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {SQUEEZED.format('strip_accents(lower(text))')} AS folded FROM documents")
def text_fold(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, len({tok('text')})::INT AS n_tokens, array_to_string({tok('text')}, ' ') AS tokens FROM documents")
def tok_bm25(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.size(T.bm25_tokens(F.col("text"))).alias("n_tokens"), F.array_join(T.bm25_tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string(list_filter({word('strip_accents(lower(text))')}, lambda x: length(x) > 2), ' ') AS words FROM documents")
def tok_word(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(T.words(T.fold(F.col("text")), 2), " ").alias("words"))


@query(f"SELECT token, ('0x' || substr(sha256(token), 1, 8))::BIGINT AS idx FROM (SELECT DISTINCT unnest({tok('text')}) AS token FROM documents)")
def tok_index_sha256(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.explode(T.bm25_tokens(F.col("text"))).alias("token")).distinct().select("token", hashing.token_index(F.col("token")).alias("idx"))


@query("""
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc/' || doc_id || ':0')) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
       substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM h""")
def uuid5_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", hashing.chunk_id(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.lit(0)).alias("chunk_id"))


@query("""
WITH t AS (SELECT doc_id, '§ ' || (doc_id % 97) || 'a podle §§ ' || (doc_id % 13) || ' a § ' || (doc_id % 13) || ' ' || text AS t FROM documents)
SELECT doc_id, array_to_string(regexp_extract_all(t, '§+\\s*([0-9]+[a-zA-Z]?)', 1)[1:1] ||
       CASE WHEN (doc_id % 97) || 'a' = (doc_id % 13)::VARCHAR THEN [] ELSE [(doc_id % 13)::VARCHAR] END, ',') AS paragraphs FROM t""".replace("\\\\", "\\"))
def para_extract(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.concat(F.lit("§ "), n % 97, F.lit("a podle §§ "), n % 13, F.lit(" a § "), n % 13, F.lit(" "), F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.array_join(T.paragraphs(text), ",").alias("paragraphs"))


@query(r"""
WITH t AS (SELECT doc_id, 'zákon č. ' || (doc_id % 500 + 1) || ' / ' || (1950 + doc_id % 70) || ' Sb. a 89/2012 Sb., ' || text AS t FROM documents),
c AS (SELECT doc_id, regexp_extract_all(t, '([0-9]{1,4})\s*/\s*([0-9]{4})', 1) AS n, regexp_extract_all(t, '([0-9]{1,4})\s*/\s*([0-9]{4})', 2) AS y FROM t),
p AS (SELECT doc_id, unnest(range(1, len(n) + 1)) AS i, n, y FROM c),
f AS (SELECT doc_id, 'local:sb/' || y[i] || '/' || n[i] AS iri, min(i) AS i FROM p GROUP BY 1, 2)
SELECT doc_id, string_agg(iri, ',' ORDER BY i) AS laws FROM f GROUP BY doc_id""")
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    text = F.concat(F.lit("zákon č. "), n % 500 + 1, F.lit(" / "), 1950 + n % 70, F.lit(" Sb. a 89/2012 Sb., "), F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.array_join(T.citations(text), ",").alias("laws"))


@query(r"""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Sbírka ' || source ELSE (doc_id % 500 + 1) || '/' || (1950 + doc_id % 70) || ' Sb.' END AS c FROM documents),
i AS (SELECT doc_id, CASE WHEN regexp_matches(c, '^[0-9]+/[0-9]{4}') THEN 'local:sb/' || regexp_extract(c, '^([0-9]+)/([0-9]{4})', 2) || '/' || regexp_extract(c, '^([0-9]+)/([0-9]{4})', 1)
                           ELSE 'local:sb/' || regexp_replace(c, '[^a-zA-Z0-9_/]', '_', 'g') END AS iri FROM c)
SELECT doc_id, iri, CASE WHEN regexp_matches(iri, '^local:sb/([0-9]{4})/([0-9]+)$')
  THEN regexp_extract(iri, '^local:sb/([0-9]{4})/([0-9]+)$', 2) || '/' || regexp_extract(iri, '^local:sb/([0-9]{4})/([0-9]+)$', 1) || ' Sb.' ELSE iri END AS filename FROM i""")
def law_iri_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    cited = F.when(n % 7 == 0, F.concat(F.lit("Sbírka "), "source")).otherwise(F.concat(n % 500 + 1, F.lit("/"), 1950 + n % 70, F.lit(" Sb.")))
    return read(spark, d, "documents").select("doc_id", T.iri_of_citation(cited).alias("iri")).withColumn("filename", T.iri_to_filename(F.col("iri")))


@query("SELECT page_id, " + SQUEEZED.format("regexp_replace(html, '<[^>]+>', ' ', 'g')") + " AS text FROM pages")
def html_strip_regex(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query()
def html_strip_parser(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", html_pages.block_text(F.col("html")).alias("text"))


@query("""SELECT CASE WHEN length(trim(COALESCE(text, ''))) = 0 THEN 'empty_text' WHEN length(trim(text)) < 3 THEN 'text_too_short' ELSE 'ok' END AS reason, count(*) AS n
FROM documents GROUP BY 1""")
def ingest_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    return ingest.counts_by_reason(read(spark, d, "documents"))


@query("SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, sha1(trim(COALESCE(text, '')))")
def dedup_text_per_source(spark: SparkSession, d: str) -> DataFrame:
    return ingest.first_text_per(read(spark, d, "documents").select("doc_id", "source", "text"), "source", "doc_id").select("doc_id", "source")


@query()
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    fragments = read(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("fragment_id"), F.col("source").alias("law_iri"), "text")
    return ingest.chunks(fragments).select("fragment_id", "chunk_index", "chunk_id", "text")


LINES = "SELECT doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS line FROM documents"
ACT = r"(?:z[aá]kon|na[rř][íi]zen[íi]|vyhl[áa][šs]ka|sd[eě]len[íi])"
INDEX = rf"regexp_matches(v, '(?i)^[0-9]{{1,3}}\.\s+(?:(?:část|hlava|díl)\s+[\p{{L}}\p{{N}}_]+\s+)?{ACT}')"
INDEX_PLAIN = rf"regexp_matches(v, '(?i)^[0-9]{{1,3}}\.\s+{ACT}')"
AMENDS = rf"regexp_matches(v, '(?i)(?:z[aá]kon|na[rř][íi]zen[íi](?:\s+vl[aá]dy)?|vyhl[áa][šs]ka|sd[eě]len[íi])\s+č\.')"
SECTION = r"regexp_matches(v, '(?i)^(?:část|hlava|díl|oddíl|pododdíl|kapitola)([^\p{L}\p{N}_]|$)')"
REFERENCE = r"regexp_matches(v, '(?i)^(?:§\s*[0-9]+[a-z]?(?:\s+odst\.\s*[0-9]+)?(?:\s+(?:a|nebo|,)\s*§\s*[0-9]+[a-z]?)*|odstavce?\s+[0-9]+(?:\s+(?:a|nebo|,)\s*[0-9]+)*|písmene?\s+[a-z]\)(?:\s+(?:a|nebo)\s+[a-z]\))*)\s*[,.]?$')"
CAPS = "(regexp_replace(v, '[^A-Za-zÀ-ž]', '', 'g') <> '' AND regexp_replace(v, '[^A-Za-zÀ-ž]', '', 'g') = upper(regexp_replace(v, '[^A-Za-zÀ-ž]', '', 'g')))"


def heading_sql(verbs: list[str]) -> str:
    n = f"len({word('v')})"
    return f"({n} > 0 AND {n} <= 12 AND length(v) < 120 AND NOT regexp_matches(v, '[.!?;:]') AND NOT regexp_matches(lower(v), '{'|'.join(verbs)}'))"


def penalty_sql(verbs: list[str] = T.VERBS, heading: str = "0.35", most: str = "0.85", references: bool = True) -> str:
    """Over a column v, the trimmed line."""
    line = f"(CASE WHEN {INDEX} THEN 0.55::DOUBLE WHEN {AMENDS} AND length(v) < 140 THEN 0.35::DOUBLE ELSE 0 END)"
    total = f"({line} + (CASE WHEN {SECTION} THEN 0.45::DOUBLE ELSE 0 END) + (CASE WHEN {heading_sql(verbs)} THEN {heading}::DOUBLE + (CASE WHEN {CAPS} THEN 0.15::DOUBLE ELSE 0 END) ELSE 0 END))"
    if references:
        total = f"(CASE WHEN {total} = 0 AND {REFERENCE} THEN 0.25::DOUBLE ELSE {total} END)"
    return f"(CASE WHEN v = '' THEN 0::DOUBLE ELSE least({total}, {most}::DOUBLE) END)"


@query(f"""WITH l AS (SELECT doc_id, pos, trim(line) AS v FROM ({LINES}))
SELECT doc_id, pos, round({penalty_sql()}, 6) AS penalty, round({penalty_sql(T.VERBS_CROSS, "0.40", "0.90", False)}, 6) AS cross_penalty FROM l""")
def structural_penalty(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", F.round(T.structural_penalty(F.col("line")), 6).alias("penalty"), F.round(T.cross_encoder_penalty(F.col("line")), 6).alias("cross_penalty"))


def heading_boost_sql(where: str, words: str) -> str:
    """Over a column v, the trimmed line; words is a list."""
    return f"(CASE WHEN {where} AND v <> '' AND NOT {SECTION} AND NOT {INDEX} AND {heading_sql(T.VERBS)} AND list_has_any(string_split({SQUEEZED.format('strip_accents(lower(v))')}, ' '), {words}) THEN 0.18::DOUBLE ELSE 0::DOUBLE END)"


@query(f"""WITH l AS (SELECT doc_id, pos, trim(line) AS v FROM ({LINES}))
SELECT doc_id, pos, {heading_boost_sql("true", "['the', 'der', 'de', 'la']")} AS boost FROM l""")
def heading_boost(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    asked = F.array(*[F.lit(w) for w in ("the", "der", "de", "la")])
    return lines.select("doc_id", "pos", T.heading_boost(F.col("line"), asked, F.lit(True), F.lit("domain_search")).alias("boost"))


SUBSTANTIVE = rf"(length(v) >= 30 AND NOT {INDEX_PLAIN} AND NOT {SECTION} AND (regexp_matches(v, '[0-9]') OR regexp_matches(v, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(T.SUBSTANTIVE_VERBS)})([^\p{{L}}\p{{N}}_]|$)|[\p{{L}}\p{{N}}_]-li([^\p{{L}}\p{{N}}_]|$)')))"


@query(f"""WITH {bm25()},
r AS (SELECT h.query_id, h.chunk_id, h.rank, trim(d.text) AS v FROM hits h JOIN d USING (chunk_id)),
g AS (SELECT *, {SUBSTANTIVE} AS good, bool_or({SUBSTANTIVE}) OVER (PARTITION BY query_id) AS any_good FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pick FROM g WHERE CASE WHEN any_good THEN good ELSE v <> '' END)
SELECT query_id, chunk_id, pick::INT AS pick, CASE WHEN length(v) > 600 THEN rtrim(substr(v, 1, 600)) || ' …' ELSE v END AS text FROM p WHERE pick <= CASE WHEN any_good THEN 5 ELSE 1 END""")
def substantive_pick(spark: SparkSession, d: str) -> DataFrame:
    return answers.substantive(hits(spark, d)).select("query_id", "chunk_id", "pick", "text")


@query(rf"""WITH {bm25()},
s AS (SELECT h.query_id, b.text AS q, h.rank, unnest(range(0, len(string_split(regexp_replace(d.text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))))) AS pos,
             trim(unnest(string_split(regexp_replace(d.text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))) AS sentence
      FROM hits h JOIN d USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id),
o AS (SELECT query_id, rank, pos, sentence, len(list_intersect(list_distinct(list_filter({word('lower(q)')}, lambda x: length(x) > 3)), list_distinct({word('lower(sentence)')}))) AS overlap FROM s WHERE length(sentence) >= 30),
u AS (SELECT query_id, sentence, max(overlap) AS overlap, min(rank * 1000000 + pos) AS place_at FROM o GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, length(sentence) DESC, place_at)::INT AS place, overlap::INT AS overlap, sentence FROM u QUALIFY place <= 4""")
def sentence_topk(spark: SparkSession, d: str) -> DataFrame:
    return answers.relevant_points(hits(spark, d))


@query(r"""WITH f AS (SELECT conv_id, turn, text, list_filter(list_transform(string_split_regex(text, '[.;]\s+|\n+'), lambda x: trim(x)), lambda x: x <> '') AS f FROM conversations)
SELECT conv_id, turn, array_to_string(CASE WHEN len(f) > 0 THEN f[1:5] ELSE [trim(text)] END, '|') AS facts FROM f""")
def fact_split(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.facts(F.col("text")), "|").alias("facts"))


@query(f"""WITH t AS (SELECT doc_id, text, {SQUEEZED.format('text')} AS p FROM documents)
SELECT doc_id, CASE WHEN length(p) <= 280 THEN p ELSE rtrim(substr(p, 1, 277)) || '...' END AS preview, trim(string_split(text, '.')[1]) AS first_sentence FROM t""")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.first_sentence(F.col("text")).alias("first_sentence"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


CITES = r"(regexp_matches(n, '§\s*[0-9]+[a-zA-Z]*') OR regexp_matches(n, '(^|[^\p{L}\p{N}_])(?:cl\.|čl\.|article|art\.)\s*[0-9]+'))"
CASES = r"regexp_matches(n, '(^|[^\p{L}\p{N}_])(?:sp\.\s*zn\.|č\.\s*j\.|case\s+no|[0-9]+\s*[a-z]{1,4}\s*[0-9]+/[0-9]{2,4}($|[^\p{L}\p{N}_]))')"


@query(f"""WITH c AS (SELECT conv_id, turn, text, {SQUEEZED.format('lower(text)')} AS n FROM conversations),
t AS (SELECT *, list_filter({word('strip_accents(n)')}, lambda x: length(x) > 2) AS terms FROM c),
k AS (SELECT *, CASE WHEN list_has_any(terms, {_list(understanding.STRATEGY_WORDS)}) THEN 'strategy' WHEN {CITES} THEN 'exact_statute'
                     WHEN {CASES} OR list_has_any(terms, {_list(understanding.COURT_WORDS)}) THEN 'case_lookup' ELSE 'semantic_law' END AS query_type,
      ({CITES} OR list_has_any(terms, {_list(understanding.LAW_WORDS)})) AS law, ({CASES} OR list_has_any(terms, {_list(understanding.COURT_WORDS)})) AS court FROM t)
SELECT conv_id, turn, sha256(n) AS query_hash, len(terms)::INT AS n_terms, query_type,
       CASE WHEN query_type = 'strategy' THEN NULL WHEN law AND NOT court THEN 'law' WHEN court AND NOT law THEN 'courts' WHEN query_type = 'case_lookup' THEN 'courts' ELSE 'law' END AS request_domain,
       CASE WHEN regexp_matches(text, '[\\x{{0400}}-\\x{{04ff}}]') THEN 'russia' ELSE 'czechia' END AS jurisdiction FROM k""")
def query_context(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"), F.lit(None).cast("string").alias("country"))
    return understanding.query_context(rows).select("conv_id", "turn", "query_hash", F.size("terms").alias("n_terms"), "query_type", "request_domain", "jurisdiction")


#: Requests that are a bare paragraph, or nearly so, made from part.
ASKED = """CASE p_partkey % 6 WHEN 0 THEN '§ ' || p_size WHEN 1 THEN '§' || p_size || 'a' WHEN 2 THEN ' § ' || p_size || ' ' WHEN 3 THEN '§ ' || p_size || ' ' || p_name WHEN 4 THEN '' || p_size ELSE p_name END"""


@query(f"""SELECT p_partkey, q, regexp_matches(trim(q), '^§\\s*[0-9]+[a-zA-Z]*$') AS bare FROM (SELECT p_partkey, {ASKED} AS q FROM part)""")
def bare_paragraph(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "part").select("p_partkey", F.expr(ASKED).alias("q"))
    return asked.select("p_partkey", "q", T.is_bare_paragraph(F.col("q")).alias("bare"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS filename FROM pages")
def filename_sanitise(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", T.safe_filename(F.col("url")).alias("filename"))
