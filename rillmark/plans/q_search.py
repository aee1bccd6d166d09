"""Registered queries over search: statistics, BM25, vectors, fusion, reranking, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import text as T
from rillmark.operators import answers, cells, dense, fusion, ingest, inverted, lexical, planning, ranking, understanding
from rillmark.operators.sides import few
from rillmark.operators.understanding import DOMAINS, EXPANSIONS, LAW_ALIASES, LAW_DOMAINS, PHRASES, STEMS
from rillmark.sources import work
from rillmark.sources.work import stored

from .q_text import SQUEEZED, heading_boost_sql, penalty_sql
from .tables import DIM, HITS, IDF, NORM_TF, STATS, bm25, corpus, dense_hits, dense_sql, embedding, hits, queries, read, word

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Statistics and BM25 -------------------------------------------------------


@query(f"""WITH {STATS}
SELECT token, ('0x' || substr(sha256(token), 1, 8))::BIGINT AS idx, df, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1.0), 6) AS idf FROM df CROSS JOIN st WHERE df >= 2""")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    return lexical.idf_table(corpus(spark, d)).withColumn("idf", F.round("idf", 6))


@query(f"""WITH {STATS}
SELECT tf.chunk_id, ('0x' || substr(sha256(tf.token), 1, 8))::BIGINT AS idx, round(sum({IDF} * {NORM_TF}), 6) AS weight
FROM tf JOIN df ON tf.token = df.token CROSS JOIN st GROUP BY 1, 2""")
def bm25_doc_weights(spark: SparkSession, d: str) -> DataFrame:
    return lexical.doc_weights(corpus(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {bm25(10)} SELECT query_id, chunk_id, score, rank::INT AS rank FROM hits")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(corpus(spark, d), queries(spark, d), 10)


@query(f"WITH {bm25(10, where=chr(100) + '.law_iri IN (' + ', '.join(repr(f'src{i}') for i in (0, 3, 5, 7)) + ')')} SELECT query_id, chunk_id, score, rank::INT AS rank FROM hits")
def bm25_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(corpus(spark, d), queries(spark, d), 10, F.col("law_iri").isin("src0", "src3", "src5", "src7"))


# Stored indexes ------------------------------------------------------------


@query(SQL["bm25_topk"])
def index_topk(spark: SparkSession, d: str) -> DataFrame:
    return inverted.search(inverted.build(corpus(spark, d), work.fresh(spark, "inverted"), ("law_iri",)), queries(spark, d), 10)


@query(SQL["bm25_topk_filtered"])
def index_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The filter acts on a column that the index keeps."""
    index = inverted.build(corpus(spark, d), work.fresh(spark, "inverted"), ("law_iri",))
    return inverted.search(index, queries(spark, d), 10, F.col("law_iri").isin("src0", "src3", "src5", "src7"))


# Vectors -------------------------------------------------------------------


@query(f"WITH {embedding('SELECT doc_id AS chunk_id, text FROM documents', 'e')} SELECT chunk_id, bucket, round(value, 6) AS value FROM e_parts WHERE round(value, 6) <> 0")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return dense.hash_embedding(corpus(spark, d), DIM).withColumn("value", F.round("value", 6)).filter("value != 0")


KNN = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM v q JOIN v c ON {0} WHERE q.vec_id % 100 = 0)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 10"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = read(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")


@query(KNN.format("true"))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense.nearest(*_vectors(spark, d), 10)


@query(KNN.format("q.label = c.label"))
def cosine_topk_by_label(spark: SparkSession, d: str) -> DataFrame:
    return dense.nearest(*_vectors(spark, d), 10, "label")


@query(SQL["cosine_topk"])
def cells_topk(spark: SparkSession, d: str) -> DataFrame:
    """The exact search of a cell index: cells that cannot hold a neighbour stay closed."""
    rows, asked = _vectors(spark, d)
    return cells.search(cells.build(rows, work.fresh(spark, "cells")), asked, 10, exact=True)


KEYWORDS = f"list_filter({{0}}, lambda x: NOT regexp_matches(x, '^(?:{'|'.join(understanding.STOP_STEMS)})') AND length(x) >= 3)"
FOLDED_TOKENS = "regexp_extract_all(strip_accents(lower({0})), '[a-z0-9]+')"


@query(f"""WITH {embedding("SELECT doc_id AS chunk_id, text FROM documents", "e")},{embedding("SELECT item_id AS chunk_id, text FROM benchmark", "f")},
k AS (SELECT item_id AS query_id, {KEYWORDS.format(FOLDED_TOKENS.format("text"))}[1] AS token FROM benchmark),
c AS (SELECT query_id, doc_id AS chunk_id FROM documents JOIN k ON list_contains({FOLDED_TOKENS.format("text")}, token)),
s AS (SELECT c.query_id, c.chunk_id, round(sum(e_parts.value * f_parts.value), 6) AS score FROM c JOIN e_parts ON e_parts.chunk_id = c.chunk_id JOIN f_parts ON f_parts.chunk_id = c.query_id AND f_parts.bucket = e_parts.bucket GROUP BY 1, 2)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s QUALIFY rank <= 10""")
def dense_keyword_filtered(spark: SparkSession, d: str) -> DataFrame:
    asked = queries(spark, d).withColumn("keywords", understanding.keywords(F.col("query")))
    return dense.nearest_with_keyword(corpus(spark, d), asked, 10, DIM)


# Fusion --------------------------------------------------------------------

RRF = """
rr AS (SELECT COALESCE(h.query_id, x.query_id) AS query_id, COALESCE(h.chunk_id, x.chunk_id) AS chunk_id, x.rank AS dense_rank, h.rank AS sparse_rank, x.score AS dense_score, h.score AS sparse_score,
       round(COALESCE(1.0::DOUBLE / (60 + x.rank), 0) + COALESCE(1.0::DOUBLE / (60 + h.rank), 0), 9) AS rrf_score
       FROM hits h FULL JOIN dhits x ON h.query_id = x.query_id AND h.chunk_id = x.chunk_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, chunk_id) AS rank FROM rr)"""


@query(f"WITH {bm25()},{dense_sql()},{RRF} SELECT query_id, chunk_id, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank, rrf_score, rank::INT AS rank FROM fused")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    sparse = lexical.search(corpus(spark, d), queries(spark, d), HITS)
    return fusion.rrf(dense_hits(spark, d), sparse).select("query_id", "chunk_id", "dense_rank", "sparse_rank", "rrf_score", "rank")


@query(f"""WITH {bm25()},{dense_sql()},
u AS (SELECT query_id, chunk_id, rank AS source_order, score AS dense_score, 0.0::DOUBLE AS sparse_score, rank <= 3 AS exact_match, '' AS note FROM dhits
      UNION ALL SELECT query_id, chunk_id, 1000 + rank, 0.0::DOUBLE, score, false, 'sparse ' || rank FROM hits)
SELECT query_id, chunk_id, max(dense_score) AS dense_score, max(sparse_score) AS sparse_score, bool_or(exact_match) AS exact_match,
       arg_min(note, source_order) FILTER (note <> '') AS note, min(source_order)::INT AS source_order FROM u GROUP BY 1, 2""")
def keyed_merge(spark: SparkSession, d: str) -> DataFrame:
    x = dense_hits(spark, d).select("query_id", "chunk_id", F.col("rank").alias("source_order"), F.col("score").alias("dense_score"), F.lit(0.0).alias("sparse_score"), (F.col("rank") <= 3).alias("exact_match"), F.lit("").alias("note"))
    s = lexical.search(corpus(spark, d), queries(spark, d), HITS).select("query_id", "chunk_id", (F.col("rank") + 1000).alias("source_order"), F.lit(0.0).alias("dense_score"), F.col("score").alias("sparse_score"), F.lit(False).alias("exact_match"), F.concat(F.lit("sparse "), F.col("rank")).alias("note"))
    return fusion.keyed_merge(x.unionByName(s), ("note",))


TERMS = f"list_filter({word('strip_accents(lower({0}))')}, lambda x: length(x) > 2)"


def lexical_sql(source: str, columns: str) -> str:
    """CTE lx over rows of ``source`` (query_id, chunk_id, score, rank)."""
    whole = "strip_accents(lower(d.filename || chr(10) || d.law_iri || chr(10) || d.text))"
    terms = TERMS.replace("{0}", "b.text")
    return f"""
lt AS (SELECT h.{columns.replace(", ", ", h.")}, {terms} AS terms, {whole} AS t, strip_accents(lower(d.filename)) AS fn, strip_accents(lower(d.law_iri)) AS sn
       FROM {source} h JOIN d USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id),
lf AS (SELECT *, list_distinct(terms) AS ts, len(list_intersect(list_distinct(terms), list_distinct(list_filter({word('t')}, lambda x: length(x) > 2)))) AS overlap_count,
       contains(t, array_to_string(terms, ' ')) AS phrase_match, len(list_filter(terms, lambda x: contains(fn, x))) > 0 AS filename_match, len(list_filter(terms, lambda x: contains(sn, x))) > 0 AS source_match FROM lt),
lx AS (SELECT *, overlap_count / len(ts)::DOUBLE AS overlap_ratio,
       round(overlap_count / len(ts)::DOUBLE * 0.6::DOUBLE + CASE WHEN phrase_match THEN 0.2::DOUBLE ELSE 0 END + 0::DOUBLE + CASE WHEN filename_match THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN source_match THEN 0.05::DOUBLE ELSE 0 END, 9) AS lexical_score FROM lf)"""


@query(f"""WITH {bm25()},{lexical_sql("hits", "query_id, chunk_id, score, rank")}
SELECT query_id, chunk_id, overlap_count::INT AS overlap_count, round(overlap_ratio, 6) AS overlap_ratio, phrase_match, filename_match, source_match, lexical_score FROM lx""")
def lexical_features(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.lexical_features(hits(spark, d).withColumn("source", F.col("law_iri")))
    return rows.select("query_id", "chunk_id", "overlap_count", F.round("overlap_ratio", 6).alias("overlap_ratio"), "phrase_match", "filename_match", "source_match", "lexical_score")


FUSED = f"""{lexical_sql("dhits", "query_id, chunk_id, score, rank")},
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, round(score + lexical_score, 9) DESC, rank) AS lexical_rank FROM lx),
gf AS (SELECT *, round(score * 0.45::DOUBLE + lexical_score * 0.3::DOUBLE + 12.0::DOUBLE / (60 + rank) + 9.0::DOUBLE / (60 + lexical_rank) + CASE WHEN phrase_match THEN 0.08::DOUBLE ELSE 0 END, 6) AS fused_score FROM lr),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, rank) AS final FROM gf)"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d).withColumn("source", F.col("law_iri"))
    rows = few(stored(dense_hits(spark, d, 25), "hits")).join(c, "chunk_id").join(queries(spark, d).drop("text"), "query_id")
    return fusion.generic_fused(rows)


@query(f"WITH {STATS},{dense_sql(25)},{FUSED} SELECT query_id, chunk_id, rank::INT AS dense_rank, lexical_rank::INT AS lexical_rank, fused_score, final::INT AS rank FROM gr")
def generic_fused_score(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "chunk_id", "dense_rank", "lexical_rank", "fused_score", "rank")


@query(f"""WITH {STATS},{dense_sql(25)},{FUSED}
SELECT query_id, arg_min(score, rank) AS top_dense_score, max(fused_score) FILTER (final <= 5) AS top_fused_score,
       round(greatest(max(fused_score) FILTER (final <= 5) - COALESCE(max(fused_score) FILTER (final = 2), 0), 0), 6) AS score_gap,
       round(arg_min(overlap_ratio, final), 6) AS keyword_coverage, count(*) FILTER (final <= 5 AND (overlap_ratio >= 0.45 OR phrase_match)) AS supporting_chunks FROM gr GROUP BY query_id""")
def retrieval_features(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.features(_fused(spark, d), 5)
    return rows.select("query_id", "top_dense_score", "top_fused_score", "score_gap", F.round("keyword_coverage", 6).alias("keyword_coverage"), "supporting_chunks")


# Understanding and plans ---------------------------------------------------

#: Czech requests of every kind, asked beside the benchmark items.
ASKED = (
    "§ 52 zákoník práce",
    "výpověď z pracovního poměru podle zákona č. 262/2006 Sb.",
    "jaká je výpovědní doba zaměstnance",
    "kupní smlouva občanský zákoník",
    "trestný čin podvod trestní odpovědnost",
    "daň z příjmů fyzických osob",
    "správní řízení úřad",
    "ústava České republiky základní práva",
    "společnost s ručením omezeným jednatel",
    "§ 89 a § 90a zákona 89 / 2012 Sb.",
    "počasí zítra v Brně",
    "náhrada škody nájem bytu dědictví",
    "podmíněný trest zkušební doba",
    "",
)


def asked(spark: SparkSession, d: str) -> DataFrame:
    """All benchmark items and, with negative ids, the requests of ASKED."""
    rows = ", ".join(f"({-1 - i}, '{q}')" for i, q in enumerate(ASKED))
    return queries(spark, d).select(F.col("query_id").cast("long").alias("query_id"), "query").unionAll(spark.sql(f"SELECT CAST(query_id AS BIGINT) query_id, query FROM VALUES {rows} t(query_id, query)"))


def planned(spark: SparkSession, d: str) -> DataFrame:
    """Their plans.  The columns are long expressions that several stages read: stored."""
    return stored(planning.build(understanding.understand(asked(spark, d))), "planned")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows)


UNDERSTOOD = rf"""
q(query_id, query) AS (SELECT item_id, text FROM benchmark UNION ALL VALUES {_values((-1 - i, x) for i, x in enumerate(ASKED))}),
f AS (SELECT *, {SQUEEZED.format("strip_accents(lower(query))")} AS folded FROM q),
al(alias, iri, i) AS (VALUES {_values((name, f"local:sb/{y}/{n}", i) for i, (name, n, y) in enumerate(LAW_ALIASES))}),
cited AS (SELECT query_id, unnest(range(1, len(regexp_extract_all(query, '([0-9]{{1,4}})\s*/\s*([0-9]{{4}})')) + 1)) AS i, regexp_extract_all(query, '([0-9]{{1,4}})\s*/\s*([0-9]{{4}})', 1) AS n, regexp_extract_all(query, '([0-9]{{1,4}})\s*/\s*([0-9]{{4}})', 2) AS y FROM f),
refs AS (SELECT query_id, 'local:sb/' || y[i] || '/' || n[i] AS iri, i FROM cited UNION ALL SELECT query_id, iri, 100 + al.i FROM f JOIN al ON contains(folded, alias)),
laws AS (SELECT query_id, iri, min(i) AS i FROM refs GROUP BY 1, 2),
law_list AS (SELECT query_id, list(iri ORDER BY i) AS laws FROM laws GROUP BY 1),
clean AS (SELECT query_id, {SQUEEZED.format(r"regexp_replace(regexp_replace(query, '(?i)(?:z[aá]kon(?:a|u|em|ě)?(?:\s+č\.?)?\s+)?([0-9]{1,4})\s*/\s*([0-9]{4})(?:\s+Sb\.?)?', ' ', 'g'), '§+\s*[0-9]+[a-zA-Z]?', ' ', 'g')")} AS c FROM f),
cl AS (SELECT query_id, CASE WHEN c <> '' THEN c ELSE {SQUEEZED.format("query")} END AS clean FROM clean JOIN f USING (query_id)),
kw AS (SELECT query_id, clean, {KEYWORDS.format(FOLDED_TOKENS.format("clean"))} AS ks FROM cl),
kx AS (SELECT query_id, k, min(i) AS i FROM (SELECT query_id, unnest(ks) AS k, unnest(range(len(ks))) AS i FROM kw) GROUP BY 1, 2),
dm(domain, di) AS (VALUES {_values((x, i) for i, x in enumerate(DOMAINS))}),
ph(domain, phrase, w) AS (VALUES {_values((x, p, w) for x in DOMAINS for p, w in PHRASES[x].items())}),
sm(domain, stem, w, si) AS (VALUES {_values((x, s, w, i) for x in DOMAINS for i, (s, w) in enumerate(STEMS[x].items()))}),
ld(iri, domain) AS (VALUES {_values(LAW_DOMAINS.items())}),
points AS (SELECT query_id, domain, w FROM f JOIN ph ON contains(folded, phrase)
  UNION ALL SELECT query_id, domain, arg_min(w, si) FROM kx JOIN sm ON starts_with(k, stem) OR starts_with(stem, k) GROUP BY query_id, domain, k
  UNION ALL SELECT query_id, domain, 5.0 FROM laws JOIN ld USING (iri)),
sums AS (SELECT q.query_id, dm.domain, di, COALESCE(sum(w), 0)::DOUBLE AS s FROM q CROSS JOIN dm LEFT JOIN points p ON p.query_id = q.query_id AND p.domain = dm.domain GROUP BY 1, 2, 3),
best AS (SELECT query_id, list(domain ORDER BY s DESC, di)[1] AS d1, list(s ORDER BY s DESC, di) AS ss FROM sums GROUP BY 1),
ex(trigger, words, xi) AS (VALUES {_values((t, w, i) for i, (t, w) in enumerate(EXPANSIONS))}),
exp AS (SELECT query_id, arg_min(words, -length(trigger) * 1000 + xi) AS words FROM f JOIN ex ON contains(folded, trigger) GROUP BY 1),
u AS (SELECT f.query_id, f.query, COALESCE(laws, []::VARCHAR[]) AS laws, list_distinct(regexp_extract_all(query, '§+\s*([0-9]+[a-zA-Z]?)', 1)) AS paragraphs, clean,
  CASE WHEN ss[1] >= 2.5 THEN d1 ELSE 'unknown' END AS domain, CASE WHEN ss[1] >= 2.5 THEN ss[1] / greatest(ss[1] + ss[2], 1.0) ELSE 0 END AS conf, clean || ' ' || words AS expanded,
  (SELECT string_agg(k, ',' ORDER BY i) FROM kx WHERE kx.query_id = f.query_id) AS keywords
  FROM f LEFT JOIN law_list USING (query_id) JOIN cl USING (query_id) JOIN best USING (query_id) LEFT JOIN exp USING (query_id)),
m AS (SELECT *, CASE WHEN len(laws) > 0 AND len(paragraphs) > 0 THEN 'exact_lookup' WHEN len(laws) > 0 THEN 'law_constrained_search' WHEN domain <> 'unknown' THEN 'domain_search' ELSE 'broad_search' END AS mode FROM u)"""


@query(f"WITH {UNDERSTOOD} SELECT query_id, domain, round(conf, 6) AS domain_confidence, COALESCE(keywords, '') AS keywords FROM m")
def domain_scores(spark: SparkSession, d: str) -> DataFrame:
    return understanding.understand(asked(spark, d)).select("query_id", "domain", F.round("domain_confidence", 6).alias("domain_confidence"), F.array_join("keywords", ",").alias("keywords"))


@query(f"WITH {UNDERSTOOD} SELECT query_id, array_to_string(laws, ',') AS laws, mode FROM m")
def query_mode(spark: SparkSession, d: str) -> DataFrame:
    return understanding.understand(asked(spark, d)).select("query_id", F.array_join("laws", ",").alias("laws"), "mode")


@query(f"WITH {UNDERSTOOD} SELECT query_id, clean, expanded FROM m")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    return understanding.understand(asked(spark, d)).select("query_id", "clean", "expanded")


PREFER = "CASE domain " + " ".join(f"WHEN '{x}' THEN {list(laws)}" for x, laws in planning.PREFERRED.items()) + " ELSE []::VARCHAR[] END"
PLANNED = f"""{UNDERSTOOD},
pv(plan, {", ".join(planning.FIELDS[:-1])}, reach) AS (VALUES {_values((k, *v) for k, v in planning.PLANS.items())}),
n AS (SELECT *, CASE WHEN mode = 'exact_lookup' THEN 'exact' WHEN mode = 'law_constrained_search' AND len(paragraphs) = 0 THEN 'topic' WHEN mode = 'law_constrained_search' THEN 'law'
        WHEN mode = 'domain_search' AND conf >= 0.9 THEN 'domain_sure' WHEN mode = 'domain_search' THEN 'domain' ELSE 'broad' END AS plan, CASE WHEN len(laws) > 0 THEN laws ELSE {PREFER} END AS preferred_laws,
        CASE WHEN keywords IS NULL THEN []::VARCHAR[] ELSE string_split(keywords, ',') END AS words FROM m),
pl AS (SELECT *, CASE WHEN plan IN ('exact', 'topic', 'law') THEN laws WHEN plan = 'domain_sure' THEN preferred_laws ELSE []::VARCHAR[] END AS law_filter FROM n JOIN pv USING (plan))"""


@query(f"""WITH {PLANNED}
SELECT query_id, plan, array_to_string(law_filter, ',') AS law_filter, array_to_string(preferred_laws, ',') AS preferred_laws,
       least(100, greatest(50, baseline, 50))::INT AS candidate_k, law_boost::DOUBLE AS law_boost, overlap_weight::DOUBLE AS overlap_weight, mismatch::DOUBLE AS mismatch, plan_mode, reach::INT AS "window" FROM pl""")
def plan_columns(spark: SparkSession, d: str) -> DataFrame:
    p = planned(spark, d)
    return p.select("query_id", "plan", F.array_join("law_filter", ",").alias("law_filter"), F.array_join("preferred_laws", ",").alias("preferred_laws"), "candidate_k", "law_boost", "overlap_weight", "mismatch", "plan_mode", "window")


# Reranking and gates -------------------------------------------------------


#: The documents as chunks of these laws, with paragraphs and flags by id.
LAWS = tuple(LAW_DOMAINS)
FLAG_EVERY = {"exact_match": 7, "structural_neighbor": 5, "neighbor_of_exact_match": 35}


def candidates(spark: SparkSession, d: str, p: DataFrame) -> DataFrame:
    """Fused BM25 and vector hits of the planned queries with the chunk's columns."""
    n = F.col("chunk_id")
    c = corpus(spark, d).withColumns({"law_iri": F.get(F.array(*[F.lit(x) for x in LAWS]), (n % len(LAWS)).cast("int")), "paragraph": (n % 100).cast("string")} | {f: n % every == 0 for f, every in FLAG_EVERY.items()})
    texts = p.select("query_id", F.col("query").alias("text"))
    sparse = lexical.search(c, texts, HITS)
    return few(stored(fusion.rrf(dense_hits(spark, d, asked=texts), sparse), "fused")).join(c, "chunk_id").drop("rank")


FINAL = """round(rrf_score / max(rrf_score) OVER q * 0.34::DOUBLE + CASE WHEN max(ds) OVER q > 0 THEN ds / max(ds) OVER q ELSE 0 END * 0.22::DOUBLE + CASE WHEN max(ss) OVER q > 0 THEN ss / max(ss) OVER q ELSE 0 END * 0.22::DOUBLE
           + text_overlap * overlap_weight::DOUBLE + CASE WHEN strict THEN law_boost::DOUBLE ELSE 0 END + CASE WHEN preferred THEN preferred_boost::DOUBLE ELSE 0 END + CASE WHEN paragraph_match THEN paragraph_boost::DOUBLE ELSE 0 END
           + CASE WHEN exact_match THEN exact_boost::DOUBLE ELSE 0 END + CASE WHEN structural_neighbor THEN neighbor_boost::DOUBLE ELSE 0 END + heading - (line_penalty + law_penalty), 6)"""
RERANK = f"""{PLANNED},{bm25(queries_sql="SELECT query_id, query AS text FROM q")},{dense_sql(queries_sql="SELECT query_id AS chunk_id, query AS text FROM q")},{RRF},
c1 AS (SELECT f.*, d.text, trim(d.text) AS v, p.* EXCLUDE (query_id, query), {list(LAWS)}[chunk_id % {len(LAWS)} + 1] AS iri, (chunk_id % 100)::VARCHAR AS paragraph, {", ".join(f"chunk_id % {every} = 0 AS {f}" for f, every in FLAG_EVERY.items())}
       FROM fused f JOIN d USING (chunk_id) JOIN pl p ON p.query_id = f.query_id),
c2 AS (SELECT *, COALESCE(dense_score, 0) AS ds, COALESCE(sparse_score, 0) AS ss, list_distinct({FOLDED_TOKENS.format("text")}) AS toks,
         list_contains(law_filter, iri) AS strict, list_contains(preferred_laws, iri) AS preferred, list_contains(paragraphs, paragraph) AS paragraph_match, {penalty_sql()} AS line_penalty, {heading_boost_sql("mode <> 'exact_lookup' AND (list_contains(law_filter, iri) OR list_contains(preferred_laws, iri))", "words")} AS heading FROM c1),
cand AS (SELECT *, CASE WHEN len(words) > 0 THEN len(list_intersect(words, toks)) / len(words)::DOUBLE ELSE 0 END AS text_overlap,
         CASE WHEN len(law_filter) > 0 AND NOT strict THEN mismatch::DOUBLE WHEN domain <> 'unknown' AND len(preferred_laws) > 0 AND NOT preferred THEN mismatch::DOUBLE * 0.35::DOUBLE ELSE 0 END AS law_penalty FROM c2),
scored AS (SELECT *, {FINAL} AS final_score FROM cand WINDOW q AS (PARTITION BY query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, exact_match DESC, paragraph_match DESC, strict DESC, preferred DESC, chunk_id) AS final_rank FROM scored),
valid AS (SELECT *, max(final_score) OVER (PARTITION BY query_id) AS top_score FROM ranked
          QUALIFY NOT (plan_mode = 'constrained' AND len(law_filter) > 0 AND NOT strict) AND NOT (plan_mode = 'exact' AND len(paragraphs) > 0 AND NOT (paragraph_match OR neighbor_of_exact_match OR exact_match))
          AND NOT (final_score < greatest(0.12, top_score * 0.30) AND NOT (exact_match OR paragraph_match OR strict OR preferred)) AND NOT (final_score < greatest(0.08, top_score * 0.18) AND NOT exact_match AND text_overlap < 0.05))"""


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    p = planned(spark, d)
    return ranking.rerank(candidates(spark, d, p), p).join(p.select("query_id", "laws", "paragraphs"), "query_id")


@query(f"WITH {RERANK} SELECT query_id, chunk_id, final_score AS score, final_rank::INT AS rank FROM ranked")
def rerank_formula(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {RERANK} SELECT query_id, chunk_id, final_score AS score FROM valid")
def validate_floors(spark: SparkSession, d: str) -> DataFrame:
    return ranking.validate(_reranked(spark, d)).select("query_id", "chunk_id", "score")


@query(f"""WITH {RERANK},
o AS (SELECT *, list_filter(words, lambda x: length(x) >= 4 AND x NOT IN ('text', 'data', 'cast', 'nebo', 'jako')) AS w FROM ranked),
g AS (SELECT query_id, max(CASE WHEN len(w) > 0 THEN len(list_intersect(w, toks)) / len(w)::DOUBLE ELSE 0 END) AS most, max(len(w)) AS n_words FROM o GROUP BY query_id)
SELECT query_id, round(most, 6) AS max_overlap, n_words > 0 AND ((plan_mode = 'broad' AND domain = 'unknown' AND len(laws) = 0 AND len(paragraphs) = 0 AND most < 0.5)
       OR (plan_mode = 'constrained' AND len(law_filter) = 0 AND domain <> 'unknown' AND len(paragraphs) = 0 AND most < 0.3)) AS fired FROM g JOIN pl USING (query_id)""")
def overlap_gate(spark: SparkSession, d: str) -> DataFrame:
    return ranking.overlap_gate(_reranked(spark, d))


@query(f"""WITH {bm25()}
SELECT h.query_id, bool_or(len(list_filter(string_split(trim(b.text), ' '), lambda w: length(w) > 3 AND contains(lower(d.text), w))) > 0) AS relevant FROM hits h JOIN d USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id GROUP BY 1""")
def any_relevant(spark: SparkSession, d: str) -> DataFrame:
    return ranking.any_relevant(hits(spark, d), F.col("query"), F.lit(False))


@query(f"""WITH {bm25()},
t AS (SELECT h.*, d.text, list_filter({word('lower(trim(b.text))')}, lambda x: length(x) > 3) AS terms FROM hits h JOIN d USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id),
s AS (SELECT *, round(score + 0.4::DOUBLE * len(list_filter(terms, lambda x: contains(lower(text), x))) + CASE WHEN len(terms) > 0 AND contains(lower(text), array_to_string(terms, ' ')) THEN 0.8::DOUBLE ELSE 0 END, 6) AS boosted FROM t)
SELECT query_id, chunk_id, boosted AS score, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank)::INT AS rank FROM s""")
def keyword_boost(spark: SparkSession, d: str) -> DataFrame:
    return ranking.keyword_boost(hits(spark, d), F.col("query")).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {bm25()},
t AS (SELECT h.*, trim(d.text) AS v, list_distinct({FOLDED_TOKENS.format("b.text")}) AS asked, {FOLDED_TOKENS.format("substr(d.text, 1, 768)")} AS said, count(*) OVER (PARTITION BY query_id) AS n
      FROM hits h JOIN d USING (chunk_id) JOIN benchmark b ON b.item_id = h.query_id),
s AS (SELECT *, CASE WHEN rank <= 10 AND n > 1 THEN {penalty_sql(T.VERBS_CROSS, "0.40", "0.90", False)} - CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, said)) / len(asked)::DOUBLE ELSE 0 END END AS adjusted FROM t)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank <= 10 DESC, adjusted ASC NULLS FIRST, rank)::INT AS rank FROM s""")
def crossencoder_partial(spark: SparkSession, d: str) -> DataFrame:
    return ranking.cross_encoder_order(hits(spark, d), ranking.lexical_stand_in(F.col("query"), F.col("text"))).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {bm25()},
g AS (SELECT h.*, d.law_iri, row_number() OVER (PARTITION BY query_id, law_iri ORDER BY rank) > 2 AS over FROM hits h JOIN d USING (chunk_id)),
s AS (SELECT *, COALESCE(sum((NOT over)::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM g QUALIFY seen < 10)
SELECT query_id, chunk_id, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY over, rank)::INT AS place FROM s) WHERE place <= 10""".replace(" AS over ", " AS is_over ").replace("(NOT over)", "(NOT is_over)").replace("BY over,", "BY is_over,"))
def diversify_cap2(spark: SparkSession, d: str) -> DataFrame:
    return ranking.diversify(hits(spark, d), 10, F.col("law_iri")).select("query_id", "chunk_id", "rank")


@query(f"""WITH {bm25()},
t AS (SELECT h.*, CASE WHEN chunk_id % 5 = 0 THEN '' ELSE d.law_iri END AS text FROM hits h JOIN d USING (chunk_id))
SELECT query_id, chunk_id, text, rank::INT AS rank FROM t QUALIFY text = '' OR row_number() OVER (PARTITION BY query_id, text ORDER BY rank) = 1""")
def dedup_result_text(spark: SparkSession, d: str) -> DataFrame:
    rows = hits(spark, d).withColumn("text", F.when(F.col("chunk_id") % 5 == 0, "").otherwise(F.col("law_iri")))
    return ingest.first_result_text(rows).select("query_id", "chunk_id", "text", "rank")


@query(f"""WITH {bm25()},
u AS (SELECT query_id, chunk_id, score FROM hits UNION ALL SELECT query_id, chunk_id, round(score / 2 + rank % 3, 6) FROM hits)
SELECT query_id, chunk_id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, chunk_id)::INT AS rank FROM u GROUP BY 1, 2""")
def dedup_by_chunk(spark: SparkSession, d: str) -> DataFrame:
    rows = hits(spark, d).select("query_id", "chunk_id", "score", "rank", "chunk_index")
    return ranking.best_per_chunk(rows.unionByName(rows.withColumn("score", F.round(F.col("score") / 2 + F.col("rank") % 3, 6)))).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {bm25()}, t AS (SELECT *, CASE WHEN rank % 7 = 0 THEN ['no_result'] WHEN rank % 5 = 0 THEN ['other'] END AS tags FROM hits)
SELECT query_id, chunk_id, score FROM t WHERE score >= 30 OR COALESCE(list_has_any(tags, ['irrelevant_query', 'no_result', 'clarification']), false)""")
def score_filter_system_tags(spark: SparkSession, d: str) -> DataFrame:
    tags = F.when(F.col("rank") % 7 == 0, F.array(F.lit("no_result"))).when(F.col("rank") % 5 == 0, F.array(F.lit("other")))
    return ranking.score_filter(hits(spark, d).withColumn("tags", tags), 30.0).select("query_id", "chunk_id", "score")


@query(f"""WITH {bm25()} SELECT query_id, chunk_id, round(score - 30, 6) AS score FROM hits WHERE round(score - 30, 6) > 0 OR rank % 7 = 0""")
def score_filter_positive(spark: SparkSession, d: str) -> DataFrame:
    tags = F.when(F.col("rank") % 7 == 0, F.array(F.lit("clarification")))
    return ranking.score_filter(hits(spark, d).withColumns({"score": F.round(F.col("score") - 30, 6), "tags": tags}), 0.0, above=True).select("query_id", "chunk_id", "score")


@query(f"""WITH {bm25()}, r AS (SELECT h.*, d.text, d.law_iri, d.filename FROM hits h JOIN d USING (chunk_id)),
s AS (SELECT query_id, {SQUEEZED.format("arg_min(text, rank)")} AS p, string_agg(chunk_id::VARCHAR, ',' ORDER BY rank) AS chunk_ids FROM r GROUP BY 1),
o AS (SELECT query_id, law_iri, min(rank) AS rank FROM r GROUP BY 1, 2), l AS (SELECT query_id, string_agg(law_iri, ',' ORDER BY rank) AS document_ids FROM o GROUP BY 1)
SELECT query_id, CASE WHEN length(p) <= 280 THEN p ELSE rtrim(substr(p, 1, 277)) || '...' END AS answer, document_ids, chunk_ids, f.filename || ',' || document_ids AS citations
FROM s JOIN l USING (query_id) JOIN (SELECT query_id, filename FROM r WHERE rank = 1) f USING (query_id)""")
def answer_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.payload(hits(spark, d).withColumns({"document_id": F.col("law_iri"), "source": F.col("law_iri")}))
    return rows.select("query_id", "answer", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("document_ids", "chunk_ids", "citations")])
