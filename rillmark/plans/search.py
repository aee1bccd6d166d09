"""Composite plans: ingestion, hybrid search, answers.  A batch of requests is one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions import text as T
from rillmark.operators import answers, cache, counts, dense, fusion, ingest, inverted, lexical, merging, planning, ranking, understanding
from rillmark.operators.sides import few
from rillmark.sources import statutes
from rillmark.sources.work import stored


def ingest_fragments(fragments: DataFrame) -> DataFrame:
    """Filter, first text of each law, chunks with ids.  ``fragments`` has fragment_id,
    law_iri, text, pos."""
    return ingest.chunks(ingest.first_text_per(ingest.ingestible(fragments), "law_iri", "pos"))


def ingest_into(table: merging.Table, fragments: DataFrame, dimension: int = dense.DIMENSION, source: str | None = None, number: int = 0) -> merging.Merged:
    """Fragments to the end in one plan: filtered, chunked, embedded and merged by chunk_id.
    A fragment that comes again with another text replaces its chunks of the same ids."""
    chunks = stored(ingest_fragments(fragments), "ingested")
    rows = chunks.join(dense.dense_vectors(chunks, dimension), "chunk_id")
    return merging.merge(table, rows.select(*table.read().columns), source=source, number=number)


def ingest_archives(table: merging.Table, held: counts.Counts, files: DataFrame, dimension: int = dense.DIMENSION, source: str | None = None, number: int = 0) -> tuple[merging.Merged, DataFrame]:
    """ZIP files of laws (path, content) in two passes.  The first unpacks, filters, chunks
    and merges them, embedded, into the table and advances its counts.  The second weighs
    the table's chunks under these counts.  What was merged, and the sparse vectors
    (chunk_id, idx, weight) of all chunks: a law that comes again changes its own chunks and
    the weights of others."""
    fragments = statutes.archive_fragments(statutes.archive_laws(statutes.unpacked(files)))
    done = ingest_into(table, fragments, dimension, source, number)
    counts.advance(held, table)
    return done, held.sparse(table.read())


#: Of a leg within preferred laws, the least candidates.
LEAST_PREFERRED = 12


@dataclass
class Searchable:
    """What a batch of requests searches, read once: matching postings, made for the batch
    or those of a stored index that keeps law_iri; vectors, columns."""

    corpus: DataFrame
    matches: lexical.Matches | inverted.Index
    vectors: DataFrame

    def sparse(self, asking: DataFrame, within: tuple[str, str]) -> DataFrame:
        if isinstance(self.matches, inverted.Index):
            return inverted.search(self.matches, asking, "k", within=within)
        return lexical.ranked(self.matches, asking, "k", within)


def searchable(corpus: DataFrame, planned: DataFrame, dimension: int, index: inverted.Index | None = None) -> Searchable:
    vectors = dense.dense_vectors(corpus, dimension, ("law_iri",))
    return Searchable(corpus, index or lexical.matches(corpus, _sparse_text(planned), keep=("law_iri",)), stored(vectors, "vectors"))


def _sparse_text(planned: DataFrame) -> DataFrame:
    return planned.select("query_id", F.coalesce("expanded", "clean").alias("text"))


def legs(planned: DataFrame) -> DataFrame:
    """One search within the law filter (everywhere, if there is none) and, without a filter,
    a smaller one within the preferred laws: leg_id, laws, k, the texts.  Both are ranked by
    themselves, so a law's best chunks need not be among the best of the corpus."""
    wide = F.struct(F.lit(0).cast("long").alias("leg"), F.col("law_filter").alias("laws"), F.col("candidate_k").alias("k"))
    near = F.struct(F.lit(1).cast("long").alias("leg"), F.col("preferred_laws").alias("laws"), F.greatest(F.lit(LEAST_PREFERRED), F.expr("candidate_k div 2").cast("int")).alias("k"))
    both = F.when((F.size("law_filter") == 0) & (F.size("preferred_laws") > 0), F.array(wide, near)).otherwise(F.array(wide))
    rows = planned.select("query_id", F.coalesce("expanded", "clean").alias("text"), "clean", F.explode(both).alias("x"))
    return rows.select((F.col("query_id").cast("long") * 2 + F.col("x.leg")).alias("query_id"), "text", "clean", F.col("x.laws").alias("laws"), F.col("x.k").alias("k"))


def _one_of_legs(hits: DataFrame) -> DataFrame:
    """The hits of both legs as one ranking, each chunk once with its best score."""
    rows = hits.select(F.shiftright("query_id", 1).alias("query_id"), "chunk_id", "score").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return rows.withColumn("rank", F.row_number().over(ranking.per_query().orderBy(F.desc("score"), "chunk_id")))


def retrieve(found: Searchable, planned: DataFrame, dimension: int) -> DataFrame:
    """Reranked candidates of planned queries: BM25 over the expanded text and vectors over
    the cleaned one, within each plan's laws, fused, with the corpus columns."""
    corpus, asking = found.corpus, legs(planned)
    within = ("laws", "law_iri")
    sparse = _one_of_legs(found.sparse(asking.select("query_id", "text", "laws", "k"), within))
    vectors = dense.dense_vectors(asking.select(F.col("query_id").alias("chunk_id"), F.col("clean").alias("text")), dimension).withColumnRenamed("chunk_id", "query_id")
    near = _one_of_legs(dense.nearest(found.vectors, asking.select("query_id", "laws", "k").join(vectors, "query_id"), "k", within=within))
    fused = few(stored(fusion.rrf(near, sparse).drop("rank"), "fused")).join(corpus, "chunk_id")
    if "paragraph" not in corpus.columns:
        fused = fused.withColumn("paragraph", F.lit(None).cast("string"))
    fused = fused.withColumns({f: F.lit(False) for f in fusion.FLAGS})
    if "fragment_id" in corpus.columns:
        fused = _with_structure(fused, corpus, planned, near, sparse)
    return ranking.rerank(fused, planned)


def _with_structure(fused: DataFrame, corpus: DataFrame, planned: DataFrame, near: DataFrame, sparse: DataFrame) -> DataFrame:
    """Adds exact lookups of the paragraphs asked for and neighbours of the best hits."""
    wanted = planned.select("query_id", F.explode_outer(F.when(F.size("law_filter") > 0, F.col("law_filter")).when(F.size("preferred_laws") > 0, F.col("preferred_laws"))).alias("law_iri"), "paragraph_filter")
    wanted = wanted.select("query_id", "law_iri", F.explode("paragraph_filter").alias("paragraph"))
    exact = ranking.exact_lookup(wanted, corpus.select("chunk_id", "fragment_id", "law_iri", "paragraph", "text", "chunk_index"))
    at = corpus.select("chunk_id", "fragment_id", "chunk_index")
    bounds = planned.select("query_id", F.col("window").alias("reach"), F.greatest(F.lit(10), F.least(F.lit(30), F.expr("candidate_k div 3"))).alias("most"))
    around = ranking.neighbors(ranking.anchors(exact, near, sparse).join(at, "chunk_id").join(bounds, "query_id"), at, F.col("reach"), F.col("most"))
    sides = (
        exact.select("query_id", "chunk_id", F.lit(True).alias("exact_match"), F.lit(False).alias("structural_neighbor"), F.lit(False).alias("neighbor_of_exact_match")),
        around.join(exact.select("query_id", F.col("chunk_id").alias("anchor_id"), F.lit(True).alias("_of")).distinct(), ["query_id", "anchor_id"], "left").select(
            "query_id", "chunk_id", F.lit(False).alias("exact_match"), F.lit(True).alias("structural_neighbor"), F.coalesce("_of", F.lit(False)).alias("neighbor_of_exact_match")
        ),
    )
    scores = ["dense_rank", "sparse_rank", "dense_score", "sparse_score", "rrf_score"]
    rows = fused.select("query_id", "chunk_id", *fusion.FLAGS, *scores)
    for s in sides:
        rows = rows.unionByName(s.withColumns({c: F.lit(None).cast(dict(fused.dtypes)[c]) for c in scores}))
    merged = rows.groupBy("query_id", "chunk_id").agg(*[F.bool_or(f).alias(f) for f in fusion.FLAGS], *[F.max(c).alias(c) for c in scores])
    return merged.join(corpus, "chunk_id")


def hybrid(corpus: DataFrame, requests: DataFrame, top_k: int = 5, dimension: int = dense.DIMENSION, index: inverted.Index | None = None) -> DataFrame:
    """query_id, rank, chunk_id, law_iri, filename, text, score for every request, and
    system rows for those without a relevant result.

    ``corpus`` has chunk_id, law_iri, filename, text, chunk_index, and may have fragment_id
    and paragraph; ``requests`` query_id, a whole number below 2^62, and query.  With an
    ``index`` of the corpus that keeps law_iri, BM25 reads its postings and no text."""
    bare = requests.filter(T.is_bare_paragraph(F.col("query")))
    clear = requests.filter((F.trim("query") != "") & ~T.is_bare_paragraph(F.col("query")))
    planned = planning.build(understanding.understand(clear).withColumn("top_k", F.lit(top_k)))
    # the plan's columns are long expressions and each stage reads them: stored once
    planned = stored(planned, "planned")
    found = searchable(corpus, planned, dimension, index)
    valid = stored(ranking.validate(retrieve(found, planned, dimension)), "valid")
    again = ranking.should_broaden(valid, planned, top_k).select("query_id")
    wider = stored(planning.broaden(planned.join(again, "query_id", "left_semi")), "wider")
    items = valid
    if not wider.isEmpty():
        items = valid.join(wider, "query_id", "left_anti").unionByName(ranking.validate(retrieve(found, wider, dimension)))
    asked = requests.select("query_id", F.col("query").alias("_asked"))
    items = ranking.cross_encoder_order(items.join(asked, "query_id"), F.when(F.col("plan_mode") != "exact", ranking.lexical_stand_in(F.col("_asked"), F.col("text"))))
    items = ranking.diversify(items, top_k * 3, F.struct("law_iri", F.coalesce(F.nullif("paragraph", F.lit("")), F.col("chunk_id").cast("string"))))
    items = stored(ranking.keyword_boost(items.filter(F.col("rank") <= top_k), F.col("_asked")), "items")
    gate = ranking.overlap_gate(items.join(planned.select("query_id", "laws", "paragraphs"), "query_id")).filter("fired").select("query_id")
    relevant = ranking.any_relevant(items, F.col("_asked"), (F.col("plan_mode") == "exact") | (F.col("domain") != "unknown")).filter("relevant").select("query_id")
    shown = ingest.first_result_text(items.join(gate, "query_id", "left_anti").join(relevant, "query_id", "left_semi"))
    shown = shown.select("query_id", "rank", F.col("chunk_id").cast("string").alias("chunk_id"), "law_iri", "filename", "text", "score")
    off = answers.system_row(gate, "irrelevant_query")
    none = answers.system_row(planned.join(gate, "query_id", "left_anti").join(relevant, "query_id", "left_anti"), "no_result")
    system = off.unionByName(none).select("query_id", F.lit(1).alias("rank"), "chunk_id", F.lit("").alias("law_iri"), F.lit("").alias("filename"), "text", "score")
    return shown.unionByName(system).unionByName(_clarified(bare, top_k))


def _clarified(bare: DataFrame, top_k: int) -> DataFrame:
    """A paragraph without a law is answered by a question and suggestions."""
    asked = bare.select("query_id", F.regexp_extract("query", "([0-9]+[a-zA-Z]*)", 1).alias("paragraph"), F.lit(None).cast("string").alias("hint"))
    name = F.when(F.col("document_id") == "", "Upřesnění dotazu").otherwise(T.iri_to_filename(F.col("document_id")))
    return answers.clarification(asked, top_k).select("query_id", (F.col("pos") + 1).alias("rank"), "chunk_id", F.col("document_id").alias("law_iri"), name.alias("filename"), "text", "score")


def generic(corpus: DataFrame, requests: DataFrame, top_k: int = 5, dimension: int = dense.DIMENSION) -> DataFrame:
    """Ranked dense hits with lexical features and fused scores, before the cut."""
    asked = dense.dense_vectors(requests.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text")), dimension).withColumnRenamed("chunk_id", "query_id")
    found = dense.nearest(dense.dense_vectors(corpus, dimension), asked, min(max(4 * top_k, top_k), 25))
    return fusion.generic_fused(few(stored(found, "found")).join(corpus, "chunk_id").join(requests, "query_id"))


def answer(corpus: DataFrame, requests: DataFrame, top_k: int = 5, dimension: int = dense.DIMENSION) -> DataFrame:
    """One row a request: its context, the gate's decision and the answer without a model.
    ``corpus`` has chunk_id, law_iri, filename, source, text."""
    context = understanding.query_context(requests.withColumn("country", F.lit(None).cast("string")))
    ranked = generic(corpus, requests, top_k, dimension)
    results = ranked.filter(F.col("rank") <= top_k).withColumns({"document_id": F.col("law_iri"), "score": F.col("fused_score")})
    decided = answers.gate(context.join(fusion.features(ranked, top_k), "query_id", "left"))
    rows = decided.join(answers.payload(results), "query_id", "left").join(answers.deterministic_answer(results), "query_id", "left")
    return rows.select("query_id", "query_type", "jurisdiction", "level", "use_llm", "response_type", "reason_codes", "confidence", "answer", "citations", "document_ids", "summary", "explanation", "key_points")


#: What an exact cache key holds, from a request's context and the corpus.
KEY = ("query_hash", "jurisdiction", "request_domain", "query_type", "active_collection", "corpus_fingerprint", "top_k")


def answer_with_caches(corpus: DataFrame, requests: DataFrame, exact: DataFrame, semantic: DataFrame, now: Column, collection: str, fingerprint: str, top_k: int = 5, dimension: int = dense.DIMENSION) -> DataFrame:
    """query_id, served_from (exact, semantic or computed), cache_key, may_store and payload
    (JSON) for every request: cached answers where there are, computed ones otherwise.

    ``exact`` has cache_key, response_payload, created_at, expires_at; ``semantic`` the same,
    the columns of cache.TAGS it knows (domain, jurisdiction, query_type) and embedding."""
    context = understanding.query_context(requests.withColumn("country", F.lit(None).cast("string")))
    known = context.withColumns({"active_collection": F.lit(collection), "corpus_fingerprint": F.lit(fingerprint), "top_k": F.lit(top_k)})
    keyed = stored(known.withColumn("cache_key", cache.key_of(known, KEY)), "requests")
    hit = cache.exact_lookup(keyed.select("query_id", "cache_key"), exact, now).select("query_id", F.lit("exact").alias("served_from"), F.col("response_payload").alias("payload"))
    left = keyed.join(hit, "query_id", "left_anti")
    vectors = dense.dense_vectors(left.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text")), dimension).withColumnRenamed("chunk_id", "query_id")
    asking = left.filter("query_type != 'strategy' AND request_domain IS NOT NULL").join(vectors, "query_id").withColumnRenamed("request_domain", "domain")
    near = cache.semantic_lookup(asking.select("query_id", "embedding", "jurisdiction", "domain", "query_type", "active_collection", "corpus_fingerprint"), semantic, now=now)
    close = near.join(semantic.select(F.col("cache_key").alias("entry_key"), "response_payload"), "entry_key").select("query_id", F.lit("semantic").alias("served_from"), F.col("response_payload").alias("payload"))
    served = stored(hit.unionByName(close), "served")
    rest = keyed.join(served, "query_id", "left_anti").select("query_id", "query")
    made = answer(corpus, rest, top_k, dimension)
    body = F.to_json(F.struct(*[c for c in made.columns if c != "query_id"]))
    stores = made.withColumn("payload", body).join(keyed.select("query_id", "request_domain"), "query_id").withColumn("may_store", cache.may_store())
    stores = stores.select("query_id", F.lit("computed").alias("served_from"), "payload", "may_store")
    rows = served.withColumn("may_store", F.lit(False)).unionByName(stores)
    return rows.join(keyed.select("query_id", "cache_key"), "query_id")


def strategy(laws: DataFrame, courts: DataFrame, requests: DataFrame, hints: tuple[str, ...] = (), top_k: int = 6, dimension: int = dense.DIMENSION) -> DataFrame:
    """One row a request (query_id, query, case_id, document_ids): facts, points of laws and
    courts, arguments, risks, missing documents and confidence, as one chain of joins."""
    asked = requests.select("query_id", "query")

    def side(corpus: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        found = generic(corpus, asked, top_k, dimension).filter(F.col("rank") <= top_k)
        n = found.groupBy("query_id").agg(F.count("*").alias(f"n_{name}s"))
        points = answers.relevant_points(found.select("query_id", "query", "rank", "text")).withColumnRenamed("place", "rank")
        return n, points.groupBy("query_id").agg(answers.ordered(F.col("sentence")).alias(f"{name}_points"))

    rows = requests.select("query_id", T.facts(F.col("query")).alias("facts"), F.col("case_id").isNotNull().alias("has_case"), (F.size(F.coalesce("document_ids", F.array().cast("array<string>"))) > 0).alias("has_documents"))
    for corpus, name in ((laws, "law"), (courts, "court")):
        n, points = side(corpus, name)
        rows = rows.join(n, "query_id", "left").join(points, "query_id", "left")
        rows = rows.withColumns({f"n_{name}s": F.coalesce(f"n_{name}s", F.lit(0)), f"{name}_points": F.coalesce(f"{name}_points", F.array().cast("array<string>"))})
    return answers.strategy(rows.withColumn("hints", F.array(*[F.lit(h) for h in hints]).cast("array<string>"))).drop("hints")
