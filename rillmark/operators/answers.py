"""From results to answers: the confidence gate, payloads, prompts, strategy drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions import text as T

#: What a confidence level is worth.
LEVELS = {"high": 0.88, "medium": 0.64, "low": 0.38}


def gate(rows: DataFrame) -> DataFrame:
    """``rows`` (query_type and the retrieval features; nulls where nothing was found) with
    level, use_llm, response_type, reason_codes and confidence."""
    found = F.col("top_fused_score").isNotNull()
    cover, gap = F.col("keyword_coverage"), F.col("score_gap")
    kind = F.col("query_type")
    statute = F.col("citation_match") & (cover >= 0.45) & (gap >= 0.02)
    case = (F.col("phrase_match") | (cover >= 0.5)) & (gap >= 0.02)
    semantic = (F.col("top_fused_score") >= 0.7) & (cover >= 0.65) & (F.col("supporting_chunks") >= 1)
    level = (
        F.when(kind == "strategy", "medium")
        .when(~found, "low")
        .when(kind == "exact_statute", F.when(statute, "high").otherwise("medium"))
        .when(kind == "case_lookup", F.when(case, "high").otherwise("medium"))
        .when(semantic, "high")
        .when(F.col("top_fused_score") >= 0.55, "medium")
        .otherwise("low")
    )
    codes = F.array_compact(F.array(F.when(F.col("citation_match"), "citation_match"), F.when(F.col("phrase_match"), "phrase_match"), F.when(cover >= 0.6, "keyword_coverage"), F.when(gap >= 0.03, "score_gap")))
    spare = (
        F.when(kind == "exact_statute", F.when(statute, "exact_statute_match").otherwise("exact_statute_needs_explanation"))
        .when(kind == "case_lookup", F.when(case, "case_lookup_match"))
        .otherwise(F.when(semantic, "semantic_high_confidence").when(F.col("top_fused_score") >= 0.55, "semantic_needs_llm").otherwise("weak_retrieval"))
    )
    reasons = F.when(kind == "strategy", F.array(F.lit("strategy_requires_llm"))).when(~found, F.array(F.lit("no_results"))).when(F.size(codes) > 0, codes).otherwise(F.array_compact(F.array(spare)))
    rows = rows.withColumns({"level": level, "reason_codes": reasons})
    cites = (kind == "exact_statute") & (F.col("level") == "high") | (kind == "case_lookup") & (F.col("level") == "high")
    worth = F.when(F.col("level") == "high", LEVELS["high"]).when(F.col("level") == "medium", LEVELS["medium"]).otherwise(LEVELS["low"])
    return rows.withColumns(
        {
            "use_llm": (kind == "strategy") | (F.col("level") != "high"),
            "response_type": F.when(kind == "strategy", "strategy_answer").when(cites, "citation_answer").otherwise("semantic_explanation"),
            "confidence": worth,
        }
    )


def ordered(value: Column) -> Column:
    """A query's values in rank order (rank column), as an aggregate."""
    return F.transform(F.sort_array(F.collect_list(F.struct("rank", value.alias("v")))), lambda x: x["v"])


def payload(results: DataFrame) -> DataFrame:
    """One row a query: preview of the best result, document ids and citations in order
    without repeats, chunk ids, and the sources."""
    by_rank = F.min_by
    rows = results.groupBy("query_id").agg(
        by_rank("text", "rank").alias("_text"),
        by_rank("filename", "rank").alias("_first"),
        F.array_distinct(ordered(F.col("document_id"))).alias("document_ids"),
        ordered(F.col("chunk_id")).alias("chunk_ids"),
        ordered(F.coalesce("source", F.lit(""))).alias("_sources"),
        ordered(F.struct("chunk_id", "document_id", "filename", "source", "score")).alias("sources"),
    )
    citations = F.filter(F.array_distinct(F.concat(F.array("_first"), F.col("_sources"))), lambda c: c != "")
    return rows.select("query_id", T.preview(F.col("_text")).alias("answer"), citations.alias("citations"), "document_ids", "chunk_ids", "sources")


def deterministic_answer(results: DataFrame) -> DataFrame:
    """Without a language model: first sentence of the best result, previews of three."""
    top = results.filter("rank <= 3").groupBy("query_id").agg(F.min_by("text", "rank").alias("_text"), ordered(T.preview(F.col("text"), 180)).alias("key_points"))
    summary = T.first_sentence(F.col("_text"))
    return top.select("query_id", F.when(summary != "", summary).otherwise("Relevant legal context located.").alias("summary"), F.array_join("key_points", " ").alias("explanation"), "key_points")


def substantive(results: DataFrame, most: int = 5, limit: int = 600) -> DataFrame:
    """A query's first substantive texts, cut to the limit; else its first text at all."""
    good = T.is_substantive(F.col("text"))
    some = F.trim(F.coalesce("text", F.lit(""))) != ""
    per = Window.partitionBy("query_id")
    rows = results.withColumns({"_good": good, "_some": some}).withColumns({"_any": F.bool_or("_good").over(per)})
    rows = rows.filter(F.when(F.col("_any"), F.col("_good")).otherwise(F.col("_some")))
    rows = rows.withColumn("pick", F.row_number().over(per.orderBy("rank"))).filter(F.col("pick") <= F.when(F.col("_any"), most).otherwise(1))
    return rows.withColumn("text", T.cut(F.col("text"), limit)).drop("_good", "_some", "_any")


#: The grounded prompt, a source in it, and its lists with and without sources.
PROMPT = """DOTAZ: %s
JURISDIKCE: %s  |  DOMÉNA: %s

%s
INSTRUKCE:
Na základě POUZE výše uvedených zdrojů [1]–[%d] odpověz na dotaz.
• summary: 1–2 věty shrnutí přesně podle zdrojů.
• explanation: podrobnější vysvětlení citující konkrétní text ze zdrojů.
• key_points: seznam klíčových bodů, každý doložen zdrojem.
Pokud zdroje nestačí k odpovědi, napiš to explicitně."""
PROMPT_SOURCE = '[%d] %s  (score: %.3f)\n    "%s"\n'
PROMPT_SOURCES, PROMPT_NO_SOURCES = "ZDROJE (%d):\n%s", "ZDROJE: Žádné relevantní úryvky nebyly nalezeny.\n"


def prompt(query: Column, jurisdiction: Column, domain: Column, sources: Column) -> Column:
    """The grounded user prompt; ``sources`` is array<struct<filename, score, text>>."""
    n = F.size(sources)
    listed = F.array_join(F.transform(sources, lambda s, i: F.format_string(PROMPT_SOURCE, i + 1, s["filename"], s["score"], s["text"])), "\n")
    body = F.when(n > 0, F.format_string(PROMPT_SOURCES, n, listed)).otherwise(PROMPT_NO_SOURCES)
    return F.format_string(PROMPT, query, jurisdiction, F.coalesce(domain, F.lit("law")), body, n)


# Rows the system makes -----------------------------------------------------

#: Laws offered when a paragraph is asked for without one.
OFFERED = (("local:sb/2006/262", "zákoník práce"), ("local:sb/2012/89", "občanský zákoník"), ("local:sb/2009/40", "trestní zákoník"))
AMBIGUOUS = "Dotaz je nejednoznačný. Uveď, o jaký zákon se jedná nebo popiš problém."
AMBIGUOUS_HERE = "Upřesni zákon. Na základě kontextu nabízím relevantní možnosti:"
#: What is said in place of results.
SYSTEM_TEXTS = {
    "irrelevant_query": "Dotaz není dostatečně specifický pro vyhledávání v českém právu.",
    "no_result": "Nepodařilo se najít relevantní výsledek.",
}


def clarification(asked: DataFrame, top_k: int = 5) -> DataFrame:
    """For ambiguous queries (query_id, paragraph, hint): the message and one suggestion
    for each law, the hinted one first."""
    laws = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(iri).alias("iri"), F.lit(name).alias("name")) for i, (iri, name) in enumerate(OFFERED)])
    ranked = F.array_sort(F.transform(laws, lambda x: F.struct((~F.coalesce(x["iri"] == F.col("hint"), F.lit(False))).cast("int").alias("a"), x["i"].alias("i"), x["iri"].alias("iri"), x["name"].alias("name"))))
    message = asked.select(
        "query_id", F.lit(0).alias("pos"), F.lit("clarification:message").alias("chunk_id"), F.lit("").alias("document_id"), F.when(F.col("hint").isNull(), AMBIGUOUS).otherwise(AMBIGUOUS_HERE).alias("text"), F.lit("clarification").alias("source_type")
    )
    offers = asked.select("query_id", "paragraph", F.posexplode(ranked).alias("at", "law")).select(
        "query_id",
        (F.col("at") + 1).alias("pos"),
        F.concat(F.lit("clarification:suggestion:"), "law.iri", F.lit(":"), F.col("paragraph").cast("string")).alias("chunk_id"),
        F.col("law.iri").alias("document_id"),
        F.concat(F.lit("§ "), F.col("paragraph").cast("string"), F.lit(" "), "law.name").alias("text"),
        F.lit("clarification_suggestion").alias("source_type"),
    )
    rows = message.unionByName(offers)
    return rows.withColumn("score", F.round(F.greatest(F.lit(0.0), 1.0 - F.col("pos") * 0.01), 4)).filter(F.col("pos") < top_k)


def system_row(queries: DataFrame, kind: str) -> DataFrame:
    """The row in place of results: irrelevant_query or no_result."""
    text = SYSTEM_TEXTS[kind]
    return queries.select("query_id", F.lit(kind).alias("chunk_id"), F.lit(text).alias("text"), F.lit("system").alias("source_type"), F.array(F.lit(kind)).alias("tags"), F.lit(0.0).alias("score"))


# Strategy ------------------------------------------------------------------


def relevant_points(chunks: DataFrame, limit: int = 4) -> DataFrame:
    """The best distinct sentences of each query's chunks (query_id, query, rank, text):
    most shared words first, then the longest."""
    words = F.array_distinct(T.words(F.lower(F.col("query")), 3))
    found = chunks.select("query_id", "rank", words.alias("q"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    rows = found.withColumn("overlap", F.size(F.array_intersect("q", F.array_distinct(T.words(F.lower(F.col("sentence")))))))
    once = rows.groupBy("query_id", "sentence").agg(F.max("overlap").alias("overlap"), F.min(F.struct("rank", "pos")).alias("at"))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), F.desc(F.length("sentence")), "at")
    return once.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query_id", "place", "overlap", "sentence")


#: The sentences of a strategy draft.
ARGUMENT = "Build the primary line of argument on: "
FEW_LAWS = "Low volume of statutory context reduces legal certainty."
FEW_COURTS = "Low volume of case-law context weakens predictive confidence."
NO_LAW_POINT = "The record currently lacks directly relevant statutory support."
NO_COURT_POINT = "The record currently lacks supporting judicial interpretation."
NO_CASE = "No case identifier was supplied, so some relevant case-specific material may be missing."
NO_HISTORY = "Case-specific filing history or procedural chronology."
ALIGN = "Validate how the matter aligns with %s."
MAP_HOLDINGS = "Map the retrieved holdings against %s."
ADD_COURTS = "Add leading court decisions before finalizing the litigation strategy."


def strategy(rows: DataFrame, law_focus: str = "the applicable statutes", court_focus: str = "the case law") -> DataFrame:
    """``rows`` (n_laws, n_courts, law_points, court_points, has_case, has_documents,
    hints) with confidence, arguments for and against, risks, recommended actions, missing
    documents and a summary of its best points."""
    laws, courts = F.col("n_laws"), F.col("n_courts")

    def listed(*parts: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(c, t) for c, t in parts]))

    held = F.size("court_points") > 0
    best = F.array_compact(F.array(F.get("law_points", F.lit(0)), F.get("court_points", F.lit(0))))
    return rows.withColumns(
        {
            "confidence": F.round(F.least(F.lit(0.95), 0.25 + 0.08 * laws + 0.08 * courts), 2),
            "arguments_for": F.transform(F.concat(F.slice("law_points", 1, 3), F.slice("court_points", 1, 2)), lambda p: F.concat(F.lit(ARGUMENT), p)),
            "risks": listed((laws < 2, FEW_LAWS), (courts < 2, FEW_COURTS)),
            "arguments_against": listed((F.size("law_points") == 0, NO_LAW_POINT), (~held, NO_COURT_POINT), (~F.col("has_case"), NO_CASE)),
            "recommended_actions": F.array(F.lit(ALIGN % law_focus.lower()), F.when(held, MAP_HOLDINGS % court_focus.lower()).otherwise(ADD_COURTS)),
            "missing_documents": F.array_distinct(F.concat(F.when(F.col("has_documents"), F.array().cast("array<string>")).otherwise(F.slice("hints", 1, 2)), listed((~F.col("has_case"), NO_HISTORY)))),
            "summary": F.array_join(best, " "),
        }
    )
