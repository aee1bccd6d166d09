"""Candidates to results: lookups, neighbours, reranking, validation, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from rillmark.functions import text as T

#: Tags of rows the system makes.
SYSTEM_TAGS = ("irrelevant_query", "no_result", "clarification")

def per_query() -> WindowSpec:
    return Window.partitionBy("query_id")


def anchors(exact: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """query_id, chunk_id and ordinal of the first 8 exact, 6 dense and 6 sparse hits."""
    parts = [d.filter(F.col("rank") <= n).select("query_id", "chunk_id", (F.lit(i * 100) + F.col("rank")).alias("ordinal")) for i, (d, n) in enumerate(((exact, 8), (dense, 6), (sparse, 6)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("query_id", "chunk_id").agg(F.min("ordinal").alias("ordinal"))


def neighbors(anchored: DataFrame, chunks: DataFrame, window: int | Column = 1, cap: int | Column = 30) -> DataFrame:
    """Chunks of an anchor's fragment within the window: an equi-join by fragment with the
    range as residual.  The first anchor wins; a query keeps ``cap`` rows.  Window and cap
    may be columns of ``anchored``.

    ``anchored`` has query_id, chunk_id, ordinal, fragment_id, chunk_index; ``chunks`` has
    chunk_id, fragment_id, chunk_index."""
    c = chunks.select(F.col("chunk_id").alias("near_id"), "fragment_id", F.col("chunk_index").alias("near_index"))
    gap = F.abs(F.col("near_index") - F.col("chunk_index"))
    pairs = anchored.join(c, "fragment_id").filter((gap <= window) & (F.col("near_id") != F.col("chunk_id")))
    first = pairs.groupBy("query_id", "near_id").agg(F.min_by(F.struct(F.col("chunk_id").alias("anchor_id"), "ordinal", "near_index", gap.alias("gap")), F.struct("ordinal", "chunk_id")).alias("r"), F.max(cap if isinstance(cap, Column) else F.lit(cap)).alias("cap"))
    order = per_query().orderBy("r.ordinal", "r.near_index", "near_id")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("cap")).select("query_id", F.col("near_id").alias("chunk_id"), "r.anchor_id", "r.gap", "rank")


def exact_lookup(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the wanted (query_id, law_iri or null for all, paragraph), best first:
    the paragraph's heading, its own text, structural lines, cross-references.

    ``chunks`` has chunk_id, fragment_id, law_iri, paragraph, text, chunk_index."""
    by_law = wanted.filter("law_iri IS NOT NULL").join(chunks, ["law_iri", "paragraph"])
    any_law = wanted.filter("law_iri IS NULL").drop("law_iri").join(chunks, "paragraph")
    text = F.trim(F.coalesce("text", F.lit("")))
    ref = F.concat(F.lit("§ "), "paragraph")
    named = (text == ref) | F.startswith(text, F.concat(ref, F.lit(" ")))
    # a boundary after the number: § 5 is not named by § 52
    crossed = F.rlike(text, F.concat(F.lit("\\Q"), ref, F.lit("\\E(?![0-9a-zA-Z])"))) & ~named
    short = (F.length(text) < 60) & (F.regexp_count(text, F.lit(r"(?U)\w+")) <= 7) & ~text.rlike("[0-9]") & ~text.rlike("[.;]")
    number = T.fragment_number(F.col("fragment_id"))
    rows = by_law.select("query_id", *chunks.columns).unionByName(any_law.select("query_id", *chunks.columns)).distinct()
    rows = rows.withColumns({"is_heading": named, "fragment_no": number})
    rows = rows.withColumn("heading_no", F.min(F.when(F.col("is_heading"), F.col("fragment_no"))).over(per_query()))
    kind = F.when(text == "", 1).when(crossed, 2).when(text.rlike(T.SECTION_HEADING) | short, 1).when(F.col("fragment_no") < F.col("heading_no"), 1).otherwise(0)
    order = per_query().orderBy(F.desc("is_heading"), "kind", "chunk_index", "fragment_id", "chunk_id")
    rows = rows.withColumn("kind", F.when(F.col("is_heading"), 0).otherwise(kind)).withColumns({"rank": F.row_number().over(order), "n": F.count("*").over(per_query())})
    score = 2.0 - (F.col("rank") - 1) / (F.col("n") + 1) + F.when(F.col("is_heading"), 1.0).otherwise(0.0)
    return rows.withColumn("score", F.round(score, 6)).drop("n", "heading_no", "fragment_no")


def over_top(value: Column) -> Column:
    """A score as a share of the greatest of its query; 0 where that is not positive."""
    top = F.max(value).over(per_query())
    return F.when(top > 0, value / top).otherwise(0.0)


def rerank(candidates: DataFrame, planned: DataFrame) -> DataFrame:
    """Weighted score and rank.  ``candidates`` has query_id, chunk_id, law_iri, paragraph,
    text, chunk_index, dense_score, sparse_score, rrf_score, exact_match,
    structural_neighbor, neighbor_of_exact_match; ``planned`` the plan's columns."""
    plan = planned.select("query_id", "law_filter", "preferred_laws", "paragraph_filter", "keywords", "domain", "mode", "plan_mode", "law_boost", "paragraph_boost", "preferred_boost", "exact_boost", "neighbor_boost", "overlap_weight", "mismatch")
    rows = candidates.join(plan, "query_id")
    law, some = F.coalesce("law_iri", F.lit("")), F.coalesce("law_iri", F.lit("")) != ""
    rows = rows.withColumns(
        {
            "strict_law_match": F.array_contains("law_filter", law),
            "preferred_law_match": F.array_contains("preferred_laws", law),
            "paragraph_match": F.coalesce(F.array_contains("paragraph_filter", F.col("paragraph")), F.lit(False)),
            "text_overlap": T.overlap_ratio(F.col("keywords"), T.tokens(F.coalesce("text", F.lit("")))),
            "dense_norm": over_top(F.coalesce("dense_score", F.lit(0.0))),
            "sparse_norm": over_top(F.coalesce("sparse_score", F.lit(0.0))),
            "rrf_norm": over_top(F.coalesce("rrf_score", F.lit(0.0))),
        }
    )
    outside = (F.size("law_filter") > 0) & some & ~F.col("strict_law_match")
    strange = (F.col("domain") != "unknown") & (F.size("preferred_laws") > 0) & some & ~F.col("preferred_law_match")
    penalty = T.structural_penalty(F.col("text")) + F.when(outside, F.col("mismatch")).when(strange, F.col("mismatch") * 0.35).otherwise(0.0)
    boost = T.heading_boost(F.col("text"), F.col("keywords"), F.col("strict_law_match") | F.col("preferred_law_match"), F.col("mode"))

    def part(flag: str, weight: str) -> Column:
        return F.when(F.col(flag), F.col(weight)).otherwise(0.0)

    score = (
        F.col("rrf_norm") * 0.34
        + F.col("dense_norm") * 0.22
        + F.col("sparse_norm") * 0.22
        + F.col("text_overlap") * F.col("overlap_weight")
        + part("strict_law_match", "law_boost")
        + part("preferred_law_match", "preferred_boost")
        + part("paragraph_match", "paragraph_boost")
        + part("exact_match", "exact_boost")
        + part("structural_neighbor", "neighbor_boost")
        + boost
        - penalty
    )
    order = per_query().orderBy(F.desc("score"), F.desc("exact_match"), F.desc("paragraph_match"), F.desc("strict_law_match"), F.desc("preferred_law_match"), "chunk_index", "chunk_id")
    return rows.withColumn("score", F.round(score, 6)).withColumn("rank", F.row_number().over(order))


def validate(items: DataFrame) -> DataFrame:
    """Reranked items that hold: of the right law and paragraph, and not too far below the
    query's top score."""
    top = F.max("score").over(per_query())
    rows = items.withColumn("_top", top)
    wrong_law = (F.col("plan_mode") == "constrained") & (F.size("law_filter") > 0) & ~F.col("strict_law_match")
    wrong_place = (F.col("plan_mode") == "exact") & (F.size("paragraph_filter") > 0) & ~(F.col("paragraph_match") | F.col("neighbor_of_exact_match") | F.col("exact_match"))
    flagged = F.col("exact_match") | F.col("paragraph_match") | F.col("strict_law_match") | F.col("preferred_law_match")
    low = (F.col("score") < F.greatest(F.lit(0.12), F.col("_top") * 0.30)) & ~flagged
    lowest = (F.col("score") < F.greatest(F.lit(0.08), F.col("_top") * 0.18)) & ~F.col("exact_match") & (F.col("text_overlap") < 0.05)
    return rows.filter(~(wrong_law | wrong_place | low | lowest)).drop("_top")


def should_broaden(valid: DataFrame, planned: DataFrame, top_k: int) -> DataFrame:
    """query_id and reason of the queries that need the wider plan."""
    n = valid.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = planned.select("query_id", "plan_mode").join(n, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when(F.col("n") == 0, "no_valid_candidates").when((F.col("plan_mode") != "exact") & (F.col("n") < max(2, min(top_k, 4))), "insufficient_validated_results")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL AND plan_mode != 'broad'").select("query_id", "reason")


def diversify(ranked: DataFrame, top_k: int, group: Column, most: int = 2) -> DataFrame:
    """At most ``most`` rows of a group first, the others after them; rows after the one
    that completes top_k are not looked at."""
    rows = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))).withColumn("_over", (F.col("_n") > most).cast("int"))
    seen = F.sum(1 - F.col("_over")).over(per_query().orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_seen", F.coalesce(seen, F.lit(0))).filter(F.col("_seen") < top_k)
    return rows.withColumn("rank", F.row_number().over(per_query().orderBy("_over", "rank"))).filter(F.col("rank") <= top_k).drop("_n", "_over", "_seen")


def cross_encoder_order(ranked: DataFrame, scored: Column, first: int = 10) -> DataFrame:
    """The first rows of a query in the order of a model's score less the chunk penalty,
    the rest unchanged.  A null score (the model failed) keeps a query's order."""
    rows = ranked.withColumns({"_head": F.col("rank") <= first, "_model": scored})
    failed = F.bool_or(F.col("_head") & F.col("_model").isNull()).over(per_query()) | (F.count("*").over(per_query()) < 2)
    rows = rows.withColumn("_adjusted", F.when(F.col("_head") & ~failed, -(F.col("_model") - T.cross_encoder_penalty(F.col("text")))))
    order = per_query().orderBy(F.desc("_head"), F.asc_nulls_first("_adjusted"), "rank")
    return rows.withColumn("rank", F.row_number().over(order)).drop("_head", "_model", "_adjusted")


def lexical_stand_in(query: Column, text: Column) -> Column:
    """A deterministic score in the place of a cross encoder: shared words of what both say
    in their first 768 characters."""
    return T.overlap_ratio(T.tokens(query), T.tokens(F.substring(F.coalesce(text, F.lit("")), 1, 768)))


def keyword_boost(items: DataFrame, query: Column) -> DataFrame:
    """0.4 for every query word of four letters or more that the text contains, 0.8 for all
    of them as a phrase; ranks anew."""
    text = F.lower(F.coalesce("text", F.lit("")))
    rows = items.withColumn("_terms", T.words(F.lower(F.trim(query)), 3)).withColumn("_text", text)
    n = F.size(F.filter("_terms", lambda t: F.contains(F.col("_text"), t)))
    phrase = (F.size("_terms") > 0) & F.contains(F.col("_text"), F.array_join("_terms", " "))
    rows = rows.withColumn("score", F.round(F.col("score") + 0.4 * n + F.when(phrase, 0.8).otherwise(0.0), 6))
    return rows.withColumn("rank", F.row_number().over(per_query().orderBy(F.desc("score"), "rank"))).drop("_terms", "_text")


#: Words that do not count for the overlap gates.
GATE_STOPS = ("text", "data", "cast", "nebo", "jako")


def overlap_gate(items: DataFrame) -> DataFrame:
    """query_id, max_overlap and fired: whether the best item shares too little with the
    query (keywords, plan_mode, domain, laws, paragraphs, law_filter columns)."""
    words = F.filter("keywords", lambda t: (F.length(t) >= 4) & ~t.isin(*GATE_STOPS))
    rows = items.withColumn("_words", words)
    per = rows.groupBy("query_id").agg(
        F.max(T.overlap_ratio(F.col("_words"), T.tokens(F.coalesce("text", F.lit(""))))).alias("max_overlap"), *[F.first(c).alias(c) for c in ("plan_mode", "domain", "laws", "paragraphs", "law_filter")], F.first(F.size("_words")).alias("n_words")
    )
    broad = (F.col("plan_mode") == "broad") & (F.col("domain") == "unknown") & (F.size("laws") == 0) & (F.size("paragraphs") == 0) & (F.col("max_overlap") < 0.5)
    domain = (F.col("plan_mode") == "constrained") & (F.size("law_filter") == 0) & (F.col("domain") != "unknown") & (F.size("paragraphs") == 0) & (F.col("max_overlap") < 0.3)
    return per.select("query_id", F.round("max_overlap", 6).alias("max_overlap"), ((F.col("n_words") > 0) & (broad | domain)).alias("fired"))


def any_relevant(items: DataFrame, query: Column, always: Column) -> DataFrame:
    """query_id and relevant: whether any item contains a query word of four letters."""
    words = F.filter(F.split(F.trim(query), " "), lambda w: F.length(w) > 3)
    hit = always | F.exists(words, lambda w: F.contains(F.lower(F.coalesce("text", F.lit(""))), w))
    return items.withColumn("_hit", hit).groupBy("query_id").agg(F.bool_or("_hit").alias("relevant"))


def best_per_chunk(items: DataFrame) -> DataFrame:
    """One row for each (query_id, chunk_id), that of the greatest score; ranks anew."""
    names = [c for c in items.columns if c not in ("query_id", "chunk_id")]
    rows = items.groupBy("query_id", "chunk_id").agg(F.max_by(F.struct(*names), F.struct("score", -F.col("rank"))).alias("r")).select("query_id", "chunk_id", "r.*")
    return rows.withColumn("rank", F.row_number().over(per_query().orderBy(F.desc("score"), "chunk_index", "chunk_id")))


def score_filter(items: DataFrame, least: float = 0.9, above: bool = False) -> DataFrame:
    """Rows of that score (``above``: of a greater one) or with a system tag."""
    enough = F.col("score") > least if above else F.col("score") >= least
    tagged = F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in SYSTEM_TAGS])), F.lit(False))
    return items.filter(enough | tagged)
