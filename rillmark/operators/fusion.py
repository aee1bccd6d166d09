"""Fusing ranked lists: reciprocal ranks, keyed merges, generic fused scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.functions import text as T

#: Fixed value: the rank offset of reciprocal rank fusion.
RRF_K = 60


def rrf(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """Full outer join of two ranked lists (query_id, chunk_id, rank, score) with the sum
    of reciprocal ranks.  rank orders by score, dense rank, sparse rank, id."""
    d = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    s = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score"))

    def part(c: str) -> Column:
        return F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))

    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "chunk_id")
    return d.join(s, ["query_id", "chunk_id"], "full_outer").withColumn("rrf_score", F.round(part("dense_rank") + part("sparse_rank"), 9)).withColumn("rank", F.row_number().over(order))


#: How the columns of one chunk's hits merge.
SCORES = ("dense_score", "sparse_score", "rrf_score")
FLAGS = ("exact_match", "structural_neighbor", "neighbor_of_exact_match")


def keyed_merge(hits: DataFrame, payload: tuple[str, ...]) -> DataFrame:
    """One row for each (query_id, chunk_id) of ``hits``, which have source_order: greatest
    scores, any flag, and the first payload value, in source order, that is not empty."""
    have = hits.columns
    first = [F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("source_order"))).alias(c) for c in payload]
    return hits.groupBy("query_id", "chunk_id").agg(
        *[F.max(F.coalesce(c, F.lit(0.0))).alias(c) for c in SCORES if c in have], *[F.bool_or(F.coalesce(c, F.lit(False))).alias(c) for c in FLAGS if c in have], *first, F.min("source_order").alias("source_order")
    )


#: Fixed value: what counts as a citation on either side.
CITATION = r"(?iU)§\s*\d+[a-zA-Z]*|\b(?:cl\.|čl\.|article|art\.)\s*\d+[a-zA-Z]*"


def lexical_features(hits: DataFrame) -> DataFrame:
    """``hits`` (query, filename, source, text, score) with overlap_count, overlap_ratio,
    phrase_match, citation_match, filename_match, source_match, lexical_score and
    combined_score.  Query words count from three letters."""
    q = T.fold(F.col("query"))
    whole = T.fold(F.array_join(F.filter(F.array(F.nullif(F.col("filename"), F.lit("")), F.nullif(F.col("source"), F.lit("")), F.nullif(F.col("text"), F.lit(""))), lambda p: p.isNotNull()), "\n"))
    rows = hits.withColumns({"_terms": T.words(q, 2), "_text": whole})
    rows = rows.withColumns({"_set": F.array_distinct("_terms"), "_some": F.size("_terms") > 0})

    def names(c: str) -> Column:
        return F.coalesce(F.exists("_set", lambda t: F.contains(T.fold(F.col(c)), t)), F.lit(False))

    rows = rows.withColumns(
        {
            "overlap_count": F.size(F.array_intersect("_set", F.array_distinct(T.words(F.col("_text"), 2)))),
            "phrase_match": F.col("_some") & F.contains(F.col("_text"), F.array_join("_terms", " ")),
            "citation_match": F.col("_some") & q.rlike(CITATION) & F.col("_text").rlike(CITATION),
            "filename_match": F.col("_some") & names("filename"),
            "source_match": F.col("_some") & (F.coalesce("source", F.lit("")) != "") & names("source"),
        }
    )
    rows = rows.withColumn("overlap_ratio", F.col("overlap_count") / F.greatest(F.lit(1), F.size("_set")))

    def part(c: str, w: float) -> Column:
        return F.when(F.col(c), w).otherwise(0.0)

    lexical = F.col("overlap_ratio") * 0.6 + part("phrase_match", 0.2) + part("citation_match", 0.15) + part("filename_match", 0.1) + part("source_match", 0.05)
    return rows.withColumn("lexical_score", F.round(lexical, 9)).withColumn("combined_score", F.round(F.col("score") + F.col("lexical_score"), 9)).drop("_terms", "_text", "_set", "_some")


def generic_fused(hits: DataFrame) -> DataFrame:
    """Lexical features, dense_rank, lexical_rank and fused_score of dense hits
    (query_id, chunk_id, rank, score, ...)."""
    by_words = Window.partitionBy("query_id").orderBy(F.desc("lexical_score"), F.desc("combined_score"), "rank")
    rows = lexical_features(hits).withColumnRenamed("rank", "dense_rank_in")
    rows = rows.withColumn("rank", F.col("dense_rank_in")).withColumn("lexical_rank", F.row_number().over(by_words)).withColumnRenamed("dense_rank_in", "dense_rank")
    bonus = F.when(F.col("phrase_match"), 0.08).otherwise(0.0) + F.when(F.col("citation_match"), 0.1).otherwise(0.0)
    fused = F.col("score") * 0.45 + F.col("lexical_score") * 0.3 + 12.0 / (RRF_K + F.col("dense_rank")) + 9.0 / (RRF_K + F.col("lexical_rank")) + bonus
    best = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "dense_rank")
    return rows.withColumn("fused_score", F.round(fused, 6)).withColumn("rank", F.row_number().over(best))


def features(ranked: DataFrame, top_k: int, domain: Column | None = None) -> DataFrame:
    """One row a query: the retrieval features that the confidence gate reads."""
    best = F.min_by
    top_dense = ranked.groupBy("query_id").agg(best("score", "dense_rank").alias("top_dense_score"))
    chosen = ranked.filter(F.col("rank") <= top_k).withColumn("in_domain", F.lit(True) if domain is None else domain)
    second = F.max(F.when(F.col("rank") == 2, F.col("fused_score")))
    per = chosen.groupBy("query_id").agg(
        F.max("fused_score").alias("top_fused_score"),
        F.round(F.greatest(F.max("fused_score") - F.coalesce(second, F.lit(0.0)), F.lit(0.0)), 6).alias("score_gap"),
        best("overlap_ratio", "rank").alias("keyword_coverage"),
        best("phrase_match", "rank").alias("phrase_match"),
        best("citation_match", "rank").alias("citation_match"),
        F.avg(F.col("in_domain").cast("double")).alias("domain_consistency"),
        F.count_if((F.col("overlap_ratio") >= 0.45) | F.col("phrase_match") | F.col("citation_match")).alias("supporting_chunks"),
    )
    return per.join(top_dense, "query_id")
