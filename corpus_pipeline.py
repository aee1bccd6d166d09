"""The corpus pipeline: five stages from raw documents to a training mix.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
documents.

1. toxicity: documents that the classifier scores at 0.3 or more go.
2. n-gram Jaccard join: of each group of near duplicates (five-word shingles, similarity
   0.8 or more) the document with the least doc_id stays.
3. substring dedup: words in 35-word windows that occur elsewhere go; untouched texts stay
   as they are.  A document may be left with an empty text.
4. benchmark decontamination: documents of which a twentieth or more are benchmark windows
   go; the others stay unchanged.
5. mixing: a row for each time the mix takes a text, with its epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillmark.llm import decontaminate, jaccard_join, mixing, shared, substring_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.trained(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, shared.read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: A classifier fitted by gradient steps has no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.table(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
