"""From fragments to chunks: filters, paragraph context, splitting, ids, dedup, counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark import packaging
from rillmark.functions import hashing
from rillmark.functions import text as T

#: Fragment types that carry text.
TEXT_TYPES = (
    "Cast",
    "Hlava",
    "Dil",
    "Oddil",
    "Pododdil",
    "Nadpis_nad",
    "Nadpis_pod",
    "Paragraf",
    "Odstavec_Dc",
    "Pismeno_Lb",
    "Bod_Dd",
    "Odrazka_Rb",
    "Pokracovani_Text",
    "Block_Prechodne_Ustanoveni_Nov",
    "Block_Zrusovaci_Ustanoveni",
    "Block_Ucinnostni_Ustanoveni",
)
#: Chunk size and overlap; where texts are split, best first.
CHUNK, OVERLAP = 1200, 180
LEGAL_SEPARATORS = ("\n\n", "\n", ". ", "; ", " ", "")
PLAIN_SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def reason(text: Column) -> Column:
    """Why a fragment is not ingested, or "ok"."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, "empty_text").when(n < 3, "text_too_short").otherwise("ok")


def ingestible(fragments: DataFrame) -> DataFrame:
    return fragments.filter(reason(F.col("text")) == "ok")


def paragraph_context(fragments: DataFrame, law: str = "law_iri", order: str = "pos", marker: str = "Paragraf") -> DataFrame:
    """The paragraph in force at each fragment: a marker row sets it or, without a number,
    resets it; another row sets it if it names one.  The value is carried in a struct, so
    that a reset is a value too."""
    named = F.nullif(F.regexp_extract("text", r"(?i)§\s*([0-9]+[a-z]?)", 1), F.lit(""))
    event = F.when((F.col("typ") == marker) | named.isNotNull(), F.struct(named.alias("p")))
    to_here = Window.partitionBy(law).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return fragments.withColumn("paragraph", F.last(event, ignorenulls=True).over(to_here)["p"])


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Recursive splitting: by the first separator that occurs, pieces that are still too
    long by the next ones; neighbouring pieces are joined up to the size, and a chunk takes
    up the last pieces of the one before, up to the overlap."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    if separator:
        cut = text.split(separator)
        # a piece keeps the separator that comes before it
        pieces = [cut[0], *[separator + p for p in cut[1:]]]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []

    def merged() -> None:
        window: list[str] = []
        total = 0
        for piece in held:
            if window and total + len(piece) > size:
                out.append("".join(window).strip())
                while window and (total > overlap or total + len(piece) > size):
                    total -= len(window.pop(0))
            window.append(piece)
            total += len(piece)
        out.append("".join(window).strip())
        held.clear()

    for piece in pieces:
        if not piece:
            continue
        if len(piece) < size:
            held.append(piece)
            continue
        if held:
            merged()
        if finer:
            out.extend(split_text(piece, size, overlap, finer))
        else:
            out.append(piece.strip())
    if held:
        merged()
    return [c for c in out if c]


def chunks(fragments: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = LEGAL_SEPARATORS) -> DataFrame:
    """fragment rows with chunk_index, chunk_id and the chunk's text.  Only texts beyond
    the size go through Python, in Arrow batches; the rest stays in the JVM."""

    packaging.send(fragments.sparkSession)

    @F.pandas_udf("array<string>")
    def parts(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield texts.map(lambda t: split_text(t, size, overlap, separators))

    trimmed = fragments.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).filter("text != ''")
    short = trimmed.filter(F.length("text") <= size).withColumns({"chunk_index": F.lit(0), "part": F.col("text")})
    long = trimmed.filter(F.length("text") > size).select("*", F.posexplode(parts("text")).alias("chunk_index", "part"))
    both = short.unionByName(long).withColumn("text", F.col("part")).drop("part")
    return both.withColumn("chunk_id", hashing.chunk_id(F.col("fragment_id"), F.col("chunk_index")))


def first_text_per(df: DataFrame, group: str, order: str) -> DataFrame:
    """The first row of every distinct text within a group, by the hash of the trimmed
    text.  min_by sums map-side, so a much repeated text is one row a task."""
    digest = F.sha1(F.trim(F.coalesce("text", F.lit(""))).cast("binary"))
    return df.groupBy(group, digest.alias("text_hash")).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("r")).select("r.*")


def first_result_text(hits: DataFrame) -> DataFrame:
    """Ranked hits without repeats of a text within a query; blank texts all stay."""
    text = F.trim(F.coalesce("text", F.lit("")))
    n = F.row_number().over(Window.partitionBy("query_id", text).orderBy("rank"))
    return hits.withColumn("_n", n).filter((text == "") | (F.col("_n") == 1)).drop("_n")


def counts_by_reason(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy(reason(F.col("text")).alias("reason")).agg(F.count("*").alias("n"))


def counts_rollup(chunked: DataFrame) -> DataFrame:
    """Chunks and characters for each law, and in all (law_iri null)."""
    return chunked.rollup("law_iri").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


def reverse_index(definitions: DataFrame) -> DataFrame:
    """fragment_id and the ids of the definitions that link to it, in order of seq."""
    links = definitions.filter("id IS NOT NULL").select("id", "seq", F.posexplode("law_links").alias("pos", "fragment_id"))
    return links.groupBy("fragment_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "pos", "id"))), lambda x: x["id"]).alias("definition_refs"))


def with_definitions(fragments: DataFrame, index: DataFrame) -> DataFrame:
    """Fragments with their definition_refs, empty where there are none."""
    return fragments.join(index, "fragment_id", "left").withColumn("definition_refs", F.coalesce("definition_refs", F.array().cast("array<string>")))


def not_ingested(new: DataFrame, existing: DataFrame, key: str = "law_iri") -> DataFrame:
    return new.join(existing.select(key).distinct(), key, "left_anti")
