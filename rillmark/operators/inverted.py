"""A stored inverted index: BM25 top k without reading a text.

Chunks are numbered as they come and cut into blocks of BLOCK.  For each token and block the
index has one row: the chunks that hold the token, what BM25 gives each before the token's
weight, and the greatest of these.  Rows lie in folders by a hash of the token and, within
files, in the order of token and block, so that a search opens few files and few row groups
of them.

A search has three steps.  The greatest impacts of a query's tokens are summed by block: no
chunk of a block can score more.  The PROBE most promising blocks of each query are scored
whole; the k-th score found there is one that the top k reaches.  From then on only blocks
whose bound reaches it are read, and of these at first only the tokens that matter: tokens
whose greatest impacts together stay below that score cannot lift a chunk without any other
into the top k.  Their entries are read for the chunks that may still get there, no others.
What is left out cannot be in the result, which is that of ``lexical.search``.

Scale: a row holds at most BLOCK chunks, however common its token is; bounds are sums by
query and block.  Writing deals a folder's rows by block as well, a million chunks each, so
a common token is written by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.sources import work
from rillmark.sources.work import stored

from . import batches, lexical
from .sides import few

#: Chunks of a block (a power of two), folders of postings, blocks scored first.
BLOCK, FOLDERS, PROBE = 64, 32, 4
#: Chunks whose postings of one folder are written by one task.
TOGETHER = 1 << 20
#: Distinct query tokens that are named to the scan, so that it skips row groups.
NAMED = 1_000
#: Scores are rounded to six places, and bounds are sums in another order.
SLACK = 2e-6


def _folder(token: str) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(FOLDERS)).cast("int")


@dataclass(frozen=True)
class Index:
    """An index in a folder: postings, tokens with their document counts, totals."""

    spark: SparkSession
    at: str

    @property
    def postings(self) -> DataFrame:
        """token, block, most, n, entries (chunk_id, impact, kept columns), folder."""
        entries = f"array<{self.kept().simpleString()}>"
        return self.spark.read.schema(f"token string, block long, most double, entries {entries}, n int, folder int").parquet(f"{self.at}/postings")

    @property
    def tokens(self) -> DataFrame:
        """token, df, its greatest impact, folder."""
        return self.spark.read.schema("token string, df long, most double, folder int").parquet(f"{self.at}/tokens")

    @property
    def totals(self) -> DataFrame:
        """One row: n_docs, avg_dl."""
        return self.spark.read.schema("n_docs long, avg_dl double").parquet(f"{self.at}/totals")

    def kept(self) -> T.StructType:
        """What is kept of a chunk in an entry."""
        return self.spark.read.parquet(f"{self.at}/kept").schema


def _posted(keep: tuple[str, ...], block: int):
    """Rows (chunk_id, kept columns, tokens) as rows of a token and block: the chunks that
    hold it, their lengths and counts, and of how many chunks it is the first."""

    def posted(rows: pa.Table, at: int) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        toks = rows.column(rows.num_columns - 1).combine_chunks()
        row, token = batches.elements(toks)
        coded = token.dictionary_encode()
        n = max(len(coded.dictionary), 1)
        # by block, token and row
        key, tf = np.unique((row // block * n + coded.indices.to_numpy()) * rows.num_rows + row, return_counts=True)
        of, row = np.divmod(key, max(rows.num_rows, 1))
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        length = np.diff(toks.offsets.to_numpy())
        first = np.zeros(len(key), np.int64)
        first[np.unique(row, return_index=True)[1]] = 1
        offsets = pa.array(np.append(starts, len(key)), pa.int32())

        def each(values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(offsets, values)

        kept = [each(rows.column(c).combine_chunks().take(pa.array(row))) for c in ("chunk_id", *keep)]
        firsts = np.add.reduceat(first, starts) if len(starts) else first
        columns = [coded.dictionary.take(pa.array(of[starts] % n)), pa.array(at + of[starts] // n, pa.int64()), pa.array(firsts, pa.int64()), each(pa.array(length[row], pa.int32())), each(pa.array(tf, pa.int32())), *kept]
        return pa.record_batch(columns, names=["token", "block", "firsts", "dls", "tfs", "chunk_id", *keep])

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = (TaskContext.get().partitionId() << 33) // block, None
        for batch in given:
            rows = pa.Table.from_batches([batch])
            rows = rows if left is None else pa.concat_tables([left, rows])
            whole = rows.num_rows // block * block
            if whole:
                yield posted(rows.slice(0, whole), at)
            at, left = at + whole // block, rows.slice(whole)
        if left is not None and left.num_rows:
            yield posted(left, at)

    return run


def build(corpus: DataFrame, at: str, keep: tuple[str, ...] = (), block: int = BLOCK) -> Index:
    """Index ``corpus`` (chunk_id, text and the kept columns) into the folder ``at``, in
    place of what is there.  Texts are read and tokenized once, and a block's chunks put
    together where they are read: what is shuffled, once, has a row a token and block.
    Chunks that stand together and are alike make blocks of which more can be skipped."""
    spark = corpus.sparkSession
    docs = lexical.tokenized(corpus, *keep)
    each = "".join(f", `{c}` array<{batches.kind_of(docs, c)}>" for c in ("chunk_id", *keep))
    counts = stored(batches.map_arrow(docs, _posted(keep, block), f"token string, block long, firsts long, dls array<int>, tfs array<int>{each}"), "index-counts")
    n = F.sum("firsts")  # once for each chunk with a token
    tokens = F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x))
    totals = counts.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n_docs"), F.coalesce(F.try_divide(tokens, n), F.lit(0.0)).cast("double").alias("avg_dl"))
    totals.write.mode("overwrite").parquet(f"{at}/totals")
    index = Index(spark, at)
    corpus.limit(0).select("chunk_id", F.lit(0.0).alias("impact"), *keep).coalesce(1).write.mode("overwrite").parquet(f"{at}/kept")
    splits = index.totals.first().n_docs // TOGETHER + 1
    dealt = counts.drop("firsts").withColumns({"folder": _folder("token"), "split": F.pmod(F.col("block"), F.lit(splits))}).repartition("folder", "split")
    zipped = F.arrays_zip("chunk_id", "dls", "tfs", *keep)
    entries = F.transform(zipped, lambda e: F.struct(e["chunk_id"].alias("chunk_id"), lexical.norm_tf(e["tfs"], e["dls"], F.col("avg_dl")).alias("impact"), *[e[c].alias(c) for c in keep]))
    # sorted before the entries are made: what is sorted, and perhaps spilled, is smaller
    rows = dealt.join(F.broadcast(index.totals.select("avg_dl"))).sortWithinPartitions("folder", "token", "block").withColumn("entries", entries)
    postings = rows.select("token", "block", F.array_max(F.transform("entries", lambda e: e["impact"])).alias("most"), "entries", F.size("entries").alias("n"), "folder")
    with work.cleaned(spark):
        postings.write.mode("overwrite").partitionBy("folder").parquet(f"{at}/postings")
    work.drop(counts)
    df = index.postings.groupBy("folder", "token").agg(F.sum("n").cast("long").alias("df"), F.max("most").alias("most"))
    with work.cleaned(spark):
        df.repartition("folder").sortWithinPartitions("folder", "token").write.mode("overwrite").partitionBy("folder").parquet(f"{at}/tokens")
    return index


def weights(index: Index, terms: DataFrame, named: Column, min_df: int = lexical.MIN_DF) -> DataFrame:
    """``terms`` (query_id, token, ...) that are indexed, with w, what a token's impact is
    multiplied by, and the most that it can give."""
    n, df = F.col("n_docs"), F.col("df")
    idf = F.when(df >= min_df, lexical.known_idf(n, df)).otherwise(lexical.unseen_idf(n))
    rows = terms.join(index.tokens.filter(named).drop("folder"), "token").join(F.broadcast(index.totals.select("n_docs")))
    return rows.withColumn("w", idf * idf).withColumn("most", F.col("w") * F.col("most")).drop("df", "n_docs")


def where_named(terms: DataFrame) -> Column:
    """The condition that leaves the scan the folders and, if they are few, the tokens that
    ``terms`` names."""
    tokens = terms.select("token", _folder("token").alias("folder")).distinct().limit(NAMED + 1).collect()
    if len(tokens) <= NAMED:
        return F.col("folder").isin(sorted({r.folder for r in tokens})) & F.col("token").isin([r.token for r in tokens]) if tokens else F.lit(False)
    folders = terms.select(_folder("token").alias("folder")).distinct().collect()  # FOLDERS at most
    return F.col("folder").isin([r.folder for r in folders])


@dataclass(frozen=True)
class Asked:
    """A batch of queries before an index: weighted terms, the postings that may hold them,
    and bounds (query_id, block, bound)."""

    terms: DataFrame
    postings: DataFrame
    bounds: DataFrame


def asked(index: Index, queries: DataFrame, *keep: str, min_df: int = lexical.MIN_DF) -> Asked:
    plain = stored(lexical.query_terms(queries, *keep), "index-asked")
    named = where_named(plain)
    terms = stored(weights(index, plain, named, min_df), "index-terms")
    postings = index.postings.filter(named)
    return Asked(terms, postings, stored(_bounds(postings, terms), "index-bounds"))


def _bounds(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """What the terms can give a chunk, by query and block.  No entry is read."""
    heads = postings.select("token", "block", F.col("most").alias("greatest")).join(few(terms.select("query_id", "token", "w")), "token")
    return heads.groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("greatest")).alias("bound"))


def _entries(postings: DataFrame, terms: DataFrame, blocks: DataFrame, keep: tuple[str, ...], passes: Column | None) -> DataFrame:
    """query_id, block, chunk_id, kept columns and what each term gives the chunk, for the
    entries of the blocks (query_id, block, and perhaps the only chunks wanted) that pass
    the filter."""
    wanted = blocks.join(few(terms.select("query_id", "token", "w", *keep)), "query_id")
    entries = F.filter("entries", lambda e: F.array_contains("chunks", e["chunk_id"])) if "chunks" in blocks.columns else F.col("entries")
    rows = postings.select("token", "block", "entries").join(wanted, ["token", "block"]).select("query_id", "block", "w", *keep, F.inline(entries))
    rows = rows if passes is None else rows.filter(passes)
    return rows.select("query_id", "block", "chunk_id", *keep, (F.col("w") * F.col("impact")).alias("part"))


def probed(found: Asked, probe: int = PROBE) -> DataFrame:
    """query_id, block: the most promising blocks of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    return found.bounds.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= probe).select("query_id", "block")


def reached(scores: DataFrame, k: Column) -> DataFrame:
    """query_id and its k-th score, for queries that have so many."""
    return lexical.top(scores, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))


def possible(found: Asked, first: DataFrame, reach: DataFrame) -> DataFrame:
    """query_id, block: further blocks that may hold one of the k best."""
    rows = found.bounds.join(first, ["query_id", "block"], "left_anti").join(reach, "query_id", "left")
    return rows.filter(F.col("bound") + SLACK >= F.coalesce("reached", F.lit(float("-inf")))).select("query_id", "block")


def weak_terms(found: Asked, reach: DataFrame) -> DataFrame:
    """The terms with ``weak``: whether it and all weaker terms of its query together stay
    below the score that was reached."""
    sums = F.sum("most").over(Window.partitionBy("query_id").orderBy("most", "token").rowsBetween(Window.unboundedPreceding, 0))
    return found.terms.withColumn("_sum", sums).join(reach, "query_id", "left").withColumn("weak", F.coalesce(F.col("_sum") + SLACK < F.col("reached"), F.lit(False))).drop("_sum")


def candidates(found: Asked, terms: DataFrame, blocks: DataFrame, keep: tuple[str, ...], passes: Column | None) -> DataFrame:
    """query_id, block, chunk_id, kept columns, part: the sum of the strong terms of chunks
    that may reach the score with what the weak terms can give in their block."""
    strong, weak = terms.filter("NOT weak"), terms.filter("weak")
    sums = _entries(found.postings, strong, blocks, keep, passes).groupBy("query_id", "block", "chunk_id", *keep).agg(F.sum("part").alias("part"))
    left = _bounds(found.postings, weak)
    goal = terms.groupBy("query_id").agg(F.max("reached").alias("reached"))
    rows = sums.join(left, ["query_id", "block"], "left").join(goal, "query_id")
    return rows.filter(F.col("part") + F.coalesce("bound", F.lit(0.0)) + SLACK >= F.coalesce("reached", F.lit(float("-inf")))).drop("bound", "reached")


def search(index: Index, queries: DataFrame, top_k: int | str, allowed: Column | None = None, within: tuple[str, str] | None = None, min_df: int = lexical.MIN_DF) -> DataFrame:
    """query_id, chunk_id, score, rank, as ``lexical.search`` of the indexed corpus.
    ``allowed`` and the column of ``within`` are about kept columns."""
    cut = (top_k,) if isinstance(top_k, str) else ()
    keep = (*cut, *((within[0],) if within else ()))
    k = F.col(top_k) if cut else F.lit(top_k)
    found = asked(index, queries, *keep, min_df=min_df)
    passes = allowed
    if within:
        inside = (F.size(within[0]) == 0) | F.array_contains(within[0], F.col(within[1]))
        passes = inside if passes is None else passes & inside
    per = ("query_id", "chunk_id", *keep)
    first_blocks = probed(found)
    whole = _entries(found.postings, found.terms, first_blocks, keep, passes).groupBy(*per).agg(F.round(F.sum("part"), 6).alias("score"))
    whole = stored(whole, "index-first")
    reach = stored(reached(whole, k), "index-reached")
    terms = stored(weak_terms(found, reach), "index-weak")
    may = stored(candidates(found, terms, possible(found, first_blocks, reach), keep, passes), "index-candidates")
    # at most BLOCK chunks a row
    left = may.groupBy("query_id", "block").agg(F.collect_set("chunk_id").alias("chunks"))
    others = _entries(found.postings, terms.filter("weak"), left, keep, passes)
    late = may.select(*per, "part").unionByName(others.select(*per, "part")).groupBy(*per).agg(F.round(F.sum("part"), 6).alias("score"))
    return lexical.top(whole.unionByName(late), k).select("query_id", "chunk_id", "score", "rank")
