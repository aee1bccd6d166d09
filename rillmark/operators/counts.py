"""BM25 statistics of a keyed table that follow its inserts, updates and deletions.

A folder of counts belongs to a keyed table of chunks (``merging``; with a text).  It holds
sums of changes: for each token in how many more or fewer chunks it stands, and in a row
without token how many more or fewer chunks have a token, and tokens.  ``advance`` brings
the counts from the table's version that they were last taken of to its present one.  It
reads the buckets that differ between the two; other buckets are not read.  Within them it
tells the rows that have changed by key and a hash of the text, and counts only these: as
they were, off, and as they are, on.  Texts are shuffled only if the changed rows are too
many to be broadcast.  Every MOST changes are summed into one.

A manifest names the folders of a version and is put in place once.  Of two writers that
advance to the same version one finds it there and leaves it as it is.  Where the version
that was counted last is gone (``merging.vacuum``), all is counted anew; so advance first.

Defined cases: a chunk without text, or without a token in it, counts for nothing; an empty
table has no tokens, 0 chunks and an average length of 0.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.functions import hashing
from rillmark.functions import text as T
from rillmark.sources import work

from . import lexical, merging
from .sides import few

#: Changes that are kept apart before they are summed.
MOST = 16
SCHEMA = "token string, df long, tokens long"


@dataclass(frozen=True)
class Counts:
    spark: SparkSession
    at: str

    def manifest(self) -> dict | None:
        """The newest version: the table's version that is counted, and folders."""
        held = [int(n.removesuffix(".json")) for n in work.names(self.spark, f"{self.at}/manifests") if n.endswith(".json")]
        return json.loads(work.get(self.spark, f"{self.at}/manifests/{max(held)}.json")) if held else None

    def read(self) -> DataFrame:
        """token, df and tokens (0 but in the row without token: chunks and their tokens)."""
        held = self.manifest()
        return _summed(self._folders(held["folders"] if held else []))

    def _folders(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.at}/data/{f}" for f in folders])

    def totals(self) -> DataFrame:
        """One row: n_docs, avg_dl."""
        n = F.coalesce(F.sum("df"), F.lit(0))
        return self.read().filter("token IS NULL").agg(n.alias("n_docs"), F.coalesce(F.try_divide(F.sum("tokens"), n), F.lit(0.0)).cast("double").alias("avg_dl"))

    def idf_table(self, min_df: int = lexical.MIN_DF) -> DataFrame:
        """What ``lexical.idf_table`` gives for the table's chunks."""
        known = self.read().filter(F.col("token").isNotNull() & (F.col("df") >= min_df)).join(F.broadcast(self.totals()))
        return known.select("token", hashing.token_index(F.col("token")).alias("idx"), "df", lexical.known_idf(F.col("n_docs"), F.col("df")).alias("idf")).filter("idf > 0")

    def sparse(self, chunks: DataFrame, min_df: int = lexical.MIN_DF) -> DataFrame:
        """chunk_id, idx, weight: the sparse vectors of chunks under these counts, as
        ``lexical.doc_weights`` would weigh them within the whole table."""
        tokens = lexical.tokenized(chunks).select("chunk_id", F.size("toks").alias("dl"), F.explode("toks").alias("token"))
        tf = tokens.groupBy("chunk_id", "dl", "token").agg(F.count("*").alias("tf"))
        weighed = tf.join(self.idf_table(min_df).select("token", "idf"), "token", "left").join(F.broadcast(self.totals()))
        weight = F.coalesce("idf", lexical.unseen_idf(F.col("n_docs"))) * lexical.norm_tf(F.col("tf"), F.col("dl"), F.col("avg_dl"))
        return weighed.groupBy("chunk_id", hashing.token_index(F.col("token")).alias("idx")).agg(F.sum(weight).alias("weight")).filter("weight > 0")


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy("token").agg(F.sum("df").alias("df"), F.sum("tokens").alias("tokens")).filter("df <> 0 OR tokens <> 0")


def _counted(chunks: DataFrame, sign: int) -> DataFrame:
    toks = chunks.select(T.bm25_tokens(F.coalesce("text", F.lit(""))).alias("toks")).filter(F.size("toks") > 0)
    of_text = F.struct(F.lit(None).cast("string").alias("token"), F.size("toks").cast("long").alias("tokens"))
    of_token = F.transform(F.array_distinct("toks"), lambda t: F.struct(t.alias("token"), F.lit(0).cast("long").alias("tokens")))
    rows = toks.select(F.explode(F.concat(F.array(of_text), of_token)).alias("r"))
    return rows.select("r.token", F.lit(sign).cast("long").alias("df"), (F.col("r.tokens") * sign).alias("tokens"))


def _changed(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that only one side has.  A key stands once in each."""
    of = F.xxhash64(F.coalesce("text", F.lit("")))
    was, now = (d.select(F.col(key).alias("_key"), of.alias("_of"), "text") for d in (before, after))
    both = was.select("_key", "_of", F.lit(-1).alias("n")).unionByName(now.select("_key", "_of", F.lit(1).alias("n")))
    one = few(work.stored(both.groupBy("_key", "_of").agg(F.sum("n").alias("n")).filter("n <> 0").select("_key", "_of"), "changed"))
    return was.join(one, ["_key", "_of"], "left_semi"), now.join(one, ["_key", "_of"], "left_semi")


def advance(counts: Counts, table: merging.Table) -> int:
    """Count what has changed in the table; the table's version that is counted now."""
    spark, held = counts.spark, counts.manifest()
    version = max(table.versions())
    if held is not None and held["version"] >= version:
        return held["version"]
    since = held["version"] if held is not None and held["version"] in table.versions() else None
    kept = held["folders"] if since is not None else []
    before, after = merging.changed(table, since, version)
    if since is not None:
        before, after = _changed(before, after, table.manifest(version)["key"])
    name = uuid.uuid4().hex
    change = _summed(_counted(before, -1).unionByName(_counted(after, 1)))
    if len(kept) >= MOST:
        change, kept = _summed(counts._folders(kept).unionByName(change)), []
    with work.cleaned(spark):
        change.write.parquet(f"{counts.at}/data/{name}")
    manifest = {"version": version, "folders": [*kept, name]}
    if not work.put_once(spark, f"{counts.at}/manifests/{version}.json", json.dumps(manifest).encode()):
        work.delete(spark, f"{counts.at}/data/{name}")
    return version


def vacuum(counts: Counts) -> int:
    """Delete what the newest version does not name, while nobody advances or reads; how
    many folders went."""
    held = counts.manifest()
    if held is None:
        return 0
    spent = [n for n in work.names(counts.spark, f"{counts.at}/data") if n not in held["folders"]]
    for n in spent:
        work.delete(counts.spark, f"{counts.at}/data/{n}")
    for n in work.names(counts.spark, f"{counts.at}/manifests"):
        if n != f"{held['version']}.json":
            work.delete(counts.spark, f"{counts.at}/manifests/{n}")
    return len(spent)
