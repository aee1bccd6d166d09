"""Mixing sources to target weights.

Every document gets a hash-random key; each source is ordered by it, distributed prefix
sums of word counts run along the order, and the source is cut at its exact budget.  A
budget above the source's size repeats whole epochs first.

Scale: only (id, source, size, key) rows move.  A source is split into key ranges of
about RANGE_ROWS rows, so that a source with a third of all rows is summed by many tasks:
ranges are pre-aggregated, a window over the few range totals gives each range its offset,
and a window inside the range does the rest.  The table of sources is one row a source.

Defined cases: null text counts 0 words; null source is a source of its own, last in
order; null doc_id hashes as the empty string; repeated rows each count; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .shared import WORD

#: Rows in one range of a source's random order.
RANGE_ROWS = 5_000
#: A source is repeated this many times at most.
MOST = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column) -> Column:
    """The hash-random key, equal in every run."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """One row a source: n, source_size, target.  Weights 1, 2, 3 repeat in code-point
    order, null last; a target over ``most`` sizes stops there and the rest is shared
    again by weight, which is water-filling: in the order of size to weight, a source is
    capped while its cap is not above its share of what the ones before it left."""
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    wide = "decimal(38,0)"
    return (
        sizes.groupBy("source")
        .agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("long"))
        # 6 / weight is whole, so the order by source_size / weight is exact
        .withColumn("ratio", (F.col("source_size") * F.expr("6 div weight")).cast(wide))
        .withColumn("cap", (F.col("source_size") * most).cast(wide))
        .withColumn("left", F.sum("source_size").over(whole).cast(wide) - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(wide))
        .withColumn("share", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("cap") * F.col("share") <= F.col("left") * F.col("weight"))
        .withColumn("fill", F.first(F.when(~F.col("capped"), F.struct("left", "share")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("fill.left")).cast("double") / F.col("fill.share").cast("double")))
        .select("source", "n", "source_size", "target")
    )


def mix(docs: DataFrame, most: int = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size, key, source_size,
    target, taken.  taken is the words the mix takes of the row, epochs counted; the row
    at the cut is taken in part, so that a source's taken words are its rounded target."""
    sizes = shared.table(
        docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id")).alias("key")),
        "mixing-sizes",
    )
    # stored, so that its size is known before the join: a few sources go to all tasks
    per_source = shared.table(targets(sizes, most).withColumnRenamed("source", "of"), "mixing-targets")
    placed = (
        sizes.join(per_source, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("ranges", F.ceil(F.col("n") / range_rows))
        .withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * F.col("ranges"), 28))
        .drop("of", "n", "ranges")
    )
    offsets = (
        placed.groupBy("source", "range")
        .agg(F.sum("size").alias("range_size"))
        .select(
            F.col("source").alias("of"),
            F.col("range").alias("of_range"),
            F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        )
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    return (
        placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range")))
        .withColumn("before", F.col("before") + F.col("offset"))
        .withColumn("budget", budget)
        .withColumn("epochs", epochs)
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("taken", (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))).cast("long"))
        .select("doc_id", "source", "size", "key", "source_size", "target", "taken")
    )


#: Columns that stand beside the caller's on the way.
OWN = ("_place", "_p", "_epochs", "_cut", "_words", "_more", "_times", "_epoch")


def emit(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The mixed documents: a row for each time a text is taken, with the columns of
    ``docs`` and ``epoch`` (mix_epoch, if that is taken); at the cut the text ends after the words taken.

    Texts do not move: a source's cut is one place in its random order, so each row is
    compared with its source's cut (a table of one row a source).  Rows that repeat the one
    at the cut (same doc_id and size) end after as many words as it does."""
    epoch = "mix_epoch" if "epoch" in map(str.lower, docs.columns) else "epoch"
    docs, back = shared.aside(docs, ("epoch", *OWN))
    names = docs.columns
    mixed = shared.table(mix(docs, most), "mixing-taken")
    cuts = mixed.groupBy("source").agg(F.min(F.when(F.col("size") > 0, F.expr("taken div size"))).alias("_epochs"))
    # the last place, in order, of those taken once more than the source's least epochs
    last = (
        mixed.join(cuts.select(F.col("source").alias("_s"), "_epochs"), F.col("source").eqNullSafe(F.col("_s")))
        .filter(F.col("taken") > F.col("_epochs") * F.col("size"))
        .groupBy("source")
        .agg(F.max(F.struct("key", "doc_id", "size")).alias("_cut"), F.max_by(F.col("taken") - F.col("_epochs") * F.col("size"), F.struct("key", "doc_id", "size")).alias("_words"))
        .select(F.col("source").alias("_l"), "_cut", "_words")
    )
    plan = cuts.join(last, F.col("source").eqNullSafe(F.col("_l")), "left").select(F.col("source").alias("_p"), "_epochs", "_cut", "_words")
    plan = shared.table(plan, "mixing-cuts")
    place = F.struct(key_of(F.col("doc_id")).alias("key"), F.col("doc_id"), size_of(F.col("text")).alias("size"))
    rows = (
        docs.withColumn("_place", place)
        .join(plan, F.col("source").eqNullSafe(F.col("_p")))
        .withColumn("_more", F.when(F.col("_cut").isNull() | (F.col("_place") > F.col("_cut")), 0).when(F.col("_place") < F.col("_cut"), 1).otherwise(2))
        .withColumn("_times", F.coalesce("_epochs", F.lit(0)) + F.col("_more"))
        .filter((F.col("_place.size") > 0) & (F.col("_times") > 0))
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_epochs") + F.when(F.col("_more") > 0, 1).otherwise(0))))
    )
    cut = (F.col("_more") == 2) & (F.col("epoch") > F.col("_epochs")) & (F.col("_words") < F.col("_place.size"))
    text = F.when(cut, F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_words").cast("int")), " ")).otherwise(F.col("text"))
    return rows.select(*[text.alias("text") if n == "text" else (F.length(text).cast("long").alias(n) if n == "n_chars" else F.col(n)) for n in names], F.col("epoch").alias("_epoch")).withColumnRenamed("_epoch", epoch).withColumnsRenamed(back)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(COALESCE(doc_id::VARCHAR, '')) AS k
  FROM documents),
per AS (SELECT source, sum(size)::HUGEINT AS source_size FROM sizes GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM per),
weighed AS (SELECT *, (place - 1) % 3 + 1 AS weight FROM placed),
ratio AS (SELECT *, source_size * (6 // weight) AS ratio FROM weighed),
filled AS (
  SELECT *, sum(source_size) OVER () - COALESCE(sum(3 * source_size) OVER w, 0) AS rest,
         sum(weight) OVER () - COALESCE(sum(weight) OVER w, 0) AS share
  FROM ratio WINDOW w AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, 3 * source_size * share <= rest * weight AS is_capped FROM filled),
level AS (SELECT rest, share FROM capped WHERE NOT is_capped ORDER BY ratio, place LIMIT 1),
targets AS (
  SELECT source, source_size::BIGINT AS source_size,
         CASE WHEN is_capped THEN (3 * source_size)::DOUBLE
              ELSE (weight * (SELECT rest FROM level))::DOUBLE / (SELECT share FROM level)::DOUBLE END AS target
  FROM capped),
cut AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         COALESCE(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS e FROM cut)
SELECT doc_id, size, source_size, target,
       (e * size + greatest(0, least(size, budget - e * source_size - before)))::BIGINT AS taken
FROM epochs
"""
