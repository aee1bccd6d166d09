"""Large JSON files of several sections, cut into records by many tasks.

A file is one object whose keys name sections, arrays of records:
``{"terms": [{...}, {...}], "links": [...]}``, on one line or on many.  Spark reads it in
splits, as pieces that end with a closing brace.  Whether a piece begins within a string, and
how many braces are open there, depends on all pieces before it, so both are prefix sums:
within a split by a window, over splits by a window with a row for each split.  Sums over a
split are taken for both ways it may begin, so two scans are enough, and the text is shuffled
once, by split.  Records that lie in one piece are whole; the others, nested ones and those
that span splits, are put together by the place of their beginning.

Line breaks are never inside a JSON string, so a lost quote does harm to the end of its line
only; a brace too many does none.  A record that lacks a closing brace takes the records after
it with it, to the end of the file, and is one bad record.  So is the last one of a file that
was cut off.  Keys of the top level whose values are no arrays of objects are left out, and
so are objects that lie in an array within a section's array.  Empty files and sections give
no rows.  Repeated records, and sections that occur twice, are all read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .statutes import SECTIONS
from .work import drop, stored

#: What stands before the first brace outside strings.
LEAD = r'(?s)^([^"{]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^"{]*+)*+)\{'
#: A key right before that brace, and the bracket of its array.
KEY = r'"([^"]*)"\s*:\s*(\[?)[\s,]*$'


def _split(earlier: bool = False) -> WindowSpec:
    """A split's pieces up to this one, or up to the one before."""
    w = Window.partitionBy("file", "block").orderBy("seq")
    return w.rowsBetween(Window.unboundedPreceding, -1 if earlier else 0)


def _file(earlier: bool = False) -> WindowSpec:
    """The same for the splits of a file."""
    w = Window.partitionBy("file").orderBy("block")
    return w.rowsBetween(Window.unboundedPreceding, -1 if earlier else 0)


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _sum_before(c: Column | str, w: WindowSpec) -> Column:
    return F.coalesce(F.sum(c).over(w), F.lit(0))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces with their place and, for a piece that begins outside (0) or within (1) a
    string, the change of depth, and whether it ends within one."""
    rows = spark.read.option("lineSep", "}").text(path)
    meta = F.col("_metadata")
    rows = rows.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.monotonically_increasing_id().alias("seq"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    rest = F.substring_index(plain, "\n", -1)
    broken = F.instr(plain, "\n") > 0
    rows = rows.withColumns({"bytes": F.octet_length("value") + 1, "quotes": _count(plain, '"'), "upto": F.when(broken, _count(plain, '"') - _count(rest, '"'))})
    for s in (0, 1):
        bare = F.regexp_replace(F.concat(F.lit('"' * s), plain), r'"[^"\n]*+(?:["\n]|$)', "")
        end = F.when(F.col("upto").isNotNull(), (F.col("quotes") - F.col("upto")) % 2).otherwise((F.col("quotes") + s) % 2)
        rows = rows.withColumns({f"opens{s}": _count(bare, "{"), f"end{s}": end})
    return rows


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds ``in0`` and ``in1``, whether a piece begins within a string if its split does not
    or does, and ``sum0`` and ``sum1``, the changes of depth from the split's beginning on."""
    rows = pieces.withColumn("passed", _sum_before("quotes", _split(True)))
    rows = rows.withColumn("line", F.max(F.col("passed") + F.col("upto")).over(_split(True)))
    for s in (0, 1):
        rows = rows.withColumn(f"in{s}", F.when(F.col("line").isNotNull(), (F.col("passed") - F.col("line")) % 2).otherwise((F.col("passed") + s) % 2))
    for s in (0, 1):
        change = F.when(F.col(f"in{s}") == 0, F.col("opens0") - (1 - F.col("end0"))).otherwise(F.col("opens1") - (1 - F.col("end1")))
        rows = rows.withColumn(f"sum{s}", F.sum(change).over(_split()))
    return rows


def _splits(placed: DataFrame) -> DataFrame:
    """For each split: whether it begins within a string, the sum of changes before it, the
    least sum so far, and whether the file's last piece is cut off."""
    per = placed.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"),
        F.max(F.col("passed") + F.col("upto")).alias("line"),
        F.sum("bytes").alias("bytes"),
        F.max("size").alias("size"),
        *[F.max_by(f"sum{s}", "seq").alias(f"sum{s}") for s in (0, 1)],
        *[F.min(f"sum{s}").alias(f"low{s}") for s in (0, 1)],
    )
    rows = per.withColumn("passed", _sum_before("quotes", _file(True)))
    rows = rows.withColumn("line", F.max(F.col("passed") + F.col("line")).over(_file(True)))
    rows = rows.withColumn("begins", (F.col("passed") - F.coalesce("line", F.lit(0))) % 2)
    for name in ("sum", "low"):
        rows = rows.withColumn(name, F.when(F.col("begins") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")))
    rows = rows.withColumn("depth", _sum_before("sum", _file(True)))
    rows = rows.withColumn("low", F.min(F.col("depth") + F.col("low")).over(_file(True)))
    # a file that ends with a brace has as many bytes as its pieces with one each; a byte
    # order mark is not part of a piece
    over = F.sum("bytes").over(Window.partitionBy("file")) - F.col("size")
    last = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    return rows.select("file", "block", "begins", "depth", "low", (last & over.isin(1, -2)).alias("cut"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all sections in files: file, block and seq (where they begin), section,
    body (JSON text)."""
    placed = _placed(_pieces(spark, path))
    splits = stored(_splits(placed), "splits")
    rows = placed.join(splits, ["file", "block"])

    def begun(name: str) -> Column:
        return F.when(F.col("begins") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    rows = rows.withColumns({"within": begun("in"), "after": F.col("depth") + begun("sum")})
    opens = F.when(F.col("within") == 0, F.col("opens0")).otherwise(F.col("opens1"))
    end = F.when(F.col("within") == 0, F.col("end0")).otherwise(F.col("end1"))
    rows = rows.withColumns({"opens": opens, "closes": 1 - end, "lost": F.col("cut") & F.lead("seq").over(Window.partitionBy("file", "block").orderBy("seq")).isNull()})
    # depth never falls below one once the file has begun: what was closed too often is added
    least = F.least("low", F.min("after").over(_split(True)))
    rows = rows.withColumn("before", F.col("after") - F.col("opens") + F.col("closes") + F.greatest(F.lit(0), 1 - F.coalesce(least, F.lit(1))))
    rows = rows.withColumn("starts", ((F.col("before") == 0) & (F.col("opens") > 1)) | ((F.col("before") == 1) & (F.col("opens") > 0)))
    body = F.when(F.col("before") == 0, F.regexp_replace("value", r"^[^{]*+\{", "")).otherwise(F.concat(F.when(F.col("within") == 1, '"').otherwise(""), "value"))
    rows = rows.withColumn("body", F.when(F.col("starts"), body))
    rows = rows.withColumn("lead", F.regexp_extract("body", LEAD, 1))
    key = F.when(F.col("starts") & F.col("lead").rlike(KEY), F.struct(F.regexp_extract("lead", KEY, 1).alias("name"), (F.regexp_extract("lead", KEY, 2) == "[").alias("array")))
    ends = (F.col("closes") == 1) & (F.col("before") + F.col("opens") - 1 == 1) & ~F.col("lost")
    ends = ends | ((F.col("before") == 0) & (F.col("closes") == 1) & (F.col("opens") == 2) & ~F.col("lost"))
    text = F.concat(F.when(F.col("starts"), F.substring(F.col("body"), F.length("lead") + 1, F.length("body"))).otherwise(F.col("value")), F.when(F.col("lost"), "").otherwise("}"))
    rows = rows.select(
        "file", "block", "seq",
        F.last(F.when(F.col("starts"), F.col("seq")), ignorenulls=True).over(_split()).alias("first"),
        F.last(key, ignorenulls=True).over(_split()).alias("key"),
        (F.col("starts") & ends).alias("whole"),
        (F.col("starts") | (F.col("before") > 1)).alias("inside"),
        text.alias("text"),
    )
    spent = [stored(rows.filter("inside").drop("inside"), "pieces"), splits]
    rows = spent[0]
    per = rows.groupBy("file", "block").agg(F.max("first").alias("first"), F.max_by("key", F.when(F.col("key").isNotNull(), F.col("seq"))).alias("key"))
    begun_at = F.when(F.col("first").isNotNull(), F.struct("block", F.col("first").alias("seq")))
    carried = per.select("file", "block", F.last(begun_at, ignorenulls=True).over(_file(True)).alias("_at"), F.last("key", ignorenulls=True).over(_file(True)).alias("_key"))
    rows = rows.join(carried, ["file", "block"]).withColumns({"at": F.coalesce(F.when(F.col("first").isNotNull(), F.struct("block", F.col("first").alias("seq"))), "_at"), "key": F.coalesce("key", "_key")})
    rows = rows.filter("key.array")
    alone = rows.filter("whole").select("file", "at", F.col("key.name").alias("section"), F.col("text").alias("body"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))), lambda x: x["text"]), "")
    parts = rows.filter("NOT whole").groupBy("file", "at").agg(F.max("key.name").alias("section"), joined.alias("body"))
    out = stored(alone.unionByName(parts).select("file", "at.block", "at.seq", "section", "body"), "records")
    for table in spent:
        drop(table)
    return out


def _read(found: DataFrame, name: str) -> DataFrame:
    schema = T.StructType.fromDDL(f"{SECTIONS[name]}, _corrupt string")
    read = F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return found.filter(F.col("section") == name).withColumn("r", read)


def section(found: DataFrame, name: str) -> DataFrame:
    """A section of ``records``, with its columns; records that are no JSON are left out."""
    return _read(found, name).filter("r._corrupt IS NULL").select("r.*").drop("_corrupt")


def bad(found: DataFrame, name: str) -> DataFrame:
    """The records that ``section`` leaves out: section, body."""
    return _read(found, name).filter("r._corrupt IS NOT NULL").select("section", "body")
