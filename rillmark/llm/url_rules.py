"""URL filters: a sort-merge range join of hosts with nested prefix rules.

A host's key is its labels in reverse, each followed by ``/``, which no host contains.
A rule fits the keys that start with its own, which is an interval of the sort order, and
such intervals nest.  The sweep goes through rules and hosts in key order with a stack:
where a rule's interval begins, the rules that have ended (their keys are no beginning of
this one) are popped, and the rule is pushed; a host pops likewise and finds the rules that
are active for it.  A rule's path holds for all subdomains, so it bounds no interval: within
the stack the longest rule whose path is a prefix of the url's wins.

Scale: only the distinct hosts are swept, so a host with a third of all rows is one row.
They are range-partitioned by key into a table.  Each range folds its own rules into
stacks; what is open at a range's start comes from a second fold over one row a range; a
window inside the range brings each host the last stack before it.  The verdict's stack
joins back by host; Spark broadcasts that side only below its size threshold, and splits a
hot host of a sort-merge join otherwise.  html is not read.

Defined cases: url null or without ``://``: host and path empty, no rule, default verdict;
repeated rows are judged each; empty tables give empty results; a rule of the same length
as another loses to the longer host, then to the smaller text; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: The rules of the contract: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The verdict where no rule fits.
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return shared.lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS t(host, path, verdict)")


#: A stack of rules, the outermost first.
STACK = "array<struct<key:string,host:string,path:string,verdict:string>>"


def begins(rules: DataFrame) -> DataFrame:
    """One row a rule host: the key where its interval begins, and its own rules."""
    host = shared.lower_ascii(F.col("host"))
    return (
        rules.select(host_key(host).alias("key"), F.struct(host_key(host).alias("key"), host.alias("host"), "path", "verdict").alias("rule"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_set("rule")).alias("own"))
    )


def open_at(stack: Column, key: Column) -> Column:
    """The stack without the rules that have ended before ``key``."""
    return F.filter(stack, lambda r: F.startswith(key, r["key"]))


def _fold(steps: Column, out_type: str, stack_after, out_of) -> Column:
    """Goes through ``steps`` with a stack and gathers what ``out_of`` makes of a step, the
    stack before it and the stack after it."""
    zero = F.struct(F.array().cast(STACK).alias("stack"), F.array().cast(f"array<{out_type}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return shared.let(
            stack_after(acc["stack"], x),
            lambda stack: F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(out_of(x, acc["stack"], stack))).alias("out")),
        )

    return F.aggregate(steps, zero, step)


def sweep(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct host of ``hosts`` that lies in a rule's interval: host and the stack
    of rules active there."""
    starts = begins(rules).select("key", F.lit(None).cast("string").alias("host"), "own")
    points = hosts.select(host_key(F.col("host")).alias("key"), "host", F.lit(None).cast(STACK).alias("own"))
    n = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = shared.table(starts.unionByName(points).repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "url-order")
    pushed = _fold(
        F.col("rules"),
        f"struct<key:string,stack:{STACK}>",
        lambda stack, x: F.concat(open_at(stack, x["key"]), x["own"]),
        lambda x, _, stack: F.struct(x["key"].alias("key"), stack.alias("stack")),
    )
    ranges = (
        ordered.groupBy("part")
        .agg(F.sort_array(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("key", "own")))).alias("rules"))
        .select("part", F.get(F.col("rules.key"), F.size("rules") - 1).alias("last"), pushed.alias("pushed"))
    )
    ranges = shared.table(ranges.select("part", "last", "pushed.stack", F.col("pushed.out").alias("begun")), "url-ranges")
    carried = _fold(
        F.col("ranges"),
        f"struct<part:int,stack:{STACK}>",
        lambda stack, x: F.when(x["last"].isNull(), stack).otherwise(F.concat(open_at(stack, x["last"]), x["stack"])),
        lambda x, before, _: F.struct(x["part"].alias("part"), before.alias("stack")),
    )
    carried = ranges.groupBy().agg(F.sort_array(F.collect_list(F.struct("part", "last", "stack"))).alias("ranges")).select(F.explode(carried["out"]).alias("c"))
    stacks = ranges.select("part", F.explode("begun").alias("b")).select("part", "b.key", F.lit(None).cast("string").alias("host"), "b.stack")
    to_here = Window.partitionBy("part").orderBy("key", F.col("host").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ordered.filter("own IS NULL")
        .select("part", "key", "host", F.lit(None).cast(STACK).alias("stack"))
        .unionByName(stacks)
        .withColumn("begun", F.last("stack", ignorenulls=True).over(to_here))
        .filter("host IS NOT NULL")
        .join(carried.select(F.col("c.part").alias("of_part"), F.col("c.stack").alias("carried")), F.col("part") == F.col("of_part"))
        .select("host", open_at(F.concat("carried", F.coalesce("begun", F.array().cast(STACK))), F.col("key")).alias("active"))
        .filter(F.size("active") > 0)
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    active = sweep(rows.select("host").distinct(), rules)
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    rank = F.transform(fits, lambda r: F.struct((-F.length(r["host"]) - F.length(r["path"])).alias("a"), (-F.length(r["host"])).alias("b"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))
    return (
        rows.join(active, "host", "left")
        .withColumn("best", F.array_min(rank))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(shared.read(spark, sf_dir, "pages"), rules_frame(spark))


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
rules(rule_host, rule_path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
ranked AS (
  SELECT u.page_id, u.host, u.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.rule_host || r.rule_path) DESC) AS place
  FROM (SELECT DISTINCT * FROM urls) u
  LEFT JOIN rules r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path))
SELECT u.page_id, u.host, u.path, k.rule, COALESCE(k.verdict, 'allow') AS verdict
FROM urls u JOIN ranked k ON k.place = 1 AND u.page_id IS NOT DISTINCT FROM k.page_id AND u.host = k.host AND u.path = k.path
"""
