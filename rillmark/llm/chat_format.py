"""Chat formatting with a grammar round trip.

A turn is rendered as ``<s>[INST]role[/INST]text</s>``.  The rendered turn is read again by
a deterministic parser (control strings in this very order, nothing before or after); if
what it recovers is not the source, the turn's role and text are escaped, the turn is
rendered and read again.  Escaping removes the first character of every control string, so
this reading recovers the source; if it did not, the query would fail.  The formatted
conversation is parsed and compared as a whole too.  The loss mask is a list of offsets in
code points of the formatted text; ``masked`` reads what lies under it.

The escape character is U+241B; it, ``<`` and ``[`` become it and a digit.  Reading undoes
this for every turn, so a plain turn that happens to hold such a pair is escaped too.

Scale: rendering and checking are row by row.  Offsets are prefix sums by window, and a
conversation is put together once, as its own output row requires.

Defined cases: null role or text: empty; turns in order of turn (null first), then role,
then text; repeated turns stay; rows with null conv_id form one conversation; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .shared import let

#: The control strings of the template and the escapes.
BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"<s>|\[INST\]|\[/INST\]|</s>"
ESCAPE = "␛"
ESCAPES = ((ESCAPE, ESCAPE + "0"), ("<", ESCAPE + "1"), ("[", ESCAPE + "2"))


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN + ROLE), role, F.lit(TEXT), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, array<struct<role, text>>; null where the control
    strings do not follow the grammar."""
    found = F.struct(F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0)).alias("tokens"), F.split(formatted, CONTROL).alias("pieces"))

    def read(x: Column) -> Column:
        tokens, pieces = x["tokens"], x["pieces"]
        n = F.size(tokens)
        turns = F.transform(
            F.sequence(F.lit(0), (n / 4).cast("int") - 1),
            lambda i: F.struct(((F.get(pieces, i * 4) == "") & (F.get(pieces, i * 4 + 1) == "")).alias("clean"), unescape(F.get(pieces, i * 4 + 2)).alias("role"), unescape(F.get(pieces, i * 4 + 3)).alias("text")),
        )
        right = (n % 4 == 0) & (F.array_join(tokens, "") == F.repeat(F.lit(BEGIN + ROLE + TEXT + END), (n / 4).cast("int"))) & (F.get(pieces, n) == "")
        none = F.when(F.get(pieces, F.lit(0)) == "", F.array().cast("array<struct<role:string,text:string>>"))
        kept = F.when(right, let(turns, lambda t: F.when(F.forall(t, lambda y: y["clean"]), F.transform(t, lambda y: F.struct(y["role"].alias("role"), y["text"].alias("text"))))))
        return F.when(n == 0, none).otherwise(kept)

    return let(found, read)


def same_or_fail(read: Column, source: Column, good: Column) -> Column:
    """``good`` where what was read equals the source; else the query fails."""
    return F.when(F.coalesce(read == source, F.lit(False)), good).otherwise(F.raise_error(F.lit("chat formatting: the formatted text does not read back as its source")))


def render_turns(turns: DataFrame) -> DataFrame:
    """Per turn: conv_id, turn, role, text (nulls empty), escaped, rendered.  The plain
    rendering is kept where its reading gives back role and text, else the escaped one."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    plain = render(F.col("role"), F.col("text"))
    again = let(render(escape(F.col("role")), escape(F.col("text"))), lambda r: same_or_fail(parse(r), source, r))
    return (
        rows.withColumn("plain", plain)
        .withColumn("escaped", ~F.coalesce(parse(F.col("plain")) == source, F.lit(False)))
        .withColumn("rendered", F.when(F.col("escaped"), again).otherwise(F.col("plain")))
        .drop("plain")
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss_spans (start and end offsets of
    the assistant texts in code points) and turns, as read back from ``formatted``."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.length(F.lit(BEGIN + ROLE + TEXT))
    role = F.when(F.col("escaped"), escape(F.col("role"))).otherwise(F.col("role"))
    placed = (
        render_turns(turns)
        .withColumn("place", F.row_number().over(order))
        .withColumn("start", F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0)) + head + F.length(role))
        .withColumn("end", F.col("start") + F.length("rendered") - head - F.length(role) - F.length(F.lit(END)))
    )
    return (
        placed.groupBy("conv_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "rendered", "role", "text"))).alias("parts"),
            F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("start", "end")))).alias("loss_spans"),
        )
        .withColumn("formatted", F.array_join(F.transform("parts", lambda p: p["rendered"]), ""))
        .withColumn("source", F.transform("parts", lambda p: F.struct(p["role"].alias("role"), p["text"].alias("text"))))
        .select("conv_id", "formatted", "loss_spans", let(parse(F.col("formatted")), lambda t: same_or_fail(t, F.col("source"), t)).alias("turns"))
    )


def masked(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped.  Offsets are looked up in four bytes a code
    point, so that a span costs its own length."""
    read = lambda wide: F.transform(spans, lambda s: unescape(F.decode(F.substring(wide, (s["start"] * 4 + 1).cast("int"), ((s["end"] - s["start"]) * 4).cast("int")), "UTF-32")))
    return F.array_join(let(F.encode(formatted, "UTF-32"), read), "")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT CAST(conv_id AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM VALUES (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    chats = format_chats(shared.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    return (
        chats.withColumn("loss", masked(F.col("formatted"), F.col("loss_spans")))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, CASE WHEN regexp_matches(role || ' ' || text, '<s>|\[INST\]|\[/INST\]|</s>|␛[012]')
                 THEN length(role || text) + length(regexp_replace(role || text, '[^␛<\[]', '', 'g'))
                 ELSE length(role || text) END + 20 AS chars
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       COALESCE(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
