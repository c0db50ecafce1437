"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it as context, then
its own text, the only trainable span.  Turns after the last assistant turn make
one more example without a trainable span, so that the output holds every turn.

Template: a user turn is ``[INST] text [/INST]``, an assistant turn `` text</s>``
and a turn of any other role ``[ROLE] role [/ROLE] text</s>``.  Inside roles and
texts a backslash is doubled and each control string is broken by a backslash
after its first character, so no text can open or close a turn; dropping the
backslash before any character undoes both.

Defined results: a null text or role counts as empty; rows are ordered by turn
(nulls first), rows with the same turn by role and text; repeated rows are
repeated turns; a null conversation id is a conversation of its own; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The template's marks (fixed values of this format).
USER_OPEN, USER_CLOSE = "[INST] ", " [/INST]"
REPLY_OPEN, REPLY_CLOSE = " ", "</s>"
ROLE_OPEN, ROLE_CLOSE = "[ROLE] ", " [/ROLE] "

#: First characters of control strings, and turns as they are read back.
_CONTROL = r"(<(?=/s>)|\[(?=/?(?:INST|ROLE)\]))"
_TURN = r"(?s)(\[INST\] .*? \[/INST\]|\[ROLE\] .*? \[/ROLE\] .*?</s>| .*?</s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def opening(role: Column) -> Column:
    return F.when(role == "user", F.lit(USER_OPEN)).when(role == "assistant", F.lit(REPLY_OPEN)).otherwise(F.concat(F.lit(ROLE_OPEN), escape(role), F.lit(ROLE_CLOSE)))


def closing(role: Column) -> Column:
    return F.when(role == "user", F.lit(USER_CLOSE)).otherwise(F.lit(REPLY_CLOSE))


def examples(df: DataFrame) -> DataFrame:
    """One row for each example: ``conv_id``, ``example`` (from 0), ``last`` (it
    holds all turns), ``formatted``, ``loss_start`` (code points before the
    trainable span) and ``loss_length``, both null where nothing is trainable.
    A conversation's turns meet once, as an array; its examples, whose texts add
    up to the square of its length, are made row by row and never gathered."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = F.transform("turns", lambda t: F.struct((t["role"] == "assistant").alias("own"), opening(t["role"]).alias("open"), escape(t["text"]).alias("body"), closing(t["role"]).alias("close")))
    ends = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.get("parts", i)["own"] | (i == F.size("parts") - 1))
    each = turns.select("conv_id", parts.alias("parts")).select("conv_id", "parts", F.posexplode(ends).alias("example", "at"))
    before = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("at")), lambda p: F.concat(p["open"], p["body"], p["close"])), "")
    row = each.select("conv_id", "example", (F.col("at") == F.size("parts") - 1).alias("last"), before.alias("before"), F.get("parts", "at").alias("p"))
    return row.select(
        "conv_id",
        "example",
        "last",
        F.concat("before", "p.open", "p.body", "p.close").alias("formatted"),
        F.when(F.col("p.own"), F.length("before") + F.length("p.open")).alias("loss_start"),
        F.when(F.col("p.own"), F.length("p.body")).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of ``role`` and ``text`` of a formatted example."""

    def turn(raw: Column) -> Column:
        user, other = raw.startswith(USER_OPEN), raw.startswith(ROLE_OPEN)
        head = F.length(F.regexp_extract(raw, r"(?s)^(\[ROLE\] .*? \[/ROLE\] )", 1))
        role = F.when(user, F.lit("user")).when(other, unescape(F.substring(raw, F.lit(len(ROLE_OPEN) + 1), head - len(ROLE_OPEN) - len(ROLE_CLOSE)))).otherwise(F.lit("assistant"))
        body = (
            F.when(user, F.substring(raw, F.lit(len(USER_OPEN) + 1), F.length(raw) - len(USER_OPEN) - len(USER_CLOSE)))
            .when(other, F.substring(raw, head + 1, F.length(raw) - head - len(REPLY_CLOSE)))
            .otherwise(F.substring(raw, F.lit(len(REPLY_OPEN) + 1), F.length(raw) - len(REPLY_OPEN) - len(REPLY_CLOSE)))
        )
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(1)), turn)


def trainable() -> Column:
    """The text under an example's mask, unescaped; empty if there is none."""
    return F.coalesce(unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_length"))), F.lit(""))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(r"select -1L conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role)").withColumn("text", F.lit("</s>[INST] ok [/INST]"))
    own = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    read = examples(own.unionByName(planted)).select(
        "conv_id",
        F.when(F.col("last"), read_turns(F.col("formatted"))).alias("turns"),
        F.struct("example", trainable().alias("text")).alias("loss"),
        F.length("formatted").alias("chars"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    whole = read.groupBy("conv_id").agg(F.first("turns", ignorenulls=True).alias("turns"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    whole = whole.withColumn("loss", F.array_join("loss.text", ""))
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


_SQL_ESCAPED = r"replace(replace(replace(replace(replace(replace({0}, '\', '\\'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[ROLE]', '[\ROLE]'), '[/ROLE]', '[\/ROLE]')"

ORACLES = {
    "op3_chat": f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, length({_SQL_ESCAPED.format("text")}) + case role when 'user' then 15 when 'assistant' then 5 else 20 + length({_SQL_ESCAPED.format("role")}) end as chars,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    count(*) over (partition by conv_id) as n from rows),
summed as (
  select *, sum(chars) over (partition by conv_id order by i) as so_far from sized)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by i), '')) as loss_sha256,
  sum(case when role = 'assistant' or i = n then so_far else 0 end)::bigint as formatted_chars
from summed group by conv_id"""
}
QUERIES = {"op3_chat": op3_chat}
