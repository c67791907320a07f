"""Multi-party perspective rotation of dialogues, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casegrain.llm.common import query, table

SYSTEM = "system"
UNNAMED = "unknown"
PART_TURNS = 64
PART_ROWS = 256

# The format's fixed marks.
OPEN, CLOSE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _cells(messages: DataFrame, part_turns: int, part_rows: int) -> DataFrame:
    """Messages with the part they belong to: ``turn_block`` and ``split``.

    A block holds ``part_turns`` consecutive turn numbers. A block of more than ``part_rows`` messages (a broken id that
    many dialogues share, say) is cut by turn and by the leading bits of the messages' hash, in the order of the dialogue,
    so no part grows with the table.
    """
    block = F.floor(F.col("turn") / part_turns)
    messages = messages.withColumn("turn_block", block)
    counted = messages.groupBy("conv_id", "turn_block").agg(F.count(F.lit(1)).alias("_n"))
    crowded = counted.where(F.col("_n") > part_rows).select(
        F.col("conv_id").alias("_c"), F.col("turn_block").alias("_b"),
        F.least(F.lit(40), F.greatest(F.lit(1), F.ceil(F.log2(F.col("_n") * 4 / part_rows)))).cast("int").alias("_bits"))
    split = (F.pmod(F.coalesce("turn", F.lit(0)), F.lit(part_turns)) * F.expr("shiftleft(1L, _bits)")
             + F.expr("shiftright(cast(conv(substr(_tie, 1, 10), 16, 10) as bigint), 40 - _bits)"))
    joined = messages.join(
        crowded, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn_block").eqNullSafe(F.col("_b")), "left")
    return joined.withColumn("split", F.when(F.col("_bits").isNull(), F.lit(0)).otherwise(split).cast("bigint")).drop("_c", "_b")


def rotate(conversations: DataFrame, part_turns: int = PART_TURNS, part_rows: int = PART_ROWS) -> DataFrame:
    """The dialogue from the point of view of every participant.

    One row per (conv_id, perspective, turn_block, split): the part's messages rendered with that speaker as assistant,
    other speakers as named users and system messages as they are; ``spans`` are the code point ranges of ``text`` that
    are trained on (the speaker's own words and end marks), ``assistant_chars`` their total length. Parts in the order
    of (turn_block, split) make up the dialogue; a dialogue within one block of turn numbers is one part.

    Speakers are the values of ``role`` but ``system``. Messages go by turn (null first), then by a hash of role and text.
    A null role is the speaker "unknown", a null text is empty, a null conv_id is a dialogue of its own; a message that is
    there twice in the same turn counts once. A dialogue of system messages alone has no row; an empty table gives none.
    Other columns are not read.
    """
    messages = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(UNNAMED)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).distinct()
    messages = messages.withColumn("_tie", F.md5(F.concat_ws("\x1f", "role", "text")))
    parts = (_cells(messages, part_turns, part_rows).groupBy("conv_id", "turn_block", "split")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "_tie", "role", "text"))).alias("_messages")))
    speakers = (messages.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective"))
                .distinct())
    seen = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c")))

    def own(m: Column) -> Column:
        return m["role"] == F.col("perspective")

    def head(m: Column) -> Column:
        role = (F.when(own(m), F.lit("assistant")).when(m["role"] == SYSTEM, F.lit(SYSTEM))
                .otherwise(F.concat(F.lit("user name="), m["role"])))
        return F.concat(F.lit(OPEN), role, F.lit(CLOSE))

    pieces = F.transform("_messages", lambda m: F.struct(
        F.concat(head(m), m["text"], F.lit(END)).alias("piece"), F.length(head(m)).alias("head"), own(m).alias("own")))
    seen = seen.withColumn("_pieces", pieces)
    walked = F.aggregate(
        "_pieces", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["piece"])).alias("at"),
            F.when(p["own"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + p["head"]).alias("start"), (s["at"] + F.length(p["piece"])).alias("end")))))
            .otherwise(s["spans"]).alias("spans")))
    return (seen.withColumn("spans", walked["spans"])
            .select("conv_id", "perspective", "turn_block", "split", F.size("_messages").cast("bigint").alias("n_messages"),
                    F.array_join(F.transform("_pieces", lambda p: p["piece"]), "").alias("text"), "spans",
                    F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"]).alias("assistant_chars")))


@query("op4_chat_rotation", r"""
with m as (select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
k as (select *, md5(role || chr(31) || text) as tie, cast(floor(turn / 64.0) as bigint) as turn_block from m),
s as (select distinct conv_id as c, role as perspective from m where role <> 'system'),
r as (
  select k.*, s.perspective, k.role = s.perspective as own,
    '<|im_start|>' || case when k.role = s.perspective then 'assistant' when k.role = 'system' then 'system'
      else 'user name=' || k.role end || chr(10) as head
  from k join s on k.conv_id is not distinct from s.c),
p as (
  select *, head || text || '<|im_end|>' || chr(10) as piece,
    sum(length(head || text || '<|im_end|>' || chr(10))) over (
      partition by conv_id, perspective, turn_block order by turn nulls first, tie) as upto
  from r)
select conv_id, perspective, turn_block, cast(0 as bigint) as split, count(*) as n_messages,
  string_agg(piece, '' order by turn nulls first, tie) as text,
  coalesce(string_agg(case when own then cast(upto - length(piece) + length(head) as varchar) || ':' || cast(upto as varchar) end,
    ',' order by turn nulls first, tie), '') as spans,
  cast(coalesce(sum(case when own then length(piece) - length(head) end), 0) as bigint) as assistant_chars
from p group by conv_id, perspective, turn_block""")
def op4_chat_rotation(spark, sf_dir):
    """Every dialogue from every speaker's side; spans as start:end, comma-joined."""
    out = rotate(table(spark, sf_dir, "conversations"))
    spans = F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return out.withColumn("spans", F.array_join(spans, ","))
