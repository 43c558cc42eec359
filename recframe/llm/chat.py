"""Operator 8: multi-party perspective rotation of dialogues.

For every participant (each role of a conversation but ``system``) the dialogue
is rendered with that speaker as ``assistant`` and the others as named users;
the mask lists the character spans [start, end) of the speaker's own words,
which are the only ones that carry loss.

One message renders as ``<|assistant|>\\ntext<|end|>\\n``,
``<|user:name|>\\ntext<|end|>\\n`` or ``<|system|>\\ntext<|end|>\\n``.  A
dialogue longer than ``max_turns`` messages is cut into consecutive examples of
that many, so no row or group grows with a conversation; nothing is left out.

Defined cases: a null role is the participant ``unknown``; a null text is
empty; a null conv_id is a conversation of its own; null turns come first; ties
in turn go by role, then text; repeated rows are separate messages; a
conversation of system messages only has no participant and gives no row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_TURNS = 64
#: Turn numbers in one ranking group, so that a hot conversation is split.
TURNS_PER_GROUP = 4096


def rotate(conversations: DataFrame, max_turns: int = MAX_TURNS) -> DataFrame:
    """conv_id, perspective, example, n_turns, rendered, mask ("start-end,...")."""
    msgs = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(-1)) / F.lit(TURNS_PER_GROUP)).alias("grp"))
    # rank of a message in its conversation = messages in earlier groups + rank in the group
    sizes = msgs.groupBy("conv_id", "grp").agg(F.count("*").alias("n"))
    earlier = sizes.select(F.col("conv_id").alias("c"), F.col("grp").alias("g"),
                           (F.sum("n").over(Window.partitionBy("conv_id").orderBy("grp")) - F.col("n")).alias("before"))
    in_group = Window.partitionBy("conv_id", "grp").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ranked = (msgs.withColumn("r", F.row_number().over(in_group) - 1)
              .join(earlier, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("grp") == F.col("g")))
              .select("conv_id", "role", "text", (F.col("before") + F.col("r")).alias("rank")))
    speakers = (msgs.where("role <> 'system'").select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct())
    name = F.when(F.col("role") == "system", F.lit("system")).when(F.col("role") == F.col("perspective"), F.lit("assistant")).otherwise(
        F.concat(F.lit("user:"), F.col("role")))
    seen = (ranked.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))
            .withColumn("example", F.floor(F.col("rank") / F.lit(max_turns)).cast("long"))
            .withColumn("head", F.concat(F.lit("<|"), name, F.lit("|>\n")))
            .withColumn("body", F.concat("head", "text", F.lit("<|end|>\n"))))
    so_far = Window.partitionBy("conv_id", "perspective", "example").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.char_length("body")).over(so_far) - F.char_length("body") + F.char_length("head")
    own = F.when(F.col("role") == F.col("perspective"), F.concat(F.col("start").cast("string"), F.lit("-"), (F.col("start") + F.char_length("text")).cast("string")))
    # at most max_turns messages in a group
    return (seen.withColumn("start", start).withColumn("span", own)
            .groupBy("conv_id", "perspective", "example")
            .agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("rank", "body", "span"))).alias("m"))
            .select("conv_id", "perspective", "example", "n_turns", F.array_join(F.col("m.body"), "").alias("rendered"),
                    F.array_join(F.col("m.span"), ",").alias("mask")))


SQL = f"""
with msgs as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations),
ranked as (
  select conv_id, role, text,
         row_number() over (partition by conv_id order by turn asc nulls first, role, text) - 1 as rank from msgs),
speakers as (select distinct conv_id as c, role as perspective from msgs where role <> 'system'),
seen as (
  select conv_id, perspective, rank, role, text, rank // {MAX_TURNS} as example,
         '<|' || case when role = 'system' then 'system' when role = perspective then 'assistant' else 'user:' || role end || '|>' || chr(10) as head
  from ranked join speakers on conv_id is not distinct from c),
bodies as (select *, head || text || '<|end|>' || chr(10) as body from seen),
placed as (
  select *, sum(length(body)) over (partition by conv_id, perspective, example order by rank
                                    rows between unbounded preceding and current row) - length(body) + length(head) as start
  from bodies)
select conv_id, perspective, cast(example as bigint) as example, count(*) as n_turns,
       string_agg(body, '' order by rank) as rendered,
       coalesce(string_agg(case when role = perspective then cast(cast(start as bigint) as varchar) || '-' || cast(cast(start + length(text) as bigint) as varchar) end, ',' order by rank), '') as mask
from placed group by conv_id, perspective, example
"""
