"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation the whole dialogue is rendered once more: that speaker's messages as the
assistant's, all others' as those of named users, system messages as such. Each message becomes one row per perspective
with its rendered segment and its place in the rendered dialogue; rows meet by blocks of turns, so a long dialogue is many
tasks' work (only messages of one turn number, or of none, stay together, as their order is among themselves); the
segments of a perspective in order of `seq` are the rendered dialogue, and the rows with `trainable` mark the characters
[body_start, body_end) that are learnt from.

Defined cases: role null or empty: a user named "unknown", who is no participant (and is not one who really has that name); a
conversation without participants has no rows. Text null: empty. Equal turns: ordered by role, then text; a null turn comes first. Repeated rows are repeated
messages. A null conv_id is a conversation of its own. Markers inside texts and names are broken
up, and line ends in names become spaces, in the rendered segment alone. Very long texts are whole segments; an empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, SYSTEM, NOBODY = "<|im_start|>", "<|im_end|>\n", "system", "unknown"
#: Turns whose offsets are summed together; sums of whole blocks are then summed in turn.
BLOCK = 1024


def _plain(text: Column) -> Column:
    """A text without markers."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def perspectives(messages: DataFrame) -> DataFrame:
    m = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit(NOBODY)).alias("role"),
        (F.coalesce("role", F.lit("")) != "").alias("named"), _plain(F.coalesce("text", F.lit(""))).alias("body"),
    )
    speakers = m.where(F.col("named") & (F.col("role") != SYSTEM)).select("conv_id", F.col("role").alias("perspective")).distinct()
    m = m.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    blocks = m.select("conv_id", "block").distinct().alias("b")
    speakers = speakers.alias("s").join(blocks, F.col("s.conv_id").eqNullSafe(F.col("b.conv_id"))).select("b.conv_id", "block", "perspective")
    m = m.alias("m").join(speakers.alias("s"), F.col("m.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("m.block") == F.col("s.block"))).select("m.*", "perspective")
    mine = F.col("named") & (F.col("role") == F.col("perspective"))  # no perspective is the system's
    head = F.when(mine, F.lit(f"{OPEN}assistant\n")).when(F.col("role") == SYSTEM, F.lit(f"{OPEN}system\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), F.translate(_plain(F.col("role")), "\r\n", "  "), F.lit("\n")))
    m = m.withColumns({"trainable": mine, "head": head})
    m = m.withColumns({"segment": F.concat("head", "body", F.lit(CLOSE))})
    key = ["conv_id", "perspective"]
    w = Window.partitionBy(*key, "block").orderBy(F.asc_nulls_first("turn"), "role", "named", "body").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = m.withColumns({"n": F.count(F.lit(1)).over(w), "upto": F.sum(F.length("segment")).over(w)})
    blocks = m.groupBy(*key, "block").agg(F.max("n").alias("n"), F.max("upto").alias("upto"))
    b = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(k).alias(f"b_{k}") for k in (*key, "block")], F.coalesce(F.sum("n").over(b), F.lit(0)).alias("n0"), F.coalesce(F.sum("upto").over(b), F.lit(0)).alias("at0"))
    same = F.col("conv_id").eqNullSafe(F.col("b_conv_id")) & (F.col("perspective") == F.col("b_perspective")) & (F.col("block") == F.col("b_block"))
    start = F.col("at0") + F.col("upto") - F.length("segment")
    body = start + F.length("head")
    return m.join(blocks, same).select(
        *key, (F.col("n0") + F.col("n")).alias("seq"), "turn", F.when(mine, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise("user").alias("rendered_role"), F.col("role").alias("name"), "segment", "trainable",
        start.alias("char_start"), body.alias("body_start"), (body + F.length("body")).alias("body_end"),
    )


ORACLE = f"""
WITH m AS (SELECT conv_id, turn, coalesce(nullif(role, ''), '{NOBODY}') AS role, coalesce(role, '') <> '' AS named,
    replace(coalesce(text, ''), '<|im_', '<| im_') AS body FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE named AND role <> '{SYSTEM}'),
r AS (SELECT m.conv_id, s.perspective, turn, role, named, body, named AND role = perspective AS trainable,
    CASE WHEN named AND role = perspective THEN '{OPEN}assistant' || chr(10) WHEN role = '{SYSTEM}' THEN '{OPEN}system' || chr(10)
         ELSE '{OPEN}user name=' || translate(replace(role, '<|im_', '<| im_'), chr(10) || chr(13), '  ') || chr(10) END AS head
    FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id),
t AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM r),
u AS (SELECT *, row_number() OVER w AS seq, CAST(sum(length(segment)) OVER w AS BIGINT) - length(segment) AS char_start FROM t
    WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, named, body ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, seq, turn, CASE WHEN trainable THEN 'assistant' WHEN role = '{SYSTEM}' THEN '{SYSTEM}' ELSE 'user' END AS rendered_role,
    role AS name, segment, trainable, char_start, char_start + length(head) AS body_start, char_start + length(head) + length(body) AS body_end FROM u
"""
