"""Multi-party perspective rotation of chats, with built-in Spark functions only.

For every participant (a role other than system) a dialogue is rendered with that speaker as the assistant and the
other speakers as named users; the loss mask covers the assistant's messages and their end markers. Where messages stand
in the text is a running sum over the dialogue, so the work grows with its length only.

A dialogue is rendered whole, as part 0. One of more than MOST_TURNS messages, which no single row should hold, comes in
consecutive parts of that many messages, which joined are the dialogue; masks count from the start of their part. Such
dialogues are numbered by a sort by ranges, so no task gets all of a conversation, however long it is.

Defined cases: a null or blank role is the speaker "unknown"; a null text is empty; null turns come first; a null conv_id
is one conversation; messages with equal turns are ordered by speaker and text; repeated rows are rendered each; a
conversation with system messages only has no participant and gives no row; "<|" in a text or a name is written "<\\|", so
contents cannot forge a marker. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import written
from ledgerloom.shared import numbered

MOST_TURNS = 10_000
FIRST = -(2**62)


def _in_parts(turns: DataFrame, most: int) -> DataFrame:
    """turns with part: 0 but in conversations of more than `most` messages."""
    sizes = turns.groupBy("key").agg(F.count("*").alias("size"))
    long = written(sizes.where(F.col("size") > most).select("key"), "long_conversations")
    if long.isEmpty():
        return turns.withColumn("part", F.lit(0).cast("long"))
    held = written(turns.join(long, "key", "left_semi").withColumn("row", F.monotonically_increasing_id()), "long_turns")
    placed = written(numbered(held, "number", F.col("key"), F.col("turn"), F.col("speaker"), F.col("body"), F.col("row")), "numbered_turns")
    first = placed.groupBy("key").agg(F.min("number").alias("first"))
    parts = placed.join(F.broadcast(first) if first.count() <= 100_000 else first, "key")
    part = F.floor((F.col("number") - F.col("first")) / most)
    return turns.join(long, "key", "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(parts.select(*turns.columns, part.alias("part")))


def perspectives(conversations: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """conv_id, part, participant, n_turns, n_target_chars, masks ("start:end" of code points in text, comma-joined), text."""
    speaker = F.when(F.trim("role") == "", None).otherwise(F.trim("role"))
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    turns = conversations.select(
        "conv_id",
        # null is a conversation too; texts as keys let one shuffle by them serve the join, the running sums and the rendering
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"),
        safe(F.coalesce(speaker, F.lit("unknown"))).alias("speaker"),
        safe(F.coalesce("text", F.lit(""))).alias("body"),
    )
    people = turns.where("speaker <> 'system'").groupBy("key").agg(F.collect_set("speaker").alias("people"))
    each = _in_parts(turns, most_turns).join(people, "key").withColumn("participant", F.explode("people")).drop("people")

    own = F.col("speaker") == F.col("participant")
    head = F.when(F.col("speaker") == "system", F.lit("<|im_start|>system\n")).when(own, F.lit("<|im_start|>assistant\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), "speaker", F.lit("\n")))
    said = each.select("key", "conv_id", "part", "participant", "turn", "speaker", "body", own.alias("own"), head.alias("head"), (F.length("body") + F.length(F.lit("<|im_end|>"))).alias("size"))
    dialogue = Window.partitionBy("key", "part", "participant").orderBy("turn", "speaker", "body").rowsBetween(Window.unboundedPreceding, 0)
    placed = said.withColumns({"n": F.count("*").over(dialogue), "end": F.sum(F.length("head") + F.col("size") + 1).over(dialogue) - 1})
    mask = F.when(F.col("own"), F.concat_ws(":", (F.col("end") - F.col("size")).cast("string"), F.col("end").cast("string")))
    line = F.concat("head", "body", F.lit("<|im_end|>\n"))
    messages = F.array_sort(F.collect_list(F.struct("n", line.alias("line"), mask.alias("mask"))))
    out = placed.groupBy("key", "conv_id", "part", "participant").agg(F.count("*").alias("n_turns"), F.coalesce(F.sum(F.when(F.col("own"), F.col("size"))), F.lit(0)).cast("long").alias("n_target_chars"), messages.alias("messages"))
    return out.select(
        "conv_id",
        "part",
        "participant",
        "n_turns",
        "n_target_chars",
        F.array_join(F.transform("messages", lambda m: m["mask"]), ",").alias("masks"),
        F.array_join(F.transform("messages", lambda m: m["line"]), "").alias("text"),
    )


def oracle(most_turns: int = MOST_TURNS) -> str:
    """The same rows as DuckDB SQL."""
    return rf"""
WITH turns AS (
  SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn,
    replace(coalesce(nullif(trim(role, ' '), ''), 'unknown'), '<|', '<\|') AS speaker, replace(coalesce(text, ''), '<|', '<\|') AS body
  FROM conversations),
parted AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, body) - 1) // {most_turns} AS part FROM turns),
people AS (SELECT DISTINCT conv_id AS of, speaker AS participant FROM turns WHERE speaker <> 'system'),
pieces AS (
  SELECT conv_id, part, participant, turn, speaker, body || '<|im_end|>' AS body, speaker = participant AS own,
    CASE WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10) WHEN speaker = participant THEN '<|im_start|>assistant' || chr(10)
      ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head
  FROM parted JOIN people ON conv_id IS NOT DISTINCT FROM of),
placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 AS start, row_number() OVER w AS n
  FROM pieces WINDOW w AS (PARTITION BY conv_id, part, participant ORDER BY turn, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, part, participant, count(*) AS n_turns, CAST(coalesce(sum(CASE WHEN own THEN length(body) END), 0) AS BIGINT) AS n_target_chars,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY n), '') AS masks,
  string_agg(head || body || chr(10), '' ORDER BY n) AS text
FROM placed GROUP BY conv_id, part, participant
"""


ORACLE_SQL = oracle()
