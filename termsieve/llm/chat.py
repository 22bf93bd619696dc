"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered with that speaker as the assistant and all others as named
users; the mask covers what the speaker says. System messages stay instructions for everybody.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialize, ranked

# Messages of one rendered part. A longer dialogue continues in the next part, so that the rows gathered for one
# training example stay bounded however long the dialogue is.
PART_MESSAGES = 64
# Parts of one dialogue that meet its speakers under one join key.
PARTS_PER_KEY = 256
SYSTEM, OPEN, CLOSE = "system", "<|", "<|end|>\n"


def heading(role: Column, speaker: Column) -> Column:
    """Text in front of a message as the model of `speaker` sees it."""
    name = F.when(role == SYSTEM, SYSTEM).when(role == speaker, "assistant").otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(OPEN), name, F.lit("|>\n"))


def _speakers(messages: str) -> Column:
    return F.array_distinct(F.filter(F.transform(messages, lambda m: m["role"]), lambda r: r != SYSTEM))


def _cast_of_long(parts: DataFrame) -> DataFrame:
    """Parts of long dialogues, once for every speaker of the whole dialogue, with its opening system messages.

    A dialogue's speakers are repeated per block of its parts, so that no dialogue is one join key.
    """
    opening = F.when(F.col("part") == 0, F.filter("ms", lambda m: m["role"] == SYSTEM))
    spans = parts.groupBy("_key").agg(F.max("part").alias("_last"), F.first(opening, ignorenulls=True).alias("_opening"))
    people = parts.select("_key", F.explode(_speakers("ms")).alias("speaker")).distinct().join(spans, "_key").select(
        "_key", "speaker", "_opening",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / PARTS_PER_KEY))).alias("_block"))
    blocks = parts.withColumn("_block", F.floor(F.col("part") / PARTS_PER_KEY))
    return blocks.join(people, ["_key", "_block"]).select(
        "conv_id", "part", F.size("ms").alias("n_messages"),
        F.when(F.col("part") > 0, F.concat("_opening", "ms")).otherwise(F.col("ms")).alias("ms"), "speaker")


def rotate(messages: DataFrame, part_messages: int = PART_MESSAGES, window_rows: int | None = None) -> DataFrame:
    """conv_id, part, speaker, n_messages, rendered, masks (start, end in code points).

    `messages` has conv_id, turn, role and text; other columns are ignored. Messages are ordered by
    (turn, role, text), nulls first; equal messages are kept as often as they occur. A null role speaks as
    `unknown`, a null text is empty, a null conv_id is a dialogue like any other. Every `part_messages` messages
    are a part, and every speaker of the dialogue gets each part, also where all of it is said by others (no mask).
    Later parts open with the system messages of the first part; `n_messages` does not count those copies.
    A dialogue without a speaker besides the system gives no row, and so does an empty table.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    speaker_of = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    rows = materialize(messages.select(
        key.alias("_key"), "conv_id", F.struct(F.col("turn"), speaker_of.alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m")))
    placed = ranked(rows, ["_key"], [F.col("m")], name="_nth", window_rows=window_rows)
    parts = materialize(placed.groupBy("_key", "conv_id", F.floor((F.col("_nth") - 1) / part_messages).alias("part"))
                        .agg(F.array_sort(F.collect_list("m")).alias("ms")))
    # A part that is not full and comes first is the whole dialogue.
    whole = (F.col("part") == 0) & (F.size("ms") < part_messages)
    short = parts.where(whole).select("conv_id", "part", F.size("ms").alias("n_messages"), "ms", F.explode(_speakers("ms")).alias("speaker"))
    seen = short.unionByName(_cast_of_long(parts.where(~whole)))
    speaker = F.col("speaker")
    pieces = F.transform("ms", lambda m: F.struct(
        heading(m["role"], speaker).alias("head"), F.concat(m["text"], F.lit(CLOSE)).alias("body"),
        ((m["role"] == speaker) & (m["role"] != SYSTEM)).alias("own")))
    shaped = seen.select("conv_id", "part", "speaker", "n_messages", pieces.alias("pieces"))
    spans = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int>>)").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("at"),
            F.when(p["own"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(p["head"])).alias("start"),
                (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end")))))
            .otherwise(acc["spans"]).alias("spans")))["spans"]
    return shaped.select(
        "conv_id", "part", "speaker", "n_messages",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "").alias("rendered"),
        spans.alias("masks"))


def op9_perspectives(spark, sf: str) -> DataFrame:
    """One row per dialogue part and participant; masks as text `start-end,...`."""
    found = rotate(spark.read.parquet(f"{sf}/conversations.parquet"))
    masks = F.array_join(F.transform("masks", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select("conv_id", "part", "speaker", "n_messages", "rendered", masks.alias("masks"))


QUERIES = {"op9_perspectives": op9_perspectives}

ORACLES = {"op9_perspectives": f"""WITH m AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS pos FROM conversations),
n AS (SELECT *, pos // {PART_MESSAGES} AS part FROM m),
later AS (SELECT DISTINCT conv_id, part FROM n WHERE part > 0),
shown AS (SELECT conv_id, part, pos, role, text, 1 AS own_part FROM n
  UNION ALL SELECT n.conv_id, l.part, n.pos, n.role, n.text, 0 FROM n JOIN later l ON n.conv_id IS NOT DISTINCT FROM l.conv_id
  WHERE n.part = 0 AND n.role = 'system'),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
p AS (SELECT shown.conv_id, part, speaker, pos, own_part, role = speaker AS own,
  '<|' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || '|>' || chr(10) AS head,
  text || '<|end|>' || chr(10) AS body FROM shown JOIN s ON shown.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, speaker ORDER BY pos) AS stop FROM p)
SELECT conv_id, part, speaker, sum(own_part)::INTEGER AS n_messages, string_agg(head || body, '' ORDER BY pos) AS rendered,
  coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY pos) FILTER (WHERE own), '') AS masks
FROM o GROUP BY conv_id, part, speaker"""}
