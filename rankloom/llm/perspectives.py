"""Chat formatting with DataFrame functions alone: every participant of a dialogue once as the assistant.

For each speaker the dialogue is rendered with that speaker's turns as the assistant's and all others' as those of
users by name; masks cover what the assistant says and its end mark. A dialogue is rendered in blocks of
``block_turns`` turns, so no row gathers more; texts of its blocks, in order, make up the whole, and
``chunk_start`` says where a block begins in it.

Turns are numbered within their dialogue from a sort by ranges: places within a range, plus what the dialogue has in the ranges before. So
a dialogue of any length, or with any number of equal or null turn numbers, is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import parts, written

END = "<|end|>\n"


def numbered(turns: DataFrame) -> DataFrame:
    """Written table (conv_id, turn, role, text, number) of distinct turns, numbered from 0 within their dialogue by (turn, role, text)."""
    order = ["turn", "role", "text"]
    rows = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    dealt = rows.repartitionByRange(parts(turns.sparkSession), "conv_id", *order).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "turns")  # ranges by sampling: fixed from here on
    inside = dealt.withColumn("place", F.row_number().over(W.partitionBy("range", "conv_id").orderBy(*order)))
    sizes = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("conv_id").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    both = inside.join(before, (inside.range == before["at"]) & inside.conv_id.eqNullSafe(before["of"]))
    return written(both.select("conv_id", *order, (F.col("before") + F.col("place") - 1).alias("number")), "numbered-turns")


def rotated(turns: DataFrame, block_turns: int = 256, system_role: str = "system") -> DataFrame:
    """(conv_id, speaker, block, chunk_start, n_turns, text, masks) of ``turns`` (conv_id, turn, role, text).

    Speakers are the roles of a dialogue but for ``system_role``, whose turns are rendered as the system's for everyone; a
    dialogue without speakers gives no rows. Masks are [start, stop) in code points of the block's text. A null role is the
    speaker "unknown", a null text is empty, a null turn comes before all others as turn -1, null conv_ids are one
    dialogue. Turns of one number follow each other by role, then text; rows that repeat all four columns are one turn.
    """
    rows = numbered(turns)
    speakers = rows.filter(F.col("role") != system_role).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    own = F.col("role") == F.col("speaker")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("role") == system_role, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user "), F.col("role"), F.lit("|>\n")))
    said = rows.join(speakers, rows.conv_id.eqNullSafe(speakers["of"])).select(
        "conv_id", "speaker", F.floor(F.col("number") / block_turns).cast("long").alias("block"), F.struct("number", "text", head.alias("head"), own.alias("own")).alias("said")
    )
    held = said.groupBy("conv_id", "speaker", "block").agg(F.array_sort(F.collect_list("said")).alias("said"))
    piece = lambda x: F.concat(x["head"], x["text"], F.lit(END))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("masks"))

    def step(s, x):
        start = s["at"] + F.length(x["head"])
        stop = start + F.length(x["text"]) + len(END)
        return F.struct(stop.alias("at"), F.when(x["own"], F.concat(s["masks"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))).otherwise(s["masks"]).alias("masks"))

    done = written(held.select("conv_id", "speaker", "block", F.size("said").alias("n_turns"), F.array_join(F.transform("said", piece), "").alias("text"), F.aggregate("said", empty, step).alias("s")), "blocks")
    # starts from the blocks' sizes alone: three numbers for each block_turns turns
    before = W.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = done.select(F.col("conv_id").alias("of"), F.col("speaker").alias("by"), F.col("block").alias("at"), F.coalesce(F.sum(F.col("s.at").cast("long")).over(before), F.lit(0)).alias("chunk_start"))
    whole = done.join(starts, done.conv_id.eqNullSafe(starts["of"]) & (done.speaker == starts["by"]) & (done.block == starts["at"]))
    return whole.select("conv_id", "speaker", "block", "chunk_start", "n_turns", "text", F.col("s.masks").alias("masks"))


def mask_string(masks: str = "masks"):
    return F.array_join(F.transform(masks, lambda m: F.concat_ws(":", m["start"].cast("string"), m["stop"].cast("string"))), ",")


#: DuckDB: the same rows, masks as "start:stop" joined by commas.
SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS number
  FROM (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM r WHERE role <> 'system'),
s AS (
  SELECT r.conv_id, p.speaker, CAST(r.number // 256 AS BIGINT) AS block, r.number, r.role, r.text, r.role = p.speaker AS own,
    CASE WHEN r.role = p.speaker THEN '<|assistant|>' WHEN r.role = 'system' THEN '<|system|>' ELSE '<|user ' || r.role || '|>' END || chr(10) AS head
  FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
l AS (
  SELECT *, length(head) + length(text) + 8 AS size,
    coalesce(sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, speaker, block ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM s),
b AS (
  SELECT conv_id, speaker, block, CAST(count(*) AS INTEGER) AS n_turns, sum(size) AS size,
    string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY number) AS text,
    coalesce(string_agg(CASE WHEN own THEN CAST(CAST(start + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + size AS BIGINT) AS VARCHAR) END, ',' ORDER BY number), '') AS masks
  FROM l GROUP BY ALL)
SELECT conv_id, speaker, block, CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, speaker ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk_start, n_turns, text, masks
FROM b
"""
