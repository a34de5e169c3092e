"""Chat formatting (operator 4): multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions, session

SYSTEM = ("system",)
#: Turns that one row of the result holds, which bounds a row's size. Dialogues of up to so many are rendered whole, whatever their turn
#: numbers; those beyond go on in further parts.
PART_TURNS = 4096
#: Letters of a text that ranges of turns are dealt by.
LETTERS = 64


def _escaped(c: Column) -> Column:
    """Markers inside a text are broken up, so that a turn can't forge another."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def told_type(parts: DataFrame) -> str:
    return parts.schema["turns"].dataType.simpleString()


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system_roles: tuple = SYSTEM, part_turns: int = PART_TURNS) -> DataFrame:
    """For every participant of a dialogue: the dialogue with that speaker as the assistant, the others as named users.

    A turn reads <|assistant|>, <|user name=..|> or <|system|>, a line break, the text, <|end|> and a line break. Turns are
    ordered by their number, ties by role and text. mask lists the spans (code points, end exclusive) that are trained on: the text and
    end mark of the assistant's turns. A dialogue whose only roles are system ones has no perspective. Dialogues go by parts of
    part_turns turns in that order, so a conversation of any length never gathers in one row or task; a part after the first
    begins with the last system turn before it, if there is one; spans count from the part's start, and a part without turns
    of a participant still shows that perspective, with an empty mask.

    Turns get their places in two levels: ranges of turns, over all dialogues, are counted by themselves, from where the ranges before end.

    Nulls: a null text is an empty turn; a null role is a speaker named "unknown"; a null turn number comes first; null
    conversation ids are one conversation. Repeated rows are repeated turns. An empty table gives an empty result. Extra columns are
    ignored, whatever their names. Very long texts are kept whole. n_turns leaves out the system turn that a part begins with.

    Returns conv_col, speaker, part, n_turns, text, mask (array of start and end).
    """
    src = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    spark = session(turns)
    work = Workspace(spark, "chat")
    src = src.repartitionByRange(partitions(spark), "conv", "turn", "role", F.substring("text", 1, LETTERS)).withColumn("range", F.spark_partition_id())
    src = work.put(src, "turns")
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that holds the dialogue
    starts = src.groupBy("conv", "range").agg(F.count("*").alias("n")).select("conv", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = src.withColumn("place", F.row_number().over(Window.partitionBy("conv", "range").orderBy("turn", "role", "text")) - 1)
    placed = inside.alias("t").join(starts.alias("s"), F.expr("t.conv <=> s.conv AND t.range = s.range")).select("t.conv", "turn", "role", "text", (F.col("place") + F.col("first")).alias("place"))
    placed = placed.withColumn("part", F.floor(F.col("place") / part_turns).cast("long"))
    speakers = src.where(~F.col("role").isin(*system_roles)).select("conv", F.col("role").alias("speaker")).distinct()
    system = F.when(F.col("role").isin(*system_roles), F.struct("place", "text", "role"))
    parts = placed.groupBy("conv", "part").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"), F.max(system).alias("rule"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = parts.withColumn("rule", F.last("rule", ignorenulls=True).over(earlier))
    told = F.when(F.col("rule").isNotNull(), F.array(F.struct(F.lit(-1).cast("long").alias("place"), F.col("rule.role").alias("role"), F.col("rule.text").alias("text"))))
    parts = parts.select("conv", "part", F.size("turns").cast("long").alias("n_turns"), F.concat(F.coalesce(told, F.array().cast(told_type(parts))), F.col("turns")).alias("turns"))
    both = parts.alias("p").join(speakers.alias("s"), F.expr("p.conv <=> s.conv")).select("p.conv", "part", "n_turns", "speaker", "turns")
    end = F.lit("<|end|>")

    def piece(t: Column) -> Column:
        mine = t["role"] == F.col("speaker")
        head = F.when(mine, F.lit("<|assistant|>\n")).when(t["role"].isin(*system_roles), F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), _escaped(t["role"]), F.lit("|>\n")))
        return F.struct(head.alias("head"), F.concat(_escaped(t["text"]), end).alias("body"), mine.alias("mine"))

    pieces = both.withColumn("pieces", F.transform("turns", piece))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        lo = acc["at"] + F.length(p["head"])
        hi = lo + F.length(p["body"])
        span = F.array(F.struct(lo.cast("long").alias("start"), hi.cast("long").alias("end")))
        return F.struct((hi + 1).cast("long").alias("at"), F.when(p["mine"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    out = pieces.select("conv", "speaker", "part", "n_turns", text.alias("text"), F.aggregate("pieces", start, step, lambda acc: acc["mask"]).alias("mask"))
    return work.last(out.withColumnRenamed("conv", conv_col))


ORACLE = f"""
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS r FROM conversations),
b AS (SELECT *, r // {PART_TURNS} AS part, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rule FROM t),
c AS (SELECT conv_id, part, r, role, text, 1 AS own FROM b UNION ALL SELECT conv_id, part, -1, 'system', rule, 0 FROM b WHERE r = part * {PART_TURNS} AND rule IS NOT NULL AND part > 0),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
p AS (SELECT c.conv_id, part, speaker, r, own, role = speaker AS mine,
  CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || replace(role, '<|', '<\\|') || '|>' END || chr(10) AS head,
  replace(text, '<|', '<\\|') || '<|end|>' AS body FROM c JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, speaker ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p)
SELECT conv_id, speaker, part, sum(own)::BIGINT AS n_turns, sha256(string_agg(head || body || chr(10), '' ORDER BY r)) AS text_sha256,
  coalesce(string_agg(CASE WHEN mine THEN (pos + length(head))::BIGINT || ':' || (pos + length(head) + length(body))::BIGINT END, ',' ORDER BY r), '') AS mask
FROM o GROUP BY conv_id, speaker, part
"""


def query(spark, sf_dir: str) -> DataFrame:
    out = perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select("conv_id", "speaker", "part", "n_turns", F.sha2("text", 256).alias("text_sha256"), mask.alias("mask"))
