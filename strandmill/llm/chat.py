"""Chat formatting by perspective rotation, with DataFrame functions only.

For every participant of a dialogue (every role but `system`) the dialogue is rendered once, with that speaker as the
assistant, the others as users with their names, and system turns as they are. The mask says for each
turn whether it is a target, and the spans say where the target texts stand in the rendering, in
characters.

A dialogue is rendered in parts of `PART_TURNS` turns, by their place in the dialogue, whatever their numbers are. The places are found by sorting all turns by
ranges and counting the rows of earlier ranges, so a dialogue that holds a third of
all rows is spread over many tasks, also where all its turns have one number. The parts of a dialogue in order are the whole of it, and `whole`
puts them together where a dialogue fits in a row. What is rendered is, by the method, every turn once for each participant.

Defined results: a null text is empty; a turn with a null role is a user named `unknown` and no participant;
rows without a conv_id belong to no dialogue and are left out; a null turn number counts as -1; repeated
rows are rendered as often as they stand; turns of one number go by role and text; in texts and names what looks like a marker gets
a space inside, and a line break in a name becomes a space, so no name or text can open or close a turn; a dialogue without a participant gives no rows; an empty table gives no rows. Only the four columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.llm.shared import Tables, partitions_of

PART_TURNS = 256
PARTS_TOGETHER = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def plain(text: Column) -> Column:
    """Text in which nothing is a marker."""
    return F.replace(text, F.lit("<|im_"), F.lit("<| im_"))


def placed(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. With `at`, the place of each row in its dialogue by turn, role and text."""
    spark, order = rows.sparkSession, ["turn", "by", "text", "role"]
    # Equal rows are one row with a number, so no range of the sort is filled by them.
    once = rows.withColumn("by", F.coalesce("role", F.lit(""))).groupBy("conv_id", *order).agg(F.count("*").alias("n"))
    ranges = once.repartitionByRange(partitions_of(spark), "conv_id", *order).sortWithinPartitions("conv_id", *order)
    sorted_ = Tables(spark, "chat").put("turns", ranges.withColumn("p", F.spark_partition_id()))
    size = sorted_.groupBy("conv_id", "p").agg(F.sum("n").alias("size"))
    before = size.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    own = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id", "p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = sorted_.withColumn("own", own).join(before, ["conv_id", "p"])
    return found.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("at", F.col("before") + F.col("own") + F.col("copy"))


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, speaker, rendered, n_turns, mask (array of 0 and 1) and spans (array of start and end, in the part)."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"), F.col(role_col).alias("role"), plain(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).where("conv_id IS NOT NULL")
    parts = placed(rows).withColumn("part", F.floor(F.col("at") / part_turns).cast("long")).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "text", "role"))).alias("all"))
    speakers = rows.where("role IS NOT NULL AND role <> 'system'").select("conv_id", F.col("role").alias("speaker")).distinct()
    # Some parts of a dialogue at a time meet its speakers, so a long dialogue is no single key.
    size = rows.groupBy("conv_id").agg(F.count("*").alias("size"))
    last = F.floor((F.col("size") - 1) / (part_turns * PARTS_TOGETHER)).cast("long")
    speakers = speakers.join(size, "conv_id").select("conv_id", "speaker", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    both = parts.withColumn("block", F.floor(F.col("part") / PARTS_TOGETHER).cast("long")).join(speakers, ["conv_id", "block"])

    def head(t: Column) -> Column:
        name = F.when(t["role"] == F.col("speaker"), F.lit("assistant")).when(t["role"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), F.translate(plain(F.coalesce(t["role"], F.lit("unknown"))), "\r\n", "  ")))
        return F.concat(F.lit(OPEN), name, F.lit("\n"))

    done = both.withColumn("pieces", F.transform("all", lambda t: F.struct(head(t).alias("head"), t["text"].alias("text"), (t["role"].eqNullSafe(F.col("speaker"))).cast("int").alias("target"))))
    close = F.lit(len(CLOSE))
    empty = F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.coalesce(empty, F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        end = begin + F.length(x["text"])
        span = F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
        return F.struct((end + close).cast("bigint").alias("at"), F.when(x["target"] == 1, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return done.select(
        "conv_id", "part", "speaker",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["text"], F.lit(CLOSE))), "").alias("rendered"),
        F.size("pieces").cast("long").alias("n_turns"), F.transform("pieces", lambda x: x["target"]).alias("mask"),
        F.aggregate("pieces", start, step, lambda a: a["spans"]).alias("spans"),
    )


def whole(parts: DataFrame) -> DataFrame:
    """One row for each dialogue and speaker: its parts one after the other, with spans in the whole. A dialogue has to fit in a row."""
    kind = "struct<at:bigint,spans:array<struct<start:bigint,end:bigint>>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")).cast(kind)

    def add(acc: Column, x: Column) -> Column:
        moved = F.transform(x["spans"], lambda y: F.struct((y["start"] + acc["at"]).alias("start"), (y["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + F.length(x["rendered"])).alias("at"), F.concat(acc["spans"], moved).alias("spans")).cast(kind)

    each = parts.groupBy("conv_id", "speaker").agg(F.array_sort(F.collect_list(F.struct("part", "rendered", "n_turns", "mask", "spans"))).alias("all"))
    return each.select(
        "conv_id", "speaker", F.array_join(F.transform("all", lambda x: x["rendered"]), "").alias("rendered"),
        F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + x["n_turns"]).alias("n_turns"), F.flatten(F.transform("all", lambda x: x["mask"])).alias("mask"),
        F.aggregate("all", start, add, lambda acc: acc["spans"]).alias("spans"),
    )


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    return found.select("conv_id", "part", "speaker", "rendered", "n_turns", F.array_join(F.col("mask").cast("array<string>"), "").alias("mask"), spans.alias("spans"))


OP3_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), text, role NULLS FIRST) - 1 AS place FROM t
), s AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS NOT NULL AND role <> 'system'
), j AS (
  SELECT n.*, CAST(place // {PART_TURNS} AS BIGINT) AS part, speaker, coalesce(role = speaker, false) AS target,
         '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system'
                                ELSE 'user name=' || translate(replace(coalesce(role, 'unknown'), '<|im_', '<| im_'), chr(13) || chr(10), '  ') END || chr(10) AS head
  FROM n JOIN s USING (conv_id)
), k AS (
  SELECT *, place AS r FROM j
), o AS (
  SELECT *, coalesce(sum(length(head) + length(text) + {len(CLOSE)}) OVER (PARTITION BY conv_id, part, speaker ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM k
)
SELECT conv_id, part, speaker, string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY r) AS rendered, count(*) AS n_turns,
       string_agg(CASE WHEN target THEN '1' ELSE '0' END, '' ORDER BY r) AS mask,
       coalesce(string_agg(CASE WHEN target THEN CAST(CAST(base + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(base + length(head) + length(text) AS BIGINT) AS VARCHAR) END, ',' ORDER BY r), '') AS spans
FROM o GROUP BY conv_id, part, speaker
"""
