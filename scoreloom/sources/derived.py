"""Completion and instruction tables derived from the raw text tables.

The raw text holds neither Arabic nor tags, so rows are dressed with both. Every
document and every conversation pair goes in, with its whole text; empty and
script-only texts are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators.conversations import turn_pairs

# Each document gives a row with its whole text between marks, and a second row, with a
# negative id, that is empty or holds hardly anything but script.
COMPLETIONS_SQL = """
SELECT doc_id AS comp_id, CAST(FLOOR(doc_id / 4.0) AS BIGINT) AS prompt_id,
 CAST(doc_id % 4 AS INT) AS gen_idx, lang, source,
 CASE doc_id % 10
  WHEN 0 THEN text
  WHEN 1 THEN concat('<think>', a, '</think><answer>', b, '</answer>')
  WHEN 2 THEN concat('<answer>', b, '</answer><think>', a, '</think>')
  WHEN 3 THEN concat('<think>', b)
  WHEN 4 THEN concat(b, '</think>')
  WHEN 5 THEN concat('<answer>', b, '</answer>')
  WHEN 6 THEN concat(repeat('ب', CAST(1 + doc_id % 97 AS INT)), ' ', text)
  WHEN 7 THEN concat('أنا آسف ', b)
  WHEN 8 THEN concat('لأن ', repeat('ت', CAST(doc_id % 80 AS INT)), ' ', text, ' ما هذا؟')
  ELSE text END AS completion
FROM (SELECT doc_id, coalesce(text, '') AS text, lang, source,
             concat('بسبب ', repeat('ن', CAST(doc_id % 23 AS INT))) AS a,
             concat('من ', coalesce(text, '')) AS b FROM documents) s
UNION ALL
SELECT -1 - doc_id AS comp_id, CAST(FLOOR(doc_id / 4.0) AS BIGINT) AS prompt_id,
 CAST(4 + doc_id % 4 AS INT) AS gen_idx, lang, source,
 CASE doc_id % 4
  WHEN 0 THEN ''
  WHEN 1 THEN repeat('ب', CAST(1 + doc_id % 97 AS INT))
  WHEN 2 THEN concat('<think>بسبب ', repeat('ن', CAST(doc_id % 23 AS INT)), '</think><answer>لأن</answer>')
  ELSE concat('لأن ', repeat('ت', CAST(doc_id % 80 AS INT)), ' ما هذا؟') END AS completion
FROM documents
"""

INSTRUCT_CONTEXT_SQL = """
 CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN CAST(NULL AS STRING)
  ELSE concat('ctx ', CAST(turn AS STRING)) END
"""
INSTRUCT_ANSWER_SQL = """
 CASE conv_id % 7
  WHEN 1 THEN concat(substr(nt, 1, 40), ' إذن، ', substr(nt, 41))
  WHEN 2 THEN concat('إذن، ', nt)
  WHEN 3 THEN concat(nt, ' إذن،  ')
  WHEN 4 THEN concat('   ', nt)
  WHEN 5 THEN concat(nt, '   ')
  WHEN 6 THEN concat(nt, ' 2024 إذن، أ إذن، ب')
  ELSE nt END
"""
#: Turns of one conversation that ``ex_id`` can tell apart; larger ids end the query, they never meet.
TURNS = 1 << 32
FIRST_SECOND = 1_704_067_200


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def completions_of(documents: DataFrame) -> DataFrame:
    """Completions, four to a prompt. Works on a batch table and on a stream."""
    return documents.sparkSession.sql(COMPLETIONS_SQL.replace("FROM documents", "FROM {documents}"), documents=documents)


def instructions_of(conversations: DataFrame) -> DataFrame:
    """Instruction rows: each user turn with its answer, and once more with a blank one."""
    pairs = turn_pairs(conversations).withColumnRenamed("assistant_text", "nt")
    ex_id = F.col("conv_id") * F.lit(TURNS) + F.col("turn")
    blank = F.when(F.col("conv_id") % 2 == 0, "").otherwise("   ")
    kinds = F.array(
        F.struct(ex_id.alias("ex_id"), F.expr(INSTRUCT_ANSWER_SQL).alias("answer")),
        F.struct((-1 - ex_id).alias("ex_id"), blank.alias("answer")),
    )
    return pairs.select(
        "conv_id",
        F.concat("user_text", F.lit(" "), F.col("conv_id").cast("string")).alias("instruction"),
        F.expr(INSTRUCT_CONTEXT_SQL).alias("context"),
        F.explode(kinds).alias("kind"),
    ).select("kind.ex_id", "conv_id", "instruction", "context", "kind.answer")


def timed(completions: DataFrame) -> DataFrame:
    """Completions with the time they came at, ``ts``: a document's about every half minute, a little out of order."""
    doc = F.when(F.col("comp_id") < 0, -1 - F.col("comp_id")).otherwise(F.col("comp_id"))
    after = doc * 30 + doc * 37 % 420 + F.when(F.col("comp_id") < 0, 11).otherwise(0)
    return completions.withColumn("ts", F.timestamp_seconds(after + F.lit(FIRST_SECOND)))


def prompts_of(documents: DataFrame) -> DataFrame:
    """A prompt text for every ``prompt_id`` of the completions, and for more ids."""
    return documents.select(F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"))


def completions(spark: SparkSession, folder: str) -> DataFrame:
    return completions_of(table(spark, folder, "documents"))


def instructions(spark: SparkSession, folder: str) -> DataFrame:
    return instructions_of(table(spark, folder, "conversations"))
