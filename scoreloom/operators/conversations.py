"""Turn-level conversations to instruction rows and chat text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.templates import CHATML, Template, as_template

# turns of a conversation that are put in order together
TURNS_PER_TASK = 1000


def turn_pairs(df: DataFrame, turns_per_task: int = TURNS_PER_TASK) -> DataFrame:
    """Each user turn with the assistant turn right behind it.

    A conversation is cut at multiples of ``turns_per_task`` in its turn numbers, so that a long one
    spreads over many tasks. Of conversations in several parts, the last turn of each part then
    meets the first of the next. Equal turns go by role, then text.
    """
    parts = df.select("conv_id", "turn", "role", "text", F.expr(f"turn div {turns_per_task}").alias("part"))
    window = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    follower = F.lead(F.struct("role", "text")).over(window).alias("next")
    columns = ["conv_id", "turn", "role", "text", "next"]
    inside = parts.select(*columns[:-1], follower)

    several = parts.select("conv_id", "part").distinct().groupBy("conv_id").count().where("count > 1")
    turn = F.struct("turn", "role", "text")
    edges = parts.join(several.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id", "part").agg(
        F.min(turn).alias("head"), F.max(turn).alias("tail")
    )
    after = F.lead("head").over(Window.partitionBy("conv_id").orderBy("part"))
    across = edges.select("conv_id", "tail.*", F.struct(after["role"].alias("role"), after["text"].alias("text")).alias("next"))
    return (
        inside.unionByName(across)
        .where("conv_id IS NOT NULL AND role = 'user' AND next.role = 'assistant'")
        .select("conv_id", "turn", F.col("text").alias("user_text"), F.col("next.text").alias("assistant_text"))
    )


def conversation_messages(df: DataFrame) -> DataFrame:
    """One row per conversation: its turns as an ordered list of messages."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    messages = F.transform(
        turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
    )
    return df.groupBy("conv_id").agg(messages.alias("messages"))


def conversation_text(df: DataFrame, template: Template | str = CHATML, ask: bool = False) -> DataFrame:
    """One row per conversation: its turns as the template writes them.

    Turns are written, and those the template does not show dropped, before the
    exchange. A conversation without a turn to show gives the empty string.
    """
    template = as_template(template)
    piece = F.when(
        template.shows(F.col("role")),
        F.struct("turn", template.turn(F.col("role"), F.col("text")).alias("piece")),
    )
    aggs = [F.collect_list("shown").alias("shown"), F.count("shown").alias("n_turns")]
    if ask:
        aggs.append(F.max_by("role", "turn").alias("last_role"))
    grouped = (
        df.select("conv_id", "turn", "role", piece.alias("shown")).groupBy("conv_id").agg(*aggs)
    )
    text = F.array_join(F.transform(F.array_sort("shown"), lambda t: t["piece"]), "")
    if ask:
        text = F.concat(text, template.opening(F.col("last_role")))
    return grouped.select("conv_id", "n_turns", text.alias("text"))
