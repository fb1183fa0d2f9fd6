"""Instruction rows to messages, prompts and training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom import constants as K
from scoreloom.functions import text as T
from scoreloom.functions.templates import CHATML, Template, as_template

INSTRUCTION_COLUMNS = ("instruction", "context", "answer")


def with_defaults(df: DataFrame, columns: tuple[str, ...] = INSTRUCTION_COLUMNS) -> DataFrame:
    """Add the absent columns as empty strings; present ones stay as they are."""
    absent = {c: F.lit("") for c in columns if c not in df.columns}
    return df.withColumns(absent) if absent else df


# --- column expressions -----------------------------------------------------------


def joined_query(instruction: Column, context: Column, separator: str = K.CONTEXT_SEPARATOR) -> Column:
    """Context, separator, instruction; without a usable context the instruction alone.

    A blank context does not count, a usable one goes in unstripped. Nulls count
    as empty strings.
    """
    instruction, context = T.text_or_empty(instruction), T.text_or_empty(context)
    return F.when(
        T.strip(context) != "", F.concat(context, F.lit(separator), instruction)
    ).otherwise(instruction)


def reasoning_part(answer: Column, marker: str = K.ANSWER_MARKER) -> Column:
    """What stands before the first marker; without one the whole answer, unstripped."""
    at = F.position(F.lit(marker), answer)
    return F.when(at > 0, T.strip(F.substr(answer, F.lit(1), at - 1))).otherwise(answer)


def final_part(answer: Column, marker: str = K.ANSWER_MARKER) -> Column:
    """What stands behind the first marker; without one the empty string."""
    at = F.position(F.lit(marker), answer)
    return F.when(at > 0, T.strip(F.substr(answer, at + len(marker)))).otherwise(F.lit(""))


def tagged_response(reasoning: Column, final: Column) -> Column:
    """Reasoning and final answer in their tags; a missing half is filled in."""
    thought = F.when(reasoning != "", reasoning).otherwise(F.lit(K.PLACEHOLDER_REASONING))
    answer = F.when(final != "", final).otherwise(reasoning)
    body = F.concat(
        F.lit(K.THINK_TAGS[0]), thought, F.lit(K.THINK_TAGS[1]),
        F.lit(K.ANSWER_TAGS[0]), answer, F.lit(K.ANSWER_TAGS[1]),
    )
    return F.when((reasoning == "") & (final == ""), F.lit("")).otherwise(body)


def message_list(*turns: tuple[str, Column]) -> Column:
    return F.array(
        *(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns)
    )


# --- table to table ---------------------------------------------------------------


def add_user_query(
    df: DataFrame, separator: str = K.CONTEXT_SEPARATOR, normalize: bool = True, name: str = "user_query"
) -> DataFrame:
    df = with_defaults(df).withColumn(
        name, joined_query(F.col("instruction"), F.col("context"), separator)
    )
    # a step of its own: the digits of a text are looked for before they are translated
    digits = T.normalize_digits(F.col(name)) if normalize else F.col(name)
    return df.withColumn(name, T.strip(digits))


def add_answer_parts(df: DataFrame) -> DataFrame:
    """Add ``reasoning``, ``final`` and the tagged ``response``."""
    df = with_defaults(df).withColumn("answer_digits", T.normalize_digits(F.col("answer")))
    parts = df.withColumns(
        {"reasoning": reasoning_part(F.col("answer_digits")), "final": final_part(F.col("answer_digits"))}
    ).drop("answer_digits")
    return parts.withColumn("response", tagged_response(F.col("reasoning"), F.col("final")))


def message_dataset(df: DataFrame, system: str = K.SYSTEM_PROMPT) -> DataFrame:
    """Raw columns plus ``messages``: system, user and assistant turn."""
    raw = with_defaults(df)
    full = add_answer_parts(add_user_query(raw))
    messages = message_list(
        ("system", F.lit(system)), ("user", F.col("user_query")), ("assistant", F.col("response"))
    )
    return full.select(*raw.columns, messages.alias("messages"))


def message_rows(messages: DataFrame, key: str = "ex_id") -> DataFrame:
    """One row per message: key, position from 0, role, content.

    The outer form keeps the optimizer from testing the list for emptiness in a
    filter of its own, which would build every message twice.
    """
    turns = messages.select(key, F.posexplode_outer("messages").alias("pos", "turn"))
    return turns.select(key, "pos", "turn.role", "turn.content")


def training_text(df: DataFrame, template: Template | str = CHATML, system: str = K.SYSTEM_PROMPT) -> DataFrame:
    """Raw columns plus ``text``: the three turns as the template writes them."""
    raw = with_defaults(df)
    full = add_answer_parts(add_user_query(raw))
    turns = [("system", F.lit(system)), ("user", F.col("user_query")), ("assistant", F.col("response"))]
    return full.select(*raw.columns, as_template(template).render_turns(turns).alias("text"))


def prompt_dataset(df: DataFrame, template: Template | str = CHATML, system: str = K.SYSTEM_PROMPT) -> DataFrame:
    """Raw columns plus ``prompt`` and empty ``chosen`` and ``rejected``."""
    raw = with_defaults(df)
    full = add_user_query(raw)
    turns = [("system", F.lit(system)), ("user", F.col("user_query"))]
    prompt = as_template(template).render_turns(turns, ask=True)
    return full.select(
        *raw.columns, prompt.alias("prompt"), F.lit("").alias("chosen"), F.lit("").alias("rejected")
    )


def question_prompts(
    df: DataFrame,
    question: str = "question",
    system: str = K.SYSTEM_PROMPT,
    template: Template | str = CHATML,
) -> DataFrame:
    """Prompts for asking a model: the question goes in exactly as it is."""
    turns = [("system", F.lit(system)), ("user", F.col(question))]
    return df.withColumn("prompt", as_template(template).render_turns(turns, ask=True))


def prepare(
    df: DataFrame,
    for_rl: bool = True,
    template: Template | str | None = None,
    max_seq_length: int | None = None,
    system: str = K.SYSTEM_PROMPT,
) -> DataFrame:
    """Prompt table for reinforcement learning, or message table for tuning."""
    if template is None:
        raise ValueError("a template is needed to write prompts or messages")
    if not for_rl and max_seq_length is None:
        raise ValueError("max_seq_length is needed for a message table")
    template = as_template(template)
    return prompt_dataset(df, template, system) if for_rl else message_dataset(df, system)


# --- small table operators ----------------------------------------------------------


def first_rows(df: DataFrame, n: int, order_by: str = "ex_id") -> DataFrame:
    """The first ``n`` rows by id, as a distributed top-k."""
    return df.orderBy(order_by).limit(n)


def peek(df: DataFrame, ids: str = "input_ids", order_by: str = "ex_id") -> DataFrame:
    """The first row by id and how many tokens it has."""
    return first_rows(df, 1, order_by).withColumn("n_tokens", F.size(ids).cast("bigint"))


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def keep_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Drop everything but the listed columns; they must be there."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*columns)


def concat_rows(*tables: DataFrame) -> DataFrame:
    """Bag union by column name; order is carried by the id columns."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out
