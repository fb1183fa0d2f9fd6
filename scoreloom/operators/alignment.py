"""Bringing prompts to completions: by position, and from token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.config import DEFAULT, RewardConfig
from scoreloom.operators.lookup import HOT_SHARE, left_lookup
from scoreloom.operators.scoring import export_rewards, score_completions

#: Shown for an id that the vocabulary does not hold.
UNKNOWN_PIECE = "\ufffd"
ID_COLUMNS = ("prompt_input_ids", "query_input_ids", "input_ids")


def align_prompts(
    completions: DataFrame,
    prompts: DataFrame,
    position: str = "pos",
    prompt_position: str = "prompt_pos",
    prompt: str = "prompt",
) -> DataFrame:
    """Pair position-identified completions with position-identified prompts.

    Positions count from 0 on both sides. If the number of completions is a
    multiple of the number of prompts, each prompt serves a block of consecutive
    completions; otherwise prompts repeat in turn. Without prompts every
    completion gets the empty string.

    Tables that know the prompt of each completion should join on it instead.
    """
    n, p = completions.count(), prompts.count()
    if p == 0:
        return completions.withColumns(
            {prompt_position: F.lit(None).cast("bigint"), prompt: F.lit("")}
        )
    at = F.col(position)
    block = F.expr(f"`{position}` div {max(n // p, 1)}")
    target = block if n % p == 0 else at % F.lit(p)
    # Every prompt serves the same number of completions, so keys are even; only
    # a handful of prompts would leave most tasks idle. Then prompts are repeated
    # and completions spread over the repeats: at most one row per task is added.
    tasks = int(completions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeats = max(1, -(-tasks // p))
    left = completions.withColumns(
        {
            prompt_position: target.cast("bigint"),
            "repeat_no": F.pmod(F.xxhash64(position), F.lit(repeats)).cast("int"),
        }
    )
    right = prompts.select(
        F.col(prompt_position).cast("bigint").alias(prompt_position),
        F.col(prompt),
        F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_no"),
    )
    return left.join(right, [prompt_position, "repeat_no"], "left").drop("repeat_no")


def join_prompts(
    completions: DataFrame,
    prompts: DataFrame,
    key: str = "prompt_id",
    spread_by: str = "comp_id",
    share: float = HOT_SHARE,
) -> DataFrame:
    """Pair completions with prompts by key; completions without a partner get a null prompt.

    A prompt asked for by more than ``share`` of all completions is repeated, once for each such share of them,
    and its completions are dealt over the repeats by ``spread_by``. All prompts together get at most
    ``1 / share`` repeats, and no task gets more of one prompt than that share. Only the keys and numbers of
    repeats are broadcast, at most ``1 / share`` of them; texts are exchanged.
    """
    counts = completions.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    limit = completions.agg(F.greatest(F.count("*") * F.lit(share), F.lit(1.0)).alias("limit")).scalar()
    hot = counts.where(F.col("rows") > limit).select(F.col(key).alias("hot_key"), F.ceil(F.col("rows") / limit).alias("repeats"))
    hot = F.broadcast(hot)
    # a null key meets no prompt, so its rows may go anywhere
    repeats = F.when(F.col(key).isNull(), F.lit(round(1 / share))).otherwise(F.coalesce("repeats", F.lit(1)))
    left = completions.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn(
        "repeat_no", F.pmod(F.xxhash64(spread_by), repeats)
    )
    right = prompts.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn(
        "repeat_no", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("repeats", F.lit(1)) - 1))
    )
    extra = ("hot_key", "repeats")
    return left.drop(*extra).join(right.drop(*extra), [key, "repeat_no"], "left").drop("repeat_no")


def decode_ids(
    batch: DataFrame,
    vocab: DataFrame,
    key: str = "prompt_id",
    separator: str = "",
    small: bool | None = None,
) -> DataFrame:
    """Token ids back to text, special tokens left out, unknown ids as ``UNKNOWN_PIECE``.

    Takes the first of ``prompt_input_ids``, ``query_input_ids`` and
    ``input_ids`` the table has. A table that brings its prompt text in a
    ``prompt`` column is returned as is; one without either gets empty prompts.
    """
    if "prompt" in batch.columns:
        return batch.select(key, "prompt")
    ids = next((c for c in ID_COLUMNS if c in batch.columns), None)
    if ids is None:
        return batch.select(key, F.lit("").alias("prompt"))
    # -1 stands for "no token here": rows without ids still give a prompt
    tokens = batch.select(key, F.posexplode_outer(ids).alias("pos", "id")).select(
        key, "pos", F.coalesce("id", F.lit(-1)).alias("token_id")
    )
    pieces = left_lookup(tokens, vocab.select("token_id", "piece", "is_special"), "token_id", ("piece",), small)
    unknown = F.struct("pos", F.lit(UNKNOWN_PIECE).alias("piece"))
    shown = F.when(~F.col("is_special"), F.struct("pos", "piece")).when(
        F.col("is_special").isNull() & (F.col("token_id") >= 0), unknown
    )
    ordered = F.array_sort(F.collect_list(shown))
    text = F.array_join(F.transform(ordered, lambda s: s["piece"]), separator)
    return pieces.groupBy(key).agg(text.alias("prompt"))


def reward_callback(
    completions: DataFrame,
    prompts: DataFrame,
    vocab: DataFrame,
    config: RewardConfig = DEFAULT,
    separator: str = "",
    ids: tuple[str, ...] = (),
) -> DataFrame:
    """What a trainer asks for: ``(*ids, pos, prompt, reward)``, the reward a 32-bit float.

    ``completions`` are numbered by ``pos``, ``prompts`` by ``prompt_pos``, both from 0. Prompts
    come as text or as token ids of ``vocab``; those given as ids are decoded first. ``pos`` gives the order.
    """
    texts = decode_ids(prompts, vocab, key="prompt_pos", separator=separator)
    scored = score_completions(align_prompts(completions, texts), config)
    return export_rewards(scored, *ids, "pos", "prompt")
