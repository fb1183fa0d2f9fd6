"""Statistics of scored completions: per prompt, per step, per run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom import constants as K
from scoreloom.config import DEFAULT, RewardConfig
from scoreloom.functions import sqltext as sql
from scoreloom.functions import text as T
from scoreloom.functions.signals import BUILT_IN, SignalRegistry, clamp, measure, script_count
from scoreloom.operators.lookup import HOT_SHARE, join_groups, join_keyed
from scoreloom.operators.numbering import number_blocks
from scoreloom.operators.quantiles import quantiles
from scoreloom.staging import staged

def _reward_stats() -> list[Column]:
    return [
        F.avg("reward").alias("mean_reward"),
        F.stddev_samp("reward").alias("sd_reward"),
        F.min("reward").alias("min_reward"),
        F.max("reward").alias("max_reward"),
        F.count("*").alias("n_rows"),
    ]


def reward_by_step(
    scored: DataFrame,
    order_by: str = "comp_id",
    step_rows: int = K.STEP_ROWS,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Reward statistics of every ``step_rows`` consecutive completions."""
    stepped = number_blocks(
        scored.select(order_by, "reward"), [order_by], step_rows, "step", rows_per_range
    )
    return stepped.groupBy("step").agg(*_reward_stats())


def group_advantage(
    scored: DataFrame,
    prompt: str = "prompt_id",
    reward: str = "reward",
    eps: float = 1e-4,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Reward relative to the other completions of the same prompt.

    ``(reward - mean) / (sd + eps)`` with the sample deviation; the completion
    of a prompt that has no other gets 0. Pass the columns to keep and nothing
    more: they are stored once, so that scoring does not run for each pass. The
    statistics are aggregated before the exchange and no prompt is ever gathered
    in one task.
    """
    rows = staged(scored, "group-advantage")
    stats = rows.groupBy(prompt).agg(
        F.count("*").alias("group_rows"),
        F.avg(reward).alias("group_mean"),
        F.stddev_samp(reward).alias("group_sd"),
    )
    joined = join_keyed(rows, stats, prompt, "group_rows", share)
    relative = (F.col(reward) - F.col("group_mean")) / (F.col("group_sd") + F.lit(float(eps)))
    return joined.withColumn(
        "advantage", F.when(F.col("group_rows") > 1, relative).otherwise(F.lit(0.0))
    )


def preference_pairs(
    scored: DataFrame,
    prompt: str = "prompt_id",
    text: str = "completion",
    comp_id: str = "comp_id",
) -> DataFrame:
    """Best and worst completion of each prompt whose rewards differ.

    Among equal rewards the lower id ranks higher. The picks are made on narrow rows and
    written, so that rewards are computed once; only the texts of picked completions are
    then fetched by id, in one pass.
    """
    order = F.struct(F.col("reward").alias("reward"), (-F.col(comp_id)).alias("rank"))
    ends = scored.groupBy(prompt).agg(
        F.max_by(comp_id, order).alias("chosen_id"), F.min_by(comp_id, order).alias("rejected_id"),
        (F.max("reward") - F.min("reward")).alias("margin"),
    ).where("margin > 0")
    ends = staged(ends, "picks")
    pick = ["chosen_id", "rejected_id"]
    wanted = ends.select("*", F.explode(F.array(*pick)).alias("pick_id"))
    found = wanted.join(scored.select(F.col(comp_id).alias("pick_id"), text), "pick_id")
    texts = [F.max(F.when(F.col("pick_id") == F.col(p), F.col(text))).alias(p.removesuffix("_id")) for p in pick]
    return found.groupBy(prompt, *pick, "margin").agg(*texts).select(prompt, *pick, "chosen", "rejected", "margin")


def best_of_prompt(scored: DataFrame, prompt: str = "prompt_id", comp_id: str = "comp_id") -> DataFrame:
    """Per prompt: completions, mean reward, best reward and its completion."""
    order = F.struct(F.col("reward"), -F.col(comp_id))
    return scored.groupBy(prompt).agg(
        F.count("*").alias("n_rows"),
        F.avg("reward").alias("mean_reward"),
        F.max("reward").alias("best_reward"),
        F.max_by(comp_id, order).alias("best_id"),
    )


# --- checks -----------------------------------------------------------------------


def checks(config: RewardConfig = DEFAULT) -> dict[str, Column]:
    """Yes/no questions of an evaluation, over measured completions."""
    filled = F.col("text_length") > 0
    return {
        "is_empty": ~filled,
        "all_script": filled & (F.col("script_length") == F.col("text_length")),
        "mostly_script": filled & (F.col("script_length") / F.col("text_length") > 0.9),
        "tags_right": (F.col("think_end") > 0)
        & (F.col("answer_end") > 0)
        & (F.col("think_at") < F.col("answer_at")),
        "has_reason_word": filled & F.col("has_keyword"),
        "has_forbidden_word": filled & F.col("has_forbidden"),
    }


def evaluation_report(
    scored: DataFrame,
    by: str,
    config: RewardConfig = DEFAULT,
    at: Sequence[float] = (0.1, 0.5, 0.9),
) -> DataFrame:
    """Share of completions passing each check, mean reward and exact quantiles.

    ``scored`` has to keep its measurements. The text is read once: rows are
    counted per group and reward, and both halves of the report come from that.
    """
    flags = checks(config)
    counted = staged(
        scored.groupBy(by, "reward").agg(
            F.count("*").alias("n"),
            *(F.count_if(test).alias(name) for name, test in flags.items()),
        ),
        "evaluation-report",
    )
    total = F.sum("n")
    shares = counted.groupBy(by).agg(
        total.alias("n_rows"),
        (F.sum(F.col("reward") * F.col("n")) / total).alias("mean_reward"),
        *((F.sum(name) / total).alias(f"share_{name}") for name in flags),
    )
    names = [f"p{round(q * 100):02d}_reward" for q in at]
    return join_groups(shares, quantiles(counted, [by], "reward", "n", at, names), [by])


def quality_reason(
    config: RewardConfig = DEFAULT, min_script: float = 0.5, need_tags: bool = True
) -> Column:
    """Why a measured completion is dropped; null when it is kept."""
    passed = checks(config)
    reason = F.when(passed["is_empty"], "empty").when(
        F.col("script_length") / F.col("text_length") < F.lit(float(min_script)), "script"
    )
    if need_tags:
        reason = reason.when(~passed["tags_right"], "tags")
    return reason.when(passed["has_forbidden_word"], "forbidden")


def quality_filter(
    df: DataFrame,
    config: RewardConfig = DEFAULT,
    text: str = "completion",
    min_script: float = 0.5,
    need_tags: bool = True,
) -> DataFrame:
    """Completions that pass every check; the columns stay as they are.

    A filter on the measurements would be pushed below them, which means
    measuring twice. The reason goes through a one-element list, and filters on
    list elements stay where they are.
    """
    measured = measure(df, config, text)
    reason = F.array(quality_reason(config, min_script, need_tags))
    judged = measured.select(*df.columns, F.explode_outer(reason).alias("drop_reason"))
    return judged.where(F.col("drop_reason").isNull()).drop("drop_reason")


def quality_summary(
    df: DataFrame,
    config: RewardConfig = DEFAULT,
    text: str = "completion",
    min_script: float = 0.5,
    need_tags: bool = True,
) -> DataFrame:
    """How many completions are kept, and how many dropped for which reason."""
    reason = F.coalesce(quality_reason(config, min_script, need_tags), F.lit("kept"))
    return (
        measure(df, config, text)
        .groupBy(reason.alias("reason"))
        .agg(F.count("*").alias("n_rows"), F.sum(F.length(T.text_or_empty(F.col(text)))).alias("n_chars"))
    )


# --- whole-run aggregates -----------------------------------------------------------


def component_contribution(
    scored: DataFrame, config: RewardConfig = DEFAULT, registry: SignalRegistry = BUILT_IN
) -> DataFrame:
    """Per signal: mean, weighted mean and range, beside the share of clamped rows.

    All signals are aggregated in one pass; the single result row is turned
    afterwards.
    """
    aggs = [
        F.count("*").alias("n_rows"),
        F.expr("avg(CAST(reward <> raw_reward AS DOUBLE)) AS share_clamped"),
    ]
    entries = []
    for name, _ in registry:
        score = sql.column(f"r_{name}")
        weighted = f"{sql.number(config.weights[name])} * {score}"
        stats = f"avg({score}) AS mean, avg({weighted}) AS weighted, min({score}) AS low, max({score}) AS high"
        aggs.append(F.expr("struct(" + stats + ")").alias(f"s_{name}"))
        of = sql.column(f"s_{name}")
        entries.append(
            f"named_struct('component', {sql.text(name)}, 'mean_score', {of}.mean,"
            f" 'mean_weighted', {of}.weighted, 'min_score', {of}.low, 'max_score', {of}.high)"
        )
    turned = F.expr(f"inline(array({', '.join(entries)}))")
    return scored.agg(*aggs).select("n_rows", "share_clamped", turned)


def config_sweep(
    df: DataFrame, configs: Mapping[str, RewardConfig], text: str = "completion"
) -> DataFrame:
    """Reward statistics of the same completions under several configurations.

    The text is measured once per distinct set of word lists, normally once in
    all; every configuration then only costs arithmetic. Rows are repeated per
    configuration inside the stage and aggregated before the exchange.
    """
    if not configs:
        raise ValueError("no configuration to sweep over")
    by_lists: dict[tuple, dict[str, RewardConfig]] = {}
    for name, config in configs.items():
        lists = tuple(config.lexicon.values())
        by_lists.setdefault(lists, {})[name] = config
    out = None
    for family in by_lists.values():
        part = _sweep_family(df, family, text)
        out = part if out is None else out.unionByName(part)
    return out


def _sweep_family(df: DataFrame, family: Mapping[str, RewardConfig], text: str) -> DataFrame:
    measured = measure(df.select(text), next(iter(family.values())), text)
    scores, totals, entries = {}, {}, []
    for i, (name, config) in enumerate(family.items()):
        scores.update({f"s{i}_{c}": column for c, column in BUILT_IN.columns(config).items()})
        totals[f"t{i}"] = F.expr(BUILT_IN.total(config, f"s{i}_r_"))
        bounded = clamp(f"t{i}", config)
        entries.append(
            f"named_struct('config_id', {sql.text(name)}, 'reward', {bounded},"
            f" 'clamped', CAST({bounded} <> t{i} AS DOUBLE))"
        )
    rows = measured.withColumns(scores).withColumns(totals)
    rows = rows.select(F.expr(f"inline(array({', '.join(entries)}))"))
    return rows.groupBy("config_id").agg(*_reward_stats(), F.avg("clamped").alias("share_clamped"))


def lexicon_coverage(
    df: DataFrame, lexicon: Mapping[str, Sequence[str]], text: str = "completion"
) -> DataFrame:
    """Per list and word: texts holding the word, and their share of all texts.

    One aggregate per word in a single pass; words without a hit stay in.
    """
    words = [(name, word) for name, entries in lexicon.items() for word in entries]
    if not words:
        raise ValueError("the lexicon is empty")
    body = f"coalesce({sql.column(text)}, '')"
    hits = [
        F.expr(f"count_if(contains({body}, {sql.text(word)})) AS w{i}") for i, (_, word) in enumerate(words)
    ]
    entries = ", ".join(
        f"named_struct('list', {sql.text(name)}, 'word', {sql.text(word)}, 'n_hits', w{i})"
        for i, (name, word) in enumerate(words)
    )
    totals = df.agg(F.count("*").alias("n_rows"), *hits)
    return totals.select("n_rows", F.expr(f"inline(array({entries}))")).select(
        "list", "word", "n_hits", (F.col("n_hits") / F.col("n_rows")).alias("share")
    )


def script_profile(df: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Share of Arabic characters per group, over all characters and per text."""
    body = f"coalesce({sql.column(text)}, '')"
    measured = df.select(
        *by, F.expr(f"length({body}) AS n"), F.expr(f"{script_count(body)} AS arabic")
    ).withColumn("ratio", F.when(F.col("n") > 0, F.col("arabic") / F.col("n")).otherwise(F.lit(0.0)))
    return measured.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.sum("n").alias("n_chars"),
        F.sum("arabic").alias("n_script"),
        F.coalesce(F.try_divide(F.sum("arabic"), F.sum("n")), F.lit(0.0)).alias("script_share"),
        F.avg("ratio").alias("mean_ratio"),
        F.avg((F.col("ratio") > 0.9).cast("double")).alias("share_mostly_script"),
    )


def review_list(
    scored: DataFrame, k: int, best_first: bool = False, text: str = "completion", preview: int = 50
) -> DataFrame:
    """The ``k`` lowest (or highest) rewards with the start of their text."""
    order = F.col("reward").desc() if best_first else F.col("reward").asc()
    return (
        scored.select("comp_id", "prompt_id", "reward", F.substring(text, 1, preview).alias("preview"))
        .orderBy(order, "comp_id")
        .limit(k)
    )
