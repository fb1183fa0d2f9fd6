"""Completions in, scored completions out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.config import DEFAULT, RewardConfig
from scoreloom.functions import sqltext as sql
from scoreloom.functions.signals import BUILT_IN, MEASURES, SignalRegistry, clamp, measure


def score_completions(
    df: DataFrame,
    config: RewardConfig = DEFAULT,
    text: str = "completion",
    registry: SignalRegistry = BUILT_IN,
    keep_measures: bool = False,
) -> DataFrame:
    """Add one ``r_<signal>`` column per signal, ``raw_reward`` and ``reward``.

    One scan and one stage; works the same on a batch table and on a stream.
    An empty table stays empty, with the full schema.
    """
    scored = measure(df, config, text).withColumns(registry.columns(config))
    scored = scored.withColumn("raw_reward", F.expr(registry.total(config)))
    scored = scored.withColumn("reward", F.expr(clamp("raw_reward", config)))
    return scored if keep_measures else scored.drop(*MEASURES)


def export_rewards(scored: DataFrame, *ids: str) -> DataFrame:
    """Identifiers and the reward as the 32-bit float a trainer takes."""
    return scored.select(*ids, F.col("reward").cast("float").alias("reward"))


def component_log(
    scored: DataFrame,
    config: RewardConfig = DEFAULT,
    ids: tuple[str, ...] = ("comp_id",),
    registry: SignalRegistry = BUILT_IN,
) -> DataFrame:
    """Long form of the score columns: one row per completion and signal."""
    entries = ", ".join(
        f"named_struct('component', {sql.text(name)}, 'score', {sql.column('r_' + name)},"
        f" 'weighted', {sql.number(config.weights[name])} * {sql.column('r_' + name)})"
        for name, _ in registry
    )
    return scored.select(*ids, F.expr(f"inline(array({entries}))"))
