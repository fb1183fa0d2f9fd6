"""Reward signals as column expressions, and the registry that holds them.

Scoring happens in two projections. The first measures the text once (length,
script count, tag positions, word hits); the second turns the measurements into
scores. Measurements are used by several branches of a score, so keeping them in
a projection of their own means each regex or search runs once per row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom import constants as K
from scoreloom.config import RewardConfig
from scoreloom.functions import sqltext as sql
from scoreloom.functions import text as T

Signal = Callable[[RewardConfig], Column | str]

MEASURES = (
    "text_length", "script_length", "think_at", "answer_at", "think_end", "answer_end", "has_think_tag",
    "has_answer_tag", "has_keyword", "has_forbidden", "has_question_word", "is_question",
)


def measure(df: DataFrame, config: RewardConfig, text: str = "completion") -> DataFrame:
    """Add the measurements every built-in signal draws on."""
    taken = [c for c in MEASURES if c in df.columns]
    if taken:
        raise ValueError(f"the table has columns {taken} of its own; rename or drop them")
    name = sql.column(text)
    body = f"coalesce({name}, '')"
    think, answer = config.think_tags, config.answer_tags
    first = df.withColumns(
        {
            "text_length": F.expr(f"length({body})"),
            "script_length": F.expr(script_count(body)),
            "think_at": F.expr(pair_start(body, think)),
            "answer_at": F.expr(pair_start(body, answer)),
            "has_keyword": F.expr(T.contains_any(body, config.keywords_to_reward)),
            "has_forbidden": F.expr(T.contains_any(body, config.keywords_to_penalize)),
            "has_question_word": F.expr(T.contains_any(body, config.arabic_question_words)),
            "is_question": F.expr(ends_as_question(body)),
        }
    )
    return first.withColumns(
        {
            "think_end": F.expr(pair_end(body, "think_at", think)),
            "answer_end": F.expr(pair_end(body, "answer_at", answer)),
            "has_think_tag": F.expr(f"think_at > 0 OR contains({body}, {sql.text(think[1])})"),
            "has_answer_tag": F.expr(f"answer_at > 0 OR contains({body}, {sql.text(answer[1])})"),
        }
    )


# --- measurements as SQL ----------------------------------------------------------


def script_count(body: str) -> str:
    """Characters in the Arabic blocks; pure ASCII text skips the regex."""
    # joined runs: far fewer matches to collect than one per character
    runs = f"regexp_extract_all({body}, {sql.text(T.ARABIC_CLASS + '++')}, 0)"
    counted = f"length(array_join({runs}, ''))"
    return f"if(octet_length({body}) = length({body}), 0, {counted})"


def ends_as_question(body: str) -> str:
    mark = sql.text(K.QUESTION_MARK)
    bare = f"trim(BOTH {sql.text(T.WHITESPACE)} FROM {body})"
    return f"(contains({body}, {mark}) AND endswith({bare}, {mark}))"


def pair_start(body: str, tags: tuple[str, str]) -> str:
    """Position of the first opening tag, else 0. Looking for bytes comes first."""
    opening = sql.text(tags[0])
    return f"if(contains({body}, {opening}), locate({opening}, {body}), 0)"


def pair_end(body: str, start: str, tags: tuple[str, str]) -> str:
    """Position of the first closing tag behind the first opening one, else 0."""
    behind = f"{start} + {len(tags[0])}"
    return f"if({start} > 0, locate({sql.text(tags[1])}, {body}, {behind}), 0)"


# --- scores as SQL over the measurements --------------------------------------------


def script_purity(config: RewardConfig) -> str:
    """Reward text written in the Arabic blocks, penalise the rest by its share."""
    factor = config.arabic_penalty_factor
    if config.script_mode == "literal":
        return sql.number(-factor)
    return f"""CASE WHEN text_length = 0 THEN {sql.number(-factor)}
        WHEN script_length = text_length THEN {sql.number(factor / 2)}
        WHEN script_length / text_length > {sql.number(0.9)} THEN {sql.number(factor / 4)}
        ELSE {sql.number(-factor)} * ({sql.number(1)} - script_length / text_length) END"""


def length_target(config: RewardConfig) -> str:
    """Reward lengths near the target, penalise the distance otherwise."""
    target, per_char = config.target_length, config.length_penalty_per_char
    tolerance = target * 0.15
    off = f"abs(text_length - {target!r})" if isinstance(target, int) else f"abs(text_length - {sql.number(target)})"
    near = f"{sql.number(config.length_positive_close)} * ({sql.number(1)} - {off} / {sql.number(tolerance)})"
    return f"""CASE WHEN text_length = 0 THEN {sql.number(-target * per_char * 2)}
        WHEN {off} = 0 THEN {sql.number(config.length_positive_exact)}
        WHEN {off} <= {sql.number(tolerance)} THEN {near}
        ELSE -({sql.number(0.1)} + {off} * {sql.number(per_char)}) END"""


def keyword_presence(config: RewardConfig) -> str:
    value = sql.number(config.reward_keywords_value)
    return f"if(text_length > 0 AND has_keyword, {value}, {sql.number(0)})"


def forbidden_absence(config: RewardConfig) -> str:
    value = sql.number(-config.forbidden_penalty_value)
    return f"if(text_length > 0 AND has_forbidden, {value}, {sql.number(0)})"


def question_words(config: RewardConfig) -> str:
    """Penalise question words, unless the text itself is a question."""
    value = sql.number(-config.q_words_penalty_value)
    return f"if(text_length > 0 AND NOT is_question AND has_question_word, {value}, {sql.number(0)})"


def tag_structure(config: RewardConfig) -> str:
    """Reward a complete think pair before a complete answer pair.

    A pair is broken when one of its tags occurs without making it complete.
    """
    reward, penalty = config.think_answer_reward_value, config.think_answer_penalty_value
    zero, broken = sql.number(0), sql.number(penalty)
    swapped = sql.number(reward + config.think_answer_order_penalty)
    return f"""if(has_think_tag AND think_end = 0, {broken}, {zero})
        + if(has_answer_tag AND answer_end = 0, {broken}, {zero})
        + CASE WHEN think_end > 0 AND answer_end > 0
            THEN if(think_at > answer_at, {swapped}, {sql.number(reward)})
          WHEN think_end > 0 OR answer_end > 0 THEN {sql.number(penalty / 2)}
          ELSE {zero} END"""


@dataclass(frozen=True)
class SignalRegistry:
    """Signals by name, in the order their weighted terms are added.

    A signal takes the configuration and returns a column, or the SQL of one, over
    the measurements and any other column of the scored table. Its weight is looked up by name.
    """

    signals: Mapping[str, Signal]

    def with_signal(self, name: str, signal: Signal) -> SignalRegistry:
        if name in self.signals:
            raise ValueError(f"signal {name!r} is registered already")
        return SignalRegistry({**self.signals, name: signal})

    def __iter__(self):
        return iter(self.signals.items())

    def columns(self, config: RewardConfig) -> dict[str, Column]:
        missing = [name for name in self.signals if name not in config.weights]
        if missing:
            raise KeyError(f"weights lack {missing}")
        scores = {f"r_{name}": signal(config) for name, signal in self}
        return {
            name: (F.expr(score) if isinstance(score, str) else score).cast("double")
            for name, score in scores.items()
        }

    def total(self, config: RewardConfig, prefix: str = "r_") -> str:
        """SQL of the weighted sum of the score columns, added in registry order."""
        return " + ".join(
            f"{sql.number(config.weights[name])} * {sql.column(prefix + name)}" for name, _ in self
        )


BUILT_IN = SignalRegistry(
    {
        "length": length_target,
        "arabic_only": script_purity,
        "contains_keywords": keyword_presence,
        "not_contains_forbidden": forbidden_absence,
        "question_words_not_in_answer": question_words,
        "think_answer_tags": tag_structure,
    }
)


def batch_signal(
    function: Callable[..., Sequence[float]],
    prompt: str = "prompt",
    completion: str = "completion",
    columns: Sequence[str] = (),
) -> Signal:
    """A signal from a callable ``(prompts, completions, **columns) -> scores`` over whole batches.

    The callable gets lists, an Arrow batch of rows at a time, and gives one number per row. Null
    prompts and completions are empty; values of the further columns come as they are.
    """

    @F.pandas_udf("double")
    def scores(*series: pd.Series) -> pd.Series:
        prompts, completions, *more = (s.astype(object).where(s.notna(), None).tolist() for s in series)
        found = function(prompts, completions, **dict(zip(columns, more, strict=True)))
        if len(found) != len(prompts):
            raise ValueError(f"{len(found)} scores for {len(prompts)} completions")
        return pd.Series(list(found), dtype="float64")

    texts = [F.coalesce(F.col(c), F.lit("")) for c in (prompt, completion)]
    return lambda config: scores(*texts, *map(F.col, columns))


def clamp(total: str, config: RewardConfig) -> str:
    """SQL that bounds a total; the upper bound wins if the two cross."""
    bounds = config.clamp_rewards
    if not bounds:
        return total
    if bounds["min"] is not None:
        total = f"greatest({sql.number(bounds['min'])}, {total})"
    if bounds["max"] is not None:
        total = f"least({sql.number(bounds['max'])}, {total})"
    return total
