"""The signals as SQL functions.

Temporary SQL functions expand into the plan of the calling query, so scoring
from SQL is as visible to the optimizer as scoring from Python. The functions
are the same SQL the column form uses: the parameters of a score function carry
the names of the measurements it reads.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from scoreloom.config import DEFAULT, RewardConfig
from scoreloom.functions import signals as S
from scoreloom.functions import sqltext as sql
from scoreloom.functions import text as T


def definitions(config: RewardConfig = DEFAULT, prefix: str = "reward_") -> dict[str, str]:
    """Function bodies by signature, in the order they have to be created."""
    body = "coalesce(txt, '')"
    think, answer = config.think_tags, config.answer_tags
    words = {
        "has_keyword": ("contains_keywords", S.keyword_presence, config.keywords_to_reward),
        "has_forbidden": ("not_contains_forbidden", S.forbidden_absence, config.keywords_to_penalize),
    }
    out = {
        f"{prefix}of_length(text_length INT)": S.length_target(config),
        f"{prefix}length(txt STRING)": f"{prefix}of_length(length({body}))",
        f"{prefix}of_script(text_length INT, script_length INT)": S.script_purity(config),
        f"{prefix}arabic_only(txt STRING)": f"{prefix}of_script(length({body}), {S.script_count(body)})",
    }
    for measured, (name, score, entries) in words.items():
        helper = f"{prefix}of_{name}"
        out[f"{helper}(text_length INT, {measured} BOOLEAN)"] = score(config)
        out[f"{prefix}{name}(txt STRING)"] = f"{helper}(length({body}), {T.contains_any(body, entries)})"
    out |= {
        f"{prefix}of_question(text_length INT, is_question BOOLEAN, has_question_word BOOLEAN)": (
            S.question_words(config)
        ),
        f"{prefix}question_words_not_in_answer(txt STRING)": (
            f"{prefix}of_question(length({body}), {S.ends_as_question(body)},"
            f" {T.contains_any(body, config.arabic_question_words)})"
        ),
        f"{prefix}of_tags(think_at INT, answer_at INT, think_end INT, answer_end INT,"
        " has_think_tag BOOLEAN, has_answer_tag BOOLEAN)": S.tag_structure(config),
        f"{prefix}of_openings(txt STRING, think_at INT, answer_at INT)": (
            f"{prefix}of_tags(think_at, answer_at, {S.pair_end('txt', 'think_at', think)},"
            f" {S.pair_end('txt', 'answer_at', answer)},"
            f" think_at > 0 OR contains(txt, {sql.text(think[1])}),"
            f" answer_at > 0 OR contains(txt, {sql.text(answer[1])}))"
        ),
        f"{prefix}think_answer_tags(txt STRING)": (
            f"{prefix}of_openings({body}, {S.pair_start(body, think)},"
            f" {S.pair_start(body, answer)})"
        ),
    }
    total = " + ".join(
        f"{sql.number(config.weights[name])} * {prefix}{name}(txt)" for name, _ in S.BUILT_IN
    )
    out[f"{prefix}total(txt STRING)"] = S.clamp(total, config)
    return out


def register(spark: SparkSession, config: RewardConfig = DEFAULT, prefix: str = "reward_") -> list[str]:
    """Create the functions in the session and return their names."""
    names = []
    for signature, body in definitions(config, prefix).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS DOUBLE RETURN {body}")
        names.append(signature.split("(")[0])
    return names
