import itertools

import pytest
from pyspark.sql import functions as F

from scoreloom.config import DEFAULT, RewardConfig
from scoreloom.functions import sql_functions
from scoreloom.functions.signals import BUILT_IN, batch_signal, measure
from scoreloom.operators.scoring import component_log, export_rewards, score_completions
from scoreloom.sources.tables import COMPLETION_SCHEMA

LITERAL = DEFAULT.with_(script_mode="literal")


def texts(spark, values):
    rows = [(i, i // 4, i % 4, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, COMPLETION_SCHEMA)


def scores(spark, values, config=DEFAULT, column="reward"):
    rows = score_completions(texts(spark, values), config).orderBy("comp_id").collect()
    return [row[column] for row in rows]


def test_golden_scores(spark, golden):
    df = texts(spark, [g["completion"] for g in golden])
    ranges = score_completions(df, keep_measures=True).orderBy("comp_id").collect()
    literal = score_completions(df, LITERAL).orderBy("comp_id").collect()
    names = {
        "length": "r_length", "arabic": "r_arabic_only", "keyword": "r_contains_keywords",
        "forbidden": "r_not_contains_forbidden", "question": "r_question_words_not_in_answer",
        "tags": "r_think_answer_tags", "n": "text_length", "ar": "script_length", "total_rng": "reward",
    }
    for expected, row, lit in zip(golden, ranges, literal, strict=True):
        for key, column in names.items():
            assert row[column] == pytest.approx(expected[key], abs=6e-5), (expected["id"], key)
        assert lit["reward"] == pytest.approx(expected["total_lit"], abs=6e-5), expected["id"]
        assert lit["r_arabic_only"] == -10


def test_sql_functions_equal_columns(spark, golden):
    sql_functions.register(spark)
    df = score_completions(texts(spark, [g["completion"] for g in golden] + [None, "<answer>a</answer><think>"]))
    calls = {f"r_{name}": f"reward_{name}(completion)" for name, _ in BUILT_IN} | {
        "reward": "reward_total(completion)"
    }
    unequal = df.where(" OR ".join(f"NOT ({column} <=> {call})" for column, call in calls.items()))
    assert unequal.count() == 0


@pytest.mark.parametrize(
    "n, expected", [(70, 0.5), (60, 0.2 * (1 - 10 / 10.5)), (59, -0.65), (80, 0.2 * (1 - 10 / 10.5)), (0, -7.0)]
)
def test_length(spark, n, expected):
    assert scores(spark, ["x" * n], column="r_length") == [expected]


def test_length_edge_is_zero(spark):
    config = DEFAULT.with_(target_length=20)
    assert scores(spark, ["x" * 17], config, "r_length") == [0.0]


def test_length_target_may_be_fractional(spark):
    config = DEFAULT.with_(target_length=20.5)
    got = scores(spark, ["x" * 20, "x" * 30], config, "r_length")
    assert got == pytest.approx([0.2 * (1 - 0.5 / (20.5 * 0.15)), -(0.1 + 9.5 * 0.05)])


def test_length_counts_code_points(spark):
    assert scores(spark, ["\N{GRINNING FACE}" * 70], column="r_length") == [0.5]


def test_script_ratio_edges(spark):
    got = scores(spark, ["ب" * 10, "ب" * 19 + " ", "ب" * 9 + " ", "", "abc"], column="r_arabic_only")
    assert got == pytest.approx([5, 2.5, -1, -10, -10])


def test_script_blocks(spark):
    points = [0x05FF, 0x0600, 0x06FF, 0x0700, 0x074F, 0x0750, 0x077F, 0x0780, 0xFB4F, 0xFB50, 0xFDFF, 0xFE00,
              0xFE6F, 0xFE70, 0xFEFF, 0xFF00, 0x1F600, 0x1EE00]
    rows = measure(texts(spark, [chr(p) for p in points]), DEFAULT).orderBy("comp_id").collect()
    inside = [0x0600, 0x06FF, 0x0750, 0x077F, 0xFB50, 0xFDFF, 0xFE70, 0xFEFF]
    assert [r["script_length"] for r in rows] == [int(p in inside) for p in points]


def test_words_are_substrings_and_count_once(spark):
    config = DEFAULT.with_(keywords_to_reward=("cat", "dog"), keywords_to_penalize=("bad",))
    got = score_completions(texts(spark, ["concatenate", "dog cat", "badly", "", "other"]), config)
    rows = got.orderBy("comp_id").collect()
    assert [r["r_contains_keywords"] for r in rows] == [1, 1, 0, 0, 0]
    assert [r["r_not_contains_forbidden"] for r in rows] == [0, 0, -2, 0, 0]


def test_empty_keyword_matches_every_text(spark):
    config = DEFAULT.with_(keywords_to_reward=("",))
    assert scores(spark, ["x", ""], config, "r_contains_keywords") == [1, 0]


def test_empty_list_matches_nothing(spark):
    config = DEFAULT.with_(keywords_to_reward=())
    assert scores(spark, ["x", ""], config, "r_contains_keywords") == [0, 0]


@pytest.mark.parametrize("size", [5, 200])
def test_list_size_does_not_matter(spark, size):
    words = [f"w{i}.\\E[" for i in range(size - 1)] + ["it's"]
    config = DEFAULT.with_(keywords_to_reward=words)
    got = scores(spark, ["a w3.\\E[ b", "w3x\\E[", "so it's", "its"], config, "r_contains_keywords")
    assert got == [1, 0, 1, 0]


def test_question_mark_excuses_question_words(spark):
    got = scores(
        spark, ["ما هذا؟", "ما هذا؟ 　\n", "ما هذا", "؟ ما هذا", "  ", ""], column="r_question_words_not_in_answer"
    )
    assert got == [0, 0, -1, -1, 0, 0]


def test_tag_scores_over_all_small_texts(spark):
    """Every sequence of up to four tag marks, against the rule in words."""
    marks = ["<think>", "</think>", "<answer>", "</answer>"]
    values = ["x".join(c) for n in range(5) for c in itertools.product(marks, repeat=n)]

    def complete(text, opening, closing):
        head, found, rest = text.partition(opening)
        return bool(found) and closing in rest

    def expected(text):
        think, answer = complete(text, *marks[:2]), complete(text, *marks[2:])
        score = -sum(
            not whole and any(mark in text for mark in pair)
            for whole, pair in ((think, marks[:2]), (answer, marks[2:]))
        )
        if think and answer:
            return score + (1 if text.index("<think>") < text.index("<answer>") else 0.5)
        return score - 0.5 * (think or answer)

    got = scores(spark, values, column="r_think_answer_tags")
    assert got == [expected(v) for v in values]
    assert set(got) == {1, 0.5, 0, -0.5, -1, -1.5, -2}


def test_tag_extra_cases(spark):
    values = ["<think>a<answer>b", "</think>x<think>", "<think><answer>x</think></answer>", "", None]
    assert scores(spark, values, column="r_think_answer_tags") == [-2, -1, 1, 0, 0]


def test_clamp(spark):
    assert scores(spark, ["x" * 1837], LITERAL) == [-5]
    assert scores(spark, ["x" * 1837], LITERAL.with_(clamp_rewards=None))[0] < -5
    assert scores(spark, ["x" * 1837], LITERAL.with_(clamp_rewards={"min": None, "max": -50.0}))[0] == -50
    # bounds that cross: the upper one wins
    assert scores(spark, ["x"], DEFAULT.with_(clamp_rewards={"min": 3.0, "max": 1.0})) == [1]


def test_null_text_scores_like_empty(spark):
    assert scores(spark, [None]) == scores(spark, [""]) == pytest.approx([-4.7])


def test_empty_table_keeps_schema(spark):
    out = score_completions(texts(spark, []))
    assert out.count() == 0
    assert {"reward", "raw_reward", *(f"r_{n}" for n, _ in BUILT_IN)} <= set(out.columns)


def test_other_columns_stay(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert score_completions(df, text="text").select(df.columns).exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        score_completions(df.withColumn("think_at", F.lit(1)), text="text")


def test_bounds_may_be_infinite(spark):
    config = DEFAULT.with_(clamp_rewards={"min": float("-inf"), "max": float("inf")})
    assert scores(spark, ["x" * 5000], config) == scores(spark, ["x" * 5000], config, "raw_reward")


def test_one_stage_and_no_python(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    plan = score_completions(df, text="text").select("doc_id", "reward")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_export_and_log(spark, golden):
    scored = score_completions(texts(spark, [g["completion"] for g in golden]))
    assert dict(export_rewards(scored, "comp_id").dtypes)["reward"] == "float"
    log = component_log(scored)
    assert log.count() == 6 * len(golden)
    summed = log.groupBy("comp_id").agg(F.sum("weighted").alias("total")).join(scored, "comp_id")
    assert summed.where(F.abs(F.col("total") - F.col("raw_reward")) > 1e-9).count() == 0


def test_custom_signal(spark):
    registry = BUILT_IN.with_signal("short", lambda c: F.when(F.length("completion") < 5, 1.0).otherwise(0.0))
    config = DEFAULT.reweighted(short=2.0)
    rows = score_completions(texts(spark, ["abc", "abcdef"]), config, registry=registry).orderBy("comp_id").collect()
    base = scores(spark, ["abc", "abcdef"], column="raw_reward")
    assert [r["raw_reward"] for r in rows] == pytest.approx([base[0] + 2, base[1]])
    with pytest.raises(KeyError):
        score_completions(texts(spark, ["a"]), DEFAULT, registry=registry)
    with pytest.raises(ValueError):
        registry.with_signal("short", lambda c: "1.0")


def test_configuration_checks():
    full = {
        "weights": dict(DEFAULT.weights), "arabic_penalty_factor": 10.0, "reward_keywords_value": 1.0,
        "forbidden_penalty_value": 2.0, "q_words_penalty_value": 1.0, "keywords_to_reward": ["a"],
        "keywords_to_penalize": ["b"], "arabic_question_words": ["c"],
    }
    config = RewardConfig.from_mapping(full)
    assert (config.target_length, config.length_positive_exact, config.clamp_rewards) == (70, 0.5, None)
    for key in full:
        with pytest.raises(KeyError):
            RewardConfig.from_mapping({k: v for k, v in full.items() if k != key})
    with pytest.raises(KeyError):
        RewardConfig.from_mapping({**full, "weights": {"length": 1}})
    with pytest.raises(ValueError):
        RewardConfig.from_mapping({**full, "no_such_key": 1})
    with pytest.raises(ValueError):
        RewardConfig(script_mode="other")
    with pytest.raises(TypeError):
        RewardConfig(keywords_to_reward="abc")
    with pytest.raises(KeyError):
        RewardConfig(clamp_rewards={"min": 0})
    assert sum(DEFAULT.weights.values()) == pytest.approx(1.3)


@pytest.mark.parametrize("scale, expected", [
    ("sf0.001", (200, 50, -2.071714, -5.345558, 20, 14, -2.355395, -4.217171)),
    ("sf0.01", (1000, 250, -2.051836, -5.307742, 100, 74, -2.338280, -4.215184)),
])
def test_summary_of_the_fixture_table(spark, fixture_sql, scale, expected):
    spark.read.parquet(f"/root/testdata/{scale}/documents.parquet").createOrReplaceTempView("documents")
    df = spark.sql(fixture_sql["SC"])
    got = score_completions(df).agg(
        F.count("*"), F.countDistinct("prompt_id"), F.avg("r_length"), F.avg("r_arabic_only"),
        F.count_if(F.col("r_arabic_only") == 5), F.count_if(F.col("r_arabic_only") == 2.5), F.avg("reward"),
        F.avg("r_contains_keywords"), F.avg("r_not_contains_forbidden"),
        F.avg("r_question_words_not_in_answer"), F.avg("r_think_answer_tags"), F.min("reward"), F.max("reward"),
    ).first()
    literal = score_completions(df, LITERAL).agg(F.avg("reward")).first()[0]
    assert tuple(got)[:7] == pytest.approx(expected[:7], abs=1e-6)
    assert literal == pytest.approx(expected[7], abs=1e-6)
    assert tuple(got)[7:] == pytest.approx((0.5, -0.2, -0.4, -0.1, -4.7, 2.05))


def test_a_callable_over_batches_is_a_signal(spark):
    seen = []

    def echoes(prompts, completions, bonus):
        seen.append(len(prompts))
        return [float(p in c) + (b or 0) for p, c, b in zip(prompts, completions, bonus, strict=True)]

    rows = spark.createDataFrame(
        [("a", "abc", 1), ("x", "abc", None), (None, None, 2)], "prompt string, completion string, bonus int"
    )
    registry = BUILT_IN.with_signal("echo", batch_signal(echoes, columns=("bonus",)))
    config = DEFAULT.reweighted(echo=2.0).with_(clamp_rewards=None)
    got = score_completions(rows, config, registry=registry).collect()
    plain = score_completions(rows, config.with_(weights={**config.weights})).collect()
    assert [r["r_echo"] for r in got] == [2.0, 0.0, 3.0]
    assert [round(r["reward"] - p["reward"], 9) for r, p in zip(got, plain, strict=True)] == [4.0, 0.0, 6.0]
    few = BUILT_IN.with_signal("echo", batch_signal(lambda prompts, completions: [0.0]))
    with pytest.raises(Exception, match="1 scores for"):
        score_completions(rows.coalesce(1), config, registry=few).collect()
