import statistics

import pytest
from pyspark.sql import functions as F

from scoreloom.config import DEFAULT
from scoreloom.operators import groups
from scoreloom.operators.scoring import score_completions
from scoreloom.sources.tables import COMPLETION_SCHEMA


def table(spark, values):
    rows = [(i, p, float(r), f"t{i}") for i, (p, r) in enumerate(values)]
    return spark.createDataFrame(rows, "comp_id bigint, prompt_id bigint, reward double, completion string")


@pytest.fixture(scope="module")
def skewed(spark):
    """Prompt 0 holds a third of all completions, the others four each."""
    values = [(0 if i % 3 == 0 else 1 + i // 6, (i * 37 % 101) / 10 - 5) for i in range(1200)]
    return table(spark, values).repartition(3)


def test_advantage(spark, skewed):
    narrow = skewed.select("comp_id", "prompt_id", "reward")
    by_prompt = {}
    for r in narrow.collect():
        by_prompt.setdefault(r["prompt_id"], []).append((r["comp_id"], r["reward"]))
    expected = {}
    for rows in by_prompt.values():
        rewards = [x for _, x in rows]
        for comp_id, reward in rows:
            sd = statistics.stdev(rewards) if len(rewards) > 1 else None
            expected[comp_id] = 0.0 if sd is None else (reward - statistics.mean(rewards)) / (sd + 1e-4)
    for share in (groups.HOT_SHARE, 0.2):
        got = {r["comp_id"]: r["advantage"] for r in groups.group_advantage(narrow, share=share).collect()}
        assert got == pytest.approx(expected, abs=1e-9)


def test_advantage_sums_to_zero(spark, skewed):
    out = groups.group_advantage(skewed.select("comp_id", "prompt_id", "reward"))
    sums = out.groupBy("prompt_id").agg(F.sum("advantage").alias("s"))
    assert sums.where(F.abs("s") > 1e-6).count() == 0


def test_advantage_of_lone_and_equal_rewards(spark):
    df = table(spark, [(1, 3.0), (2, 1.0), (2, 1.0)]).select("comp_id", "prompt_id", "reward")
    assert {r["comp_id"]: r["advantage"] for r in groups.group_advantage(df).collect()} == {0: 0.0, 1: 0.0, 2: 0.0}


def test_advantage_never_windows(spark, skewed):
    plan = groups.group_advantage(skewed.select("comp_id", "prompt_id", "reward"))._jdf.queryExecution().executedPlan()
    assert "Window" not in plan.toString() and "Python" not in plan.toString()


def test_preference_pairs(spark):
    df = table(spark, [(1, 2.0), (1, 5.0), (1, 5.0), (1, 2.0), (2, 1.0), (2, 1.0), (3, 4.0)])
    got = [tuple(r) for r in groups.preference_pairs(df).collect()]
    # equal rewards: the lower id is chosen, the higher one rejected
    assert got == [(1, 1, 3, "t1", "t3", 3.0)]


def test_best_of_prompt(spark):
    df = table(spark, [(1, 2.0), (1, 5.0), (1, 5.0), (2, 1.0)])
    got = {r["prompt_id"]: tuple(r)[1:] for r in groups.best_of_prompt(df).collect()}
    assert got == {1: (3, 4.0, 5.0, 1), 2: (1, 1.0, 1.0, 3)}


@pytest.mark.parametrize("rows_per_range", [5, 90, 5000])
def test_steps(spark, rows_per_range):
    rewards = [float(i % 13) for i in range(300)]
    df = table(spark, [(0, r) for r in rewards]).repartition(4)
    out = {r["step"]: r for r in groups.reward_by_step(df, step_rows=32, rows_per_range=rows_per_range).collect()}
    assert sorted(out) == list(range(10))
    for step, row in out.items():
        part = rewards[32 * step : 32 * step + 32]
        assert (row["n_rows"], row["min_reward"], row["max_reward"]) == (len(part), min(part), max(part))
        assert row["mean_reward"] == pytest.approx(statistics.mean(part))
        assert row["sd_reward"] == pytest.approx(statistics.stdev(part))


@pytest.fixture(scope="module")
def samples(spark, golden):
    rows = [(i, i // 3, i % 3, g["completion"]) for i, g in enumerate(golden)]
    return spark.createDataFrame(rows, COMPLETION_SCHEMA)


def test_evaluation_report(spark, samples):
    scored = score_completions(samples, keep_measures=True).withColumn("all", F.lit("x"))
    row = groups.evaluation_report(scored, "all").first()
    rewards = [r["reward"] for r in scored.collect()]
    assert row["n_rows"] == 19
    assert row["mean_reward"] == pytest.approx(statistics.mean(rewards))
    assert row["p50_reward"] == pytest.approx(statistics.median(rewards))
    assert row["share_is_empty"] == pytest.approx(1 / 19)
    assert row["share_tags_right"] == pytest.approx(2 / 19)
    assert row["share_has_forbidden_word"] == pytest.approx(1 / 19)
    assert row["share_has_reason_word"] == pytest.approx(2 / 19)
    nameless = groups.evaluation_report(scored.withColumn("part", F.when(F.col("comp_id") != 3, "x")), "part")
    assert nameless.agg(F.sum("n_rows")).first()[0] == 19 and nameless.where("part IS NULL").count() == 1


def test_contribution_adds_up(spark, samples):
    scored = score_completions(samples)
    rows = groups.component_contribution(scored).collect()
    assert len(rows) == 6
    total = scored.agg(F.avg("raw_reward")).first()[0]
    assert sum(r["mean_weighted"] for r in rows) == pytest.approx(total)


def test_sweep_equals_scoring_each(spark, samples):
    configs = {
        "default": DEFAULT,
        "literal": DEFAULT.with_(script_mode="literal"),
        "words": DEFAULT.with_(keywords_to_reward=("أنا", "هنا")),
        "tight": DEFAULT.with_(clamp_rewards={"min": -2.0, "max": -1.0}),
        "free": DEFAULT.with_(clamp_rewards=None, target_length=30),
    }
    got = {r["config_id"]: r for r in groups.config_sweep(samples, configs).collect()}
    assert set(got) == set(configs)
    for name, config in configs.items():
        scored = score_completions(samples, config)
        mean, clamped = scored.agg(
            F.avg("reward"), F.avg((F.col("reward") != F.col("raw_reward")).cast("double"))
        ).first()
        assert got[name]["mean_reward"] == pytest.approx(mean)
        assert got[name]["share_clamped"] == pytest.approx(clamped)
    with pytest.raises(ValueError):
        groups.config_sweep(samples, {})


def test_quality_filter_and_summary_agree(spark, samples):
    for min_script, need_tags in ((0.0, True), (0.5, False), (0.9, True)):
        kept = groups.quality_filter(samples, min_script=min_script, need_tags=need_tags)
        assert kept.columns == samples.columns
        summary = groups.quality_summary(samples, min_script=min_script, need_tags=need_tags).collect()
        counts = {r["reason"]: r["n_rows"] for r in summary}
        assert sum(counts.values()) == 19
        assert kept.count() == counts.get("kept", 0)
    kept = groups.quality_filter(samples, min_script=0.0)
    assert sorted(r["comp_id"] for r in kept.collect()) == [9, 10]


def test_filter_does_not_measure_twice(spark, samples):
    plan = groups.quality_filter(samples)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") <= 1


def test_lexicon_coverage(spark, samples):
    lexicon = {"a": ("هنا", "nothing"), "b": ("هنا", "<think>")}
    got = {(r["list"], r["word"]): (r["n_hits"], r["share"]) for r in groups.lexicon_coverage(samples, lexicon).collect()}
    hits = {w: sum(w in r["completion"] for r in samples.collect()) for w in ("هنا", "nothing", "<think>")}
    assert got == {(k, w): (hits[w], hits[w] / 19) for k, words in lexicon.items() for w in words}
    with pytest.raises(ValueError):
        groups.lexicon_coverage(samples, {"a": ()})


def test_script_profile(spark, samples, golden):
    row = groups.script_profile(samples.withColumn("g", F.lit(1)), ["g"], "completion").first()
    assert row["n_script"] == sum(g["ar"] for g in golden)
    assert row["script_share"] == pytest.approx(sum(g["ar"] for g in golden) / sum(g["n"] for g in golden))
    empty = samples.where("completion = ''").withColumn("g", F.lit(1))
    assert groups.script_profile(empty, ["g"], "completion").first()["script_share"] == 0


def test_review_list(spark, samples):
    scored = score_completions(samples)
    ranked = sorted((r["reward"], r["comp_id"]) for r in scored.collect())
    got = [(r["reward"], r["comp_id"]) for r in groups.review_list(scored, 5).collect()]
    assert got == ranked[:5]
    best = groups.review_list(scored, 3, best_first=True)
    assert [r["reward"] for r in best.collect()] == [r for r, _ in reversed(ranked[-3:])]
    assert all(len(r["preview"]) <= 50 for r in best.collect())
    assert "TakeOrderedAndProject" in best._jdf.queryExecution().executedPlan().toString()
