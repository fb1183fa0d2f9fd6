import datetime as dt

import pytest
from pyspark.sql import functions as F

from scoreloom.operators.groups import group_advantage
from scoreloom.operators.scoring import score_completions
from scoreloom.staging import fresh_path
from scoreloom.streaming import jobs

SCHEMA = "comp_id bigint, prompt_id bigint, completion string, ts timestamp"
START = dt.datetime(2024, 1, 1)


@pytest.fixture()
def folder(spark, tmp_path, golden):
    """The sample texts in three files, every prompt whole within its file."""
    path = str(tmp_path / "in")
    texts = [g["completion"] for g in golden]
    for part in range(3):
        rows = [
            (100 * part + i, 10 * part + i // 4, t, START + dt.timedelta(minutes=part * 100 + 7 * i))
            for i, t in enumerate(texts)
        ]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def stream_of(spark, folder, files=1):
    return jobs.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=files)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_scores_equal_batch(spark, folder):
    batch = score_completions(spark.read.parquet(folder))
    stream = jobs.score_stream(stream_of(spark, folder))
    assert rows(jobs.drained(stream, "scores", jobs.append_to).select(batch.columns)) == rows(batch)


@pytest.mark.parametrize("window", [{}, {"slide": "20 minutes"}, {"session_gap": "8 minutes", "by": ("prompt_id",)}])
def test_windows_equal_batch(spark, folder, window):
    batch = jobs.reward_windows(score_completions(spark.read.parquet(folder)), **window)
    stream = jobs.reward_windows(jobs.score_stream(stream_of(spark, folder, files=3)), **window)
    out = jobs.drained(stream, "windows", lambda s, p, c: jobs.per_batch_to(s, p, c, mode="complete"))
    columns = ["window_start", "window_end", F.round("mean_reward", 9).alias("mean"), "n_rows"]
    assert rows(out.select(columns)) == rows(batch.select(columns))


def test_windows_are_one_kind(spark, folder):
    with pytest.raises(ValueError):
        jobs.reward_windows(spark.read.parquet(folder).withColumn("reward", F.lit(0.0)), slide="1 hour", session_gap="1 hour")
    with pytest.raises(ValueError):
        jobs.reward_windows(spark.read.parquet(folder).withColumn("reward", F.lit(0.0)), session_gap="1 hour")


def write_hours(spark, path, hours):
    """A file per item, a row per hour in it."""
    for i, some in enumerate(hours):
        rows = [(100 * i + k, i, "نص", START + dt.timedelta(hours=h, minutes=5)) for k, h in enumerate(some)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("window", [{}, {"slide": "20 minutes"}, {"session_gap": "30 minutes", "by": ("kind",)}])
def test_closed_windows_equal_batch_and_late_files_change_nothing(spark, tmp_path, window):
    """The fourth file brings rows of hours that the watermark has passed, beside one on time."""
    kept, late = [[0, 1], [5], [6, 7], [9]], [[0, 1], [5], [6, 7], [0, 2, 9]]
    found = []
    for name, hours in (("kept", kept), ("late", late)):
        path = str(tmp_path / name)
        write_hours(spark, path, hours)
        scored = jobs.score_stream(stream_of(spark, path)).withColumn("kind", F.lit("k"))
        out = jobs.drained(jobs.reward_windows(scored, **window), name, jobs.append_to)
        found.append(rows(out.select("window_start", "window_end", "n_rows")))
    batch = score_completions(spark.read.parquet(str(tmp_path / "kept"))).withColumn("kind", F.lit("k"))
    passed = F.lit(START + dt.timedelta(hours=9, minutes=-5)).cast("timestamp")
    closed = jobs.reward_windows(batch, **window).where(F.col("window_end") <= passed)
    assert found[0] == found[1] == rows(closed.select("window_start", "window_end", "n_rows"))


def test_window_state_stays_bounded(spark, tmp_path):
    path = str(tmp_path / "many")
    write_hours(spark, path, [[2 * i, 2 * i + 1] for i in range(10)])
    query = jobs.append_to(
        jobs.reward_windows(jobs.score_stream(stream_of(spark, path))), fresh_path(spark, "many"), fresh_path(spark, "many-state")
    )
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 10 and max(held) <= 4


def test_every_completion_is_in_one_window(spark, small):
    """The closed tumbling windows and the rows that came after them are all completions."""
    from scoreloom.plans.queries import QUERIES
    from scoreloom.sources import derived

    closed = QUERIES["stream_reward_windows"](spark, small).collect()
    rows_of = derived.timed(derived.completions(spark, small))
    later = rows_of.where(F.unix_timestamp("ts") >= max(r["window_start"] for r in closed) + 3600).count()
    assert sum(r["n_rows"] for r in closed) + later == rows_of.count()


@pytest.mark.parametrize("files", [1, 3])
def test_advantage_equals_batch(spark, folder, files):
    batch = group_advantage(score_completions(spark.read.parquet(folder)).select("comp_id", "prompt_id", "reward"))
    stream = jobs.score_stream(stream_of(spark, folder, files)).select("comp_id", "prompt_id", "reward")
    out = jobs.latest_advantages(jobs.drained(stream, "advantage", jobs.stream_advantage))
    columns = ["comp_id", F.round("advantage", 9).alias("advantage")]
    assert rows(out.select(columns)) == rows(batch.select(columns))


@pytest.mark.parametrize("files", [1, 2])
def test_advantage_of_a_prompt_in_two_files(spark, tmp_path, files):
    path = str(tmp_path / "split")
    for part in ([(1, 7, "نص"), (2, 7, "نص طويل")], [(3, 7, ""), (4, 7, "لأن")]):
        df = spark.createDataFrame(part, "comp_id bigint, prompt_id bigint, completion string")
        df.coalesce(1).write.mode("append").parquet(path)
    score = lambda df: score_completions(df).select("comp_id", "prompt_id", "reward")
    batch = group_advantage(score(spark.read.parquet(path)))
    stream = jobs.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=files)
    out = jobs.latest_advantages(jobs.drained(score(stream), "split", jobs.stream_advantage))
    columns = ["comp_id", F.round("advantage", 9).alias("advantage")]
    assert rows(out.select(columns)) == rows(batch.select(columns))


def test_advantage_of_a_hot_prompt_and_no_prompt(spark, tmp_path):
    """A prompt split over three files and many states, a null prompt, lone completions."""
    path = str(tmp_path / "hot")
    made = [(i, 7 if i % 3 == 0 else None if i % 3 == 1 else i, "نص " * (i % 11)) for i in range(90)]
    for k in range(3):
        df = spark.createDataFrame(made[30 * k : 30 * k + 30], "comp_id bigint, prompt_id bigint, completion string")
        df.coalesce(1).write.mode("append").parquet(path)
    score = lambda df: score_completions(df).select("comp_id", "prompt_id", "reward")
    columns = ["comp_id", "prompt_id", F.round("advantage", 9).alias("advantage")]
    batch = group_advantage(score(spark.read.parquet(path))).select(columns)
    stream = jobs.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    out = jobs.latest_advantages(jobs.drained(score(stream), "hot", jobs.stream_advantage))
    assert rows(out.select(columns)) == rows(batch)


def test_a_batch_reads_and_writes_its_own_rows(spark, tmp_path):
    path, n = str(tmp_path / "each"), 6
    for k in range(n):
        made = [(100 * k + i, 10 * k + i % 5, "نص") for i in range(20)]
        df = spark.createDataFrame(made, "comp_id bigint, prompt_id bigint, completion string")
        df.coalesce(1).write.mode("append").parquet(path)
    stream = jobs.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    scored = jobs.score_stream(stream).select("comp_id", "prompt_id", "reward")
    query = jobs.stream_advantage(scored, fresh_path(spark, "each"), fresh_path(spark, "each-state"))
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in batches] == [20] * n
    assert all(p["stateOperators"][0]["numRowsUpdated"] <= 5 * jobs.PROMPT_PARTS for p in batches)


def test_rerun_adds_nothing(spark, folder):
    path, state = fresh_path(spark, "rerun"), fresh_path(spark, "rerun-state")
    for _ in range(2):
        stream = jobs.score_stream(stream_of(spark, folder)).select("comp_id", "prompt_id", "reward")
        jobs.stream_advantage(stream, path, state)
    assert spark.read.parquet(path).count() == 57


def test_neighbouring_prompts_share_states(spark, tmp_path):
    """Python is called per state: far fewer than completions, and the advantages are those of the batch."""
    path = str(tmp_path / "near")
    for k in range(2):
        made = [(8 * i + 2 * j + k, i - 100, "نص " * (i * j % 11)) for i in range(200) for j in range(4)]
        made += [(None if j else (1 << 60) + k, p, "نص " * (j + k)) for p in (None, 5, 1 << 60) for j in range(3)]
        df = spark.createDataFrame(made, "comp_id bigint, prompt_id bigint, completion string")
        df.coalesce(1).write.mode("append").parquet(path)
    score = lambda df: score_completions(df).select("comp_id", "prompt_id", "reward")
    stream = score(jobs.read_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1))
    out = fresh_path(spark, "near")
    query = jobs.stream_advantage(stream, out, fresh_path(spark, "near-state"))
    blocks = len({p >> jobs.BLOCK_BITS for p in range(-100, 100)}) + 2
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert len(updated) == 2 and max(updated) <= blocks * (jobs.PROMPT_PARTS + 1)
    columns = ["comp_id", "prompt_id", F.round("advantage", 9).alias("advantage")]
    batch = group_advantage(score(spark.read.parquet(path)))
    assert rows(jobs.latest_advantages(spark.read.parquet(out)).select(columns)) == rows(batch.select(columns))
