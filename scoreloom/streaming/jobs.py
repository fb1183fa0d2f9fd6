"""Scoring streams of completions and watching their rewards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scoreloom.config import DEFAULT, RewardConfig
from scoreloom.functions.signals import BUILT_IN, SignalRegistry
from scoreloom.operators.lookup import HOT_SHARE, join_keyed
from scoreloom.operators.scoring import score_completions
from scoreloom.staging import fresh_path

#: States that the completions of a prompt are dealt over.
PROMPT_PARTS = 8
#: Neighbouring prompt ids whose statistics share a state, as a power of two: Python is called per state.
BLOCK_BITS = 6
STATISTICS = "slot array<int>, n array<long>, mean array<double>, squares array<double>"
RUNNING = "comp_id long, prompt_id long, reward double, part int, n long, mean double, squares double"


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """A table as a stream of its files: a folder that files arrive in, or a single file."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        # a file source lists folders: this one's, and of it only the file
        return reader.option("pathGlobFilter", place.getName()).load(place.getParent().toString())
    return reader.load(path)


def utc_instant(wall_clock: Column) -> Column:
    """A wall-clock time without zone, read as UTC: watermarks need an instant."""
    return F.concat(wall_clock.cast("string"), F.lit("Z")).cast("timestamp")


def score_stream(
    stream: DataFrame,
    config: RewardConfig = DEFAULT,
    text: str = "completion",
    registry: SignalRegistry = BUILT_IN,
) -> DataFrame:
    """Score every arriving completion. Stateless, the same columns as in batch."""
    return score_completions(stream, config, text, registry)


def reward_windows(
    scored: DataFrame,
    width: str = "1 hour",
    slide: str | None = None,
    session_gap: str | None = None,
    late: str = "10 minutes",
    at: str = "ts",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Mean reward and row count per window of event time.

    Tumbling windows by default, sliding ones with ``slide``, sessions with
    ``session_gap``. Sessions belong to something, say a training run, so they
    need the columns to group ``by``. Rows later than the watermark are dropped. In append mode a
    window is written once, when the watermark has passed its end, and its state is then given up.
    """
    if slide is not None and session_gap is not None:
        raise ValueError("a window either slides or follows sessions")
    if session_gap is not None and not by:
        raise ValueError("sessions need columns to group by")
    if session_gap is not None:
        span = F.session_window(at, session_gap)
    else:
        span = F.window(at, width, slide) if slide else F.window(at, width)
    timed = scored.withWatermark(at, late) if scored.isStreaming else scored
    return (
        timed.groupBy(span.alias("span"), *by)
        .agg(F.avg("reward").alias("mean_reward"), F.count("*").alias("n_rows"))
        .select(
            F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"),
            *by, "mean_reward", "n_rows",
        )
    )


def _finish(query) -> None:
    query.awaitTermination()
    failure = query.exception()
    if failure is not None:
        raise failure


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Write everything available to a parquet table, each row exactly once; the ended query."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    _finish(query)
    return query


def per_batch_to(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "append",
) -> None:
    """Write each micro-batch under its own number, so a retry replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        folder = f"{path}/batch_no={number}" if mode == "append" else path
        out.write.mode("overwrite").parquet(folder)

    _finish(
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def _running_statistics(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Arriving rewards of one part of a block of prompts with count, mean and squared deviations of all so far."""
    n, (mean, squares) = np.zeros(1 << BLOCK_BITS, "int64"), np.zeros((2, 1 << BLOCK_BITS))
    if state.exists:
        slots, *kept = state.get
        n[slots], mean[slots], squares[slots] = kept
    for rows in batches:
        slots, rewards = rows["slot"].to_numpy(), rows["reward"].to_numpy(float)
        here, at = np.unique(slots, return_inverse=True)  # other prompts of the block stay as they are
        before, own_n = n[here], np.bincount(at)
        own, both = np.bincount(at, rewards) / own_n, before + own_n
        apart = own - mean[here]
        squares[here] += np.bincount(at, (rewards - own[at]) ** 2) + apart**2 * before * own_n / both
        mean[here] += apart * own_n / both
        n[here] = both
        yield rows.drop(columns=["slot", "block"]).assign(n=n[slots], mean=mean[slots], squares=squares[slots])
    known = np.flatnonzero(n)
    state.update((known.tolist(), n[known].tolist(), mean[known].tolist(), squares[known].tolist()))


def stream_advantage(scored: DataFrame, path: str, checkpoint: str, parts: int = PROMPT_PARTS):
    """Rewards of a stream with the statistics of their prompts, from which ``latest_advantages`` reads advantages.

    The state store holds three numbers per part of a prompt, those of a block of neighbouring prompts in one state,
    and a micro-batch reads and writes its own rows and the blocks it touches, however many came before. A prompt's
    completions are dealt over ``parts`` states by id, so that no task gets all rows of a hot one.
    """
    comp, prompt = F.col("comp_id"), F.col("prompt_id").cast("long")
    # ids that are null have a part of their own: among others they would turn these into floats
    part = F.when(comp.isNull(), F.lit(parts)).otherwise(F.pmod(F.xxhash64(comp), F.lit(parts))).cast("int")
    slot = F.coalesce(prompt.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)), F.lit(0)).cast("int")
    keyed = scored.select(
        "comp_id", "prompt_id", "reward", part.alias("part"), slot.alias("slot"),
        F.shiftright(prompt, BLOCK_BITS).alias("block"),
    )
    rows = keyed.groupBy("block", "part").applyInPandasWithState(
        _running_statistics, RUNNING, STATISTICS, "append", GroupStateTimeout.NoTimeout
    )
    return append_to(rows, path, checkpoint)


def _merged(a: Column, b: Column) -> Column:
    """The statistics of two disjoint sets of rewards together."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    share = b["n"] / F.greatest(n, F.lit(1))
    return F.struct(
        n.alias("n"), (a["mean"] + apart * share).alias("mean"),
        (a["squares"] + b["squares"] + apart * apart * a["n"] * share).alias("squares"),
    )


def latest_advantages(table: DataFrame, eps: float = 1e-4, share: float = HOT_SHARE) -> DataFrame:
    """``(comp_id, prompt_id, reward, advantage)`` of what ``stream_advantage`` wrote, given all rows so far."""
    last = table.groupBy("prompt_id", "part").agg(F.max(F.struct("n", "mean", "squares")).alias("s"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    parts = F.array_sort(F.collect_list(F.struct("part", "s")))  # one per part of the prompt
    whole = last.groupBy("prompt_id").agg(F.aggregate(parts, none, lambda s, p: _merged(s, p["s"])).alias("s"))
    stats = whole.select(
        "prompt_id", F.col("s.n").alias("group_rows"), F.col("s.mean").alias("group_mean"),
        F.sqrt(F.col("s.squares") / F.greatest(F.col("s.n") - 1, F.lit(1))).alias("group_sd"),
    )
    joined = join_keyed(table.select("comp_id", "prompt_id", "reward"), stats, "prompt_id", "group_rows", share)
    relative = (F.col("reward") - F.col("group_mean")) / (F.col("group_sd") + F.lit(float(eps)))
    advantage = F.when(F.col("group_rows") > 1, relative).otherwise(F.lit(0.0))
    return joined.select("comp_id", "prompt_id", "reward", advantage.alias("advantage"))


def drained(stream: DataFrame, label: str, write: Callable[[DataFrame, str, str], object]) -> DataFrame:
    """Run a stream over all that is available and return the table it wrote."""
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, label), fresh_path(spark, f"{label}-state")
    write(stream, path, checkpoint)
    return spark.read.parquet(path)
