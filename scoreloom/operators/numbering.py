"""Global row numbers without a global window.

A window over a whole table runs in one task. Here a range exchange puts the rows in order over many
tasks, each task counts its own, and the ordered table is written once, so a lost executor cannot
change what was counted. The rows ahead of each range are prefix sums in two levels: within hundreds
of ranges, and over their sums. They are a small table that rows look up by their range; nothing of
it is in the plan or on the driver, whatever the number of ranges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.lookup import BROADCAST_ROWS
from scoreloom.staging import staged

RANGE = "range_no"
PLACE = "range_place"
#: Ranges whose sizes are summed together in the first level.
RANGES_PER_SUM = 1024
#: A written place is the number of the task shifted by this, and the row's number in the task.
TASK_BITS = 33


def in_ranges(df: DataFrame, keys: Sequence[str], rows_per_range: int | None = None) -> DataFrame:
    """``df`` dealt to tasks by ranges of the keys, of about ``rows_per_range`` rows if given."""
    if rows_per_range is None:
        return df.repartitionByRange(*keys)
    return df.repartitionByRange(max(1, math.ceil(df.count() / rows_per_range)), *keys)


def in_order(df: DataFrame, keys: Sequence[str], rows_per_range: int | None = None) -> DataFrame:
    """``df`` in the order of its keys, written once, with a ``PLACE`` that counts up, and the ``RANGE`` it is in.

    ``keys`` must be unique in total; nulls come first.
    """
    ordered = in_ranges(df, keys, rows_per_range).sortWithinPartitions(*keys)
    placed = staged(ordered.withColumn(PLACE, F.monotonically_increasing_id()), "in-order")
    return placed.withColumn(RANGE, F.shiftright(PLACE, TASK_BITS).cast("int"))


def rows_ahead(placed: DataFrame) -> DataFrame:
    """``(RANGE, ahead)``, written once: how many rows the ranges before hold."""
    sizes = placed.groupBy(RANGE).agg(F.count("*").alias("rows")).withColumn("sum_no", F.expr(f"{RANGE} div {RANGES_PER_SUM}"))
    own = F.array_sort(F.collect_list(F.struct(RANGE, "rows"))).alias("own")
    sums = sizes.groupBy("sum_no").agg(own, F.sum("rows").alias("rows"))
    # one row per thousand ranges
    before = Window.orderBy("sum_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("own", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    each = sums.select("own", "before", F.posexplode("own").alias("place", "range"))
    inside = F.aggregate(F.slice("own", 1, F.col("place")), F.lit(0).cast("long"), lambda n, r: n + r["rows"])
    return staged(each.select(F.col(f"range.{RANGE}").alias(RANGE), (F.col("before") + inside).alias("ahead")), "ahead")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    name: str = "row_no",
    first: int = 1,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Add the row number in the order of ``keys``, which must be unique in total; nulls come first."""
    placed = in_order(df, keys, rows_per_range)
    ahead = rows_ahead(placed)
    # there are no more ranges than tasks; they are of about one size, so beyond a broadcast no join task is hot
    tasks = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    few = rows_per_range is None and int(tasks) <= BROADCAST_ROWS or ahead.count() <= BROADCAST_ROWS
    joined = placed.join(F.broadcast(ahead) if few else ahead, RANGE)
    within = F.col(PLACE).bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    return joined.withColumn(name, F.col("ahead") + within + F.lit(first)).drop("ahead", PLACE, RANGE)


def number_blocks(
    df: DataFrame,
    keys: Sequence[str],
    size: int,
    name: str = "block_no",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Number blocks of ``size`` consecutive rows, from 0."""
    if size < 1:
        raise ValueError("block size must be positive")
    numbered = number_rows(df, keys, "row_no", first=0, rows_per_range=rows_per_range)
    return numbered.withColumn(name, F.expr(f"row_no div {size}"))
