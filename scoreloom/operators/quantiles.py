"""Exact interpolated quantiles per group, without holding a group in one task.

The built-in exact percentile keeps every distinct value of a group in one hash
map. Here the distinct values are cut into ranges of about equal size, the row
counts of the ranges tell which of them a quantile falls into, and only those
are put in order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.lookup import join_groups
from scoreloom.operators.numbering import in_ranges
from scoreloom.staging import staged


def quantiles(
    counts: DataFrame,
    group: Sequence[str],
    value: str,
    rows: str,
    at: Sequence[float],
    names: Sequence[str],
    rows_per_range: int | None = None,
) -> DataFrame:
    """Quantiles of ``value`` where each row of ``counts`` stands for ``rows`` rows.

    ``counts`` holds each value of a group once. It is read once.
    """
    if any(math.isnan(q) or not 0 <= q <= 1 for q in at):
        raise ValueError(f"not quantiles: {at}")
    group = list(group)
    narrow = in_ranges(counts.select(*group, value, rows), [*group, value], rows_per_range)
    binned = staged(narrow.withColumn("bin_no", F.spark_partition_id()), "bins")

    # one row per group and range from here on
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("bin_no").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = (
        binned.groupBy(*group, "bin_no")
        .agg(F.sum(rows).alias("bin_rows"))
        .withColumns(
            {
                "ahead": F.coalesce(F.sum("bin_rows").over(upto), F.lit(0)),
                "group_n": F.sum("bin_rows").over(whole),
            }
        )
    )
    place = [F.lit(float(q)) * (F.col("group_n") - 1) for q in at]
    ranks = [
        F.struct(F.lit(i).alias("q"), F.lit(up).alias("up"), step(p).cast("bigint").alias("rank"))
        for i, p in enumerate(place)
        for up, step in ((False, F.floor), (True, F.ceil))
    ]
    wanted = per_bin.select(
        *group, "bin_no", "ahead", "group_n",
        F.filter(
            F.array(*ranks),
            lambda r: (r["rank"] >= F.col("ahead")) & (r["rank"] < F.col("ahead") + F.col("bin_rows")),
        ).alias("ranks"),
    ).where(F.size("ranks") > 0)

    inside = Window.partitionBy(*group, "bin_no").orderBy(value)
    last = F.col("ahead") + F.sum(rows).over(inside)
    values = (
        join_groups(binned, wanted, [*group, "bin_no"])
        .withColumn("last", last)
        .select(
            *group, "group_n", value,
            F.explode_outer(
                F.filter(
                    "ranks",
                    lambda r: (r["rank"] < F.col("last")) & (r["rank"] >= F.col("last") - F.col(rows)),
                )
            ).alias("hit"),
        )
        .where(F.col("hit").isNotNull())
    )
    found = [
        F.max(F.when((F.col("hit.q") == i) & (F.col("hit.up") == up), F.col(value))).alias(f"v{i}_{int(up)}")
        for i in range(len(at))
        for up in (False, True)
    ]
    table = values.groupBy(*group).agg(F.first("group_n").alias("group_n"), *found)
    out = []
    for i, (q, name) in enumerate(zip(at, names, strict=True)):
        spot = F.lit(float(q)) * (F.col("group_n") - 1)
        below, above = F.col(f"v{i}_0"), F.col(f"v{i}_1")
        out.append((below + (spot - F.floor(spot)) * (above - below)).alias(name))
    return table.select(*group, *out)
