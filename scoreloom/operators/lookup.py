"""Equi-joins against a keyed table that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# a key is hot when it holds more than this share of all rows, so there are
# never more than 1 / HOT_SHARE hot keys, however large the table
HOT_SHARE = 1 / 2000
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on grouping columns, where a null group meets the null group."""
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys]
    return left.join(renamed, same).drop(*(f"right_{k}" for k in keys))


def hot_keys(counts: DataFrame, key: str, rows: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys of ``counts`` holding more than ``share`` of all counted rows."""
    total = counts.agg((F.sum(rows) * F.lit(share)).alias("limit")).scalar()
    return counts.where(F.col(rows) > total)


def join_keyed(rows: DataFrame, table: DataFrame, key: str, counts: str, share: float = HOT_SHARE) -> DataFrame:
    """Join ``rows`` to ``table``, which has one row per key and the key's row count.

    Rows of hot keys meet their partner by a broadcast of at most ``1 / share``
    table rows and are never shuffled; the others are shuffled by key, where no
    key is large enough to unbalance a task.
    """
    # null keys form a group of their own, as they do in an aggregate
    partner = table.withColumnRenamed(key, "partner_key")
    hot = F.broadcast(hot_keys(partner, "partner_key", counts, share))
    same = rows[key].eqNullSafe(F.col("partner_key"))
    near = rows.join(hot, same)
    far = rows.join(hot.select("partner_key"), same, "left_anti").join(partner, same)
    return near.unionByName(far).drop("partner_key")


def fits_broadcast(table: DataFrame, text_columns: tuple[str, ...]) -> bool:
    """Check the size of a table before broadcasting it."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text_columns), start=F.lit(0))
    size = table.agg(F.count("*").alias("rows"), F.sum(width + 16).alias("bytes")).first()
    return size["rows"] <= BROADCAST_ROWS and (size["bytes"] or 0) <= BROADCAST_BYTES


def left_lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    text_columns: tuple[str, ...],
    small: bool | None = None,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Left join of ``rows`` to a table unique in ``key``.

    A table whose size was checked is broadcast. A larger one is joined by
    shuffle, after the rows of hot keys were taken out and served by a broadcast
    of their few table rows. Rows must not hold a null key.
    """
    if fits_broadcast(table, text_columns) if small is None else small:
        return rows.join(F.broadcast(table), key, "left")
    counts = rows.groupBy(key).agg(F.count("*").alias("rows"))
    hot = hot_keys(counts, key, "rows", share).select(key)
    hot_table = table.join(F.broadcast(hot), key, "left_semi")
    near = rows.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(hot_table), key, "left")
    far = rows.join(F.broadcast(hot), key, "left_anti").join(table, key, "left")
    return near.unionByName(far)
