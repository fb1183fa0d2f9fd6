"""Exact duplicates by skew-safe combining.

Texts are equal when identical after lower-casing A-Z; a null text is empty. Copies are
combined in three steps, and each step groups by digest *and whole text*, so a digest
that two texts share never joins them:

1. within a task (the partial aggregate): one row per text leaves it, however many
   copies the task read;
2. in salted groups ``(salt, digest, text)``, the salt being the reading task's number:
   a text that fills a third of the table is spread over all salts;
3. across salts: at most ``SALTS`` winners per text meet.

Defined cases: a null ``doc_id`` loses to any other (a group of only null ids keeps one
row, its ``keep_id`` is null); of rows that repeat a ``doc_id`` with an equal text one
stays; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import lower_ascii
from scoreloom.staging import staged

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_classes(rows: DataFrame) -> DataFrame:
    """``(digest, norm, keep_id, group_size)``, one row per different text of ``rows(doc_id, digest, norm)``."""
    salted = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    winners = salted.groupBy("salt", "digest", "norm").agg(
        F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n")
    )
    return winners.groupBy("digest", "norm").agg(
        F.max("winner").alias("keep_id"), F.sum("n").alias("group_size")
    )


def _digested(docs: DataFrame, digest: Callable[[Column], Column], *more: str) -> DataFrame:
    norm = docs.select("doc_id", lower_ascii(F.col("text")).alias("norm"), *more)
    return norm.withColumn("digest", digest(F.col("norm")))


def _classes(docs: DataFrame, digest: Callable[[Column], Column]) -> tuple[DataFrame, bool]:
    """The written classes without their texts, and whether different texts share a digest.

    The texts are dropped because a digest almost surely names one text. Where it does
    not, the caller compares texts once more.
    """
    classes = text_classes(_digested(docs, digest))
    narrow = staged(classes.select("digest", "keep_id", "group_size"), "text-classes")
    shared = narrow.groupBy("digest").count().where("count > 1")
    return narrow, not shared.isEmpty()


def exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: the id that stays, the group's size, whether this row stays.

    ``(doc_id, keep_id, group_size, kept, text_digest)``. Rows meet their class on the
    digest alone, as narrow rows; the adaptive join splits a digest with very many rows.
    """
    classes, ambiguous = _classes(docs, digest)
    rows = _digested(docs, digest, F.xxhash64("text").alias("raw")).withColumn("norm64", F.xxhash64("norm"))
    if ambiguous:
        full = text_classes(_digested(docs, digest)).withColumnsRenamed({"digest": "d", "norm": "t"})
        joined = rows.join(full, (F.col("digest") == F.col("d")) & (F.col("norm") == F.col("t")))
    else:
        joined = rows.drop("norm").join(classes, "digest")
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # only rows with the winning id can tie; the others are spread by their own id
    tie = Window.partitionBy(
        F.when(top, F.col("digest")), F.when(top, F.col("norm64")).otherwise(F.xxhash64("doc_id", "digest"))
    ).orderBy("raw", "group_size")
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (top & (F.row_number().over(tie) == 1)).alias("kept"),
        F.col("digest").alias("text_digest"),
    )


def drop_exact_duplicates(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; one row per different text.

    A kept row is found by ``(digest, winning id)``: copies of one text have different ids
    and so go to different tasks.
    """
    classes, ambiguous = _classes(docs, digest)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    keyed = row.select(
        "row",
        digest(lower_ascii(F.col("row.text"))).alias("digest"),
        F.col("row.doc_id").alias("id"),
    )
    won = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("d"))
    if ambiguous:
        classes = text_classes(_digested(docs, digest)).withColumnRenamed("norm", "t")
        won &= lower_ascii(F.col("row.text")) == F.col("t")
    kept = keyed.join(classes.withColumnRenamed("digest", "d"), won, "left_semi")
    text = lower_ascii(F.col("row.text")) if ambiguous else F.lit(0)
    first = F.row_number().over(
        Window.partitionBy("digest", F.coalesce("id", F.lit(0)), F.isnull("id"), text).orderBy(F.xxhash64("row.text"))
    )
    return kept.withColumn("n", first).where("n = 1").select("row.*")
