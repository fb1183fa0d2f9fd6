"""Running sums of a source in groups of chunks, one of which holds a third of all rows."""

from pyspark.sql import functions as F

from scoreloom.llm import mixing


def _starts(sized):
    return {r["row"]: (r["source"], r["start"], r["size"]) for r in mixing._placed(sized).collect()}


def test_starts_tile_every_source(spark, monkeypatch):
    rows = spark.range(900).select(
        F.col("id").alias("row"), (F.col("id") % 700).alias("doc_id"), F.expr("CASE WHEN id < 400 THEN 'hot' WHEN id % 9 = 0 THEN null ELSE concat('s', id % 4) END").alias("source"),
        F.expr("id * 7 % 23").alias("size"), F.xxhash64("id").alias("text_hash"),
    )
    monkeypatch.setattr(mixing, "CHUNK", 4)
    one = _starts(rows)
    monkeypatch.setattr(mixing, "GROUP", 7)
    many = _starts(rows.repartition(5))
    assert one == many and len(many) == 900
    for source in {s for s, _, _ in many.values()}:
        at = 0
        for start, size in sorted((start, size) for s, start, size in many.values() if s == source):
            assert start == at
            at += size


def test_no_chunks_no_bases(spark):
    assert mixing._chunk_bases(spark.createDataFrame([], "source string, chunk long, words long")).count() == 0
