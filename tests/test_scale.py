"""Numbering, lookups and quantiles: whole results whatever the split or skew."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreloom import staging
from scoreloom.operators.lookup import hot_keys, join_keyed, left_lookup
from scoreloom.operators.numbering import in_order, number_blocks, number_rows, rows_ahead
from scoreloom.operators.quantiles import quantiles


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keyed(spark, values, schema):
    random.Random(5).shuffle(values)
    return spark.createDataFrame(values, schema).repartition(3)


@pytest.mark.parametrize("rows_per_range", [1, 3, 10, 64, 10_000])
@pytest.mark.parametrize("kind", ["number", "text", "pair"])
def test_row_numbers_equal_the_global_order(spark, rows_per_range, kind):
    if kind == "number":
        values = [(3 * i - 100,) for i in range(150)]
        df, keys = keyed(spark, values, "k bigint"), ["k"]
    elif kind == "text":
        values = [(f"é\"\\{i:x}ب"[: 3 + i % 9] + str(i),) for i in range(150)]
        df, keys = keyed(spark, values, "k string"), ["k"]
    else:
        # two thirds of the rows share the first part of the key
        values = [(7 if i % 3 else i % 5, i) for i in range(150)]
        df, keys = keyed(spark, values, "a int, k bigint"), ["a", "k"]
    got = number_rows(df, keys, "n", first=5, rows_per_range=rows_per_range)
    assert got.columns == [*df.columns, "n"]
    expected = df.withColumn("n", F.row_number().over(Window.orderBy(*keys)) + 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    if rows_per_range == 10:
        sizes = [r["count"] for r in in_order(df, keys, rows_per_range).groupBy("range_no").count().collect()]
        assert len(sizes) > 5 and max(sizes) <= 60


@pytest.mark.parametrize("unit", [1, 2, 7, 16, 256])
@pytest.mark.parametrize("rows_per_range", [3, 20, None])
def test_blocks_of_consecutive_rows(spark, unit, rows_per_range):
    df = keyed(spark, [(i * i,) for i in range(233)], "k bigint")
    rows = sorted((r["k"], r["b"]) for r in number_blocks(df, ["k"], unit, "b", rows_per_range).collect())
    assert [b for _, b in rows] == [i // unit for i in range(233)]


def test_rows_ahead_in_two_levels(spark):
    """More ranges than are summed together, some of them empty."""
    sizes = [(i * 7919) % 5 for i in range(3000)]
    placed = spark.range(sum(sizes)).select(
        F.get(F.lit([r for r, n in enumerate(sizes) for _ in range(n)]), F.col("id").cast("int")).alias("range_no")
    )
    got = {r["range_no"]: r["ahead"] for r in rows_ahead(placed).collect()}
    assert got == {r: sum(sizes[:r]) for r, n in enumerate(sizes) if n}


def test_the_plan_does_not_grow_with_the_ranges(spark):
    """Nothing of the ranges is in the plan, and a result takes few jobs."""
    from scoreloom.operators import groups, sequences

    steps = spark.range(12_000).select(F.col("id").alias("comp_id"), (F.col("id") % 7).cast("double").alias("reward"))
    ids = F.sequence(F.lit(1), F.pmod("id", F.lit(9)).cast("int") + 1)
    tokens = spark.range(6_000).select(F.col("id").alias("ex_id"), ids.alias("input_ids"))
    tokens = sequences.training_rows(tokens)
    tracker = spark.sparkContext.statusTracker()
    for build in (lambda r: groups.reward_by_step(steps, rows_per_range=r), lambda r: sequences.pad_batches(tokens, rows_per_range=r)):
        texts, rows = [], []
        for rows_per_range in (6_000, 60, None):
            before = len(tracker.getJobIdsForGroup(None))
            out = build(rows_per_range)
            # with a given size of the ranges, rows and ranges are counted as well
            assert len(tracker.getJobIdsForGroup(None)) - before <= (8 if rows_per_range is None else 12)
            texts.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
            found = [[round(v, 9) if isinstance(v, float) else v for v in r] for r in out.collect()]
            rows.append(sorted(map(repr, found)))
        assert rows[0] == rows[1] == rows[2]
        assert max(texts) - min(texts) < 200


def test_an_empty_table_has_no_numbers(spark):
    df = spark.createDataFrame([], "k bigint")
    out = number_rows(df, ["k"])
    assert out.columns == ["k", "row_no"] and out.count() == 0


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of all rows."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 211}") for i in range(3000)]
    return spark.createDataFrame(rows, "id bigint, k string").repartition(4)


def test_join_keyed_is_whole(spark, skewed):
    stats = skewed.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    assert [r["k"] for r in hot_keys(stats, "k", "n", 0.05).collect()] == ["hot"]
    for share in (0.0, 0.05, 1.0):
        got = join_keyed(skewed, stats, "k", "n", share)
        whole = Window.partitionBy("k")
        expected = skewed.select("id", "k", F.count("*").over(whole).alias("n"), F.max("id").over(whole).alias("top"))
        assert sorted(map(repr, got.select("id", "k", "n", "top").collect())) == sorted(map(repr, expected.collect()))


def test_left_lookup_is_whole_either_way(spark, skewed):
    table = spark.createDataFrame([(f"k{i}", i) for i in range(0, 300, 2)] + [("hot", -1)], "k string, v int")
    skewed = skewed.where("k IS NOT NULL")
    expected = sorted(map(repr, skewed.join(table, "k", "left").select("id", "k", "v").collect()))
    for small, share in ((None, 0.05), (True, 0.05), (False, 0.05), (False, 0.0), (False, 1.0)):
        got = left_lookup(skewed, table, "k", ("k",), small, share).select("id", "k", "v").collect()
        assert sorted(map(repr, got)) == expected


@pytest.mark.parametrize("rows_per_range", [20, 100, 100_000])
def test_quantiles_equal_numpy(spark, rows_per_range):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(size=501), "one": np.array([4.5]), "two": np.array([1.0, 2.0]),
        "ties": rng.integers(-3, 3, size=400).astype(float), "flat": np.full(50, -5.0),
        None: np.array([-0.0, 1e-300, 2.0]),
        "edge": np.concatenate([np.full(300, -5.0), rng.uniform(-5, 5, size=150)]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double")
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    at = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    out = quantiles(counts, ["g"], "v", "n", at, [f"q{i}" for i in range(len(at))], rows_per_range)
    got = {r["g"]: tuple(r)[1:] for r in out.collect()}
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.quantile(values, at), abs=1e-12), g


def test_quantiles_of_nothing(spark):
    counts = spark.createDataFrame([], "g string, v double, n bigint")
    assert quantiles(counts, ["g"], "v", "n", (0.5,), ("m",)).count() == 0
    with pytest.raises(ValueError):
        quantiles(counts, ["g"], "v", "n", (1.5,), ("m",))


def test_staged_table_lives_in_the_shared_folder(spark):
    df = spark.range(10).withColumn("a", F.array(F.lit(1), F.lit(2)))
    out = staging.staged(df, "unit")
    assert out.dtypes == df.dtypes and out.count() == 10
    assert all(staging.shared_dir(spark).removeprefix("file:") in f for f in out.inputFiles())


def test_staged_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "shared_dir", lambda session: str(tmp_path))
    staging.staged(spark.range(3), "unit")
    assert list(tmp_path.rglob("*.parquet"))
    assert staging.drop_staged(spark) and not list(tmp_path.rglob("*.parquet"))


@pytest.mark.parametrize("kind", ["timestamp", "date", "decimal(20,4)"])
def test_ranges_of_any_orderable_key(spark, kind):
    at = {"timestamp": "timestamp_micros(1700000000000000 + id * 1234567)", "date": "date_add(date'2020-01-01', CAST(id AS INT))"}
    df = spark.range(500).selectExpr("id", f"CAST({at.get(kind, 'id / 8')} AS {kind}) AS k").repartition(5)
    got = number_rows(df, ["k"], rows_per_range=40).select("id", "row_no").collect()
    assert all(r["row_no"] == r["id"] + 1 for r in got)


def test_whole_texts_reach_the_derived_rows(spark, small):
    from scoreloom.sources import derived

    docs = derived.table(spark, small, "documents")
    rows = derived.completions(spark, small)
    assert rows.count() == rows.select("comp_id").distinct().count() == 2 * docs.count()
    held = docs.join(rows, docs["doc_id"] == rows["comp_id"]).where("contains(completion, text)")
    assert held.count() == docs.count()
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for c, n in ((0, 2400), (1, 2)) for t in range(n)]
    made = derived.instructions_of(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"))
    assert made.count() == made.select("ex_id").distinct().count() == 2 * 1201


def test_unknown_ids_are_shown(spark):
    from scoreloom.operators.alignment import UNKNOWN_PIECE, decode_ids

    vocab = spark.createDataFrame([(3, "a", False), (4, "b", False), (1, "s", True)], "token_id bigint, piece string, is_special boolean")
    batch = spark.createDataFrame([(1, [3, 999999, 1, 4])], "prompt_id bigint, input_ids array<int>")
    assert decode_ids(batch, vocab).first()["prompt"] == f"a{UNKNOWN_PIECE}b"
