import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import text as T
from scoreloom.operators import alignment, sequences

TEXTS = ["b a  c", "", "a a\ta", None, "<|im_start|>user x <|im_end|>", "ب é <|endoftext|>", "z " * 40]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "ex_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def vocab(rows):
    return sequences.build_vocab(rows, "text")


def test_vocabulary(rows, vocab):
    got = sorted((r["token_id"], r["piece"], r["is_special"]) for r in vocab.collect())
    words = sorted({w for t in TEXTS for w in (t or "").split()} - set(sequences.SPECIALS), key=str.encode)
    expected = [(i, w, True) for i, w in enumerate(sequences.SPECIALS)]
    assert got == expected + [(i + 3, w, False) for i, w in enumerate(words)]
    again = sequences.build_vocab(rows, "text", rows_per_range=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, vocab.collect()))
    with pytest.raises(ValueError):
        sequences.build_vocab(rows, "text", specials=())


@pytest.mark.parametrize("small", [None, False])
@pytest.mark.parametrize("cap", [None, 2])
def test_encode(rows, vocab, small, cap):
    ids = {r["piece"]: r["token_id"] for r in vocab.collect()}
    got = {r["ex_id"]: r["input_ids"] for r in sequences.encode(rows, vocab, "text", max_length=cap, small=small).collect()}
    assert got == {i: [ids[w] for w in (t or "").split()][:cap] for i, t in enumerate(TEXTS)}


def test_unknown_tokens_get_the_unknown_id(spark, vocab):
    df = spark.createDataFrame([(1, "a nope")], "ex_id bigint, text string")
    assert sequences.encode(df, vocab, "text", unknown_id=99).first()["input_ids"][1] == 99


@pytest.mark.parametrize("small", [None, False])
def test_decode_drops_special_tokens(rows, vocab, small):
    ids = sequences.encode(rows, vocab, "text").select(F.col("ex_id").alias("prompt_id"), F.col("input_ids").alias("prompt_input_ids"))
    got = {r["prompt_id"]: r["prompt"] for r in alignment.decode_ids(ids, vocab, separator=" ", small=small).collect()}
    assert got == {i: " ".join(w for w in (t or "").split() if w not in sequences.SPECIALS) for i, t in enumerate(TEXTS)}


def test_decode_picks_the_first_known_column(spark, vocab):
    ids = {r["piece"]: r["token_id"] for r in vocab.collect()}
    a, b, c = ([ids[w]] for w in "abc")
    df = spark.createDataFrame([(1, c, b, a)], "prompt_id bigint, input_ids array<int>, query_input_ids array<int>, prompt_input_ids array<int>")
    decoded = lambda d: alignment.decode_ids(d, vocab).first()["prompt"]
    assert decoded(df) == "a"
    assert decoded(df.drop("prompt_input_ids")) == "b"
    assert decoded(df.drop("prompt_input_ids", "query_input_ids")) == "c"
    assert decoded(df.select("prompt_id")) == ""
    assert decoded(df.withColumn("prompt", F.lit("given"))) == "given"


def test_training_rows(rows, vocab):
    out = sequences.training_rows(sequences.encode(rows, vocab, "text"), max_length=3).collect()
    for r in out:
        assert len(r["input_ids"]) <= 3
        assert r["labels"] == r["input_ids"] and r["attention_mask"] == [1] * len(r["input_ids"])


@pytest.fixture(scope="module")
def tokens(spark):
    values = [(i * 10, list(range(1, 2 + (i * 7) % 11))) for i in range(51)]
    df = spark.createDataFrame(values, "ex_id bigint, input_ids array<int>").repartition(4)
    return sequences.training_rows(df)


@pytest.mark.parametrize("by_length", [False, True])
@pytest.mark.parametrize("size, rows_per_range", [(2, 5000), (2, 7), (8, 3)])
def test_padding(tokens, by_length, size, rows_per_range):
    source = {r["ex_id"]: r for r in tokens.collect()}
    padded = sequences.pad_batches(tokens, 0, size, by_length=by_length, rows_per_range=rows_per_range).collect()
    assert len(padded) == len(source)
    order = sorted(source, key=lambda k: (len(source[k]["input_ids"]), k) if by_length else k)
    assert {r["ex_id"]: r["batch_id"] for r in padded} == {k: i // size for i, k in enumerate(order)}
    for batch in {r["batch_id"] for r in padded}:
        members = [r for r in padded if r["batch_id"] == batch]
        width = max(r["n_tokens"] for r in members)
        for r in members:
            raw, gap = source[r["ex_id"]], width - r["n_tokens"]
            assert r["input_ids"] == raw["input_ids"] + [0] * gap
            assert r["attention_mask"] == raw["attention_mask"] + [0] * gap
            assert r["labels"] == raw["labels"] + [-100] * gap


def test_waste(spark, tokens):
    sizes = tokens.select("ex_id", F.size("input_ids").alias("n_tokens"))
    for rows_per_range in (4, 1000):
        got = {r["by_length"]: r for r in sequences.padding_waste(sizes, 4, rows_per_range=rows_per_range).collect()}
        for by_length in (False, True):
            padded = sequences.pad_batches(tokens, 0, 4, by_length=by_length).collect()
            cells = sum(len(r["input_ids"]) for r in padded)
            gaps = sum(len(r["input_ids"]) - r["n_tokens"] for r in padded)
            row = got[by_length]
            assert (row["n_batches"], row["n_cells"], row["n_padding"]) == (13, cells, gaps)
            assert row["waste"] == pytest.approx(gaps / cells)
    assert got[True]["waste"] < got[False]["waste"]
    none = sequences.padding_waste(sizes.limit(0)).collect()
    assert [(r["n_batches"], r["waste"]) for r in none] == [(0, 0.0), (0, 0.0)]


def test_caps(spark):
    df = spark.createDataFrame([(1, list("abcde"), list("vwxyz")), (2, ["a"], [])], "id int, prompt_tokens array<string>, completion_tokens array<string>")
    out = {r["id"]: r for r in sequences.length_caps(df, max_prompt=3, max_completion=4).collect()}
    assert (out[1]["prompt_tokens"], out[1]["completion_tokens"]) == (list("cde"), list("vwxy"))
    assert (out[1]["prompt_over"], out[1]["completion_over"]) == (True, True)
    assert (out[2]["prompt_tokens"], out[2]["completion_tokens"]) == (["a"], [])
    assert (out[2]["prompt_over"], out[2]["completion_over"]) == (False, False)
    head = sequences.length_caps(df, max_prompt=3, keep="head").where("id = 1").first()
    assert head["prompt_tokens"] == list("abc") and not head["completion_over"]
    with pytest.raises(ValueError):
        sequences.length_caps(df, keep="middle")


def test_truncation_report(spark):
    good = "<think> a </think> <answer> b </answer>"
    df = spark.createDataFrame([("s", good), ("s", "x " * 9 + good), ("s", "x " * 30), ("t", "x")], "source string, completion string")
    got = {r["source"]: tuple(r)[1:] for r in sequences.truncation_report(df, "source", 12).collect()}
    assert got["s"] == pytest.approx((3, 30, 2 / 3, 2 / 3, 1 / 3))
    assert got["t"] == (1, 1, 0, 0, 0)


def test_tokenizer_plug_in_on_arrow_batches(spark):
    tokenizers = pytest.importorskip("tokenizers")
    model = tokenizers.Tokenizer(tokenizers.models.WordLevel({"a": 5, "b": 6, "?": 0}, unk_token="?"))
    model.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    stored = json.dumps(json.loads(model.to_str()))

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        local = tokenizers.Tokenizer.from_str(stored)
        return pd.Series([e.ids for e in local.encode_batch(texts.tolist())])

    df = spark.createDataFrame([(1, "a b"), (2, "c a")], "ex_id bigint, text string")
    out = sequences.training_rows(sequences.tokenize_with(df, encode, "text"))
    assert {r["ex_id"]: r["labels"] for r in out.collect()} == {1: [5, 6], 2: [0, 5]}
    native = sequences.tokenize_with(df, T.words_of, "text", "words")
    assert {r["ex_id"]: r["words"] for r in native.collect()} == {1: ["a", "b"], 2: ["c", "a"]}


@pytest.mark.parametrize("n, p", [(6, 3), (7, 3), (3, 3), (2, 3), (5, 1), (40, 1), (0, 2), (5, 0), (12, 5)])
def test_alignment_by_position(spark, n, p):
    completions = spark.createDataFrame([(i, f"c{i}") for i in range(n)], "pos bigint, completion string")
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(p)], "prompt_pos bigint, prompt string")
    got = {r["pos"]: r["prompt"] for r in alignment.align_prompts(completions, prompts).collect()}
    if p == 0:
        assert got == {i: "" for i in range(n)}
    elif n % p == 0:
        assert got == {i: f"p{i // (n // p)}" for i in range(n)}
    else:
        assert got == {i: f"p{i % p}" for i in range(n)}


def test_join_prompts_keeps_every_completion(spark):
    completions = spark.createDataFrame([(1, 7), (2, 8)], "comp_id bigint, prompt_id bigint")
    prompts = spark.createDataFrame([(7, "p")], "prompt_id bigint, prompt string")
    got = {r["comp_id"]: r["prompt"] for r in alignment.join_prompts(completions, prompts).collect()}
    assert got == {1: "p", 2: None}


def test_join_prompts_deals_hot_prompts_out(spark):
    """A third of all completions under one prompt, a tenth under none: whole, and no task has much more than others."""
    kind = F.expr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 10 = 1 THEN NULL ELSE id % 5000 END")
    rows = spark.range(30_000).select(F.col("id").alias("comp_id"), kind.alias("prompt_id"))
    prompts = spark.range(0, 5000, 2).select(F.col("id").alias("prompt_id"), F.concat(F.lit("p"), "id").alias("prompt"))
    prompts = prompts.union(spark.createDataFrame([(7, "hot")], prompts.schema))
    want = sorted(map(repr, rows.join(prompts, "prompt_id", "left").select("comp_id", "prompt_id", "prompt").collect()))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = alignment.join_prompts(rows, prompts)
        assert joined.columns == ["prompt_id", "comp_id", "prompt"]
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        assert sorted(map(repr, joined.select("comp_id", "prompt_id", "prompt").collect())) == want
        assert len(sizes) == 16 and sizes[-1] <= 3 * sizes[8]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_tokenizer_over_batches(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "ex_id long, text string")
    tokenizer = sequences.batch_tokenizer(lambda: lambda texts: [list(map(ord, t)) for t in texts])
    got = {r["ex_id"]: r["input_ids"] for r in sequences.tokenize_with(rows, tokenizer, "text").collect()}
    assert got == {1: [97, 98], 2: [], 3: []}
    assert sequences.tokenize_with(rows.where("false"), tokenizer, "text").count() == 0


def test_a_tokenizer_gets_parts_of_a_batch(spark):
    """However many rows an Arrow batch has, about a million bytes of text are made into ids at a time."""

    def load():
        def encode(texts):
            most = sum(len(t.encode()) for t in texts) <= sequences.BYTES_AT_ONCE + 40_000 or len(texts) == 1
            return [[len(t), int(most)] for t in texts]

        return encode

    long = F.expr("CASE WHEN id % 50 = 7 THEN NULL WHEN id = 33 THEN repeat('a', 3000000) ELSE repeat('ن', CAST(id % 20000 AS INT)) END")
    rows = spark.range(0, 400, 1, 1).select((F.col("id") * 37).alias("id")).select("id", long.alias("text"))
    tokenized = sequences.tokenize_with(rows, sequences.batch_tokenizer(load), "text")
    got = tokenized.select("id", "input_ids", F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect()
    assert len(got) == 400 and all(r["input_ids"] == [r["n"], 1] for r in got)


def test_peek_and_kept_columns(spark):
    from scoreloom.operators import prepare

    rows = spark.createDataFrame([(2, [1]), (1, [1, 2, 3])], "ex_id long, input_ids array<int>")
    assert [(r["ex_id"], r["n_tokens"]) for r in prepare.peek(rows).collect()] == [(1, 3)]
    assert prepare.peek(rows.where("false")).count() == 0
