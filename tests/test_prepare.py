import pytest
from pyspark.sql import functions as F

from scoreloom import constants as K
from scoreloom.functions import text as T
from scoreloom.functions.templates import CHATML, PLAIN, Template
from scoreloom.operators import conversations, prepare
from scoreloom.sources.tables import (
    INSTRUCTION_SCHEMA, from_columns, read_table, replace_splits, write_table,
)

SPACES = T.WHITESPACE


def rows(spark, *values):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(values)], INSTRUCTION_SCHEMA)


def one(df, *columns):
    row = df.select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_white_space_is_what_python_strips(spark):
    assert len(SPACES) == 29
    assert sorted(SPACES) == [c for c in map(chr, range(0x110000)) if c.isspace()]
    df = spark.createDataFrame([(SPACES + "a b" + SPACES,)], "t string")
    assert one(df, T.strip(F.col("t"))) == "a b"


@pytest.mark.parametrize("value", ["", "  ", "a", " a\tb c ", SPACES + "x" + SPACES + "y" + SPACES, None, "é ب​c"])
def test_words(spark, value):
    df = spark.createDataFrame([(value,)], "t string")
    assert one(df, T.words_of(F.col("t"))) == (value or "").split()


def test_words_split_on_every_space_and_nothing_else(spark):
    text = "".join(f"{chr(p)}|" for p in [*range(1, 0x3100), 0xFEFF, 0x1F600])
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df, T.words_of(F.col("t"))) == text.split()


@pytest.mark.parametrize("value, expected", [("a1ب20", "a١ب٢٠"), (None, ""), ("", ""), ("0123456789", K.ARABIC_DIGITS), ("٣ three", "٣ three")])
def test_digits(spark, value, expected):
    df = spark.createDataFrame([(value,)], "t string")
    assert one(df, T.normalize_digits(F.col("t"))) == expected


@pytest.mark.parametrize(
    "instruction, context, expected",
    [
        ("i", "c", "c\\n\\ni"),
        ("i", "   ", "i"),
        ("i", SPACES, "i"),
        ("i", None, "i"),
        (" i ", " c ", "c \\n\\n i"),
        ("1", "2", "٢\\n\\n١"),
        (None, "c", "c\\n\\n"),
        (None, None, ""),
    ],
)
def test_user_query(spark, instruction, context, expected):
    out = prepare.add_user_query(rows(spark, (instruction, context, "")))
    assert one(out, "user_query") == expected


def test_user_query_options(spark):
    df = rows(spark, ("1", "2", ""))
    assert one(prepare.add_user_query(df, separator="\n", normalize=False), "user_query") == "2\n1"


R, P = "reason", K.PLACEHOLDER_REASONING


@pytest.mark.parametrize(
    "answer, reasoning, final, response",
    [
        ("r إذن، f", "r", "f", "<think>r</think><answer>f</answer>"),
        ("إذن، f", "", "f", f"<think>{P}</think><answer>f</answer>"),
        (" r ", " r ", "", "<think> r </think><answer> r </answer>"),
        ("r إذن،  ", "r", "", "<think>r</think><answer>r</answer>"),
        ("", "", "", ""),
        (None, "", "", ""),
        ("   ", "   ", "", "<think>   </think><answer>   </answer>"),
        ("a إذن، b إذن، c", "a", "b إذن، c", "<think>a</think><answer>b إذن، c</answer>"),
        ("a\nإذن،\nb\nc1", "a", "b\nc١", "<think>a</think><answer>b\nc١</answer>"),
        ("  إذن،  ", "", "", ""),
    ],
)
def test_answer_parts(spark, answer, reasoning, final, response):
    out = prepare.add_answer_parts(rows(spark, ("i", "", answer)))
    assert one(out, "reasoning", "final", "response") == (reasoning, final, response)


def test_message_and_prompt_datasets(spark):
    df = rows(spark, ("سؤال 1", "سياق", "لأن إذن، نعم"))
    messages = prepare.prepare(df, for_rl=False, template="chatml", max_seq_length=8)
    assert messages.columns == [*df.columns, "messages"]
    turns = [(m["role"], m["content"]) for m in one(messages, "messages")]
    assert turns == [
        ("system", K.SYSTEM_PROMPT), ("user", "سياق\\n\\nسؤال ١"), ("assistant", "<think>لأن</think><answer>نعم</answer>"),
    ]
    prompts = prepare.prepare(df, template=CHATML)
    assert prompts.columns == [*df.columns, "prompt", "chosen", "rejected"]
    assert one(prompts, "prompt", "chosen", "rejected") == (
        f"<|im_start|>system\n{K.SYSTEM_PROMPT}<|im_end|>\n<|im_start|>user\nسياق\\n\\nسؤال ١<|im_end|>\n"
        "<|im_start|>assistant\n", "", "",
    )
    text = one(prepare.training_text(df), "text")
    assert text == one(messages.select(CHATML.render(F.col("messages")).alias("t")), "t")
    assert text.endswith("</answer><|im_end|>\n")
    assert [tuple(r) for r in prepare.message_rows(messages).orderBy("pos").collect()] == [
        (0, i, *turn) for i, turn in enumerate(turns)
    ]


def test_system_prompt_length():
    assert len(K.SYSTEM_PROMPT) == 355


def test_absent_columns_count_as_empty(spark):
    df = spark.createDataFrame([(1, "q")], "ex_id bigint, instruction string")
    assert one(prepare.message_dataset(df), F.expr("messages[2].content")) == ""
    assert one(prepare.prompt_dataset(df, PLAIN), "prompt").endswith("user: q\nassistant: ")


def test_arguments_are_checked_before_any_plan(spark):
    df = rows(spark, ("i", "", ""))
    with pytest.raises(ValueError):
        prepare.prepare(df)
    with pytest.raises(ValueError):
        prepare.prepare(df, for_rl=False, template="chatml")
    with pytest.raises(ValueError):
        prepare.prepare(df, template="no such template")


def test_question_goes_in_as_it_is(spark):
    df = spark.createDataFrame([(" 1+1? ",)], "question string")
    out = prepare.question_prompts(df, system="s")
    assert one(out, "prompt") == (
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n 1+1? <|im_end|>\n<|im_start|>assistant\n"
    )


def messages(spark, *turns):
    return spark.createDataFrame([(list(turns),)], "messages array<struct<role: string, content: string>>")


def test_templates(spark):
    df = messages(spark, ("user", "u"), ("tool", "t"), ("assistant", "a"))
    m = F.col("messages")
    assert one(df, CHATML.render(m)) == "<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert one(df, CHATML.render(m, ask=True)).endswith("a<|im_end|>\n<|im_start|>assistant\n")
    assert one(df, PLAIN.render(m, ask=True)) == "user: u\ntool: t\nassistant: a\n"
    assert one(messages(spark, ("user", "u")), PLAIN.render(m, ask=True)) == "user: u\nassistant: "
    assert one(messages(spark), CHATML.render(m)) == ""
    upper = Template(turn=lambda r, c: F.upper(c), opener="?")
    assert one(df, upper.render(m, ask=True)) == "UTA?"


def test_small_table_operators(spark):
    df = rows(spark, *((f"i{i}", "", "") for i in range(20)))
    assert [r["ex_id"] for r in prepare.first_rows(df, 3).collect()] == [0, 1, 2]
    assert prepare.row_count(df).first()["n_rows"] == 20
    assert prepare.concat_rows(df, df, df).count() == 60
    assert prepare.keep_columns(df, "ex_id").columns == ["ex_id"]
    with pytest.raises(ValueError):
        prepare.keep_columns(df, "nope")


# --- conversations ------------------------------------------------------------------


def turns(spark, *values):
    return spark.createDataFrame(list(values), "conv_id bigint, turn bigint, role string, text string")


def test_turn_pairs(spark):
    df = turns(
        spark, (1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 5, "user", "u2"),
        (1, 9, "assistant", "a2"), (2, 0, "user", "u3"), (2, 1, "user", "u4"), (3, 0, "assistant", "a3"),
        (4, 0, "user", "u5"), (5, 0, "assistant", "a5"),
    )
    got = sorted(tuple(r) for r in conversations.turn_pairs(df).collect())
    assert got == [(1, 1, "u1", "a1"), (1, 5, "u2", "a2")]


@pytest.mark.parametrize("turns_per_task", [1, 2, 7, 50, 10_000])
def test_long_conversations_are_spread(spark, turns_per_task):
    """A third of all rows and more in one conversation, with gaps in its turns and turns below 0."""
    values = [(7, 3 * t - 90, ("user", "assistant", "user", "system")[t % 4], f"x{t}") for t in range(200)]
    values += [(c, t, ("user", "assistant")[t % 2], f"{c}.{t}") for c in range(20) if c != 7 for t in range(c % 5)]
    df = turns(spark, *values).repartition(3)
    found = conversations.turn_pairs(df, turns_per_task)
    want = []
    for conv in {v[0] for v in values}:
        own = sorted(v for v in values if v[0] == conv)
        want += [(conv, a[1], a[3], b[3]) for a, b in zip(own, own[1:]) if (a[2], b[2]) == ("user", "assistant")]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_conversation_text(spark):
    df = turns(
        spark, (1, 2, "assistant", "a"), (1, 1, "user", "u"), (1, 3, "tool", "t"), (2, 0, "tool", "t"), (3, 0, "user", "q")
    )
    chat = {r["conv_id"]: (r["n_turns"], r["text"]) for r in conversations.conversation_text(df).collect()}
    assert chat == {
        1: (2, "<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"),
        2: (0, ""), 3: (1, "<|im_start|>user\nq<|im_end|>\n"),
    }
    plain = {r["conv_id"]: r["text"] for r in conversations.conversation_text(df, PLAIN, ask=True).collect()}
    assert plain == {1: "user: u\nassistant: a\ntool: t\n", 2: "tool: t\n", 3: "user: q\nassistant: "}
    built = conversations.conversation_messages(df).select("conv_id", PLAIN.render(F.col("messages"), True).alias("t"))
    assert {r["conv_id"]: r["t"] for r in built.collect()} == plain


# --- sources and sinks --------------------------------------------------------------


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_write_and_read_a_split(spark, tmp_path, fmt):
    df = rows(spark, ("a", "", "x"), ("b", "c", "y")).withColumn("split", F.when(F.col("ex_id") == 0, "train").otherwise("test"))
    path = str(tmp_path / "t")
    write_table(df, path, fmt, partition_by=["split"])
    schema = INSTRUCTION_SCHEMA if fmt == "json" else None
    train = read_table(spark, path, "train", fmt, schema)
    assert [r["instruction"] for r in train.collect()] == ["a"]
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(Exception):
        write_table(df, path, fmt)


def test_reading_is_checked(spark, small):
    with pytest.raises(ValueError):
        read_table(spark, small, fmt="csv")
    with pytest.raises(ValueError):
        read_table(spark, small, fmt="json")
    with pytest.raises(ValueError):
        read_table(spark, f"{small}/documents.parquet", split="train")


def test_from_columns(spark):
    df = from_columns(spark, {"instruction": ["a", "b"], "answer": ["x", "y"]})
    assert [tuple(r) for r in df.orderBy("instruction").collect()] == [("a", "x"), ("b", "y")]
    assert df.columns == ["instruction", "answer"]
    with pytest.raises(ValueError):
        from_columns(spark, {"a": [1], "b": []})


def test_replacing_a_split(spark, tmp_path):
    path = str(tmp_path / "splits")
    schema = "ex_id long, text string, split string"
    replace_splits(spark.createDataFrame([(1, "a\nb", "train"), (2, None, "test"), (3, "", "test")], schema), path)
    for _ in range(2):
        replace_splits(spark.createDataFrame([(4, "new", "test")], schema), path)
    assert sorted(map(tuple, read_table(spark, path).collect())) == [(1, "a\nb", "train"), (4, "new", "test")]
    replace_splits(spark.createDataFrame([], schema), path)
    assert read_table(spark, path).count() == 2
    with pytest.raises(ValueError):
        replace_splits(spark.range(1), path, partition_by=())


def test_summary_of_the_fixture_table(spark, fixture_sql):
    for scale, expected in (("sf0.001", (34, 10, 2, 16, 6, 10)), ("sf0.01", (233, 71, 29, 108, 25, 63))):
        spark.read.parquet(f"/root/testdata/{scale}/conversations.parquet").createOrReplaceTempView("conversations")
        out = prepare.add_answer_parts(spark.sql(fixture_sql["SI"]))
        r, f = F.col("reasoning") != "", F.col("final") != ""
        got = out.agg(
            F.count("*"), F.count_if(r & f), F.count_if(~r & f), F.count_if(r & ~f), F.count_if(~r & ~f),
            F.count_if(T.strip(F.coalesce("context", F.lit(""))) != ""),
        ).first()
        assert tuple(got) == expected
