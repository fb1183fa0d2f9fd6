"""Token sequences: ids, caps, batches and their padding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom import constants as K
from scoreloom.functions import text as T
from scoreloom.operators.lookup import left_lookup
from scoreloom.operators.numbering import number_blocks, number_rows
from scoreloom.staging import staged

SPECIALS = (K.END_OF_TEXT, K.TURN_START, K.TURN_END)
#: Text that a plugged-in tokenizer gets at a time, beside the text that reaches it.
BYTES_AT_ONCE = 1 << 20


def build_vocab(
    df: DataFrame,
    text: str,
    specials: Sequence[str] = SPECIALS,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Vocabulary of white-space tokens: ``token_id, piece, is_special``.

    Special tokens come first, the others follow in code-point order.
    """
    if not specials:
        raise ValueError("at least one special token is needed, it marks padding")
    words = df.select(F.explode_outer(T.words_of(F.col(text))).alias("piece"))
    pieces = words.where(~F.col("piece").isin(*specials)).distinct()
    numbered = number_rows(pieces, ["piece"], "token_id", len(specials), rows_per_range)
    fixed = df.sparkSession.createDataFrame(
        [(i, piece, True) for i, piece in enumerate(specials)],
        "token_id bigint, piece string, is_special boolean",
    )
    rest = numbered.select(F.col("token_id").cast("bigint").alias("token_id"), "piece", F.lit(False).alias("is_special"))
    return staged(fixed.unionByName(rest), "vocab")


def encode(
    df: DataFrame,
    vocab: DataFrame,
    text: str,
    key: str = "ex_id",
    max_length: int | None = None,
    unknown_id: int = 0,
    small: bool | None = None,
) -> DataFrame:
    """``key`` and ``input_ids``: white-space tokens looked up in the vocabulary.

    A cap cuts the token list before the lookup, so tokens that would be dropped
    are neither joined nor shuffled. Text without tokens gives an empty list.
    """
    words = T.words_of(F.col(text))
    if max_length is not None:
        words = F.slice(words, 1, max_length)
    # dealt by key before the explode: the text moves once, and its tokens stay where they are
    dealt = df.select(key, words.alias("words")).repartition(key)
    tokens = dealt.select(key, F.posexplode_outer("words").alias("pos", "word")).select(
        key, "pos", F.coalesce("word", F.lit("")).alias("piece")
    )
    found = left_lookup(tokens, vocab.select("piece", "token_id"), "piece", ("piece",), small)
    placed = F.struct("pos", F.coalesce("token_id", F.lit(unknown_id)).cast("bigint").alias("id"))
    placed = F.when(F.col("pos").isNotNull(), placed)
    ordered = F.array_sort(F.collect_list(placed))
    unpacked = F.transform(ordered, lambda e: e["id"])
    return found.groupBy(key).agg(unpacked.alias("input_ids"))


def tokenize_with(
    df: DataFrame, tokenizer: Callable[[Column], Column], text: str, name: str = "input_ids"
) -> DataFrame:
    """Plug in a tokenizer: a column builder, or a pandas UDF working on Arrow batches."""
    return df.withColumn(name, tokenizer(F.col(text)))


def batch_tokenizer(load: Callable[[], Callable[[list[str]], list[list[int]]]]) -> Callable[[Column], Column]:
    """A tokenizer for ``tokenize_with`` from one that takes lists of texts.

    ``load`` runs once for all batches of a task, so that a model is not read again for each. A batch is
    tokenized and given back in parts of about ``BYTES_AT_ONCE``, as lists of ids take many times their texts.
    """

    @F.arrow_udf("array<bigint>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for texts in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="int64")
            cuts = np.flatnonzero(np.diff(ends // BYTES_AT_ONCE)) + 1
            for start, end in pairwise([0, *cuts.tolist(), len(texts)]):
                part = [t or "" for t in texts[start:end].to_pylist()]
                yield pa.array(encode(part), pa.list_(pa.int64()))

    return ids


def training_rows(df: DataFrame, max_length: int = K.MAX_SEQUENCE, ids: str = "input_ids") -> DataFrame:
    """Cut ids to ``max_length`` and add ``attention_mask`` and ``labels``."""
    cut = df.withColumn(ids, F.slice(ids, 1, max_length))
    return cut.withColumns(
        {"attention_mask": F.array_repeat(F.lit(1), F.size(ids)), "labels": F.col(ids)}
    )


def _padded(array: str, fill: int) -> Column:
    missing = F.col("batch_length") - F.size(array)
    return F.concat(F.col(array), F.array_repeat(F.lit(fill), missing)).alias(array)


def pad_batches(
    rows: DataFrame,
    pad_id: int = 0,
    batch_size: int = K.COLLATE_ROWS,
    key: str = "ex_id",
    by_length: bool = False,
    label_pad: int = K.LABEL_PAD,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Batches of consecutive rows, padded to the longest row of the batch.

    ``by_length`` orders rows by length before batching, so a batch holds rows
    of about one length. Ids are padded with ``pad_id``, masks with 0 and labels
    with ``label_pad``. Batches are made of keys and lengths alone, so the ids are
    exchanged once, to meet them; ``rows`` is read twice and should be a stored table.
    """
    sizes = rows.select(key, F.size("input_ids").alias("n_tokens"))
    keys = ["n_tokens", key] if by_length else [key]
    blocks = number_blocks(sizes, keys, batch_size, "batch_id", rows_per_range)
    longest = F.max("n_tokens").over(Window.partitionBy("batch_id")).alias("batch_length")
    return rows.join(blocks.select(key, "batch_id", "n_tokens", longest), key).select(
        key, "batch_id", "n_tokens",
        _padded("input_ids", pad_id), _padded("attention_mask", 0), _padded("labels", label_pad),
    )


def padding_waste(
    sizes: DataFrame,
    batch_size: int = K.COLLATE_ROWS,
    key: str = "ex_id",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Padding cells as a share of all cells, with and without ordering by length.

    Takes ``key`` and ``n_tokens``; only these narrow rows are exchanged.
    """
    sizes = staged(sizes.select(key, "n_tokens"), "token-counts")
    out = None
    for by_length in (False, True):
        keys = ["n_tokens", key] if by_length else [key]
        blocks = number_blocks(sizes, keys, batch_size, "batch_id", rows_per_range)
        batches = blocks.groupBy("batch_id").agg(
            F.max("n_tokens").alias("longest"), F.count("*").alias("rows"), F.sum("n_tokens").alias("used")
        )
        part = batches.agg(
            F.count("*").alias("n_batches"),
            F.sum(F.col("longest") * F.col("rows")).alias("n_cells"),
            F.sum(F.col("longest") * F.col("rows") - F.col("used")).alias("n_padding"),
        ).select(
            F.lit(by_length).alias("by_length"), "n_batches", "n_cells", "n_padding",
            F.coalesce(F.try_divide("n_padding", "n_cells"), F.lit(0.0)).alias("waste"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def length_caps(
    df: DataFrame,
    prompt_tokens: str = "prompt_tokens",
    completion_tokens: str = "completion_tokens",
    max_prompt: int = K.MAX_PROMPT,
    max_completion: int = K.MAX_COMPLETION,
    keep: str = "tail",
    keep_completion: str = "head",
) -> DataFrame:
    """Cap token lists and flag the rows that were over.

    ``keep`` says which end survives: ``head`` or ``tail``.
    """
    for end in (keep, keep_completion):
        if end not in ("head", "tail"):
            raise ValueError(f"keep must be 'head' or 'tail', not {end!r}")

    def cap(tokens: str, most: int, end: str) -> Column:
        start = F.lit(1) if end == "head" else F.greatest(F.lit(1), F.size(tokens) - most + 1)
        return F.slice(tokens, start, F.lit(most))

    return df.withColumns(
        {
            "prompt_over": F.size(prompt_tokens) > max_prompt,
            "completion_over": F.size(completion_tokens) > max_completion,
        }
    ).withColumns(
        {
            prompt_tokens: cap(prompt_tokens, max_prompt, keep),
            completion_tokens: cap(completion_tokens, max_completion, keep_completion),
        }
    )


def truncation_report(
    df: DataFrame, by: str, max_length: int = K.MAX_COMPLETION, text: str = "completion"
) -> DataFrame:
    """Per group: rows over the cap, and rows whose tags are complete only before the cut."""
    words = df.select(
        by, F.col(text).alias("whole"), T.words_of(F.col(text)).alias("words")
    ).withColumn("over", F.size("words") > max_length)
    # rows within the cap lose nothing, so only the others are put together again
    cut = words.withColumn(
        "cut", F.when(F.col("over"), F.array_join(F.slice("words", 1, max_length), " "))
    )

    def complete(column: str) -> Column:
        body = F.col(column)
        return F.coalesce(
            (T.tag_end(body, T.tag_start(body, K.THINK_TAGS[0]), *K.THINK_TAGS) > 0)
            & (T.tag_end(body, T.tag_start(body, K.ANSWER_TAGS[0]), *K.ANSWER_TAGS) > 0),
            F.lit(False),
        )

    flagged = cut.select(
        by, "over", F.size("words").alias("n_tokens"),
        complete("whole").alias("before"), complete("cut").alias("after"),
    )
    return flagged.groupBy(by).agg(
        F.count("*").alias("n_rows"),
        F.max("n_tokens").alias("max_tokens"),
        F.avg(F.col("over").cast("double")).alias("share_over"),
        F.avg(F.col("before").cast("double")).alias("share_complete"),
        F.avg((F.col("over") & F.col("before") & ~F.col("after")).cast("double")).alias("share_broken"),
    )
