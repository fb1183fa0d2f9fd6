"""Reading instruction and completion tables, writing prepared ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "json", "orc")

INSTRUCTION_SCHEMA = T.StructType(
    [
        T.StructField("ex_id", T.LongType()),
        T.StructField("instruction", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)
COMPLETION_SCHEMA = T.StructType(
    [
        T.StructField("comp_id", T.LongType()),
        T.StructField("prompt_id", T.LongType()),
        T.StructField("gen_idx", T.IntegerType()),
        T.StructField("completion", T.StringType()),
    ]
)


def _known(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, not {fmt!r}")
    return fmt


def read_table(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """A stored table, or one split of it.

    ``split`` filters the partition column of that name, so the files of other
    splits are never opened. JSON without a schema would be read twice to infer
    one, so it has to come with its schema.
    """
    if _known(fmt) == "json" and schema is None:
        raise ValueError("a JSON table needs an explicit schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if split is None:
        return df
    if "split" not in df.columns:
        raise ValueError(f"{path} has no split column")
    return df.where(F.col("split") == split)


def from_columns(
    spark: SparkSession, columns: Mapping[str, Sequence], schema: T.StructType | None = None
) -> DataFrame:
    """A small in-memory table from equally long columns."""
    lengths = {name: len(values) for name, values in columns.items()}
    if len(set(lengths.values())) > 1:
        raise ValueError(f"columns differ in length: {lengths}")
    rows = list(zip(*columns.values(), strict=True))
    return spark.createDataFrame(rows, schema if schema is not None else list(columns))


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Store a prepared table, by split if asked to."""
    writer = df.write.format(_known(fmt)).mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def replace_splits(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ("split",)) -> None:
    """Put the splits that ``df`` holds in place of those stored; the others stay.

    Writing the same rows again leaves one copy of them, so a job that failed half way can simply run again.
    """
    if not partition_by:
        raise ValueError("splits are told apart by at least one column")
    writer = df.write.format(_known(fmt)).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).save(path)
