"""Words, hashes and written tables the pipeline operators share.

A *word* is a run of characters other than space and U+0009..U+000D. Python's
``bytes.split()`` cuts UTF-8 at exactly these six bytes, so tasks work on bytes
and never decode a text they only have to cut into words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)
#: Distinct words a worker remembers; the memory is emptied beyond that.
REMEMBERED = 400_000


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of the values are in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
#: Bytes of a text hashed at once; a longer word is still hashed whole.
BLOCK_BYTES = 1 << 18
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_up_to(n: int) -> list[np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        base = int(ODD)
        for k, b in enumerate((base, pow(base, -1, 1 << 64))):
            _powers[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64)
    return _powers


def text_hashes(text: bytes) -> np.ndarray:
    """The 64-bit hash of each word of a text: a polynomial over its bytes, from running sums."""
    return text_words(text)[0]


def text_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word of a text, and the bytes where it starts and ends."""
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK_BYTES)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        chars = np.frombuffer(text, np.uint8, end - at, at)
        inside = np.zeros(len(chars) + 2, bool)
        np.logical_not(_SPACE[chars], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        powers, inverse = _powers_up_to(max(len(chars) + 1, BLOCK_BYTES + 1))
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(_BYTE[chars] * powers[: len(chars)], out=sums[1:])
        starts, ends = edges[0::2], edges[1::2]
        parts.append((mix((sums[ends] - sums[starts]) * inverse[starts]), starts + at, ends + at))
        at = end
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes, starts, ends = (np.concatenate(p) for p in zip(*parts, strict=True))
    return hashes, starts, ends


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` consecutive words."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = word_hashes[:count].copy()
    for k in range(1, n):
        out = out * ODD + word_hashes[k : k + count]
    return mix(out)


def shingle_set(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct ``n``-word shingles, sorted; fewer words count as one shingle, none as none."""
    if not len(word_hashes):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(word_hashes, min(n, len(word_hashes))))


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string or binary column as Python bytes."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
          "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def arrow_schema(columns: str) -> pa.Schema:
    """``"a long, b binary"`` as tasks need it, where no session is at hand."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def map_batches(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """``function(table) -> columns by name`` on the record batches of each partition."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is None:
                continue
            arrays = [
                v if isinstance(v, pa.Array) and v.type == f.type else pa.array(v, type=f.type)
                for f, v in ((f, out[f.name]) for f in arrow)
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def pack(values: np.ndarray, deltas: bool = False) -> bytes:
    """Sorted or small numbers as bytes, one plane per byte position, compressed."""
    values = values.astype(np.uint64)
    values = np.diff(values, prepend=np.uint64(0)) if deltas else values
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, deltas: bool = False) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    values = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if deltas else values
