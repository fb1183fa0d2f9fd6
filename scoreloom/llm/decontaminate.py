"""Benchmark decontamination with SimHash windows.

A document is contaminated by an item when some window of the document, as many words
long as the item, has a weighted 5-word shingle similarity of 0.75 or more with it
(sum of the smaller counts over sum of the larger counts; A-Z lower-cased; an item of
fewer than five words is one shingle of all its words). A document shorter than the item
is one window as a whole; with fewer shingles than 0.75 of the item's it cannot be similar.

* *Windows.* Every window that holds at least one shingle of the benchmark is
  fingerprinted; any other window has similarity 0. A window's 128-bit SimHash is the sign
  of a difference of running sums, so sliding costs the same for any item length.
* *Candidates.* The fingerprint is cut into 16 blocks of 8 bits, and each block looks up
  the items whose block is at most 2 bits away. Up to radius 47 (16 * 3 - 1) some block must
  match, so every item within the radius is found. At similarity 0.75 the expected distance
  is 22 with a deviation of 4.3.
* *Verification.* Candidates are compared on their full shingle counts.

The benchmark is taken in parts of about ``PART`` items or ``PART_BYTES`` of text, each sent to the executors.
Up to ``CHAIN`` parts are compared in one pass over the documents; with more, the result is written and the parts are
given up before the next ones are sent. Documents are never shuffled or grouped.

Defined cases: a null or empty text is clean; null or empty items match nothing; rows
repeating an item or a document are judged one by one; without items all is clean; further
columns are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from scoreloom.llm.common import ODD, among, bytes_of, gram_hashes, mix, text_hashes
from scoreloom.staging import staged

WORDS, SIMILARITY = 5, 0.75
BITS, BLOCKS, BLOCK_RADIUS = 128, 16, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Items sent to the executors at once, and the size of an item's part in that limit.
PART, PART_BYTES = 2_000, 4 << 20
#: Parts compared in one pass.
CHAIN = 4
#: Windows fingerprinted at once.
WINDOWS = 4_096
FOUND = "array<struct<item_id: bigint, from_word: bigint, n_words: bigint, similarity: double>>"


def _grams(hashes: np.ndarray, length: int) -> np.ndarray:
    """The shingles as long as an item of ``length`` words has them."""
    return gram_hashes(hashes, min(WORDS, length))


def _signs(shingles: np.ndarray) -> np.ndarray:
    """A row of ``BITS`` times +1 or -1 for each shingle."""
    words = np.stack([mix(shingles), mix(shingles ^ ODD)], axis=1)
    bits = np.unpackbits(words.view(np.uint8).reshape(len(shingles), 16), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(shingles: np.ndarray, width: int) -> np.ndarray:
    """SimHash, as 16 bytes, of every run of ``width`` shingles."""
    sums = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(_signs(shingles), axis=0, out=sums[1:])
    return np.packbits(sums[width:] - sums[:-width] > 0, axis=1)


def similarity(a: Counter, b: Counter) -> float:
    return (a & b).total() / (a | b).total()


class Items:
    """One part of the benchmark: shingles, fingerprints and block tables by item length."""

    def __init__(self, items: list[tuple[int, str]]):
        self.by_length: dict[int, dict] = {}
        shingles: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            hashes = text_hashes(text.encode().lower())
            if not len(hashes):
                continue
            grams = _grams(hashes, len(hashes))
            group = self.by_length.setdefault(len(hashes), {"ids": [], "counts": [], "prints": []})
            group["ids"].append(item)
            group["counts"].append(Counter(grams.tolist()))
            group["prints"].append(fingerprints(grams, len(grams))[0])
            shingles.setdefault(min(WORDS, len(hashes)), []).append(grams)
        near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)) <= BLOCK_RADIUS
        for length, group in self.by_length.items():
            group["prints"] = np.stack(group["prints"])
            # tables[block][value]: which items have a block within its radius of the value
            group["tables"] = near[group["prints"].T].transpose(0, 2, 1)
            group["shingles"] = np.unique(np.concatenate([np.fromiter(c, np.uint64) for c in group["counts"]]))
        self.shingles = {n: np.unique(np.concatenate(s)) for n, s in shingles.items()}
        self.sieves = {}
        for n, s in self.shingles.items():
            sieve = np.zeros(1 << 18, bool)
            sieve[s & np.uint64(0x3FFFF)] = True
            self.sieves[n] = sieve

    def search(self, text: bytes | None) -> list[dict]:
        """The best window of each item the text holds."""
        hashes = text_hashes((text or b"").lower())
        best: dict[int, dict] = {}
        for n in self.shingles:
            grams = gram_hashes(hashes, n)
            hits = np.flatnonzero(self.sieves[n][(grams & np.uint64(0x3FFFF)).astype(np.int64)])
            hits = hits[among(grams[hits], self.shingles[n])]
            if len(hits):
                self._windows(grams, hits, n, len(hashes), best)
        return sorted(best.values(), key=lambda x: x["item_id"])

    def _windows(self, grams: np.ndarray, hits: np.ndarray, n: int, n_words: int, best: dict) -> None:
        for length, group in self.by_length.items():
            width = min(length - n + 1, len(grams))
            if min(WORDS, length) != n or width < SIMILARITY * (length - n + 1):
                continue
            own = hits[among(grams[hits], group["shingles"])]
            if not len(own):
                continue
            # starts of windows that hold a hit, as runs of consecutive starts
            low, high = np.maximum(own - width + 1, 0), np.minimum(own, len(grams) - width)
            low = np.maximum(low, np.concatenate([[-1], np.maximum.accumulate(high)[:-1]]) + 1)
            runs = [(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True) if a <= b]
            for start, end in _joined(runs):
                for at in range(start, end + 1, WINDOWS):
                    stop = min(end + 1, at + WINDOWS)
                    self._compare(grams, at, fingerprints(grams[at : stop + width - 1], width), group, min(length, n_words), width, best)

    def _compare(self, grams, at: int, prints: np.ndarray, group: dict, length: int, width: int, best: dict) -> None:
        found = np.zeros((len(prints), len(group["ids"])), bool)
        for block in range(BLOCKS):
            found |= group["tables"][block][prints[:, block]]
        window, item = np.nonzero(found)
        distance = np.bitwise_count(prints[window] ^ group["prints"][item]).sum(axis=1)
        for w, i in zip(window[distance <= RADIUS].tolist(), item[distance <= RADIUS].tolist(), strict=True):
            value = similarity(Counter(grams[at + w : at + w + width].tolist()), group["counts"][i])
            known = best.get(group["ids"][i])
            if value >= SIMILARITY and (known is None or value > known["similarity"]):
                best[group["ids"][i]] = {
                    "item_id": group["ids"][i], "from_word": at + w, "n_words": length, "similarity": value,
                }


def _joined(runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs that touch, as one."""
    start = end = None
    for a, b in runs:
        if start is not None and a <= end + 1:
            end = max(end, b)
            continue
        if start is not None:
            yield start, end
        start, end = a, b
    if start is not None:
        yield start, end


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts of about ``PART`` items or ``PART_BYTES``, by a hash of the text."""
    items = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-n // PART), -(-size // PART_BYTES))
    for k in range(parts):
        chosen = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield sorted((r[0], r[1]) for r in chosen.collect())


def search_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with one more column, last: per item with a similar window, the best one.

    It is called ``found``, with as many underscores ahead as the columns of ``docs`` make necessary.
    """
    name = "found"
    while name.lower() in [c.lower() for c in docs.columns]:
        name = "_" + name
    out, chained = docs.withColumn(name, F.array().cast(FOUND)), []
    for items in _parts(benchmark):
        if len(chained) == CHAIN:
            out = staged(out, "decontaminated")
            while chained:
                chained.pop().unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(Items(items))
        chained.append(sent)
        schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(FOUND))])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterable[pa.RecordBatch], sent=sent, arrow=arrow) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = batch.column(name).to_pylist()
                more = [f + sent.value.search(t) for f, t in zip(found, bytes_of(batch.column("text")), strict=True)]
                columns = [batch.column(c) for c in range(batch.num_columns - 1)]
                more = pa.array(more, type=arrow.field(name).type)
                yield pa.RecordBatch.from_arrays([*columns, more], schema=pa.schema(
                    [*(pa.field(f.name, c.type) for f, c in zip(arrow, columns, strict=False)), arrow.field(name)]
                ))

        out = out.mapInArrow(run, schema)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it holds: ``(doc_id, item_id, from_word, n_words, similarity)``."""
    found = search_benchmark(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The clean rows of ``docs``, all columns."""
    searched = search_benchmark(docs, benchmark)
    return searched.where(F.size(searched.columns[-1]) == 0).select(*docs.columns)
