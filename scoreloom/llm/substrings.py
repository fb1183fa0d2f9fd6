"""Repeated passages found with an FM-index per shard.

A word goes when a window of ``LENGTH`` consecutive words covers it whose words also start in a
document with a smaller id. Windows are judged on the input.

*Shards by content.* Every window is sent where its least 3-gram hash (its minimizer) leads, so
equal windows meet, and consecutive windows with one minimizer travel as one segment. The
work is in proportion to the text, where documents against every shard would be quadratic.
3-grams that are frequent in a bounded sample are avoided as minimizers; the list steers only
the way, and all windows are matched whatever it holds. Segments that a task reads twice
leave it once, for the smallest document; the other documents' words are marked at once.

*Index.* A shard sorts the suffixes of its segments (by 16 words, which decides 13), keeps their
Burrows-Wheeler transform in a wavelet matrix of bit planes, and streams its documents through
backward search: a window's interval of suffixes shrinks word by word and is left when only the
window itself remains. What is left after 13 words are the matches at or above the
threshold; the intervals of different windows do not overlap, so one pass over the sorted
suffixes gives each its smallest document. Segments whose minimizer no other document of the
shard has cannot match and are not indexed.

Defined cases: a null text has no words; a text of fewer than 13 words keeps all; a null
``doc_id`` counts as larger than any other; rows that repeat a ``doc_id`` do not remove each
other's words; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import among, bytes_of, gram_hashes, map_batches, mix, pack, text_words, unpack

LENGTH, GRAM = 13, 3
#: Words whose interval the index keeps for every place.
HEAD = 4
#: Bytes of text one shard stands for, and that a task cuts at once.
SHARD_BYTES, CUT_BYTES = 6 << 20, 4 << 20
#: Frequent 3-grams: in one of ``FREQUENT`` documents of a sample of ``SAMPLE``, at most ``LISTED``.
SAMPLE, FREQUENT, LISTED = 2_000, 200, 50_000
NO_ID = np.iinfo(np.int64).max
PACK = "shard long, decided boolean, docs binary, keys binary, starts binary, words binary, least binary, sizes binary, text binary"
MARKS = "doc_id long, text_key long, starts array<int>, ends array<int>"


#: The bits below each place of a cell.
_BELOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)


class WaveletMatrix:
    """Occurrence counts of symbols in prefixes of a sequence, from one bit plane per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.planes, self.counts, self.zeros = [], [], []
        first = np.zeros(alphabet, np.int32)
        every = np.arange(alphabet, dtype=np.int32)
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level) & 1 == 1
            packed = np.packbits(bits, bitorder="little")
            plane = np.zeros(len(bits) // 64 + 1, np.uint64)
            plane.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(plane), np.int32)
            np.cumsum(np.bitwise_count(plane[:-1]), out=counts[1:])
            self.planes.append(plane)
            self.counts.append(counts)
            self.zeros.append(int(len(bits) - bits.sum()))
            first = self._down(len(self.planes) - 1, first, (every >> level) & 1 == 1)
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.first = first

    def _down(self, k: int, at: np.ndarray, ones: np.ndarray) -> np.ndarray:
        cell = at >> 6
        rank = self.counts[k][cell] + np.bitwise_count(self.planes[k][cell] & _BELOW[at & 63])
        return np.where(ones, np.int32(self.zeros[k]) + rank, at - rank)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at``, for arrays of both."""
        for k in range(self.levels):
            at = self._down(k, at, (symbol >> (self.levels - 1 - k)) & 1 == 1)
        return at - self.first[symbol]


def suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix positions sorted by their first 16 symbols, and the interval of each position's first ``HEAD`` symbols.

    Only suffixes that still tie are sorted again.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    width = 1
    values = text[order]
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    low = high = None
    while width < 16:
        sizes = np.diff(np.append(heads, n))
        if width == HEAD:
            low, high = rank.astype(np.int32), np.empty(n, np.int32)
            high[order] = np.repeat(heads + sizes, sizes)
        tied = np.repeat(sizes > 1, sizes)
        places = np.flatnonzero(tied)
        if not len(places):
            break
        some = order[places]
        after = some + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[some] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        order[places] = some[by]
        key = key[by]
        start = np.zeros(n, bool)
        start[heads] = True
        start[places[1:]] |= key[1:] != key[:-1]
        heads = np.flatnonzero(start)
        rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
        width *= 2
    if low is None:  # no two suffixes share ``HEAD`` symbols
        low, high = rank.astype(np.int32), rank.astype(np.int32) + 1
    return order, low, high


class Index:
    """FM-index of a sequence of symbols (0 separates segments)."""

    def __init__(self, text: np.ndarray, alphabet: int):
        self.text = text.astype(np.int32)
        self.order, self.low, self.high = suffixes(text)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))]).astype(np.int32)
        self.matrix = WaveletMatrix(self.text[self.order - 1], alphabet)

    def search(self, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows (their starts) that occur more than once, with their intervals of suffixes.

        The search begins with the interval of the last ``HEAD`` symbols, known from the sorting.
        """
        last = windows + length - HEAD
        low, high = self.low[last], self.high[last]
        for step in range(length - HEAD - 1, -1, -1):
            going = high - low > 1
            windows, low, high = windows[going], low[going], high[going]
            symbol = self.text[windows + step]
            both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.starts[symbol] + both[: len(low)], self.starts[symbol] + both[len(low) :]
        going = high - low > 1
        return windows[going], low[going], high[going]


def _minimizers(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The least 3-gram hash of each window; frequent 3-grams come after all others."""
    grams = gram_hashes(hashes, GRAM)
    least = np.where(among(grams, frequent), grams | np.uint64(1 << 63), grams & np.uint64((1 << 63) - 1))
    width, reach = LENGTH - GRAM + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least


def _segments(hashes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run with one minimizer, and the minimizer."""
    least = _minimizers(hashes, frequent)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return starts, np.append(starts[1:], len(least)) - 1, least[starts]


def _document(doc: int, key: int, text: bytes, frequent: np.ndarray) -> dict[str, np.ndarray] | None:
    """The segments of one document; ``begin`` and ``end`` are bytes of its text."""
    hashes, begins, ends = text_words(text)
    if len(hashes) < LENGTH:
        return None
    starts, lasts, least = _segments(hashes, frequent)
    windows = np.concatenate([[np.uint64(0)], np.cumsum(gram_hashes(hashes, LENGTH))])
    return {
        "docs": np.full(len(starts), doc), "keys": np.full(len(starts), key), "starts": starts, "words": lasts - starts + LENGTH,
        "least": least, "begin": begins[starts], "end": ends[lasts + LENGTH - 1],
        "same": mix(windows[lasts + 1] - windows[starts] + (lasts - starts).astype(np.uint64)),
    }


def _row(shard: int, decided: bool, segments: dict[str, np.ndarray], at: np.ndarray, text: bytes) -> tuple:
    packed = (pack(segments[c][at]) for c in ("keys", "starts", "words", "least", "sizes"))
    return (shard, decided, pack(segments["docs"][at], True), *packed, text)


def _cut(docs: list[int], keys: list[int], texts: list[bytes], shards: int, frequent: np.ndarray) -> list[tuple]:
    """The segments of some documents by shard, and what these documents decide among themselves."""
    found, joined, total = [], [], 0
    for doc, key, text in sorted(zip(docs, keys, texts, strict=True), key=lambda x: x[0]):
        segments = _document(doc, key, text, frequent)
        if segments:
            segments["begin"], segments["end"] = segments["begin"] + total, segments["end"] + total
            found.append(segments)
            joined.append(text)
            total += len(text)
    if not found:
        return []
    cut = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
    everything = b"".join(joined)
    begin, end = cut["begin"].tolist(), cut["end"].tolist()
    # documents are in order, so the first of equal segments is the smallest document's
    _, first, back = np.unique(cut["same"], return_index=True, return_inverse=True)
    decided = cut["docs"] > cut["docs"][first[back]]
    for i in np.flatnonzero(decided).tolist():
        k = first[back[i]]
        decided[i] = everything[begin[i] : end[i]] == everything[begin[k] : end[k]]
    cut["sizes"] = cut["end"] - cut["begin"]
    shard = (cut["least"] % np.uint64(1_000_003) % np.uint64(shards)).astype(np.int64)
    # within a shard these bits tell minimizers apart; two that share them only keep more segments
    cut["least"] = cut["least"] >> np.uint64(8) & np.uint64(0xFFFFFF)
    order = np.flatnonzero(~decided)
    order = order[np.argsort(shard[order], kind="stable")]
    heads = np.flatnonzero(np.diff(shard[order], prepend=-1))
    squeeze, rows = zstandard.ZstdCompressor(level=3), []
    for at in np.split(order, heads[1:]):
        text = b"".join([everything[begin[i] : end[i]] for i in at.tolist()])
        rows.append(_row(int(shard[at[0]]), False, cut, at, squeeze.compress(text)))
    at = np.flatnonzero(decided)
    if len(at):
        # decided words need no shard; they travel with any
        rows.append(_row(int(cut["same"][at[0]] % np.uint64(shards)), True, cut, at, b""))
    return rows


def _marked(docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    """A row per document with the ranges of words that go."""
    if not len(docs):
        return pd.DataFrame({"doc_id": [], "text_key": [], "starts": [], "ends": []})
    by = np.lexsort((starts, keys, docs))
    docs, keys, starts, ends = docs[by], keys[by], starts[by], ends[by]
    heads = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])]))
    cuts = heads[1:]
    return pd.DataFrame({
        "doc_id": docs[heads], "text_key": keys[heads],
        "starts": np.split(starts.astype(np.int32), cuts), "ends": np.split(ends.astype(np.int32), cuts),
    })


def _joined(column: pd.Series, deltas: bool = False) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(unpack(x, deltas).view(np.int64) for x in column)])


def match_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Index one shard, stream its windows, and mark those that a smaller document holds."""
    decided, rows = rows[rows["decided"]], rows[~rows["decided"]]
    s = _joined(decided["starts"])
    parts = [(_joined(decided["docs"], True), _joined(decided["keys"]), s, s + _joined(decided["words"]))]
    if len(rows):
        segments = {c: _joined(rows[c], c == "docs") for c in ("docs", "keys", "starts", "words", "least", "sizes")}
        docs, least = segments["docs"], segments["least"]
        by = np.argsort(least, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(least[by]) != 0]))
        several = np.minimum.reduceat(docs[by], heads) != np.maximum.reduceat(docs[by], heads)
        keep = np.zeros(len(docs), bool)
        keep[by] = np.repeat(several, np.diff(np.append(heads, len(by))))
        if keep.any():
            text = b"".join(map(zstandard.ZstdDecompressor().decompress, rows["text"]))
            end = np.cumsum(segments["sizes"])[keep]
            begin = end - segments["sizes"][keep]
            text = b" ".join([text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            parts.append(_matched(text, *(segments[c][keep] for c in ("docs", "keys", "starts", "words"))))
    return _marked(*(np.concatenate([p[k] for p in parts]) for k in range(4)))


def _matched(text: bytes, docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word ranges of segments that a smaller document holds; ``text`` is all their words."""
    words = text.split()
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words), 1)}
    owner = np.repeat(np.arange(len(docs)), counts)
    symbols = np.zeros(len(words) + len(docs) + 1, np.int64)
    symbols[np.arange(len(words)) + owner + 1] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    del words
    offsets = 1 + np.concatenate([[0], np.cumsum(counts + 1)[:-1]])
    owner = np.concatenate([[0], np.repeat(np.arange(len(docs)), counts + 1)])
    index = Index(symbols, len(numbers) + 1)
    n_windows = counts - LENGTH + 1
    first = np.repeat(offsets - np.concatenate([[0], np.cumsum(n_windows)[:-1]]), n_windows)
    windows, low, high = index.search(first + np.arange(len(first)), LENGTH)
    if len(windows):
        of_suffix = np.append(docs[owner[index.order]], NO_ID)
        places, back = np.unique(low, return_inverse=True)
        bounds = np.empty(2 * len(places), np.int64)
        bounds[0::2] = places
        bounds[1::2][back] = high
        smallest = np.minimum.reduceat(of_suffix, bounds)[0::2][back]
        windows = np.sort(windows[smallest < docs[owner[windows]]])
    own = owner[windows]
    at = np.flatnonzero((np.diff(windows, prepend=-2) != 1) | (np.diff(own, prepend=-1) != 0))
    runs = np.diff(np.append(at, len(windows)))
    own, begin = own[at], windows[at]
    begin = starts[own] + begin - offsets[own]
    return docs[own], keys[own], begin, begin + runs + LENGTH - 1


def _distinct_grams(batch: pa.RecordBatch) -> dict:
    grams = [np.unique(gram_hashes(text_words(t)[0], GRAM)) for t in bytes_of(batch.column("text"))]
    return {"gram": np.concatenate([*grams, np.empty(0, np.uint64)]).view(np.int64)}


def _frequent(rows: DataFrame, n_rows: int) -> np.ndarray:
    """The grams that many documents of a sample of about ``SAMPLE`` hold."""
    share = min(1.0, SAMPLE / max(n_rows, 1))
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 40))
    grams = map_batches(rows.where(place < int(share * (1 << 40))).select("text"), _distinct_grams, "gram long")
    often = grams.groupBy("gram").count().where(F.col("count") * FREQUENT >= max(share * n_rows, 2 * FREQUENT))
    values = [r["gram"] for r in often.orderBy(F.desc("count"), "gram").limit(LISTED).collect()]
    return np.sort(np.array(values, np.int64).view(np.uint64))


def repeated_passages(docs: DataFrame, text_key: Column) -> DataFrame:
    """``(doc_id, text_key, starts, ends)``: word ranges that go, per row of ``docs(doc_id, text)`` that has some.

    ``text_key`` tells rows of one id apart.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), text_key.alias("text_key"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    size, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    shards = size // SHARD_BYTES + 1
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(rows, n_rows))
    names = [c.split()[0] for c in PACK.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in PACK.split(", ")]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), bytes_of(batch.column(2))
            at = 0
            while at < len(ids):
                end, total = at, 0
                while end < len(ids) and total < CUT_BYTES:
                    total += len(texts[end])
                    end += 1
                packs = _cut(ids[at:end], keys[at:end], texts[at:end], shards, frequent.value)
                at = end
                if packs:
                    columns = zip(*packs, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    packs = rows.mapInArrow(cut, PACK)
    return packs.groupBy("shard").applyInPandas(match_shard, MARKS)


def _kept(batch: pa.RecordBatch) -> dict:
    n_words, n_removed, out = [], [], []
    marks = zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)
    for text, (starts, ends) in zip(bytes_of(batch.column("text")), marks, strict=True):
        words = kept = (text or b"").split()
        if starts:
            step = np.zeros(len(words) + 1, np.int32)
            np.add.at(step, starts, 1)
            np.add.at(step, ends, -1)
            kept = [w for w, n in zip(words, np.cumsum(step[:-1]).tolist(), strict=True) if n == 0]
        n_words.append(len(words))
        n_removed.append(len(words) - len(kept))
        out.append(b" ".join(kept))
    kept = pa.array(out, pa.binary()).cast(pa.string())
    return {"doc_id": batch.column("doc_id"), "n_words": n_words, "n_removed": n_removed, "kept": kept}


def remove_repeated(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``(doc_id, n_words, n_removed, kept)``."""
    # rows are told apart by their text only where ids repeat: a constant travels for nothing
    repeats = docs.groupBy("doc_id").count().where("count > 1")
    text_key = F.lit(0).cast("long") if repeats.isEmpty() else F.abs(F.xxhash64("text"))
    marks = repeated_passages(docs, text_key).groupBy("doc_id", "text_key").agg(
        F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")
    )
    marks = marks.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "starts", "ends")
    rows = docs.select(F.col("doc_id").cast("long"), "text", text_key.alias("text_key"))
    same = (F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("id")) & (F.col("text_key") == F.col("key"))
    joined = rows.join(marks, same, "left").select("doc_id", "text", "starts", "ends")
    return map_batches(joined, _kept, "doc_id long, n_words long, n_removed long, kept string")
