"""Documents to fixed-length token sequences: first-fit decreasing in random groups.

* ``tokenized`` turns every whole text into token ids and an end id, once, as a written table. The full
  sequences inside a long document are cut off there: they need no packing and no exchange.
* What is left of each document, always shorter than a sequence, goes to a random group of about
  ``DOCS_PER_GROUP`` documents, so a group holds at most that many sequences of ids, whatever the texts.
* ``pack_group`` packs a group by first-fit decreasing. ``CapacityTree`` is a tournament over the free space
  of all bins: an inner node holds the larger one of its two children, so the first bin that fits is found
  on one path down. Then ``close_gaps`` cuts the pieces of the emptiest bins to size for the gaps of the
  others, and ``split_tail`` deals the one bin that stays open into sequences of a power of two.
* ``sequences`` joins the pieces to rows of ids.

Words are tokenized one at a time and remembered: the tokenizer's patterns never match across ASCII white
space, so a text's ids are those of its words one after the other (tests compare with whole texts).

Defined cases: a null or empty text is the end id alone; rows that repeat a ``doc_id``, or have none, are
documents of their own; ties in length go by row; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import arrow_schema, bytes_of, map_batches, record_batch
from scoreloom.staging import staged

SEQUENCE = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
DOCS_PER_GROUP = 1024
#: Smaller gaps are padded: a cut would leave only shreds.
LEAST_PIECE = 16
#: Words whose ids a worker remembers; the memory is emptied beyond that. Longer ones are not kept.
REMEMBERED, LONGEST_REMEMBERED = 800_000, 64
#: Below it, lower case is the same letter by letter wherever a word stands.
LATIN_END = "\u0250"
FLUSH_BYTES = 8 << 20
#: Ids of sequences packed in groups start here; full ones inside documents count up from their task's number.
PACKED = 1 << 62
SEQUENCES_PER_GROUP = 1 << 20

_normal = partial(unicodedata.is_normalized, "NFC")
TOKENS = "row long, doc_id long, doc_tokens long, first_sequence long, whole binary, rest binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def load_tokenizer(vocabulary: str = VOCABULARY):
    """A tokenizer file by its path, or one of the public ones by its name."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary if Path(vocabulary).is_absolute() else public_tokenizers.path(vocabulary))


def byte_letters() -> dict[int, str]:
    """The letter each byte is written as in byte-level vocabularies: itself if it can be seen, else one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordIds(dict):
    """Word (UTF-8) -> its token ids as little-endian numbers, remembered for a bounded number of words.

    A word of letters in normal form and lower case is one token run for the tokenizer's patterns, so its ids come
    from the tokenizer's model alone; any other word takes the whole way.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.letters = tokenizer, byte_letters()
        self.kind = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def __missing__(self, word: bytes) -> bytes:
        value = self._ids(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" not in text:  # else it may hold a special token, which is matched as written
            core = text.rstrip(".,;:!?")
            if core and core != text and core[-1].isalpha():  # marks behind a letter are tokens of their own
                return self[core.encode()] + self[text[len(core) :].encode()]
            lower = text.lower()
            if lower != text and max(text) < LATIN_END and (word.isascii() or lower.isalpha() and _normal(text)):
                return self[lower.encode()]
            if lower == text and text.isalpha() and _normal(text):
                letters = word.decode("latin-1").translate(self.letters)
                return np.array([t.id for t in self.tokenizer.model.tokenize(letters)], self.kind).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_words: dict[str, WordIds] = {}


def word_ids(vocabulary: str) -> WordIds:
    """One memory per worker process: the tasks it runs one after the other share it."""
    if vocabulary not in _words:
        _words[vocabulary] = WordIds(load_tokenizer(vocabulary))
    return _words[vocabulary]


def tokenized(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """The ids of every document, written once: full sequences, and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(vocabulary)
        end, width = np.array([end_id], words.kind).tobytes(), words.kind.itemsize
        schema = arrow_schema(TOKENS)
        row = sequence = TaskContext.get().partitionId() << 33
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text")), strict=True):
                ids = words.of(text or b"") + end
                n, cut = len(ids) // width, len(ids) - len(ids) % (size * width)
                out.append((row, doc_id, n, sequence, ids[:cut], ids[cut:]))
                row, sequence, held = row + 1, sequence + n // size, held + len(ids) + 64
                if held > FLUSH_BYTES:
                    yield record_batch(out, schema)
                    out, held = [], 0
        yield record_batch(out, schema)

    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS), "tokens")


class CapacityTree:
    """The free space of bins as a tournament: every inner node holds the larger one of its children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Put ``size`` into the first bin with room for it."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            node += free[node] < size
        found = node - self.leaves
        free[node] -= size
        while node > 1:
            node >>= 1
            free[node] = max(free[2 * node], free[2 * node + 1])
        return found


Piece = tuple[int, int, int]  # item, first token, tokens


def first_fit_decreasing(lengths: list[int], size: int) -> list[list[Piece]]:
    tree, bins = CapacityTree(len(lengths), size), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = tree.first_fit(lengths[item])
        if at == len(bins):
            bins.append([])
        bins[at].append((item, 0, lengths[item]))
    return bins


def close_gaps(bins: list[list[Piece]], size: int, least: int) -> list[list[Piece]]:
    """Pieces of the emptiest bins close the gaps of at least ``least`` tokens in the fullest ones."""
    load = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: (-load[b], b))
    low, high = 0, len(order) - 1
    while low < high:
        to, source = order[low], order[high]
        gap = size - load[to]
        if gap < least:
            low += 1
        elif not bins[source]:
            high -= 1
        else:
            item, start, n = bins[source].pop()
            taken = min(n, gap)
            bins[to].append((item, start, taken))
            if taken < n:
                bins[source].append((item, start + taken, n - taken))
            load[to] += taken
            load[source] -= taken
    return [b for b in bins if b]


def split_tail(pieces: list[Piece], size: int, least: int) -> list[list[Piece]]:
    """A bin with a gap of at least ``least`` as sequences of powers of two, the largest first."""
    total = sum(p[2] for p in pieces)
    if size - total < least:
        return [pieces]
    out, left = [], list(reversed(pieces))
    for power in reversed(range(total.bit_length())):
        room = total & (1 << power)
        if room:
            out.append([])
        while room:
            item, start, n = left.pop()
            taken = min(n, room)
            out[-1].append((item, start, taken))
            room -= taken
            if taken < n:
                left.append((item, start + taken, n - taken))
    return out


def pack_group(lengths: list[int], size: int = SEQUENCE, least: int = LEAST_PIECE) -> list[list[Piece]]:
    """Sequences of pieces that hold every token of every item once."""
    bins = close_gaps(first_fit_decreasing(lengths, size), size, least)
    return [s for b in bins for s in split_tail(b, size, least)]


def _whole_sequences(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(PIECES)
        out: list[tuple] = []
        for batch in batches:
            for doc_id, total, first, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(whole, _kind(len(whole), total // size * size)).astype("<u4")
                for k in range(0, len(ids), size):
                    out.append((doc_id, k, size, total, first + k // size, 0, ids[k : k + size].tobytes()))
                    if len(out) * size * 4 > FLUSH_BYTES:
                        yield record_batch(out, schema)
                        out = []
        yield record_batch(out, schema)

    return run


def _kind(size: int, n: int) -> str:
    return f"<u{size // n}"


def _packed(size: int, least: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        docs, totals, rests = (rows[c].to_pylist() for c in ("doc_id", "doc_tokens", "rest"))
        ids = [np.frombuffer(r, _kind(len(r), t % size)).astype("<u4") for r, t in zip(rests, totals, strict=True)]
        first, out = PACKED + key[0].as_py() * SEQUENCES_PER_GROUP, []
        for k, sequence in enumerate(pack_group([len(x) for x in ids], size, least)):
            at = 0
            for item, start, n in sequence:
                place = totals[item] - len(ids[item]) + start
                out.append((docs[item], place, n, totals[item], first + k, at, ids[item][start : start + n].tobytes()))
                at += n
        return pa.Table.from_batches([record_batch(out, arrow_schema(PIECES))])

    return run


def pack(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    size: int = SEQUENCE,
    docs_per_group: int = DOCS_PER_GROUP,
    least_piece: int = LEAST_PIECE,
) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``: where each lies in its document and in its sequence, and its ids.

    ``ids`` are little-endian unsigned 32-bit numbers. ``docs_per_group`` bounds the memory of a task: a group
    holds fewer than ``size`` tokens of each of its documents.
    """
    if docs_per_group * 2 > SEQUENCES_PER_GROUP:
        raise ValueError(f"at most {SEQUENCES_PER_GROUP // 2} documents a group")
    tokens = tokenized(docs, vocabulary, end_id, size)
    groups = max(1, math.ceil(tokens.count() / docs_per_group))
    full = tokens.where(F.octet_length("whole") > 0).select("doc_id", "doc_tokens", "first_sequence", "whole")
    rest = tokens.where(F.octet_length("rest") > 0).select(
        "row", "doc_id", "doc_tokens", "rest", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")
    )
    packed = rest.groupBy("group").applyInArrow(_packed(size, least_piece), PIECES)
    return full.mapInArrow(_whole_sequences(size), PIECES).unionByName(packed)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: ``(sequence_id, input_ids, piece_lengths)``; the lengths tell where documents change."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts")

    def joined(batch: pa.RecordBatch) -> dict:
        rows = batch.column("parts").to_pylist()
        ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").tolist() for parts in rows]
        return {
            "sequence_id": batch.column("sequence_id"),
            "input_ids": ids,
            "piece_lengths": [[p["length"] for p in parts] for parts in rows],
        }

    whole = pieces.groupBy("sequence_id").agg(parts)
    return map_batches(whole, joined, "sequence_id long, input_ids array<int>, piece_lengths array<long>")
