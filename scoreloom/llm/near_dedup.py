"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

A document is the set of its distinct 5-word shingles (A-Z lower-cased); two documents
are linked when ``100 * |both| >= 75 * |either|``, counted on the full sets.

1. *Signatures.* Every shingle draws one random rank per round and one place of a random
   permutation of the slots; a slot keeps its least value. Values of later rounds are
   larger, so a document ends as soon as all its slots are filled: about two rounds for
   500 shingles in place of one per slot.
2. *Classes.* Documents with equal sets become one class with a number of its own; a row with its smallest id
   lends the text. Ids only name the groups at the end, so rows that repeat an id never stand for each other.
3. *Bands.* 42 bands of 3 slots: a pair at similarity 0.75 misses all with a chance of
   1e-10. Buckets keep their smallest and largest class.
4. *First links.* Every class is verified against the extreme it shares most bands with.
   That joins most of a group, whatever its size, with two pairs per class.
5. *Remaining links.* A class outside the largest component of one of its buckets joins that
   component's group. It meets the classes of the group in tiles of bounded size: pairs whose
   signatures agree in at least ``FLOOR`` of the slots (five deviations below 0.75) are compared on
   the full sets. A pair within one component could not change the result and is skipped.
6. *Groups.* Union-find within partitions, then stars across them.

Defined cases: no words or a null text is the empty set, linked with nothing; fewer than
five words are one shingle; a null ``doc_id`` belongs to no group and stays; rows that
repeat a ``doc_id`` are judged by their own text, so two groups may bear one id; of a group's
rows with its smallest id, ``near_duplicates`` keeps all and ``drop_near_duplicates`` those with
one of the texts; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import GOLDEN, ODD, WordHashes, bytes_of, map_batches, mix, shingle_set
from scoreloom.llm.components import components
from scoreloom.staging import staged

WORDS, PERCENT = 5, 75
BANDS, ROWS = 42, 3
SLOTS = BANDS * ROWS
FLOOR = 0.55
TILE = 256
SALTS = 32
#: Shingles signed at once.
CHUNK = 400_000
_EMPTY = np.uint64(2**64 - 1)
_hashes = WordHashes()


def superminhash(values: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n, slots) of ``n`` sets; element ``values[i]`` belongs to set ``owner[i]``.

    A value is ``round << 56 | rank``. The slot of an element in round ``j`` is the ``j``-th
    entry of its own shuffle of the slots, found by undoing the swaps of earlier rounds.
    """
    signature = np.full(n * slots, _EMPTY, np.uint64)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        draw = mix(values + np.uint64((int(GOLDEN) * (j + 1)) % 2**64))
        other = (j + mix(draw ^ ODD) % np.uint64(slots - j)).astype(np.int64)
        slot = other.copy()
        for i in range(j - 1, -1, -1):
            slot[slot == swaps[i]] = i
        np.minimum.at(signature, owner * slots + slot, (np.uint64(j) << np.uint64(56)) | (draw >> np.uint64(8)))
        open_sets = (signature.reshape(n, slots) == _EMPTY).any(axis=1)
        going = open_sets[owner]
        if not going.any():
            break
        swaps.append(other)
        if not going.all():
            values, owner, swaps = values[going], owner[going], [s[going] for s in swaps]
    return signature.reshape(n, slots)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, rows.shape[:2])
    for r in range(ROWS):
        key = mix(key * ODD + rows[:, :, r])
    return key.view(np.int64)


def text_set(text: bytes | None) -> np.ndarray:
    return shingle_set(_hashes.of((text or b"").lower().split()), WORDS)


def set_digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _signed(batch: pa.RecordBatch) -> dict:
    texts = bytes_of(batch.column("text"))
    sets = [text_set(t) for t in texts]
    bands: list = [None] * len(sets)
    sketches: list = [None] * len(sets)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= CHUNK):
            total += len(sets[end])
            end += 1
        some = [k for k in range(at, end) if len(sets[k])]
        if some:
            owner = np.repeat(np.arange(len(some)), [len(sets[k]) for k in some])
            signature = superminhash(np.concatenate([sets[k] for k in some]), owner, len(some))
            keys, small = band_keys(signature), mix(signature).astype(np.uint8)
            for i, k in enumerate(some):
                bands[k], sketches[k] = keys[i], small[i].tobytes()
        at = end
    return {
        "doc_id": batch.column("doc_id"),
        "raw": batch.column("raw"),
        "n_shingles": [len(s) for s in sets],
        "set_id": [set_digest(s) for s in sets],
        "bands": bands,
        "sketch": sketches,
    }


def signatures(docs: DataFrame) -> DataFrame:
    """``(doc_id, raw, n_shingles, set_id, bands, sketch)`` per row of ``docs(doc_id, text)``; ``raw`` is the text's hash."""
    schema = "doc_id long, raw long, n_shingles long, set_id binary, bands array<long>, sketch binary"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("raw")), _signed, schema)


class _Sets(OrderedDict):
    """The shingle sets used last."""

    def of(self, key: int, text: bytes) -> np.ndarray:
        if key not in self:
            if len(self) >= 256:
                self.popitem(last=False)
            self[key] = text_set(text)
        self.move_to_end(key)
        return self[key]


def similar(s: np.ndarray, t: np.ndarray) -> bool:
    if 100 * min(len(s), len(t)) < PERCENT * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= PERCENT * (len(s) + len(t) - both)


def _linked(batch: pa.RecordBatch) -> dict:
    a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
    sets, keep = _Sets(), []
    for i, (x, y, s, t) in enumerate(zip(a, b, bytes_of(batch.column("text_a")), bytes_of(batch.column("text_b")), strict=True)):
        s, t = sets.of(x, s), sets.of(y, t)
        if similar(s, t):
            keep.append(i)
    return {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose full shingle sets are similar enough."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), _linked, "a long, b long")


class _Tile:
    """A bounded part of a group: classes outside its component, and classes they have to meet."""

    def __init__(self):
        self.few: list[tuple] = []
        self.others: list[tuple] = []

    def links(self) -> list[tuple[int, int]]:
        """Verified links; members are ``(rep, comp, outside, sketch, text)``. Components that joined here meet no more."""
        if not self.few or not self.others:
            return []
        sketches = np.frombuffer(b"".join([m[3] for m in self.others]), np.uint8).reshape(-1, SLOTS)
        ids, comps, outside = (np.array([m[k] for m in self.others]) for k in range(3))
        sets: dict[int, np.ndarray] = {}
        out = []
        for rep, comp, _, sketch, text in self.few:
            equal = (sketches == np.frombuffer(sketch, np.uint8)).sum(axis=1)
            joined = {comp}
            # two members outside the group's component meet twice, once as each side
            near = np.flatnonzero((equal >= FLOOR * SLOTS) & (comps != comp) & (~outside | (ids > rep)))
            for i in near[np.argsort(-equal[near], kind="stable")].tolist():
                if comps[i] in joined:
                    continue
                for key, t in ((rep, text), (int(ids[i]), self.others[i][4])):
                    if key not in sets:
                        sets[key] = text_set(t)
                if similar(sets[rep], sets[int(ids[i])]):
                    joined.add(comps[i])
                    out.append((min(rep, int(ids[i])), max(rep, int(ids[i]))))
        return out


def _tile_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of the tiles of a partition, whose rows come sorted by tile."""
    at, tile = None, _Tile()
    for batch in batches:
        out = []
        columns = [bytes_of(c) if c.type == pa.string() else c.to_pylist() for c in batch.columns]
        for main, s, m, straggler, *member in zip(*columns, strict=True):
            if (main, s, m) != at:
                out += tile.links()
                at, tile = (main, s, m), _Tile()
            (tile.few if straggler else tile.others).append(member)
        yield _link_batch(out)
    yield _link_batch(tile.links())


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = zip(*links, strict=True) if links else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def _salted(classes: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Join ``classes`` to the one row of each key in ``facts``, the classes of a key spread over ``SALTS`` tasks."""
    spread = classes.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return spread.join(copies, [key, "salt"]).drop("salt")


def remaining_links(members: DataFrame, labels: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(a, b)`` across the components that share buckets.

    A class outside the largest component of one of its buckets joins that component's group.
    Two classes of different components in one bucket are then in one group: either one is of
    the largest component, or both joined its group. Each class is in a group once, not per band.
    """
    known = labels.withColumnsRenamed({"node": "rep", "root": "comp"})
    rows = members.join(known, "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        sizes.groupBy("key")
        .agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps"))
        .where("comps > 1")
    )
    joined = staged(rows.join(mixed, "key").where("comp <> main").select("main", "rep", "comp").distinct(), "stragglers")
    few = joined.groupBy("main").agg(F.count(F.lit(1)).alias("few"))
    crowd = rows.select("rep", "comp").distinct()
    crowd = crowd.withColumn("main", F.col("comp"))
    own = _salted(crowd, few, "main").select("main", "rep", "comp", F.lit(False).alias("outside"))
    everyone = own.unionByName(joined.withColumn("outside", F.lit(True)))
    groups = everyone.groupBy("main").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("outside").cast("long")).alias("few"))
    everyone = _salted(everyone, groups, "main")
    across, down = F.ceil(F.col("all") / TILE).cast("long"), F.ceil(F.col("few") / TILE).cast("long")
    place = F.xxhash64("rep")
    once = everyone.select(
        "*", F.lit(False).alias("straggler"), F.pmod(place, across).alias("m"), F.explode(F.sequence(F.lit(0), down - 1)).alias("s")
    )
    again = everyone.where("outside").select(
        "*", F.lit(True).alias("straggler"), F.explode(F.sequence(F.lit(0), across - 1)).alias("m"), F.pmod(place, down).alias("s")
    )
    columns = ["main", "s", "m", "straggler", "rep", "comp", "outside"]
    dealt = once.select(*columns).unionByName(again.select(*columns))
    known = signed.select("rep", "sketch").join(texts.select(F.col("id").alias("rep"), "text"), "rep")
    dealt = dealt.join(known, "rep").select(*columns, "sketch", "text")
    tiles = dealt.repartition("main", "s", "m").sortWithinPartitions("main", "s", "m")
    return tiles.mapInArrow(_tile_links, "a long, b long")


def _judged(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``(doc_id, raw, n_shingles, root, component_id, kept)``; ``root`` numbers the group."""
    signed = staged(signatures(docs), "signatures")
    named = signed.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("set_id").agg(F.min("doc_id").alias("least"))
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    own = (named["set_id"] == classes["set_id"]) & (named["doc_id"] == classes["least"])
    reps = named.join(classes, own).select("rep", "least", "raw", "bands", "sketch").dropDuplicates(["rep"])
    banded = reps.select("rep", F.explode("bands").alias("key"))
    ends = banded.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    members = staged(banded.join(ends, "key"), "bucket-members")

    crowded = members.select("rep").distinct()
    signed_reps = reps.join(crowded, "rep", "left_semi")
    texts = staged(_texts(docs, signed_reps), "candidate-texts")
    if not texts.groupBy("id").count().where("count > 1").isEmpty():  # equal rows with one id
        texts = staged(texts.dropDuplicates(["id"]), "candidate-texts")

    to_end = members.where("rep > lo").groupBy("rep", F.col("lo").alias("end")).agg(F.count(F.lit(1)).alias("n"))
    to_end = to_end.withColumn("low", F.lit(True)).unionByName(
        members.where("rep < hi").groupBy("rep", F.col("hi").alias("end")).agg(F.count(F.lit(1)).alias("n")).withColumn("low", F.lit(False))
    )
    best = to_end.groupBy("rep", "low").agg(F.max(F.struct("n", "end"))["end"].alias("end"))
    pairs = best.select(F.least("rep", "end").alias("a"), F.greatest("rep", "end").alias("b")).distinct()
    first = staged(verified(pairs, texts), "first-links")

    more = remaining_links(members, components(first), signed_reps, texts)
    roots = components(first.union(staged(more, "more-links"))).withColumnRenamed("node", "rep")
    roots = roots.union(roots.select("root", "root").distinct())
    ids = roots.join(classes, "rep").groupBy("root").agg(F.min("least").alias("label"))
    known = classes.join(roots.join(ids, "root"), "rep", "left").select(
        "set_id", F.coalesce("root", "rep").alias("root"), F.coalesce("label", "least").alias("label")
    )
    rows = signed.select("doc_id", "raw", "n_shingles", "set_id").join(known, "set_id", "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return rows.select("doc_id", "raw", "n_shingles", "root", group.alias("component_id")).withColumn("kept", kept)


def _texts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``(id, text)``: a text of each class."""
    rows = docs.select(F.col("doc_id").cast("long").alias("least"), F.xxhash64("text").alias("raw"), "text")
    return rows.join(reps.select(F.col("rep").alias("id"), "least", "raw"), ["least", "raw"]).select("id", "text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``(doc_id, n_shingles, component_id, kept)``."""
    return _judged(docs).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one text of each group, with the group's smallest id."""
    judged = staged(_judged(docs), "judged")
    firsts = judged.where("kept AND root IS NOT NULL AND doc_id IS NOT NULL").groupBy("root")
    several = firsts.agg(F.min("raw").alias("first"), F.max("raw").alias("last")).where("first < last")
    others = judged.where("kept AND doc_id IS NOT NULL").join(several, "root").where("raw <> first")
    gone = judged.where("NOT kept").select("doc_id", "raw").union(others.select("doc_id", "raw")).distinct()
    gone = gone.withColumnsRenamed({"doc_id": "gone_id", "raw": "gone_raw"})
    same = (docs["doc_id"] == F.col("gone_id")) & (F.xxhash64(docs["text"]) == F.col("gone_raw"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)
