"""Ranked lexical search: every item of a query table against every document.

* ``restricted`` reads each whole text once and keeps the counts of the items' terms, as a written table; the
  numbers of documents and terms and the documents of each term are aggregates over it.
* Each task builds trees over blocks of documents. A document is the list of its terms from the most to the least
  frequent, so documents share paths from the root; a node keeps, for every term below it, the largest count, and
  the smallest length figure ``m`` of its documents. Both bound the score of any document below.
* Per item the tree is walked depth first, the more promising child first, and a subtree whose bound is below the
  item's last place so far is left out. The best documents of a task carry over from tree to tree.
* Of the tasks' best rows the best are taken in two steps, in salted groups and then per item.

Items are a stated query set: they are read in parts of about ``PART_TERMS`` terms, each part against all documents.

Scores are 64-bit integers: with ``N`` documents holding any term, ``L`` terms in all, ``n`` terms in a document and
``df`` documents holding a term, ``w = floor(1000 ln((2N + 2) / (2df + 1)))``, ``m = 75 + (25 n N) div L``, and an
item's score is the sum of ``w * ((10**9 tf) div (1000 tf + 12 m))`` over its terms, repeats included.

Defined cases: a null text has no term; items without a term, and documents that score 0, get no row; equal scores go
by ascending ``doc_id``, null ids last; rows that repeat an id are documents, or items, of their own; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import arrow_schema, bytes_of, record_batch
from scoreloom.staging import staged

TOP = 20
#: Terms of the items read at once: bounds what the driver holds and sends to the tasks.
PART_TERMS = 200_000
#: A tree holds documents x distinct terms up to this many counts, and so many documents.
CELLS, DOCS_PER_TREE = 3 << 20, 1024
SALTS = 32
NO_ID = 1 << 63

ITEM_TERMS = "item long, item_id long, term binary, times long"
VECTORS = "doc_id long, n long, terms array<int>, counts array<long>"
BEST = "item long, doc_id long, score long, salt int"

_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case."""
    return (text or b"").translate(_TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """``(item, item_id, term, times)``, written once; ``item`` tells rows with the same id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, item = arrow_schema(ITEM_TERMS), TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), bytes_of(batch.column("text")), strict=True):
                out += [(item, item_id, term, times) for term, times in Counter(terms_of(text)).items()]
                item += 1
            yield record_batch(out, schema)

    return staged(items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, ITEM_TERMS), "item-terms")


def restricted(docs: DataFrame, numbers) -> DataFrame:
    """The counts of some terms in every document that has a term at all, written once.

    ``numbers`` is a broadcast dictionary from the term to its number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema = numbers.value, arrow_schema(VECTORS)
        for batch in batches:
            ids, ns, ends, terms, counts = [], [], [0], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text")), strict=True):
                words = terms_of(text)
                if words:
                    held = Counter(filter(known.__contains__, words))
                    terms += [known[t] for t in held]
                    counts += held.values()
                    ids.append(doc_id)
                    ns.append(len(words))
                    ends.append(len(terms))
            lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, k)) for v, k in
                     ((terms, pa.int32()), (counts, pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], schema=schema)

    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, VECTORS), "vectors")


@dataclass(frozen=True)
class Queries:
    """What a task needs to search: terms are numbered from the most frequent on."""

    place: np.ndarray  # number of a term as written -> its place by frequency
    items: list[tuple[int, np.ndarray, np.ndarray]]  # item, its places in order, the weights there
    n_docs: int
    n_terms: int
    top: int

    def lengths(self, ns: list[int]) -> np.ndarray:
        return np.array([75 + 25 * n * self.n_docs // self.n_terms for n in ns], np.int64)


class Best:
    """The best documents of every item so far."""

    def __init__(self, top: int):
        self.top, self.heaps = top, {}

    def least(self, item: int) -> int:
        """A document below this score has no place."""
        heap = self.heaps.get(item, ())
        return heap[0][0] if len(heap) == self.top else 1

    def offer(self, item: int, score: int, doc_id: int) -> None:
        heap = self.heaps.setdefault(item, [])
        if len(heap) < self.top:
            heapq.heappush(heap, (score, -doc_id))
        else:
            heapq.heappushpop(heap, (score, -doc_id))


def impacts(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``(10**9 tf) div (1000 tf + 12 m)`` where a count is not 0."""
    out = np.zeros(counts.shape, np.int32)
    rows, columns = np.nonzero(counts)
    tf = counts[rows, columns].astype(np.int64)
    out[rows, columns] = 10**9 * tf // (1000 * tf + 12 * lengths[rows])
    return out


class DocumentTree:
    """Documents as paths of their terms, from the most frequent on; paths without a branch are one step.

    Inner nodes are numbered so that children come before their parent; the root is the last. ``kids[node]`` lists
    inner nodes, ``own[node]`` the documents that branch off there.
    """

    def __init__(self, doc_ids: list[int], lengths: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]]):
        keys = [places.astype(">u4").tobytes() for places, _ in vectors]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.doc_ids = [doc_ids[i] for i in order]
        self.columns = np.unique(np.concatenate([places for places, _ in vectors]))
        counts = np.zeros((len(order), len(self.columns)), np.int64)
        for row, i in enumerate(order):
            places, tfs = vectors[i]
            counts[row, np.searchsorted(self.columns, places)] = tfs
        lengths = lengths[order]
        self.kids, self.own = _branches([vectors[i][0] for i in order])
        most = np.empty((len(self.kids), len(self.columns)), np.int64)
        least = np.empty(len(self.kids), np.int64)
        for node, (kids, own) in enumerate(zip(self.kids, self.own, strict=True)):
            parts = [p for p in (most[kids], counts[own]) if len(p)]
            most[node] = np.concatenate(parts).max(axis=0)
            least[node] = min(np.concatenate([least[kids], lengths[own]]))
        self.exact, self.bounds = impacts(counts, lengths), impacts(most, least)

    def search(self, item: int, places: np.ndarray, weights: np.ndarray, best: Best) -> None:
        at = np.searchsorted(self.columns, places)
        here = at < len(self.columns)
        here[here] = self.columns[at[here]] == places[here]
        if not here.any():
            return
        at, weights = at[here], weights[here]
        bound = (self.bounds[:, at].astype(np.int64) @ weights).tolist()
        stack, least = [len(self.kids) - 1], best.least(item)
        while stack:
            node = stack.pop()
            if bound[node] < least:
                continue
            own = self.own[node]
            if own:
                scores = self.exact[np.ix_(own, at)].astype(np.int64) @ weights
                for k in np.flatnonzero(scores >= least):
                    best.offer(item, int(scores[k]), self.doc_ids[own[k]])
                least = best.least(item)
            stack += sorted((k for k in self.kids[node] if bound[k] >= least), key=bound.__getitem__)


def _branches(paths: list[np.ndarray]) -> tuple[list[list[int]], list[list[int]]]:
    """The branching nodes of sorted paths: inner children and documents of each, children first."""
    kids: list[list[int]] = []
    own: list[list[int]] = []
    open_nodes: list[tuple[int, list[int], list[int]]] = [(0, [], [])]  # depth, inner children, documents

    def put(node: tuple[int, list[int], list[int]], child: int) -> None:
        (node[2] if child < 0 else node[1]).append(~child if child < 0 else child)

    def close(child: int) -> int:
        node = open_nodes.pop()
        put(node, child)
        kids.append(node[1])
        own.append(node[2])
        return len(kids) - 1

    last = ~0  # a document is written as the complement of its number
    for k in range(1, len(paths)):
        shared = _shared(paths[k - 1], paths[k])
        while open_nodes[-1][0] > shared:
            last = close(last)
        if open_nodes[-1][0] < shared:
            open_nodes.append((shared, [], []))
        put(open_nodes[-1], last)
        last = ~k
    while open_nodes:
        last = close(last)
    return kids, own


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    different = np.flatnonzero(a[:n] != b[:n])
    return int(different[0]) if len(different) else n


def _search(queries):
    """The best documents of every item among those a task reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        best = Best(q.top)
        ids: list[int] = []
        ns: list[int] = []
        vectors: list[tuple[np.ndarray, np.ndarray]] = []
        distinct: set[int] = set()

        def searched() -> None:
            if ids:
                tree = DocumentTree(ids, q.lengths(ns), vectors)
                for item, places, weights in q.items:
                    tree.search(item, places, weights, best)
            for held in (ids, ns, vectors, distinct):
                held.clear()

        for batch in batches:
            lists = batch.column("terms")
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            counts = batch.column("counts").values.to_numpy()
            heads = zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), offsets[:-1], offsets[1:], strict=True)
            for doc_id, n, low, high in heads:
                if low == high:
                    continue
                places = q.place[values[low:high]]
                order = np.argsort(places)
                places = places[order]
                new = distinct.union(places.tolist())
                if ids and (len(ids) >= DOCS_PER_TREE or (len(ids) + 1) * len(new) > CELLS):
                    searched()
                    new = set(places.tolist())
                distinct |= new
                ids.append(NO_ID if doc_id is None else doc_id)
                ns.append(n)
                vectors.append((places, counts[low:high][order]))
        searched()
        salt = TaskContext.get().partitionId() % SALTS
        rows = [
            (item, None if -minus == NO_ID else -minus, score, salt)
            for item, heap in best.heaps.items() for score, minus in heap
        ]
        yield record_batch(rows, arrow_schema(BEST))

    return run


def _part(docs: DataFrame, held: list, top: int) -> DataFrame | None:
    """The best documents of the items whose ``(item, term, times)`` rows are given; None without documents."""
    context = docs.sparkSession.sparkContext
    numbers = {term: k for k, term in enumerate(sorted({bytes(r["term"]) for r in held}))}
    vectors = restricted(docs, context.broadcast(numbers))
    size = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not size["docs"]:
        return None
    found = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("docs"))
    df = np.zeros(len(numbers), np.int64)
    for row in found.collect():  # one row per term of this part
        df[row["term"]] = row["docs"]
    place = np.empty(len(numbers), np.int64)
    place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weight = [math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * d + 1))) for d in df.tolist()]
    by_item: dict[int, list[tuple[int, int]]] = {}
    for r in held:
        k = numbers[bytes(r["term"])]
        by_item.setdefault(r["item"], []).append((int(place[k]), r["times"] * weight[k]))
    items = []
    for item, pairs in by_item.items():
        places, weights = zip(*sorted(pairs), strict=True)
        items.append((item, np.array(places, np.int64), np.array(weights, np.int64)))
    queries = Queries(place, items, size["docs"], size["terms"], top)
    return vectors.mapInArrow(_search(context.broadcast(queries)), BEST)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, part_terms: int = PART_TERMS) -> DataFrame:
    """``(item, item_id, rank, doc_id, score)``: the ``top`` documents of every item of ``items(item_id, text)``."""
    terms = item_terms(items)
    names = terms.select("item", "item_id").distinct()
    parts = -(-terms.count() // part_terms)
    found = terms.sparkSession.createDataFrame([], BEST)
    for part in range(parts):
        own = terms.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
        rows = own.select("item", "term", "times").collect()  # about part_terms rows
        best = _part(docs, rows, top) if rows else None
        if best is not None:
            found = found.unionByName(best)
    for keys in (["item", "salt"], ["item"]):
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.join(names, "item").select("item", "item_id", "rank", "doc_id", "score")
