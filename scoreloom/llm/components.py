"""Connected components of a table of links, with nothing gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.staging import staged


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: each node with the smallest node it reaches there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(root, part), pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links(a, b)`` that is not itself the smallest of its component.

    Each partition first contracts its own links by union-find, then rounds of large and
    small stars (every node hands its neighbours to the smallest of them) join the
    partitions' forests; the number of rounds grows with the logarithm of the longest path.
    Each round is written to the shared folder, so a lost executor costs no earlier round.
    """
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = staged(edges.mapInArrow(_forests, "u long, v long"), "forest")
    while True:
        parents = edges.select(F.col("v").alias("p")).distinct()
        chained = edges.join(parents, edges["u"] == parents["p"], "left_semi")
        twice = edges.groupBy("u").count().where("count > 1").select("u")
        if chained.select("u").union(twice).isEmpty():
            return edges.withColumnsRenamed({"u": "node", "v": "root"})
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
