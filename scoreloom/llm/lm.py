"""Language-model scores with stupid backoff from counts of the corpus itself.

The score of a word is the count of the longest n-gram ending in it over the count of that
n-gram's context, times 0.4 for each shorter step; n-grams of two and more words count as
seen from ``MIN_COUNT`` on, single words always. A document's score is the sum of the
logarithms.

As relations: (1) the exploded n-grams of a block of documents, aggregated to one entry per
different n-gram; (2) the count tables, partitioned by n-gram hash, which sum the entries
of all blocks; (3) the join of both, one total per entry; (4) the sum per document. Rows
of (1) to (3) hold all entries of one block in one partition of the count tables, sorted by
hash and packed, so an entry moves as about six bytes, and the join is a merge of sorted
arrays. An n-gram in every document is one entry per block, so no partition is hot.

Blocks and partitions have a fixed size, and their number follows the corpus.

Defined cases: a null text or one without words has score 0 and 0 words; rows that repeat
count and are scored each; an empty table gives an empty result; further columns are
ignored; a null ``doc_id`` is a document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import WordHashes, gram_hashes, pack, unpack

ORDER, BACKOFF, MIN_COUNT = 2, 0.4, 2
BLOCK_BYTES, PARTITION_BYTES = 8 << 20, 24 << 20
_hashes = WordHashes()


def _documents(texts: pd.Series) -> list[np.ndarray]:
    return [_hashes.of((t or "").encode().split()) for t in texts]


def _block_grams(words: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    grams = [gram_hashes(w, order) for w in words]
    return np.unique(np.concatenate([*grams, np.empty(0, np.uint64)]), return_counts=True)


def _bounds(partitions: int) -> np.ndarray:
    """The first hash of each partition."""
    return np.array([(k << 64) // partitions for k in range(partitions)], np.uint64)


def exploded(texts: pd.DataFrame, partitions: int, order: int) -> pd.DataFrame:
    """The n-grams of one block: a row per partition and order with hashes and counts in it."""
    words, rows = _documents(texts["text"]), []
    for n in range(1, order + 1):
        grams, counts = _block_grams(words, n)
        cuts = np.append(np.searchsorted(grams, _bounds(partitions)), len(grams))
        for k in range(partitions):
            part = slice(cuts[k], cuts[k + 1])
            if cuts[k] < cuts[k + 1]:
                rows.append((k, texts["block"].iloc[0], n, pack(grams[part], True), pack(counts[part])))
    return pd.DataFrame(rows, columns=["part", "block", "n", "grams", "counts"])


def totals(rows: pd.DataFrame) -> pd.DataFrame:
    """One partition of the count tables: for each block's entries their counts in the whole corpus."""
    out = []
    for n, same in rows.groupby("n"):
        grams = [unpack(g, True) for g in same["grams"]]
        table, place = np.unique(np.concatenate(grams), return_inverse=True)
        counts = np.concatenate([unpack(c) for c in same["counts"]]).astype(np.float64)
        total = np.bincount(place, counts, len(table)).astype(np.uint64)
        at = 0
        for block, part, g in zip(same["block"], same["part"], grams, strict=True):
            out.append((part, block, n, pack(total[place[at : at + len(g)]])))
            at += len(g)
    return pd.DataFrame(out, columns=["part", "block", "n", "totals"])


def scored(texts: pd.DataFrame, counts: pd.DataFrame, order: int, total_words: int) -> pd.DataFrame:
    """The documents of one block, from the totals of its n-grams."""
    words = _documents(texts["text"])
    counts = counts.sort_values("part")
    tables = {}
    for n in range(1, order + 1):
        got = [unpack(t) for t in counts.loc[counts["n"] == n, "totals"]]
        tables[n] = (_block_grams(words, n)[0], np.concatenate([*got, np.empty(0, np.uint64)]).astype(np.float64))
    scores, backed = [], []
    for w in words:
        found = [None] + [tables[n][1][np.searchsorted(tables[n][0], gram_hashes(w, n))] for n in range(1, order + 1)]
        logs = np.log(found[1] / max(total_words, 1)) if len(w) else np.zeros(0)
        used = np.ones(len(w), int)
        for n in range(2, order + 1):
            if len(w) < n:
                break
            longer = np.where(
                found[n] >= MIN_COUNT, np.log(found[n] / found[n - 1][: len(found[n])]), logs[n - 1 :] + np.log(BACKOFF)
            )
            used[n - 1 :] = np.where(found[n] >= MIN_COUNT, n, used[n - 1 :])
            logs = np.concatenate([logs[: n - 1], longer])
        scores.append(float(logs.sum()))
        backed.append(int((used < np.minimum(np.arange(len(w)) + 1, order)).sum()))
    return pd.DataFrame(
        {"doc_id": texts["doc_id"], "n_words": [len(w) for w in words], "n_backoff": backed, "score": scores}
    )


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``(doc_id, n_words, n_backoff, score)``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))
    size, total_words = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(words, F.lit(0))).first()
    blocks, partitions = size // BLOCK_BYTES + 1, size // PARTITION_BYTES + 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)))

    def explode(texts: pd.DataFrame) -> pd.DataFrame:
        return exploded(texts, partitions, order)

    def score(texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        return scored(texts, counts, order, total_words)

    grams = dealt.groupBy("block").applyInPandas(explode, "part long, block long, n long, grams binary, counts binary")
    counts = grams.groupBy("part").applyInPandas(totals, "part long, block long, n long, totals binary")
    both = dealt.groupBy("block").cogroup(counts.groupBy("block"))
    return both.applyInPandas(score, "doc_id long, n_words long, n_backoff long, score double")
