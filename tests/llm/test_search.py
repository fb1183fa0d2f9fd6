"""Ranked search against plain scoring of every document."""

import collections
import math
import random
import re

import numpy as np
import pytest

from scoreloom.llm import search

DOCS = "doc_id long, text string, item long, score string"
ITEMS = "item_id long, text string, doc_id long, rank int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, top=search.TOP):
    held = [(i, collections.Counter(t)) for i, x in docs if (t := terms(x))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, counts in held:
            m = 100 - 25 + (25 * sum(counts.values()) * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if counts[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * counts[t]) // (1000 * counts[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id, score))
        for rank, (_, _, doc_id, score) in enumerate(sorted(scored)[:top], 1):
            out.append((item_id, rank, doc_id, score))
    return sorted(out, key=repr)


def made(seed, n, longest):
    """Documents of a few hundred words, common and rare, with copies and ties."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Été", "日本", "naïve", "x1y2"]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.2:
            texts.append(rng.choice(texts))
        else:
            texts.append(" ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(rng.randrange(1, longest))))
    return texts


def found(spark, docs, items, **more):
    a = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, 1, 1) for i, t in items], ITEMS)
    rows = search.search(a, b, **more).collect()
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows), key=repr)


@pytest.mark.parametrize("cells, part_terms", [(search.CELLS, search.PART_TERMS), (3000, 60)])
def test_equals_scoring_every_document(spark, monkeypatch, cells, part_terms):
    monkeypatch.setattr(search, "CELLS", cells)
    docs = list(enumerate(made(1, 500, 80)))
    items = [(i, " ".join(t.split()[:15])) for i, t in enumerate(made(2, 20, 60))]
    assert found(spark, docs, items, part_terms=part_terms) == expected(docs, items)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, "-- ,;"), (4, "One two TWO"), (5, "one two two"), (6, "é É e one"), (7, "two " * 3000),
        (None, "one two two"), (None, None), (5, "one two two"), (8, "x\x00y a_b"), (9, "nothing shared"),
    ]
    items = [(1, "One two"), (1, "É one x"), (2, None), (3, "!!"), (None, "a b y"), (4, "absent words"), (5, "two two Two")]
    assert found(spark, docs, items) == expected(docs, items)
    assert found(spark, docs, items, top=2) == expected(docs, items, 2)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_bounds_hold_for_every_document_below():
    rng = np.random.default_rng(4)
    vectors, lengths = [], rng.integers(75, 300, 200)
    for _ in range(200):
        places = np.unique(np.floor(60 * rng.random(rng.integers(1, 25)) ** 2).astype(np.int64))
        vectors.append((places, rng.integers(1, 9, len(places))))
    tree = search.DocumentTree(list(range(200)), lengths, vectors)
    below = []
    for kids, own in zip(tree.kids, tree.own, strict=True):
        below.append(sorted([*own, *(d for k in kids for d in below[k])]))
        assert (tree.exact[below[-1]] <= tree.bounds[len(below) - 1]).all()
        assert len(kids) + len(own) >= 2 or len(below) == len(tree.kids)
    assert below[-1] == list(range(200))
