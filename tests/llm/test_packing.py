"""Packing: every id in exactly one piece, sequences without holes, little padding."""

import collections
import zlib

import numpy as np
import pytest

from scoreloom.llm import packing, queries

ODD = [
    "", None, "   \n\t", "One two", "<|endoftext|> in a text<|startoftext|>", "<|ENDOFTEXT|>. It's THE end!?",
    "x" * 5000 + " y", "ΣΑΣ Σ, H̱ ẖ. İstanbul ß ﬁ", "à́ é. a b c\x1cd 12 34a5...",
    "日本語テキスト。 次、", " ".join(f"w{i % 977}x{i}" for i in range(9_000)),
]


@pytest.fixture(scope="module")
def tokenizer():
    return packing.load_tokenizer()


def whole_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(pieces, texts, tokenizer, size=packing.SEQUENCE):
    """``pieces`` as rows of the query; returns the share of padding."""
    of_doc, of_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        of_doc[p["doc_id"]].append(p)
        of_sequence[p["sequence_id"]].append(p)
    assert set(of_doc) == set(texts)
    for doc_id, text in texts.items():
        ids, at = whole_ids(tokenizer, text), 0
        for p in sorted(of_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + p["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids)
    used = padded = 0
    for rows in of_sequence.values():
        at = 0
        for p in sorted(rows, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        used, padded = used + at, padded + (0 if at & (at - 1) == 0 else size - at)
    return padded / (used + padded)


def test_whole_table(spark, small, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = queries.QUERIES["op11_pack_sequences"](spark, small).collect()
    assert check(found, texts, tokenizer) < 0.003


@pytest.mark.parametrize("size, group", [(2048, 1024), (64, 4)])
def test_odd_rows(spark, tokenizer, size, group):
    rows = [(i, t, 5, "x") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, ids string").repartition(3)
    pieces = packing.pack(docs, size=size, docs_per_group=group)
    digests = pieces.selectExpr("*", "crc32(ids) AS ids_crc32").collect()
    assert check(digests, dict(enumerate(ODD)), tokenizer, size) < 0.05
    rows = packing.sequences(pieces).collect()
    assert sum(len(r["input_ids"]) for r in rows) == sum(len(whole_ids(tokenizer, t)) for t in ODD)
    assert all(sum(r["piece_lengths"]) == len(r["input_ids"]) <= size for r in rows)


def test_repeated_and_missing_ids_and_no_rows(spark, tokenizer):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    found = packing.pack(docs).collect()
    assert sorted(len(p["ids"]) // 4 for p in found) == [1, 2, 3, 3]
    assert packing.pack(docs.where("false")).count() == 0


def test_words_alone_give_the_ids_of_the_text(tokenizer):
    words = packing.WordIds(tokenizer)
    more = ["Éauouon, ÉTÉ ÇA Öl ÄÖ. naïve Naïve e\u0301te É", "ΑΣ ας Ǆ ǅ ǆ ſt K Å Å ﬁ ß ẞ İI ıi ʼn ŉ", "it's o'll Don'T ª º ² ½ ⅷ Ⅷ à"]
    for text in filter(None, ODD + more):
        assert np.frombuffer(words.of(text.encode()), words.kind).tolist() == whole_ids(tokenizer, text)[:-1]


def test_the_tree_finds_the_first_bin():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 101, rng.integers(1, 120)).tolist()
        free: list[int] = []
        bins: list[list] = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            at = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
            if at == len(free):
                free.append(100)
                bins.append([])
            free[at] -= lengths[i]
            bins[at].append((i, 0, lengths[i]))
        assert packing.first_fit_decreasing(lengths, 100) == bins
        for least in (1, 8):
            packed = packing.pack_group(lengths, 100, least)
            cover = collections.Counter((i, k) for s in packed for i, start, n in s for k in range(start, start + n))
            assert cover == collections.Counter((i, k) for i, n in enumerate(lengths) for k in range(n))
            short = [t for s in packed if (t := sum(p[2] for p in s)) != 100]
            assert all(t > 100 - least or t & (t - 1) == 0 for t in short)
