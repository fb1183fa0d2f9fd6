"""The training-data operators on odd inputs and against brute force."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, differences
from scoreloom.llm import (
    chat, decontaminate, exact_dedup, langid, licenses, lm, mixing, near_dedup, pii, queries, substrings,
)
from scoreloom.llm import common
from scoreloom.llm.common import WordHashes, gram_hashes
from scoreloom.llm.components import components

LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
PASSAGE = " ".join(f"p{i}" for i in range(40))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, found string, digest string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with names the operators use."""
    texts = [
        (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t", "en", "a"), (4, "One", "en", None), (5, "one", "en", "b"),
        (6, LONG, "en", "b"), (7, LONG + " end", "en", "b"), (8, PASSAGE, "de", "c"), (9, "start " + PASSAGE + " stop", "de", "c"),
        (9, "start " + PASSAGE + " stop", "de", "c"), (9, "another text of row nine", "de", "c"), (None, PASSAGE, "fr", "d"),
        (None, "no id here", "fr", "d"), (10, "123 456", "en", "a"), (11, "ÄÖ ß x   y", "de", "a"),
    ]
    return spark.createDataFrame([(i, t, g, s, None, 7, "x", "y") for i, t, g, s in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def words_of(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    con = connect(small)
    assert differences(queries.QUERIES[name](spark, small), con, queries.ORACLES[name]) == []
    con.close()


@pytest.mark.parametrize("block", [7, 1 << 18])
def test_text_hashes_cut_and_tell_words_apart(monkeypatch, block):
    monkeypatch.setattr(common, "BLOCK_BYTES", block)
    texts = [b"", b" \t\r\n", b"one", b"a b\x0bc \x1cd  a", LONG.encode(), "ß ss ß".encode(), b"x" * 5000 + b" x"]
    for t in texts:
        words, found = t.split(), common.text_hashes(t).tolist()
        assert len(found) == len(words)
        assert len(set(zip(words, found, strict=True))) == len(set(words)) == len(set(found))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


# --- exact copies -----------------------------------------------------------------------


def expect_exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups["".join(c.lower() if c.isascii() else c for c in t or "")].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return groups, top


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.lit(b"same")])
def test_exact_copies(odd, digest):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    groups, top = expect_exact(rows)
    got = exact_dedup.exact_duplicates(odd, digest).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    want = collections.Counter((i, top[t], len(ids)) for t, ids in groups.items() for i in ids)
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    kept = exact_dedup.drop_exact_duplicates(odd, digest)
    assert kept.columns == odd.columns and kept.count() == len(groups)


# --- near copies ------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words_of((t or "").lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = (find(root, k) for k in (a, b))
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(root, i)) for i in ids}


def find(root, x):
    while root[x] != x:
        x = root[x]
    return x


def near(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()}


def test_near_copies_in_a_large_group(spark, monkeypatch):
    """Variants of one text, many of them similar only to some others; tiles of eight."""
    monkeypatch.setattr(near_dedup, "TILE", 8)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(90):
        w = [f"v{k}" for k in range(80)]
        for k in rng.integers(0, 80, rng.integers(0, 7)):
            w[k] = f"z{rng.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    assert near(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute_components(rows)


def test_near_copies_of_odd_rows(odd, nothing):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r["kept"] for r in got if r["doc_id"] is None) and all(r["kept"] for r in got if r["n_shingles"] == 0)
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id[7] == 6 and by_id[5] == 4
    gone = near_dedup.drop_near_duplicates(nothing)
    assert gone.columns == nothing.columns and gone.count() == 0


def brute_rows(rows):
    """Per row (id, text): (id, size of its set, smallest id of its group, kept), each row a node of its own."""
    sets = []
    for _, t in rows:
        w = words_of("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = {k: k for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and None not in (rows[a][0], rows[b][0]) and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(root, a)] = find(root, b)
    groups = collections.defaultdict(list)
    for k in root:
        groups[find(root, k)].append(k)
    out = []
    for own in groups.values():
        label = min((rows[k][0] for k in own if rows[k][0] is not None), default=None)
        out += [(rows[k][0], len(sets[k]), label, rows[k][0] == label) for k in own]
    return sorted(out, key=repr), groups


P, Q = PASSAGE, " ".join(f"q{i}" for i in range(40))
REPEATED = [
    [(8, P), (9, f"start {P} stop"), (9, "another text of row nine")],
    [(8, P), (9, f"start {P} stop"), (9, Q), (7, f"{Q} end")],
    [(5, P), (5, f"{P} more"), (5, f"{P} more"), (5, "alone here"), (6, f"{P} much"), (None, P), (3, None), (3, "")],
]


@pytest.mark.parametrize("case", range(len(REPEATED)))
def test_near_copies_with_repeated_ids(spark, case):
    """Every row is judged by its own text, in any order of the rows."""
    for rows in (REPEATED[case], REPEATED[case][::-1], sorted(REPEATED[case], key=repr)):
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, rep string, raw long").coalesce(1)
        want, groups = brute_rows(rows)
        assert sorted(map(tuple, near_dedup.near_duplicates(df).collect()), key=repr) == want
        kept = near_dedup.drop_near_duplicates(df)
        assert kept.columns == df.columns
        stay = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
        for own in groups.values():  # equal rows stay together
            some = {rows[k] for k in own}
            label = min((i for i, _ in some if i is not None), default=None)
            found = [r for r in some if stay[r]]
            if any(words_of(t) for _, t in some):
                assert len(found) == 1 and found[0][0] == label or label is None
            else:
                assert len(found) == len(some)


def test_near_copies_equal_brute_force_on_odd_rows(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(map(tuple, near_dedup.near_duplicates(odd).collect()), key=repr) == brute_rows(rows)[0]


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    for n, share in ((3, 2), (60, 30), (900, 700)):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[:share], rng.integers(0, 2**63, n - share, dtype=np.uint64)])
        owner = np.repeat([0, 1], n)
        sign = near_dedup.superminhash(np.concatenate([a, b]), owner, 2, 240)
        assert abs((sign[0] == sign[1]).mean() - share / (2 * n - share)) < 0.13


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1002), (500, 500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000, 1002: 1000}


# --- repeated passages -------------------------------------------------------------------


def brute_removed(rows):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, substrings.NO_ID), substrings.NO_ID if i is None else i)
    out = collections.Counter()
    for i, t in rows:
        w, own = words_of(t), substrings.NO_ID if i is None else i
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < own for j in range(13)}
        out[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    return out


@pytest.mark.parametrize("cut", [300, 4 << 20])
def test_repeated_passages(spark, odd, nothing, monkeypatch, cut):
    monkeypatch.setattr(substrings, "CUT_BYTES", cut)
    monkeypatch.setattr(substrings, "SHARD_BYTES", 20_000)
    got = substrings.remove_repeated(odd).collect()
    assert collections.Counter(map(tuple, got)) == brute_removed([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert substrings.remove_repeated(nothing).count() == 0


def test_index_counts():
    rng = np.random.default_rng(2)
    text = np.concatenate([[0], rng.integers(1, 4, 400), [0]])
    index = substrings.Index(text, 4)
    windows = np.arange(1, 390)
    found, low, high = index.search(windows, 6)
    counts = collections.Counter(tuple(text[i : i + 6]) for i in range(len(text) - 5))
    assert set(found) == {i for i in windows if counts[tuple(text[i : i + 6])] > 1}
    assert all(h - l == counts[tuple(text[i : i + 6])] for i, l, h in zip(found, low, high, strict=True))


# --- benchmark passages ------------------------------------------------------------------


def test_decontamination(spark, odd, nothing):
    rng = np.random.default_rng(3)
    items = [(k, " ".join(f"b{k}_{j}" for j in range(n))) for k, n in enumerate((3, 12, 30, 55))] + [(8, None), (9, "")]
    benchmark = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, doc_id bigint")
    rows = []
    for i in range(120):
        k = int(rng.integers(0, 4))
        w = items[k][1].split()
        for j in rng.integers(0, len(w), rng.integers(0, 4)):
            w[j] = "other"
        pad = [f"n{x}" for x in rng.integers(0, 900, 30)]
        rows.append((i, " ".join([*pad[:15], *w, *pad[15:]]).upper()))
    want = set()
    hashes = WordHashes()
    for i, t in rows:
        h = hashes.of(t.lower().encode().split())
        for k, item in items[:4]:
            g = hashes.of(item.encode().split())
            n = min(5, len(g))
            own, grams = collections.Counter(gram_hashes(g, n).tolist()), gram_hashes(h, n).tolist()
            width = len(g) - n + 1
            if any(decontaminate.similarity(collections.Counter(grams[s : s + width]), own) >= 0.75 for s in range(len(grams) - width + 1)):
                want.add((i, k))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, benchmark).collect()} == want
    assert 20 < len(want) < 120
    clean = decontaminate.drop_contaminated(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert decontaminate.drop_contaminated(nothing, benchmark).count() == 0
    assert decontaminate.drop_contaminated(odd, benchmark.limit(0)).count() == odd.count()


def test_decontamination_of_documents_shorter_than_the_item(spark):
    rng = np.random.default_rng(8)
    items = [(k, [f"c{k}_{j}" for j in range(n)]) for k, n in enumerate((3, 6, 20, 40, 55))]
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string")
    texts = [w[:-1] for _, w in items] + [w[1:] for _, w in items]
    for _, w in items * 20:
        gone = set(rng.integers(0, len(w), rng.integers(1, 9)).tolist())
        texts.append([x for j, x in enumerate(w) if j not in gone])
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    shingles = lambda w, n: collections.Counter(tuple(w[s : s + n]) for s in range(len(w) - n + 1))
    want = {}
    for i, w in enumerate(texts):
        for k, item in items:
            n = min(5, len(item))
            if len(w) >= n and (value := decontaminate.similarity(shingles(w, n), shingles(item, n))) >= 0.75:
                want[i, k] = (0, len(w), value)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["from_word"], r["n_words"], r["similarity"]) for r in decontaminate.contaminated(df, benchmark).collect()}
    assert got == want and (3, 3) in got and got[3, 3][2] == 35 / 36
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(df, benchmark).collect()} == set(range(len(rows))) - {i for i, _ in want}


# --- personal data -------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd_, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd_)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    return {"email": True, "card": 13 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 9 <= len(digits) <= 15}[kind]


def brute_base(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def test_personal_spans(spark, odd, nothing, docs):
    tricky = [
        "a@b.c_d@e.f x@y.z-q@r.s @a.b a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 " + "9" * 60 + ".1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112", "+1 (743) 555-3824. +123 ++49 30 1234567 +",
        "ß😀 a@b.de 😀 10.0.0.1 😀", "1 " * 3000, "1.2.3.4 " * 500, "x" * 3_000 + "@", "7" * 3_000, "a.b" * 900,
        'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f9"', " ".join(f"{i}.7 x" for i in range(50_000)),
        "aws_secret_access_key_for_production_use = '0a1b2c3d4e5f60718293a4b5c6d7e8f9'",
        "the_application_secret_token_of_the_service=0a1b2c3d4e5f60718293a4b5c6d7e8f9 end",
    ]
    secrets = [10, 12, 13]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tricky)], "doc_id bigint, text string")
    others = odd.select("doc_id", "text").union(docs.select("doc_id", "text")).withColumn("doc_id", F.col("doc_id") + 1000)
    rows = df.union(others)
    got = pii.personal_spans(rows.select("*", F.col("text").alias("kept"))).collect()
    want = collections.Counter((r["doc_id"], tuple(brute_base(r["text"]))) for r in rows.collect())
    assert collections.Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["base"])) for r in got) == want
    assert pii.personal_spans(nothing).count() == 0
    # secrets are found whatever the size of the table, and nothing is learned from their neighbours
    few = df.where(F.col("doc_id").isin(secrets))
    for found in (got, pii.personal_spans(few).collect(), pii.personal_spans(df.where("doc_id = 13")).collect()):
        held = {r["doc_id"]: [s["kind"] for s in r["added"]] for r in found if r["doc_id"] in secrets and r["added"]}
        assert held == {i: ["x_secret"] for i in held} and 13 in held
    assert {r["doc_id"] for r in got if [s["kind"] for s in r["added"]] == ["x_secret"]} >= set(secrets)


def test_conversations_do_not_depend_on_the_layout(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, None, "system", "s"), (2, 1, "user", "q"), (2, 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [
        {r["conv_id"]: chat.read_back(r["formatted"]) for r in chat.format_conversations(part).collect()}
        for part in (df.coalesce(1), df.repartition(7), df.orderBy(F.col("text").desc()).coalesce(1))
    ]
    assert found[0] == found[1] == found[2]
    assert found[0][1] == [("system", "s"), ("assistant", "z"), ("user", "a"), ("user", "b")]
    assert found[0][2] == [("user", ""), ("user", "q")]


# --- language -------------------------------------------------------------------------------


def test_language_accuracy(spark, small, docs):
    got = queries.QUERIES["op10_language_id"](spark, small).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0


def test_language_gradients():
    network = langid.ByteNetwork(["a", "b"], hidden=3)
    for p in network.parameters():
        p[...] = np.random.default_rng(p.size).standard_normal(p.shape) * 0.4
    x, y = np.array([[97, 98, 99], [98, 98, 97]], np.uint8), np.array([0, 1])
    _, grads = network.gradients(x, y)
    for p, g in zip(network.parameters(), grads, strict=True):
        flat, k = p.reshape(-1), int(np.abs(g).argmax())
        old, step = flat[k], np.float32(1e-2)
        flat[k] = old + step
        up, _ = network.gradients(x, y)
        flat[k] = old - step
        down, _ = network.gradients(x, y)
        flat[k] = old
        assert abs((up - down) / (2 * step) - g.reshape(-1)[k]) < 2e-3


def test_language_of_odd_rows(odd, nothing):
    network = langid.train_network(odd)
    got = {r["doc_id"]: r for r in langid.identify(odd, network).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 10))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[6]["positions"] == len(LONG.replace(" ", ""))
    assert langid.train_network(nothing) is None and langid.identify(nothing, None).count() == 0
    kept = langid.keep_identified(odd, network)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4


def test_language_network_learns_every_language(spark, monkeypatch):
    """More languages than the 64 once learned, told apart after a shared start of over 4000 characters."""
    monkeypatch.setattr(langid, "WORDS", 300)
    start = "gemeinsam " * 450
    names = [f"l{k:02}" for k in range(66)]
    own = {g: f"{chr(0x4E00 + 64 * k)}{chr(0x4E00 + 64 * k + 1)}" for k, g in enumerate(names)}
    rows = [(i, start + " ".join([own[names[i % 66]]] * 900), names[i % 66]) for i in range(66 * 8)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    drawn = langid._training_words(df, {g: 8 for g in names})
    assert all(any(w.decode() == own[g] for w in drawn[g]) for g in names)
    network = langid.train_network(df)
    assert network.languages == names


def test_language_draw_is_bounded_and_repeats(spark, odd):
    text = " ".join(f"w{i}" for i in range(5000)).encode() + b" " + b"x" * 100
    drawn = langid._draw(text, -5, 40)
    assert len(drawn) == 40 and drawn == langid._draw(text, -5, 40) and max(int(w[1:]) for w in drawn if w[:1] == b"w") > 2500
    assert langid._draw(b"a " + b"y" * 30, 1, 40) == [b"a", b"y" * 24, b"y" * 6]
    copies = odd.where("doc_id IS NULL").unionByName(odd.where("doc_id IS NULL")).repartition(5)
    assert langid._training_words(copies, {"fr": 4}) == langid._training_words(copies.coalesce(1), {"fr": 4})


def test_language_scores_do_not_depend_on_company(spark, docs):
    """Bit for bit the same alone, in another order, in other batches, and in a plain forward pass of the network."""
    network = langid.train_network(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, network).collect()}
    for other in (docs.repartition(7), docs.orderBy(F.col("doc_id").desc()).coalesce(1), docs.where("doc_id % 3 = 1")):
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(other, network).collect()}
        assert got == {i: want[i] for i in got}
    for doc_id, text in rows[::5]:
        reader = langid.Reader(network)
        alone = langid._scores(reader.read([(text or "").encode()]), len(network.languages))[0]
        pieces = [w[a : a + langid.LONGEST] for w in words_of(text) for a in range(0, len(w), langid.LONGEST)]
        sums = sum((network.positions(np.frombuffer(p, np.uint8)[None])[0].sum(axis=0) for p in pieces), np.zeros(1))
        plain = sums.max() / max(1, sum(map(len, pieces)))
        assert want[doc_id][1] == (alone if want[doc_id][0] != langid.UNKNOWN else 0.0) and abs(plain - alone) < 1e-5


def test_language_stage_drops_letter_junk(spark, small, docs):
    rng = np.random.default_rng(6)
    letters = list("bcdfghjkmnpqvwxyz0123456789")
    junk = [(10_000 + i, " ".join("x" + "".join(rng.choice(letters, 7)) for _ in range(60))) for i in range(40)]
    added = spark.createDataFrame([(i, t, None) for i, t in junk], "doc_id bigint, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").union(added)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, rows, small).collect()}
    clean = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert clean <= kept and len(kept - clean) <= 2


def test_language_stage_without_labels(spark, small, odd):
    rows = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(spark, rows, small)
    assert kept.columns == rows.columns and kept.count() == rows.count() - 4


# --- mix --------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    open_, left, out = set(names), 1.5 * sum(sizes.values()), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: 2.0 * sizes[s] for s in above}
        left, open_ = left - sum(2 * sizes[s] for s in above), open_ - above
    return out


def test_mix(spark, odd, docs, nothing):
    for rows in (odd, docs):
        got = mixing.words_taken(rows, block=16, shard=64).collect()
        want = collections.Counter((r["doc_id"], len(words_of(r["text"])), r["source"]) for r in rows.collect())
        assert collections.Counter((r["doc_id"], r["size"], r["source"]) for r in got) == want
        sizes, taken = collections.Counter(), collections.Counter()
        for r in got:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert r["taken"] <= 2 * r["size"]
        targets = brute_targets(sizes)
        assert all(abs(r["target"] - targets[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] for r in got)
        assert all(abs(taken[s] - targets[s]) <= 32 + 0.01 * targets[s] for s in sizes)
        again = mixing.words_taken(rows, block=16, shard=64).collect()
        assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.words_taken(nothing).count() == 0


def test_mix_does_not_depend_on_the_layout(odd, docs, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 20)
    for rows in (odd, docs):
        taken = [sorted(map(str, mixing.words_taken(x, block=16, shard=64).collect())) for x in (rows.coalesce(1), rows.repartition(7))]
        assert taken[0] == taken[1]


def test_mixed_texts(spark, docs):
    given = {w for r in docs.collect() for w in words_of(r["text"])}
    got = mixing.mixed_texts(docs, block=64).collect()
    sizes = collections.Counter(len(r["text"].split(" ")) for r in got)
    assert sizes.most_common(1)[0][0] == 64 and max(sizes) == 64
    assert {w for r in got for w in r["text"].encode().split()} <= given


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = spark.range(n).select(F.expr(mixing.permuted("id", f"{n}L", "5L")).alias("p"))
        assert sorted(r["p"] for r in got.collect()) == list(range(n))


# --- licences, scores, chats ---------------------------------------------------------------------


def test_licenses(spark, odd, nothing, docs):
    rows = docs.where("text LIKE '%License%' OR text LIKE '%CC BY-NC%'")
    classifier = licenses.train_classifier(docs)
    got = collections.defaultdict(set)
    for r in licenses.scan_licenses(docs, classifier).collect():
        got[r["doc_id"]].add(r["family"])
    marks = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General": "GPL-3.0", "CC BY-NC": "CC-BY-NC-4.0"}
    assert got == {r["doc_id"]: {f for m, f in marks.items() if m in r["text"]} for r in rows.collect()}
    assert licenses.scan_licenses(odd, classifier).count() == licenses.scan_licenses(nothing, classifier).count() == 0
    long = spark.createDataFrame([(1, LONG[:5000] + " Released under the MIT License. " + LONG[:5000])], "doc_id bigint, text string")
    assert [r["family"] for r in licenses.scan_licenses(long, classifier).collect()] == ["MIT"]
    assert licenses.train_classifier(nothing).search(b"Released under the MIT License.")[0]["family"] == "MIT"


def test_scores_of_odd_rows(spark, odd, nothing):
    got = {r["doc_id"]: r for r in lm.score_documents(odd).collect()}
    assert len(lm.score_documents(odd).collect()) == odd.count()
    assert got[1]["score"] == 0 and got[1]["n_words"] == 0 and got[6]["n_words"] == 20_000
    assert lm.score_documents(nothing).count() == 0
    three = lm.score_documents(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id bigint, text string"), order=3).first()
    assert abs(three["score"] - np.log(2 / 6)) < 1e-9 and three["n_backoff"] == 0


def test_scores_of_order_three(spark, small, docs):
    import __spark_entry__

    texts = {r["doc_id"]: words_of(r["text"]) for r in docs.collect()}
    counts = collections.Counter(tuple(w[k : k + n]) for w in texts.values() for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total, backed = sum(map(len, texts.values())), 0
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["op8_lm_score_order3"](spark, small).collect()}
    assert got.keys() == texts.keys()
    for i, w in texts.items():
        score, short = 0.0, 0
        for k in range(len(w)):
            n = longest = min(3, k + 1)
            while n > 1 and counts[tuple(w[k + 1 - n : k + 1])] < 2:
                n -= 1
            below = counts[tuple(w[k + 1 - n : k])] if n > 1 else total
            score += np.log(counts[tuple(w[k + 1 - n : k + 1])] / below) + (longest - n) * np.log(0.4)
            short, backed = short + (n < longest), backed + (longest - n == 2)
        assert abs(got[i]["score"] - score) < 1e-4 and got[i]["n_backoff"] == short
    assert backed > 0


def test_scores_do_not_depend_on_blocks(docs, monkeypatch):
    one = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(lm, "PARTITION_BYTES", 50_000)
    many = {r["doc_id"]: r["score"] for r in lm.score_documents(docs).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-6 for k in one)


def test_format_round_trip():
    turns = [("system", "a <<SYS>> \\"), ("user", "</s>[INST] ok [/INST]"), ("assistant", ""), ("to]ol", "x\n\\[y"), ("", "😀"), ("assistant", "z</s>")]
    formatted, loss = chat.format_turns(turns)
    assert chat.read_back(formatted) == turns
    assert [chat.unescape(formatted[r["start"] : r["end"]]) for r in loss] == ["", "z</s>"]
    with pytest.raises(ValueError):
        chat.read_back(formatted + "rest")


def test_conversations_of_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "y"), (None, 0, "user", "n"), (None, 0, "user", "m"), (2, None, "user", "q")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame([(*r, 5) for r in rows], schema + ", node bigint")
    got = collections.Counter((r["conv_id"], len(chat.read_back(r["formatted"]))) for r in chat.format_conversations(df).collect())
    assert got == {(1, 3): 1, (None, 1): 2, (2, 1): 1}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_best_paths(spark):
    # 0 -> 1 -> 3, 0 -> 2 -> 4 -> 5; a root of its own; an orphan; a cycle
    nodes = [(0, None, 1.0), (1, 0, 5.0), (3, 1, 0.0), (2, 0, 2.0), (4, 2, 3.0), (5, 4, 3.0), (7, None, 0.0), (8, 99, 0.0), (20, 21, 1.0), (21, 20, 1.0)]
    df = spark.createDataFrame(nodes, "node bigint, parent bigint, score double")
    got = sorted(tuple(r) for r in chat.best_paths(df).select("leaf", "place", "node").collect())
    assert got == [(5, 1, 0), (5, 2, 2), (5, 3, 4), (5, 4, 5), (7, 1, 7), (8, 1, 8)]


# --- the pipeline ---------------------------------------------------------------------------------


def test_pipeline(spark, small, docs):
    """Each stage against brute force on its own input."""
    held, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, small)
        assert out.columns == docs.columns
        rows = {r["doc_id"]: r["text"] for r in held.collect()}
        kept = {r["doc_id"] for r in out.collect()}
        if name == "identify_language":
            assert kept == {i for i, t in rows.items() if any(c.isalpha() for c in t or "")}
        if name == "drop_copies":
            _, top = expect_exact(rows.items())
            assert kept == set(top.values())
        if name == "drop_near_copies":
            assert kept == {i for i, (_, c) in brute_components(rows.items()).items() if c == i}
        if name == "drop_benchmark":
            items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            assert not kept & {i for i, t in rows.items() if any(x in t for x in items)}
            assert len(kept) >= 0.9 * len(rows)
        counts.append(len(kept))
        held = held.where(F.col("doc_id").isin(sorted(kept)))
    result = corpus_pipeline.STAGES[-1][1](spark, held, small)
    assert result.count() == counts[-1] < docs.count()
