"""Structure repair against plain dynamic programming, whole conversations and cut ones."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from compare import connect, differences
from scoreloom.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, pos long, conv string"
WANTED = re.compile(r"(s?(ua)+)?")


def cheapest(initials, faults):
    """(cost, audit, roles said) of the cheapest edits, the first by letters."""
    said = {"": "u", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, state, inserts):
        ways = []
        if i == len(initials) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserts < 3:
            cost, audit, roles = best(i, said[state], inserts + 1)
            ways.append((cost + 3, "I" + audit, (said[state], *roles)))
        if i < len(initials):
            cost, audit, roles = best(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit, roles))
            if faults[i] != repair.GOES:
                more = 3 * (faults[i] == repair.CUT_OFF)
                if initials[i] == said[state] or (initials[i], state) == ("s", ""):
                    cost, audit, roles = best(i + 1, initials[i], 0)
                    ways.append((cost + more, "K" + audit, (initials[i], *roles)))
                cost, audit, roles = best(i + 1, said[state], 0)
                ways.append((cost + more + 3, "R" + audit, (said[state], *roles)))
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 0)


def cases(seed, n, longest):
    rng = random.Random(seed)
    for _ in range(n):
        size = rng.randrange(longest)
        yield [rng.choice("suax" if rng.random() < 0.3 else "ua") for _ in range(size)], [
            rng.choice((0, 0, 0, 1, 2)) for _ in range(size)
        ]


def test_auction_finds_the_cheapest_and_first():
    for initials, faults in cases(1, 400, 12):
        found = repair.solve(initials, faults, 100)
        cost, audit, roles = cheapest(initials, faults)
        assert (found.cost, found.audit) == (cost, audit)
        assert WANTED.fullmatch("".join(roles))
        said = [
            r[0] if r else initials[p - 100]
            for e, p, r in zip(found.audit, found.places, found.roles, strict=True) if e != "D"
        ]
        assert tuple(said) == roles


def test_prices_are_feasible_and_tight():
    for initials, faults in cases(2, 60, 30):
        arcs, prices = repair.lattice(initials, faults, repair.END)
        repair.auction(arcs, prices, repair.START)
        assert all(prices[i] <= cost + prices[j] for i, out in enumerate(arcs) for _, cost, j in out)
        steps = repair.trace(arcs, prices, repair.START)
        assert prices[repair.START] == sum(cost for _, cost, _ in steps)


def test_folded_runs_equal_the_whole():
    for initials, faults in cases(3, 60, 40):
        cuts = [0, len(initials) // 3, 2 * len(initials) // 3, len(initials)]
        runs = [(initials[a:b], faults[a:b]) for a, b in itertools.pairwise(cuts) if a < b]
        ends, after = repair.END, []
        for r, f in reversed(runs):
            after.insert(0, ends)
            p = repair.run_prices(r, f)
            ends = [min((p[4 * s + x] + ends[x] for x in repair.STATES if p[4 * s + x] >= 0 and ends[x] >= 0), default=-1)
                    for s in repair.STATES]
        state, audit, cost = repair.START, "", 0
        for (r, f), e in zip(runs, after, strict=True):
            found = repair.solve(r, f, 0, state, e)
            state, audit, cost = found.exit, audit + found.audit, cost + found.cost
        assert (cost, audit) == cheapest(initials, faults)[:2]


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        rest = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(0 if rest == "" else 1 if (role, text) in seen else 2 if rest[-1] not in ".!?" else 3)
        seen.add((role, text))
    return out


def expected(rows):
    """``rows(turn, role, text)`` of one conversation after damage -> what the report and the texts must be."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    kinds = faults_of(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    cost, audit, roles = cheapest(tuple(initials), tuple({0: 2, 1: 2, 2: 1, 3: 0}[k] for k in kinds))
    texts, at, names = [], iter(rows), iter(roles)
    for e in audit:
        row = next(at) if e != "I" else None
        if e != "D":
            name = {"u": "user", "a": "assistant"}.get(next(names))
            texts.append((row[1] if e == "K" else name, row[2] if row else ""))
    return (gaps, *(kinds.count(k) for k in range(3)), illegal, cost, audit), texts


def check(spark, rows):
    """``rows(conv_id, turn, role, text)`` through the operator against ``expected``."""
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    found = repair.repair(df)
    report = {r["conv_id"]: tuple(r)[2:] for r in found.report.collect()}
    texts = {}
    for r in sorted(repair.repaired_turns(found).collect(), key=lambda r: (r["first_pos"], r["place"])):
        texts.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    assert set(report) == set(convs)
    for c, given in convs.items():
        want, said = expected(given)
        assert report[c] == want, c
        assert texts.get(c, []) == said


def made(seed, convs, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "usr"]
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "a b? ", "end.\n", "Long " * 300 + "."]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, longest)):
            turn = None if rng.random() < 0.05 else t + (rng.random() < 0.1)
            text = rng.choice(texts) if rng.random() < 0.3 else f"text {rng.random()}."
            rows.append((c if c else None, turn, rng.choice(roles), text))
    return rows


@pytest.mark.parametrize("longest, bits", [(128, 14), (4, 3)])
def test_odd_rows(spark, monkeypatch, longest, bits):
    monkeypatch.setattr(repair, "LONGEST_RUN", longest)
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    check(spark, made(5, 25, 14))


def test_no_rows(spark):
    found = repair.repair(spark.createDataFrame([], SCHEMA))
    assert found.report.count() == 0 and found.edits.count() == 0 and repair.repaired_turns(found).count() == 0


def test_one_long_conversation(spark):
    """A third of all rows in one conversation, cut into many runs, equals the whole lattice."""
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "tool"]), f"text {t}" + rng.choice([".", ""])) for t in range(600)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    report = repair.repair(df).report.collect()[0]
    initials = [r[2][0] for r in rows]
    faults = [0 if r[3].endswith(".") else 1 for r in rows]
    whole = repair.solve(initials, faults, 0)
    assert (report["cost"], report["audit"]) == (whole.cost, whole.audit)


def test_damage(spark):
    rows = [(c, t, "assistant", f"a.b!{t}?") for c in (*range(30), None) for t in (0, 1, None, -3)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(tuple, repair.damaged(df).collect()), key=repr) == sorted(want, key=repr)


def test_query_on_odd_rows_equals_sql(spark, tmp_path):
    rows = [(*r, 1, "x") for r in made(6, 60, 12)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "c"))
    next((tmp_path / "c").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    con = connect(str(tmp_path))
    name = "op12_repair_structure"
    assert differences(queries.QUERIES[name](spark, str(tmp_path)), con, queries.ORACLES[name]) == []
    con.close()


def test_query_counts_every_conversation(spark, small):
    rows = queries.QUERIES["op12_repair_structure"](spark, small)
    given = spark.read.parquet(f"{small}/conversations.parquet")
    assert rows.count() == given.select("conv_id").distinct().count()
    empty = hashlib.sha256(b"").hexdigest()
    assert rows.where(f"audit = '' AND repaired_sha256 <> '{empty}'").isEmpty()
    assert rows.where(F.col("cost") < 0).isEmpty()
