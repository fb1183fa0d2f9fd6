"""Conversation structure repair by an auction for shortest paths.

Each conversation, in order, is a lattice: a node is a place between two rows and the role said last; arcs keep,
rerole or delete the next row, or insert a turn. The cheapest edits that leave the roles in the form
``(system? (user assistant)+)?`` are a shortest path.

* ``auction`` finds it by node prices: the path is extended along the arc that is cheapest by cost plus price,
  or, where a node's price is too low for all its arcs, the price is raised and the path contracted. Prices start
  from the faults that cost something whatever is done, and stay feasible, so at the end every arc of every
  cheapest path is tight. ``trace`` follows the tight arcs that lead to the end, at each node the least letter.
* Conversations of up to ``LONGEST_RUN`` rows are solved where they lie. A longer one, or one that straddles two
  blocks, is cut into runs. The prices from each entry to each exit of a run are folded from the back to the
  price of every exit, each run is then solved for every entry, and the entries are folded from the front.
  The result is that of the whole lattice, and no task ever holds the rows of a conversation.

Rows are ordered by (conversation, turn, role, text) through a range exchange and numbered once.

Defined cases: null roles and texts count as one space, which is no role; rows with a null ``conv_id`` are one
conversation; null turns come first; equal turns go by role, then text; repeated rows are duplicates; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import arrow_schema, record_batch
from scoreloom.staging import staged

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: (role said last, initial) -> the role then said last
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The only role that a rerole or an insert can say after each state.
SAID = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
LEGAL = ("su", "ua", "au")
#: A conversation may end without a turn or after an assistant.
END = [0, -1, -1, 0]
GOOD, CUT_OFF, GOES = range(3)
LONGEST_RUN = 128
BLOCK_BITS = 12
BLANKS = " \t\n\x0b\x0c\r"

RUN = (
    "conv string, first_pos long, open boolean, cost long, illegal long, head string, tail string, audit string, "
    "places array<long>, roles array<string>, initials array<string>, faults array<int>, prices array<long>"
)
ENDS = "conv string, first_pos long, ends array<long>, link long"
VARIANT = (
    "conv string, first_pos long, entry int, exit int, cost long, audit string, places array<long>, roles array<string>"
)
ENTRY = "conv string, first_pos long, entry int"

Arc = tuple[str, int, int]  # letter, cost, node


def lattice(initials: list[str], faults: list[int], ends: list[int]) -> tuple[list[list[Arc]], list[int]]:
    """Arcs of every node, in the order of their letters, and feasible prices; the last node is the end.

    Node ``4 * i + state`` lies before row ``i``. ``ends`` has the price of each state after the last row, or -1.
    """
    n = len(initials)
    target = 4 * (n + 1)
    arcs: list[list[Arc]] = []
    for i in range(n):
        more = TRUNCATED if faults[i] == CUT_OFF else 0
        for state in STATES:
            said = SAID[state]
            out = [("D", DELETE, 4 * i + 4 + state), ("I", INSERT, 4 * i + said)]
            if faults[i] != GOES:
                kept = FOLLOWS.get((state, initials[i]))
                if kept is not None:
                    out.append(("K", more, 4 * i + 4 + kept))
                out.append(("R", REROLE + more, 4 * i + 4 + said))
            arcs.append(out)
    for state in STATES:
        stop = [("", ends[state], target)] if ends[state] >= 0 else []
        arcs.append([*stop, ("I", INSERT, 4 * n + SAID[state])])
    arcs.append([])
    prices = [0] * (target + 1)
    least = min(e for e in ends if e >= 0)
    for i in reversed(range(n + 1)):
        if i < n:
            least += {GOOD: 0, CUT_OFF: TRUNCATED, GOES: DELETE}[faults[i]]
        prices[4 * i : 4 * i + 4] = [least] * 4
    return arcs, prices


def auction(arcs: list[list[Arc]], prices: list[int], origin: int) -> int:
    """Raise ``prices`` until a path of tight arcs leads from ``origin`` to the last node; its cost."""
    target, path = len(arcs) - 1, [origin]
    while path[-1] != target:
        node = path[-1]
        best, to = min((cost + prices[j], j) for _, cost, j in arcs[node])
        if prices[node] < best:
            prices[node] = best
            if node != origin:
                path.pop()
        else:
            path.append(to)
    return prices[origin]


def trace(arcs: list[list[Arc]], prices: list[int], origin: int) -> list[Arc]:
    """Of the cheapest paths the one whose letters come first: ``(letter, cost, node)`` of each step."""
    target = len(arcs) - 1
    reaches = [False] * target + [True]
    for low in reversed(range(0, target, 4)):
        for _ in range(2):  # an insert leads to a node of the same place
            for node in range(low, low + 4):
                reaches[node] = reaches[node] or any(
                    reaches[j] and prices[node] == cost + prices[j] for _, cost, j in arcs[node]
                )
    steps, node = [], origin
    while node != target:
        step = next(a for a in arcs[node] if reaches[a[2]] and prices[node] == a[1] + prices[a[2]])
        steps.append(step)
        node = step[2]
    return steps


@dataclass(frozen=True)
class Solved:
    cost: int
    exit: int
    audit: str
    places: list[int | None]
    roles: list[str | None]


def solve(initials: list[str], faults: list[int], first_pos: int, entry: int = START, ends: list[int] = END) -> Solved:
    """The edits of a run of rows: their letters, the row of each, the role that a rerole or an insert gives."""
    arcs, prices = lattice(initials, faults, ends)
    auction(arcs, prices, entry)
    steps = trace(arcs, prices, entry)
    *edits, _ = steps
    places, roles, row = [], [], first_pos
    for letter, _, node in edits:
        places.append(None if letter == "I" else row)
        roles.append(ROLES[node % 4] if letter in "IR" else None)
        row += letter != "I"
    last = edits[-1][2] % 4 if edits else entry
    return Solved(sum(e[1] for e in edits), last, "".join(e[0] for e in edits), places, roles)


def run_prices(initials: list[str], faults: list[int]) -> list[int]:
    """The least cost from each entry to each exit, -1 where there is no way; entry by entry."""
    kept_system = any(r == "s" and f != GOES for r, f in zip(initials, faults, strict=True))
    ways = {START: {START}, SYSTEM: {SYSTEM} | ({START} if kept_system else set()), USER: {*STATES}, ASSISTANT: {*STATES}}
    found = {}
    for way_out in STATES:
        arcs, prices = lattice(initials, faults, [0 if s == way_out else -1 for s in STATES])
        for entry in ways[way_out]:
            found[entry, way_out] = auction(arcs, prices, entry)
    return [found.get((entry, way_out), -1) for entry in STATES for way_out in STATES]


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _runs(key: tuple, rows: pa.Table) -> pa.Table:
    """The rows of a block as runs; those wholly inside the block are solved."""
    rows = rows.sort_by("pos")
    convs, positions, initials, faults = (rows[c].to_pylist() for c in ("conv", "pos", "initial", "fault"))
    out, at, n = [], 0, len(convs)
    while at < n:
        end = at + 1
        while end < n and convs[end] == convs[at]:
            end += 1
        whole = 0 < at and end < n and end - at <= LONGEST_RUN
        for low in range(at, end, LONGEST_RUN):
            r, f = (x[low : min(low + LONGEST_RUN, end)] for x in (initials, faults))
            known = (convs[low], positions[low], not whole)
            if whole:
                s = solve(r, f, positions[low])
                out.append((*known, s.cost, _illegal(r), r[0], r[-1], s.audit, s.places, s.roles, None, None, None))
            else:
                out.append((*known, None, _illegal(r), r[0], r[-1], None, None, None, r, f, run_prices(r, f)))
        at = end
    return pa.Table.from_batches([record_batch(out, arrow_schema(RUN))])


def _fold_back(key: tuple, runs: pa.Table) -> pa.Table:
    """The price of every exit of every run, from the last run of a conversation to the first."""
    rows = runs.sort_by("first_pos").to_pylist()
    out, ends = [], END
    for k, run in reversed(list(enumerate(rows))):
        link = k > 0 and rows[k - 1]["tail"] + run["head"] not in LEGAL
        out.append((run["conv"], run["first_pos"], ends, int(link)))
        ways = [run["prices"][4 * s : 4 * s + 4] for s in STATES]
        ends = [
            min((w + e for w, e in zip(ways[s], ends, strict=True) if w >= 0 and e >= 0), default=-1) for s in STATES
        ]
    return pa.Table.from_batches([record_batch(out, arrow_schema(ENDS))])


def _every_entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for run in batch.to_pylist():
            for entry in STATES:
                s = solve(run["initials"], run["faults"], run["first_pos"], entry, run["ends"])
                out.append((run["conv"], run["first_pos"], entry, s.exit, s.cost, s.audit, s.places, s.roles))
        yield record_batch(out, arrow_schema(VARIANT))


def _fold_forth(key: tuple, variants: pa.Table) -> pa.Table:
    """The entry of every run, from the first run of a conversation to the last."""
    leads: dict[int, dict[int, int]] = {}
    for first_pos, entry, way_out in zip(*(variants[c].to_pylist() for c in ("first_pos", "entry", "exit")), strict=True):
        leads.setdefault(first_pos, {})[entry] = way_out
    out, state = [], START
    for first_pos in sorted(leads):
        out.append((key[0].as_py(), first_pos, state))
        state = leads[first_pos][state]
    return pa.Table.from_batches([record_batch(out, arrow_schema(ENTRY))])


def ordered_turns(rows: DataFrame) -> DataFrame:
    """``(conv, conv_id, turn, role, text, pos)``, written once; ``pos`` counts up in the order of the table."""
    named = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"), F.col("conv_id").cast("long"), "turn",
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("start", F.left("text", F.lit(32)))
    order = ["conv_id", "turn", "role", "start"]
    ranged = named.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("start")
    return staged(ranged.withColumn("pos", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """``(conv, pos, turn, initial, blank, duplicate, truncated)``, written once: the first fault of each row."""
    end = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    narrow = turns.select(
        "conv", "pos", "turn", "role", F.sha2("text", 256).alias("digest"),
        (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("open_end"),
    )
    same = ["conv", "role", "digest"]
    groups = narrow.where("NOT blank").groupBy(*same).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    marked = narrow.join(groups.where("n > 1").drop("n"), same, "left")
    later = F.coalesce(F.col("pos") > F.col("first"), F.lit(False)) & ~F.col("blank")
    found = marked.select("conv", "pos", "turn", F.left("role", F.lit(1)).alias("initial"), "blank",
                          later.alias("duplicate"), "open_end")
    cut = (F.col("open_end") & ~F.col("blank") & ~F.col("duplicate")).alias("truncated")
    return staged(found.select(*found.columns[:-1], cut), "faults")


@dataclass(frozen=True)
class Repair:
    """``turns`` as ordered; ``edits(conv, first_pos, place, edit, pos, role)`` in the order of (first_pos, place);
    ``report`` with one row per conversation."""

    turns: DataFrame
    edits: DataFrame
    report: DataFrame


def conv_id(conv: Column) -> Column:
    return F.when(conv != " ", conv.cast("long"))


def repair(rows: DataFrame) -> Repair:
    """Cheapest edits for every conversation of ``rows(conv_id, turn, role, text)``."""
    turns = ordered_turns(rows)
    faulty = faults(turns)
    code = F.when(F.col("blank") | F.col("duplicate"), GOES).when(F.col("truncated"), CUT_OFF).otherwise(GOOD)
    blocks = faulty.select(
        F.shiftright("pos", BLOCK_BITS).alias("block"), "conv", "pos", "initial", code.alias("fault")
    )
    # a number of its own: blocks are small in bytes for the work they give, so merging them would leave cores idle
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = staged(blocks.repartition(tasks, "block").groupBy("block").applyInArrow(_runs, RUN), "runs")
    parts = runs.where("open")
    key = ["conv", "first_pos"]
    ends = parts.select(*key, "head", "tail", "prices").groupBy("conv").applyInArrow(_fold_back, ENDS)
    ends = staged(ends, "ends")
    given = parts.select(*key, "initials", "faults").join(ends.drop("link"), key)
    variants = staged(given.mapInArrow(_every_entry, VARIANT), "variants")
    entries = variants.select(*key, "entry", "exit").groupBy("conv").applyInArrow(_fold_forth, ENTRY)
    chosen = variants.join(entries, [*key, "entry"], "left_semi")
    columns = [*key, "cost", "audit", "places", "roles"]
    solved = staged(runs.where("NOT open").select(*columns).unionByName(chosen.select(*columns)), "solved")

    zipped = F.arrays_zip(F.split("audit", "").alias("edit"), F.col("places").alias("pos"), F.col("roles").alias("role"))
    spread = solved.where("audit <> ''").select(*key, F.posexplode(zipped).alias("place", "e"))
    edits = spread.select(*key, "place", F.col("e.edit").alias("edit"), F.col("e.pos").alias("pos"), F.col("e.role").alias("role"))
    return Repair(turns, edits, _report(faulty, runs, ends, solved))


def _report(faulty: DataFrame, runs: DataFrame, ends: DataFrame, solved: DataFrame) -> DataFrame:
    def many(name: str) -> Column:
        return F.sum(F.col(name).cast("long")).alias(name)

    turn = F.col("turn")
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long")
    counts = faulty.groupBy("conv").agg(
        gaps.alias("gaps"), many("blank"), many("duplicate"), many("truncated"), F.count("*").alias("n_rows")
    )
    pairs = runs.select("conv", "illegal").unionByName(ends.select("conv", F.col("link").alias("illegal")))
    in_order = F.array_sort(F.collect_list(F.struct("first_pos", "audit")))
    edits = solved.groupBy("conv").agg(
        F.sum("cost").alias("cost"), F.array_join(F.transform(in_order, lambda r: r["audit"]), "").alias("audit")
    )
    return (
        counts.join(pairs.groupBy("conv").agg(F.sum("illegal").alias("illegal")), "conv")
        .join(edits, "conv")
        .select(conv_id(F.col("conv")).alias("conv_id"), "n_rows", "gaps", "blank", "duplicate", "truncated", "illegal",
                "cost", "audit")
    )


def repaired_turns(found: Repair) -> DataFrame:
    """``(conv_id, first_pos, place, role, text)``: the turns after the edits, in the order of (first_pos, place)."""
    said = found.edits.where("edit IN ('K', 'R')").join(
        found.turns.select("pos", "text", F.col("role").alias("was")), "pos"
    )
    kept = said.select("conv", "first_pos", "place", F.coalesce("role", "was").alias("role"), "text")
    added = found.edits.where("edit = 'I'").select("conv", "first_pos", "place", "role", F.lit("").alias("text"))
    every = kept.unionByName(added)
    return every.select(conv_id(F.col("conv")).alias("conv_id"), "first_pos", "place", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given another role by a checksum of their place."""
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(place) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"), kind.alias("kind"))
    hurt = rows.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )
    return hurt.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")
