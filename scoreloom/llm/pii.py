"""Personal data: base spans by fixed rules, further spans by boosted trees over candidates.

Everything is DataFrame work on arrays inside the row; no text is shuffled.

* *Base.* Four kinds, leftmost non-overlapping per kind, matches that fail their check dropped.
* *Candidates.* Four generous generators propose spans that may overlap one another and the base.
* *Features* of format (digits, letters, separators, dots, checks) and context (words before,
  character before) have few levels each, so the whole corpus boils down to a table of
  feature combinations with counts. Its size is bounded by the product of the levels, not by data.
* *Training.* A candidate is positive where it overlaps a base span, or assigns a long mixed value
  to a secret's name. Trees of depth two are boosted on one half of the documents.
* *Calibration.* On the other half, each generator gets the lowest score, even odds at least, from which on
  ``PRECISE`` of its candidates are positive, however many there are; even odds where it has none. Candidates at
  or above it that touch no base span are added, the best of overlapping ones; an assignment of a long mixed
  value to a secret's name is a candidate whatever the trees have learned.

Regex quantifiers are possessive where giving back could not help, and start only where a
match may begin, so time is linear in the text.

Defined cases: a null text is empty and has no spans; a repeated row is treated alike; an empty
table gives an empty result and trains nothing; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.staging import staged

#: Base kinds in order, with a cheap test that no match fails.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
GENERATORS = {
    "mail": (r"(?<![^\x00-\x20<>\"',;:@])[^\x00-\x20<>\"',;:@]++ ?(?:@|\[at\]|\(at\)) ?[^\x00-\x20<>\"',;:@]++", r"@|\[at\]|\(at\)"),
    "number": (r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().:/-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])", r"[0-9]"),
    "address": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}+(?![0-9])", r"[0-9]\.[0-9]"),
    "secret": (r"(?<![A-Za-z_])[A-Za-z_]{2,}+ ?[=:] ?[\"']?[A-Za-z0-9+/_-]{16,}+[\"']?", r"[=:] ?[\"']?[A-Za-z0-9+/_-]{16}"),
}
NAMES = {"mail": "x_mail", "number": "x_number", "address": "x_address", "secret": "x_secret"}
SECRET_WORDS = r"(?i)(token|secret|passw|api.?key|credential)"
PHONE_WORDS = r"(?i)(tel|phone|call|fax|mobile|card|account|iban|mail|contact)"
FEATURES = ("gen", "digits", "letters", "plus", "seps", "dots", "at", "luhn", "octets", "context", "before")
ROUNDS, RATE, PRECISE, CONTEXT = 20, 0.4, 0.95, 24
#: Matches whose lengths are summed one by one.
RUN = 128


def matches(text: Column, pattern: str, when: Column) -> tuple[Column, Column]:
    """The matches of a pattern, and the lengths of the gaps around them."""
    found = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    gaps = F.when(when, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array(F.lit(0)))
    return found, gaps


def advance(found: str, gaps: str) -> Column:
    """How far each match and the gap before it lead."""
    return F.expr(f"zip_with(slice({gaps}, 1, size({found})), {found}, (g, p) -> g + length(p))")


def spans(found: str, gaps: str, steps: str) -> Column:
    """``array<struct<start, end, piece>>`` from the columns of ``matches``, in code points."""
    # the sum before each run once, then within the run
    bases = (
        f"transform(sequence(0, CAST((size({found}) - 1) div {RUN} AS INT)), c -> named_struct("
        f"'at', c * {RUN}, 'sum', aggregate(slice({steps}, 1, c * {RUN}), 0, (a, x) -> a + x)))"
    )
    runs = (
        f"flatten(transform({bases}, r -> transform(slice({found}, r.at + 1, {RUN}), (p, i) -> named_struct("
        f"'start', r.sum + aggregate(slice({steps}, r.at + 1, i), 0, (a, x) -> a + x)"
        f" + element_at({gaps}, r.at + i + 1), 'piece', p))))"
    )
    whole = f"transform({runs}, s -> named_struct('start', s.start, 'end', s.start + length(s.piece), 'piece', s.piece))"
    none = "CAST(array() AS array<struct<start: int, end: int, piece: string>>)"
    return F.expr(f"CASE WHEN size({found}) = 0 THEN {none} ELSE {whole} END")


def _digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def valid(kind: str, piece: Column) -> Column:
    digits = _digits(piece)
    if kind == "ip":
        return F.forall(F.split(piece, r"\."), lambda p: p.try_cast("double") <= 255)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _level(value: Column, *limits: int) -> Column:
    """How many of the limits the value reaches."""
    return sum((F.when(value >= n, 1).otherwise(0) for n in limits), F.lit(0))


def _touches(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _candidate(gen: int, text: Column, base: Column):
    def make(s: Column) -> Column:
        piece, start = s["piece"], s["start"]
        digits = _digits(piece)
        before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
        last = F.substring(text, start, F.least(start, F.lit(1)))
        value = F.regexp_extract(piece, r"([A-Za-z0-9+/_-]{16,})[\"']?$", 1)
        named = F.rlike(piece, F.lit(SECRET_WORDS)) & F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]"))
        secret = named if gen == 3 else F.lit(False)
        octets = F.coalesce(F.forall(F.split(piece, r"\."), lambda p: p.try_cast("double") <= 255), F.lit(False))
        return F.struct(
            start.alias("start"), s["end"].alias("end"), F.lit(gen).alias("gen"),
            _level(F.length(digits), 7, 9, 13, 16, 20).alias("digits"),
            _level(F.length(F.regexp_replace(piece, "[^A-Za-z]", "")), 1, 4, 16).alias("letters"),
            piece.startswith("+").cast("int").alias("plus"),
            _level(F.length(F.regexp_replace(piece, "[^ ()-]", "")), 1, 3).alias("seps"),
            _level(F.length(F.regexp_replace(piece, "[^.]", "")), 1, 3).alias("dots"),
            F.contains(piece, F.lit("@")).cast("int").alias("at"),
            F.coalesce(F.call_function("luhn_check", digits), F.lit(False)).cast("int").alias("luhn"),
            octets.cast("int").alias("octets"),
            F.when(F.rlike(F.concat(before, piece), F.lit(SECRET_WORDS)), 1).when(F.rlike(before, F.lit(PHONE_WORDS)), 2).otherwise(0).alias("context"),
            F.when(F.rlike(last, F.lit(r"^\s?$")), 0).when(F.rlike(last, F.lit(r"\p{L}")), 1).otherwise(2).alias("before"),
            F.exists(base, lambda b: _touches(b, s)).alias("known"), secret.alias("secret"),
        )

    return make


def _base_spans(order: int, kind: str) -> Column:
    named = lambda s: F.struct(
        F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")
    )
    return F.transform(F.filter(f"s_{kind}", lambda s: valid(kind, s["piece"])), named)


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, found)`` per row of ``docs(doc_id, text)``: base spans with kinds, candidates with features."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    columns = {}
    digit = F.rlike(text, F.lit("[0-9]"))
    for kind, (pattern, sign) in BASE.items():
        columns[f"b_{kind}"], columns[f"g_{kind}"] = matches(text, pattern, F.contains(text, F.lit(sign)) if sign else digit)
    for name, (pattern, test) in GENERATORS.items():
        columns[f"b_{name}"], columns[f"g_{name}"] = matches(text, pattern, F.rlike(text, F.lit(test)))
    rows = rows.withColumns(columns)
    kinds = [*BASE, *GENERATORS]
    rows = rows.withColumns({f"a_{k}": advance(f"b_{k}", f"g_{k}") for k in kinds})
    rows = rows.select("doc_id", "text", *[spans(f"b_{k}", f"g_{k}", f"a_{k}").alias(f"s_{k}") for k in kinds])
    kept = [_base_spans(order, kind) for order, kind in enumerate(BASE)]
    rows = rows.select("doc_id", "text", F.concat(*kept).alias("base"), *[f"s_{g}" for g in GENERATORS])
    found = F.concat(*[F.transform(f"s_{g}", _candidate(k, text, F.col("base"))) for k, g in enumerate(GENERATORS)])
    return rows.select("doc_id", "base", found.alias("found"))


def combinations(found: DataFrame) -> list[dict]:
    """Candidates counted by features, half of the documents and label."""
    rows = found.select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"), F.explode("found").alias("c"))
    label = F.col("c.known") | F.col("c.secret")
    grouped = rows.groupBy("half", *[F.col(f"c.{f}").alias(f) for f in FEATURES])
    return [r.asDict() for r in grouped.agg(
        F.sum(F.when(label, 1).otherwise(0)).alias("yes"), F.sum(F.when(label, 0).otherwise(1)).alias("no")
    ).collect()]


class Trees:
    """Boosted trees of depth two over small whole-number features."""

    def __init__(self):
        self.start, self.trees = 0.0, []
        self.least = [math.inf] * len(GENERATORS)

    def score(self, row: dict) -> float:
        return self.start + sum(_walk(t, row) for t in self.trees)

    def train(self, rows: list[dict]) -> None:
        yes, no = sum(r["yes"] for r in rows), sum(r["no"] for r in rows)
        self.start = math.log((yes + 1) / (no + 1))
        scores = [self.start] * len(rows)
        for _ in range(ROUNDS if rows else 0):
            grads = []
            for r, s in zip(rows, scores, strict=True):
                p = 1 / (1 + math.exp(-s))
                n = r["yes"] + r["no"]
                grads.append((r["yes"] - n * p, n * p * (1 - p)))
            tree = _grow(rows, grads, list(range(len(rows))), 2)
            self.trees.append(tree)
            scores = [s + _walk(tree, r) for s, r in zip(scores, rows, strict=True)]

    def calibrate(self, rows: list[dict]) -> None:
        for gen in range(len(GENERATORS)):
            yes = no = 0
            own = sorted(((self.score(r), r) for r in rows if r["gen"] == gen), key=lambda x: -x[0])
            for k, (score, r) in enumerate(own):
                yes, no = yes + r["yes"], no + r["no"]
                last = k + 1 == len(own) or own[k + 1][0] < score
                if last and score >= 0 and yes >= PRECISE * (yes + no):
                    self.least[gen] = score
            if not own:
                self.least[gen] = 0.0

    def column(self, row: Column) -> Column:
        return sum((_case(t, row) for t in self.trees), F.lit(self.start))


def _grow(rows: list[dict], grads: list[tuple], inside: list[int], depth: int):
    g, h = sum(grads[i][0] for i in inside), sum(grads[i][1] for i in inside)
    best, split = 1e-6, None
    for f in FEATURES if depth else ():
        levels: dict[int, list[float]] = {}
        for i in inside:
            s = levels.setdefault(rows[i][f], [0.0, 0.0])
            s[0] += grads[i][0]
            s[1] += grads[i][1]
        left_g = left_h = 0.0
        for v in sorted(levels)[:-1]:
            left_g, left_h = left_g + levels[v][0], left_h + levels[v][1]
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            if gain > best:
                best, split = gain, (f, v)
    if split is None:
        return RATE * g / (h + 1)
    f, v = split
    low = [i for i in inside if rows[i][f] <= v]
    high = [i for i in inside if rows[i][f] > v]
    return f, v, _grow(rows, grads, low, depth - 1), _grow(rows, grads, high, depth - 1)


def _walk(tree, row: dict) -> float:
    while isinstance(tree, tuple):
        f, v, low, high = tree
        tree = low if row[f] <= v else high
    return tree


def _case(tree, row: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, v, low, high = tree
    return F.when(row[f] <= v, _case(low, row)).otherwise(_case(high, row))


def train_trees(found: DataFrame) -> Trees:
    rows = combinations(found)
    trees = Trees()
    trees.train([r for r in rows if r["half"] == 0])
    trees.calibrate([r for r in rows if r["half"] == 1])
    return trees


def personal_spans(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """``(doc_id, base, added)`` per row: arrays of ``(order, kind, start, end)``, ordered."""
    # written, so texts are searched once for training and choosing, and the optimizer has no search to repeat per field
    found = staged(candidates(docs), "candidates")
    trees = trees if trees is not None else train_trees(found)
    scored = F.transform(
        F.filter("found", lambda c: ~c["known"]),
        lambda c: F.struct(
            trees.column(c).alias("score"), c["start"].alias("start"), c["end"].alias("end"), c["gen"].alias("gen"),
            c["secret"].alias("secret"),
        ),
    )
    least = F.array(*[F.lit(x) for x in trees.least])
    rows = found.select("doc_id", "base", scored.alias("scored"))
    rows = rows.select("doc_id", "base", F.filter(
        "scored", lambda c: c["secret"] | (c["score"] >= F.element_at(least, c["gen"] + 1))
    ).alias("chosen"))

    def beaten(c: Column) -> Column:
        rank = lambda x: F.struct(x["score"], x["end"] - x["start"], -x["gen"])
        return F.exists("chosen", lambda d: _touches(c, d) & (rank(d) > rank(c)))

    names = F.array(*[F.lit(NAMES[g]) for g in GENERATORS])
    added = F.transform(F.filter("chosen", lambda c: ~beaten(c)), lambda c: F.struct(
        (c["gen"] + len(BASE)).alias("order"), F.element_at(names, c["gen"] + 1).alias("kind"),
        c["start"].alias("start"), c["end"].alias("end"),
    ))
    return rows.select("doc_id", "base", F.array_sort(added).alias("added"))


def span_list(of: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def n_of_kind(of: Column, kind: str) -> Column:
    return F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long")
