"""Reply trees to conversations: best root-to-leaf path per tree, in a chat format.

* ``numbered_turns`` turns rows ``(conv_id, turn, role, text)`` into trees: a row replies to the
  row before it in its conversation.
* ``best_paths`` finds paths by iterative self-joins. Each round doubles how far every node
  sees towards its root, so a path of 400 replies takes 9 rounds; the written tables of the
  rounds then give the nodes of the chosen paths. Branches are ranked by mean score, then by
  depth, then by smaller leaf; each tree's best one is chosen by an aggregate.
* ``format_paths`` writes a path as one text. Role marks are control strings; inside texts every
  character that could begin one is escaped, so ``read_back`` returns the very turns. The
  loss mask lists the code point ranges of assistant texts.

Defined cases: a null text is empty, a null role is the empty role; a null ``conv_id`` makes
each row a conversation of its own; equal ``(conv_id, turn)`` rows follow one another by role, then text; a parent
that does not exist makes a node a root; nodes of a cycle lead to no root and are in no path;
an empty table gives no conversation; further columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import map_batches
from scoreloom.staging import staged

#: The marks of the format.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, ROLE_MID, ROLE_END = "[ROLE:", "]", "[/ROLE]"
_TURN = re.compile(
    r"(?:(?P<open><<SYS>>|\[INST\]|<s>)|\[ROLE:(?P<role>(?:[^\\<\[\]]|\\.)*)\])"
    r"(?P<text>(?:[^\\<\[]|\\.)*)(?:<</SYS>>|\[/INST\]|</s>|\[/ROLE\])",
    re.S,
)
_OPENED = {marks[0]: role for role, marks in MARKS.items()}
FORMATTED = "conv_id long, formatted string, loss array<struct<start: int, end: int>>"


def escape(text: str) -> str:
    return re.sub(r"[\\<\[\]]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The text of a conversation and the ranges the loss is taken on."""
    parts: list[str] = []
    loss: list[dict] = []
    at = 0
    for role, text in turns:
        before, after = MARKS.get(role) or (ROLE + escape(role) + ROLE_MID, ROLE_END)
        body = escape(text)
        if role == "assistant":
            loss.append({"start": at + len(before), "end": at + len(before) + len(body)})
        parts += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(parts), loss


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((_OPENED[m["open"]] if m["open"] else unescape(m["role"]), unescape(m["text"])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a formatted conversation from character {at} on")
    return turns


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, conv_id, parent, score)`` and ``(node, role, text)``, each written once."""
    rows = staged(
        conversations.select(
            F.monotonically_increasing_id().alias("node"), F.col("conv_id").cast("long"), "turn",
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        ),
        "turns",
    )
    before = Window.partitionBy("conv_id", F.when(F.isnull("conv_id"), F.col("node"))).orderBy("turn", "role", "text", "node")
    links = rows.select("node", "conv_id", F.lag("node").over(before).alias("parent"))
    return staged(links.withColumn("score", F.lit(0.0)), "replies"), rows.select("node", "role", "text")


def best_paths(nodes: DataFrame) -> DataFrame:
    """``(leaf, node, place)``: the nodes of the best path of each tree of ``nodes(node, parent, score)``."""
    known = nodes.select(F.col("node").alias("p"))
    seen = nodes.join(known, nodes["parent"] == known["p"], "left").select(
        "node", F.col("p").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"),
        F.col("node").alias("top"),
    )
    seen = staged(seen, "jump")
    rounds = [seen]
    inner = seen.select(F.col("up").alias("node")).where("node IS NOT NULL").distinct()
    most = nodes.count().bit_length() + 1
    while len(rounds) <= most and not seen.where("up IS NOT NULL").isEmpty():
        far = seen.select(*[F.col(c).alias(f"{c}_") for c in seen.columns])
        joined = seen.join(far, seen["up"] == far["node_"], "left")
        seen = staged(
            joined.select(
                "node", F.col("up_").alias("up"), (F.col("depth") + F.coalesce("depth_", F.lit(0))).alias("depth"),
                (F.col("total") + F.coalesce("total_", F.lit(0.0))).alias("total"), F.coalesce("top_", "top").alias("top"),
            ),
            "jump",
        )
        rounds.append(seen)
    leaves = seen.where("up IS NULL").join(inner, "node", "left_anti")
    best = F.max(F.struct((F.col("total") / F.col("depth")).alias("mean"), "depth", (-F.col("node")).alias("minus")))
    chosen = leaves.groupBy("top").agg(best.alias("b")).select((-F.col("b.minus")).alias("leaf"), F.col("b.depth").alias("depth"))
    path = chosen.select("leaf", F.col("leaf").alias("node"), F.col("depth").alias("place"))
    for k, jump in enumerate(rounds[:-1]):
        up = jump.where("up IS NOT NULL").select("node", "up")
        path = staged(path.unionByName(
            path.join(up, "node").select("leaf", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        ), "path")
    return path


def _formatted(batch: pa.RecordBatch) -> dict:
    made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
    return {"conv_id": batch.column("conv_id"), "formatted": [m[0] for m in made], "loss": [m[1] for m in made]}


def format_paths(paths: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per path: ``(conv_id, formatted, loss)``."""
    turns = F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    rows = paths.join(texts, "node").groupBy("leaf").agg(turns)
    named = rows.join(nodes.select(F.col("node").alias("leaf"), "conv_id"), "leaf").select("conv_id", "turns")
    return map_batches(named, _formatted, FORMATTED)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Every conversation of ``conversations(conv_id, turn, role, text)`` as one formatted text."""
    nodes, texts = numbered_turns(conversations)
    return format_paths(best_paths(nodes), nodes, texts)
