"""Mix sources to target weights, in DataFrame operations only.

The words of a source, its documents laid end to end, are packed into blocks of
``block`` words. The mix is a list of slots, each holding one block:

* targets: the mix holds ``share`` times all words; sources take parts of it by weight,
  none more than ``most`` times its own words, and what a source cannot take goes to the
  others by weight (solved in closed form on the table of sources);
* slots: a pseudorandom permutation deals the slots of all sources to output shards of
  ``shard`` slots. A shard's source counts are thus multinomial draws given that the sums
  over all shards meet the targets, which free draws would miss on small tables;
* blocks: slot number ``i`` of a source means pass ``i div blocks`` over its blocks, in the
  order of a permutation of that pass. No block is used more than ``most`` times;
* the slots meet the pieces of documents by ``(source, block)``.

Permutations are "swap or not" rounds on integers: no sort, no state, the same on each
run. Running sums go through groups of chunks of documents, so neither the rows of a source nor its
chunks are ordered in one task.

Defined cases: a null text has no words and is never taken; a null source is a source,
last in order; a null ``doc_id`` is a document like any other; rows that repeat a
``doc_id`` are documents of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import n_words
from scoreloom.staging import staged

#: The weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK, SHARD = 128, 4096
#: Documents of one source whose running sum one task computes.
CHUNK = 1_000
#: Chunks of one source whose running sum one task computes.
GROUP = 1_000
#: Slots per cell of the lookup from slot number to source.
CELL = 4096
PRIME = 2_147_483_647
ROUNDS = 10


def permuted(x: str, n: str, seed: str, rounds: int = ROUNDS) -> str:
    """SQL: the place of ``x`` in a pseudorandom permutation of ``0..n-1``.

    Each round pairs ``x`` with ``k - x`` (mod ``n``) and swaps the pair or not by a hash
    of its larger member, which makes every round a permutation whatever ``n`` is.
    """
    steps = ", ".join(f"named_struct('m', {16807 + 2 * 7919 * r}L, 'c', {104729 * (r + 1)}L)" for r in range(rounds))
    key = f"((({seed}) % {PRIME} * s.m + s.c) % {PRIME})"
    other = f"((({key} * s.m + 12345) % ({n}) + ({n}) - a) % ({n}))"
    t = f"((greatest(a, {other}) % {PRIME} * s.m + {key}) % {PRIME})"
    return (
        f"aggregate(array({steps}), CAST({x} AS BIGINT), (a, s) -> "
        f"CASE WHEN ({t} * {t} % {PRIME} div 1024) % 2 = 1 THEN {other} ELSE a END)"
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, source, size, text_hash)``, written once: the text is read for its words only here."""
    return staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"),
            F.xxhash64("text").alias("text_hash"),
        ),
        "sized",
    )


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``(source, source_size, weight, target)``; a source's target stops at ``most`` times its size.

    With the sources in order of ``cap / weight``, the capped ones come first; the level
    ``(total - caps so far) / (weights left)`` of the first source that stays below its
    cap is the level of all sources after it.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1)
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = sources.withColumn("level", level).withColumn("stays", F.col("cap") > F.col("level") * F.col("weight"))
    common = F.min(F.when(F.col("stays"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.least("cap", F.coalesce(common * F.col("weight"), F.col("cap")))
    return leveled.select("source", "source_size", "weight", target.alias("target"))


def _placed(sized: DataFrame) -> DataFrame:
    """``start``: the words of the source before this document, by group of chunks, chunk and place in the chunk.

    ``row`` follows the layout of the input, so it only tells fully equal rows apart.
    """
    chunks = sized.agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.lit(1)).cast("long")).first()[0]
    rows = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(chunks)))
    totals = rows.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    bases = _chunk_bases(staged(totals, "chunks"))
    within = Window.partitionBy("source", "chunk").orderBy("doc_id", "text_hash", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = rows["source"].eqNullSafe(bases["source"]) & (rows["chunk"] == bases["chunk"])
    return rows.join(bases, same).select("row", rows["source"], "size", (F.col("inner") + F.col("base")).alias("start"))


def _chunk_bases(totals: DataFrame) -> DataFrame:
    """``(source, chunk, base)``: the words of a source before each chunk, from those before its group of chunks."""
    totals = totals.withColumn("group", F.expr(f"chunk div {GROUP}"))
    groups = totals.groupBy("source", "group").agg(F.sum("words").alias("words"))
    by_group = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("source", "group", F.coalesce(F.sum("words").over(by_group), F.lit(0)).alias("ahead"))
    by_chunk = Window.partitionBy("source", "group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("inside", F.coalesce(F.sum("words").over(by_chunk), F.lit(0)))
    same = totals["source"].eqNullSafe(groups["source"]) & (totals["group"] == groups["group"])
    return totals.join(groups, same).select(totals["source"], "chunk", (F.col("ahead") + F.col("inside")).alias("base"))


def mix_slots(sized: DataFrame, targets: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``(shard, slot, source, pass, block)``: every slot of the mix with the block it holds."""
    running = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        targets.where("source_size > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("slots", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
        .withColumn("first", F.coalesce(F.sum("slots").over(running), F.lit(0)))
        .withColumn("key", F.pmod(F.xxhash64("source"), F.lit(PRIME)))
        .where("slots > 0")
    )
    plan = staged(plan.select("source", "blocks", "slots", "first", "key"), "mix-plan")
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    cells = plan.select("*", F.explode(F.expr(f"sequence(first div {CELL}, (first + slots - 1) div {CELL})")).alias("cell"))
    slots = plan.sparkSession.range(total).select(
        F.col("id").alias("slot"),
        F.expr(f"id div {shard}").alias("shard"),
        F.expr(permuted("id", f"{max(total, 1)}L", "20241L")).alias("dealt"),
    )
    slots = slots.withColumn("cell", F.expr(f"dealt div {CELL}")).join(cells, "cell")
    slots = slots.where("dealt >= first AND dealt < first + slots").withColumn("i", F.expr("dealt - first"))
    return slots.select(
        "shard", "slot", "source", F.expr("i div blocks").alias("pass"),
        F.expr(permuted("i % blocks", "blocks", "key + 31 * (i div blocks)")).alias("block"),
    )


def mix_sources(
    docs: DataFrame, sized: DataFrame | None = None, targets: DataFrame | None = None, block: int = BLOCK, shard: int = SHARD
) -> DataFrame:
    """The mix: ``(shard, slot, source, pass, block, row, from_word, n)``, the pieces of documents in each slot.

    A piece is ``n`` words of the document ``row`` (see ``sized_documents``) from its word
    number ``from_word`` on; pieces of a slot in order of ``at``, their place in the block.
    """
    sized = sized if sized is not None else sized_documents(docs)
    targets = targets if targets is not None else source_targets(sized)
    last = f"(start + size - 1) div {block}"
    pieces = _placed(sized).where("size > 0").select("*", F.explode(F.expr(f"sequence(start div {block}, {last})")).alias("b"))
    begin = F.greatest("start", F.col("b") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block)
    pieces = pieces.select(
        F.col("source").alias("s"), "b", "row", (begin - F.col("start")).alias("from_word"), (end - begin).alias("n"),
        (begin - F.col("b") * block).alias("at"),
    )
    slots = mix_slots(sized, targets, block, shard)
    joined = slots.join(pieces, slots["source"].eqNullSafe(pieces["s"]) & (slots["block"] == pieces["b"]))
    return joined.select("shard", "slot", "source", "pass", "block", "row", "from_word", "n", "at")


def shard_counts(slots: DataFrame) -> DataFrame:
    """``(shard, source, n_slots)``: how many blocks of each source a shard drew."""
    return slots.groupBy("shard", "source").agg(F.count(F.lit(1)).alias("n_slots"))


def words_taken(docs: DataFrame, **options) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes, repeats counted."""
    sized = sized_documents(docs)
    targets = staged(source_targets(sized), "targets")
    taken = mix_sources(docs, sized, targets, **options).groupBy("row").agg(F.sum("n").alias("taken"))
    rows = sized.join(taken, "row", "left")
    known = targets.withColumnRenamed("source", "s")
    return rows.join(known, rows["source"].eqNullSafe(known["s"])).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
    )


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix as text: ``(shard, slot, source, text)``, words of a slot joined by one space."""
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    held = staged(numbered.select(F.col("__row").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), "text"), "mix-texts")
    sized = held.select("row", "doc_id", "source", "size", "text_hash")
    pieces = mix_sources(docs, sized, staged(source_targets(sized), "targets"), **options)
    cut = held.select("row", words.alias("words")).join(pieces, "row")
    cut = cut.select("shard", "slot", "source", "at", F.slice("words", F.col("from_word").cast("int") + 1, F.col("n").cast("int")).alias("w"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "w")))
    return cut.groupBy("shard", "slot", "source").agg(ordered.alias("p")).select(
        "shard", "slot", "source", F.array_join(F.flatten(F.transform("p", lambda x: x["w"])), " ").alias("text")
    )
