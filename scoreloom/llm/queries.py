"""The operators as queries with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from scoreloom.llm import (
    chat, decontaminate, exact_dedup, langid, licenses, lm, mixing, near_dedup, packing, pii, repair,
    search, substrings,
)
from scoreloom.llm.common import map_batches

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op7_mix_sources(spark, sf):
    return mixing.words_taken(table(spark, sf, "documents"))


@query
def op9_exact_dedup(spark, sf):
    found = exact_dedup.exact_duplicates(table(spark, sf, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_digest")).alias("text_sha256")
    )


ORACLES["op9_exact_dedup"] = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""


@query
def op4_near_dedup(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


@query
def op1_decontaminate(spark, sf):
    found = decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    best = F.array_sort(F.collect_list("item_id")).alias("item_ids")
    return found.groupBy("doc_id").agg(best, F.max("similarity").alias("similarity"))


@query
def op10_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    found = langid.identify(docs, langid.train_network(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op5_license_scan(spark, sf):
    docs = table(spark, sf, "documents")
    return licenses.scan_licenses(docs, licenses.train_classifier(docs))


def _chat_digest(batch):
    out = {name: [] for name in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
    rows = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True)
    for conv_id, formatted, loss in rows:
        turns = chat.read_back(formatted)
        learned = "".join(chat.unescape(formatted[r["start"] : r["end"]]) for r in loss)
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        values = (conv_id, len(turns), _hex(said), len(learned), _hex(learned), len(formatted))
        for name, value in zip(out, values, strict=True):
            out[name].append(value)
    return out


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@query
def op6_chat_format(spark, sf):
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    rows = given.unionByName(spark.createDataFrame(extra, given.schema))
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return map_batches(chat.format_conversations(rows), _chat_digest, schema)


@query
def op8_lm_score(spark, sf):
    found = lm.score_documents(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_backoff", F.round("score", 6).alias("score"))


def op8_lm_score_order3(spark, sf):
    """Up to two words of context; beyond the check's limits (README), so registered beside the query of bigrams."""
    found = lm.score_documents(table(spark, sf, "documents"), order=3)
    return found.select("doc_id", "n_words", "n_backoff", F.round("score", 6).alias("score"))


ORACLES["op8_lm_score"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w[i] AS b, CASE WHEN i > 1 THEN w[i - 1] END AS a
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT b, count(*) AS n FROM p GROUP BY b),
g AS (SELECT a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY a, b),
s AS (SELECT p.doc_id, p.a IS NOT NULL AND g.n < 2 AS backed,
             CASE WHEN p.a IS NULL THEN ln(u.n / (SELECT count(*) FROM p))
                  WHEN g.n >= 2 THEN ln(g.n / c.n) ELSE ln(u.n / (SELECT count(*) FROM p)) + ln(0.4) END AS l
      FROM p JOIN u ON u.b = p.b LEFT JOIN g ON g.a = p.a AND g.b = p.b LEFT JOIN u c ON c.b = p.a)
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words,
       CAST(count(*) FILTER (WHERE backed) AS BIGINT) AS n_backoff, round(coalesce(sum(l), 0), 6) AS score
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
ORACLES["op6_chat_format"] = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(text, '([\\<\[\]])', '\\\1', 'g'))
           + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
             ELSE 14 + length(regexp_replace(role, '([\\<\[\]])', '\\\1', 'g')) END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


@query
def op2_substring_dedup(spark, sf):
    found = substrings.remove_repeated(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op2_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS least FROM p GROUP BY g),
r AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT p.doc_id, p.i FROM p JOIN f USING (g) WHERE f.least < p.doc_id) x,
      (SELECT unnest(range(0, 13)) AS k) y),
e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
k AS (SELECT e.doc_id, count(*) AS kept, string_agg(x, ' ' ORDER BY e.i) AS t
      FROM e LEFT JOIN r ON r.doc_id = e.doc_id AND r.i = e.i WHERE r.i IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@query
def op3_pii(spark, sf):
    found = pii.personal_spans(table(spark, sf, "documents"))
    counts = [pii.n_of_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE]
    every = pii.span_list(F.concat("base", "added"))
    return found.select(
        "doc_id", *counts, F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"), every.alias("spans")
    )


@query
def op11_pack_sequences(spark, sf):
    pieces = packing.pack(table(spark, sf, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op12_repair_structure(spark, sf):
    given = table(spark, sf, "conversations")
    found = repair.repair(repair.damaged(given))
    line = F.struct("first_pos", "place", F.concat_ws(":", "role", "text").alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda r: r["line"])
    texts = repair.repaired_turns(found).groupBy("conv_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha"))
    ids = given.select(F.col("conv_id").cast("long")).distinct()
    for right in (found.report, texts):
        named = right.withColumnRenamed("conv_id", "id")
        ids = ids.join(named, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return ids.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"),
    )


#: A path is (cost in nine digits, letters): the least string is the cheapest path, and of those the first by letters.
#: The walk goes from the last row to the first, as letters put in front keep the order of two paths.
ORACLES["op12_repair_structure"] = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
             string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
             lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END),
             4294967295) % 20 AS kind
  FROM conversations),
h AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(0, CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS r,
             right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM h),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             lead(r) OVER (PARTITION BY conv_id ORDER BY i) AS next_r FROM o),
f AS (SELECT conv_id, i, n, turn, role, text, r, next_r, last = '' AS blank, last <> '' AND again AS dup,
             last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS cut,
             CASE WHEN last = '' OR again THEN 999 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS more FROM d),
w AS (  -- e, s, u, a: the best way on from before row i, after nothing, a system, a user or an assistant turn
  SELECT conv_id, n + 1 AS i, '000000000' AS e, '000000006II' AS s, '000000003I' AS u, '000000000' AS a
  FROM f WHERE i = n
  UNION ALL
  SELECT conv_id, i, least(e1, add_front(3, 'I', u2)), least(s1, add_front(3, 'I', u2)), u2, least(a1, add_front(3, 'I', u1))
  FROM (SELECT *, least(u1, add_front(3, 'I', a1)) AS u2 FROM (
    SELECT f.conv_id, f.i,
      least(add_front(4, 'D', w.e), add_front(more + 3, 'R', w.u),
            CASE r WHEN 's' THEN add_front(more, 'K', w.s) WHEN 'u' THEN add_front(more, 'K', w.u) ELSE '9' END) AS e1,
      least(add_front(4, 'D', w.s), add_front(more + 3, 'R', w.u), CASE r WHEN 'u' THEN add_front(more, 'K', w.u) ELSE '9' END) AS s1,
      least(add_front(4, 'D', w.u), add_front(more + 3, 'R', w.a), CASE r WHEN 'a' THEN add_front(more, 'K', w.a) ELSE '9' END) AS u1,
      least(add_front(4, 'D', w.a), add_front(more + 3, 'R', w.u), CASE r WHEN 'u' THEN add_front(more, 'K', w.u) ELSE '9' END) AS a1
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i - 1))),
b AS (SELECT conv_id, left(e, 9)::BIGINT AS cost, substr(e, 10) AS audit FROM w WHERE i = 1),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS j FROM b WHERE audit <> ''),
m AS (SELECT *, CASE WHEN edit <> 'I' THEN count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY conv_id ORDER BY j) END AS i FROM l),
t AS (SELECT m.conv_id, j, edit, role, text, row_number() OVER (PARTITION BY m.conv_id ORDER BY j)
             + CASE WHEN first_value(left(role, 1)) OVER (PARTITION BY m.conv_id ORDER BY j) = 's'
                     AND first_value(edit) OVER (PARTITION BY m.conv_id ORDER BY j) = 'K' THEN 1 ELSE 0 END AS nth
      FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i WHERE edit <> 'D'),
x AS (SELECT conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN role ELSE CASE nth % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
             || ':' || CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM t GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
             count(*) FILTER (WHERE next_r IS NOT NULL AND r || next_r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM c.conv_id
"""
ORACLES["op12_repair_structure"] = re.sub(
    r"add_front\(([^,]+), ('[A-Z]'), ([\w.]+)\)",
    r"(lpad(CAST(left(\3, 9)::BIGINT + \1 AS VARCHAR), 9, '0') || \2 || substr(\3, 10))",
    ORACLES["op12_repair_structure"],
)


@query
def op13_search_documents(spark, sf):
    found = search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


ORACLES["op13_search_documents"] = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY doc_id, t),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM n, s),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY t, docs),
q AS (SELECT item_id, t, count(*) AS times FROM i GROUP BY item_id, t),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN c USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 20
"""
