"""The same results in plain SQL, for another engine to check against.

Nothing here is used by the Spark jobs. The statements are built from common
table expressions named by what they hold.
"""

from __future__ import annotations

from scoreloom import constants as K
from scoreloom.config import DEFAULT, RewardConfig
from scoreloom.functions.text import WHITESPACE
from scoreloom.sources.derived import FIRST_SECOND
from scoreloom.plans.queries import FROM_MAPPING, LITERAL, PAGE_TAGS, SESSION_GAP_MS, SWEEP, TEXT_CAP, TIGHT_CLAMP

ORDER = tuple(K.DEFAULT_WEIGHTS)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def d(value: float) -> str:
    return f"CAST({float(value)!r} AS DOUBLE)"


def r6(expr: str) -> str:
    return f"round({expr}, 6) + CAST(0 AS DOUBLE)"


def runs(blocks) -> str:
    return "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in blocks) + "]"


ARABIC = q(runs(K.ARABIC_BLOCKS))
SPACES = q(runs(K.WHITESPACE_RUNS) + "+")


def strip(expr: str) -> str:
    return f"trim({expr}, {q(WHITESPACE)})"


def words(expr: str) -> str:
    bare = strip(expr)
    return f"(CASE WHEN {bare} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex({bare}, {SPACES}) END)"


def digits(expr: str) -> str:
    return f"translate(coalesce({expr}, ''), {q(K.ASCII_DIGITS)}, {q(K.ARABIC_DIGITS)})"


def any_of(column: str, entries) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in entries) + ")"


# the inputs are stated here on their own, so that a slip in the Spark side's shows
SC = """docs AS (SELECT *, coalesce(text, '') AS t, doc_id % 10 AS k FROM documents), sc AS (
 SELECT doc_id AS comp_id, doc_id // 4 AS prompt_id, CAST(doc_id % 4 AS INT) AS gen_idx, lang, source,
  CASE WHEN k = 1 THEN '<think>بسبب ' || repeat('ن', doc_id % 23) || '</think><answer>من ' || t || '</answer>'
   WHEN k = 2 THEN '<answer>من ' || t || '</answer><think>بسبب ' || repeat('ن', doc_id % 23) || '</think>'
   WHEN k = 3 THEN '<think>من ' || t WHEN k = 4 THEN 'من ' || t || '</think>'
   WHEN k = 5 THEN '<answer>من ' || t || '</answer>' WHEN k = 6 THEN repeat('ب', 1 + doc_id % 97) || ' ' || t
   WHEN k = 7 THEN 'أنا آسف من ' || t WHEN k = 8 THEN 'لأن ' || repeat('ت', doc_id % 80) || ' ' || t || ' ما هذا؟'
   ELSE t END AS completion FROM docs
 UNION ALL
 SELECT -doc_id - 1, doc_id // 4, CAST(4 + doc_id % 4 AS INT), lang, source,
  [ '', repeat('ب', 1 + doc_id % 97), '<think>بسبب ' || repeat('ن', doc_id % 23) || '</think><answer>لأن</answer>',
    'لأن ' || repeat('ت', doc_id % 80) || ' ما هذا؟' ][1 + doc_id % 4] FROM docs)"""

PAIRS = """pairs AS (
 SELECT conv_id, turn, text AS user_text, nt AS assistant_text FROM (
  SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations) p
 WHERE role = 'user' AND nr = 'assistant')"""
SI = f"""{PAIRS}, dressed AS (
 SELECT conv_id, turn, concat(user_text, ' ', conv_id) AS instruction,
  CASE WHEN conv_id % 4 = 3 THEN 'ctx ' || turn WHEN conv_id % 4 = 1 THEN '   ' WHEN conv_id % 4 = 0 THEN '' END AS context,
  [assistant_text, assistant_text[1:40] || ' إذن، ' || assistant_text[41:], 'إذن، ' || assistant_text,
   assistant_text || ' إذن،  ', '   ' || assistant_text, assistant_text || '   ',
   assistant_text || ' 2024 إذن، أ إذن، ب'][1 + conv_id % 7] AS answer FROM pairs), si AS (
 SELECT conv_id * 4294967296 + turn AS ex_id, conv_id, instruction, context, answer FROM dressed
 UNION ALL
 SELECT -(conv_id * 4294967296 + turn) - 1, conv_id, instruction, context, CASE WHEN conv_id % 2 = 0 THEN '' ELSE '   ' END
 FROM dressed)"""
MARK = q(K.ANSWER_MARKER)
PARTS = f"""{SI}, dg AS (
 SELECT ex_id, instruction, {digits('answer')} AS ans,
  {strip(digits(f"CASE WHEN {strip('coalesce(context, chr(32))')} <> '' THEN concat(context, {q(K.CONTEXT_SEPARATOR)}, instruction) ELSE instruction END"))} AS user_query
 FROM si), parts AS (
 SELECT ex_id, instruction, user_query,
  CASE WHEN strpos(ans, {MARK}) > 0 THEN {strip(f"split_part(ans, {MARK}, 1)")} ELSE ans END AS reasoning,
  CASE WHEN strpos(ans, {MARK}) > 0 THEN {strip(f"substr(ans, strpos(ans, {MARK}) + 4)")} ELSE '' END AS final
 FROM dg), rs AS (
 SELECT *, CASE WHEN reasoning <> '' AND final <> '' THEN '<think>' || reasoning || '</think><answer>' || final || '</answer>'
  WHEN final <> '' THEN '<think>' || {q(K.PLACEHOLDER_REASONING)} || '</think><answer>' || final || '</answer>'
  WHEN reasoning <> '' THEN '<think>' || reasoning || '</think><answer>' || reasoning || '</answer>'
  ELSE '' END AS response FROM parts)"""


def turn(role: str, content: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {content} || '<|im_end|>' || chr(10)"


OPENER = "'<|im_start|>assistant' || chr(10)"
SYSTEM = turn("system", q(K.SYSTEM_PROMPT))
TRAIN_TEXT = f"{SYSTEM} || {turn('user', 'user_query')} || {turn('assistant', 'response')}"
TEXTS = f"{PARTS}, tx AS (SELECT ex_id, {TRAIN_TEXT} AS text FROM rs)"


def tag(column: str, name: str, body: str) -> str:
    opening, closing = f"<{name}>", f"</{name}>"
    rest = f"substr({body}, strpos({body}, {q(opening)}) + {len(opening)})"
    inside = f"CASE WHEN strpos({body}, {q(opening)}) > 0 AND strpos({rest}, {q(closing)}) > 0"
    if column == "body":
        return f"{inside} THEN substr({rest}, 1, strpos({rest}, {q(closing)}) - 1) END"
    if column == "complete":
        return f"{inside} THEN 1 ELSE 0 END"
    return f"strpos({body}, {q(opening)})"


def measured(config: RewardConfig = DEFAULT, source: str = "sc", first: str = "think", then: str = "answer") -> str:
    c = "completion"
    return f"""me AS (SELECT *, length({c}) AS n, len(regexp_extract_all({c}, {ARABIC})) AS ar,
 {tag('complete', first, c)} AS tc, {tag('complete', then, c)} AS ac,
 {tag('at', first, c)} AS ta, {tag('at', then, c)} AS aa,
 contains({c}, '<{first}>') OR contains({c}, '</{first}>') AS tp,
 contains({c}, '<{then}>') OR contains({c}, '</{then}>') AS ap,
 {any_of(c, config.keywords_to_reward)} AS kw, {any_of(c, config.keywords_to_penalize)} AS fw,
 {any_of(c, config.arabic_question_words)} AS qw, suffix({strip(c)}, {q(K.QUESTION_MARK)}) AS qm FROM {source})"""


def components(config: RewardConfig) -> dict[str, str]:
    t, ppc, pf = config.target_length, config.length_penalty_per_char, config.arabic_penalty_factor
    off = f"abs(n - {t})"
    pen = config.think_answer_penalty_value
    ratio = "(CAST(ar AS DOUBLE) / CAST(n AS DOUBLE))"
    return {
        "length": f"CASE WHEN n = 0 THEN {d(-t * ppc * 2)} WHEN {off} = 0 THEN {d(config.length_positive_exact)}"
        f" WHEN {off} <= {d(t * 0.15)} THEN {d(config.length_positive_close)} * ({d(1)} - {off} / {d(t * 0.15)})"
        f" ELSE -({d(0.1)} + {off} * {d(ppc)}) END",
        "arabic_only": d(-pf)
        if config.script_mode == "literal"
        else f"CASE WHEN n = 0 THEN {d(-pf)} WHEN ar = n THEN {d(pf / 2)} WHEN {ratio} > {d(0.9)} THEN {d(pf / 4)}"
        f" ELSE {d(-pf)} * ({d(1)} - {ratio}) END",
        "contains_keywords": f"CASE WHEN kw THEN {d(config.reward_keywords_value)} ELSE {d(0)} END",
        "not_contains_forbidden": f"CASE WHEN fw THEN {d(-config.forbidden_penalty_value)} ELSE {d(0)} END",
        "question_words_not_in_answer": f"CASE WHEN qw AND NOT qm THEN {d(-config.q_words_penalty_value)} ELSE {d(0)} END",
        "think_answer_tags": f"CASE WHEN tp AND tc = 0 THEN {d(pen)} ELSE {d(0)} END"
        f" + CASE WHEN ap AND ac = 0 THEN {d(pen)} ELSE {d(0)} END"
        f" + CASE WHEN tc = 1 AND ac = 1 THEN CASE WHEN ta > aa"
        f" THEN {d(config.think_answer_reward_value + config.think_answer_order_penalty)}"
        f" ELSE {d(config.think_answer_reward_value)} END"
        f" WHEN tc + ac = 1 THEN {d(pen / 2)} ELSE {d(0)} END",
    }


def scored(config: RewardConfig = DEFAULT, name: str = "rw", extra: str = "") -> str:
    parts = components(config)
    columns = ", ".join(f"{parts[s]} AS r_{s}" for s in ORDER)
    total = " + ".join(f"{d(config.weights[s])} * r_{s}" for s in ORDER) + extra
    bounds = config.clamp_rewards
    reward = f"least({d(bounds['max'])}, greatest({d(bounds['min'])}, raw_reward))" if bounds else "raw_reward"
    return f"""{name}_c AS (SELECT *, {columns} FROM me), {name}_t AS (SELECT *, {total} AS raw_reward FROM {name}_c),
 {name} AS (SELECT *, {reward} AS reward FROM {name}_t)"""


def full(config: RewardConfig = DEFAULT) -> str:
    return f"WITH {SC}, {measured(config)}, {scored(config)}"


STATS = (
    f"{r6('avg(reward)')} AS mean_reward, {r6('stddev_samp(reward)')} AS sd_reward,"
    f" {r6('min(reward)')} AS min_reward, {r6('max(reward)')} AS max_reward, count(*) AS n_rows"
)
SHARE = "CAST(count(*) FILTER (WHERE {}) AS DOUBLE) / count(*)"
RIGHT = "tc = 1 AND ac = 1 AND ta < aa"


def vocab(source: str, column: str) -> str:
    return f"""tk AS (SELECT ex_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT ex_id, {words(column)} AS ws FROM {source}) a),
 vb AS (SELECT word, row_number() OVER (ORDER BY word) + 2 AS token_id FROM (SELECT DISTINCT word FROM tk
  WHERE word NOT IN ('<|endoftext|>', '<|im_start|>', '<|im_end|>')) c),
 ids AS (SELECT ex_id, count(*) AS n_tokens, string_agg(CAST(coalesce(token_id,
   CASE word WHEN '<|im_start|>' THEN 1 WHEN '<|im_end|>' THEN 2 ELSE 0 END) AS VARCHAR), ' ' ORDER BY pos) AS input_ids
  FROM tk LEFT JOIN vb USING (word) {{where}} GROUP BY ex_id)"""


def ids(source: str, column: str, cap: int | None = None) -> str:
    return vocab(source, column).replace("{where}", f"WHERE pos <= {cap}" if cap else "")


def component(name: str, config: RewardConfig = DEFAULT) -> str:
    return f"{full(config)} SELECT comp_id, {r6(f'r_{name}')} AS score FROM rw"


def align(prompts: str) -> str:
    return f"""WITH {SC}, c AS (SELECT comp_id, row_number() OVER (ORDER BY comp_id) - 1 AS pos FROM sc),
 p AS ({prompts}), k AS (SELECT comp_id, CASE WHEN n % m = 0 THEN pos // (n // m) ELSE pos % m END AS prompt_pos
  FROM c, (SELECT count(*) AS n FROM c) x, (SELECT count(*) AS m FROM p) y)
 SELECT comp_id, CAST(prompt_pos AS BIGINT) AS prompt_pos, prompt FROM k JOIN p USING (prompt_pos)"""


def sweep() -> str:
    parts = []
    for name, config in SWEEP.items():
        parts.append(
            f"SELECT {q(name)} AS config_id, {STATS},"
            f" {r6(SHARE.format('reward <> raw_reward'))} AS share_clamped FROM w_{name}"
        )
    ctes = ", ".join(scored(config, f"w_{name}") for name, config in SWEEP.items())
    return f"WITH {SC}, {measured()}, {ctes} " + " UNION ALL ".join(parts)


def coverage() -> str:
    rows = ", ".join(f"({q(name)}, {q(word)})" for name, entries in DEFAULT.lexicon.items() for word in entries)
    return f"""WITH {SC}, lx(list, word) AS (VALUES {rows}), hit AS (
  SELECT list, word, count(*) AS n_hits FROM sc, lx WHERE contains(completion, word) GROUP BY ALL)
 SELECT list, word, coalesce(n_hits, 0) AS n_hits,
  {r6('coalesce(n_hits, 0) / CAST((SELECT count(*) FROM sc) AS DOUBLE)')} AS share
 FROM lx LEFT JOIN hit USING (list, word)"""


def contribution() -> str:
    parts = [
        f"SELECT {q(s)} AS component, count(*) AS n_rows,"
        f" {r6(SHARE.format('reward <> raw_reward'))} AS share_clamped, {r6(f'avg(r_{s})')} AS mean_score,"
        f" {r6(f'avg({d(DEFAULT.weights[s])} * r_{s})')} AS mean_weighted,"
        f" {r6(f'min(r_{s})')} AS min_score, {r6(f'max(r_{s})')} AS max_score FROM rw"
        for s in ORDER
    ]
    return f"{full()} " + " UNION ALL ".join(parts)


#: Completions with their second, and the second that the watermark of ten minutes ends at.
TIMED = f"""c AS (SELECT *, CASE WHEN comp_id < 0 THEN -1 - comp_id ELSE comp_id END AS d FROM rw),
 e AS (SELECT source, reward, {FIRST_SECOND} + d * 30 + d * 37 % 420 + CASE WHEN comp_id < 0 THEN 11 ELSE 0 END AS s FROM c),
 timed AS (SELECT *, max(s) OVER () - 600 AS passed FROM e)"""
ADVANTAGE = f"""{full()} SELECT comp_id, prompt_id, {r6('reward')} AS reward,
 round(CASE WHEN count(*) OVER w > 1 THEN (reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + {d(1e-4)})
  ELSE 0 END, 4) + CAST(0 AS DOUBLE) AS advantage FROM rw WINDOW w AS (PARTITION BY prompt_id)"""

PICKS = """first_value({0}) OVER (PARTITION BY prompt_id ORDER BY reward DESC, comp_id ROWS BETWEEN
 UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
LASTS = PICKS.replace("reward DESC, comp_id ", "reward, comp_id DESC ")


def waste(order: str, flag: str) -> str:
    return f"""SELECT {flag} AS by_length, count(*) AS n_batches, CAST(sum(mx * k) AS BIGINT) AS n_cells,
 CAST(sum(mx * k - used) AS BIGINT) AS n_padding,
 {r6('CAST(sum(mx * k - used) AS DOUBLE) / sum(mx * k)')} AS waste
 FROM (SELECT max(n) AS mx, count(*) AS k, sum(n) AS used FROM (
   SELECT n, (row_number() OVER (ORDER BY {order}) - 1) // {K.COLLATE_ROWS} AS b FROM sz) x GROUP BY b) y"""


def capped(column: str, keep: str) -> str:
    piece = f"{column}[1:{TEXT_CAP}]" if keep == "head" else f"{column}[greatest(1, len({column}) - {TEXT_CAP - 1}):]"
    return f"array_to_string({piece}, ' ')"


def broken() -> str:
    cut = "(CASE WHEN len(ws) > {0} THEN array_to_string(ws[1:{0}], ' ') ELSE completion END)".format(K.MAX_COMPLETION)

    def whole(body: str) -> str:
        return f"({tag('complete', 'think', body)}) + ({tag('complete', 'answer', body)}) = 2"

    return f"""WITH {SC}, wd AS (SELECT source, completion, {words('completion')} AS ws FROM sc),
 fl AS (SELECT source, len(ws) AS n, cut, completion, len(ws) > {K.MAX_COMPLETION} AS over,
  {whole('completion')} AS before, {whole('cut')} AS after FROM (SELECT *, {cut} AS cut FROM wd) x)
 SELECT source, count(*) AS n_rows, max(n) AS max_tokens, {r6(SHARE.format('over'))} AS share_over,
  {r6(SHARE.format('before'))} AS share_complete,
  {r6(SHARE.format('over AND before AND NOT after'))} AS share_broken FROM fl GROUP BY source"""


def reasons(min_script: float, need_tags: bool) -> str:
    tags = f"WHEN NOT ({RIGHT}) THEN 'tags'" if need_tags else ""
    return f"""CASE WHEN n = 0 THEN 'empty' WHEN CAST(ar AS DOUBLE) / n < {d(min_script)} THEN 'script' {tags}
 WHEN fw THEN 'forbidden' ELSE 'kept' END"""


CUSTOM = f"""WITH {SC}, {measured()}, {scored(DEFAULT, 'base')},
 cu AS (SELECT *, CASE WHEN regexp_matches(completion, '[0-9]') THEN {d(-1)} ELSE {d(0)} END AS r_no_digits FROM base),
 ct AS (SELECT comp_id, r_no_digits, raw_reward + {d(0.5)} * r_no_digits AS raw_reward FROM cu)
 SELECT comp_id, {r6('r_no_digits')} AS r_no_digits, {r6('raw_reward')} AS raw_reward,
  {r6(f'least({d(5)}, greatest({d(-5)}, raw_reward))')} AS reward FROM ct"""

CHECKS = {
    "is_empty": "n = 0",
    "all_script": "n > 0 AND ar = n",
    "mostly_script": f"n > 0 AND CAST(ar AS DOUBLE) / n > {d(0.9)}",
    "tags_right": RIGHT,
    "has_reason_word": "kw",
    "has_forbidden_word": "fw",
}

ORACLES: dict[str, str] = {
    "digits_normalized": f"SELECT doc_id, {digits('text')} AS text FROM documents",
    "turn_pairs": f"WITH {PAIRS} SELECT * FROM pairs",
    "user_query": f"WITH {PARTS} SELECT ex_id, user_query FROM dg",
    "answer_split": f"WITH {PARTS} SELECT ex_id, reasoning, final FROM parts",
    "assistant_response": f"WITH {PARTS} SELECT ex_id, response FROM rs",
    "sft_messages": f"""WITH {PARTS} SELECT ex_id, CAST(0 AS BIGINT) AS pos, 'system' AS role, {q(K.SYSTEM_PROMPT)} AS content FROM rs
 UNION ALL SELECT ex_id, 1, 'user', user_query FROM rs UNION ALL SELECT ex_id, 2, 'assistant', response FROM rs""",
    "sft_text": f"WITH {TEXTS} SELECT ex_id, text FROM tx",
    "grpo_prompts": f"""WITH {PARTS} SELECT ex_id, {SYSTEM} || {turn('user', 'user_query')} || {OPENER} AS prompt,
 '' AS chosen, '' AS rejected FROM dg""",
    "plain_prompts": f"""WITH {PARTS} SELECT ex_id, 'system: ' || {q(K.SYSTEM_PROMPT)} || chr(10) || 'user: '
 || user_query || chr(10) || 'assistant: ' AS prompt FROM dg""",
    "question_prompts": f"WITH {PARTS} SELECT ex_id, {SYSTEM} || {turn('user', 'instruction')} || {OPENER} AS prompt FROM dg",
    "conversation_text": f"""SELECT conv_id, count(*) AS n_turns,
 string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || {OPENER} AS text
 FROM conversations GROUP BY conv_id""",
    "conversation_messages": """SELECT conv_id, count(*) AS n_messages,
 string_agg(role || ': ' || text || chr(10), '' ORDER BY turn)
 || CASE WHEN arg_max(role, turn) = 'user' THEN 'assistant: ' ELSE '' END AS text FROM conversations GROUP BY conv_id""",
    "first_n_rows": f"WITH {SI} SELECT ex_id, instruction, answer FROM si ORDER BY ex_id LIMIT 100",
    "row_counts": f"""WITH {SC}, {SI} SELECT count(*) AS n_rows, 'completions' AS name FROM sc
 UNION ALL SELECT count(*), 'instructions' FROM si""",
    "union_samples": f"""WITH {SC}, {SI} SELECT 'completion' AS kind, comp_id AS id, completion AS text FROM sc
 UNION ALL SELECT 'answer', ex_id, answer FROM si""",
    "reward_script_ranges": component("arabic_only"),
    "reward_script_literal": component("arabic_only", LITERAL),
    "reward_length": component("length"),
    "reward_keywords": component("contains_keywords"),
    "reward_forbidden": component("not_contains_forbidden"),
    "reward_question": component("question_words_not_in_answer"),
    "reward_tags": component("think_answer_tags"),
    "tag_bodies": f"""WITH {SC} SELECT comp_id, {tag('body', 'think', 'completion')} AS think,
 {tag('body', 'answer', 'completion')} AS answer FROM sc""",
    "page_tag_bodies": f"""SELECT page_id, {tag('body', 'title', 'html')} AS title,
 {tag('body', 'article', 'html')} AS article FROM pages""",
    "reward_total": f"{full()} SELECT comp_id, {r6('raw_reward')} AS raw_reward, {r6('reward')} AS reward FROM rw",
    "reward_total_literal": f"{full(LITERAL)} SELECT comp_id, {r6('reward')} AS reward FROM rw",
    "reward_total_clamped": f"{full(TIGHT_CLAMP)} SELECT comp_id, {r6('reward')} AS reward FROM rw",
    "reward_export": f"""{full()} SELECT comp_id,
 round(CAST(CAST(reward AS FLOAT) AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS reward FROM rw""",
    "reward_components_long": f"{full()} "
    + " UNION ALL ".join(
        f"SELECT comp_id, {q(s)} AS component, {r6(f'r_{s}')} AS score,"
        f" {r6(f'{d(DEFAULT.weights[s])} * r_{s}')} AS weighted FROM rw"
        for s in ORDER
    ),
    "align_block": align(
        "SELECT row_number() OVER (ORDER BY prompt_id) - 1 AS prompt_pos,"
        " 'prompt ' || CAST(prompt_id AS VARCHAR) AS prompt FROM (SELECT DISTINCT prompt_id FROM sc) z"
    ),
    "align_cyclic": align(
        "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS prompt_pos, text AS prompt FROM conversations"
    ),
    "decoded_prompts": f"WITH {SI} SELECT ex_id AS prompt_id, array_to_string({words('instruction')}, ' ') AS prompt FROM si",
    "custom_signal": CUSTOM,
    "sql_function_scores": f"""{full()} SELECT comp_id, {r6('r_length')} AS length_score,
 {r6('r_arabic_only')} AS script_score, {r6('r_think_answer_tags')} AS tag_score, {r6('reward')} AS reward FROM rw""",
    "reward_by_step": f"""{full()} SELECT step, {STATS} FROM (
  SELECT reward, (row_number() OVER (ORDER BY comp_id) - 1) // {K.STEP_ROWS} AS step FROM rw) x GROUP BY step""",
    "group_advantage": ADVANTAGE,
    "preference_pairs": f"""{full()} SELECT DISTINCT prompt_id, chosen_id, rejected_id, chosen, rejected,
 {r6('best - worst')} AS margin FROM (SELECT prompt_id, {PICKS.format('comp_id')} AS chosen_id,
  {PICKS.format('completion')} AS chosen, {PICKS.format('reward')} AS best, {LASTS.format('comp_id')} AS rejected_id,
  {LASTS.format('completion')} AS rejected, {LASTS.format('reward')} AS worst FROM rw) x WHERE best > worst""",
    "best_of_prompt": f"""{full()} SELECT prompt_id, count(*) AS n_rows, {r6('avg(reward)')} AS mean_reward,
 {r6('max(reward)')} AS best_reward, max(best_id) AS best_id
 FROM (SELECT *, {PICKS.format('comp_id')} AS best_id FROM rw) x GROUP BY prompt_id""",
    "evaluation_report": f"""{full()} SELECT source, count(*) AS n_rows, {r6('avg(reward)')} AS mean_reward, """
    + ", ".join(f"{r6(SHARE.format(test))} AS share_{name}" for name, test in CHECKS.items())
    + f""", {r6('quantile_cont(reward, 0.1)')} AS p10_reward, {r6('quantile_cont(reward, 0.5)')} AS p50_reward,
 {r6('quantile_cont(reward, 0.9)')} AS p90_reward FROM rw GROUP BY source""",
    "component_contribution": contribution(),
    "config_sweep": sweep(),
    "quality_filter": f"""WITH {SC}, {measured()} SELECT comp_id, prompt_id, completion FROM me
 WHERE {reasons(0.05, False)} = 'kept'""",
    "quality_summary": f"""WITH {SC}, {measured()} SELECT {reasons(0.05, True)} AS reason, count(*) AS n_rows,
 CAST(sum(n) AS BIGINT) AS n_chars FROM me GROUP BY 1""",
    "lexicon_coverage": coverage(),
    "script_profile": f"""WITH {SC}, {measured()} SELECT lang, source, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_chars,
 CAST(sum(ar) AS BIGINT) AS n_script, {r6('coalesce(CAST(sum(ar) AS DOUBLE) / nullif(sum(n), 0), 0)')} AS script_share,
 {r6('avg(CASE WHEN n > 0 THEN CAST(ar AS DOUBLE) / n ELSE 0 END)')} AS mean_ratio,
 {r6(SHARE.format('n > 0 AND CAST(ar AS DOUBLE) / n > 0.9'))} AS share_mostly_script FROM me GROUP BY lang, source""",
    "review_list": f"""{full()} SELECT comp_id, prompt_id, {r6('reward')} AS reward, substr(completion, 1, 50) AS preview
 FROM (SELECT * FROM rw ORDER BY reward DESC, comp_id LIMIT 50) x""",
    "tokenized": f"""WITH {TEXTS}, {ids('tx', 'text', K.MAX_SEQUENCE)} SELECT ex_id, n_tokens, input_ids,
 trim(repeat('1 ', n_tokens)) AS attention_mask, input_ids AS labels FROM ids""",
    "padded_batches": f"""WITH {TEXTS}, {ids('tx', 'text', K.MAX_SEQUENCE)},
 bt AS (SELECT *, (row_number() OVER (ORDER BY ex_id) - 1) // {K.COLLATE_ROWS} AS batch_id FROM ids),
 mx AS (SELECT *, max(n_tokens) OVER (PARTITION BY batch_id) - n_tokens AS gap FROM bt)
 SELECT ex_id, batch_id, n_tokens, input_ids || repeat(' 0', gap) AS input_ids,
  trim(repeat('1 ', n_tokens)) || repeat(' 0', gap) AS attention_mask,
  input_ids || repeat(' {K.LABEL_PAD}', gap) AS labels FROM mx""",
    "padding_waste": f"""WITH {TEXTS}, sz AS (SELECT ex_id, least(len({words('text')}), {K.MAX_SEQUENCE}) AS n FROM tx)
 {waste('ex_id', 'false')} UNION ALL {waste('n, ex_id', 'true')}""",
    "length_caps": f"""WITH {PARTS}, lc AS (SELECT ex_id, {words('user_query')} AS p, {words('response')} AS c FROM rs)
 SELECT ex_id, len(p) > {TEXT_CAP} AS prompt_over, len(c) > {TEXT_CAP} AS completion_over,
  {capped('p', 'tail')} AS prompt, {capped('c', 'head')} AS completion FROM lc""",
    "truncation_report": broken(),
    "stream_scores": f"{full()} SELECT comp_id, {r6('reward')} AS reward FROM rw",
    "stream_reward_windows": f"""{full()}, {TIMED}
SELECT CAST(floor(s / 3600) * 3600 AS BIGINT) AS window_start, {r6('avg(reward)')} AS mean_reward, count(*) AS n_rows
FROM timed GROUP BY 1 HAVING window_start + 3600 <= any_value(passed)""",
    "stream_sliding_windows": f"""{full()}, {TIMED}
SELECT CAST(floor(s / 1200) * 1200 AS BIGINT) - k AS window_start, {r6('avg(reward)')} AS mean_reward, count(*) AS n_rows
FROM timed, (VALUES (0), (1200), (2400)) w(k) GROUP BY 1 HAVING window_start + 3600 <= any_value(passed)""",
    "stream_group_advantage": ADVANTAGE,
    "batch_callable_signal": f"""WITH {SC}, {measured()}, {scored()},
 p AS (SELECT rw.*, text AS prompt FROM rw LEFT JOIN documents ON doc_id = CASE WHEN comp_id % 3 = 0 THEN 0 ELSE prompt_id END),
 e AS (SELECT *, CASE WHEN left(coalesce(prompt, ''), 12) <> '' AND contains(completion, left(prompt, 12)) THEN -1.0::DOUBLE
   ELSE (length(completion) % 7)::DOUBLE / 8 + CASE WHEN source < 'm' THEN 0.5::DOUBLE ELSE 0 END END AS r_echo FROM p),
 t AS (SELECT *, raw_reward + {d(0.5)} * r_echo AS raw FROM e)
SELECT comp_id, {r6('r_echo')} AS r_echo, {r6('raw')} AS raw_reward,
 {r6(f"least({d(DEFAULT.clamp_rewards['max'])}, greatest({d(DEFAULT.clamp_rewards['min'])}, raw))")} AS reward FROM t""",
    "prompts_by_key": f"""WITH {SC}, k AS (SELECT comp_id, CASE WHEN comp_id % 3 = 0 THEN 0 WHEN comp_id % 11 = 1 THEN NULL
 ELSE prompt_id END AS prompt_id FROM sc)
SELECT comp_id, prompt_id, text AS prompt FROM k LEFT JOIN documents ON doc_id = prompt_id""",
    "empty_batch": f"{full()} SELECT comp_id, comp_id AS pos, completion AS prompt, reward FROM rw WHERE false",
    "split_replaced": f"""WITH {SC} SELECT comp_id, prompt_id,
 CASE WHEN comp_id % 10 = 0 THEN 'again' || chr(10) || completion ELSE completion END AS completion,
 CASE WHEN comp_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM sc""",
    "json_read_back": f"WITH {SI} SELECT ex_id, instruction, context, answer FROM si",
    "kept_columns": f"WITH {SI} SELECT ex_id, answer FROM si",
    "plugin_tokenized": f"""WITH {TEXTS}, c AS (SELECT ex_id, left(text, {K.MAX_SEQUENCE}) AS t FROM tx)
SELECT ex_id, CAST(length(t) AS BIGINT) AS n_tokens, array_to_string(list_transform(string_split(t, ''), lambda x: unicode(x)), ' ')
 AS input_ids FROM c""",
    "first_row_tokens": f"""WITH {TEXTS}, {ids('tx', 'text', K.MAX_SEQUENCE)}
SELECT ex_id, n_tokens, input_ids FROM ids ORDER BY ex_id LIMIT 1""",
    "batches_by_length": f"""WITH {TEXTS}, {ids('tx', 'text', K.MAX_SEQUENCE)},
 bt AS (SELECT *, (row_number() OVER (ORDER BY n_tokens, ex_id) - 1) // {K.COLLATE_ROWS} AS batch_id FROM ids),
 mx AS (SELECT *, max(n_tokens) OVER (PARTITION BY batch_id) - n_tokens AS gap FROM bt)
 SELECT ex_id, batch_id, n_tokens, input_ids || repeat(' 0', gap) AS input_ids FROM mx""",
    "stream_session_windows": f"""{full()}, {TIMED},
 g AS (SELECT *, CASE WHEN (s - lag(s) OVER (PARTITION BY source ORDER BY s)) * 1000 < {SESSION_GAP_MS}
   THEN 0 ELSE 1 END AS opens FROM timed),
 o AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY s ROWS UNBOUNDED PRECEDING) AS session FROM g)
 SELECT CAST(min(s) AS BIGINT) AS window_start, source, {r6('avg(reward)')} AS mean_reward, count(*) AS n_rows
 FROM o GROUP BY source, session HAVING max(s) * 1000 + {SESSION_GAP_MS} <= any_value(passed) * 1000""",
    "reward_page_tags": f"""WITH pg AS (SELECT page_id, coalesce(html, '') AS completion FROM pages),
 {measured(PAGE_TAGS, 'pg', 'title', 'article')}, {scored(PAGE_TAGS)}
 SELECT page_id, {r6('r_think_answer_tags')} AS tag_score, {r6('reward')} AS reward FROM rw""",
    "reward_from_mapping": f"{full(FROM_MAPPING)} SELECT comp_id, {r6('reward')} AS reward FROM rw",
    "split_read_back": f"""WITH {SC} SELECT comp_id, prompt_id, completion, 'test' AS split FROM sc
 WHERE comp_id % 10 = 0""",
    "reward_callback": f"""{full()}, {SI},
 p AS (SELECT row_number() OVER (ORDER BY ex_id) - 1 AS prompt_pos,
   array_to_string({words('instruction')}, ' ') AS prompt FROM si),
 c AS (SELECT comp_id, reward, row_number() OVER (ORDER BY comp_id) - 1 AS pos FROM rw),
 k AS (SELECT comp_id, pos, reward, CASE WHEN n % m = 0 THEN pos // (n // m) ELSE pos % m END AS prompt_pos
  FROM c, (SELECT count(*) AS n FROM c) x, (SELECT count(*) AS m FROM p) y)
 SELECT comp_id, CAST(pos AS BIGINT) AS pos, prompt,
  round(CAST(CAST(reward AS FLOAT) AS DOUBLE), 4) + CAST(0 AS DOUBLE) AS reward FROM k JOIN p USING (prompt_pos)""",
}
