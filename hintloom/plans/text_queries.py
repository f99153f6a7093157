"""Queries of scalar functions and hint cards over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hintloom.functions import text as T
from hintloom.operators import cards
from hintloom.plans.registry import query, table

#: White space of any kind in DuckDB's patterns, inside brackets.
BLANK = r"\s\x0b\x{{85}}\p{{Z}}"
STRIP = rf"regexp_replace({{0}}, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')"


def strip_sql(x: str) -> str:
    return STRIP.format(x)


@query("token_estimate", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INT AS tokens FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("trim_budget", r"SELECT doc_id, md5(regexp_replace(substr(text, 1, 64), '\s+$', '')) AS head FROM documents")
def trim_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.trim_to_budget(F.col("text"), 16)).alias("head"))


@query(
    "reasoning_trace",
    f"""SELECT line_no, md5(CASE WHEN t <> '' AND r <> '' THEN '<think>' || chr(10) || t || chr(10) || '</think>' || chr(10) || chr(10) || r WHEN t <> '' THEN t ELSE r END) AS trace
    FROM (SELECT line_no, {strip_sql("coalesce(model_think, '')")} AS t, {strip_sql("coalesce(model_response, '')")} AS r FROM sample_source_cot)""",
)
def reasoning_trace(spark, sf_dir):
    return table(spark, sf_dir, "sample_source_cot").select("line_no", F.md5(T.reasoning_trace(F.col("model_think"), F.col("model_response"))).alias("trace"))


_W, _S, _LINE = (x.replace("{{", "{").replace("}}", "}") for x in (f"[{BLANK}]", f"[^{BLANK}]", r"[ \t\x0b\f\r\x{{85}}\p{{Z}}]"))
_ANSWERS = [rf"(?im)^{_W}*final{_W}+answer{_W}*[:：]{_LINE}*({_S}[^\n]*?){_W}*$", rf"(?im)^{_W}*answer{_W}*[:：]{_LINE}*({_S}[^\n]*?){_W}*$", rf"(?i)\bthe{_W}+final{_W}+answer{_W}+is{_W}+([^\n]+)", rf"(?i)\bthe{_W}+answer{_W}+is{_W}+([^\n]+)"]


@query(
    "answer_extract",
    rf"""WITH t AS (SELECT line_no, coalesce(model_response, '') AS x FROM sample_source_cot),
    p AS (SELECT line_no, x, {", ".join(f"regexp_extract_all(x, '{p}', 1) AS {c}" for p, c in zip(_ANSWERS, "abcd"))}, CASE WHEN contains(x, '\boxed') THEN {strip_sql(r"regexp_extract(string_split(x, '\boxed')[-1], '^[^{]*\{([^{}]*)\}', 1)")} ELSE '' END AS e FROM t)
    SELECT line_no, CASE WHEN e <> '' THEN e {" ".join(f"WHEN len({c}) > 0 THEN {strip_sql(f'{c}[-1]')}" for c in "abcd")} ELSE {strip_sql(f"regexp_extract({strip_sql('x')}, '([^\n\r]*)$', 1)")} END AS final_answer FROM p""",
)
def answer_extract(spark, sf_dir):
    return table(spark, sf_dir, "sample_source_cot").select("line_no", T.final_answer(F.coalesce("model_response", F.lit(""))).alias("final_answer"))


def _normal_sql(x: str) -> str:
    x = rf"regexp_replace(regexp_replace(lower({strip_sql(x)}), '\\boxed\s*\{{([^{{}}]*)\}}', '\1', 'g'), '\\text\s*\{{([^{{}}]*)\}}', '\1', 'g')"
    for token in ("$", r"\(", r"\)", r"\[", r"\]", r"\left", r"\right", "`", "*", " "):
        x = f"replace({x}, '{token}', '')"
    return f"rtrim({x}, '.;,')"


@query("answer_normalize_match", f"SELECT line_no, a AS normalized, coalesce(a <> '' AND a = b, false) AS matches FROM (SELECT line_no, {_normal_sql('answer')} AS a, {_normal_sql('answer_of')} AS b FROM (SELECT s.line_no, s.answer, p.answer AS answer_of FROM sample_skill_cards s LEFT JOIN (SELECT question_id, min(answer) AS answer FROM sample_problems GROUP BY 1) p USING (question_id)))")
def answer_normalize_match(spark, sf_dir):
    gold = table(spark, sf_dir, "sample_problems").groupBy("question_id").agg(F.min("answer").alias("gold"))
    rows = table(spark, sf_dir, "sample_skill_cards").join(gold, "question_id", "left")
    return rows.select("line_no", T.normalize_answer(F.col("answer")).alias("normalized"), T.answers_match(F.col("answer"), F.col("gold")).alias("matches"))


@query("think_split", r"""SELECT line_no, md5(regexp_replace(regexp_extract(x, '(?is)^(.*)<\s*/\s*(?:thought|think|analysis|reasoning)\s*>(.*)$', 1), '^\s+|\s+$', '', 'g')) AS think, md5(answer) AS answer
    FROM (SELECT line_no, flash_output AS x, regexp_replace(regexp_extract(flash_output, '(?is)^(.*)<\s*/\s*(?:thought|think|analysis|reasoning)\s*>(.*)$', 2), '^\s+|\s+$', '', 'g') AS answer FROM joined_sample) WHERE answer <> ''""")
def think_split(spark, sf_dir):
    rows = table(spark, sf_dir, "joined_sample").select("line_no", T.split_thinking(F.col("flash_output"), "short").alias("s")).where("s is not null")
    return rows.select("line_no", F.md5("s.think").alias("think"), F.md5("s.answer").alias("answer"))


@query("xml_extract", r"SELECT line_no, md5(regexp_replace(regexp_extract(coalesce(reasoning_trace, ''), '(?is)<think>(.*?)</think>', 1), '^\s+|\s+$', '', 'g')) AS think FROM sample_source_cot")
def xml_extract(spark, sf_dir):
    return table(spark, sf_dir, "sample_source_cot").select("line_no", F.md5(T.tagged(F.coalesce("reasoning_trace", F.lit("")), "think")).alias("think"))


@query("slugify", "SELECT question_id, CASE WHEN s = '' THEN 'run' ELSE s END AS slug FROM (SELECT question_id, lower(regexp_replace(regexp_replace(benchmark || ' / ' || question_id, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS s FROM sample_benchmark)")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "sample_benchmark").select("question_id", T.slug(F.concat_ws(" / ", "benchmark", "question_id")).alias("slug"))


@query("budget_extract", r"SELECT line_no, coalesce(try_cast(nullif(regexp_extract(q, '\[\[(\d+)\]\]', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(q, '(\d+)', 1), '') AS BIGINT), 512) AS budget FROM (SELECT line_no, coalesce(question, '') AS q FROM sample_problems)")
def budget_extract(spark, sf_dir):
    return table(spark, sf_dir, "sample_problems").select("line_no", T.stated_budget(F.coalesce("question", F.lit(""))).alias("budget"))


@query("output_format_counts", r"SELECT coalesce(source, 'none') AS source, sum(len(regexp_extract_all(flash_output, '```cpp'))) AS cpp, sum(len(regexp_extract_all(flash_output, '```python'))) AS python, count(*) FILTER (flash_output IS NOT NULL AND NOT contains(flash_output, '```')) AS no_fence FROM joined_sample GROUP BY 1")
def output_format_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "joined_sample").groupBy(F.coalesce("source", F.lit("none")).alias("source"))
    count = lambda x: F.sum(F.regexp_count("flash_output", F.lit(x)).cast("bigint"))
    return rows.agg(count("```cpp").alias("cpp"), count("```python").alias("python"), F.count_if(~F.contains("flash_output", F.lit("```"))).alias("no_fence"))


_FENCE = r"(?s)```([a-zA-Z0-9_+\-]*)\n(.*?)\n```"
_FOREIGN = ", ".join(f"'{x}'" for x in T.UNSUPPORTED)
_ALIAS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.LANGUAGES.items())


@query("code_extract", rf"""WITH t AS (SELECT line_no, flash_output AS x FROM joined_sample),
    f AS (SELECT line_no, 0 AS part, unnest(range(1, len(l) + 1)) AS i, l, c FROM (SELECT line_no, regexp_extract_all(x, '{_FENCE}', 1) AS l, regexp_extract_all(x, '{_FENCE}', 2) AS c FROM t)),
    g AS (SELECT line_no, 1 AS part, unnest(range(1, len(c) + 1)) AS i, c FROM (SELECT line_no, list_transform(regexp_extract_all(x, '{T.CODE_BLOCK}', 1), lambda y: {strip_sql('y')}) AS c FROM t)),
    b AS (SELECT line_no, part, i, CASE lower(l[i]) {_ALIAS} END AS lang, regexp_replace(c[i], '^\n+|\n+$', '', 'g') AS code FROM f WHERE lower(l[i]) NOT IN ({_FOREIGN})
          UNION ALL SELECT line_no, part, i, CASE WHEN regexp_matches(c[i], '{T.CPP_SIGN}') THEN 'cpp' WHEN regexp_matches(c[i], '{T.PYTHON_SIGN}') THEN 'python' END, c[i] FROM g WHERE NOT regexp_matches(c[i], '{T.FOREIGN_SIGN}')),
    r AS (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY length(code) + CASE WHEN lang IS NULL THEN 0 ELSE 10000000 END DESC, part, i) AS place FROM b WHERE {strip_sql('code')} <> '')
    SELECT t.line_no, r.lang, md5(CASE WHEN r.line_no IS NULL THEN regexp_replace({strip_sql('x')}, '{T.CODE_BLOCK}', '\1', 'g') ELSE r.code END) AS code FROM t LEFT JOIN r ON r.line_no = t.line_no AND place = 1""")
def code_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "joined_sample").select("line_no", T.best_code(F.col("flash_output")).alias("c"))
    return rows.select("line_no", "c.lang", F.md5("c.code").alias("code"))


@query("code_block_errors", rf"SELECT line_no, {strip_sql("upper(coalesce(status, ''))")} IN ('CE', 'RE') AND contains(lower(coalesce(detail, '')), 'code_block') AS again FROM (SELECT line_no, CASE WHEN error IS NOT NULL THEN 'CE' ELSE status END AS status, model_response || CASE WHEN line_no % 2 = 0 THEN ' stray <Code_Block> tag' ELSE '' END AS detail FROM sample_source_cot)")
def code_block_errors(spark, sf_dir):
    """Which verdicts are to be judged again because tags of a code block were compiled."""
    rows = table(spark, sf_dir, "sample_source_cot").select("line_no", F.when(F.col("error").isNotNull(), "CE").otherwise(F.col("status")).alias("status"), F.concat("model_response", F.when(F.col("line_no") % 2 == 0, " stray <Code_Block> tag").otherwise("")).alias("detail"))
    return rows.select("line_no", T.code_block_error(F.col("status"), F.col("detail")).alias("again"))


@query("compare_outputs", "SELECT l_orderkey, l_linenumber, abs(l_tax - l_discount) <= 1e-6 OR (l_discount <> 0 AND abs(l_tax - l_discount) / greatest(abs(l_discount), 1e-15) <= 1e-6) AS same FROM lineitem")
def compare_outputs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.outputs_equal(F.col("l_tax").cast("string"), F.col("l_discount").cast("string")).alias("same"))


@query("json_props_extract", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("json_repair", "SELECT line_no, true AS parsed FROM sample_source_cot")
def json_repair(spark, sf_dir):
    raw = F.concat(F.lit('{"text": "'), F.replace(F.replace(F.replace(F.coalesce("model_response", F.lit("")), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")), F.lit('"}'))
    rows = table(spark, sf_dir, "sample_source_cot").select("line_no", raw.alias("raw"))
    return rows.select("line_no", F.get_json_object(T.repair_escapes(F.col("raw")), "$.text").isNotNull().alias("parsed"))


@query("task_ids", "SELECT line_no, left(md5(coalesce(unique_key, 'None') || '|' || coalesce(category, 'None') || '|' || 'flash'), 12) AS task_id FROM joined_sample")
def task_ids(spark, sf_dir):
    return table(spark, sf_dir, "joined_sample").select("line_no", T.task_hash(F.col("unique_key"), F.col("category"), F.lit("flash")).alias("task_id"))


@query("secret_scan", r"SELECT doc_id, i AS line FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(x, '[a-z]+_\d{4}')")
def secret_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.secret_lines(F.col("text"), r"[a-z]+_\d{4}")).alias("hit")).select("doc_id", F.col("hit.line").cast("bigint").alias("line"))


@query("prompt_render", "SELECT question_id, md5(replace(replace(replace('Problem ({{topic}}): {{question}} {{hints}}', '{{topic}}', coalesce(topic, '')), '{{question}}', coalesce(question, '')), '{{hints}}', 'none')) AS prompt FROM (SELECT line_no AS question_id, topic, question FROM sample_problems)")
def prompt_render(spark, sf_dir):
    template = F.lit("Problem ({{topic}}): {{question}} {{hints}}")
    return table(spark, sf_dir, "sample_problems").select(F.col("line_no").alias("question_id"), F.md5(T.render(template, {"topic": F.col("topic"), "question": F.col("question"), "hints": F.lit("none")})).alias("prompt"))


@query("hints_block", r"SELECT question_id, md5(string_agg(heuristic, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY line_no)) AS hints, count(*) AS n FROM sample_skill_cards WHERE regexp_replace(heuristic, '\s+', '', 'g') <> '' GROUP BY question_id")
def hints_block(spark, sf_dir):
    rows = table(spark, sf_dir, "sample_skill_cards").where(T.filled(F.col("heuristic")).isNotNull())
    listed = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "heuristic"))).alias("h"), F.count("*").alias("n"))
    return listed.select("question_id", F.md5(F.array_join("h.heuristic", "\n\n---\n\n")).alias("hints"), "n")


def _cards(spark, sf_dir):
    """Skill cards as structured ones: items of the heuristic to do, keywords as triggers and tags."""
    rows = table(spark, sf_dir, "sample_skill_cards")
    items = F.filter(F.transform(F.split(F.coalesce("heuristic", F.lit("")), "\n"), T.strip), lambda x: x != "")
    keys = F.filter(F.transform(F.split(F.coalesce("keywords", F.lit("")), ","), T.strip), lambda x: x != "")
    kind = F.when(F.col("line_no") % 3 == 0, "success").when(F.col("line_no") % 3 == 1, "edge_fix").otherwise("other")
    none = F.lit(None).cast("string")
    card = {"type": kind, "trigger": keys, "tags": keys, "do": items, "avoid": F.slice(items, 2, 1), "check": F.slice(keys, 1, 0), "detours": F.slice(keys, 1, 0), "edge_pattern": F.col("topic"), "fix_hint": F.col("answer"), "wrong_approach": none, "correct_direction": none, "risk": none, "complexity": none}
    return rows, card


_CARDS = r"""SELECT line_no, CASE line_no % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'edge_fix' ELSE 'other' END AS type, topic, answer,
    list_filter(list_transform(string_split(coalesce(heuristic, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS items,
    list_filter(list_transform(string_split(coalesce(keywords, ''), ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS keys FROM sample_skill_cards"""


@query("card_texts", f"""SELECT line_no,
    md5(concat_ws(chr(10), CASE WHEN len(keys) > 0 THEN 'TRIGGER: ' || array_to_string(keys, ' | ') END, CASE WHEN len(keys) > 0 THEN 'TAGS: ' || array_to_string(keys, ' ') END, CASE WHEN len(items) > 0 THEN 'DO: ' || array_to_string(items, ' ; ') END, CASE WHEN len(items) > 1 THEN 'AVOID: ' || items[2] END)) AS index_text,
    md5(trim(coalesce('If ' || nullif(array_to_string(keys[1:2], ' | '), '') || ': ', '') || coalesce('Do: ' || nullif(array_to_string(items[1:3], '; '), '') || '. ', '') || CASE WHEN len(items) > 1 THEN 'Avoid: ' || items[2] || '. ' ELSE '' END)) AS inject_text FROM ({_CARDS})""")
def card_texts(spark, sf_dir):
    rows, card = _cards(spark, sf_dir)
    return rows.select("line_no", F.md5(cards.index_text(card)).alias("index_text"), F.md5(cards.inject_text(card)).alias("inject_text"))


@query("retrieval_documents", f"SELECT line_no, md5(array_to_string(list_filter([{strip_sql("coalesce(question, '')")}, {strip_sql("coalesce(topic, '')")}, {strip_sql("coalesce(heuristic, '')")}, {strip_sql("coalesce(keywords, '')")}], lambda x: x <> ''), chr(10))) AS body FROM sample_skill_cards")
def retrieval_documents(spark, sf_dir):
    return table(spark, sf_dir, "sample_skill_cards").select("line_no", F.md5(cards.retrieval_text(F.col("question"), F.col("topic"), F.col("heuristic"), F.col("keywords"))).alias("body"))


_LEAK = r"(?i)\b(?:wa|tle|re|ce|wrong answer|runtime error|compile error|expected|got|stderr|judge|pass(?:ed)?\b|fail(?:ed)?\b)\b"
_ISSUES = rf"""SELECT *, list_filter([CASE WHEN type = 'other' THEN 'unexpected_type' END, CASE WHEN len(keys) = 0 THEN 'trigger_empty' END,
    CASE WHEN len(keys) > 0 AND len(list_filter(keys, lambda k: NOT (regexp_matches(k, '{_LEAK}') OR regexp_matches(k, '{cards.GENERIC}')))) = 0 THEN 'trigger_low_signal' END,
    CASE WHEN len(list_filter(keys, lambda k: regexp_matches(k, '(?i)\b\d{{3,}}\b\s*(?:to|->|=>|→)\s*\b\d{{3,}}\b|\b(?:sample|example)\b') OR len(regexp_extract_all(k, '\b\d{{3,}}\b')) >= 2)) > 0 THEN 'trigger_literal_example' END,
    CASE WHEN len(list_filter(keys, lambda k: length(k) > 120)) > 0 THEN 'trigger_too_long' END, CASE WHEN regexp_matches(body, '{_LEAK}') THEN 'judge_leak' END,
    CASE WHEN len(items) = 0 THEN 'action_gap' END, CASE WHEN (type = 'edge_fix' AND (trim(coalesce(topic, '')) = '' OR trim(coalesce(answer, '')) = '')) OR (type <> 'edge_fix' AND len(items) = 0) THEN 'type_specific_gap' END,
    CASE WHEN length(body) > 900 OR greatest(length(trim(coalesce(topic, ''))), length(trim(coalesce(answer, '')))) > 280 THEN 'long_form' END], lambda x: x IS NOT NULL) AS issues
    FROM (SELECT *, array_to_string(list_filter([type, {strip_sql("coalesce(topic, '')")}, {strip_sql("coalesce(answer, '')")}], lambda x: x <> '') || keys || keys || items || items[2:2], chr(10)) AS body FROM ({_CARDS}))"""


@query("card_issues", f"SELECT line_no, array_to_string(issues, ',') AS issues FROM ({_ISSUES})")
def card_issues(spark, sf_dir):
    rows, card = _cards(spark, sf_dir)
    return rows.select("line_no", F.array_join(cards.issues(card), ",").alias("issues"))


@query("card_quality_report", f"SELECT count(*) AS total, count(*) FILTER (len(issues) = 0) AS ready, round(count(*) FILTER (len(issues) = 0) * 100.0 / count(*), 6) AS ready_pct, round(count(DISTINCT lower(keys[1])) / count(*), 6) AS unique_trigger_ratio FROM ({_ISSUES})")
def card_quality_report(spark, sf_dir):
    rows, card = _cards(spark, sf_dir)
    return cards.quality_report(rows.select(cards.issues(card).alias("issues"), card["trigger"].alias("trigger")), "issues", "trigger")


@query("card_issue_histogram", f"SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM ({_ISSUES})) GROUP BY issue")
def card_issue_histogram(spark, sf_dir):
    rows, card = _cards(spark, sf_dir)
    return cards.issue_histogram(rows.select(cards.issues(card).alias("issues")), "issues")


@query("card_drop_reasons", f"SELECT CASE WHEN type = 'other' THEN 'type' WHEN len(keys) = 0 THEN 'trigger_empty' WHEN length(coalesce(array_to_string(items, ' '), '')) < 20 THEN 'text_too_short' ELSE 'kept' END AS reason, count(*) AS n FROM ({_CARDS}) GROUP BY 1")
def card_drop_reasons(spark, sf_dir):
    rows, card = _cards(spark, sf_dir)
    return rows.groupBy(F.coalesce(cards.drop_reason(card, F.array_join(card["do"], " ")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("card_texts_typed", f"""SELECT line_no, md5(concat_ws(chr(10), CASE WHEN len(keys) > 0 THEN 'TRIGGER: ' || array_to_string(keys, ' | ') END, CASE WHEN len(keys) > 0 THEN 'TAGS: ' || array_to_string(keys, ' ') END,
      CASE WHEN type = 'edge_fix' AND topic <> '' THEN 'EDGE: ' || topic END, CASE WHEN type = 'edge_fix' AND answer <> '' THEN 'FIX: ' || answer END,
      CASE WHEN len(items) > 0 THEN 'DO: ' || array_to_string(items, ' ; ') END, CASE WHEN len(items) > 1 THEN 'AVOID: ' || items[2] END)) AS index_text,
    md5(CASE WHEN type = 'edge_fix' THEN concat_ws(' ', 'EDGE CASE if ' || nullif(array_to_string(keys[1:2], ' | '), '') || ':', nullif(topic, '') || '.', 'Fix: ' || nullif(answer, '') || '.')
      ELSE concat_ws(' ', 'If ' || nullif(array_to_string(keys[1:2], ' | '), '') || ':', 'Do: ' || nullif(array_to_string(items[1:3], '; '), '') || '.', CASE WHEN len(items) > 1 THEN 'Avoid: ' || items[2] || '.' END) END) AS inject_text FROM ({_CARDS})""")
def card_texts_typed(spark, sf_dir):
    rows, card = _cards(spark, sf_dir)
    return rows.select("line_no", F.md5(cards.typed_index_text(card)).alias("index_text"), F.md5(cards.typed_inject_text(card)).alias("inject_text"))


@query("experience_block", f"SELECT line_no, md5(array_to_string(list_transform(['Check each step.'] || items, lambda x: '- ' || x), chr(10))) AS block FROM ({_CARDS})")
def experience_block(spark, sf_dir):
    rows, card = _cards(spark, sf_dir)
    return rows.select("line_no", F.md5(cards.experience_block(card["do"], F.lit("Check each step."))).alias("block"))


@query("failure_card_drops", f"SELECT coalesce(CASE WHEN type = 'edge_fix' AND (length(coalesce(topic, '')) < 5 OR length(coalesce(answer, '')) < 5) THEN 'field_too_short' WHEN type = 'edge_fix' AND length(coalesce(array_to_string(items, ' '), '')) > 250 THEN 'text_too_long' END, 'kept') AS reason, count(*) AS n FROM ({_CARDS}) GROUP BY 1")
def failure_card_drops(spark, sf_dir):
    rows, card = _cards(spark, sf_dir)
    return rows.groupBy(F.coalesce(cards.failure_drop_reason(card, F.array_join(card["do"], " ")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("verdict_parse", f"SELECT line_no, CASE WHEN contains(h, 'INCORRECT') THEN 'INCORRECT' WHEN contains(h, 'CORRECT') THEN 'CORRECT' ELSE 'UNKNOWN' END AS verdict FROM (SELECT line_no, upper(string_split({strip_sql("CASE line_no % 3 WHEN 0 THEN 'It is incorrect: ' WHEN 1 THEN ' Correct. ' ELSE '' END || coalesce(model_response, '')")}, chr(10))[1]) AS h FROM sample_source_cot)")
def verdict_parse(spark, sf_dir):
    before = F.when(F.col("line_no") % 3 == 0, "It is incorrect: ").when(F.col("line_no") % 3 == 1, " Correct. ").otherwise("")
    return table(spark, sf_dir, "sample_source_cot").select("line_no", T.verdict(F.concat(before, F.coalesce("model_response", F.lit("")))).alias("verdict"))
