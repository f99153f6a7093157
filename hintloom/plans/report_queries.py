"""Queries of reports, keyed operations and streams over the project's and the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hintloom.functions import text as T
from hintloom.operators import relational as R
from hintloom.operators import reports, sampling
from hintloom.plans.registry import query, table
from hintloom.plans.text_queries import strip_sql

_RUNS = """SELECT o_custkey AS question_id, o_orderkey % 3 AS repeat_idx, CASE WHEN o_orderkey % 2 = 0 THEN 'direct' ELSE 'hinted' END AS mode, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'success' END AS status,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_totalprice > 150000)::INT END AS is_correct, o_orderkey % 100 AS prompt_tokens, nullif(o_orderkey % 50, 0) AS completion_tokens, (o_orderkey % 13) / 1000.0 AS cost FROM orders"""


def _runs(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("question_id"), (key % 3).alias("repeat_idx"), F.when(key % 2 == 0, "direct").otherwise("hinted").alias("mode"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("success").alias("status"),
        F.when(key % 7 != 0, (F.col("o_totalprice") > 150000).cast("int")).alias("is_correct"), (key % 100).alias("prompt_tokens"), F.nullif(key % 50, F.lit(0)).alias("completion_tokens"), ((key % 13) / 1000.0).alias("cost"),
    )


_SUMMARY = f"""WITH runs AS ({_RUNS}),
    q AS (SELECT mode, count(*) AS questions, sum(won) AS won FROM (SELECT mode, question_id, (avg(coalesce(is_correct, 0)) > 0.5)::INT AS won FROM runs GROUP BY ALL) GROUP BY mode),
    r AS (SELECT mode, repeat_idx, sum(CASE WHEN status = 'success' THEN coalesce(is_correct, 0) ELSE 0 END) AS correct, count(*) FILTER (status = 'success') AS ok,
          sum(prompt_tokens) FILTER (status = 'success') AS p, sum(coalesce(completion_tokens, 0)) FILTER (status = 'success') AS c, sum(cost) FILTER (status = 'success') AS m FROM runs GROUP BY ALL),
    s AS (SELECT mode, any_value(questions) AS questions, any_value(won) AS won, count(*) AS repeats, sum(ok) AS n_ok, avg(correct / questions) AS mean, stddev_pop(correct / questions) AS std, sum(p) AS p, sum(c) AS c, sum(m) AS m FROM r JOIN q USING (mode) GROUP BY mode),
    summary AS (SELECT mode, questions, repeats, questions * repeats AS attempts, round(n_ok / (questions * repeats) * 100, 2) AS success_rate, round(mean * 100, 2) AS mean_accuracy, round(std * 100, 2) AS accuracy_std,
          round(won / questions * 100, 2) AS majority_accuracy, round(p / n_ok, 1) AS avg_prompt_tokens, round(c / n_ok, 1) AS avg_completion_tokens, round(m / n_ok, 8) AS avg_cost FROM s)"""


@query("condition_summary", f"{_SUMMARY} SELECT * FROM summary")
def condition_summary(spark, sf_dir):
    return reports.condition_summary(_runs(spark, sf_dir), ["mode"])


@query("mode_comparison", f"""{_SUMMARY} SELECT 'all' AS benchmark, d.mean_accuracy AS base_mean_accuracy, d.avg_completion_tokens AS base_avg_completion_tokens, d.avg_cost AS base_avg_cost, h.mean_accuracy AS other_mean_accuracy,
    h.avg_completion_tokens AS other_avg_completion_tokens, h.avg_cost AS other_avg_cost, round(h.mean_accuracy - d.mean_accuracy, 2) AS delta_mean_accuracy, round(h.avg_completion_tokens - d.avg_completion_tokens, 1) AS delta_avg_completion_tokens, round(h.avg_cost - d.avg_cost, 8) AS delta_avg_cost
    FROM summary d, summary h WHERE d.mode = 'direct' AND h.mode = 'hinted'""")
def mode_comparison(spark, sf_dir):
    summary = reports.condition_summary(_runs(spark, sf_dir), ["mode"]).withColumn("benchmark", F.lit("all"))
    return reports.comparison(summary, ["benchmark"], "mode", "direct", "hinted")


_S = r"upper(regexp_replace(coalesce(status, ''), '^\s+|\s+$', '', 'g'))"


@query("judge_status_distribution", f"SELECT model_label, status, n, round(n / sum(n) OVER (PARTITION BY model_label), 6) AS share FROM (SELECT model_label, {_S} AS status, count(*) AS n FROM judge_results GROUP BY ALL)")
def judge_status_distribution(spark, sf_dir):
    return reports.verdict_distribution(table(spark, sf_dir, "judge_results"), ["model_label"], T.status(F.col("status")))


@query("language_status_cross", f"SELECT coalesce(lang, 'unknown') AS lang, {_S} AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY coalesce(lang, 'unknown')), 6) AS share FROM judge_results GROUP BY 1, 2")
def language_status_cross(spark, sf_dir):
    rows = table(spark, sf_dir, "judge_results").withColumn("lang", F.coalesce("lang", F.lit("unknown")))
    return reports.verdict_distribution(rows, ["lang"], T.status(F.col("status")))


@query("test_pass_rates", f"SELECT {_S} AS status, sum(passed) AS passed, sum(total_tests) AS total_tests, round(sum(passed) FILTER (total_tests IS NOT NULL) / nullif(sum(total_tests), 0) * 100, 4) AS pass_rate FROM judge_results GROUP BY 1")
def test_pass_rates(spark, sf_dir):
    known = F.sum(F.when(F.col("total_tests").isNotNull(), F.col("passed")))
    rows = table(spark, sf_dir, "judge_results").groupBy(T.status(F.col("status")).alias("status"))
    return rows.agg(F.sum("passed").alias("passed"), F.sum("total_tests").alias("total_tests"), F.round(F.try_divide(known, F.sum("total_tests")) * 100, 4).alias("pass_rate"))


_CAT = r"""SELECT *, CASE WHEN x = '' OR y = '' THEN NULL WHEN x = 'AC' AND y = 'AC' THEN 'both_ac' WHEN x = 'AC' THEN 'flash_ac_doubao_wrong' WHEN y = 'AC' THEN 'flash_wrong_doubao_ac' ELSE 'both_wrong' END AS cat
    FROM (SELECT *, upper(trim(coalesce(flash_status, ''))) AS x, upper(trim(coalesce(doubao_status, ''))) AS y FROM joined_sample)"""


@query("classify_pairs", f"SELECT line_no, cat AS category FROM ({_CAT})")
def classify_pairs(spark, sf_dir):
    return table(spark, sf_dir, "joined_sample").select("line_no", T.category(F.col("flash_status"), F.col("doubao_status")).alias("category"))


@query("ac_rate_by_category", f"SELECT coalesce(cat, 'unknown') AS category, count(*) AS n, count(*) FILTER (x = 'AC') AS accepted, round(count(*) FILTER (x = 'AC') / count(*), 4) AS ac_rate FROM ({_CAT}) GROUP BY 1")
def ac_rate_by_category(spark, sf_dir):
    rows = table(spark, sf_dir, "joined_sample").withColumn("category", F.coalesce(T.category(F.col("flash_status"), F.col("doubao_status")), F.lit("unknown")))
    return reports.accepted_rate(rows, ["category"], T.status(F.col("flash_status")))


@query("gen_stats", rf"SELECT source_model, count(*) AS n, count(*) FILTER (NOT full_) AS empty, sum(source_completion_tokens) FILTER (full_) AS tokens, round(avg(source_completion_tokens) FILTER (full_), 4) AS avg_tokens FROM (SELECT *, {strip_sql("coalesce(model_response, '')")} <> '' AS full_ FROM sample_source_cot) GROUP BY 1")
def gen_stats(spark, sf_dir):
    full = T.filled(F.col("model_response")).isNotNull()
    tokens = F.when(full, F.col("source_completion_tokens"))
    return table(spark, sf_dir, "sample_source_cot").groupBy("source_model").agg(F.count("*").alias("n"), F.count_if(~full).alias("empty"), F.sum(tokens).alias("tokens"), F.round(F.avg(tokens), 4).alias("avg_tokens"))


def _token_sql(used: str) -> str:
    return f"SELECT topic, count(*) AS n, count({used}) AS n_used, round(avg(({used})::DOUBLE), 4) AS avg_tokens FROM sample_source_cot GROUP BY topic"


def _tokens(rule):
    def run(spark, sf_dir):
        return reports.token_report(table(spark, sf_dir, "sample_source_cot"), ["topic"], F.col("source_completion_tokens"), rule, F.col("source_prompt_tokens"))

    return run


query("token_report_skip_missing", _token_sql("source_completion_tokens"))(_tokens("skip_missing"))
query("token_report_skip_zero", _token_sql("nullif(source_completion_tokens, 0)"))(_tokens("skip_missing_and_zero"))
query("token_report_missing_is_zero", _token_sql("coalesce(source_completion_tokens, 0)"))(_tokens("missing_is_zero"))
query("token_report_first_of", _token_sql("coalesce(source_completion_tokens, source_prompt_tokens)"))(_tokens("first_of"))


@query("tokens_per_accepted", "SELECT event_type, count(*) FILTER (ok) AS accepted, round(sum(value) / nullif(count(*) FILTER (ok), 0), 4) AS tokens_per_accepted, round(avg(value) FILTER (ok), 4) AS avg_accepted, round(median(value) FILTER (ok), 4) AS median_accepted FROM (SELECT *, user_id % 2 = 0 AS ok FROM events) GROUP BY 1")
def tokens_per_accepted(spark, sf_dir):
    return reports.tokens_per_accepted(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), F.col("user_id") % 2 == 0)


@query("upper_median_length", "SELECT source, count(*) AS n, round(avg(length(text)), 4) AS mean, list_sort(list(length(text)))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY source")
def upper_median_length(spark, sf_dir):
    return reports.upper_median_length(table(spark, sf_dir, "documents"), ["source"], F.col("text"))


@query("most_common_keys", "SELECT unique_key, count(*) AS n FROM judge_results GROUP BY 1 ORDER BY n DESC, min(line_no) LIMIT 20")
def most_common_keys(spark, sf_dir):
    return reports.most_common(table(spark, sf_dir, "judge_results"), "unique_key", "line_no", 20)


@query("first_non_accepted", f"SELECT unique_key, coalesce(arg_min(s, line_no) FILTER (s <> 'AC'), 'AC') AS overall FROM (SELECT unique_key, line_no, {_S} AS s FROM judge_results) GROUP BY 1")
def first_non_accepted(spark, sf_dir):
    return reports.first_failure(table(spark, sf_dir, "judge_results"), "unique_key", "line_no", T.status(F.col("status")))


@query("consecutive_fail_stop", f"SELECT unique_key, line_no FROM (SELECT unique_key, line_no, sum(({_S} = 'AC')::INT) OVER w AS ok, count(*) OVER w AS n FROM judge_results WINDOW w AS (PARTITION BY unique_key ORDER BY line_no ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE ok = 0 AND n = 5")
def consecutive_fail_stop(spark, sf_dir):
    return reports.failing_runs(table(spark, sf_dir, "judge_results"), "unique_key", ["line_no"], T.status(F.col("status")), 5)


@query("diagnostic_failures", f"""WITH f AS (SELECT unique_key, line_no, {_S} AS s, coalesce(total_tests, 0) AS size FROM judge_results WHERE {_S} <> 'AC'),
    p AS (SELECT unique_key, min(line_no) AS a, max(line_no) AS b, min(line_no) FILTER (s = 'TLE') AS c, arg_min(line_no, (-size) * 10000000 + line_no) FILTER (s = 'WA') AS d FROM f GROUP BY 1),
    e AS (SELECT unique_key, a AS line_no, 0 AS o, 'first' AS why FROM p UNION ALL SELECT unique_key, b, 1, 'last' FROM p UNION ALL SELECT unique_key, c, 2, 'tle' FROM p WHERE c IS NOT NULL UNION ALL SELECT unique_key, d, 3, 'worst' FROM p WHERE d IS NOT NULL)
    SELECT unique_key, line_no, arg_min(why, o) AS why FROM e GROUP BY 1, 2""")
def diagnostic_failures(spark, sf_dir):
    return reports.diagnostic_picks(table(spark, sf_dir, "judge_results"), "unique_key", "line_no", T.status(F.col("status")), F.coalesce("total_tests", F.lit(0)))


_DEDUP = "SELECT unique_key, model_label, line_no, status, passed FROM (SELECT *, row_number() OVER (PARTITION BY unique_key, model_label ORDER BY line_no {0}) AS r FROM judge_results) WHERE r = 1"


@query("dedup_last_wins", _DEDUP.format("DESC"))
def dedup_last_wins(spark, sf_dir):
    return R.last_wins(table(spark, sf_dir, "judge_results").select("unique_key", "model_label", "line_no", "status", "passed"), ["unique_key", "model_label"], "line_no")


@query("dedup_first_wins", _DEDUP.format("ASC"))
def dedup_first_wins(spark, sf_dir):
    return R.first_wins(table(spark, sf_dir, "judge_results").select("unique_key", "model_label", "line_no", "status", "passed"), ["unique_key", "model_label"], "line_no")


@query("resume_anti", "SELECT line_no, question_id FROM sample_problems p WHERE NOT EXISTS (SELECT 1 FROM sample_source_cot s WHERE s.question_id = p.question_id)")
def resume_anti(spark, sf_dir):
    return R.remaining(table(spark, sf_dir, "sample_problems").select("line_no", "question_id"), table(spark, sf_dir, "sample_source_cot"), "question_id")


@query("ok_only_resume", "SELECT line_no, question_id FROM sample_problems p WHERE NOT EXISTS (SELECT 1 FROM sample_skill_cards s WHERE s.question_id = p.question_id AND s.status = 'success')")
def ok_only_resume(spark, sf_dir):
    return R.remaining(table(spark, sf_dir, "sample_problems").select("line_no", "question_id"), table(spark, sf_dir, "sample_skill_cards"), "question_id", F.col("status") == "success")


@query("missing_keys", "SELECT DISTINCT unique_key FROM joined_sample j WHERE NOT EXISTS (SELECT 1 FROM judge_results r WHERE r.unique_key = j.unique_key)")
def missing_keys(spark, sf_dir):
    return R.missing_keys(table(spark, sf_dir, "joined_sample"), table(spark, sf_dir, "judge_results"), "unique_key")


@query("holdout_exclusion", "SELECT line_no, unique_key FROM judge_results r WHERE NOT EXISTS (SELECT 1 FROM joined_sample j WHERE j.split_name = 'holdout' AND j.unique_key = r.unique_key)")
def holdout_exclusion(spark, sf_dir):
    held = table(spark, sf_dir, "joined_sample").where("split_name = 'holdout'")
    return R.remaining(table(spark, sf_dir, "judge_results").select("line_no", "unique_key"), held, "unique_key").select("line_no", "unique_key")


@query("merge_rejudged", f"SELECT j.line_no, CASE WHEN r.unique_key IS NOT NULL THEN r.status ELSE j.flash_status END AS flash_status FROM joined_sample j LEFT JOIN (SELECT unique_key, arg_max(struct_pack(s := status), line_no).s AS status FROM judge_results WHERE model_label = (SELECT min(model_label) FROM judge_results) GROUP BY 1) r USING (unique_key)")
def merge_rejudged(spark, sf_dir):
    judged = table(spark, sf_dir, "judge_results")
    label = judged.agg(F.min("model_label")).first()[0]
    new = R.last_wins(judged.where(F.col("model_label") == label).select("unique_key", "line_no", F.col("status").alias("flash_status")), ["unique_key"], "line_no").drop("line_no")
    return R.merged(table(spark, sf_dir, "joined_sample").select("line_no", "unique_key", "flash_status"), new, "unique_key", ["flash_status"]).drop("unique_key")


@query("refill_union", "WITH good AS (SELECT question_id, heuristic FROM sample_skill_cards WHERE status = 'success') SELECT question_id, heuristic AS text FROM good UNION ALL SELECT question_id, answer AS text FROM sample_problems p WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.question_id = p.question_id)")
def refill_union(spark, sf_dir):
    old = table(spark, sf_dir, "sample_skill_cards").select("question_id", F.col("heuristic").alias("text"), "status")
    new = table(spark, sf_dir, "sample_problems").select("question_id", F.col("answer").alias("text"))
    return R.refilled(old, new, "question_id", F.col("status") == "success").drop("status")


@query("case_io_join", "SELECT line_no, i - 1 AS pos, x AS word, b[i] AS key FROM (SELECT line_no, unnest(a) AS x, generate_subscripts(a, 1) AS i, b FROM (SELECT line_no, string_split(coalesce(question, ''), ' ') AS a, string_split(coalesce(keywords, ''), ', ') AS b FROM sample_skill_cards))")
def case_io_join(spark, sf_dir):
    rows = table(spark, sf_dir, "sample_skill_cards").select("line_no", F.split(F.coalesce("question", F.lit("")), " ").alias("word"), F.split(F.coalesce("keywords", F.lit("")), ", ").alias("key"))
    return R.positional_join(rows, "line_no", "word", "key").withColumn("pos", F.col("pos").cast("bigint"))


@query("repeats_cross", "SELECT question_id, r AS repeat_idx, mode FROM sample_benchmark, range(3) t(r), (VALUES ('direct'), ('hinted')) m(mode)")
def repeats_cross(spark, sf_dir):
    rows = R.repeated(table(spark, sf_dir, "sample_benchmark").select("question_id"), 3)
    return rows.select("question_id", F.col("repeat_idx").cast("bigint").alias("repeat_idx"), F.explode(F.array(F.lit("direct"), F.lit("hinted"))).alias("mode"))


@query("case_counts_by_file_key", "SELECT k[1] AS dataset, k[2] AS split, count(*) AS n FROM (SELECT string_split(lower(regexp_replace(unique_key, '\\s+', '', 'g')), '/') AS k FROM joined_sample WHERE unique_key IS NOT NULL) GROUP BY 1, 2")
def case_counts_by_file_key(spark, sf_dir):
    parts = F.split(F.lower(F.regexp_replace("unique_key", r"\s+", "")), "/")
    rows = table(spark, sf_dir, "joined_sample").where("unique_key is not null")
    return rows.groupBy(F.get(parts, F.lit(0)).alias("dataset"), F.get(parts, F.lit(1)).alias("split")).agg(F.count("*").alias("n"))


@query("stratified_holdout")
def stratified_holdout(spark, sf_dir):
    rows = sampling.stratified_holdout(table(spark, sf_dir, "joined_sample").select("line_no", "category"), "line_no", "category", 100)
    return rows.groupBy("category", "split").agg(F.count("*").alias("n"))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    rows = table(spark, sf_dir, "judge_results").select("model_label", (T.status(F.col("status")) == "AC").cast("double").alias("accepted"))
    return sampling.bootstrap_mean(rows, "model_label", "accepted", 10_000)


@query("progress_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def progress_windows(spark, sf_dir):
    from hintloom.streaming.monitor import run_once

    return run_once(spark, sf_dir)


@query("judge_demo")
def judge_demo(spark, sf_dir):
    """Runs three constant, trusted programs, one on each benchmark row's numbers: one right, one wrong, one failing."""
    from hintloom.operators.judging import judge

    # The rows are few and each is a process per case, so they are spread over all cores.
    items = table(spark, sf_dir, "sample_benchmark").select("question_id", "line_no", "problem_idx").repartition(spark.sparkContext.defaultParallelism, "question_id")
    n = F.col("line_no") % 7
    code = F.when(n == 0, "raise ValueError").when(n == 1, "print(int(input()))").otherwise("print(int(input()) + 1)")
    cases = F.array(*[F.struct(x.cast("string").alias("input"), (x + 1).cast("string").alias("output")) for x in (n, F.col("line_no"), F.col("problem_idx"))])
    asked = items.select(F.col("question_id").alias("unique_key"), F.concat(F.lit("```python\n"), code, F.lit("\n```")).alias("output"), cases.alias("cases"))
    return judge(asked).select("unique_key", "status", "lang", "passed", "total_tests")


@query("card_recovery", f"""SELECT line_no, CASE WHEN blank THEN 'card_0_do_empty_after_coerce' END AS error, CASE WHEN NOT blank THEN CASE WHEN line_no % 2 = 0 THEN 'success' ELSE 'unknown' END END AS type, CASE WHEN NOT blank THEN CASE WHEN line_no % 2 = 0 THEN 'r' ELSE 'Potential overfitting risk.' END END AS risk
    FROM (SELECT line_no, {strip_sql("coalesce(heuristic, '')")} = '' AS blank FROM sample_skill_cards)""")
def card_recovery(spark, sf_dir):
    """Raw answers with and without a type and a risk: the strict rules take the former, the tolerant ones the latter."""
    from hintloom.operators.recovery import recovered_cards

    field = lambda c: F.coalesce(F.col(c), F.lit(""))
    even = F.col("line_no") % 2 == 0
    card = F.struct(F.when(even, "success").alias("type"), F.lit("t").alias("trigger"), F.lit("g").alias("tags"), field("heuristic").alias("do"), F.lit("a").alias("avoid"), F.lit("c").alias("check"), F.when(even, "r").alias("risk"))
    rows = table(spark, sf_dir, "sample_skill_cards").select("line_no", recovered_cards(F.concat(F.lit("Cards:\n"), F.to_json(F.array(card)))).alias("r"))
    first = F.get("r.cards", F.lit(0))
    return rows.select("line_no", "r.error", first["type"].alias("type"), first["risk"].alias("risk"))


@query("mock_pipeline", """SELECT mode, 3 * count(*) AS runs, 3 * sum(CASE WHEN mode = 'direct' THEN length(question) ELSE length(question) + length(coalesce(hints, '')) END) AS characters
    FROM (SELECT question, h.hints FROM sample_benchmark b LEFT JOIN (SELECT question_id, string_agg(heuristic, ' ') AS hints FROM sample_skill_cards GROUP BY 1) h USING (question_id)), (VALUES ('direct'), ('hinted')) m(mode) GROUP BY mode""")
def mock_pipeline(spark, sf_dir):
    from hintloom.plans.pipeline import generate

    hints = table(spark, sf_dir, "sample_skill_cards").where("heuristic is not null").groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "heuristic")))["heuristic"], " ").alias("hints"))
    items = R.repeated(table(spark, sf_dir, "sample_benchmark").join(hints, "question_id", "left"), 3)
    items = items.withColumn("mode", F.explode(F.array(F.lit("direct"), F.lit("hinted"))))
    prompt = T.render(F.lit("{{question}}{{hints}}"), {"question": F.col("question"), "hints": F.when(F.col("mode") == "hinted", F.col("hints"))})
    made = generate(items.withColumn("prompt", prompt), "prompt").where("generation.status = 'success'")
    return made.groupBy("mode").agg(F.count("*").alias("runs"), F.sum(F.length("prompt")).alias("characters"))


@query("batch_pipeline")
def batch_pipeline(spark, sf_dir):
    """Every problem to a trace and a card, every benchmark item through retrieval, generation, checking and the summary of both modes."""
    from hintloom.plans.pipeline import run_pipeline

    return run_pipeline(table(spark, sf_dir, "sample_problems"), table(spark, sf_dir, "sample_benchmark"), "{{question}}\n\n{{hints}}")


@query("run_statistics", """SELECT source_model, count(*) AS tasks, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, round(count(*) FILTER (ok) / count(*), 4) AS ok_rate, round(sum(coalesce(retry_attempt, 0)) / count(*), 2) AS avg_attempts,
    count(*) FILTER (s) AS special_total, count(*) FILTER (s AND ok) AS special_ok, round(count(*) FILTER (s AND ok) / nullif(count(*) FILTER (s), 0), 4) AS special_ok_rate FROM (SELECT *, coalesce(lower(trim(status)) = 'success', false) AS ok, coalesce(source_completion_tokens, 0) > 600 AS s FROM sample_source_cot) GROUP BY 1""")
def run_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "sample_source_cot")
    return reports.run_statistics(rows, ["source_model"], F.lower(F.trim("status")) == "success", F.col("retry_attempt"), F.col("source_completion_tokens") > 600)


@query("error_counts", "SELECT coalesce(error, 'unknown') AS error, count(*) AS n, sum(source_prompt_tokens) AS prompt_tokens FROM sample_source_cot WHERE coalesce(lower(trim(status)), '') <> 'success' GROUP BY 1")
def error_counts(spark, sf_dir):
    failed = table(spark, sf_dir, "sample_source_cot").where(F.coalesce(F.lower(F.trim("status")), F.lit("")) != "success")
    return failed.groupBy(F.coalesce("error", F.lit("unknown")).alias("error")).agg(F.count("*").alias("n"), F.sum("source_prompt_tokens").alias("prompt_tokens"))


@query("compile_diagnosis", r"""SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(x, 'use std::|fn main\(\)|for\s+_\s+in\s+0\.\.')) AS rust_syntax, sum(len(list_filter(t, lambda y: y IN ('rust', 'rs')))) AS rust_blocks,
    sum(len(list_filter(t, lambda y: y NOT IN ('cpp', 'c++', 'cc', 'cxx', 'python', 'py')))) AS other_blocks, count(*) FILTER (len(t) = 0) AS no_fence
    FROM (SELECT source, coalesce(flash_output, '') AS x, list_transform(regexp_extract_all(coalesce(flash_output, ''), '```(\w+)', 1), lambda y: lower(y)) AS t FROM joined_sample) GROUP BY 1""")
def compile_diagnosis(spark, sf_dir):
    return reports.compile_diagnosis(table(spark, sf_dir, "joined_sample"), ["source"], F.col("flash_output"))


@query("prompt_profile", "SELECT CASE WHEN passed > 0 THEN 'A' ELSE 'B' END || ':cases=' || least(total_tests, 9) AS profile, count(*) AS n, round(avg(length(coalesce(unique_key, ''))), 2) AS avg_len, max(length(coalesce(unique_key, ''))) AS max_len FROM judge_results GROUP BY 1")
def prompt_profile(spark, sf_dir):
    tier = F.when(F.col("passed") > 0, "A").otherwise("B")
    return reports.prompt_profile(table(spark, sf_dir, "judge_results"), F.concat(tier, F.lit(":cases="), F.least("total_tests", F.lit(9)).cast("string")), F.col("unique_key"))


@query("status_grid", f"""WITH m AS (SELECT lower(lang) AS lang, {_S} AS status, count(*) AS n FROM judge_results GROUP BY 1, 2)
    SELECT a.i * 6 + b.i AS place, a.v AS lang, b.v AS status, coalesce(n::VARCHAR, '-') AS n FROM (SELECT unnest(['python', 'cpp', 'rust']) AS v, unnest(range(3)) AS i) a, (SELECT unnest(['AC', 'WA', 'TLE', 'RE', 'CE', 'MLE']) AS v, unnest(range(6)) AS i) b LEFT JOIN m ON m.lang = a.v AND m.status = b.v""")
def status_grid(spark, sf_dir):
    measures = table(spark, sf_dir, "judge_results").groupBy(F.lower("lang").alias("lang"), T.status(F.col("status")).alias("status")).agg(F.count("*").alias("n"))
    return reports.grid({"lang": ["python", "cpp", "rust"], "status": ["AC", "WA", "TLE", "RE", "CE", "MLE"]}, measures)
