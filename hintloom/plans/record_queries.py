"""Queries that assemble records: aligned samples, unions, set operations, cases, groupings."""

from __future__ import annotations

from pyspark.sql import functions as F

from hintloom.functions import text as T
from hintloom.operators import cases
from hintloom.operators import relational as R
from hintloom.plans.registry import query, table

_ST = r"upper(regexp_replace(coalesce(status, ''), '^\s+|\s+$', '', 'g'))"


@query("aligned_samples", f"""WITH v AS (SELECT unique_key, model_label, arg_max({_ST}, line_no) AS s FROM judge_results GROUP BY 1, 2), l AS (SELECT min(model_label) AS a, max(model_label) AS b FROM judge_results),
    x AS (SELECT j.line_no, a.s AS sa, b.s AS sb, coalesce(length(flash_output), 0) > 0 AS oa, coalesce(length(doubao_output), 0) > 0 AS ob FROM joined_sample j, l LEFT JOIN v a ON a.unique_key = j.unique_key AND a.model_label = l.a LEFT JOIN v b ON b.unique_key = j.unique_key AND b.model_label = l.b)
    SELECT CASE WHEN sa IS NULL OR sb IS NULL THEN 'not judged' WHEN NOT oa OR NOT ob THEN 'no output' WHEN sa = '' OR sb = '' THEN 'no status' ELSE 'kept' END AS reason, count(*) AS n FROM x GROUP BY 1""")
def aligned_samples(spark, sf_dir):
    judged = table(spark, sf_dir, "judge_results")
    low, high = judged.agg(F.min("model_label"), F.max("model_label")).first()
    last = R.last_wins(judged.select("unique_key", "model_label", "line_no", T.status(F.col("status")).alias("s")), ["unique_key", "model_label"], "line_no")
    rows = table(spark, sf_dir, "joined_sample")
    for label, name in ((low, "sa"), (high, "sb")):
        rows = rows.join(last.where(F.col("model_label") == label).select("unique_key", F.col("s").alias(name)), "unique_key", "left")
    there = (F.length(F.coalesce("flash_output", F.lit(""))) > 0) & (F.length(F.coalesce("doubao_output", F.lit(""))) > 0)
    reason = F.when(F.col("sa").isNull() | F.col("sb").isNull(), "not judged").when(~there, "no output").when((F.col("sa") == "") | (F.col("sb") == ""), "no status").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("cards_by_problem", "SELECT question_id, array_to_string(list(line_no ORDER BY line_no), ',') AS cards FROM sample_skill_cards GROUP BY 1")
def cards_by_problem(spark, sf_dir):
    return table(spark, sf_dir, "sample_skill_cards").groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("line_no")), lambda x: x.cast("string")), ",").alias("cards"))


@query("library_union", "SELECT 'problem' AS origin, line_no, question AS body, NULL AS keywords FROM sample_problems UNION ALL SELECT 'card', line_no, heuristic, keywords FROM sample_skill_cards UNION ALL SELECT 'benchmark', line_no, question, NULL FROM sample_benchmark")
def library_union(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    line = F.col("line_no")
    return cases.adapt({
        "problem": (t("sample_problems"), {"line_no": line, "body": F.col("question")}), "card": (t("sample_skill_cards"), {"line_no": line, "body": F.col("heuristic"), "keywords": F.col("keywords")}),
        "benchmark": (t("sample_benchmark"), {"line_no": line, "body": F.col("question")}),
    })


@query("key_intersection", "SELECT unique_key FROM joined_sample INTERSECT SELECT unique_key FROM judge_results")
def key_intersection(spark, sf_dir):
    return table(spark, sf_dir, "joined_sample").select("unique_key").intersect(table(spark, sf_dir, "judge_results").select("unique_key"))


@query("train_keys", "SELECT unique_key FROM joined_sample EXCEPT SELECT unique_key FROM joined_sample WHERE split_name <> 'train'")
def train_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "joined_sample")
    return rows.select("unique_key").subtract(rows.where("split_name <> 'train'").select("unique_key"))


@query("status_by_label_pivot", f"SELECT model_label, count(*) FILTER ({_ST} = 'AC') AS ac, count(*) FILTER ({_ST} = 'WA') AS wa, count(*) FILTER ({_ST} = 'TLE') AS tle FROM judge_results GROUP BY 1")
def status_by_label_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "judge_results").select("model_label", T.status(F.col("status")).alias("s"))
    wide = rows.groupBy("model_label").pivot("s", ["AC", "WA", "TLE"]).count()
    return wide.select("model_label", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c.lower()) for c in ("AC", "WA", "TLE")])


@query("status_display_order", f"SELECT status, n, row_number() OVER (ORDER BY coalesce(nullif(list_position(['AC', 'WA', 'TLE', 'RE', 'CE'], status), 0), 6), status) AS place FROM (SELECT {_ST} AS status, count(*) AS n FROM judge_results GROUP BY 1)")
def status_display_order(spark, sf_dir):
    from pyspark.sql.window import Window

    counts = table(spark, sf_dir, "judge_results").groupBy(T.status(F.col("status")).alias("status")).agg(F.count("*").alias("n"))
    return cases.ordered_statuses(counts, "status").withColumn("place", F.row_number().over(Window.orderBy("place")).cast("bigint"))


@query("case_pairing", r"SELECT line_no, len(a) AS n_in, least(len(a), len(b)) AS n_pairs, coalesce(a[least(len(a), len(b))] || '>' || b[least(len(a), len(b))], '') AS last_pair FROM (SELECT line_no, string_split(coalesce(question, ''), ' ') AS a, string_split(coalesce(keywords, ''), ', ') AS b FROM sample_skill_cards)")
def case_pairing(spark, sf_dir):
    rows = table(spark, sf_dir, "sample_skill_cards").select("line_no", F.split(F.coalesce("question", F.lit("")), " ").alias("a"), F.split(F.coalesce("keywords", F.lit("")), ", ").alias("b"))
    pairs = rows.select("line_no", F.size("a").cast("bigint").alias("n_in"), cases.paired(F.col("a"), F.col("b")).alias("p"))
    last = F.try_element_at("p", F.lit(-1))
    return pairs.select("line_no", "n_in", F.size("p").cast("bigint").alias("n_pairs"), F.coalesce(F.concat(last["input"], F.lit(">"), last["output"]), F.lit("")).alias("last_pair"))


@query("verdict_details", "SELECT line_no, nullif(concat_ws(chr(10), CASE WHEN trim(coalesce(error, '')) <> '' THEN '[compile_error]' || chr(10) || error END, CASE WHEN trim(coalesce(status, '')) <> '' THEN '[detail]' || chr(10) || status END), '') AS detail FROM sample_source_cot")
def verdict_details(spark, sf_dir):
    return table(spark, sf_dir, "sample_source_cot").select("line_no", cases.verdict_detail(F.col("error"), F.col("status"), F.lit(None).cast("string")).alias("detail"))


@query("verdict_summaries", f"""WITH j AS (SELECT unique_key, model_label, {_ST} AS s FROM judge_results), c AS (SELECT unique_key, model_label, s, count(*) AS n FROM j GROUP BY ALL),
    t AS (SELECT unique_key, model_label, 'verdict: ' || CASE WHEN count(*) = 1 AND min(s) = 'AC' THEN 'AC' ELSE 'mixed' END || '; cases: ' || string_agg(s || '=' || n, ', ' ORDER BY s) AS x FROM c GROUP BY ALL)
    SELECT unique_key, model_label, CASE WHEN length(x) <= 40 THEN x ELSE substr(x, 1, 20) || chr(10) || '...' || chr(10) || right(x, 20) END AS summary FROM t""")
def verdict_summaries(spark, sf_dir):
    """The operator's summary per key and model, shortened to forty characters. Statuses are counted before they are listed: a key's list has an entry per status."""
    counts = table(spark, sf_dir, "judge_results").groupBy("unique_key", "model_label", T.status(F.col("status")).alias("s")).agg(F.count("*").alias("n"))
    merged = counts.groupBy("unique_key", "model_label").agg(F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("c"))
    verdict = F.when((F.size("c") == 1) & F.map_contains_key("c", "AC"), "AC").otherwise("mixed")
    return merged.select("unique_key", "model_label", cases.counted_summary(verdict, F.col("c"), 40).alias("summary"))


@query("length_profile", "SELECT topic, length(question) // 100 AS bucket, count(*) AS n, round(avg(length(question)), 4) AS mean, max(length(question)) AS longest FROM sample_problems GROUP BY 1, 2")
def length_profile(spark, sf_dir):
    n = F.length("question")
    return table(spark, sf_dir, "sample_problems").groupBy("topic", F.floor(n / 100).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean"), F.max(n).cast("bigint").alias("longest"))


@query("empty_output_rates", r"SELECT source, count(*) AS n, count(*) FILTER (e) AS empty, round(count(*) FILTER (e) * 100.0 / count(*), 4) AS pct FROM (SELECT source, regexp_replace(coalesce(flash_output, ''), '\s+', '', 'g') = '' AS e FROM joined_sample) GROUP BY 1")
def empty_output_rates(spark, sf_dir):
    empty = T.filled(F.coalesce("flash_output", F.lit(""))).isNull()
    return table(spark, sf_dir, "joined_sample").groupBy("source").agg(F.count("*").alias("n"), F.count_if(empty).alias("empty"), F.round(F.count_if(empty) * 100.0 / F.count("*"), 4).alias("pct"))


@query("representation_library", r"""SELECT line_no, question_id, CASE WHEN line_no % 2 = 0 THEN 64 ELSE 128 END::INT AS budget, md5(regexp_replace(substr(coalesce(nullif(regexp_replace(heuristic, '^\s+|\s+$', '', 'g'), ''), question, ''), 1, CASE WHEN line_no % 2 = 0 THEN 256 ELSE 512 END), '\s+$', '')) AS body FROM sample_skill_cards""")
def representation_library(spark, sf_dir):
    body = F.coalesce(T.filled(T.strip(F.col("heuristic"))), F.col("question"), F.lit(""))
    even = F.col("line_no") % 2 == 0
    cut = F.when(even, T.trim_to_budget(body, 64)).otherwise(T.trim_to_budget(body, 128))
    return table(spark, sf_dir, "sample_skill_cards").select("line_no", "question_id", F.when(even, 64).otherwise(128).alias("budget"), F.md5(cut).alias("body"))


@query("daily_sessions", "SELECT user_id, sum(new) AS sessions, count(*) AS events FROM (SELECT user_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1")
def daily_sessions(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w))
    fresh = F.col("before").isNull() | (F.col("ts") > F.col("before") + F.expr("INTERVAL 1 DAY"))
    return rows.withColumn("fresh", fresh.cast("bigint")).groupBy("user_id").agg(F.sum("fresh").alias("sessions"), F.count("*").alias("events"))
