import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hintloom.functions import text as T
from hintloom.operators import cards, dense, fusion, judging, lexical, recovery, relational, reports, sampling
from hintloom.plans import pipeline
from hintloom.streaming import monitor


def test_bm25_against_definition(spark):
    docs = [(1, "a b b c"), (2, "b c d"), (3, ""), (4, None), (5, "b c d"), (None, "a")]
    queries = [("q1", "b b d"), ("q2", "zzz"), ("q3", None)]
    d = spark.createDataFrame(docs, "id bigint, t string")
    q = spark.createDataFrame(queries, "qid string, t string")
    for weighting, times in (("tf", 2), ("distinct", 1)):
        got = {(r.query, r.doc): (r.score, r["rank"]) for r in lexical.bm25_top_k(d, "id", "t", q, "qid", "t", 2, weighting).collect()}
        n, avg = 5, (4 + 3 + 0 + 0 + 3) / 5
        idf = {t: np.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in {"b": 3, "d": 2}.items()}
        tf = lambda f, dl: f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avg))
        two = round(times * idf["b"] * tf(1, 3) + idf["d"] * tf(1, 3), 6)
        assert got == {("q1", 2): (pytest.approx(two), 1), ("q1", 5): (pytest.approx(two), 2)}
    assert lexical.bm25_top_k(d.limit(0), "id", "t", q, "qid", "t").collect() == []


def test_dense_against_numpy(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(60, 5)).round(2)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(100, None), (101, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>").repartition(5)
    got = dense.dense_top_k(df, "id", "v", df.where("id % 20 = 0 and id < 100"), "id", "v", 4).collect()
    w = v.astype(np.float32).astype(float)
    for q in (0, 20, 40):
        scores = np.round(w @ w[q], 6)
        want = sorted(range(60), key=lambda i: (-scores[i], i))[:4]
        assert [r.vec for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == want


def model_mmr(tokens, k, lam=0.7):
    if len(tokens) <= k:
        return list(range(len(tokens)))
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    chosen, left = [0], list(range(1, len(tokens)))
    while len(chosen) < k and left:
        best = max(left, key=lambda i: (round(lam / (i + 1) - (1 - lam) * max(jac(tokens[i], tokens[j]) for j in chosen), 9), -i))
        chosen.append(best)
        left.remove(best)
    return chosen


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdef"), max_size=4), min_size=1, max_size=8), st.integers(1, 5))
def test_mmr_against_model(spark, lists, k):
    c = [(i, f"d{i}", sorted(set(t))) for i, t in enumerate(lists)]
    df = spark.createDataFrame([(c,)], "candidates array<struct<rank:int,doc:string,tokens:array<string>>>")
    got = [x["rank"] for x in df.select(fusion.mmr(F.col("candidates"), k).alias("m")).first().m]
    assert got == model_mmr([set(t) for _, _, t in c], k)


def test_mix(spark):
    schema = "chosen array<struct<rank:int,doc:string,type:string>>, cand array<struct<rank:int,doc:string,type:string>>"

    def run(chosen, cand):
        return [x.doc for x in spark.createDataFrame([(chosen, cand)], schema).select(fusion.mix_in(F.col("chosen"), F.col("cand")).alias("m")).first().m]

    s = [(0, "a", "success"), (3, "b", "success")]
    assert run(s, [*s, (5, "f", "failure"), (2, "g", "trap")]) == ["a", "g"]
    assert run(s, [*s, (16, "f", "failure")]) == ["a", "b"]
    assert run([(0, "a", "trap"), (1, "b", "success")], [(2, "f", "failure")]) == ["a", "b"]


def test_gate_and_rrf(spark):
    df = spark.createDataFrame([(0.49,), (0.59,), (0.6,), (0.7,), (0.85,), (None,)], "s double")
    assert [(r.skipped, r.effective_k) for r in fusion.gated(df, "s", 5).collect()] == [(True, 0), (False, 2), (False, 3), (False, 4), (False, 5), (True, 0)]
    assert [r.k for r in df.select(fusion.dynamic_k(F.col("s"), 1).alias("k")).limit(5).collect()] == [1, 1, 2, 3, 1]
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query string, doc string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query string, doc string, rank int")
    got = fusion.rrf([a, b], 3).orderBy("rank").collect()
    assert [(r.doc, r.score) for r in got] == [("y", round(1 / 62 + 1 / 61, 6)), ("x", round(1 / 61, 6)), ("z", round(1 / 62, 6))]


def card(**kw):
    base = {k: None for k in (*cards.SCALARS, *cards.LISTS)}
    return {**base, **kw}


def test_card_issues(spark):
    rows = [
        card(type="edge_fix", trigger=["wrong answer on hidden cases"], do=["x"], edge_pattern="p", fix_hint="h"),
        card(type="wrong_approach", trigger=["greedy by end time"], do=["sort"], check=["ties"], wrong_approach="w", correct_direction="c"),
        card(type="edge_fix", trigger=["100000 to 999999"], do=["x"], edge_pattern="p", fix_hint="h"),
        card(type="odd"), card(type="success", trigger=["a" * 130], check=["ok"]),
    ]
    schema = ", ".join([f"`{k}` string" for k in cards.SCALARS] + [f"`{k}` array<string>" for k in cards.LISTS])
    df = spark.createDataFrame([tuple(r[k] for k in (*cards.SCALARS, *cards.LISTS)) for r in rows], schema)
    c = {k: F.col(f"`{k}`") for k in (*cards.SCALARS, *cards.LISTS)}
    got = [set(r.i) for r in df.select(cards.issues(c).alias("i")).collect()]
    assert got[0] >= {"judge_leak", "trigger_low_signal"} and got[1] == set() and got[2] == {"trigger_literal_example"}
    assert got[3] == {"unexpected_type", "trigger_empty", "action_gap", "type_specific_gap"} and got[4] == {"trigger_too_long"}
    report = cards.quality_report(df.select(cards.issues(c).alias("i"), c["trigger"].alias("t")), "i", "t").first()
    assert (report.total, report.ready, report.ready_pct) == (5, 1, 20.0)


def test_condition_summary(spark):
    rows = [("m", "a", 0, "success", 1, 10, 5, 0.1), ("m", "a", 1, "error", None, None, None, None), ("m", "b", 0, "success", None, 20, None, 0.3)]
    df = spark.createDataFrame(rows, "mode string, question_id string, repeat_idx int, status string, is_correct int, prompt_tokens int, completion_tokens int, cost double")
    r = reports.condition_summary(df, ["mode"]).first()
    assert (r.questions, r.repeats, r.attempts, r.success_rate, r.mean_accuracy, r.accuracy_std, r.majority_accuracy) == (2, 2, 4, 50.0, 25.0, 25.0, 0.0)
    assert (r.avg_prompt_tokens, r.avg_completion_tokens, r.avg_cost) == (15.0, 2.5, 0.2)


def test_keyed(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), (None, 5, "z")], "k string, n int, v string")
    assert {(r.k, r.n, r.v) for r in relational.last_wins(df, ["k"], "n").collect()} == {("a", 2, None), ("b", 1, "y"), (None, 5, "z")}
    assert {(r.k, r.n) for r in relational.first_wins(df, ["k"], "n").collect()} == {("a", 1), ("b", 1), (None, 5)}
    done = spark.createDataFrame([("a", "bad"), ("b", "ok"), (None, "ok")], "k string, s string")
    assert {r.k for r in relational.remaining(df, done, "k", F.col("s") == "ok").collect()} == {"a", None}
    new = spark.createDataFrame([("a", None)], "k string, v string")
    assert {(r.k, r.n, r.v) for r in relational.merged(df, new, "k", ["v"]).collect()} == {("a", 1, None), ("a", 2, None), ("b", 1, "y"), (None, 5, "z")}
    with pytest.raises(ValueError, match="missing"):
        relational.require_complete(df.where("k = 'a'"), done.where("k = 'b'"), "k")


def test_sampling(spark):
    assert sampling.allocation({"a": 90, "b": 9, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    df = spark.createDataFrame([(i, "ab"[i % 10 == 0]) for i in range(200)] + [(999, None)], "k bigint, s string")
    one = {(r.k, r.split) for r in sampling.stratified_holdout(df, "k", "s", 20).collect()}
    two = {(r.k, r.split) for r in sampling.stratified_holdout(df.repartition(7), "k", "s", 20).collect()}
    assert one == two and sum(x == "holdout" for _, x in one) == 20 and (999, None) in one
    r = sampling.bootstrap_mean(df.select(F.lit("g").alias("g"), (F.col("k") % 2).alias("v")).where("v is not null"), "g", "v", 2000).first()
    assert r.low < r["mean"] < r.high and abs((r.high - r.low) - 2 * 1.96 * 0.5 / 201**0.5) < 0.03
    q = spark.createDataFrame([("x",), ("y",)], "q string")
    a = {(r.query, r["rank"], r.item) for r in sampling.seeded_sample(df, "k", q, "q", 3, "1").collect()}
    assert a == {(r.query, r["rank"], r.item) for r in sampling.seeded_sample(df.repartition(9), "k", q, "q", 3, "1").collect()} and len(a) == 6


PRINT = "```python\na = int(input())\nprint(a * 2)\n```"


@pytest.mark.parametrize(
    ("row", "status"),
    [
        ({"output": PRINT, "cases": [{"input": "2", "output": "4\n"}, {"input": "3", "output": "6.0000001"}]}, "AC"),
        ({"output": PRINT, "cases": [{"input": "2", "output": "5"}]}, "WA"), ({"output": PRINT, "cases": [{"input": "x", "output": "5"}]}, "RE"),
        ({"output": "```python\nwhile True: pass\n```", "cases": [{"input": "", "output": ""}], "timeout_s": 0.5}, "TLE"),
        ({"output": PRINT, "cases": []}, "NO_TESTS"), ({"output": PRINT, "cases": None}, "NO_CASES"), ({"output": " ", "cases": []}, "NO_OUTPUT"),
        ({"output": "fn main() -> i32 { let mut x = 1; }", "cases": [{}]}, "UNSUPPORTED_LANG"),
        ({"output": "```python\ndef f(a, b):\n    return [a + b]\n```", "mode": "function", "fn_name": "f", "cases": [{"input": "[1, 2]", "output": "[3.0000000001]"}]}, "AC"),
        ({"output": PRINT, "checker": "print(1 if open('output.txt').read().strip() == '4' else 0)", "cases": [{"input": "2", "output": "-"}]}, "AC"),
        ({"output": "```python\nopen('output.txt', 'w').write(open('input.txt').read()[::-1])\n```", "mode": "file", "cases": [{"input": "ab", "output": "ba"}]}, "AC"),
    ],
)
def test_judge(row, status):
    assert judging.judge_row(row)["status"] == status


def test_judge_stops_and_maps(spark):
    r = judging.judge_row({"output": PRINT, "cases": [{"input": "1", "output": "9"}] * 5}, stop_after=2)
    assert r["case_status"] == ["WA", "WA", "SKIPPED", "SKIPPED", "SKIPPED"]
    df = spark.createDataFrame([("k", PRINT, [("2", "4")])], "unique_key string, output string, cases array<struct<input:string,output:string>>")
    assert judging.judge(df).first().status == "AC"
    assert judging.same_json({"a": [1, True]}, {"a": [1.0, 1]}) and not judging.same_json([1], [1, 2]) and not judging.same_json("1", 1)


def test_recovery(spark):
    good = '{"cards": [{"type": "Success ", "trigger": "a; b", "tags": ["t"], "do": ["x"], "avoid": ["y"], "check": "- z", "risk": ["r", "s"]}]}'
    got = recovery.recover("Here:\n```json\n" + good + "\n```")
    assert got["error"] is None and got["cards"][0]["trigger"] == ["a", "b"] and got["cards"][0]["risk"] == "r ; s" and got["cards"][0]["type"] == "success"
    assert recovery.recover("bad { x ] then " + good + " end")["error"] is None
    assert recovery.recover(good.replace('"a; b"', r'"\alpha"'))["cards"][0]["trigger"] == [r"\alpha"]
    assert recovery.recover(None)["error"] == "empty_raw_content" and recovery.recover("none")["error"] == "no_json_object" and recovery.recover("[1]")["error"] == "card_0_not_object"
    assert recovery.validated([{"type": "x"}])[1].startswith("card_0_missing:")
    df = spark.createDataFrame([(good,), (None,)], "t string").select(recovery.recovered_cards(F.col("t")).alias("r")).collect()
    assert df[0].r.cards[0].do == ["x"] and df[1].r.error == "empty_raw_content"
    assert {k: len(v) for k, v in recovery.fit_prompt({"a": "x" * 100, "b": "y" * 100}, ["b", "a"], {"b": 40}, 130, 10).items()} == {"a": 80, "b": 40}


def test_tolerant_cards():
    whole = {"trigger": "a", "tags": "t", "do": "x", "avoid": "y", "check": "z"}
    assert recovery.validated([whole])[1] == "card_0_missing:type"
    cards, error = recovery.validated([whole], tolerant=True)
    assert error is None and cards[0]["type"] == "unknown" and cards[0]["risk"] == "Potential overfitting risk."
    assert recovery.validated([whole | {"do": " ; "}], tolerant=True)[1] is None  # the text itself stands where splitting leaves nothing
    assert recovery.validated([whole | {"do": []}], tolerant=True)[1] == "card_0_do_empty_after_coerce"
    assert recovery.validated([whole, 5], tolerant=True)[1] == "card_1_not_object"
    assert recovery.validated("x")[1] == "root_not_object_or_list" and recovery.validated({"cards": {}})[1] == "cards_missing_or_empty"
    assert recovery.items("- a; b\n") == ["a", "b"] and recovery.items([" c ", "", 4]) == ["c", "4"] and recovery.items(None) == [] == recovery.items(" ")


def test_failure_cards():
    card = {"type": "x", "trigger": ["a"] * 9, "tags": "t", "edge_pattern": " e ", "do": "1;2;3;4"}
    cards, error = recovery.validated_failures({"cards": [card, card | {"type": "Wrong_Approach", "wrong_approach": "w"}]})
    assert error is None and cards[0] == {"type": "edge_fix", "trigger": ["a"] * 4, "tags": ["t"], "do": ["1", "2", "3"], "avoid": [], "check": [], "edge_pattern": "e", "fix_hint": ""}
    assert cards[1]["type"] == "wrong_approach" and cards[1]["wrong_approach"] == "w" and cards[1]["correct_direction"] == ""
    assert recovery.validated_failures([{"trigger": "a"}])[1] == "card_0_tags_empty" and recovery.validated_failures([3])[1] == "card_0_not_object"


def test_tagged_code(spark):
    texts = [
        "<code_block>\n#include <x>\nint main() {}\n</code_block>", "<CODE_BLOCK>def f(x):\n  return x</CODE_BLOCK>\n```text\n" + "y" * 99 + "\n```",
        "<code_block>use std::io; fn main() {}</code_block>", "```rust\nfn x() {}\n```", "```c++\na\n```\n```py\nlonger\n```\n```py\nlonges\n```", " plain ", None, "```python\nopen",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.best_code(F.col("t")).alias("c"), T.code_block_error(F.lit("re "), F.col("t")).alias("e"))
    for r in df.collect():
        assert (r.c.lang, r.c.code or "") == judging.pick_code(r.t), r.t
        assert r.e == (r.t is not None and "code_block" in r.t.lower())
    assert judging.pick_code(texts[0])[0] == "cpp" and judging.pick_code(texts[1]) == ("python", "def f(x):\n  return x")
    assert judging.pick_code(texts[4])[1] == "longer" and judging.pick_code(texts[2])[1].startswith("use std")


def test_pair_scores_equal_those_of_the_search(spark):
    rnd = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice("a b c d e f g h".split()) for _ in range(rnd.randrange(12)))) for i in range(60)] + [(99, None)], "doc bigint, body string")
    asks = spark.createDataFrame([("q1", "a a b"), ("q2", "h"), ("q3", None)], "q string, t string")
    found = lexical.bm25_top_k(docs, "doc", "body", asks, "q", "t", 100)
    pairs = docs.select("doc").crossJoin(asks.select(F.col("q").alias("query")))
    scored = {(r.query, r.doc): r.score for r in lexical.bm25_scores(docs, "doc", "body", asks, "q", "t", pairs).collect()}
    assert len(scored) == 61 * 3 and {k: v for k, v in scored.items() if v > 0} == {(r.query, r.doc): r.score for r in found.collect()}
    lexical.VALUES_AT_ONCE, kept = 3, lexical.VALUES_AT_ONCE
    assert sorted(map(tuple, lexical.bm25_top_k(docs, "doc", "body", asks, "q", "t", 100).collect())) == sorted(map(tuple, found.collect()))
    lexical.VALUES_AT_ONCE = kept
    assert lexical.bm25_top_k(docs, "doc", "body", asks.limit(0), "q", "t").collect() == []


def test_pipeline(spark):
    items = spark.createDataFrame([("q1", "What is 1+1?", "2"), ("q2", None, None)], "question_id string, question string, answer string")
    hints = spark.createDataFrame([("q1", "add them")], "question_id string, hints string")
    runs = pipeline.benchmark_runs(items, hints, "{{question}} {{hints}}", 2).collect()
    assert len(runs) == 8 and {r.status for r in runs} == {"success"} and {r.is_correct for r in runs} == {0}

    def call(prompt):
        if "1+1" not in prompt:
            raise RuntimeError("no")
        return {"content": "Final answer: 2", "prompt_tokens": 3, "completion_tokens": 4}

    got = pipeline.generate(items.select("question_id", F.coalesce("question", F.lit("")).alias("p")), "p", call, retries=1, sleep=lambda s: None).collect()
    assert {(r.question_id, r.generation.status, r.generation.attempts) for r in got} == {("q1", "success", 1), ("q2", "error", 2)}
    assert pipeline.parse_experiment("hybrid_m3-5") == {"strategy": "hybrid", "label": "m3", "k": 5}
    with pytest.raises(ValueError):
        pipeline.parse_experiment("nothing")
    traces = items.withColumns({**pipeline.mock_trace(F.col("question")), "topic": F.lit("sums")})
    assert pipeline.mock_cards(traces).first().keywords == "1, is, what"


def test_monitor(spark, tmp_path):
    df = spark.createDataFrame([("a", " "), ("b", "x"), ("c", None)], "k string, t string")
    assert monitor.wait_step(df, "t") == (2, True) and monitor.wait_step(df, "t", ready=1) == (2, False)
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"k": "a", "t": "x"}\n{"k": "b", "t": ""}\n')
    for name in (None, "2.json"):
        if name:
            (src / name).write_text('{"k": "c", "t": "y"}\n')
        monitor.append_stream(spark, df.schema, str(src), str(tmp_path / "out"), str(tmp_path / "state"), F.col("t") != "")
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]


def test_runs_and_medians(spark):
    rnd = random.Random(1)
    rows = [("g", "x" * rnd.randrange(9)) for _ in range(10)]
    df = spark.createDataFrame(rows, "g string, t string")
    lengths = sorted(len(t) for _, t in rows)
    r = reports.upper_median_length(df, ["g"], F.col("t")).first()
    assert (r.n, r.upper_median) == (10, lengths[5])
    s = spark.createDataFrame([("k", i, x) for i, x in enumerate(["WA", "AC", "WA", "TLE", "WA", "AC"])], "k string, i int, s string")
    assert [r.i for r in reports.failing_runs(s, "k", ["i"], F.col("s"), 3).collect()] == [4]
    assert reports.first_failure(s, "k", "i", F.col("s")).first().overall == "WA"
    picks = {(r.i, r.why) for r in reports.diagnostic_picks(s, "k", "i", F.col("s"), F.col("i")).collect()}
    assert picks == {(0, "first"), (4, "last"), (3, "tle")}
