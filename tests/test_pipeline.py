import json

import pytest
from oracle import SF_DIR
from pyspark.sql import functions as F

from hintloom.plans import pipeline, registry, report_queries

assert report_queries


def test_hints_reach_the_hinted_prompts(spark):
    problems = spark.createDataFrame([(1, "sums", "Add the apples"), (2, "time", "Clocks and trains"), (3, None, None)], "line_no bigint, topic string, question string")
    items = spark.createDataFrame([("b1", "How many apples?", "2"), ("b2", "zzz", "3")], "question_id string, question string, answer string")
    rows = {r["mode"]: r for r in pipeline.run_pipeline(problems, items, "{{question}}{{hints}}", repeats=2, k=1).collect()}
    assert set(rows) == {"direct", "hinted"} and rows["hinted"].attempts == 4
    assert rows["hinted"].avg_prompt_tokens > rows["direct"].avg_prompt_tokens
    traces = problems.withColumns(pipeline.mock_trace(F.col("question")))
    hints = pipeline.retrieved_hints(pipeline.mock_cards(traces).withColumn("card_id", F.col("line_no")), items, 1).collect()
    assert [(h.question_id, h.hints.split(" tasks")[0]) for h in hints] == [("b1", "1. For sums")]


def test_the_registered_pipeline_uses_its_hints(spark):
    rows = {r["mode"]: r for r in registry.QUERIES["batch_pipeline"](spark, SF_DIR).collect()}
    assert {r.attempts for r in rows.values()} == {1200}
    assert rows["hinted"].avg_prompt_tokens > rows["direct"].avg_prompt_tokens + 50


GOOD = {"type": "success", "trigger": "t", "tags": "g", "do": "d", "avoid": "a", "check": "c"}


def test_repair_and_gate(spark):
    good = json.dumps({"cards": [GOOD, GOOD | {"trigger": "bad"}]})
    bad = json.dumps({"cards": [GOOD | {"trigger": "bad"}]})

    def call(prompt):
        if prompt == "down":
            raise RuntimeError("no")
        content = "no json" if prompt == "q" else bad if "no_json_object" in prompt else good if "quality_gate:leak" in prompt else "?"
        return {"content": content, "prompt_tokens": 1, "completion_tokens": 2}

    df = spark.createDataFrame([("q",), ("down",)], "p string")
    gate = lambda card: ["leak"] if card["trigger"] == ["bad"] else []
    got = {r.p: r.recovered for r in pipeline.recovered_with_retries(df, "p", call, gate, sleep=lambda s: None).collect()}
    assert got["q"].ok and got["q"].attempts == 3 and len(json.loads(got["q"].cards)) == len(json.loads(got["q"].rejected)) == 1
    assert not got["down"].ok and got["down"].attempts == 3 and got["down"].error == "RuntimeError: no"


def test_two_steps(spark, tmp_path):
    log = str(tmp_path / "calls")

    def call(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return {"content": "[[40]]" if prompt.startswith("budget") else prompt, "prompt_tokens": 3, "completion_tokens": 5}

    df = spark.createDataFrame([("x",)], "q string")
    got = pipeline.generate_two_step(df, "q", "budget of {{question}}", "solve {{question}} in {{budget}}", call).first()
    assert got.budget == 40 and got.generation.content == "solve x in 40" and (got.generation.prompt_tokens, got.generation.completion_tokens) == (6, 10)
    assert open(log).read().splitlines() == ["budget of x", "solve x in 40"]


def test_verifier(spark):
    def call(prompt):
        if "gone" in prompt:
            raise ValueError
        return {"content": "incorrect" if "nine" in prompt else "Correct.\nINCORRECT" if "four" in prompt else "well"}

    rows = spark.createDataFrame([(1, "4", "four"), (2, "4", "nine"), (3, "4", "x"), (4, None, "four")], "i int, g string, c string").withColumn("q", F.lit("q"))
    of = lambda *a: {r.i: (r.verdict, r.is_correct) for r in pipeline.verified(rows, "q", "g", "c", *a).collect()}
    assert of("llm", call) == {1: ("CORRECT", 1), 2: ("INCORRECT", 0), 3: ("UNKNOWN", None), 4: ("UNKNOWN", None)}
    assert of("none")[1] == ("SKIPPED", None) and of("exact")[1] == ("INCORRECT", 0)
    with pytest.raises(ValueError):
        of("other")
    items = spark.createDataFrame([("q1", "four?", "4")], "question_id string, question string, answer string")
    runs = pipeline.benchmark_runs(items, None, "{{question}}", 1, None, "llm", call).collect()
    assert [r.is_correct for r in runs] == [1]
