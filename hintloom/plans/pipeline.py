"""The batch pipeline: problems, traces, cards, retrieval, generation, checking; model calls are pluggable and mocked by default."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hintloom.functions import text as T
from hintloom.operators import lexical, recovery, reports
from hintloom.operators.cards import retrieval_text

RECOVERED = "ok boolean, attempts int, prompt_tokens bigint, completion_tokens bigint, raw_content string, cards string, rejected string, error string"
#: What a model is asked after an answer that isn't a set of good cards, and to check an answer.
REPAIR = "Rewrite the text below as one strict JSON object with the key `cards`, nothing else. Each card has type, trigger, tags, do, avoid and check.\nFix this first: {error}\n\n{content}"
VERIFY = "Does the candidate's final answer equal the official one? Reply CORRECT or INCORRECT.\n\nProblem:\n{{question}}\n\nOfficial answer:\n{{gold}}\n\nCandidate answer:\n{{candidate}}"
GENERATION = "content string, prompt_tokens bigint, completion_tokens bigint, status string, error string, attempts int"


def parse_experiment(name: str) -> dict:
    """The settings that an experiment's name states: strategy, embedding label and number of results, e.g. ``hybrid_m3-5``."""
    if name in ("direct", "baseline"):
        return {"strategy": "direct", "label": None, "k": 0}
    head, _, tail = name.rpartition("-")
    if not head or not tail.isdigit():
        raise ValueError(f"not an experiment: {name}")
    strategy, _, label = head.partition("_")
    if strategy not in ("bm25", "embed", "hybrid", "random", "twostage"):
        raise ValueError(f"unknown strategy: {strategy}")
    return {"strategy": strategy, "label": label or None, "k": int(tail)}


def backoff(attempt: int, base: float = 1.0, most: float = 20.0) -> float:
    return min(most, base * 2**attempt)


def mock_trace(question: Column) -> dict[str, Column]:
    """Deterministic thinking and response for a question."""
    head = T.clip(F.coalesce(question, F.lit("")), 80)
    return {"model_think": F.concat(F.lit("Restate the task: "), head, F.lit(" Then solve it step by step.")), "model_response": F.concat(F.lit("Final answer: "), F.left(F.md5(F.coalesce(question, F.lit(""))), F.lit(6)))}


def mock_cards(df: DataFrame) -> DataFrame:
    """Traces with a deterministic heuristic and keywords, natively."""
    words = F.slice(F.array_sort(F.array_distinct(T.word_tokens(F.coalesce("question", F.lit(""))))), 1, 5)
    return df.withColumns({"heuristic": F.concat(F.lit("1. For "), F.coalesce("topic", F.lit("any")), F.lit(" tasks, state what is asked.\n2. Check the result against the givens.")), "keywords": F.array_join(words, ", "), "status": F.lit("success")})


def generate(df: DataFrame, prompt_col: str, call: Callable[[str], dict] | None = None, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``df`` with ``generation``: what ``call`` makes of each prompt, the deterministic mock without one.

    ``call`` takes a prompt and returns content and token counts; it is shipped to the executors, builds its own client there and must
    not carry keys. A failing call is tried again after a growing wait; what still fails gives an ``error`` row, so that a resumed run
    finds it. Rows are generated where they lie; the number of partitions is the number of calls at a time.
    """
    if call is None:
        prompt = F.coalesce(F.col(prompt_col), F.lit(""))
        content = F.concat(F.lit("Mock answer.\nFinal answer: "), F.left(F.md5(prompt), F.lit(6)))
        fields = {"content": content, "prompt_tokens": T.estimate_tokens(prompt).cast("bigint"), "completion_tokens": T.estimate_tokens(content).cast("bigint"), "status": F.lit("success"), "error": F.lit(None).cast("string"), "attempts": F.lit(1)}
        return df.withColumn("generation", F.struct(*[v.alias(k) for k, v in fields.items()]))

    def one(prompt: str) -> dict:
        error = ""
        for attempt in range(retries + 1):
            try:
                got = call(prompt)
                return {"content": got["content"], "prompt_tokens": got.get("prompt_tokens"), "completion_tokens": got.get("completion_tokens"), "status": "success", "error": None, "attempts": attempt + 1}
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"[:300]
                if attempt < retries:
                    sleep(backoff(attempt))
        return {"content": None, "prompt_tokens": None, "completion_tokens": None, "status": "error", "error": error, "attempts": retries + 1}

    def batch(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in prompts:
            yield pd.DataFrame([one(p) for p in s], columns=["content", "prompt_tokens", "completion_tokens", "status", "error", "attempts"])

    batch.__annotations__ = {"prompts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return df.withColumn("generation", F.pandas_udf(batch, GENERATION)(F.col(prompt_col)))


def recovered_with_retries(df: DataFrame, prompt_col: str, call: Callable[[str], dict], gate: Callable[[dict], list[str]] | None = None, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``df`` with ``recovered``: the cards (JSON) that ``call`` makes of each prompt, asked again with a repair prompt until they are valid.

    ``gate`` names the issues of a card. Cards with issues are rejected, and if all are, that is an error to repair like any other. A
    failing call is tried again with the prompt it had. The tokens are those of the last answer.
    """

    def one(prompt: str) -> dict:
        now, out = prompt, {"ok": False, "prompt_tokens": None, "completion_tokens": None, "raw_content": None, "cards": "[]", "rejected": "[]", "error": None}
        for attempt in range(attempts):
            out["attempts"] = attempt + 1
            try:
                got = call(now)
                out |= {"raw_content": got["content"], "prompt_tokens": got.get("prompt_tokens"), "completion_tokens": got.get("completion_tokens")}
            except Exception as e:  # noqa: BLE001
                out["error"] = f"{type(e).__name__}: {e}"[:300]
            else:
                value, error = recovery.first_json(got["content"])
                cards, error = (None, error) if error else recovery.validated(value)
                found = [gate(c) if gate else [] for c in cards or []]
                out["rejected"] = json.dumps([c | {"issues": i} for c, i in zip(cards or [], found) if i])
                kept = [c for c, i in zip(cards or [], found) if not i]
                if kept:
                    return out | {"ok": True, "cards": json.dumps(kept), "error": None}
                out["error"] = error or "quality_gate:" + ",".join(sorted({x for i in found for x in i}))
                now = REPAIR.format(error=out["error"], content=got["content"] or "")
            if attempt + 1 < attempts:
                sleep(backoff(attempt))
        return out

    def batch(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in prompts:
            yield pd.DataFrame([one(p) for p in s], columns=[f.split()[0] for f in RECOVERED.split(", ")])

    batch.__annotations__ = {"prompts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return df.withColumn("recovered", F.pandas_udf(batch, RECOVERED)(F.col(prompt_col)))


def generate_two_step(df: DataFrame, question_col: str, budget_template: str, solve_template: str, call: Callable[[str], dict] | None = None, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``df`` with ``budget`` and ``generation``: the model is asked for a token budget, then for a solution within ``{{budget}}``.

    The tokens of both calls are summed. Without an answer to the first call the default budget holds.
    """
    ask = lambda template, **more: T.render(F.lit(template), {"question": F.col(question_col), **more})
    first = generate(df.withColumn("_prompt", ask(budget_template)), "_prompt", call, retries, sleep).withColumnRenamed("generation", "_first")
    first = first.withColumn("budget", T.stated_budget(F.coalesce("_first.content", F.lit(""))))
    done = generate(first.withColumn("_prompt", ask(solve_template, budget=F.col("budget").cast("string"))), "_prompt", call, retries, sleep)
    both = lambda c: F.coalesce(F.col(f"_first.{c}"), F.lit(0)) + F.coalesce(F.col(f"generation.{c}"), F.lit(0))
    summed = [both(c).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens")]
    rest = [F.col(f"generation.{c}").alias(c) for c in ("status", "error", "attempts")]
    return done.withColumn("generation", F.struct(F.col("generation.content").alias("content"), *summed, *rest)).drop("_first", "_prompt")


def verified(df: DataFrame, question: str, gold: str, candidate: str, verify: str = "exact", call: Callable[[str], dict] | None = None) -> DataFrame:
    """``df`` with ``verdict`` (CORRECT, INCORRECT, UNKNOWN, SKIPPED) and ``is_correct`` (1, 0 or null).

    ``verify`` is "exact", "llm" or "none". The llm's first line decides; without a ``call`` the exact comparison stands in for it. A
    blank gold answer is UNKNOWN and isn't asked about.
    """
    if verify not in ("exact", "llm", "none"):
        raise ValueError("verify must be exact, llm or none")
    there = T.filled(F.col(gold)).isNotNull()
    if verify == "none":
        verdict = F.lit("SKIPPED")
    elif verify == "exact" or call is None:
        verdict = F.when(T.answers_match(F.col(candidate), F.col(gold)), "CORRECT").otherwise("INCORRECT")
    else:
        prompt = T.render(F.lit(VERIFY), {"question": F.col(question), "gold": F.col(gold), "candidate": F.col(candidate)})
        asked = lambda p: call(p) if p else {"content": ""}
        df = generate(df.withColumnRenamed("generation", "_kept").withColumn("_verify", F.when(there & F.col(candidate).isNotNull(), prompt)), "_verify", asked).withColumnRenamed("generation", "_said").withColumnRenamed("_kept", "generation")
        verdict = T.verdict(F.col("_said.content"))
    df = df.withColumn("verdict", F.when(~there, "UNKNOWN").otherwise(verdict))
    return df.withColumn("is_correct", F.when(F.col("verdict") == "CORRECT", 1).when(F.col("verdict") == "INCORRECT", 0)).drop("_verify", "_said")


def benchmark_runs(items: DataFrame, hints: DataFrame | None, template: str, repeats: int, call: Callable[[str], dict] | None = None, verify: str = "exact", verifier: Callable[[str], dict] | None = None) -> DataFrame:
    """Items × repeats × (direct, and hinted if hints are given): prompts, generations, extracted answers, verdicts.

    ``hints`` has (question_id, hints). ``is_correct`` is 1 or 0 for a successful generation and null otherwise; with ``verify`` other
    than "exact" it is that of ``verified``.
    """
    base = items.withColumn("mode", F.explode(F.array(F.lit("direct"), F.lit("hinted")) if hints is not None else F.array(F.lit("direct"))))
    base = base.join(hints, "question_id", "left") if hints is not None else base.withColumn("hints", F.lit(None).cast("string"))
    base = base.withColumn("repeat_idx", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    shown = F.when(F.col("mode") == "hinted", F.coalesce("hints", F.lit(""))).otherwise(F.lit(""))
    done = generate(base.withColumn("prompt", T.render(F.lit(template), {"question": F.col("question"), "hints": shown})), "prompt", call)
    answer = T.final_answer(F.coalesce("generation.content", F.lit("")))
    if verify != "exact":
        done = verified(done.withColumn("candidate", F.when(F.col("generation.status") == "success", answer)), "question", "answer", "candidate", verify, verifier)
    right = T.answers_match(answer, F.col("answer")).cast("int") if verify == "exact" else F.col("is_correct")
    return done.select(
        "question_id", "mode", "repeat_idx", F.col("generation.status").alias("status"), answer.alias("predicted_answer"),
        F.when(F.col("generation.status") == "success", right).alias("is_correct"),
        F.col("generation.prompt_tokens").alias("prompt_tokens"), F.col("generation.completion_tokens").alias("completion_tokens"), F.lit(0.0).alias("cost"),
    )


def retrieved_hints(cards: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """(question_id, hints): the heuristics of each item's ``k`` best cards by BM25 over question, keywords and heuristic, best first.

    ``cards`` has (card_id, question, keywords, heuristic, status); only successful ones with a heuristic are searched.
    """
    good = cards.where((F.lower(T.strip("status")) == "success") & T.filled(F.col("heuristic")).isNotNull())
    found = lexical.bm25_top_k(good.withColumn("card_text", retrieval_text(F.col("question"), F.col("keywords"), F.col("heuristic"))), "card_id", "card_text", items, "question_id", "question", k)
    named = found.join(good.select(F.col("card_id").alias("doc"), "heuristic"), "doc")
    listed = named.groupBy(F.col("query").alias("question_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "heuristic"))).alias("h"))
    return listed.select("question_id", F.array_join("h.heuristic", "\n\n---\n\n").alias("hints"))


def run_pipeline(problems: DataFrame, items: DataFrame, template: str, repeats: int = 3, k: int = 5, call: Callable[[str], dict] | None = None) -> DataFrame:
    """The summary per mode of the whole pipeline: a trace and a card of every problem, retrieval for every item, runs, verdicts.

    ``problems`` has (line_no, topic, question), ``items`` (question_id, question, answer).
    """
    traces = problems.withColumns(mock_trace(F.col("question")))
    traces = traces.withColumn("reasoning_trace", T.reasoning_trace(F.col("model_think"), F.col("model_response")))
    hints = retrieved_hints(mock_cards(traces).withColumn("card_id", F.col("line_no")), items, k)
    return reports.condition_summary(benchmark_runs(items, hints, template, repeats, call), ["mode"])
