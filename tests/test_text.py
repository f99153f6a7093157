import json

import pytest
from pyspark.sql import functions as F

from hintloom.functions import text as T


def one(spark, expr, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    row = spark.createDataFrame([values], schema).select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()
    return row.x


@pytest.mark.parametrize(
    ("fn", "values", "want"),
    [
        (T.estimate_tokens, ("",), 0), (T.estimate_tokens, (None,), 0), (T.estimate_tokens, ("abc",), 1), (T.estimate_tokens, ("😀é漢字ab",), 1), (T.estimate_tokens, ("a" * 41,), 10),
        (lambda c: T.trim_to_budget(c, 2), ("abcdef  ghi",), "abcdef"), (lambda c: T.trim_to_budget(c, 0), ("abc",), ""),
        (T.reasoning_trace, (" a ", "b"), "<think>\na\n</think>\n\nb"), (T.reasoning_trace, (None, "b "), "b"), (T.reasoning_trace, ("a", ""), "a"),
        (lambda c: T.tagged(c, "skill"), ("x <SKILL> a\nb </skill> <skill>c</skill>",), "a\nb"), (lambda c: T.tagged(c, "skill"), ("none",), ""),
        (T.last_boxed, (r"\boxed{1} and \boxed{ \frac{1}{2} } end",), r"\frac{1}{2}"), (T.last_boxed, (r"\boxed{1} \boxed{2",), ""), (T.last_boxed, ("none",), ""),
        (T.final_answer, ("x\nAnswer: 3\nFinal answer: 4 \ny",), "4"), (T.final_answer, ("Answer：7",), "7"), (T.final_answer, ("so the answer is 9.\nbye",), "9."), (T.final_answer, ("a\n  b  \n\n",), "b"), (T.final_answer, ("",), ""),
        (T.normalize_answer, (r" \boxed{ 1 + 2 }. ",), "1+2"), (T.normalize_answer, (r"$\text{Yes}$;",), "yes"),
        (T.answers_match, ("$4$", "4."), True), (T.answers_match, ("", ""), False), (T.answers_match, (None, "4"), False),
        (T.slug, ("GPT-4 / Test!",), "gpt_4_test"), (T.slug, ("!!",), "run"),
        (T.stated_budget, ("Budget: [[77]] 5",), 77), (T.stated_budget, ("about 12 or 13",), 12), (T.stated_budget, ("none",), 512),
        (T.category, (" ac", "WA"), "flash_ac_doubao_wrong"), (T.category, ("TLE", "ac"), "flash_wrong_doubao_ac"), (T.category, ("", "AC"), None),
        (lambda c: T.shorten(c, 4, "~"), ("abcdefgh",), "ab~gh"), (lambda c: T.clip(c, 3), ("abcdef",), "abc..."),
        (T.output_text, ("a \r\nb\t\n \n\n",), "a\nb"), (T.outputs_equal, ("1.0000001 x", "1 x"), True), (T.outputs_equal, ("1.1", "1"), False), (T.outputs_equal, ("0.0000001", "0"), True), (T.outputs_equal, ("a b", "a"), False), (T.outputs_equal, ("", None), True),
        (T.task_hash, ("a", None), "56cbeab21b8e"),
    ],
)
def test_scalars(spark, fn, values, want):
    if fn is T.task_hash:
        import hashlib

        want = hashlib.md5(b"a|None").hexdigest()[:12]
    assert one(spark, fn, *values) == want


def test_tokens(spark):
    assert one(spark, T.word_tokens, "A_b c-1, É") == ["a_b", "c", "1"]
    assert one(spark, T.code_tokens, "X+1 <= 2^10 && a_b-c") == ["x+1", "<=", "2^10", "a_b-c"]
    assert one(spark, T.similarity_tokens, "a a b^2*") == ["a", "b", "^", "2", "*"]


def test_thinking(spark):
    r = one(spark, T.split_thinking, "one </think> two </Thought > three ")
    assert (r.think, r.answer, r.tag) == ("one </think> two", "three", "</Thought >")
    assert one(spark, T.split_thinking, "one </think>  ") is None
    assert one(spark, T.split_thinking, "plain") is None


def test_code(spark):
    text = "x\n```rust\n" + "y" * 90 + "\n```\n```py\nprint(1)\n```\n```\nlonger but of no language\n```"
    r = one(spark, T.best_code, text)
    assert (r.lang, r.code) == ("python", "print(1)")
    r = one(spark, T.best_code, " no block ")
    assert (r.lang, r.code) == (None, "no block")


def test_render_and_repair(spark):
    assert one(spark, lambda t, a, b: T.render(t, {"a": a, "b": b}), "{{a}}-{{b}}", "{{b}}", "x") == "x-x"
    assert json.loads(one(spark, T.repair_escapes, r'{"a": "\frac \alpha \n"}'))["a"].endswith("lpha \n")
    assert [tuple(x) for x in one(spark, T.secret_lines, "a\nfk12.abc\nb")] == [(2, "fk12.abc")]
