import random

import pytest
from pyspark.sql import functions as F

from hintloom.llm import endings, truncation

WHOLE = [
    "The sum is 12.", "Is it so?", "It holds. ∎", "It holds. □", "It holds.\nQED", "Done.\n---", "Done.\n====", "Done.\n[end]", "Done.\n-- fin", "12", "207/8", "7+sqrt(2)",
    "$207/8$", "**156**", "So.\n\\boxed{7+sqrt(10)}", "So.\nFinal answer: 264", "So.\nResult = 165/12", "Donc.\nRéponse : 19", "```python\nprint(1)\n```", "(It holds.)", 'He said "yes."',
    "计算结果成立。", "It holds.  \n\n", "How many? (adapted)", '"How many? [revised]"', "It holds.​", "<answer>5</answer>",
]
CUT = [
    "The sum is", "The sum is 12 and the oth", "We get 12,", "```python\nprint(1)", "x\n```cpp\nint main() {\n``", "So.\nFinal answer:", "So.\n\\boxed{7+sqrt(1", "So.\n**15", "$20", "7+sqrt(",
    "It holds. More…", "It holds [truncated]", "It holds.\n[+349 chars]", "The p�", "We count <output clipped>", "After a sweep, (more)", "so the s[...]",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert endings.ending(text) is None


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert endings.ending(text) is not None


def test_answer_prefix():
    assert endings.ending("So.\nAnswer: 39", "392/10") == "answer"
    assert endings.ending("So.\nAnswer: 392/10", "392/10") is None
    assert endings.ending("So.\nAnswer: 39", None) is None
    assert endings.ending("39", "392") == "answer"


@pytest.mark.parametrize("text", [None, "", " \t\n", "\xa0", "​", "None", "null", "N/A", "-", "[]", "\\boxed{}", "<answer></answer>", "```\n\n```", "(no output)"])
def test_shells(text):
    assert endings.is_shell(text)
    assert endings.ending(text) is None


@pytest.mark.parametrize("text", ["no", "0", "x = 1", "none of them fits."])
def test_no_shells(text):
    assert not endings.is_shell(text)


def test_long_marks_and_signs():
    assert endings.is_shell("-" * 500) and endings.ending("Done.\n" + "=" * 300) is None
    assert endings.ending("It holds [" + "w" * 200 + " was truncated]") == "mark"
    assert endings.ending("It holds." + '"' * 100) is None and endings.ending("a" * 100_000) == "sentence"
    assert endings.ending("- " * 50_000 + "x, and") == "sentence" and endings.ending("(" * 20_000) == "sentence"


def trace(*args):
    return truncation.trace_cut(*args)[0]


def test_trace():
    think, said = "First we look. It gives 5.", "The sum is 5.\nAnswer: 5"
    whole = f"<think>\n{think}\n</think>\n{said}"
    assert truncation.trace_cut(whole, think, said, "5") == (None, True)
    for n in range(10, len(whole) - 1):
        assert trace(whole[:n], think, said, "5") is not None, whole[:n]
    assert trace(f"<think>\nFirst we lo\n</think>\n{said}", "First we lo", said, "5") is None
    assert trace(f"<think>\n{think}\n{said}", think, said, "5") is None
    assert trace(said, None, said, "5") is None
    assert trace(think, think, " ", "5") is None
    assert truncation.trace_cut(think, None, said, "5") == (None, False)
    assert trace(f"<think>\n{think}\n</think>\nNone", think, "None", "5") is None
    assert truncation.trace_cut(f"<think>\n{think}\n</think>\n\u200b", think, "\u200b", "5") == (None, True)
    assert trace(f"<think>\n{think}\n</think>\n", think, "", "5") == "layout"
    assert truncation.trace_cut(None, None, None, None) == (None, True)


def test_output():
    whole = "We look. It is 5.\n</thought>\nThis uses it.\n```python\nprint(1)\n```"
    assert truncation.output_cut(whole, "</thought>") == (None, False)
    assert truncation.output_cut(whole + "\nHence it holds.", "</thought>")[0] is None
    for n in range(8, len(whole) - 1):
        assert truncation.output_cut(whole[:n], "</thought>")[0] is not None, whole[:n]
    assert truncation.output_cut(None, "</thought>") == (None, True)


def test_lengths():
    for text in ("a", "é\n<b>&\"'\\\t\r\n", "😀x", "\x00"):
        n, wide, units, html, quoted, *_ = endings.text_lengths(text)
        assert (n, wide, units) == (len(text), len(text.encode()), len(text.encode("utf-16-le")) // 2)
        assert html == len(text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")) and quoted == html + sum({'"': 5, "'": 5}.get(c, 0) for c in text)
        assert endings.text_lengths(text)[7] == len(text.replace("\r\n", "\n").replace("\n", "\r\n"))


def values_of(spark, rows):
    """Inspected values of (field, id, source, text) whose only rule is how they end."""
    df = spark.createDataFrame(rows, "field string, id int, source string, text string").withColumn("h", F.lit(1))
    return truncation.inspected(df, lambda t: (endings.ending(t), False))


def test_limits_find_values_that_end_like_sentences(spark):
    rnd = random.Random(5)
    natural = lambda: " ".join(f"word{rnd.randrange(999)}" for _ in range(rnd.randrange(10, 90))) + "."
    rows = [("f", i, "a", natural()) for i in range(900)]
    cut_at = lambda n, end: ((f"{rnd.random()} " + natural() * 9)[: n - len(end)] + end)
    rows += [("f", 1000 + i, "a", cut_at(256, ".")) for i in range(20)]  # a field limit whose texts all end like sentences, with nothing longer
    rows = [r for r in rows if len(r[3]) <= 256]
    rows += [("f", 2000 + i, "b", cut_at(200, "" if i % 3 else ".")) for i in range(30)] + [("f", 3000 + i, "b", natural() * 2) for i in range(300)]  # longer ones hide no limit
    rows += [("f", 5000 + i, "d", "x" * 100 + ".") for i in range(50)]  # one text, loaded many times
    rows += [("f", 6000, None, None), ("f", 6001, "e", ""), ("f", None, "a", "It is"), ("f", 6002, "a", "z" * 30_000 + ".")]
    values = values_of(spark, rows)
    limits = {(r.source, r.encoding): r.limit for r in endings.length_limits(truncation.as_measured(values)).collect()}
    assert limits[("b", "characters")] == 200 and ("d", "characters") not in limits and ("e", "characters") not in limits
    got = truncation.cut_values(values.where("coalesce(id, 0) <> 6002"))
    reasons = {r.id: r.reason for r in got.where("reason is not null").collect()}
    assert {i for i, r in reasons.items() if r == "limit"} >= {1000 + i for i in range(20)} | {2000 + i for i in range(30)}
    assert all(endings.ending(t) is None for _, i, s, t in rows if i in range(1000, 1020)), "only the limit tells these"
    assert reasons.pop(None) == "sentence" and all(r == "limit" for r in reasons.values())
    rates = {r.source: (r.n_values, r.n_cut, r.n_limit) for r in truncation.cut_rates(got).collect()}
    assert rates[None] == (0, 0, 0) and rates["e"] == (0, 0, 0) and rates["d"] == (50, 0, 0) and rates["b"][2] >= 30
    assert truncation.cut_values(values.limit(0)).collect() == []


def test_limit_is_given_to_the_encoding_that_explains_most(spark):
    rnd = random.Random(9)
    body = lambda n: "".join(rnd.choice("abc def é") for _ in range(n))

    def fit(size):
        text = body(size)
        while len(text.encode()) > size:
            text = text[:-1]
        return text + "x" * (size - len(text.encode()))

    rows = [("f", i, "a", fit(300)) for i in range(60)] + [("f", 100 + i, "a", body(rnd.randrange(40, 250)) + ".") for i in range(200)]
    got = [(r.encoding, r.limit, r.n) for r in endings.length_limits(truncation.as_measured(values_of(spark, rows))).collect()]
    assert got == [("utf8 bytes", 300, 60)]


def test_whole_value_at_its_limit_is_kept(spark):
    values = values_of(spark, [("f", i, "a", f"{i:04d} " + "y" * 94 + ".") for i in range(30)]).withColumn("whole", F.col("id") == 7)
    reasons = {r.id: r.reason for r in truncation.cut_values(values).collect()}
    assert reasons.pop(7) is None and set(reasons.values()) == {"limit"}


def test_field_values(spark):
    traces = spark.createDataFrame([(1, "M_a", None, "It is so.", "It is so.", "5", 0), (2, " m-A", None, None, None, None, 0)], "line_no bigint, source_model string, model_think string, model_response string, reasoning_trace string, answer string, id int")
    joined = spark.createDataFrame([(1, "S", "We look", None, 0), (2, None, "", "<think>\nx.\n</think>\nok.\n```\n1\n```", 0)], "line_no bigint, source string, flash_output string, doubao_output string, text int")
    got = {(r.field, r.id): (r.source, r.how) for r in truncation.field_values(traces, joined).collect()}
    assert got[("reasoning_trace", 1)] == ("m-a", None)
    assert got[("flash_output", 1)] == ("s", "thought")
    assert got[("doubao_output", 2)] == (None, None) and len(got) == 6
