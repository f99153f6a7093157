import random

import pytest

from hintloom.llm import pairs

Q = "The thin ridge of Fenford measures 36 by 48 pounds and stores cogs. How many cogs does Marel need for the ridge before Tuesday?"
GOOD = "First we count the cogs, then subtract the 12 that Marel sells. The ridge holds 36 of them.\nAnswer: 36"


@pytest.mark.parametrize(
    ("question", "think", "response", "answer", "defect"),
    [
        (Q, "It is so.", GOOD, "36", None),
        (Q, None, "36", "36", None),
        (Q, "Wir zählen die Räder und das ist es.", GOOD, "36", None),
        (Q, None, None, "36", "empty"),
        (Q, None, " N/A ", "36", "empty"),
        (Q, None, GOOD[:50], "36", "truncated"),
        (Q, "We look at the", GOOD, "36", "truncated"),
        (Q, "We look.", "I'm sorry, but I can't help with this question. I hope you understand.", "36", "refusal"),
        (Q, None, "Dazu darf ich keine Lösung angeben.", "36", "refusal"),
        (Q, None, "Je dois décliner cette demande, merci de consulter un professeur.", "36", "refusal"),
        (Q, None, "Debo rechazar esta petición, consulta a un profesor.", "36", "refusal"),
        (Q, None, "The ridge cannot store more than 36 cogs, so I can't use the wide ones here. The value 36 works.", "36", None),
        (Q, None, Q, "36", "copy"),
        (Q, None, "You asked: " + Q.upper(), "36", "copy"),
        (Q, None, Q.replace("36 by ", ""), "36", "copy"),
        (Q, None, Q + "\nAnswer: 36", "36", None),
        (Q, None, Q + " " + GOOD, "36", None),
        (Q, None, "Zuerst zählen wir die Räder und erhalten 36 Stück. Das ist die Lösung für den Kamm.", "36", "language"),
        (Q, None, "首先计算剩余数量，得到 36 个。注意不要把总量和差值混在一起。", "36", "language"),
        (None, None, GOOD, None, None),
        ("", None, "Das ist die Lösung, und sie ist nicht groß.", None, None),
    ],
)
def test_rules(question, think, response, answer, defect):
    assert pairs.pair_defect(question, think, response, answer) == defect


def test_shortened_equals_brute_force(spark):
    rnd = random.Random(2)
    texts = set()
    for _ in range(60):
        full = " ".join(f"word{rnd.randrange(50)}" for _ in range(30))
        texts |= {full, full[: rnd.randrange(60, len(full))], full[: rnd.randrange(5, 40)]}
    texts |= {"a" * 50, "", " "}

    def stops(a, b):
        return len(b) > len(a) and b.startswith(a) and len(a.split()) >= 8 and ((a[-1].isalnum() and b[len(a)].isalnum()) or not a.rstrip().endswith("."))

    want = {a for a in texts if any(stops(a, b) for b in texts)}
    rows = [(t.encode(), t) for t in texts]
    df = spark.createDataFrame(rows, "digest binary, text string").repartition(7)
    got = [bytes(r.digest).decode() for r in pairs.shortened(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert pairs.shortened(df.limit(0)).collect() == []


def test_defective_pairs(spark):
    long = "The ridge holds 36 of them and the other 12 are sold. " * 400
    rows = [(1, Q, None, GOOD, "36", "m"), (2, Q, None, GOOD[:-9] + "sold", "36", "m"), (3, None, None, None, None, None), (4, None, None, long, None, "m"), (None, Q, None, None, None, "m")]
    rows += [(10 + i, Q, None, "It is the same response to all of the questions.", "36", "m") for i in range(40)]
    rows += [(100, Q, None, "One two three four five six seven eight nine = 12", "12/5", "m"), (101, Q, None, "One two three four five six seven eight nine = 12/5.", "12/5", "m")]
    schema = "line_no bigint, q string, t string, r string, a string, s string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as id", "'x' as text", "0 as defect")
    got = {r.id: (r.defect, r.reason) for r in pairs.defective_pairs(df, "line_no", "q", "t", "r", "a", "s").collect()}
    assert got == {2: ("truncated", "ending"), 3: ("empty", "empty"), 100: ("truncated", "prefix")}
    assert pairs.defective_pairs(df.limit(0), "line_no", "q", "t", "r", "a", "s").collect() == []


def test_a_sibling_after_a_line_break_hides_no_continuation(spark):
    start = "one two three four five six seven eight nine"
    texts = [f"{start} te", f"{start} te\nother line", f"{start} ten eleven twelve."]
    df = spark.createDataFrame([(t.encode(), t) for t in texts], "digest binary, text string").coalesce(1)
    assert [bytes(r.digest).decode() for r in pairs.shortened(df).collect()] == [texts[0]]


def test_continuations_beyond_whole_partitions(spark):
    """A short text whose continuation lies partitions away, behind siblings that are no evidence."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        start = "one two three four five six seven eight nine te"
        texts = [start] + [f"{start}\nline {i:04d}." for i in range(400)] + [f"{start}n eleven.", "a.", "z."]
        df = spark.createDataFrame([(t.encode(), t) for t in texts], "digest binary, text string").repartition(4)
        assert [bytes(r.digest).decode() for r in pairs.shortened(df).collect()] == [start]
        assert pairs.shortened(df.where("text not like '%eleven.'")).collect() == []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_only_limits_find_responses_that_end_like_sentences(spark):
    rnd = random.Random(4)
    words = lambda n: " ".join(rnd.choice("the sum of and is to we that for a".split()) for _ in range(n))
    rows = [(i, Q, None, (f"{rnd.random()} " + words(200))[:511] + ".", "36", "m") for i in range(12)]
    rows += [(100 + i, Q, None, words(rnd.randrange(10, 60)) + ".", "36", "m") for i in range(200)]
    df = spark.createDataFrame(rows, "line_no bigint, q string, t string, r string, a string, s string")
    got = {r.id: (r.defect, r.reason) for r in pairs.defective_pairs(df, "line_no", "q", "t", "r", "a", "s").collect()}
    assert got == {i: ("truncated", "limit") for i in range(12)}


def test_refusals_of_any_length():
    filler = " ".join(["There are many good books on this subject and they may well be of use."] * 15)
    assert pairs.is_refusal(f"I'm sorry, but I can't help with this question. {filler}")
    work = " ".join(f"We multiply {i} by {i + 1} and get {i * i + i}." for i in range(15))
    assert not pairs.is_refusal(f"I can't give a closed form, so we count. {work}")
    assert not pairs.is_refusal("I can't help you more than this.\nAnswer: 36")


def test_language_of_scripts():
    assert pairs.language("Сначала мы считаем все колёса и складываем их.") == "ru"
    assert pairs.language("これは答えではありません。") == "ja" and pairs.language("12 + 5") is None
