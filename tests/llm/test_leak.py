import random
import re

from hintloom.llm import leak


def passages(text, n):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc bigint, body string, item string")
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "qid string, q string, doc_id int")
    return sorted((r.doc_id, r.item_id) for r in leak.leaked(d, "doc", "body", q, "qid", "q", **kw).collect())


def test_equals_brute_force(spark):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(f"q{i}", make(rnd.randrange(2, 25))) for i in range(30)] + [("null", None), ("empty", "")]
    docs = []
    for i in range(150):
        text = make(rnd.randrange(0, 40)).split()
        if rnd.random() < 0.5:
            w = (rnd.choice(items)[1] or "").split()
            at = rnd.randrange(len(text) + 1)
            text[at:at] = w[rnd.randrange(3) :]
        docs.append((i, rnd.choice([" ", ", ", "\n", "-"]).join(text).upper()))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    for n in (4, 5, 12):
        want = sorted({(k, i, q) for k, (i, t) in enumerate(docs) for q, u in items if passages(t, n) & passages(u, n)})
        assert run(spark, docs, items, length=n) == sorted((i, q) for _, i, q in want)


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(leak, "CHARS_AT_ONCE", 20)
    items = [(f"q{i}", f"a{i} b c d e f") for i in range(7)]
    assert run(spark, [(1, "x a3 b c d e"), (2, "a4; b\nc")], items, length=4) == [(1, "q0"), (1, "q1"), (1, "q2"), (1, "q3"), (1, "q4"), (1, "q5"), (1, "q6")]
    assert run(spark, [], items) == []
    assert run(spark, [(1, "a b c")], []) == []


def test_long_document(spark):
    item = " ".join(f"k{i}" for i in range(12))
    assert run(spark, [(1, "pad " * 300_000 + item + " pad" * 10)], [("q", item)]) == [(1, "q")]
