import random
import re

from hintloom.llm import splitjoin
from pyspark.sql import functions as F


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def norm(key):
    parts = re.sub(r"\s+", "", (key or "").lower()).split("/")
    if len(parts) != 3 or not all(parts):
        return None
    return (parts[0], parts[1], parts[2].lstrip("0") or "0")


def brute(rows):
    out = set()
    for a, ka, ta, sa in rows:
        for b, kb, tb, sb in rows:
            if a is None or b is None or not (sa in ("holdout", "valid") and sb == "train"):
                continue
            x, y = grams(ta), grams(tb)
            if (norm(ka) and norm(ka) == norm(kb)) or (x and y and len(x & y) / len(x | y) >= 0.5):
                out.add((min(a, b), max(a, b)))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "line_no bigint, k string, q string, s string, side string, origin int")
    return {(r.a, r.b) for r in splitjoin.overlap_pairs(splitjoin.split_overlaps(df, "line_no", "k", "q", "s")).collect()}


def edited(rnd, words, n):
    w = list(words)
    for _ in range(n):
        i = rnd.randrange(len(w))
        kind = rnd.randrange(5)
        if kind == 0:
            del w[i]
        elif kind == 1:
            w.insert(i, f"new{rnd.randrange(99)}")
        elif kind == 2:
            w[i : i + 2] = [f"sub{rnd.randrange(99)}"]
        elif kind == 3:
            w = w[i:] + w[:i]
        else:
            w[i] = f"sub{rnd.randrange(99)}"
    return " ".join(w)


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    rows, n = [], 0
    for _ in range(60):
        base = [f"w{rnd.randrange(150)}" for _ in range(rnd.choice([3, 4, 6, 10, 17, 30, 60]))]
        for _ in range(4):
            n += 1
            rows.append((n, f"set/test/{n:07d}", edited(rnd, base, rnd.randrange(1 + len(base) // 6)), rnd.choice(["train", "train", "holdout", "valid", "other", None])))
    assert run(spark, rows) == brute(rows)


def test_keys_copies_and_nulls(spark):
    rows = [
        (1, " Pool/TEST/0000012", "one two three four", "train"),
        (2, "pool / test / 12", None, "valid"),
        (3, "pool/test", "x y", "valid"),
        (4, None, "ONE, two; three\nfour", "holdout"),
        (5, None, "-", "train"),
        (6, None, "", "valid"),
        (None, None, "one two three four", "valid"),
        (8, "pool/test/12", "x y", None),
        (9, "pool/test/0", "x y", "train"),
        (10, "pool/test/000", "z", "valid"),
    ]
    assert run(spark, rows) == {(1, 2), (1, 4), (9, 10)}
    assert run(spark, []) == set()


def test_hot_text_and_long_text(spark):
    long = " ".join(f"v{i}" for i in range(6000))
    rows = [(i, None, "the same question again and again", "train" if i % 2 else "valid") for i in range(60)] + [(100, None, long, "train"), (101, None, long + " end", "holdout")]
    assert run(spark, rows) == brute(rows)


def test_edits_are_counted_in_words(spark):
    make = lambda t: spark.createDataFrame([(1, t)], "cid bigint, text string")
    base = " ".join(f"w{i}" for i in range(40))
    got = splitjoin.similar_across(make(base), make(base.replace("w7 ", "other ").replace("w30 ", ""))).collect()
    assert [r.edits for r in got] == [2]
    moved = " ".join(base.split()[25:] + base.split()[:25])
    assert [r.edits for r in splitjoin.similar_across(make(base), make(moved)).collect()] == [-1]


def test_origin_key(spark):
    keys = ["A/b/007", " a / B / 7 ", "a/b/", "a/b", "a/b/7/8", None, "", "a/b/x01"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select(splitjoin.origin_key(F.col("k")).alias("o"))
    assert [r.o for r in df.collect()] == ["a/b/7", "a/b/7", None, None, None, None, None, "a/b/x01"]


def test_rows_are_counted_per_split_and_source(spark):
    rows = [
        (1, "pool/test/1", "one two three four", "train", "a"),
        (2, "pool/test/1", "one two three four", "train", "b"),
        (3, "Pool/test/01", "other words than these", "valid", "a"),
        (4, None, "One two three, four", " Holdout", "a"),
        (5, "pool/test/1", "one two three four", "holdout", "a"),
        (6, "pool/test/6", "nothing of the sort", "holdout", "a"),
        (7, None, None, "valid", None),
    ]
    df = spark.createDataFrame(rows, "line_no bigint, k string, q string, s string, src string")
    got = splitjoin.overlap_rates(splitjoin.split_overlaps(df, "line_no", "k", "q", "s", source_col="src")).collect()
    assert {tuple(r) for r in got} == {("valid", "a", 1, 1, 0, 1), ("holdout", "a", 3, 1, 2, 2), ("valid", None, 1, 0, 0, 0)}


def test_segment_join_equals_edit_distance(spark):
    """Every pair within the allowed edits is found by the segments, whatever is edited; nothing beyond them is."""
    rnd = random.Random(12)
    pairs = []
    for _ in range(80):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([5, 9, 14, 30, 70]))]
        pairs.append((base, edited(rnd, base, rnd.randrange(1 + len(base) // 8)).split()))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            above, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(above[j] + (x != y), above[j + 1] + 1, row[j] + 1))
        return row[-1]

    make = lambda side: spark.createDataFrame([(i, " ".join(p[side])) for i, p in enumerate(pairs)], "cid bigint, text string")
    none = splitjoin.np.zeros(0, splitjoin.np.uint64), splitjoin.np.zeros(0, splitjoin.np.int64)
    described = splitjoin.pieces(make(0), 0.5, *none), splitjoin.pieces(make(1), 0.5, *none)
    found = {r.left_id: r.edits for r in splitjoin.within_edits(make(0), make(1), described, 0.5, *none).collect() if r.left_id == r.right_id}
    want = {}
    for i, (a, b) in enumerate(pairs):
        x, y = grams(" ".join(a)), grams(" ".join(b))
        if (d := distance(a, b)) <= min(len(x) // 9, len(a) // splitjoin.SEGMENT - 1) and len(b) >= splitjoin.SEGMENT and len(x & y) >= 0.5 * len(x | y):
            want[i] = d
    assert found == want and len(want) > 20
