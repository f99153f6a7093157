import os
import random
import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hintloom.lineage import checkpoint_dir
from hintloom.llm import grams, minhash


def shingle_set(text, k):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, threshold):
    sets = {i: shingle_set(t, k) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) / len(x | y) >= threshold:
                p, q = sorted((find(a), find(b)))
                label[q] = p
    return {i: find(i) for i in ids}


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "line bigint, body string, rep string, cluster int")
    return {r.id: r for r in minhash.near_duplicates(df, "line", "body", **kw).collect()}


def variants(rnd, vocabulary, n_words, n):
    base = [rnd.choice(vocabulary) for _ in range(n_words)]
    for _ in range(n):
        w = base[:]
        for _ in range(rnd.randrange(4)):
            i = rnd.randrange(len(w))
            kind = rnd.randrange(3)
            w[i : i + 1] = [] if kind == 0 else [rnd.choice(vocabulary)] if kind == 1 else [w[i], rnd.choice(vocabulary)]
        yield " ".join(w)


@pytest.mark.parametrize(("k", "threshold"), [(3, 0.5), (5, 0.8)])
def test_groups_equal_brute_force(spark, k, threshold):
    rnd = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [t for _ in range(12) for t in variants(rnd, vocabulary, rnd.randrange(20, 60), 6)]
    rows = list(enumerate(texts + texts[:5] + [None, "", "  ", "one two", "one two"]))
    got = run(spark, rows, shingle=k, threshold=threshold)
    assert {i: r.cluster for i, r in got.items()} == brute(rows, k, threshold)


def test_bucket_larger_than_pairwise(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRWISE", 3)
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)]
    rows = list(enumerate(t for _ in range(3) for t in variants(rnd, vocabulary, 30, 25)))
    got = run(spark, rows, shingle=3, threshold=0.5)
    assert {i: r.cluster for i, r in got.items()} == brute(rows, 3, 0.5)


def test_copies_nulls_and_empty(spark):
    text = "a b c d e f g " * 2000
    got = run(spark, [(1, text), (2, text.upper()), (3, None), (4, ""), (None, text)], shingle=3, threshold=0.5)
    assert set(got) == {1, 2, 3, 4}
    assert (got[2].text_class, got[2].cluster, got[2].copies) == (1, 1, 2)
    assert got[3].cluster == 3
    assert run(spark, []) == {}


def test_within_keeps_tables_apart(spark):
    rows = [(1, "x", "a b c d e f"), (2, "y", "a b c d e f"), (3, "x", "a b c d e f")]
    df = spark.createDataFrame(rows, "id bigint, src string, text string")
    got = minhash.near_duplicates(df, "id", "text", within="src", shingle=3, threshold=0.5)
    assert {r.id: r.cluster for r in got.collect()} == {1: 1, 2: 2, 3: 1}
    assert {(r.a, r.b) for r in minhash.cluster_pairs(got).collect()} == {(1, 3)}


def test_banding():
    for t in (0.5, 0.8, 0.95):
        bands, rows = minhash.banding(t)
        assert (1 - t**rows) ** bands <= 0.002


def test_third_of_rows_in_one_group(spark):
    """A skewed input: a third of the texts are different variants of one text, another group chains through them."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    hot = list(variants(rnd, vocabulary, 60, 250))
    cold = [" ".join(rnd.choice(vocabulary) for _ in range(40)) for _ in range(500)]
    rows = list(enumerate(hot + cold))
    got = run(spark, rows, shingle=3, threshold=0.5)
    assert {i: r.cluster for i, r in got.items()} == brute(rows, 3, 0.5)


def test_texts_that_share_a_sentence_are_not_paired(spark, monkeypatch):
    """1,500 texts share 50 of 110 words and are not similar; the pairs that are verified are few for each, not all of a bucket."""
    rnd = random.Random(11)
    shared = " ".join(f"s{i}" for i in range(50))
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(30)) + f" {shared} " + " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(1500)]
    texts += [texts[3] + " more words", texts[7].replace("s20", "other")]
    seen = []
    real = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    got = run(spark, list(enumerate(texts)), shingle=3, threshold=0.5)
    assert {i: r.cluster for i, r in got.items() if r.cluster != i} == {1500: 3, 1501: 7}
    # By far most are the pairs of small buckets and of least members; all pairs would be 1.1 million.
    assert sum(seen) < 60 * len(texts), seen
    assert seen[-1] <= len(texts), seen


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_prefix_keys_miss_no_pair(threshold):
    rnd = random.Random(3)
    pool = [rnd.randrange(2**63) for _ in range(120)]
    sets = [sorted(set(rnd.sample(pool[: rnd.choice([12, 120])], rnd.randrange(1, 12))) | set(pool[:5] if rnd.random() < 0.5 else [])) for _ in range(300)]
    flat, offsets = np.array([g for s in sets for g in s], np.uint64), np.cumsum([0, *map(len, sets)])
    hot = np.array(sorted(pool[:5]), np.uint64)
    owner, keys = grams.prefix_keys(flat, offsets, np.zeros(len(sets), np.int64), threshold, hot, np.arange(5) + 2)
    held = [set(keys[owner == i].tolist()) for i in range(len(sets))]
    for i, a in enumerate(map(set, sets)):
        for j in range(i):
            b = set(sets[j])
            if len(a & b) / len(a | b) >= threshold:
                assert held[i] & held[j], (a, b)


def test_shuffles_and_stored_texts_do_not_stay(spark):
    """What a search has shuffled and stored is off the disk when its groups are known, whenever the driver collects its garbage."""
    rnd = random.Random(13)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = [t for _ in range(400) for t in variants(rnd, vocabulary, 40, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {os.path.join(d, f) for top in dirs for d, _, files in os.walk(top) for f in files if f.startswith("shuffle_") and f.endswith(".data")}
    before = shuffled()
    groups = minhash.near_duplicates(df, "id", "text", shingle=3, threshold=0.5)
    for _ in range(50):  # files are dropped in the background
        left = sum(os.path.getsize(f) for f in shuffled() - before if os.path.exists(f))
        if left < 0.1 * sum(map(len, texts)):
            break
        time.sleep(0.2)
    assert left < 0.1 * sum(map(len, texts))
    assert not [x for x in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if x.startswith("stored-")]
    assert {r.id: r.cluster for r in groups.collect()} == brute(list(enumerate(texts)), 3, 0.5)


def test_recurring_keys_are_those_of_several_texts(spark):
    rnd = random.Random(17)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(i - 2**40, i % 2, t) for i, t in enumerate(t for _ in range(20) for t in variants(rnd, vocabulary, 30, 4))]
    keys = minhash._minima(pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["salt", "text"]), 3, 10, 3)[0]
    buckets = defaultdict(list)
    for (rep, *_), own in zip(rows, keys.tolist()):
        for key in own:
            buckets[key].append(rep)
    want = sorted((rep, len(x), min(x)) for x in buckets.values() if len(x) > 1 for rep in x)
    got = minhash.recurring_keys(spark.createDataFrame(rows, "rep bigint, salt bigint, text string"), 3, 10, 3).collect()
    assert sorted((r.rep, r.n, r.lo) for r in got) == want
    assert len({r.key for r in got}) == sum(len(x) > 1 for x in buckets.values())
