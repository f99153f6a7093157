import random

import numpy as np
import pandas as pd
import pytest

from hintloom.llm import packing

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CONTAINERS = [("small", 16), ("large", 64)]


def run(spark, docs, containers=CONTAINERS):
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc bigint, body string, used int, container string")
    c = spark.createDataFrame([(*r, 1) for r in containers], "kind string, size int, id int")
    return packing.pack_documents(d, "doc", "body", c, "kind", "size", VOCABULARY)


def tokens(text):
    return len(packing._encoding(open(VOCABULARY, "rb").read()).encode_ordinary(text or ""))


def check(docs, rows, containers=CONTAINERS):
    for kind, capacity in containers:
        mine = [r for r in rows if r.container_kind == kind]
        boxes, pieces = {}, {}
        for r in mine:
            boxes.setdefault(r.container, []).append(r)
            pieces.setdefault(r.id, []).append((r.chunk, r.n_tokens))
        for box in boxes.values():
            assert sum(r.n_tokens for r in box) == box[0].used <= capacity
        assert set(pieces) == {i for i, _ in docs if i is not None}
        for i, text in docs:
            if i is None:
                continue
            n, got = tokens(text), sorted(pieces[i])
            assert sum(k for _, k in got) == n
            assert len(got) == max(1, -(-n // capacity))
            assert all(k == capacity for _, k in got[:-1])


def test_every_document_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 40)
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice(["the cat", "a mat", "jumps over", "walks", "rivers"]) for _ in range(rnd.randrange(0, 30)))) for i in range(200)]
    docs += [(1000, None), (1001, ""), (1002, "  "), (None, "lost"), (1003, "word " * 500), (1004, docs[3][1])]
    rows = run(spark, docs).collect()
    check(docs, rows)
    rates = {r.container_kind: r.fill_rate for r in packing.fill_rates(run(spark, docs)).collect()}
    assert all(v > 0.95 for v in rates.values())


def test_empty_and_refused(spark):
    assert run(spark, []).collect() == []
    assert run(spark, [(1, "a")], []).collect() == []
    with pytest.raises(ValueError):
        run(spark, [(1, "a")], [("bad", 0)])


def test_bm25_equals_definition():
    texts = ["a b b c", "b c d", "x y", "", None, "b"]
    index = packing.Bm25(texts)
    docs = [(t or "").split() for t in texts]
    mean = np.mean([len(d) for d in docs])
    for seed, query in enumerate(docs):
        want = []
        for d in docs:
            score = 0.0
            for t in set(query):
                df = sum(t in e for e in docs)
                tf = d.count(t)
                score += np.log1p((len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean)) if tf else 0.0
            want.append(score)
        assert np.allclose(index.scores(seed), want)


def test_neighbours_share_a_container():
    texts = ["cat mat hat " * 3] * 4 + ["sun moon star " * 3] * 4
    boxes = packing.fill(np.full(8, 8), 32, packing.Bm25(texts).scores)
    assert sorted(map(sorted, boxes)) == [[0, 1, 2, 3], [4, 5, 6, 7]]
    assert packing.fill(np.zeros(0, int), 8, None) == []
    assert packing.fill(np.array([8, 8, 3, 5]), 8, None) == [[0], [1], [3, 2]]


def test_reopened_items_are_packed_by_their_neighbours():
    items = [(1, 60, "apple pie"), (2, 40, "brick wall"), (3, 38, "apple tree")]
    frame = pd.DataFrame([("k", i, 0, n, t) for i, n, t in items], columns=["container_kind", "id", "chunk", "n_tokens", "text"])
    got = packing._pack(frame, [("k", 100)], "g0", False)
    assert sorted(sorted(ids) for ids in got.groupby("container")["id"].apply(list)) == [[1, 3], [2]]


def test_repeated_ids_of_divided_documents_keep_their_containers(spark):
    rows = run(spark, [(5, "word " * 300), (5, "other " * 300), (5, "a b c")]).collect()
    for kind, capacity in CONTAINERS:
        boxes = {}
        for r in rows:
            if r.container_kind == kind:
                boxes.setdefault(r.container, []).append(r)
        assert all(sum(r.n_tokens for r in box) == box[0].used <= capacity for box in boxes.values())


def test_like_documents_share_shards_of_bounded_size(spark, monkeypatch):
    """Documents of a few themes fall into shards by theme; one that is repeated for a third of the rows fills several shards and no single task."""
    monkeypatch.setattr(packing, "SHARD", 50)
    themes = ["quarks hadrons leptons bosons", "violins cellos trumpets clarinets", "glaciers moraines fjords icebergs"]
    docs = [(i, f"{themes[i % 3]} number{i}") for i in range(300)] + [(1000 + i, "repeated sentences everywhere") for i in range(150)]
    rows = run(spark, docs).collect()
    check(docs, rows)
    boxes = {}
    for r in rows:
        if r.container_kind == "large" and r.id < 1000:
            boxes.setdefault(r.container, []).append(r.id % 3)
    alike = [b.count(max(set(b), key=b.count)) / len(b) for b in boxes.values()]
    assert sum(alike) / len(alike) > 0.8  # a third by chance
    assert len({r.container.split("-")[0] for r in rows if r.id >= 1000 and r.container_kind == "small"}) > 1
