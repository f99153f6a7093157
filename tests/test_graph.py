import random

from hintloom.operators.graph import connected_components


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: min(y for y in root if find(y) == find(x)) for x in root}


def run(spark, edges):
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "a bigint, b bigint, node string")
    return {r.node: r.component for r in connected_components(df).collect()}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (None, 3), (3, None), (7, 9), (9, 7)]
    assert run(spark, edges) == brute(edges)


def test_empty_and_hub(spark):
    assert run(spark, []) == {}
    hub = [(1, i) for i in range(2, 400)]
    assert set(run(spark, hub).values()) == {1}
