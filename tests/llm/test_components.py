import random

import pytest

from regionpanel.llm import components as C


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


CASES = {"none": [], "loop": [(5, 5)], "chain": [(i, i + 1) for i in range(300)], "star": [(0, i) for i in range(1, 200)],
         "repeated": [(1, 2), (2, 1), (1, 2)], "signs": [(-(1 << 62), 7), (7, 1 << 62)]}


@pytest.mark.parametrize("name", [*sorted(CASES), "random"])
def test_components(spark, name):
    rng = random.Random(4)
    pairs = CASES.get(name) if name != "random" else [(rng.randrange(400), rng.randrange(400)) for _ in range(330)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    assert {r.id: r.component for r in C.components(df).collect()} == brute(pairs)


def test_links_added_later(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)]
    frame = lambda some: spark.createDataFrame(some, "a long, b long")
    found = C.components(frame(pairs[:150]))
    found = C.joined_components(found, frame(pairs[150:]))
    assert {r.id: r.component for r in found.collect()} == brute(pairs)
