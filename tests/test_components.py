"""Components by pointer doubling, beside union by hand; rounds stay few on long rings."""

import random

import pytest

from orbweave.operators import components
from orbweave.operators.components import connected_components


def by_hand(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "ring", "empty"])
def test_components(spark, tmp_path, monkeypatch, kind):
    rng = random.Random(4)
    if kind == "random":
        links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(350)] + [(7, 7), (None, 3), (2**63 - 1, -(2**63))] + [(500, x) for x in range(501, 560)] * 2
    elif kind == "ring":
        links = [(i, (i + 1) % 5000) for i in range(5000)]
    else:
        links = []
    rounds = []
    monkeypatch.setattr(components, "written", lambda df, path, f=components.written: rounds.append(path) or f(df, path))
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), str(tmp_path / "c")).collect()}
    assert got == by_hand(links)
    assert len(rounds) <= 20
