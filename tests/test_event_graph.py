"""The graph over every event, beside plain Python."""

import datetime
import random
from collections import deque

from orbweave.operators import graph
from orbweave.operators.graph import expand_within_budget
from orbweave.plans.queries import QUERIES


def walk():
    """Users in the order of their events: two dense groups, a ring of 6, and users met once."""
    rng = random.Random(3)
    return [rng.choice([3, 1, 4]) for _ in range(12)] + [50] + [rng.choice([9, 7, 8, 6]) for _ in range(10)] + [51] + [*range(20, 26), 20]


def depths(edges, seeds):
    found, queue = dict.fromkeys(seeds, 0), deque(seeds)
    while queue:
        at = queue.popleft()
        for a, b in edges:
            if a == at and b not in found:
                found[b] = found[at] + 1
                queue.append(b)
    return found


def test_every_event_is_an_edge(spark, tmp_path):
    users = walk()
    begin = datetime.datetime(2024, 1, 1)
    # two events share each time, and a few days have events
    data = [(i, begin + datetime.timedelta(hours=7 * (i // 2)), u, 199.9 if u == 51 else float(i % 50)) for i, u in enumerate(users)]
    spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    edges = {(a, b) for a, b in zip(users, users[1:]) if a != b}
    reach = {u: set(depths(edges, [b for a, b in edges if a == u])) for u in users}
    component = {u: min(v for v in reach[u] if u in reach[v]) for u in users if u in reach[u]}
    length = {c: min(depths(edges, [c])[a] + 1 for a, b in edges if b == c and component.get(a) == c) for c in set(component.values())}
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert len(length) == 3 and length[20] == 6
    assert {r.node: r.component for r in run("scc_components_all")} == component
    assert {r.component: r.length for r in run("shortest_cycle_len_all")} == length
    assert {r.name: r.depth for r in run("external_expansion_all")} == depths(edges, [51])
    cycles = {r.component: r.cycle for r in run("mutual_cycles")}
    assert set(cycles) == set(length) and cycles[20] == "20 -> 21 -> 22 -> 23 -> 24 -> 25"


def test_expansion_stays_within_its_budget(spark):
    rng = random.Random(6)
    names = [f"n{i:03d}" for i in range(200)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(500)]
    known = {n: rng.random() < 0.7 for n in names if rng.random() < 0.9}
    corpus, seeds = set(rng.sample(names, 20)), rng.sample(names, 6)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for budget in (1, 7, 40, 256):
        waiting, done, expected = sorted(seeds), set(), []
        while waiting and len(expected) < budget:
            name = waiting.pop(0)
            if name in done:
                continue
            done.add(name)
            found = known.get(name, False) and name not in corpus
            expected.append((name, found))
            if found:
                waiting = sorted(waiting + [b for a, b in edges if a == name and b != a and b not in corpus and b not in done])
        got = expand_within_budget(frame(edges, "src string, dst string"), frame(list(known.items()), "name string, is_reference boolean"), frame([(s,) for s in seeds], "name string"),
                                   frame([(c,) for c in corpus], "name string"), budget)
        assert got == expected


def test_long_chains(spark, monkeypatch):
    """A ring of 5000, two chains that close one cycle between them, and chains that lead in and out."""
    cuts = []
    monkeypatch.setattr(graph, "keep", lambda df, f=graph.keep: cuts.append(1) or f(df))
    ring = [(i, i + 1) for i in range(10_000, 14_999)] + [(14_999, 10_000)]
    there, back = [(i, i + 1) for i in range(100, 400)], [(400, 900), *[(i, i - 1) for i in range(900, 600, -1)], (600, 100)]
    led = [(i, i + 1) for i in range(2000, 2300)] + [(2300, 250), (350, 5000), *[(i, i + 1) for i in range(5000, 5200)]]
    edges = spark.createDataFrame([*ring, *there, *back, *led, (1, 2), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in graph.strong_components(edges).collect()}
    assert got == {i: 10_000 for i in range(10_000, 15_000)} | {i: 100 for i in [*range(100, 401), *range(600, 901)]}
    ring = edges.filter("src >= 10000")
    paths = {r.component: r.path for r in graph.component_cycles(ring, graph.strong_components(ring)).collect()}
    assert paths == {10_000: list(range(10_000, 15_000))}
    assert len(cuts) < 80
