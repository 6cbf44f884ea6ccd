"""The prefix trie against a plain Python version, on families, long chains, many equal conversations and odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from orbweave.llm import prefix_trie as pt

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = f"{len(role)}:{role}{text}"
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(said.encode()).hexdigest()[:32], role, text))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    members, ends, words = defaultdict(set), defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
            words[path[:d]] = len(re.findall(r"[^\x20\x09-\x0D]+", path[d - 1][1])) if d else 0
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path in members:
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(members[path]) - 1) * words[path]
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def spark_rows(spark, rows, schema=TURNS, **options):
    got = pt.prefix_trie(spark.createDataFrame(rows, schema), **options).collect()
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in got)


def some_chats(seed, convs=130):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-30, 400), convs):
        for turn in range(rng.choice([0, 1, 2, 3, 6])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a b c", "hello  you\t x", "", None, "é ß"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_chats(spark, seed):
    rows = some_chats(seed)
    assert spark_rows(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (7, None, "user", "no turn"), (7, 0, "user", "x"), (7, 0, "user", "x"), (7, 0, None, None),  # null turn, repeated and empty rows
        (45, 1, "user", "base is absent"), (None, 0, "user", "no conversation"),
        (60, 0, "1:", "user"), (61, 0, "1", ":user"),  # the same characters, cut in another way
        (62, 5, "user", "one turn"),  # may borrow all it has
    ]
    assert spark_rows(spark, rows) == plain(rows)


def test_one_conversation_many_times_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(pt.end_digests, "__defaults__", (20, 2))  # two families a row: ends go over many rows
    rows = [(c, t, "user", f"same words {t}") for c in range(1000, 1700) for t in range(2)]
    rows += [(3, t, "user", f"turn {t}") for t in range(300)]
    assert spark_rows(spark, rows) == plain(rows)


def test_empty_table_and_other_columns(spark):
    assert spark_rows(spark, []) == []
    rows = [(*r, "x", 1) for r in some_chats(5, 30)]
    assert spark_rows(spark, rows, TURNS + ", node string, base long") == plain([r[:4] for r in rows])
