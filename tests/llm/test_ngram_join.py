"""Components and kept rows against a comparison of all pairs."""

import re

import numpy as np

from orbweave.llm import ngram_join
from orbweave.llm.ngram_join import _decode_gaps, _encode_gaps, component_rows, keep_one

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((rows[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(rows)))


def made_texts(seed):
    rng = np.random.default_rng(seed)
    passage = " ".join(f"shared{i}" for i in range(40))
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(20, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 7)):  # edits about the threshold, chains of them
            base = list(base)
            for _ in range(rng.integers(1, 4)):
                base[rng.integers(len(base))] = f"e{rng.integers(100000)}"
            texts.append(" ".join(base))
        if rng.random() < 0.5:
            texts.append(f"{passage} {' '.join(base[: rng.integers(1, 40)])}")
    return [*texts, texts[0], texts[0].upper(), None, "", "One two", "one TWO", "one two three", "x", " \t\n"]


def test_components(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    monkeypatch.setattr(ngram_join, "STAR", 3)
    for seed in (1, 2):
        rows = [(1000 - 3 * i, t) for i, t in enumerate(made_texts(seed))]
        docs = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id long, text string, th int, class string").repartition(3)
        found = sorted(tuple(r) for r in component_rows(docs).select("doc_id", "n_shingles", "component_id").collect())
        assert found == brute_force(rows)


def test_nothing_small_enough_to_broadcast_or_to_carry(spark, monkeypatch):
    """Roots are joined by shuffles, and all bitmaps but the shortest are compared outside the tiles."""
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "SIGNATURE", 1)
    rows = [(7 * i, t) for i, t in enumerate(made_texts(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in component_rows(docs).select("doc_id", "n_shingles", "component_id").collect()) == brute_force(rows)


def test_keep_one(spark):
    rows = [(i, t) for i, t in enumerate(made_texts(3))]
    rows += [rows[0], (None, rows[0][1]), (None, "a text of its own with no id")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    expected = sorted(d for d, n, c in brute_force(rows[:-3]) if d == c or n == 0)
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == expected and ids.count(None) == 1
    assert keep_one(docs.limit(0)).count() == 0 and component_rows(docs.limit(0)).count() == 0


def test_gaps_round_trip():
    rng = np.random.default_rng(0)
    for values in ([], [0], [0, 0, 255, 255, 510, 511], np.sort(rng.integers(0, 10**6, 5000))):
        values = np.asarray(values, dtype=np.int64)
        assert (_decode_gaps(_encode_gaps(values)) == values).all()
