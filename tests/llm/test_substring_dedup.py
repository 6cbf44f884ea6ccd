"""Removed bytes against a table of all windows."""

import hashlib
import re
from collections import Counter

import numpy as np

from orbweave.llm.substring_dedup import picked, strip_repeats

DEPTH = 400


def brute_force(rows):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + DEPTH] for t in texts for i in range(len(t) - DEPTH + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - DEPTH + 1):
            if seen[t[i : i + DEPTH]] > 1:
                gone[i : i + DEPTH] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((doc_id, len(t), int(gone.sum()), int(np.sum(np.diff(np.concatenate(([0], gone.astype(int)))) == 1)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made_rows():
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghij é\n"))
    noise = lambda n: "".join(rng.choice(letters, n))
    passages = [noise(n) for n in (399, 400, 401, 450, 700, 2500)]
    texts = []
    for i in range(60):
        text = noise(rng.integers(0, 900))
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(len(passages))]
            cut = rng.integers(0, len(p) // 3)
            text += p[cut:] + noise(rng.integers(0, 300))
        texts.append(text)
    texts += [texts[3], texts[3], "a" * 1200, "ab" * 500, "b" * 399, "b" * 400, None, "", "q" * 700 + noise(10), noise(300) * 3]
    texts.append(passages[5][:1000] + passages[5][1000:][::-1] + passages[5][:450])
    return [(i * 2, t) for i, t in enumerate(texts)] + [(None, noise(600))]


def test_removed_bytes(spark):
    rows = made_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, th string").repartition(4)
    found = strip_repeats(docs, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute_force(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)


def test_long_texts_in_pieces(spark, monkeypatch):
    rows = made_rows()
    rng = np.random.default_rng(1)
    big = "".join(rng.choice(list("abcdefgh "), 9000))
    rows += [(900, big), (901, big[500:7000]), (902, "z" + big[:4000])]
    from orbweave.llm import substring_dedup
    monkeypatch.setattr(substring_dedup, "PIECE", 1500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r)[:5] for r in strip_repeats(docs).collect()), key=str) == brute_force(rows)
    assert strip_repeats(docs.limit(0)).count() == 0


def test_picked_is_the_first_smallest():
    rng = np.random.default_rng(2)
    for n, width in ((50, 7), (7, 7), (1000, 301)):
        h = rng.integers(0, 2**20, n).astype(np.uint64) << np.uint64(40)
        expected = [s + int(np.argmin(h[s : s + width])) for s in range(n - width + 1)]
        assert picked(h, width).tolist() == expected


def covered_words(rows, depth=50):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    seen = Counter(tuple(w[i : i + depth]) for w in lists for i in range(len(w) - depth + 1))
    return sorted(((d, len({k for i in range(len(w) - depth + 1) if seen[tuple(w[i : i + depth])] > 1 for k in range(i, i + depth)})) for (d, _), w in zip(rows, lists, strict=True)), key=str)


def test_passages_of_words(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    passages = [words(n) for n in (49, 50, 51, 60, 200)]
    rows = [(i, f"{words(rng.integers(0, 90))} {passages[i % 5] if i % 3 else ''} {words(rng.integers(0, 90))}") for i in range(60)]
    rows += [(200 + i, f"{words(7)} {passages[4]} {words(i)}") for i in range(12)]  # equal runs in many texts
    rows += [(100, rows[1][1].upper()), (101, rows[5][1]), (None, passages[4] + " " + passages[4]), (102, None), (103, words(50)), (104, "a " * 120), (105, rows[5][1])]
    from orbweave.llm import substring_dedup
    monkeypatch.setattr(substring_dedup, "SAMPLED", 1)
    monkeypatch.setattr(substring_dedup, "MANY", 400)  # some grams are dealt as frequent ones
    got = strip_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.passage_words) for r in got), key=str) == covered_words(rows)
    assert all(r.in_passage == (r.passage_words > 0) for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_force(rows)
