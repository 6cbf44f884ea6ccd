"""Fingerprints against true Jaccard similarity and plain Python."""

import hashlib
import re

import numpy as np

from orbweave.llm import fingerprint
from orbweave.llm.fingerprint import BINS, EMPTY, densify, edited_likeness
from orbweave.llm.textops import U

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, found, tolerance=0.15):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert sorted(f.doc_id for f in found if f.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None)
    by_id = {f.doc_id: f for f in found}
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        f = by_id[doc_id]
        assert f.n_chars == len(text)
        assert f.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(f.near_edited - jaccard(text, edited)) < tolerance
        assert abs(f.near_next - jaccard(text, after)) < tolerance


def test_rows_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}é" for i in range(400)]
    rows = [(i * 3, " ".join(rng.choice(vocabulary, rng.integers(60, 300)))) for i in range(60)]
    rows[10] = (rows[10][0], rows[9][1])
    rows[20] = (rows[20][0], None)
    rows[21] = (rows[21][0], "")
    rows[22] = (rows[22][0], "One two THREE")
    rows[23] = (rows[23][0], "one two three")
    rows[30] = (rows[30][0], "long " + " ".join(rng.choice(vocabulary, 5000)))
    rows[40] = (None, "a row without an id " * 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(rows, edited_likeness(docs).collect())


def test_equal_texts_and_small_tables(spark):
    docs = spark.createDataFrame([(1, "Same text of six words here", 1), (2, "same Text of six words here", 2)], "doc_id long, text string, rank int")
    a, b = edited_likeness(docs).collect()
    assert a.fingerprint == b.fingerprint != ""
    assert edited_likeness(docs.limit(0)).count() == 0
    one = edited_likeness(docs.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_densify_is_a_function_of_the_set():
    bins = np.full((3, BINS), EMPTY, dtype=U)
    bins[0, 5] = 77
    bins[1, [5, 90]] = [77, 12]
    full = densify(bins)
    assert (full[0] == 77).all() and (full[2] == EMPTY).all()
    assert set(full[1].tolist()) == {77, 12} and (full == densify(bins)).all()
