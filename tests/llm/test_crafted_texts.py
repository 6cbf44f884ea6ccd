"""Texts made to collide in polynomial hashes modulo 2**64: the Thue-Morse sequence and its complement."""

import hashlib

import numpy as np
import pytest

from orbweave.llm.fingerprint import edited_likeness
from orbweave.llm.ngram_join import component_rows
from orbweave.llm.substring_dedup import strip_repeats
from orbweave.llm.textops import BASES, PRIME, Exact, column_bytes, product, words

DOCUMENTS = "doc_id long, text string"


def thue_morse(bits, one, two):
    return "".join((one, two)[k.bit_count() & 1] for k in range(1 << bits))


def pair(bits, one="a", two="b"):
    return thue_morse(bits, one, two), thue_morse(bits, two, one)


def test_products_modulo_the_prime():
    rng = np.random.default_rng(3)
    a, b = (np.concatenate((rng.integers(0, PRIME, 500, dtype=np.uint64), np.array([0, 1, PRIME - 1], dtype=np.uint64))) for _ in range(2))
    assert product(a, b).tolist() == [x * y % PRIME for x, y in zip(a.tolist(), b.tolist())]


@pytest.mark.parametrize("tokens", [np.frombuffer(b"the same words the same words" * 300, dtype=np.uint8), np.tile(np.random.default_rng(1).integers(0, 1 << 64, 70, dtype=np.uint64), 90)])
def test_exact_windows_are_equal_where_the_tokens_are(tokens):
    starts = np.arange(0, len(tokens) - 200, 7)
    for which in range(len(BASES)):
        found = Exact(tokens, which).windows(starts, starts + 200)
        of = {}
        for s, h in zip(starts.tolist(), found.tolist()):
            assert of.setdefault(tokens[s : s + 200].tobytes(), h) == h
        assert len(set(of.values())) == len(of)


def test_words_hash_apart_wherever_they_stand():
    import pyarrow as pa

    one, two = pair(10)
    hashes, counts = words(*column_bytes(pa.array([f"{one} {two}", f"x  {one.upper()}", two, None, " "])))
    assert counts.tolist() == [2, 2, 1, 0, 0]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[4] and hashes[0] != hashes[1]


def test_op1_and_op2_on_long_words(spark):
    one, two = pair(10)
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} a b c d e"), (4, f"{two} a b c d e"), (5, one)], DOCUMENTS)
    assert {r.doc_id: r.component_id for r in component_rows(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    likeness = {r.doc_id: r.near_next for r in edited_likeness(docs).collect()}
    assert likeness[1] == 1 and likeness[2] < 0.6 and likeness[5] < 0.6  # of 5 and 1 the texts are equal, of the others no shingle is


def test_op3_on_complements(spark):
    one, two = pair(9)
    blocks = pair(9, "xyzzyx.,", "plugh123")
    texts = [one, two, "q" + one[:450] + "r", *(b[:900] for b in blocks), "s" * 399]
    got = {r.doc_id: r for r in strip_repeats(spark.createDataFrame(list(enumerate(texts)), DOCUMENTS)).collect()}
    starts = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 399):
            starts.setdefault(t[i : i + 400], []).append((k, i))
    for k, t in enumerate(texts):
        gone = np.zeros(len(t), dtype=bool)
        for places in starts.values():
            if len(places) > 1:
                for d, i in places:
                    if d == k:
                        gone[i : i + 400] = True
        assert got[k].n_removed == gone.sum()
        assert got[k].kept_sha256 == hashlib.sha256("".join(c for c, g in zip(t, gone) if not g).encode()).hexdigest()
