"""Packing: every piece has one place, sequences are gapless, ids are the tokenizer's."""

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from orbweave.llm.packing import END, SEQUENCE, encoder, pack, plan, tokenizer_path

TEXTS = [
    "A short text, it's only a few words.", None, "", "x<|endoftext|>y", "ünï ½ １２ 語 don't''ll  \t\n\n z", " ".join(f"word{i}" for i in range(2500)),
    "same text", "same text", "  leading and   inner spaces  ", " ".join(f"n{i}" for i in range(340)),
]


def expected(rows):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END]
        first = (len(ids) - 1) % SEQUENCE + 1
        cuts = [0, *range(first, len(ids) + 1, SEQUENCE)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())


def test_pieces_and_places(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "no id")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, length int").repartition(3)
    found = pack(docs, with_ids=True).collect()
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=key) == sorted(expected(rows), key=key)
    by_sequence = defaultdict(list)
    for r in found:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= SEQUENCE
    assert len(by_sequence) <= -(-sum(r.length for r in found) // SEQUENCE) + 1


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(0)
    for size in (1, 5, 50, 400, 3000):
        histogram = Counter(rng.integers(1, SEQUENCE + 1, size).tolist())
        used = Counter()
        for lengths, times in plan(histogram):
            assert sum(lengths) <= SEQUENCE
            for x in lengths:
                used[x] += times
        assert used == histogram
    assert plan({600: 2, 424: 1, 300: 1, 124: 1}) == [((600, 424), 1), ((600, 300, 124), 1)]


def plain_best_fit(histogram):
    """How many sequences best fit takes, piece by piece from the longest."""
    gaps = []
    for length in sorted(histogram.elements(), reverse=True):
        at = bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else SEQUENCE
        insort(gaps, gap - length)
    return len(gaps)


def spreads():
    rng = np.random.default_rng(7)
    for k in range(20):
        shape = rng.lognormal(rng.uniform(3, 6.5), rng.uniform(0.3, 1.5), 300 + 300 * k)
        yield f"random {k}", Counter((np.clip(shape, 1, SEQUENCE)).astype(int).tolist())
    encode = encoder(tokenizer_path())
    for name in ("sf0.001", "sf0.01", "sf0.1"):
        found = Counter()
        for text in pq.read_table(f"/root/testdata/{name}/documents.parquet", columns=["text"]).column(0).to_pylist():
            total = len(encode(text or "")) // 4 + 1
            found.update([(total - 1) % SEQUENCE + 1] + [SEQUENCE] * ((total - 1) // SEQUENCE))
        yield name, found


@pytest.mark.parametrize(("name", "histogram"), list(spreads()) if os.path.isdir("/root/testdata/sf0.1") else [])
def test_no_more_sequences_than_plain_best_fit(name, histogram):
    patterns = plan(histogram)
    used = Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= SEQUENCE
        for x in lengths:
            used[x] += times
    assert used == histogram
    assert sum(times for _, times in patterns) <= plain_best_fit(histogram)
