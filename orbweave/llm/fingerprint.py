"""Document fingerprints: one-permutation MinHash with optimal densification, packed to 4 bits.

Each five-word shingle is hashed once; the leading 9 bits choose one of 512 bins and the smallest
hash of a bin is its value. An empty bin borrows from a bin found by a chain of universal hashes of
(bin, attempt), which equal sets follow alike. Only the 4 low bits of each value are stored; as two
unrelated values agree in them once in 16 times, the share of equal bins is corrected for that.

Defined results: words are compared with A-Z in lower case; a text with one to four words is one
shingle; a text without words (or null) has the fingerprint "", which is like itself (1) and unlike
all others (0); ids order the edited texts as documents do, null ids last, ties by text; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import bounds_at_most, numbers, small_batches
from orbweave.llm.textops import PIECE, U, column_bytes, mix, shingles, words

BIN_BITS, STORED_BITS = 9, 4
BINS = 1 << BIN_BITS
EMPTY = U(0xFFFFFFFFFFFFFFFF)
#: Documents of one range, about; a task handles one range of ids at a time.
RANGE_ROWS = 1000
MAX_RANGES = 65536


def borrowed_from(attempts: np.ndarray) -> np.ndarray:
    """Which bin each bin asks at each attempt: (attempts, BINS)."""
    asked = mix(attempts.astype(U)[:, None] * U(0x9E3779B97F4A7C15) + np.arange(1, BINS + 1, dtype=U)[None, :] * U(0xC2B2AE3D27D4EB4F))
    return (asked >> U(64 - BIN_BITS)).astype(np.int64)


CHAINS = borrowed_from(np.arange(64))


def densify(bins: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row; rows without any value stay empty."""
    filled = bins.copy()
    todo = np.flatnonzero((bins == EMPTY).any(axis=1) & (bins != EMPTY).any(axis=1))
    for chain in CHAINS:
        if not len(todo):
            return filled
        rows = filled[todo]
        filled[todo] = np.where(rows == EMPTY, bins[todo][:, chain], rows)
        todo = todo[(filled[todo] == EMPTY).any(axis=1)]
    for row in todo:  # few values: follow the chains in blocks
        own = np.flatnonzero(bins[row] != EMPTY)
        if len(own) == 1:
            filled[row] = bins[row, own[0]]
            continue
        attempt = len(CHAINS)
        while (left := np.flatnonzero(filled[row] == EMPTY)).size:
            found = bins[row][borrowed_from(np.arange(attempt, attempt + 256))[:, left]]
            hit = (found != EMPTY).argmax(axis=0)
            filled[row, left] = found[hit, np.arange(len(left))]
            attempt += 256
    return filled


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Stored bits of each text, one byte a bin; rows of 255 stand for texts without words."""
    count = len(offsets) - 1
    bins = np.full(count * BINS, EMPTY, dtype=U)
    runs, of = shingles(*words(data, offsets))
    np.minimum.at(bins, of * BINS + (runs >> U(64 - BIN_BITS)).astype(np.int64), runs)
    bins = bins.reshape(count, BINS)
    none = (bins == EMPTY).all(axis=1)
    stored = (densify(bins) & U((1 << STORED_BITS) - 1)).astype(np.uint8)
    stored[none] = 255
    return stored


def packed(stored: np.ndarray) -> list[str]:
    """Two bins a byte, in base64."""
    pairs = (stored[:, ::2] << 4 | stored[:, 1::2] & 15).astype(np.uint8)
    return ["" if row[0] == 255 else base64.b64encode(pair.tobytes()).decode() for row, pair in zip(stored, pairs, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of stored bits, corrected for chance agreement."""
    chance = 1 / (1 << STORED_BITS)
    same = ((a == b).mean(axis=1) - chance) / (1 - chance)
    empty_a, empty_b = a[:, 0] == 255, b[:, 0] == 255
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), np.clip(same, 0, 1))


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)])


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprint_rows(batches: Iterator) -> Iterator:
    """Rows sorted by (range, halo, doc_id descending): each is compared with the next of its range."""
    import pyarrow as pa

    def emit(rows: list[tuple]):
        """rows: (range, halo, doc_id, text); the last one is only the next of the one before it."""
        texts = [r[3] for r in rows]
        plain = fingerprints(*_encode(texts))
        own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not own:
            return None
        edited = []
        for i in own:
            text, k = texts[i], len(texts[i]) // 3
            edited.append(text[: len(text) - k] + texts[i + 1][:k])
        data, offsets = _encode(edited)
        changed = fingerprints(data, offsets)
        at = np.array(own)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([rows[i][2] for i in own], pa.int64()),
            "n_chars": pa.array([len(texts[i]) for i in own], pa.int64()),
            "edited_sha256": [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)],
            "fingerprint": packed(plain[at]), "edited_fingerprint": packed(changed),
            "near_edited": likeness(plain[at], changed), "near_next": likeness(plain[at], plain[at + 1]),
        })

    held: list[tuple] = []
    size = 0
    for batch in batches:
        columns = [batch.column(i) for i in range(4)]
        for start in range(0, batch.num_rows, 200):
            part = [c.slice(start, 200).to_pylist() for c in columns]
            for row in zip(*part, strict=True):
                held.append(row)
                size += len(row[3])
                if len(held) > 1 and size > PIECE:
                    if (out := emit(held)) is not None:
                        yield out
                    held, size = held[-1:], len(held[-1][3])
    if len(held) > 1 and (out := emit(held)) is not None:
        yield out


def edited_likeness(docs: DataFrame) -> DataFrame:
    """The rows of op1: fingerprints of each text and of its edited text, and their likeness.

    Documents are dealt by ranges of ids (their bounds, at most MAX_RANGES numbers, are known to
    the driver), and the first row of each range is copied behind the end of the range before it.
    """
    small_batches(docs.sparkSession)
    lowest = F.lit(-(2**63)).cast("long")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), lowest).alias("rank"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"))
    count = max(1, min(MAX_RANGES, docs.count() // RANGE_ROWS))
    shares = [i / count for i in range(1, count)]
    bounds = [int(b) for b in sorted(set(rows.approxQuantile("rank", shares, 0.1 / count)))] if shares else []
    dealt = rows.withColumn("range", bounds_at_most(F.col("rank"), bounds))
    tops = sorted(tuple(r) for r in dealt.groupBy("range").agg(F.max("rank")).collect())
    highest, above = [0] * (len(bounds) + 2), [0] * (len(bounds) + 2)
    for i, (number, top) in enumerate(tops):
        highest[number], above[number] = top, tops[(i + 1) % len(tops)][0]
    copies = F.array_compact(F.array(
        F.struct(F.col("range"), F.lit(False).alias("halo")),
        F.when(F.get(numbers(highest), F.col("range")) == F.col("rank"),
               F.struct(F.get(numbers(above), F.col("range")).cast("int").alias("range"), F.lit(True).alias("halo")))))
    parts = dealt.withColumn("copy", F.explode(copies)).select("copy.range", "copy.halo", "doc_id", "text")
    return (parts.repartition("range").sortWithinPartitions("range", "halo", F.col("doc_id").desc_nulls_last(), "text")
            .mapInArrow(_fingerprint_rows, SCHEMA))
