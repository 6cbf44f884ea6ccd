"""Best-fit packing of tokenised documents by exact-complement hashing over a length histogram.

Tasks tokenise whole texts and cut those over a sequence's size; each piece gets its rank among the
pieces of its length in its task. The driver sees only how many pieces of each length there are (at
most one number a length) and plans patterns: for each length, from the longest, it looks up the
single length that fills the gap exactly, then pairs, then triples of lengths, consumes as many such
combinations as the counts allow, and packs what is left by best fit. A pattern used m times takes m consecutive
ranks of each of its lengths, so every piece finds its sequence and place from its rank alone.

Defined results: null text is empty, so its document is the end token alone; ids, ties and repeated
rows do not matter, each row is its own document; an empty table gives an empty result; a text that
contains the literal end-of-text marker is encoded as the tokenizer does by default; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from struct import pack as pack_ids

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import cut, small_batches

SEQUENCE = 1024
END = 2
KNOWN_WORDS = 250_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The characters that byte-level BPE writes for the bytes 0 to 255: printable ones stand for themselves, the others follow from 256 on.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}


class Words(dict):
    """Pre-tokens to their ids as little-endian bytes; the model is asked for those not met of late.

    There are two generations, of which the older is dropped in time.
    """

    def __init__(self, model):
        self.tokenize = model.tokenize
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            found = self.tokenize(word.encode().decode("latin-1").translate(BYTE_CHARACTERS))
            ids = pack_ids(f"<{len(found)}I", *[t.id for t in found])
        self[word] = ids
        return ids


class Encoder:
    """Token ids as little-endian bytes; the tokenizer's BPE model is asked once for each pre-token.

    Byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens, and a
    pre-token's are the model's for its bytes: the rest of the tokenizer costs three times as much there.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.any_split = regex.compile(public_tokenizers.PATTERN).findall
        self.markers = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Words(self.tokenizer.model)

    def __call__(self, text: str) -> bytes:
        if any(m in text for m in self.markers):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = self.any_split(text) if UNUSUAL.search(text) else usual_split(text)
        return b"".join(map(self.known.__getitem__, words))


#: Where a text has only these characters, the letters and digits of the tokenizer's pattern are
#: those of usual_split, which is the same pattern for them and faster.
UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]")
usual_split = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+").findall
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECE = "chunk int, rank long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut_pieces(batches: Iterator, path: str, with_ids: bool) -> Iterator:
    """Rows (doc_id, text) to pieces; rank counts the pieces of one length within this task."""
    import pyarrow as pa
    from pyspark import TaskContext

    encode, chunk, ranks = encoder(path), TaskContext.get().partitionId(), Counter()
    end = np.array([END], dtype="<u4").tobytes()
    for batch in batches:
        rows, tokens = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text or "") + end
            total = len(ids) // 4
            start, piece = 0, 0
            while start < total:
                to = start + (total - start - 1) % SEQUENCE + 1  # the first piece takes what is over
                part = ids[4 * start : 4 * to]
                rows.append((chunk, ranks[to - start], doc_id, piece, start, to - start, zlib.crc32(part)))
                if with_ids:
                    tokens.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
                ranks[to - start] += 1
                start, piece = to, piece + 1
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in PIECE.split(", ")]
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
        if with_ids:
            arrays, names = [*arrays, pa.array(tokens, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _complement(gap: int, length: int, counts: np.ndarray, parts: int) -> tuple | None:
    """So many lengths (one to three), of which enough are left and which sum to gap, largest first."""
    def enough(found: tuple) -> bool:
        return all(counts[x] >= n for x, n in Counter((length, *found)).items())

    if parts == 1:
        return (gap,) if enough((gap,)) else None
    there = np.flatnonzero(counts[: gap + 1])[::-1]
    if parts == 2:
        for a in there[(there * 2 >= gap) & (counts[gap - there] > 0)]:
            if a < gap and enough((int(a), gap - int(a))):
                return int(a), gap - int(a)
        return None
    for a in there[there * 3 >= gap]:
        rest = gap - int(a)
        second = there[(there <= a) & (there * 2 >= rest) & (there < rest)]
        for b in second[counts[rest - second] > 0]:
            if enough((int(a), int(b), rest - int(b))):
                return int(a), int(b), rest - int(b)
    return None


def _exact(counts: np.ndarray, size: int, parts: int) -> list[tuple[tuple, int]]:
    """Takes from counts what fills sequences exactly: a length, from the longest, and so many others."""
    patterns = []
    for length in range(size - 1, 0, -1):
        while counts[length] and (found := _complement(size - length, length, counts, parts)):
            whole = (length, *found)
            need = Counter(whole)
            times = int(min(counts[x] // n for x, n in need.items()))
            for x, n in need.items():
                counts[x] -= n * times
            patterns.append((whole, times))
    return patterns


def _best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple, int]]:
    """Best fit of what counts has, longest first; equal pieces that meet equal gaps move as one."""
    open_: dict[int, list[tuple[tuple, int]]] = {}
    for length in range(size - 1, 0, -1):
        left = int(counts[length])
        while left:
            gap = min((g for g, groups in open_.items() if g >= length and groups), default=None)
            if gap is None:
                each = size // length
                for parts, times in (((length,) * each, left // each), ((length,) * (left % each), 1)):
                    if parts and times:
                        open_.setdefault(size - sum(parts), []).append((parts, times))
                left = 0
            else:
                parts, times = open_[gap].pop()
                used = min(times, left)
                if times > used:
                    open_[gap].append((parts, times - used))
                open_.setdefault(gap - length, []).append(((*parts, length), used))
                left -= used
    return [group for groups in open_.values() for group in groups]


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[tuple, int]]:
    """(lengths, times) of sequences that hold all pieces; histogram: pieces by length.

    Single complements of all lengths are consumed first, then pairs, then triples, so that small pieces
    are not used up while larger ones fill the same gap. How far to go is open: exact fills of long pieces
    may take the small ones that others need. So the plan is made with no, one, two and three of these
    steps before best fit, and the one with the fewest sequences is taken (of equal ones the one with most
    steps). Plain best fit is one of them, so no plan needs more.
    """
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    full = [((size,), int(counts[size]))] if counts[size] else []
    counts[size] = 0
    exact: list[tuple[tuple, int]] = []
    best, fewest = None, 0
    for parts in range(4):
        if parts:
            exact += _exact(counts, size, parts)
        whole = full + exact + _best_fit(counts, size)
        needs = sum(times for _, times in whole)
        if best is None or needs <= fewest:
            best, fewest = whole, needs
    return best


def places(patterns: list[tuple[tuple, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each run of equal places."""
    found: dict[int, list] = {}
    taken, sequence = Counter(), 0
    for lengths, times in patterns:
        offset = 0
        for length in lengths:
            found.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}


def _place(batches: Iterator, where) -> Iterator:
    """Adds sequence_id and offset to pieces (…, length, rank); rank: among all of that length."""
    import pyarrow as pa

    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for one in np.unique(length):
            own = np.flatnonzero(length == one)
            first, sequences, offsets = where.value[int(one)]
            run = np.searchsorted(first, rank[own], side="right") - 1
            sequence[own], offset[own] = sequences[run] + rank[own] - first[run], offsets[run]
        keep = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)],
                                         names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; and ids if asked for."""
    small_batches(docs.sparkSession)
    columns = PIECE + (", ids array<int>" if with_ids else "")
    pieces = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
                 .mapInArrow(partial(_cut_pieces, path=path or tokenizer_path(), with_ids=with_ids), columns))
    by_task = cut(pieces.groupBy("length", "chunk").count())
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    where = docs.sparkSession.sparkContext.broadcast(places(plan(histogram)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = pieces.join(bases, ["length", "chunk"]).select(*out, (F.col("rank") + F.col("base")).alias("rank"))
    kinds = dict(pieces.dtypes)
    return ranked.mapInArrow(partial(_place, where=where), ", ".join(f"{c} {kinds[c]}" for c in out) + ", sequence_id long, offset long")
