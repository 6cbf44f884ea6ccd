"""Removal of repeated strings by a depth-limited radix sort of suffixes, digit by digit from an anchor.

A string of `depth` tokens that starts twice is a pair of suffixes that agree to that depth, so suffixes
are sorted only as deep as that, most significant digit first, and one that is alone in its bucket after a
digit leaves. Equal groups after the last digit are exactly the repeated windows. The digits are taken
from an anchor outwards, not from the left, so that neighbouring suffixes go through the first ones together:

1. The first digit of a window is the smallest hash of its grams, its anchor. Neighbouring windows that
   have the same one form a run, and runs are sorted, about one for (depth - gram) / 2 suffixes. Runs that
   agree in all their tokens are repeated as a whole, and one of them stands for all from there on.
2. The second digit is the core: windows that start in one band of places before the anchor have a part in
   common, all but a band's length of the depth. Bands whose core occurs once leave.
3. The last digit is the whole window, 128 bits of hash, of each start in the bands that are left.

Grams that a sample finds to be frequent are dealt by run as well, so that no bucket of step 1 is large;
buckets of the other steps are counted in the map side's aggregate and joined back, never gathered.
A token is a byte, or a word for the passages.

Defined results: null text counts as empty; texts of fewer than 400 bytes lose nothing; a text of 400
bytes and more with an equal text elsewhere (or a row that is repeated) loses everything; passages are
strings of 50 words (A-Z in lower case) that start twice; ids may be null or repeated, each row gives one
row; an empty table gives an empty result; other columns are not read. Texts are told apart by 64 bits
where they are joined, by SHA-256 where they are called equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.bloom import needed
from orbweave.llm.common import WORD, remove, shared_folder, small_batches, written
from orbweave.llm.textops import PIECE, TABLE, Exact, Rolling, U, column_bytes, mix, pieces, words


@dataclass(frozen=True)
class Unit:
    """What tokens are, how many a window has, how many a gram, and how many starts are in a band."""

    token: str
    depth: int
    gram: int
    band: int


BYTES, WORDS = Unit("byte", 400, 100, 25), Unit("word", 50, 10, 10)
PLACE_BITS = 24
#: One text in so many is looked at for frequent grams; a gram is frequent that makes up one run in MANY of those.
SAMPLED, MANY = 64, 5000
#: A frequent gram is dealt to so many buckets.
SALTS = 256


def tokens(column, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts of an Arrow column end to end (bytes as they are, words as hashes), and where each text begins."""
    data, offsets = column_bytes(column)
    if unit.token == "byte":
        return data, offsets
    hashes, counts = words(data, offsets)
    return hashes, np.concatenate(([0], np.cumsum(counts)))


def _values(part: np.ndarray) -> np.ndarray:
    return TABLE[part] if part.dtype == np.uint8 else part


def picked(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes, the place of its smallest one (the first of equals)."""
    count = len(hashes) - width + 1
    keys = (hashes >> U(PLACE_BITS) << U(PLACE_BITS)) | np.arange(len(hashes), dtype=U)
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(U).max, dtype=U)
    padded[: len(keys)] = keys
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & U((1 << PLACE_BITS) - 1)).astype(np.int64)


def runs_of(values: np.ndarray, offsets: np.ndarray, unit: Unit):
    """The runs of windows of each text, as arrays: text, first start, last start and anchor (from the
    beginning of the text), gram hash, run hash, the first band of starts and how many, and all cores' hashes.
    """
    nothing = tuple(np.zeros(0, dtype=d) for d in (np.int64, np.int64, np.int64, np.int64, U, U, np.int64, np.int64, np.int32))
    if len(values) < unit.depth:
        return nothing
    hashes = Rolling(_values(values))
    at = np.arange(len(values) - unit.gram + 1)
    grams = hashes.windows(at, at + unit.gram)
    place = picked(grams, unit.depth - unit.gram + 1)
    starts = np.arange(len(place))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    inside = starts + unit.depth <= offsets[owner + 1]
    starts, place, owner = starts[inside], place[inside], owner[inside]
    if not len(starts):
        return nothing
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))
    first, last = starts[new], starts[np.concatenate((new[1:], [True]))]
    of, anchor = owner[new], place[new]
    band = (anchor - last) // unit.band
    bands = (anchor - first) // unit.band - band + 1
    row = np.repeat(np.arange(len(of)), bands)
    k = band[row] + np.arange(len(row)) - np.repeat(np.cumsum(bands) - bands, bands)
    cores = (hashes.windows(anchor[row] - k * unit.band, anchor[row] + unit.depth - (k + 1) * unit.band) >> U(33)).astype(np.int32)
    return of, first - offsets[of], last - offsets[of], anchor - offsets[of], grams[anchor], Exact(values, 0).windows(first, last + unit.depth), band, bands, cores


def portions(values: np.ndarray, offsets: np.ndarray, unit: Unit) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, start in it, tokens, offsets) of about PIECE tokens; long texts overlap by a window."""
    for first, last in pieces(offsets, PIECE):
        begin, end = int(offsets[first]), int(offsets[last])
        if last == first + 1 and end - begin > PIECE:
            for at in range(0, max(1, end - begin - unit.depth + 1), PIECE):
                part = values[begin + at : min(end, begin + at + PIECE + unit.depth - 1)]
                yield first, at, part, np.array([0, len(part)])
        else:
            yield first, 0, values[begin:end], offsets[first : last + 1] - begin


def _third_and_later(gram: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Places of runs that two equal ones came before."""
    order = np.lexsort((run, gram))
    new = np.concatenate(([True], (gram[order][1:] != gram[order][:-1]) | (run[order][1:] != run[order][:-1])))[: len(order)]
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) > 1]


RUN = "gram long, salt int, run long, th long, first int, last int, anchor int, band int, cores array<int>"


def _runs(batches: Iterator, unit: Unit, frequent=None) -> Iterator:
    """Rows (th, text) to RUN; each task gives a text once.

    Of equal runs that are met together, two go to the bucket of their gram; the others, which are known
    to be repeated by then, get a negative salt and are spread, so that no run fills a bucket.
    """
    import pyarrow as pa

    hot = np.zeros(0, dtype=np.int64) if frequent is None else frequent.value
    seen: set = set()
    for batch in batches:
        keys = batch.column(0).to_numpy()
        fresh = np.zeros(len(keys), dtype=bool)
        for i, th in enumerate(keys.tolist()):
            if th not in seen:
                seen.add(th)
                fresh[i] = True
        keys = keys[fresh]
        for text, at, part, offsets in portions(*tokens(batch.column(1).filter(pa.array(fresh)), unit), unit):
            of, first, last, anchor, gram, run, band, bands, cores = runs_of(part, offsets, unit)
            gram, run = gram.view(np.int64), run.view(np.int64)
            salt = np.where(np.isin(gram, hot), run % SALTS + 1, 0)
            again = _third_and_later(gram, run)
            salt[again] = -1 - keys[text + of[again]] % SALTS
            ints = lambda x: pa.array(x.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram), ints(salt), pa.array(run), pa.array(keys[text + of]), ints(first + at), ints(last + at), ints(anchor + at), ints(band),
                 pa.ListArray.from_arrays(ints(np.concatenate(([0], np.cumsum(bands)))), pa.array(cores))],
                names=[c.split()[0] for c in RUN.split(", ")])


def _windows(batches: Iterator, unit: Unit) -> Iterator:
    """Rows (th, text, open array<struct<low, high, weight>>) to (th, start, weight, w1, w2), a row a start."""
    import pyarrow as pa

    for batch in batches:
        values, offsets = tokens(batch.column(1), unit)
        for i, (th, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            text = values[offsets[i] : offsets[i + 1]]
            spans.sort(key=lambda r: r["low"])
            k = 0
            while k < len(spans):  # neighbouring spans of at most PIECE tokens are hashed together
                low, to = spans[k]["low"], k
                while to < len(spans) and spans[to]["high"] - low < PIECE:
                    to += 1
                to = max(to, k + 1)
                starts = np.concatenate([np.arange(r["low"], r["high"] + 1) for r in spans[k:to]])
                weight = np.repeat([r["weight"] for r in spans[k:to]], [r["high"] - r["low"] + 1 for r in spans[k:to]])
                part = text[low : int(starts.max()) + unit.depth]
                one, two = (Exact(part, k).windows(starts - low, starts - low + unit.depth) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), th, dtype=np.int64)), pa.array(starts.astype(np.int32)), pa.array(weight.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    names=["th", "start", "weight", "w1", "w2"])
                k = to


REST = "th long, n_removed long, n_spans long, kept_sha256 string"


def removed(size: int, repeated: np.ndarray, depth: int) -> np.ndarray:
    """Which bytes lie in windows that start in one of the ranges."""
    edge = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edge, repeated >> 32, 1)
    np.add.at(edge, (repeated & 0xFFFFFFFF) + depth, -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(batches: Iterator, with_text: bool) -> Iterator:
    """Rows (th, text, repeated array<long>) to REST, and the bytes left if asked for."""
    import pyarrow as pa

    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        rows = []
        for i, (th, repeated) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
            text = data[offsets[i] : offsets[i + 1]]
            gone = removed(len(text), repeated.values.to_numpy(), BYTES.depth)
            spans = int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1]))))
            left = text[~gone].tobytes()
            rows.append((th, int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=[c.split()[0] for c in REST.split(", ")] + ["kept"] * with_text)


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row (th, text) for each th of the table wanted, joined with its other column. Only texts that may be wanted move."""
    return needed(texts, wanted.select(F.col("th").alias("h")), wanted.count()).groupBy("th").agg(F.any_value("text").alias("text")).join(wanted, "th")


def frequent_grams(texts: DataFrame, unit: Unit, path: str) -> np.ndarray:
    """Hashes of fewer than MANY grams that a sample of texts has most often. They only decide how runs are dealt."""
    sample = texts.filter(F.pmod(F.xxhash64("th"), F.lit(SAMPLED)) == 0).mapInArrow(partial(_runs, unit=unit), RUN)
    counts = written(sample.groupBy("gram").count(), path)
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return np.array(sorted(r.gram for r in counts.filter(F.col("count") > max(8, total // MANY)).collect()), dtype=np.int64)


def repeated_ranges(texts: DataFrame, unit: Unit, folder: str) -> DataFrame:
    """(th, repeated): the ranges of starts of repeated windows in each of texts (th, text), a table in folder.

    A range from first to last is the number first * 2**32 + last.
    """
    spark = texts.sparkSession
    long_ones = texts.filter(F.octet_length("text") >= (unit.depth if unit.token == "byte" else 2 * unit.depth - 1))
    frequent = spark.sparkContext.broadcast(frequent_grams(long_ones, unit, f"{folder}/grams"))

    # the first digit
    equal, bucket = Window.partitionBy("gram", "salt", "run"), Window.partitionBy("gram", "salt")
    shared = written(
        long_ones.mapInArrow(partial(_runs, unit=unit, frequent=frequent), RUN).repartition("gram", "salt").distinct()
        .withColumn("rank", F.row_number().over(equal.orderBy("th", "first"))).withColumn("same", F.count(F.lit(1)).over(equal)).withColumn("all", F.count(F.lit(1)).over(bucket))
        .filter("all > 1 or salt <> 0"), f"{folder}/shared")
    frequent.destroy()
    whole = shared.filter("same > 1 or salt < 0").select("th", "first", "last")

    # the second digit
    cores = (shared.filter("rank = 1 and (same < all and salt = 0 or salt > 0)")
             .select("gram", "th", "first", "last", "anchor", "band", F.least("same", F.lit(2)).cast("int").alias("weight"), F.posexplode("cores").alias("k", "core")).withColumn("band", F.col("band") + F.col("k")))
    twice = cores.groupBy("gram", "band", "core").agg(F.count(F.lit(1)).alias("n"), F.min("weight").alias("least")).filter("n > 1 and least = 1").drop("n", "least")
    low = F.greatest("first", F.col("anchor") - (F.col("band") + 1) * unit.band + 1)
    high = F.least("last", F.col("anchor") - F.col("band") * unit.band)
    spans = written(cores.join(twice, ["gram", "band", "core"]).groupBy("th").agg(F.collect_list(F.struct(low.alias("low"), high.alias("high"), "weight")).alias("open")), f"{folder}/open")

    # the last digit
    windows = written(_texts_of(long_ones, spans).select("th", "text", "open").mapInArrow(partial(_windows, unit=unit), "th long, start int, weight int, w1 long, w2 long"), f"{folder}/windows")
    again = windows.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).filter("n > 1").drop("n")
    single = windows.filter("weight = 1").join(again, ["w1", "w2"]).select("th", F.col("start").alias("first"), F.col("start").alias("last"))
    span = F.shiftleft(F.col("first").cast("long"), 32) + F.col("last")  # one number, as texts may have many
    found = written(whole.unionAll(single).groupBy("th").agg(F.collect_list(span).alias("repeated")), f"{folder}/repeated")
    for name in ("grams", "shared", "open", "windows"):
        remove(spark, f"{folder}/{name}")
    return found


def _covered(unit: Unit):
    """How many tokens lie in the windows that start in the ranges of `repeated`."""
    first, last = (lambda r: F.shiftright(r, 32)), (lambda r: r.bitwiseAND(0xFFFFFFFF))
    grown = F.aggregate(F.array_sort("repeated"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")), lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0), last(r) + unit.depth - F.greatest(first(r), s["upto"]))).cast("long").alias("n"),
        F.greatest(s["upto"], last(r) + unit.depth).cast("long").alias("upto")))
    return grown["n"]


def strip_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """The rows of op3: doc_id, n_bytes, n_removed, n_spans, kept_sha256, then passage_words, how many words lie in
    repeated passages, and in_passage, whether any do; and the bytes left if asked for."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_folder(spark, "substring-dedup")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text"))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), *([text.cast("binary").alias("whole")] if with_text else []))
    copies = slim.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("th")).filter("n > 1").select("sha", "th", F.lit(True).alias("copied"))
    ranges = repeated_ranges(texts, BYTES, f"{folder}/bytes")
    partly = written(ranges.join(copies, "th", "left_anti"), f"{folder}/partly")
    passages = repeated_ranges(texts, WORDS, f"{folder}/words").select("th", _covered(WORDS).alias("passage_words"))
    rest = _texts_of(texts, partly).select("th", "text", "repeated").mapInArrow(
        partial(_remove, with_text=with_text), REST + (", kept binary" if with_text else ""))
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= BYTES.depth)
    none = F.lit(0).cast("long")
    in_words = F.when(F.coalesce("copied", F.lit(False)) & (F.col("n_words") >= WORDS.depth), F.col("n_words")).otherwise(F.coalesce("passage_words", none))
    return (slim.join(copies.select("sha", "copied"), "sha", "left").join(rest, "th", "left").join(passages, "th", "left").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", none)).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        in_words.alias("passage_words"), (in_words > 0).alias("in_passage"),
        *([F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", "whole")).alias("kept")] if with_text else [])))
