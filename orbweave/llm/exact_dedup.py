"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

The first pass hashes every text into a blocked Bloom filter that keeps only bits set more than once; it
shuffles (block, bit) pairs with their counts, never rows. Then the hashes, and nothing else, meet the
filter's blocks; those of which both bits are set may be repeated, and they make a second filter, as
small as they are few, which is broadcast. The second pass asks it about every row where it stands. A row
that it doesn't know has no equal and passes straight through; the others, which may be repeated, are the
only rows that shuffle to be grouped, by SHA-256 of the normalised text. That is so at every size: beyond
MAX_BITS the second filter only gets less sharp, so more rows are grouped in vain.

Defined results: texts are equal when identical after lower-casing A-Z only; null text
counts as empty; the row with the largest doc_id stays (null ids are smallest); of rows
that repeat id and text too, one stays; an empty table gives an empty result; columns of
any name pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.bloom import BLOCK, asked, build, filter_blocks
from orbweave.llm.common import ascii_lower, attach, cut

#: Bits of the second filter at most (64 MB): 33 million hashes that may be repeated at its full sharpness.
MAX_BITS = 1 << 29


def flag_repeats(rows: DataFrame, total: int) -> DataFrame:
    """Pass two: rows (with a long column h) with `maybe`, false where h surely occurs once."""
    hashes = cut(rows.select("h"))
    blocks = filter_blocks(total)
    again = cut(asked(hashes, "h", build(hashes, blocks, least=2), blocks, 0).filter("maybe").select("h").distinct())
    few = max(1, min(filter_blocks(again.count()), MAX_BITS // BLOCK))
    return asked(rows, "h", build(again, few), few, few * BLOCK)


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Of every row: doc_id, keep_id, group_size, kept, text_sha256."""
    text = ascii_lower(F.col("text"))
    slim = cut(docs.select(
        F.col("doc_id").cast("long"), F.unhex(F.sha2(text, 256)).alias("sha"), F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("rid"),
    ))
    total = slim.count()
    flagged = flag_repeats(slim, total)
    single = flagged.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha",
    )
    candidates = flagged.filter("maybe").select("doc_id", "sha", "rid")
    groups = cut(candidates.groupBy("sha").agg(
        F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size"),
    ))
    repeated = attach(candidates, groups, "sha", "group_size", total).select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"), "sha",
    )
    return single.unionByName(repeated).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; only possible repeats are grouped."""
    text = ascii_lower(F.col("text"))
    rows = docs.select(F.xxhash64(text).alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    flagged = flag_repeats(rows, docs.count())
    best = flagged.filter("maybe").groupBy(
        F.sha2(ascii_lower(F.col("row.text")), 256).alias("sha"),
    ).agg(F.max_by("row", F.struct(F.col("row.doc_id"), F.xxhash64("row"))).alias("row"))
    return flagged.filter(~F.col("maybe")).select("row.*").unionAll(best.select("row.*"))
