"""Blocked Bloom filters of long hashes as DataFrames of (block, bits), in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one block, a row of 4096 bytes.
BLOCK = 32768
BITS_PER_ROW = 16
#: Bits of the largest filter that says which texts are needed (64 MB, for a list of 33 million); it is sized by its list, and a longer one makes it less sharp.
NEED_BITS = 1 << 29


def filter_blocks(rows: int) -> int:
    """Blocks for so many rows, a power of two."""
    bits = BLOCK
    while bits < BITS_PER_ROW * rows:
        bits *= 2
    return bits // BLOCK


def probe_columns(h: Column, blocks: int) -> list[Column]:
    """A hash chooses a block and two bits in it."""
    return [
        F.pmod(h, F.lit(blocks)).alias("block"),
        F.shiftrightunsigned(h, 34).bitwiseAND(BLOCK - 1).alias("bit1"),
        F.shiftrightunsigned(h, 49).bitwiseAND(BLOCK - 1).alias("bit2"),
    ]


def build(hashes: DataFrame, blocks: int, least: int = 1) -> DataFrame:
    """(block, bits) of the bits that at least so many of hashes (column h) set."""
    bits = hashes.select(*probe_columns(F.col("h"), blocks)).select("block", F.explode(F.array("bit1", "bit2")).alias("bit"))
    often = bits.groupBy("block", "bit").count().filter(F.col("count") >= least)
    return often.groupBy("block").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))


def is_set(bit: str) -> Column:
    byte = F.expr(f"cast(conv(hex(substring(bits, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int)")
    return F.call_function("shiftright", byte, F.pmod(F.col(bit), F.lit(8)).cast("int")).bitwiseAND(1) == 1


def asked(rows: DataFrame, h: str, filtered: DataFrame, blocks: int, most_broadcast: int) -> DataFrame:
    """rows with `maybe`, false where the hash in column h is surely not in the filter.

    The filter is broadcast up to most_broadcast bits, else joined by block.
    """
    few = F.broadcast(filtered) if blocks * BLOCK <= most_broadcast else filtered
    return (
        rows.select("*", *probe_columns(F.col(h), blocks)).join(few, "block", "left")
        .withColumn("maybe", F.coalesce(is_set("bit1") & is_set("bit2"), F.lit(False)))
        .drop("block", "bit1", "bit2", "bits")
    )


def needed(docs: DataFrame, hashes: DataFrame, count: int) -> DataFrame:
    """The rows of docs whose th may be among hashes (column h, about so many); the others stay where they are."""
    blocks = min(filter_blocks(count), NEED_BITS // BLOCK)
    return asked(docs, "th", build(hashes, blocks), blocks, NEED_BITS).filter("maybe").drop("maybe")
