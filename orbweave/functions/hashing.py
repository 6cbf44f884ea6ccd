"""FNV-1a fingerprints.

Strings are hashed in Arrow batches, one vectorised step a byte position: as expressions of Spark, 64-bit
products overflow and the work is many times slower.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of FNV-1a with 64 bits.
BASIS, PRIME, MOST = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1
#: Strings that are hashed one by one once so few are left.
FEW = 8


def _fnv1a_arrays(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """FNV-1a 64 of byte strings that lie end to end, one step a byte position over all strings that are as long."""
    out = np.full(len(offsets) - 1, BASIS, dtype=np.uint64)
    order = np.argsort(offsets[:-1] - offsets[1:], kind="stable")  # longest first
    starts, lengths = offsets[:-1][order], np.diff(offsets)[order]
    state, prime = out[order], np.uint64(PRIME)
    at, active = 0, int(np.count_nonzero(lengths > 0))
    while active > FEW:
        state[:active] = (state[:active] ^ data[starts[:active] + at]) * prime
        at += 1
        active = int(np.searchsorted(-lengths[:active], -at, side="left"))
    for i in range(active):  # a few strings are far longer than the others
        h = int(state[i])
        for byte in data[starts[i] + at : starts[i] + lengths[i]].tobytes():
            h = (h ^ byte) * PRIME & MOST
        state[i] = h
    out[order] = state
    return out


@F.pandas_udf(StringType())
def fnv1a_hex(text: pd.Series) -> pd.Series:
    """FNV-1a 64 of a string's UTF-8 bytes, lower-case hex without leading zeros; null of null."""
    import pyarrow as pa

    column = pa.array(text, pa.string(), from_pandas=True)
    whole = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = whole.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    hashes = [f"{h:x}" for h in _fnv1a_arrays(data, offsets).tolist()]
    return pd.Series(hashes, dtype=object).where(text.notna().to_numpy(), None)


def content_fingerprint(text: Column, salt: str = "") -> Column:
    """Key of cached facts: hash of content and salt, and the content's length in bytes."""
    return F.concat(fnv1a_hex(F.concat(text, F.lit(salt))), F.lit("-"), F.octet_length(text).cast("string"))


def finding_fingerprint(*parts: Column) -> Column:
    """Key of a finding in a baseline: hash of its parts, joined by bars."""
    return fnv1a_hex(F.concat_ws("|", *[p.cast("string") for p in parts]))
