"""Hashing of words, shingles and windows of many texts at once, in numpy inside tasks.

Texts lie end to end in one array. A window's hash is the difference of two running sums, moved to a common
origin, so that any number of windows is hashed in a few passes over arrays. There are two kinds: Rolling,
modulo 2**64, is fast and only deals windows to buckets, as crafted texts can make it collide; Exact,
modulo the prime 2**61 - 1, is what tells windows apart. A word begins where its hash begins, so its bytes
are mixed with their place in it and summed up. Long inputs are hashed in pieces.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
RATIO = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finalizer of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


TABLE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
#: A Mersenne prime, so that a product is reduced by shifts; and two numbers below it whose powers tell places apart.
PRIME = (1 << 61) - 1
BASES = (0x0DE3B1C95A7F2E4B, 0x15F09C6D2B8E4A37)
_powers: dict = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """RATIO**i, or its inverse's, modulo 2**64 for i < n; kept for the next call."""
    name = "inverse" if inverse else "plain"
    if len(_powers.get(name, ())) < n:
        base = pow(RATIO, -1, 1 << 64) if inverse else RATIO
        steps = np.full(max(n, PIECE + 65536), base, dtype=U)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def product(a: np.ndarray, b) -> np.ndarray:
    """a * b modulo PRIME of numbers below it, by halves of 31 bits."""
    b = np.asarray(b, dtype=U)
    half = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & half, b >> U(31), b & half
    middle = a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << U(1)) + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << U(31)) + a0 * b0)


def prime_powers(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i < n, by doubling; kept for the next call."""
    if len(_powers.get(base, ())) < n:
        found, most = np.ones(1, dtype=U), max(n, PIECE + 65536)
        while len(found) < most:
            found = np.concatenate((found, product(found, pow(base, len(found), PRIME))))
        _powers[base] = found
    return _powers[base][:n]


class Rolling:
    """Window hashes modulo 2**64 of 64-bit tokens: for buckets, not for equality."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, dtype=U)
        np.cumsum(values * powers(len(values)), out=self.sums[1:])

    def windows(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * powers(len(self.sums), inverse=True)[starts])


class Exact:
    """Window hashes modulo PRIME of tokens (bytes, or 64-bit hashes of words), with one of the BASES.

    Powers are split in halves of 32 bits, so that running sums of up to 2**23 tokens stay whole numbers
    below 2**64 and only the windows that are asked for are reduced.
    """

    def __init__(self, tokens: np.ndarray, which: int):
        self.inverse = pow(BASES[which], -1, PRIME)
        at = prime_powers(BASES[which], len(tokens))
        if tokens.dtype == np.uint8:
            tokens = tokens.astype(U) + U(1)
            high, low = tokens * (at >> U(32)), tokens * (at & U(0xFFFFFFFF))
        else:
            whole = product(_reduced(tokens), at)
            high, low = whole >> U(32), whole & U(0xFFFFFFFF)
        self.high, self.low = np.zeros(len(tokens) + 1, dtype=U), np.zeros(len(tokens) + 1, dtype=U)
        np.cumsum(high, out=self.high[1:])
        np.cumsum(low, out=self.low[1:])

    def windows(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        high, low = _reduced(self.high[ends] - self.high[starts]), self.low[ends] - self.low[starts]
        high = ((high << U(32)) & U(PRIME)) + (high >> U(29))  # times 2**32
        value = product(_reduced(_reduced(high) + _reduced(low)), prime_powers(self.inverse, len(self.high))[starts])
        return mix(value + mix((ends - starts).astype(U) + U(1)))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, end to end, and where each text begins (null: empty)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_binary()) if column.null_count else column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE):
    """Ranges of texts of at most so many bytes together; a longer text is alone."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def _piece_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word; a word also ends where a text begins (breaks)."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[breaks] = True
    edge[-1] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    if not len(starts):
        return starts, np.zeros(0, dtype=U)
    at = int(starts[0])
    place = np.arange(at, len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    sums = np.zeros(len(data) - at + 1, dtype=U)
    np.cumsum(mix((place.astype(U) << U(8)) + LOWER[data[at:]] + U(1)), out=sums[1:])
    return starts, mix(sums[ends - at] - sums[starts - at] + mix((ends - starts).astype(U)))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased), and how many words each text has."""
    found, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    for first, last in pieces(offsets):
        at, end = int(offsets[first]), int(offsets[last])
        if last == first + 1 and end - at > PIECE:
            while at < end:  # one long text: cut it behind a space
                to = min(end, at + PIECE)
                if to < end:
                    blank = np.flatnonzero(SPACE[data[at:to]])
                    while not len(blank) and to < end:
                        to = min(end, to + PIECE)
                        blank = np.flatnonzero(SPACE[data[at:to]])
                    to = at + int(blank[-1]) + 1 if len(blank) else end
                _, h = _piece_words(data[at:to], np.zeros(0, dtype=np.int64))
                found.append(h)
                counts[first] += len(h)
                at = to
        elif end > at:
            starts, h = _piece_words(data[at:end], offsets[first:last] - at)
            found.append(h)
            counts[first:last] = np.diff(np.searchsorted(starts, offsets[first : last + 1] - at))
    return (np.concatenate(found) if found else np.zeros(0, dtype=U)), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words and the text it is in; a shorter text is one shingle."""
    factors = mix(np.arange(1, size + 1, dtype=U)) | U(1)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes) - size + 1
    if n > 0:
        total = hashes[:n] * factors[0]
        for k in range(1, size):
            total += hashes[k : k + n] * factors[k]
        whole = owner[:n] == owner[size - 1 :]
        runs, of = mix(total[whole]), owner[:n][whole]
    else:
        runs, of = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), dtype=U)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] += hashes[(ends - counts)[short[has]] + k] * factors[k]
        extra = mix(extra + counts[short].astype(U) * U(0xA0761D6478BD642F))
        runs, of = np.concatenate((runs, extra)), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        runs, of = runs[order], of[order]
    return runs, of
