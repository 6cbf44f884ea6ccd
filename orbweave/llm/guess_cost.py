"""How hard a string is to guess: its cheapest segmentation, by dynamic programming, in bits.

A guesser is taken to know the kinds of segments below and to try cheap ones first. A segment costs
KIND bits (which of the five kinds it is) and
- a word of the dictionary (3 letters and more): log2 of its rank, a bit for a capital or for capitals
  throughout, a bit a letter for other mixtures, a bit for each letter written as a digit or sign;
- a date: log2 of the days, or years, that it may be;
- a repeat of a unit of up to UNIT characters, all copies that end there: the unit's own cost and log2 of
  their number;
- a walk of three and more neighbouring keys: the first key, then for each step a bit to go on and
  log2 of the directions where it turns;
- a brute-force span: log2 of its alphabet (the classes of characters that occur in it) a character.

Time is linear in the length: spans of any length are states that a step extends, not pairs of ends.
"""

from __future__ import annotations

import datetime
import json
import re
from functools import lru_cache
from math import inf, log2

KIND = log2(5)
UNIT = 16
LONGEST_WORD = 20
FIRST_YEAR, YEARS = 1900, 200
DAYS = 366

#: Letters that are often written as other characters. Fixed values.
LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t"})
#: A keyboard's rows, each half a key to the right of the one above; plain and with shift. Fixed values.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = ("!@#$%^&*()_+", "QWERTYUIOP{}", 'ASDFGHJKL:"', "ZXCVBNM<>?")
PLACE = {key: (2 * x + y, y) for rows in (ROWS, SHIFTED) for y, row in enumerate(rows) for x, key in enumerate(row)}
STEPS = {(2, 0), (-2, 0), (1, 1), (-1, 1), (1, -1), (-1, -1)}
FIRST_KEY, TURN = log2(len(PLACE)), log2(len(STEPS))

#: Sizes of the classes of characters: a-z, A-Z, 0-9, all others.
CLASSES = (26, 26, 10, 33)
SIZE = [log2(sum(n for k, n in enumerate(CLASSES) if mask >> k & 1) or 1) for mask in range(16)]
MASKS = [[m for m in range(16) if m >> k & 1] for k in range(4)]

DATE = re.compile(r"(?a)(?:(?P<y>\d{4})(?P<s>[-/._]?)(?P<m>\d\d)(?P=s)(?P<d>\d\d)|(?P<a>\d\d)(?P<t>[-/._]?)(?P<b>\d\d)(?P=t)(?P<z>\d{4}|\d\d))")


def character_class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def ranked_words(path: str) -> dict[str, int]:
    """Whole words of letters in a tokenizer's vocabulary (lower case, word ends marked), by rank from 1."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    words = [t.removesuffix("</w>") for t, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if t.endswith("</w>")]
    return {w: k for k, w in enumerate((w for w in words if 3 <= len(w) <= LONGEST_WORD and w.isascii() and w.isalpha()), 1)}


def _is_day(year: int, month: int, day: int) -> bool:
    try:
        datetime.date(year, month, day)
    except ValueError:
        return False
    return True


def date_bits(s: str) -> float:
    """Bits of a year, or of a day in one of the usual orders; infinite for anything else."""
    if len(s) == 4 and s.isascii() and s.isdigit():
        return log2(YEARS) if FIRST_YEAR <= int(s) < FIRST_YEAR + YEARS else inf
    if (found := DATE.fullmatch(s)) is None:
        return inf
    if found["y"]:
        tried, mark = [(found["y"], found["m"], found["d"])], found["s"]
    else:
        tried, mark = [(found["z"], found["a"], found["b"]), (found["z"], found["b"], found["a"])], found["t"]
        if len(found["z"]) == 2:
            tried.append((found["a"], found["b"], found["z"]))
    span = YEARS if any(len(y) == 4 for y, _, _ in tried) else 100
    first, last = (FIRST_YEAR, FIRST_YEAR + YEARS) if span == YEARS else (0, 100)
    good = any(first <= int(y) < last and _is_day(int(y) if len(y) == 4 else 2000 + int(y), int(m), int(d)) for y, m, d in tried)
    return log2(DAYS * span) + (2 if mark else 0) if good else inf


def word_bits(s: str, words: dict[str, int]) -> float:
    low = s.lower()
    plain = low.translate(LEET)
    rank = words.get(plain)
    if rank is None:
        return inf
    changed = sum(a != b for a, b in zip(low, plain, strict=True))
    upper, lower = sum(c.isupper() for c in s), sum(c.islower() for c in s)
    case = 0 if not upper else 1 if not lower or upper == 1 and s[0].isupper() else upper + lower
    return log2(rank) + case + changed


class GuessCost:
    """Costs over one dictionary; units of repeats are kept for the next call."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self._unit = lru_cache(maxsize=65536)(self._cost)

    def bits(self, s: str) -> float:
        """The cheapest segmentation's bits; 0 for the empty string."""
        return self._cost(s)

    def _cost(self, s: str) -> float:
        best = [0.0] + [inf] * len(s)
        brute, walk, short = [inf] * 16, inf, inf  # ends at i, in a span of that alphabet; in a walk; in a walk of two keys
        same, was = [0] * (UNIT + 1), None  # characters equal to the one a unit before; the last step on the keyboard
        for i, c in enumerate(s):
            begin = best[i] + KIND
            now = [inf] * 16
            for m in MASKS[character_class(c)]:
                now[m] = min(brute[m], begin) + SIZE[m]
            brute = now
            here = min(brute)
            step = _step(s[i - 1], c) if i else None
            if step is None:
                walk = short = inf
            else:
                turn = 1 + (TURN if step != was else 0)
                walk = min(walk, short) + turn
                short = best[i - 1] + KIND + FIRST_KEY + 1 + TURN
                here = min(here, walk)
            was = step
            for n in range(3, min(LONGEST_WORD, i + 1) + 1):
                here = min(here, best[i + 1 - n] + KIND + word_bits(s[i + 1 - n : i + 1], self.words))
            if c.isdigit():
                for n in (4, 6, 8, 10):
                    if n <= i + 1 and s[i + 1 - n].isdigit():
                        here = min(here, best[i + 1 - n] + KIND + date_bits(s[i + 1 - n : i + 1]))
            for u in range(1, min(UNIT, i) + 1):
                same[u] = same[u] + 1 if s[i - u] == c else 0
                copies = same[u] // u + 1
                if copies > 1:
                    start = i + 1 - copies * u
                    here = min(here, best[start] + KIND + self._unit(s[start : start + u]) + log2(copies))
            best[i + 1] = here
        return best[-1]


def _step(a: str, b: str):
    """The direction from one key to a neighbouring one, or None."""
    if a not in PLACE or b not in PLACE:
        return None
    step = (PLACE[b][0] - PLACE[a][0], PLACE[b][1] - PLACE[a][1])
    return step if step in STEPS else None
