"""Secret scans: three patterns, and values in the context of a credential that are costly to guess.

Base spans are the matches of the patterns below, leftmost and without overlap for each kind; a match
that is too short is dropped. Then values that stand in a wider context of credentials ("pwd:",
"passphrase is", "Authorization: Bearer") are judged by the guess-cost dynamic program of guess_cost.py:
those that cost LEAST_BITS and more are spans of kind `password`, unless a base assignment already covers
them. Where no sign but a word or blank stands between name and value, the value must also mix classes of
characters, as prose stands there too. Base assignments get their value's bits too, by which placeholders
can be told from secrets. Every document is scanned for itself, in one pass without a shuffle; the
dictionary is a tokenizer's vocabulary of fixed size, whose path is a parameter.

Defined results: null text is empty and has no spans; offsets are code points, ends exclusive; spans are
ordered by start, kind as listed, end; rows with equal ids are scanned each for itself; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import small_batches
from orbweave.llm.guess_cost import GuessCost, character_class, ranked_words

KINDS = ("assign", "access", "hex", "password")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")  # runs of 32 and more, from where they begin
NAME = r"pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_ -]?key|credentials?|auth(?:orization)?|bearer"
CONTEXT = re.compile(
    rf"""(?ai)(?<![a-z])(?:{NAME})["']?(?:(?P<sign>[\x20\t]*(?:=>|:=|==?|:)[\x20\t]*)(?:bearer[\x20\t]+)?|[\x20\t]+(?:is|was)[\x20\t]+|(?<=bearer)[\x20\t]+)["']?(?P<value>[^\s"'<>,;]{{8,}})""")
#: Every match of ASSIGN or CONTEXT has one of these in its text, in some case.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
LEAST_BITS = 40.0
SPAN = "struct<kind: string, start: long, end: long, bits: double>"


def default_words() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def scan(text: str, cost: GuessCost, least_bits: float = LEAST_BITS) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, bits) of one text."""
    spans, covered = [], []
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    if hinted:
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                spans.append(("assign", *m.span(), cost.bits(m[2])))
                covered.append(m.span())
    spans += [("access", *m.span(), None) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    if hinted:
        at = 0
        for m in CONTEXT.finditer(text):
            start, end = m.span("value")
            value = m["value"].rstrip(".:!?)")
            end = start + len(value)
            while at < len(covered) and covered[at][1] < end:
                at += 1
            if at < len(covered) and covered[at][0] <= start or len(value) < 8:
                continue
            if m["sign"] is None and len({character_class(c) for c in value}) < 2:
                continue
            if (bits := cost.bits(value)) >= least_bits:
                spans.append(("password", start, end, bits))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _scan_batches(batches: Iterator, words_path: str | None, least_bits: float) -> Iterator:
    import pyarrow as pa

    cost = GuessCost(ranked_words(words_path or default_words()))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))
    names = [f.name for f in kind.value_type]
    for batch in batches:
        found = [[dict(zip(names, span, strict=True)) for span in scan(text or "", cost, least_bits)] for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, type=kind)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, words_path: str | None = None, least_bits: float = LEAST_BITS) -> DataFrame:
    """doc_id and spans (kind, start, end, bits) of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_scan_batches, words_path=words_path, least_bits=least_bits), f"doc_id long, spans array<{SPAN}>")


def secret_digests(docs: DataFrame) -> DataFrame:
    """The columns of op12, and n_password (added spans) and assign_bits (whole bits of each assigned value)."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    count = lambda kind: F.size(of(kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs).select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(joined(of(*KINDS[:3])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform(of("assign"), lambda s: F.floor(s["bits"]).cast("string")), ",").alias("assign_bits"))
