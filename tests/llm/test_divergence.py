"""The divergence audit against a plain version over all terms, with many small blocks and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from orbweave.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain(rows, top=200):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms_of(text)
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]
        v, whole = len(kept), sum((counts[lang, s] for s in sources), Counter())

        def ps(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + v) for t in kept}

        p, q = {s: ps(counts[lang, s]) for s in sources}, ps(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            parts = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s],
                     "term": [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def spark_rows(spark, rows, schema=SCHEMA, **options):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in dv.divergence(spark.createDataFrame(rows, schema), **options).collect())


def some(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k)}" for k in range(20)] + ["É", "é", "Der", "DER", "a b", "日本", " ", "x"]
    return [(rng.choice([k, 1, None]), " ".join(rng.choices(words, k=rng.randint(0, 30))).replace("wa wb", "wa,wb-wa"), rng.choice(["en", "de", None, "one"]), rng.choice(["s1", "s2", "s3", None]))
            for k in range(n)]


@pytest.mark.parametrize("block", [40, 16_000_000])
def test_small_blocks_and_one(spark, monkeypatch, block):
    monkeypatch.setattr(dv.postings, "__defaults__", (3, block))
    rows = some(block)
    assert spark_rows(spark, rows, top=5) == plain(rows, 5)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "alone"), (3, "1 2 3 ...", "fr", "a"), (4, "only once", "fr", "b"),  # a language without kept terms
            *[(5, "same same row", "xx", "s")] * 4, (6, "same " * 5000 + "x" * 100_000, "xx", "t"), (7, "\x00row\x7fROW[row]", "xx", "t")]
    assert spark_rows(spark, rows) == plain(rows)


def test_ties_and_other_columns(spark):
    rows = [(k, "b a é z", "en", s) for k in range(3) for s in ("s1", "s2")] + [(9, "b a é z q", "en", "s3")]
    assert spark_rows(spark, rows) == plain(rows)
    assert spark_rows(spark, [(*r, 1, "x") for r in rows], SCHEMA + ", term int, p0 string") == plain(rows)


def test_empty_table(spark):
    assert spark_rows(spark, []) == []
