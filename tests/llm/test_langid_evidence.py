"""Language ID of texts without evidence, without labels, and with many languages."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from orbweave.llm.langid import NAMES, SCRIPTS, Model, Scorer, fit, keep_identified, language_rows, predict, spans_of, viterbi

ONE, TWO = "the quick brown fox jumps over the lazy dog and runs away", "der schnelle braune fuchs springt über den faulen hund und läuft weg"
GREEK = "και το καλοκαίρι πηγαίνουμε στη θάλασσα με τους φίλους"


def test_unseen_scripts_and_missing_labels(spark):
    docs = spark.createDataFrame(
        [(i, *pair) for i, pair in enumerate([(ONE, "aa"), (TWO, "bb")] * 20)] + [(90, GREEK, None), (91, f"{GREEK} {TWO}", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language_rows(docs).collect()}
    assert rows[90] == ("aa", 0.0) and rows[91] == ("bb", 1.0)
    assert 90 not in {r.doc_id for r in keep_identified(docs).collect()}
    model = fit(docs.filter("doc_id < 40"))
    assert spans_of(GREEK, model) == []
    assert spans_of(f"{GREEK} {TWO}", model) == [(len(GREEK) + 1, len(GREEK) + 1 + len(TWO), "bb")]
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert keep_identified(unlabelled).count() == docs.count()
    wordless = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(spark.range(200, 260).select(F.col("id").alias("doc_id"), F.lit("12").alias("text"), F.lit("aa").alias("lang")))
    assert {(r.doc_id < 200, r.lang_pred) for r in language_rows(wordless).collect()} == {(True, "aa"), (False, "und")} and keep_identified(wordless).count() == docs.count() + 60


def test_viterbi_with_many_languages():
    scores = np.full((4, 200), -100.0)
    scores[[0, 1], 150] = scores[[2, 3], 160] = 0
    assert viterbi(scores, np.array([4])).tolist() == [150, 150, 160, 160]


def test_letters_are_those_of_unicode(spark):
    docs = spark.createDataFrame(
        [(i, *pair) for i, pair in enumerate([(ONE, "aa"), (TWO, "bb"), (TWO, "bb")] * 20)]
        + [(90, "½ ² ³ Ⅷ ٣ 4 _ 🙂", None), (91, "語", None), (92, "½a", None), (93, "͏", None), (94, "ª", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language_rows(docs).collect()}
    assert rows[90] == rows[93] == ("und", 0.0)
    assert rows[91] == ("bb", 0.0)  # has a letter, and bb is the most frequent
    assert rows[92][0] in ("aa", "bb") and rows[92][1] == 1.0 and rows[94][0] in ("aa", "bb")


def _mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


M64 = (1 << 64) - 1


def _grams(word):
    points = [32, *map(ord, word), 32]
    for n in range(1, 5):
        for i in range(len(points) - n + 1):
            if n > 1 or points[i] != 32:
                total = 0
                for p in points[i : i + n]:
                    total = (total * 0x9E3779B97F4A7C15 + _mix(p + 1)) & M64
                yield _mix((total + n) & M64) >> 48


def _words(text):
    return regex.findall(r"\p{L}+", (text or "").lower())


def _script(word):
    return next(name for end, name in SCRIPTS if ord(word[0]) <= end)


def plain_rows(learned, asked):
    languages = sorted({lang for _, lang in learned if lang is not None})
    grams = {lang: Counter(g for text, own in learned if own == lang for w in _words(text) for g in _grams(w)) for lang in languages}
    written = {lang: Counter() for lang in languages}
    for text, lang in learned:
        for w in _words(text):
            written[lang][_script(w)] += len(w)
    uses = {lang: {s for s, n in written[lang].items() if n >= 0.005 * sum(written[lang].values())} for lang in languages}
    sizes = Counter(lang for _, lang in learned)
    out = []
    for text in asked:
        words = _words(text)
        scores, counts = [], []
        for w in words:
            able = [lang for lang in languages if _script(w) in uses[lang]]
            counts.append(len(w) if able else 0)
            found = [sum(math.log((grams[lang][g] + 0.5) / (sum(grams[lang].values()) + 0.5 * 65536)) for g in _grams(w)) if lang in able else -math.inf for lang in languages] if able else [0.0] * len(languages)
            scores.append([x - max(found) for x in found])
        if not words:
            out.append(("und", 0.0))
            continue
        best, back = list(scores[0]), []
        for row in scores[1:]:
            top = max(range(len(best)), key=lambda k: (best[k], -k))
            back.append([k if best[k] >= best[top] - 25.0 else top for k in range(len(best))])
            best = [max(b, best[top] - 25.0) + x for b, x in zip(best, row)]
        path = [max(range(len(best)), key=lambda k: (best[k], -k))]
        for b in reversed(back):
            path.append(b[path[-1]])
        letters = Counter()
        for k, n in zip(reversed(path), counts):
            letters[k] += n
        total = sum(counts)
        k = max(range(len(languages)), key=lambda k: (letters[k], -k))
        out.append((languages[k], letters[k] / total) if total else (max(languages, key=lambda x: (sizes[x], [-ord(c) for c in x])), 0.0))
    return out


@pytest.mark.parametrize("many", [False, True])
def test_rows_are_those_of_a_plain_version(spark, many):
    texts = [("the quick brown fox", "aa"), ("der schnelle fuchs über", "bb"), (GREEK, "gg"), ("le renard brun saute", "cc"), ("los perros corren", "dd")] * 3
    texts += [(f"zq{k} wv{chr(97 + k)}x {chr(97 + k) * 4} abc", f"m{k:02}") for k in range(20 * many)]
    asked = ["the fox über", f"{GREEK} the quick", "жук the", "½", None, "", "語 語", "renard " * 40 + "perros corren los " * 60, "zq3 wvcx cccc", "ὅτι the λόγος"]
    rows = [(k, t, lang) for k, (t, lang) in enumerate(texts)] + [(10_000 + k, t, None) for k, t in enumerate(asked)]
    learned = [(t, lang) for k, t, lang in rows if lang is not None and zlib.crc32(str(k).encode()) % 3 != 1]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for (k, t, _), (lang, score) in zip(rows, plain_rows(learned, [t for _, t, _ in rows])):
        assert got[k][0] == lang and got[k][1] == pytest.approx(score), (k, t)


def test_memory_with_many_languages():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(1 << 16, 200)).astype(np.float32)
    uses = np.ones((len(NAMES), 200), dtype=bool)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [" ".join("".join(rng.choice(letters, 6)) for _ in range(60)) for _ in range(1000)]
    scorer = Scorer(Model([f"l{k:03}" for k in range(200)], table, uses))
    tracemalloc.start()
    names, shares = predict(texts, scorer)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(names) == 1000 and peak < 300e6, peak
