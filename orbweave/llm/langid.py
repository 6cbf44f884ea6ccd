"""Language ID: script ranges narrow candidates, then Viterbi over per-word scores labels spans.

The model is fitted from labelled rows: character n-grams of words, hashed, counted by language
(naive Bayes), and the languages that use each script. At most about SAMPLE documents of a language
are counted, chosen by a hash of their id. A word's score for a language is the sum of its n-grams'
log probabilities; languages that do not use the word's script are no candidates for it, and a word in a
script that no language uses is no evidence: its letters count for none. The labels of a text
maximise the sum of scores less a penalty for every switch of language. With few languages long texts are
solved in segments for every entry state at once, with many texts advance together; both give such labels.

Defined results: letters are the characters of Unicode's categories L; null text, and text without a letter,
is `und` with score 0; only letters in a script of the model's languages count, and a text with other letters
alone is the most frequent language (ties by name) with score 0; without any label every text is `und`
(keep_identified keeps all documents where no labelled row has a letter); the prediction is the language with
the most letters, ties by name; its score is
its share of the letters that count; repeated rows get equal predictions; rows with
a null id are neither held out nor learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import small_batches
from orbweave.llm.textops import U, mix

UND = "und"
SAMPLE = 3000
FEATURE_BITS, LONGEST = 16, 4
SWITCH = 25.0
SEGMENT = 128
#: A script belongs to a language that writes at least this share of its letters in it.
SCRIPT_SHARE = 0.005
#: Most labels that a model holds; more of them are an error, as each is a column of the model.
MOST_LANGUAGES = 4096
#: Up to so many languages long texts are labelled by segments, whose state is the square of that.
FEW_LANGUAGES = 16
#: Scores that a task keeps for words it has met, or holds while it scores new ones.
KEPT_SCORES = 800_000
#: What LETTERS finds besides letters: numbers such as ½ that are no decimals and in no category of letters (below U+10000; a class of characters beyond is slow).
NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if c.isalnum() and not c.isdecimal() and unicodedata.category(c)[0] != "L") + "]")
WIDE = re.compile("[\U00010000-\U0010FFFF]")
LETTERS = re.compile(r"[^\W\d_]+")
#: Last code point of each range, and its script.
SCRIPTS = (
    (0x24F, "latin"), (0x36F, "other"), (0x3FF, "greek"), (0x52F, "cyrillic"), (0x58F, "armenian"), (0x5FF, "hebrew"),
    (0x6FF, "arabic"), (0x8FF, "other"), (0x97F, "devanagari"), (0x9FF, "bengali"), (0xDFF, "other"), (0xE7F, "thai"),
    (0x10FF, "other"), (0x11FF, "hangul"), (0x1DFF, "other"), (0x1EFF, "latin"), (0x1FFF, "greek"), (0x303F, "other"),
    (0x30FF, "kana"), (0x33FF, "other"), (0x9FFF, "han"), (0xABFF, "other"), (0xD7AF, "hangul"), (0x10FFFF, "other"),
)
RANGE_ENDS = np.array([end for end, _ in SCRIPTS])
NAMES = sorted({name for _, name in SCRIPTS})
RANGE_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS])


@dataclass
class Model:
    """languages; log probability by (hashed n-gram, language); script use by (script, language); the most frequent language."""

    languages: list
    table: np.ndarray
    uses: np.ndarray
    frequent: int = 0


def letters_only(text: str | None) -> str:
    """The text with blanks for numbers that LETTERS would take for letters; places stay the same."""
    if text is None or text.isascii():
        return text or ""
    if NUMBERS.search(text):
        text = NUMBERS.sub(" ", text)
    return WIDE.sub(lambda m: m[0] if unicodedata.category(m[0])[0] == "L" else " ", text) if WIDE.search(text) else text


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points, each word between two spaces, end to end; and where words begin."""
    points = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), dtype=np.uint32)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    return points, np.concatenate(([0], np.cumsum(lengths + 2)))


def features(points: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n up to LONGEST: hashed n-grams that lie inside one word, and the word of each."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    spread = mix(points.astype(U) + U(1))
    found, total = [], np.zeros(len(points), dtype=U)
    for n in range(1, LONGEST + 1):
        total = total[: len(points) - n + 1] * U(0x9E3779B97F4A7C15) + spread[n - 1 :]
        inside = owner[: len(total)] == owner[n - 1 :]
        if n == 1:
            inside = inside & (points != 32)
        found.append(((mix(total[inside] + U(n)) >> U(64 - FEATURE_BITS)).astype(np.int64), owner[: len(total)][inside]))
    return found


def scripts(words: list[str]) -> np.ndarray:
    """Of each word, the script of its first letter."""
    return RANGE_SCRIPT[np.searchsorted(RANGE_ENDS, np.array([ord(w[0]) for w in words], dtype=np.int64))]


def _count_features(batches: Iterator, languages: list) -> Iterator:
    """Rows (lang, text) to (kind, lang, key, n): n-grams (kind 0) and letters by script (kind 1)."""
    import pyarrow as pa

    at = {name: i for i, name in enumerate(languages)}
    grams = np.zeros((len(languages), 1 << FEATURE_BITS), dtype=np.int64)
    letters = np.zeros((len(languages), len(NAMES)), dtype=np.int64)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = LETTERS.findall(letters_only(text).lower())
            if words:
                for keys, _ in features(*code_points(words)):
                    grams[at[lang]] += np.bincount(keys, minlength=1 << FEATURE_BITS)
                letters[at[lang]] += np.bincount(scripts(words), [len(w) for w in words], len(NAMES)).astype(np.int64)
    for kind, counts in enumerate((grams, letters)):
        lang, key = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"kind": np.full(len(lang), kind), "lang": lang, "key": key, "n": counts[lang, key]})


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (doc_id, text, lang); the driver gets counts of hashed n-grams only."""
    small_batches(labelled.sparkSession)
    rows = labelled.filter("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different labels; a language model needs the labels of languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << FEATURE_BITS, 0), dtype=np.float32), np.zeros((len(NAMES), 0), dtype=bool))
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, sample / sizes[name])))])[F.col("lang")]
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")
    counts = (chosen.mapInArrow(partial(_count_features, languages=languages), "kind long, lang long, key long, n long")
              .groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")).toPandas())
    table = np.zeros((1 << FEATURE_BITS, len(languages)))
    letters = np.zeros((len(NAMES), len(languages)))
    for kind, into in ((0, table), (1, letters)):
        part = counts[counts.kind == kind]
        into[part.key.to_numpy(), part.lang.to_numpy()] = part.n.to_numpy()
    table = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table)))
    return Model(languages, table.astype(np.float32), (letters > 0) & (letters >= SCRIPT_SHARE * letters.sum(axis=0)),
                 max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k)))


class Scorer:
    """Per-word scores, kept for the words met so far (started anew when there are too many)."""

    def __init__(self, model: Model):
        self.model, self.numbers = model, {}
        self.rows = np.zeros((0, len(model.languages)), dtype=np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        numbers, states = self.numbers, max(1, len(self.model.languages))
        if len(numbers) * states > KEPT_SCORES:
            numbers.clear()
            self.rows = self.rows[:0]
        new = [w for w in set(words) if w not in numbers]
        if new:
            new.sort()
            numbers.update(zip(new, range(len(numbers), len(numbers) + len(new)), strict=True))
            each = max(1, KEPT_SCORES // (8 * states))
            self.rows = np.concatenate((self.rows, *(self._score(new[k : k + each]) for k in range(0, len(new), each))))
        return self.rows[np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))]

    def _score(self, words: list[str]) -> np.ndarray:
        """Log probabilities below the best one; languages that don't write a word's script are no candidates for it."""
        total = np.zeros((len(words), len(self.model.languages)))
        for keys, of in features(*code_points(words)):
            gained = self.model.table[keys]
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(of, gained[:, k], len(words))
        used = self.model.uses[scripts(words)]
        evidence = used.any(axis=1)
        total[~used & evidence[:, None]] = -np.inf
        total[~evidence] = 0
        return (total - total.max(axis=1)[:, None]).astype(np.float32)


def _in_step(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """viterbi() with one state a text: all texts advance together, a word a step, longest first."""
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    begin = (np.cumsum(counts) - counts)[order]
    going = np.searchsorted(-counts[order], -np.arange(int(counts.max())), side="left")
    best, stays, sources = scores[begin].astype(np.float64), [], []
    for step in range(1, len(going)):
        live = going[step]
        top = best[:live].argmax(axis=1)
        come = best[np.arange(live), top][:, None] - penalty
        stays.append(best[:live] >= come)
        sources.append(top.astype(np.int32))
        best[:live] = np.maximum(best[:live], come) + scores[begin[:live] + step]
    labels, state = np.zeros(len(scores), dtype=np.int64), best.argmax(axis=1)
    for step in reversed(range(len(going))):
        live = going[step]
        labels[begin[:live] + step] = state[:live]
        if step:
            state[:live] = np.where(stays[step - 1][np.arange(live), state[:live]], state[:live], sources[step - 1])
    return labels


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best label of every word of texts that lie end to end; counts: words of each text.

    With few languages, texts are cut into segments that advance together, each from every state it may begin in;
    with many, whole texts do, with one vector of states each.
    """
    states = scores.shape[1]
    if states == 1 or not len(scores):
        return np.zeros(len(scores), dtype=np.int64)
    if states > FEW_LANGUAGES:
        return _in_step(scores, counts, penalty)
    per_text = -(-counts // SEGMENT)
    text = np.repeat(np.arange(len(counts)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = np.repeat(np.cumsum(counts) - counts, per_text) + number * SEGMENT
    length = np.minimum(SEGMENT, np.repeat(np.cumsum(counts), per_text) - begin)
    order = np.argsort(-length, kind="stable")  # at any step the segments that go on come first
    begin, length = begin[order], length[order]
    going = np.searchsorted(-length, -np.arange(int(length.max())), side="left")

    def advance(best: np.ndarray, step: int, live: int) -> tuple[np.ndarray, np.ndarray]:
        come = best[:live].max(axis=-1, keepdims=True) - penalty
        stay = best[:live] >= come
        gain = scores[begin[:live] + step]
        return np.where(stay, best[:live], come) + (gain[:, None, :] if best.ndim == 3 else gain), stay

    through = np.where(np.eye(states, dtype=bool), 0.0, -np.inf)[None].repeat(len(text), axis=0)  # (segment, entry, exit)
    for step, live in enumerate(going):
        through[:live], _ = advance(through, step, live)
    place = np.empty(len(text), dtype=np.int64)
    place[order] = np.arange(len(text))
    first = np.cumsum(per_text) - per_text
    value = np.zeros((len(counts), states))
    came = np.zeros((len(text), states), dtype=np.int64)
    for k in range(int(per_text.max())):
        own = np.flatnonzero(per_text > k)
        at = place[first[own] + k]
        step = value[own][:, :, None] + through[at]
        came[at], value[own] = step.argmax(axis=1), step.max(axis=1)
    leave, enter = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
    state = value.argmax(axis=1)
    for k in reversed(range(int(per_text.max()))):
        own = np.flatnonzero(per_text > k)
        at = place[first[own] + k]
        leave[at] = state[own]
        enter[at] = state[own] = came[at, state[own]]
    best = np.where(np.arange(states)[None] == enter[:, None], 0.0, -np.inf)
    stays = np.zeros((len(going), len(text), states), dtype=bool)
    source = np.zeros((len(going), len(text)), dtype=np.int32)
    for step, live in enumerate(going):
        source[step, :live] = best[:live].argmax(axis=-1)
        best[:live], stays[step, :live] = advance(best, step, live)
    labels = np.zeros(len(scores), dtype=np.int64)
    state = leave
    for step in reversed(range(len(going))):
        live = going[step]
        labels[begin[:live] + step] = state[:live]
        state[:live] = np.where(stays[step, np.arange(live), state[:live]], state[:live], source[step, :live])
    return labels


def label_texts(texts: list, scorer: Scorer):
    """How many words each text has, and the length that counts and the label of every word."""
    counts, flat = [], []
    for text in texts:
        found = LETTERS.findall(letters_only(text).lower())
        flat.extend(found)
        counts.append(len(found))
    counts = np.array(counts, dtype=np.int64)
    lengths = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    labels = np.zeros(0, dtype=np.int64)
    if flat:
        lengths = lengths * scorer.model.uses[scripts(flat)].any(axis=1)
        labels = viterbi(scorer(flat), counts)
    return counts, lengths, labels


def predict(texts: list, scorer: Scorer) -> tuple[list, np.ndarray]:
    """(language, share of letters) of each text: UND without letters, the most frequent language with share 0 where no letter counts."""
    languages = scorer.model.languages
    if not languages:
        return [UND] * len(texts), np.zeros(len(texts))
    counts, lengths, labels = label_texts(texts, scorer)
    owner = np.repeat(np.arange(len(texts)), counts)
    letters = np.bincount(owner * len(languages) + labels, lengths, len(texts) * len(languages)).reshape(len(texts), -1)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    names = [languages[b if t else scorer.model.frequent] if n else UND for b, t, n in zip(best, total, counts, strict=True)]
    return names, np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0)


def portions(texts: list, most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


def _predict_rows(batches: Iterator, model) -> Iterator:
    """Batches whose last column is the text: that column becomes (lang_pred, score)."""
    import pyarrow as pa

    scorer = Scorer(model.value)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        names, scores = [], []
        for a, b in portions(texts):
            found, shares = predict(texts[a:b], scorer)
            names += found
            scores += shares.tolist()
        columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])


def _keep_rows(batches: Iterator, model, at: int, least: float) -> Iterator:
    import pyarrow as pa

    scorer = Scorer(model.value)
    for batch in batches:
        texts = batch.column(at).to_pylist()
        keep = []
        for a, b in portions(texts):
            names, shares = predict(texts[a:b], scorer)
            keep += [name != UND and share >= least for name, share in zip(names, shares, strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_()))


def spans_of(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, language) of the maximal spans of a text; labels cover letters that count."""
    words = [(m.start(), m.end()) for m in LETTERS.finditer(letters_only(text))]
    if not words or not model.languages:
        return []
    lowered = [text[a:b].lower() for a, b in words]
    labels = viterbi(Scorer(model)(lowered), np.array([len(words)]))
    spans: list[tuple[int, int, str]] = []
    for (a, b), k, known in zip(words, labels, model.uses[scripts(lowered)].any(axis=1), strict=True):
        if not known:
            continue
        if spans and spans[-1][2] == model.languages[k]:
            spans[-1] = (spans[-1][0], b, spans[-1][2])
        else:
            spans.append((a, b, model.languages[k]))
    return spans


def held_out(doc_id):
    """Whether a document belongs to the fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def language_rows(docs: DataFrame) -> DataFrame:
    """The rows of op10: doc_id, held_out, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(~held_out(F.col("doc_id")))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(partial(_predict_rows, model=model), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows of docs in a language of the model: those without letters go, and those of which no
    language has the least share of letters. All columns stay. Without a labelled letter all documents stay."""
    fitted = fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    if not fitted.uses.any():
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    return docs.mapInArrow(partial(_keep_rows, model=model, at=docs.columns.index("text"), least=least), docs.schema)
