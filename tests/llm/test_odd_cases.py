"""Long texts, many languages, empty tables, nulls and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orbweave.llm import ngram_join, textops
from orbweave.llm.langid import viterbi
from orbweave.llm.mixing import mix_plan
from orbweave.llm.ngram_join import component_rows
from orbweave.llm.url_filter import dated_captures, derived_list, judge

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_viterbi(scores, penalty):
    best, came = scores[0].astype(float), []
    for row in scores[1:]:
        switch = best.max() - penalty
        stay = best >= switch
        came.append(np.where(stay, np.arange(len(best)), best.argmax()))
        best = np.where(stay, best, switch) + row
    path = [int(best.argmax())]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    return np.array(path[::-1]), best.max()


@pytest.mark.parametrize("states", [2, 5, 200])
def test_viterbi_over_segments(states):
    rng = np.random.default_rng(states)
    counts = np.array([3, 128, 129, 300, 0, 641])
    scores = rng.normal(size=(counts.sum(), states)) * 2
    labels, begin = viterbi(scores, counts, penalty=3.0), 0
    for n in counts[counts > 0]:
        own, got = scores[begin : begin + n], labels[begin : begin + n]
        begin += n
        value = own[np.arange(n), got].sum() - 3.0 * np.count_nonzero(np.diff(got))
        assert abs(value - plain_viterbi(own, 3.0)[1]) < 1e-6


def test_near_copies_of_texts_beyond_a_piece(spark, monkeypatch):
    monkeypatch.setattr(textops, "PIECE", 2000)
    monkeypatch.setattr(ngram_join, "pieces", lambda offsets: textops.pieces(offsets, 2000))
    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 900, 3000)]
    edited = [*words[:700], "new", *words[701:]]
    rows = [(5, " ".join(words)), (2, " ".join(edited)), (9, " ".join(words[:1400])), (1, "short text of a few words here")]
    got = {r.doc_id: r.component_id for r in component_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 2, 2: 2, 9: 9, 1: 1}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2), (2, None, None, 3, 4), (3, "c d e", "s", 5, 6)], "doc_id long, text string, source string, size long, target long")
    assert {r.doc_id: r.size for r in mix_plan(docs).collect()} == {1: 2, 2: 0, 3: 3}
    long_url = "http://h.example/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long_url, "<p>", "p"), (2, None, None, "q"), (3, "http://h.example/a", "", "r")], "page_id long, url string, html string, pattern string")
    plain = judge(dated_captures(pages.drop("pattern")), derived_list(pages.drop("pattern"))).collect()
    assert sorted(map(str, judge(dated_captures(pages), derived_list(pages)).collect())) == sorted(map(str, plain)) and len(plain) == 3


def test_stages_with_nulls_and_nothing(spark):
    rows = [(1, None, None, None, None), (None, "the cat sat on the mat and ran", "en", None, 3), (2, "", "en", "a", 0), (2, "the cat sat on the mat and ran", None, "a", 3), (3, "12 34", "fr", "b", 5)]
    for docs in (spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame([], DOCUMENTS)):
        docs = docs.withColumn("row", F.lit("clash"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * docs.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
