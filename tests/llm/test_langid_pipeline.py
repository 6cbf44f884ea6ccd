"""Language ID on held-out documents, and the pipeline on a small table."""

import itertools

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from orbweave.llm.langid import fit, language_rows, keep_identified, spans_of, viterbi

SF = "/root/testdata/sf0.001"


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(5)
    for counts in ([4], [1, 3, 0, 5]):
        scores = rng.normal(size=(sum(counts), 2)) * 3
        labels = viterbi(scores, np.array(counts), penalty=2.0)
        begin = 0
        for n in counts:
            own = scores[begin : begin + n]
            value = lambda path: sum(own[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
            best = max(value(p) for p in itertools.product(range(2), repeat=n))
            assert abs(value(labels[begin : begin + n]) - best) < 1e-9
            begin += n


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_rows(docs)
    judged = got.filter("held_out").join(docs.filter("lang is not null").select("doc_id", "lang"), "doc_id").filter("lang_pred <> 'und'")
    right, total = judged.select(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert got.count() == docs.count()
    assert total and right >= 0.9 * total


def test_spans_and_odd_rows(spark):
    one, two = "the quick brown fox jumps over the lazy dog and runs away", "der schnelle braune fuchs springt über den faulen hund und läuft weg"
    docs = spark.createDataFrame(
        [(i, t, lang, "s", 1, "clash") for i, (t, lang) in enumerate([(one, "aa"), (two, "bb")] * 20)] + [(90, None, "aa", "s", 0, ""), (91, "12 34", None, "s", 5, ""), (None, one, "bb", "s", 1, ""), (93, one * 3000, None, None, 1, "")],
        "doc_id long, text string, lang string, source string, n_chars long, score string")
    rows = {r.doc_id: r for r in language_rows(docs).collect()}
    assert (rows[90].lang_pred, rows[90].score, rows[91].lang_pred) == ("und", 0.0, "und")
    assert rows[93].lang_pred == "aa" and not rows[None].held_out
    model = fit(docs.filter("doc_id < 40"))
    assert [s[2] for s in spans_of(f"{one} {two}", model)] == ["aa", "bb"]
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and {90, 91}.isdisjoint(r.doc_id for r in kept.collect())
    assert language_rows(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_rows(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns, name
        if name == "exact_dedup":
            assert after.count() == docs.select(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).distinct().count()
        if name == "best_fit_packing":
            by = after.groupBy("sequence_id").agg(F.sum("length").alias("n"))
            assert by.filter("n > 1024").count() == 0
            assert after.filter("piece = 0").count() == docs.count()
        docs = after
