"""Innermost intervals by nested bins against all pairs, on nested, overlapping and odd spans."""

import random

import pytest

from orbweave.operators.intervals import innermost

POINTS, SPANS = "key string, name long, at int", "key string, span long, b int, e int"


def all_pairs(points, spans, apart):
    out = {}
    for key, name, at in points:
        inside = [(e - b, s) for k, s, b, e in spans if None not in (k, s, b, e, at) and k == key and b <= at <= e and not (apart and s == name)]
        if inside:
            out[name] = min(inside)[1]
    return out


def found(spark, points, spans, apart):
    got = innermost(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS), ["key"], "name", "at", "span", "b", "e", apart)
    return {r.name: r.span for r in got.collect()}


@pytest.mark.parametrize("apart", [False, True])
@pytest.mark.parametrize("width", [5, 300, 100_000])
def test_random_spans(spark, apart, width):
    rng = random.Random(width)
    spans = [("a" if rng.random() < 0.8 else "b", s, b := rng.randint(-width, width), b + rng.randint(-2, width)) for s in range(120)]
    points = [(rng.choice("aab"), n, rng.randint(-2 * width, 2 * width)) for n in range(200)]
    assert found(spark, points, spans, apart) == all_pairs(points, spans, apart)


def test_nested_spans_of_one_key(spark):
    spans = [("a", s, s, 4000 - s) for s in range(2000)]  # each inside the one before; the innermost of 500 is 500
    points = [("a", 10_000 + n, n) for n in range(0, 4001, 50)]
    assert found(spark, points, spans, False) == all_pairs(points, spans, False)


def test_odd_rows(spark):
    spans = [("a", 1, 0, 9), ("a", 2, 0, 9), ("a", None, 1, 2), (None, 3, 0, 9), ("a", 4, None, 9), ("a", 5, 7, 3), ("a", 6, 4, 4)]
    points = [("a", 1, 5), ("a", 7, 4), ("a", 8, None), (None, 9, 5), ("c", 10, 5), ("a", 11, 10)]
    for apart in (False, True):
        assert found(spark, points, spans, apart) == all_pairs(points, spans, apart)
    assert found(spark, points, [], False) == {} and found(spark, [], spans, False) == {}
