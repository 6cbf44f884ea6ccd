"""What the divergence audit must not do to its postings, and counts that need more than 64 bits."""

import pytest
from pyspark.sql import functions as F

from orbweave.llm import divergence as dv


def test_postings_meet_no_table_of_all_terms(spark):
    """A term's count in its language comes with its postings: nothing is joined by term again."""
    rows = [(k, f"a b c{k % 3}", "en", f"s{k % 2}") for k in range(12)]
    df = dv.divergence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and "term#" in x]


@pytest.mark.parametrize("count", [0, 7, dv.FITS - 1, dv.FITS, dv.FITS + 1, 2**62])
def test_p_is_exact(spark, count):
    for n, v in ((count, 3), (2**62, 2**20), (5, 0)):
        found = spark.createDataFrame([(count, n, v)], "c long, n long, v long")
        if v and 1 + 10**9 * (count + 1) // (n + v) < 2**63:
            assert found.select(dv._p(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (count + 1) // (n + v)
