"""URL filters on captures of any month."""

import datetime

from orbweave.llm import url_filter


def test_captures_after_the_last_day_meet_open_entries(spark):
    log = spark.createDataFrame([("bad.com", "block", "add", datetime.date(2024, 1, 5))], "pattern string, list string, action string, day date")
    captures = spark.createDataFrame([(1, "http://bad.com/", datetime.date(2024, 1, 4)), (2, "http://bad.com/", datetime.date(2026, 3, 1)), (3, "http://bad.com/", None)], "page_id long, url string, day date")
    assert sorted((r.page_id, r.blocked) for r in url_filter.judge(captures, log).collect()) == [(1, False), (2, True), (3, False)]
    assert url_filter.judge(captures.limit(0), log).count() == 0
    assert not any(r.blocked for r in url_filter.judge(captures.filter("day is null"), log).collect())


def test_one_far_date_costs_one_row(spark):
    log = spark.createDataFrame([(f"h{k}.com", "block", "add", datetime.date(2024, 1, 5)) for k in range(50)] + [("h1.com", "block", "remove", datetime.date(2024, 2, 1)), ("h1.com", "allow", "add", datetime.date(2025, 1, 1))],
                                "pattern string, list string, action string, day date")
    captures = spark.createDataFrame([(k, f"http://www.h{k % 3}.com/{k}", datetime.date(9999, 12, 31) if k == 4 else datetime.date(2024, 1 + k % 3, 1)) for k in range(300)], "page_id long, url string, day date")
    asked = captures.select(url_filter.host_of(captures.url).alias("key"), "day").distinct()
    assert asked.count() == 4  # of 300 captures; a row for each host and day, however far
    got = {r.page_id: (r.rule_list, r.blocked) for r in url_filter.judge(captures, log).collect()}
    for k in range(300):
        day = datetime.date(9999, 12, 31) if k == 4 else datetime.date(2024, 1 + k % 3, 1)
        host, listed = k % 3, day >= datetime.date(2024, 1, 5)
        want = ("allow", False) if host == 1 and day.year == 9999 else (None, False) if not listed or host == 1 and day >= datetime.date(2024, 2, 1) else ("block", True)
        assert got[k] == want, k
