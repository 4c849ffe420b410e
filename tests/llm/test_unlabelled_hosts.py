"""Hosts without outcomes take the posterior of their domain, suffix or the root."""

from __future__ import annotations

from mapquarry.llm import urlrep


def test_unlabelled_hosts_are_judged_by_the_levels_above(spark):
    rows = [(f"http://h{h}.bad.test/{i}", 1) for h in range(4) for i in range(40)]
    rows += [(f"http://h{h}.good.test/{i}", 0) for h in range(4) for i in range(40)]
    rows += [(f"http://h{h}.bad.evil/{i}", 1) for h in range(4) for i in range(40)]
    outcomes = spark.createDataFrame(rows, "url string, bad int")
    pages = spark.createDataFrame([(1, "http://new.bad.test/"), (2, "http://new.good.test/"), (3, "http://a.b.evil/"), (4, "http://h0.bad.test/"), (5, "http://x.y.zz/")], "page_id long, url string")
    got = {r.page_id: r for r in urlrep.filter_urls(pages, outcomes, rules=()).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["block", "allow", "block", "block"]
    assert got[5].bad_rate == (320 + 1) / (480 + 2) and got[5].bound < got[5].bad_rate
    none = urlrep.filter_urls(pages, outcomes.limit(0), rules=()).collect()
    assert len(none) == 5 and all(r.verdict == "allow" and r.bound is None for r in none)
