"""Hosts without labelled pages are judged by their domain, suffix or all pages."""

from curvefx.llm import url_filter


def test_new_subdomain_of_a_bad_domain_is_blocked(spark):
    seen = [(f"http://h{i}.bad.com/{k}", 1) for i in range(8) for k in range(40)]
    seen += [(f"http://h{i}.good{i % 4}.com/{k}", 0) for i in range(40) for k in range(40)]
    outcomes = spark.createDataFrame(seen, "url string, bad int")
    pages = spark.createDataFrame([(u,) for u in ["http://new.bad.com/1", "http://h1.bad.com/1", "http://new.good1.com/1", "http://a.else.com/1", "http://a.else.net/1", "nowhere", None]], "url string")
    got = {r["url"]: (r["verdict"], r["low"]) for r in url_filter.judged(pages, outcomes, []).collect()}
    assert got["http://new.bad.com/1"][0] == got["http://h1.bad.com/1"][0] == "block"
    assert {got[u][0] for u in ("http://new.good1.com/1", "http://a.else.com/1", "http://a.else.net/1", "nowhere", None)} == {"allow"}
    assert all(got[u][1] is not None for u in got if u and "/" in u) and got[None][1] is None
