"""URL lists: domains of many labels."""

import datetime as dt

from spreadlab.llm import urllist


def test_parents_of_any_depth_match(spark):
    day = dt.datetime(2024, 1, 1)
    deep = ".".join(f"l{k}" for k in range(127))
    entries = [("g.com", day, "allow"), ("b.c.d.e.f.g.com", day, "block"), (deep.split(".", 1)[1], day, "block"), (deep.split(".", 60)[60], day, "allow")]
    hosts = {"a.b.c.d.e.f.g.com": "b.c.d.e.f.g.com", "b.c.d.e.f.g.com": "b.c.d.e.f.g.com", "xb.c.d.e.f.g.com": "g.com", deep: deep.split(".", 1)[1], "x." + deep.split(".", 30)[30]: deep.split(".", 60)[60], "com": None}
    captures = spark.createDataFrame([(i, f"http://{h}/", day) for i, h in enumerate(hosts)], "page_id long, url string, fetched_at timestamp_ntz")
    got = urllist.filter_urls(captures, spark.createDataFrame(entries, "domain string, effective_at timestamp_ntz, action string")).collect()
    assert {r.host: r.matched for r in got} == hosts
    assert {r.host: r.verdict for r in got}["a.b.c.d.e.f.g.com"] == "block"
