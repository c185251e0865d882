"""Small cases of windows, attribution and journeys, written out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import web
from tidemark.operators import query as q
from tidemark.operators import visits as v
from tidemark.operators import windows as w
from tidemark.operators.query import Unsupported


def test_rolling_day_over_clock_changes(spark):
    sites = spark.createDataFrame([(1, "America/New_York"), (2, "+0545"), (3, "No/Where")], "site_id long, timezone string")
    now = 1_710_074_096_789  # 2024-03-10 12:34:56.789 UTC, after New York's clocks went forward
    got = {r.site_id: r for r in w.bounds(sites, "24h", now).collect()}
    assert (got[1]["first"], got[1]["last"], got[1].to_ts) == ("2024-03-09", "2024-03-10", 1_710_075_600_000)
    assert got[2].to_ts == 1_710_076_500_000 and got[3].timezone == "UTC"
    before = {r.site_id: r for r in w.compared(w.bounds(sites, "24h", now)).collect()}
    assert (before[1].from_ts, before[1].to_ts) == (got[1].from_ts - w.DAY_MS, got[1].from_ts)
    week = w.compared(w.bounds(sites, "7d", now)).filter("site_id = 1").first()
    assert (week["first"], week["last"]) == ("2024-02-26", "2024-03-03")
    year = w.compared(w.bounds(sites, ("2024-02-29", "2024-03-01"), now), "year").first()
    assert (year["first"], year["last"]) == ("2023-03-01", "2023-03-01")
    rolled = w.compared(w.bounds(sites, "24h", now), "year").filter("site_id = 2").first()  # its last day lies in a leap year, after February
    assert (got[2].from_ts - rolled.from_ts, got[2].to_ts - rolled.to_ts, rolled["last"]) == (366 * w.DAY_MS, 366 * w.DAY_MS, "2023-03-10")
    for bad in (lambda: w.bounds(sites, "8d", now), lambda: w.compared(w.bounds(sites, "7d", now), "never")):
        with pytest.raises(Unsupported):
            bad()


def test_attribution_by_the_received_host(spark):
    sites = spark.createDataFrame([(1, ["docs.example.com"], "UTC"), (2, ["example.com"], "UTC")], "site_id long, domains array<string>, timezone string")
    cases = [
        (1, "https://docs.example.com/a", "https://docs.example.com/x", "internal", "example.com"), (1, "https://docs.example.com/a", "https://example.com/x", "referral", "example.com"),
        (2, "https://example.com/", "https://docs.example.com/x", "referral", "example.com"), (2, "https://example.com/", "https://shop.example.com/x", "internal", "example.com"),
        (2, "https://example.com/", "http://203.0.113.9/", "referral", "203.0.113.9"), (2, "https://example.com/", "https://news.google.com/", "search", "news.google.com"),
        (2, "https://example.com/", "https://www.google.co.uk/", "search", "google.co.uk"), (2, "https://example.com/", "https://youtu.be/x", "social", "youtube.com"),
        (2, "https://example.com/", "android-app://com.slack/", "referral", "slack.com"), (2, "https://example.com/", None, "direct", None), (2, "https://example.com/", "no url", "direct", None),
        (2, "https://example.com/?gbraid=1&mtm_src=z", "https://t.co/", "campaign", "twitter.com"), (2, "https://other.test/", "https://other.test/y", "internal", "other.test"),
    ]
    hits = spark.createDataFrame([(n, s, 0, u, r) for n, (s, u, r, _, _) in enumerate(cases)], "hit_id long, site_id long, ts long, url string, referrer string")
    got = {r.hit_id: r for r in v.enrich(hits, sites).collect()}
    assert [(got[n].ref_type, got[n].ref_domain) for n in range(len(cases))] == [(t, d) for *_, t, d in cases]
    assert (got[11].path, got[11].utm_source, got[11].utm_medium) == ("/", "z", None)
    assert got[3].ref_domain_raw == "shop.example.com" and got[3].ref_path == "/x" and got[4].ref_domain_raw is None and got[4].ref_path == "/" and got[10].ref_path is None


def test_outlinks_and_downloads_are_steps(spark):
    rows = [("s", 1, "pageview", "/a"), ("s", 2, "ping", "/a"), ("s", 3, "outlink", "/out"), ("s", 4, "pageview", "/a"), ("s", 5, "download", "/b"), ("s", 6, "pageview", "/b")]
    e = spark.createDataFrame([(*r, None, None) for r in rows], "session_id string, seq long, type string, path string, event_category string, event_action string")
    assert [(r.n, r.label) for r in q.steps(e).orderBy("n").collect()] == [(1, "/a"), (2, "/out"), (3, "/a"), (4, "/b")]


def test_cut_urls_keep_tracking_first(spark):
    df = spark.createDataFrame([("https://a.test/p?x=1&utm_source=s&y=2#f",), ("https://a.test/" + "p" * 60,), ("https://a.test/p?x=1",)], "url string")
    got = [r[0] for r in df.select(web.bounded(F.col("url"), 32)).collect()]
    assert got == ["https://a.test/p?utm_source=s&x=1"[:29], "https://a.test/" + "p" * 17, "https://a.test/p?x=1"]


def test_refusals(spark):
    many = {"any": [{"dim": "country", "op": "eq", "value": str(k)} for k in range(17)]}
    for bad in (lambda: q.predicate(many), lambda: w.site_goal(None, None, 1, {}, by="hour"), lambda: w.recombined(None, [], ["visitors"]), lambda: q.broken_paths(None, {"dim": "browser", "op": "eq", "value": "x"})):
        with pytest.raises(Unsupported):
            bad()
    notes = spark.createDataFrame([(None, "2024-01-02", "all"), (1, "2024-01-02", "one"), (2, "2024-02-02", "late")], "site_id long, local_date string, text string")
    sites = spark.createDataFrame([(1, "UTC"), (2, "UTC")], "site_id long, timezone string")
    got = sorted((r.of_site, r.text) for r in w.annotations_in(notes, w.bounds(sites, ("2024-01-01", "2024-01-03"), 0)).collect())
    assert got == [(1, "all"), (1, "one"), (2, "all")]
