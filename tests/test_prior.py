"""Cases of healed rows, resumed imports and gates, written out."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.query import Unsupported
from tidemark.sinks import facts
from tidemark.sources import prior

EVENTS = "id long, site_id long, visitor long, ts long, local_date string, local_hour int, type string, session_id string, seq int, path string, ref_domain string, ref_type string, utm_source string, utm_medium string, utm_campaign string, extra string"
VISITS = "id long, session_id string, site_id long, visitor long, local_date string, started_at long, last_seen_at long, entry_path string, exit_path string, pageviews long, events long, engaged_ms long, ref_type string, utm_source string, utm_medium string, utm_campaign string"


@pytest.fixture(scope="module")
def dims(spark):
    sites = spark.createDataFrame([(1, "Asia/Tokyo"), (2, "+0530")], "site_id long, timezone string")
    aliases = spark.createDataFrame([(0, "utm_source", "google", "ads"), (2, "utm_campaign", "sale", "Sale 1")], "site_id long, field string, alias string, canonical string")
    return sites, aliases


def event(n, path, source=None, medium=None, campaign=None, site=1, kind="direct", type="pageview"):
    return (n, site, 7, 1_000 * n, "2024-01-10", 3, type, "s", n, path, None, kind, source, medium, campaign, "kept")


def test_paths_keep_what_is_not_tracking(spark):
    cases = {
        None: None, "": "", "/a": "/a", "/a?utm_source=x": "/a", "/a?b=1&utm_x=2&c": "/a?b=1&c", "/a?": "/a?", "/a?&&b": "/a?&&b", "/a?gclid=1&": "/a?", "/a?UTM_source=x": "/a?UTM_source=x",
        "/a?utm%5Fsource=x&q=%zz": "/a?q=%zz", "/a?x=1?utm_y=2": "/a?x=1?utm_y=2", "http://?utm_a=1": "http://?utm_a=1", "//:8?utm_a=1": "//:8?utm_a=1", "//h.test/p?utm_a=1": "//h.test/p", "a b?pk_c=1&z=é": "a b?z=é",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "path string, want string").withColumn("got", prior.clean_path(F.col("path")))
    assert {r.path: r.got for r in rows.collect()} == cases


def test_attribution_only_where_no_campaign_value_is(spark, dims):
    rows = [
        event(1, "/a?gclid=x"), event(2, "/a?gclid=x", campaign="Sale"), event(3, "/a?gclid=&msclkid=1&x=2", kind="search"), event(4, "/a?gclid="), event(5, None, source="  "), event(6, "http://?gclid=1"),
        event(7, "/b", source="GOOGLE", campaign="sale", site=2), event(8, "/b", source="ads", medium="cpc"), event(9, "c?fbclid=1#f"), event(9, "c?fbclid=1#f"),
    ]
    got = prior.healed_events(spark.createDataFrame(rows, EVENTS), dims[1])
    assert sorted(got.columns) == sorted([c.split()[0] for c in EVENTS.split(", ")] + ["utm_source_raw", "utm_medium_raw", "utm_campaign_raw", *prior.FLAGS])
    seen = [(r.id, r.path, r.ref_type, r.utm_source, r.utm_medium, r.utm_campaign, r.utm_source_raw, r.utm_campaign_raw, r.paths_cleaned, r.attributed, r.utm_normalized) for r in got.orderBy("id").collect()]
    assert seen == [
        (1, "/a", "campaign", "ads", "cpc", None, None, None, 1, True, False), (2, "/a", "direct", None, None, "sale", None, "Sale", 1, False, True), (3, "/a?x=2", "campaign", "bing", "cpc", None, None, None, 1, True, False),
        (4, "/a", "direct", None, None, None, None, None, 1, False, False), (5, None, "direct", None, None, None, "  ", None, 0, False, True), (6, "http://?gclid=1", "direct", None, None, None, None, None, 0, False, False),
        (7, "/b", "direct", "ads", None, "Sale 1", "GOOGLE", "sale", 0, False, True), (8, "/b", "direct", "ads", "cpc", None, None, None, 0, False, False),
        # what stands after # is cut off with the query string it follows
        (9, "c", "campaign", "facebook", "social", None, None, None, 1, True, False), (9, "c", "campaign", "facebook", "social", None, None, None, 1, True, False),
    ]


def visit(n, site, at, entry="/a", exit="/b?utm_x=1"):
    return (n, f"s{n}", site, 7, "2024-01-10", at, at, entry, exit, 1, 0, 5, "direct", None, None, None)


def test_hours_of_visits_in_their_zone(spark, dims):
    at = 1_704_844_800_000  # midnight, 10 January 2024 UTC
    got = prior.healed_visits(spark.createDataFrame([visit(1, 1, at), visit(2, 2, at, None, None), visit(3, 9, at, "/x?ttclid=1")], VISITS), *dims).orderBy("id").collect()
    assert [(r.local_hour, r.entry_path, r.exit_path, r.utm_source, r.paths_cleaned) for r in got] == [(9, "/a", "/b", None, 1), (5, None, None, None, 0), (0, "/x", "/b", "tiktok", 2)]


def test_an_import_goes_on_is_held_against_its_source_and_ends(spark, dims, tmp_path):
    e = spark.createDataFrame([event(n, f"/p{n % 2}?utm_a={n}") for n in range(1, 8)] + [event(8, None, type="ping")], EVENTS)
    s = spark.createDataFrame([visit(1, 1, 0), visit(2, 1, 0)], VISITS)
    store = facts.create(spark, str(tmp_path / "store"))
    assert prior.gate_faults(e.limit(0), s.limit(0), e.limit(0), s.limit(0)).isEmpty()
    assert not prior.increment(store, 0, e.limit(0), s.limit(0), *dims)
    assert prior.increment(store, 0, e, s, *dims, until=(5, 1)) and not prior.increment(store, 0, e, s, *dims)
    faults = {(r.gate, r.cell, r.measure): (r.source, r.target) for r in prior.finish(store, 1, e, s).collect()}
    assert faults[("rows", "events", "n")] == (8, 5) and faults[("pages", "/p1", "pageviews")] == (4, 3) and faults[("daily", "2024-01-10", "visits")] == (2, 1)
    assert prior.increment(store, 1, e, s, *dims) and not prior.increment(store, 2, e, s, *dims)
    assert prior.finish(store, 3, e, s).isEmpty()
    with pytest.raises(Unsupported):
        prior.increment(store, 4, e, s, *dims)
    assert prior.report(store).first().asDict() == {"events": 8, "visits": 2, "paths_cleaned": 9, "attributed": 0, "utm_normalized": 0}
