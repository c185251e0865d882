"""Small cases of requests and of repaired visits, written out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import repair
from tidemark.operators import requests as r
from tidemark.operators import windows as w
from tidemark.operators.query import Unsupported


def test_scope_horizon_and_buckets(spark):
    sites = spark.createDataFrame([(1, "America/New_York"), (2, "UTC")], "site_id long, timezone string")
    assert {x.site_id for x in r.sites_in_scope(sites).collect()} == {1, 2}
    assert [x.site_id for x in r.sites_in_scope(sites, "all", [2, 9]).collect()] == [2] and r.sites_in_scope(sites, 2, [2]).count() == 1
    for bad in ((3, None), (1, [2]), (2, [])):
        with pytest.raises(Unsupported):
            r.sites_in_scope(sites, *bad)
    window = w.bounds(sites, ("2024-03-10", "2024-03-12"), 1_710_500_000_000)
    r.refuse_pruned(window, None)
    r.refuse_pruned(window, 1_709_999_000_000)  # 2024-03-09 in both zones
    with pytest.raises(Unsupported):
        r.refuse_pruned(window, 1_710_030_000_000)  # 2024-03-10 in UTC only
    assert [r.bucket_for(*a) for a in (("day", "a", "a"), ("day", "a", "b"), ("week", "a", "a"), (None, "a", "a"))] == ["hour", "day", "week", None]


def test_measures_typical_and_derived(spark):
    assert r.measures(["visits"])["visits"].kind == "sum" and r.measures(["visits"], ("path",))["visits"].kind == "distinct" and r.measures(["visits"], ("country",))["visits"].kind == "sum"
    days = spark.createDataFrame([("a", 2, 3.0, 4), ("b", 6, 1.0, 0), ("c", 0, None, 2)], "bucket string, visits long, views_per_visit double, visitors long")
    assert tuple(r.typical(days, ["visits", "visitors", "views_per_visit"]).first()) == (8 / 3, 2.0, 1.5)
    assert r.typical(days.limit(0), ["visits", "views_per_visit"]).first()["views_per_visit"] is None
    with pytest.raises(Unsupported):
        r.typical(days, ["avg_engagement"])
    own = spark.createDataFrame([(100.0, 300, 3), (None, 0, 0), (50.0, 50, 1)], "avg_engagement double, engaged_ms long, engaged_sessions long")
    assert r.typical(own, ["avg_engagement"]).first()[0] == r.typical(own.drop("engaged_ms"), ["avg_engagement"]).first()[0] == 87.5
    got = r.derived(days, "x", ("+", ("/", "visits", "visitors"), 1), "day").collect()
    assert [x.x for x in got] == [1.5, None, 1.0]
    with pytest.raises(Unsupported):
        r.derived(days, "x", ("/", "visits", "visitors"), "week")
    r.derived(days, "x", ("/", "visits", 2), "week")


def test_missing_views_move_and_visits_are_counted_again(spark):
    def row(i, visit, seq, ts, kind, path, domain=None, source=None):
        return (i, visit, seq, ts, kind, path, 1, "2024-01-01", 0, "site1.test", domain, source, "desktop", None, 0)

    rows = [row(1, "a", 1, 0, "pageview", "/x?p=1"), row(2, "a", 2, 5_000, "pageview", "/404"), row(3, "a", 3, 6_000, "ping", "/404"), row(4, "a", 4, 40_000, "pageview", "/y"),
            row(5, "b", 1, 0, "pageview", "/404", "news.test", "campaign"), row(6, "b", 2, 10, "event", "/404"), row(7, "c", 1, 0, "pageview", "/z"), row(8, "c", 2, 10, "pageview", None),
            row(9, "d", 1, 9_000_000, "pageview", "/404"), row(10, "e", 1, 0, "outlink", "/q"), row(11, "e", 2, 10, "pageview", "/404")]
    df = spark.createDataFrame(rows, "hit_id long, session_id string, seq int, ts long, type string, path string, site_id long, local_date string, local_hour int, hostname string, ref_domain string, ref_type string, device_type string, country string, engaged_step long")
    stay, moved = repair.move_missing(df, F.col("path") == "/404", 9_500_000)
    assert stay.columns == df.columns
    assert {(x.hit_id, x.engaged_step) for x in stay.collect()} == {(1, 0), (4, 20_000), (7, 0), (8, 0), (9, 0)}  # e has no page view left, d is still open
    assert {(x.hit_id, x.ref_type, x.ref_domain, x.ref_path) for x in moved.collect()} == {(2, "internal", "site1.test", "/x"), (5, "referral", "news.test", None), (11, "direct", None, None)}
    assert [t.count() for t in repair.move_missing(df.limit(0), F.col("path") == "/404", 0)] == [0, 0]


def test_visit_marginals_of_nulls(spark):
    visits = spark.createDataFrame([(1, "d", None, 1, 0, 5), (1, "d", "", 2, 0, 0), (1, "d", None, 1, 0, 20_000)], "site_id long, local_date string, country string, pageviews long, events long, engaged_ms long")
    got = {(x.dim, x.value): tuple(x)[4:] for x in r.session_day_marginals(visits, ("country",)).collect()}
    assert got == {("total", None): (3, 2, 20_005, 1, 4), ("country", None): (2, 2, 20_005, 1, 2), ("country", ""): (1, 0, 0, 0, 2)}
