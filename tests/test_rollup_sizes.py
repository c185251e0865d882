"""Rollups of days shuffle groups only where a visitor's rows lie in one task."""

from pyspark.sql import functions as F

from tidemark.operators import rollups as r

from .test_sizes import count, made


def test_event_days_shuffle_groups_only(spark, sf, monkeypatch):
    events = made(spark, sf, monkeypatch, most=20)
    days = r.event_days(events, ("path", "country"))
    assert count(days, "Exchange") == count(events, "Exchange") + 1 and count(days, "Expand") == 0


def test_event_days_with_nulls(spark):
    rows = [(1, "d", "pageview", None, "s1", 1.0, "a"), (1, "d", "pageview", "v", None, 1.0, "a"), (1, "d", "event", "v", "s2", 2.5, "a"), (1, "d", "event", "v", "s3", None, None), (1, "d", "ping", "w", "s4", 9.0, "a")]
    e = spark.createDataFrame(rows, "site_id long, local_date string, type string, visitor string, session_id string, event_value double, path string")
    got = {(x.dim, x.value): (x.hits, x.actions, x.pageviews, x.events, x.value_sum, x.visitors, x.sessions) for x in r.event_days(e, ("path",)).collect()}
    assert got == {("total", None): (5, 4, 2, 2, 2.5, 1, 3), ("path", "a"): (4, 3, 2, 1, 2.5, 1, 2), ("path", None): (1, 1, 0, 1, 0.0, 1, 1)}
    assert r.event_days(e.filter(F.lit(False)), ("path",)).count() == 0
