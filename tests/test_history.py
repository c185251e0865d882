"""Small cases of history rewrites, saved segments and site cards."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history as h
from tidemark.operators import live
from tidemark.operators import query as q


def test_one_property_goes_and_other_text_stays(spark):
    bags = ['{"beta":true,"plan":"a,b"}', '{"plan":"x\\"beta\\":1}","beta":"q,}\\""}', '{"a":1,"beta":2.5,"c":null}', '{"beta":1}', '{"beta2":1}', None]
    rows = spark.createDataFrame([(n, 1, b) for n, b in enumerate(bags)] + [(9, 2, bags[0])], "n int, site_id long, props string")
    got = {r.n: r.props for r in h.without_prop(rows, 1, "beta").collect()}
    assert got == {0: '{"plan":"a,b"}', 1: '{"plan":"x\\"beta\\":1}"}', 2: '{"a":1,"c":null}', 3: None, 4: '{"beta2":1}', 5: None, 9: bags[0]}
    with pytest.raises(q.Unsupported):
        h.without_prop(rows, 1, "Bad key")


def test_mark_follows_rows_and_not_their_order(spark):
    mark = lambda *rows: h.table_mark(spark.createDataFrame(rows, "host string, canonical string")).first().mark
    assert mark(("a", "b"), ("c", None)) == mark(("c", None), ("a", "b"))
    assert mark(("a", "b")) != mark(("a", "c")) and mark(("a", "b")) != mark(("a", "b"), ("a", "b"))


def test_segments_do_not_nest():
    saved = {"a": {"dim": "country", "op": "eq", "value": "DE"}, "b": {"not": {"segment": "a"}}}
    assert q.with_segments({"any": [{"not": {"segment": "a"}}]}, saved) == {"any": [{"not": saved["a"]}]}
    for bad in ({"segment": "b"}, {"segment": "none"}):
        with pytest.raises(q.Unsupported):
            q.with_segments(bad, saved)


def test_cards_of_silent_and_new_sites(spark):
    sites = spark.createDataFrame([(1, "b.test"), (2, "a.test"), (3, "c.test")], "site_id long, domain string")
    rows = [(1, 7, "pageview", "2024-01-08"), (1, 7, "event", "2024-01-09"), (1, 8, "pageview", "2024-01-09"), (1, 7, "pageview", "2024-01-02"), (3, 9, "pageview", "2024-01-08"), (2, 5, "ping", "2024-01-08")]
    e = spark.createDataFrame(rows, "site_id long, visitor long, type string, local_date string")
    got = [tuple(r) for r in live.site_cards(e, sites, ("2024-01-08", "2024-01-09"), ("2024-01-01", "2024-01-07")).collect()]
    assert got == [(1, "b.test", 2, 100, False, "1,2"), (3, "c.test", 1, None, False, "1,0"), (2, "a.test", 0, None, True, "0,0")]


def test_old_rows_leave_the_registry_and_hours_come_back(spark):
    registry = spark.createDataFrame([("a", 5), ("b", 4)], "key string, last_seen long")
    assert [r.key for r in h.aged(registry, 5).collect()] == ["a"]
    visits = spark.createDataFrame([("x", 1), ("y", 1)], "session_id string, local_hour int")
    events = spark.createDataFrame([("x", 2, 9), ("x", 1, 8)], "session_id string, seq int, local_hour int")
    assert sorted((r.session_id, r.local_hour) for r in h.with_first_hour(visits, events).select("session_id", F.col("local_hour")).collect()) == [("x", 8), ("y", None)]
