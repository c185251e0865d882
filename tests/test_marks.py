"""Increments above watermarks: ids of 0 and below, rows without an id, ids that two rows share."""

from tidemark.sinks import facts
from tidemark.sources import demo, prior, warehouse

from .test_prior import EVENTS, VISITS, event, visit


def test_ids_of_zero_and_below_are_landed_once(spark, tmp_path):
    dims = spark.createDataFrame([(1, "UTC")], "site_id long, timezone string"), demo.aliases(spark)
    e = spark.createDataFrame([event(-3, "/a"), event(0, "/b"), event(5, "/c"), (None, *event(7, "/d")[1:])], EVENTS)
    s = spark.createDataFrame([visit(-2, 1, 0), visit(0, 1, 0), visit(4, 1, 0)], VISITS)
    store = facts.create(spark, str(tmp_path / "store"))
    assert prior.increment(store, 0, e, s, *dims, until=(-1, -2))
    assert prior.increment(store, 1, e, s, *dims, until=(0, 0)) and prior.increment(store, 2, e, s, *dims)
    assert not prior.increment(store, 3, e, s, *dims)
    assert sorted(r.path for r in facts.read(store, "events").collect()) == ["/a", "/b", "/c", "/d"]
    assert sorted(r.id for r in facts.read(store, "visits").collect()) == [-2, 0, 4]
    assert warehouse.watermarks(store) == {"events": 5, "visits": 4}


def test_rows_that_share_an_id_keep_their_own_actions(spark):
    rows = spark.createDataFrame([(1, 10, None), (1, 11, 10), (None, 11, None), (2, None, None)], "id long, a long, b long")
    actions = spark.createDataFrame([(10, 1, "x", 0), (11, 4, "y", 0)], "idaction long, type int, name string, url_prefix int")
    got = warehouse.with_actions(rows, "id", {"url": "a", "label": "b"}, actions).select("id", "url.name", "label.name").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "x", None), (1, "y", "x"), (None, "y", None), (2, None, None)], key=str)
