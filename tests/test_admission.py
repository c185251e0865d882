"""Small cases of refusals, addresses, trackers and shaped results."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import admission as a
from tidemark.operators import rollups as r
from tidemark.operators import shaping as s
from tidemark.operators.query import Unsupported
from tidemark.sources import tracker


def test_addresses(spark):
    rows = spark.createDataFrame([("10.0.0.255",), ("2001:DB8::1",), ("::1",), ("1:2:3:4:5:6:7:8",), ("300.1.1.1",), ("hello",), (None,)], "ip string")
    got = [x[0] for x in rows.select(a.address_hex(F.col("ip"))).collect()]
    assert got == ["0" * 20 + "ffff0a0000ff", "20010db8" + "0" * 23 + "1", "0" * 31 + "1", "00010002000300040005000600070008", None, None, None]
    inside = rows.withColumn("site_id", F.lit(1)).select(a.excluded([(1, "10.0.0.0/8"), (2, "::/0"), (None, "2001:db8::/32")])).collect()
    assert [x[0] for x in inside] == [True, True, False, False, False, False, False]
    with pytest.raises(Unsupported):
        a.excluded([(None, "10.0.0.1")] * (a.MOST_RULES + 1))


def test_requests(spark):
    texts = ["?rec=1&idsite=1&url=https%3A%2F%2Fa.test%2Fx%23f&e_c=a&e_a=b&link=z", "?rec=1&idsite=1&url=u&idgoal=3", "?rec=1&url=u", "", None, "?rec=1&idsite=x&url=u", "?rec=1&idsite=2&url=a%zz&action_name=" + "t" * 513, "?rec=1&idsite=1&ping=1&e_c=a"]
    log = spark.createDataFrame([(i, 0, t, None) for i, t in enumerate(texts)], "line long, received_at long, request string, body string")
    got = {x["line"]: x for x in tracker.from_requests(log).collect()}
    assert sorted(got) == [0, 6, 7]
    assert (got[0]["type"], got[0]["url"], got[0]["target_url"]) == ("event", "https://a.test/x", None)
    assert (got[6]["url"], got[6]["title"], got[7]["type"]) == ("a%zz", None, "ping")
    bodies = spark.createDataFrame([(1, 0, "{"), (2, 0, '{"requests": ["?idsite=1&url=u"]}')], "batch long, received_at long, payload string")
    assert tracker.from_bulk(bodies).count() == 1


def test_hour_axis_around_clock_changes(spark):
    sites = spark.createDataFrame([(1, "America/New_York"), (2, "UTC")], "site_id long, timezone string")
    count = lambda d: {x["site_id"]: x["count"] for x in s.hour_axis(sites, d, d).groupBy("site_id").count().collect()}
    assert count("2024-03-10") == {1: 23, 2: 24}
    assert count("2024-11-03") == {1: 24, 2: 24}  # a repeated hour is one key


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([(3, 'a "b", c', ["x", "y"], None)], "n int, path string, steps array<string>, b string").coalesce(1)  # every part has a header
    s.write_csv(rows, str(tmp_path / "out"), ["path"], ["n"])
    text = "".join(p.read_bytes().decode() for p in (tmp_path / "out").glob("*.csv"))
    assert text.split("\r\n")[0] == "path,n,b,steps" and text.split("\r\n")[1] == '"a ""b"", c",3,,x > y'


def test_rollup_refusals():
    assert r.can_answer(["pageviews"], ("site_id",), "day") and not r.can_answer(["visitors"]) and not r.can_answer(["pageviews"], ("path",))
    with pytest.raises(Unsupported):
        r.bounces(None, 1)
