"""The order in which hits are refused, agents, and what is stored of admitted hits: cases written out."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import admission as a
from tidemark.operators import intake

SCHEMA = "hit_id long, site string, ts long, type string, url string, referrer string, props string, ip string, user_agent string, tracker_id string, bag map<string,string>, event_category string, event_action string, event_value double, event_name string, target_url string, scroll_pct int, title string, lang string"
BROWSER = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0.0.0 Safari/537.36"
T = 1_700_000_000_000


def hit(n, site="1", kind="pageview", ip="10.0.0.1", agent=BROWSER, bag=None, props=None, tracker=None, url="https://a.test/x"):
    return (n, site, T + n * 1000, kind, url, None, props, ip, agent, tracker, bag, None, None, None, None, None, None, "t", "en")


@pytest.fixture(scope="module")
def tables(spark):
    sites = spark.createDataFrame([(1, "a.test", "UTC"), (2, "b.test", "Asia/Tokyo")], "site_id long, domain string, timezone string")
    salts = spark.createDataFrame([("UTC", "2023-11-01", "s"), ("Asia/Tokyo", "2023-11-01", "t")], "timezone string, local_date string, salt string")
    return sites, salts


def test_the_first_refusal_counts(spark, tables):
    rows = [
        hit(1), hit(2, site="A.TEST", bag={"plan": "pro"}), hit(3, site="nowhere.test", ip="10.9.0.1"), hit(4, site=None), hit(5, ip="10.9.0.1", agent="curl/8.6.0"), hit(6, agent="curl/8.6.0", bag={"Bad": "x"}),
        hit(7, props='{"missing": "/gone"}', bag={"Bad": "x"}), hit(8, kind="ping", ip="10.0.0.2", bag={"plan": "x"}), hit(9, kind="ping", bag={"plan": "x"}), hit(10, site="2", ip=None, agent=None, bag={"Bad": "x", "ok": "1"}),
    ]
    t = intake.take(spark.createDataFrame(rows, SCHEMA), *tables, rules=[(None, "10.9.0.0/16")])
    events = {r["hit_id"]: r for r in t.events.collect()}
    assert sorted(events) == [1, 2, 9, 10]  # 8 has no visit to go on with
    assert events[1]["session_id"] == events[2]["session_id"] == events[9]["session_id"] != events[10]["session_id"]
    assert [events[n]["props"] for n in (1, 2, 9, 10)] == [None, '{"plan":"pro"}', None, '{"ok":"1"}']
    assert (events[1]["browser"], events[1]["browser_version"], events[1]["os"], events[1]["device_type"], events[1]["lang"], events[1]["country"]) == ("Chrome", "126.0.0.0", "Windows", "desktop", "en", None)
    assert (events[10]["browser"], events[10]["device_type"], events[10]["local_date"]) == (None, "desktop", "2023-11-15")
    assert not {"ip", "user_agent", "tracker_id", "bag", "site"} & set(t.events.columns)
    assert [(r["hit_id"], r["path"]) for r in t.missing.collect()] == [(7, "/gone")]
    assert {(r["site_id"], r["refused"], r["n"]) for r in t.refused.collect()} == {(1, "excluded", 1), (1, "bot", 1)}
    assert {(r["site_id"], r["reason"], r["n"]) for r in t.props.collect()} == {(1, "on_ping", 2), (2, "bad_key", 1)}
    assert {(r["ref"], r["hits"], r["last_seen"]) for r in t.unknown.collect()} == {("nowhere.test", 1, T + 3000), ("", 1, T + 4000)}


def test_no_hits_give_empty_tables(spark, tables):
    t = intake.take(spark.createDataFrame([], SCHEMA), *tables)
    assert [x.count() for x in (t.events, t.missing, t.refused, t.props, t.unknown)] == [0] * 5


def test_extra_columns_of_made_names_are_made_anew(spark, tables):
    rows = spark.createDataFrame([hit(1)], SCHEMA).withColumns({c: F.lit("given") for c in ("country", "city", "browser", "visitor", "refused", "own_column")})
    got = intake.take(rows, *tables).events.first()
    assert (got["country"], got["city"], got["browser"], got["own_column"], len(got["visitor"])) == (None, None, "Chrome", "given", 16)


@pytest.mark.parametrize(("agent", "want"), [
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1", ("Mobile Safari", "17.1", "iOS", "mobile")),
    ("Mozilla/5.0 (iPad; CPU OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1", ("Mobile Safari", "17.1", "iOS", "tablet")),
    ("Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.4 Safari/605.1.15", ("Safari", "17.4", "Mac OS", "desktop")),
    ("Mozilla/5.0 (Linux; Android 14; SM-S918B) AppleWebKit/537.36 (KHTML, like Gecko) SamsungBrowser/25.0 Chrome/121.0.0.0 Mobile Safari/537.36", ("Samsung Internet", "25.0", "Android", "mobile")),
    ("Mozilla/5.0 (Linux; Android 13; SM-X900) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/121.0.0.0 Safari/537.36", ("Chrome", "121.0.0.0", "Android", "tablet")),
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36 Edg/120.0.2210.91", ("Edge", "120.0.2210.91", "Windows", "desktop")),
    ("Mozilla/5.0 (SMART-TV; Linux; Tizen 7.0) AppleWebKit/537.36 (KHTML, like Gecko) SamsungBrowser/5.0 Chrome/94.0 TV Safari/537.36", ("Samsung Internet", "5.0", "Tizen", "other")),
    ("Mozilla/5.0 (X11; CrOS x86_64 14541.0.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/121.0.0.0 Safari/537.36", ("Chrome", "121.0.0.0", "Chromium OS", "desktop")),
    ("", (None, None, None, "desktop")), (None, (None, None, None, "desktop")),
])
def test_agents(spark, agent, want):
    row = spark.createDataFrame([(agent,)], "ua string").select(*[c.alias(n) for n, c in a.agent_columns(F.col("ua")).items()], a.crawler(F.col("ua")).alias("bot")).first()
    assert (row["browser"], row["browser_version"], row["os"], row["device_type"]) == want and not row["bot"]


def test_crawlers(spark):
    agents = ["Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)", "curl/8.6.0", "python-requests/2.31", "Mozilla/5.0 HeadlessChrome/120.0", "facebookexternalhit/1.1"]
    rows = spark.createDataFrame([(x,) for x in agents], "ua string")
    assert rows.filter(a.crawler(F.col("ua"))).count() == len(agents)
    assert rows.filter(a.crawler(F.col("ua"), "nothing")).count() == 0


def test_limits_of_properties_know_earlier_batches(spark):
    schema = "hit_id long, site_id long, ts long, key string, value string"
    first = [(1, 1, 10, "a", "x"), (2, 1, 11, "b", "y"), (3, 1, 12, "a", "z"), (4, 2, 1, "c", "x")]
    later = [(5, 1, 20, "c", "x"), (6, 1, 21, "a", "new"), (7, 1, 22, "a", "z"), (8, 2, 23, "a", "x"), (9, 1, 24, "b", "v")]
    frames = [spark.createDataFrame(x, schema) for x in (first, later, first + later)]
    known = a.first_values(frames[0])
    rows = lambda df: {(r["hit_id"], r["key"], r["value"]) for r in df.collect()}
    got = rows(a.limited_props(frames[1], 2, 2, known))
    assert got == {(6, "a", "(other)"), (7, "a", "z"), (8, "a", "x"), (9, "b", "v")}
    assert got == {x for x in rows(a.limited_props(frames[2], 2, 2)) if x[0] > 4}
    assert {tuple(r) for r in a.first_values(frames[1], known).collect()} == {tuple(r) for r in a.first_values(frames[2]).collect()}
