"""What trackers send and what is kept of it, in written cases."""

from pyspark.sql import functions as F

from tidemark.functions import web
from tidemark.operators import admission as a
from tidemark.operators import query as q
from tidemark.operators import shaping as s
from tidemark.operators import visits as v
from tidemark.operators import windows as w
from tidemark.sources import tracker


def test_kinds_of_requests(spark):
    base = "rec=1&idsite=1&url=https%3A%2F%2Fa.test%2Fx"
    cases = {
        "idsite=1&url=u": None, f"{base}&rec=0": "pageview", base: "pageview", f"{base}&ca=1": None, f"{base}&c_i=": None, f"{base}&c_n=x": None, f"{base}&idgoal=": None, f"{base}&ca=0": "pageview",
        f"{base}&ca=1&e_c=a&e_a=b": "event", f"{base}&c_i=click&link=l": "outlink", f"{base}&e_c=a": "pageview", "rec=1&idsite=1&action_name=Title": "pageview", "rec=1&idsite=1": None, f"{base}&ping=1&idgoal=2": "ping",
        f"{base}&e_c={'x' * 201}&e_a=b": "pageview", "rec=1&idsite=0&url=u": None, f"{base}&download=d&ping=1": "download",
    }
    log = spark.createDataFrame([(n, 0, t, None) for n, t in enumerate(cases)], "line long, received_at long, request string, body string")
    got = {r.line: r.type for r in tracker.from_requests(log).collect()}
    assert [got.get(n) for n in range(len(cases))] == list(cases.values())


def test_fields_of_requests(spark):
    long = "https://a.test/p?" + "&".join(f"k{n}={'v' * 40}" for n in range(60)) + "&utm_term=z#frag"
    text = f"/t?rec=1&idsite=2&url={long.replace('&', '%26').replace('#', '%23')}&_id=ABCDEF0123456789&res=1920x1080&lang=de&e_v=x"
    rows = [(0, 0, text, None), (1, 0, "?rec=1&idsite=1&url=a&_id=short&res=" + "9" * 21, None), (2, 0, "?rec=1&url=wrong", "idsite=3&url=right&rec=1")]
    got = {r.line: r for r in tracker.from_requests(spark.createDataFrame(rows, "line long, received_at long, request string, body string")).collect()}
    assert got[0].url.startswith("https://a.test/p?utm_term=z&k0=v") and len(got[0].url) <= web.URL_LENGTH and "#" not in got[0].url and got[0].url.endswith("v" * 40)
    assert (got[0].tracker_id, got[0].screen, got[0].lang) == ("abcdef0123456789", "1920x1080", "de")
    assert (got[1].tracker_id, got[1].screen, got[2].site_id, got[2].url) == (None, None, 3, "right")


def test_envelopes_degrade_field_by_field(spark):
    payload = '{"site": "Shop.Test", "hits": [{"type": "pageview", "url": "u", "title": "%s", "scroll": 55, "props": "{}"}, {"type": "ping", "scroll": 101}, {"type": "event", "category": "", "action": "b"}, {"type": "outlink"}]}' % ("t" * 513)
    sites = spark.createDataFrame([(4, ["shop.test", "x.test"]), (9, ["SHOP.test"])], "site_id long, domains array<string>")
    got = tracker.from_envelopes(spark.createDataFrame([(0, 0, payload)], "batch long, received_at long, payload string"))
    assert [(r.at, r.type, r.title, r.scroll_pct) for r in got.orderBy("at").collect()] == [(0, "pageview", None, 55), (1, "ping", None, None)]
    assert {r.site_id for r in v.named_sites(got.drop("site_id"), sites).collect()} == {4}
    named = v.named_sites(spark.createDataFrame([("4",), (" X.TEST ",), ("5",), (None,)], "site string"), sites)
    assert [r.site_id for r in named.collect()] == [4, 4]


def test_page_identity_and_attribution(spark):
    urls = ["https://a.test/p?utm_content=1&x=2&pk_any=3&piwik_kwd=4&Utm_Id=5", "https://a.test/?utm_source=%20Email%20&gclid=1", "https://a.test/?utm_source=%20&fbclid=1", "https://a.test/?gclid=&fbclid=1", "https://a.test/?UTM_SOURCE=x"]
    sites = spark.createDataFrame([(1, "a.test", "UTC")], "site_id long, domain string, timezone string")
    aliases = spark.createDataFrame([(0, "utm_source", "email", "all"), (1, "utm_source", "email", "newsletter"), (0, "utm_source", "facebook", "fb")], "site_id long, field string, alias string, canonical string")
    hits = spark.createDataFrame([(n, 1, 0, u, None) for n, u in enumerate(urls)], "hit_id long, site_id long, ts long, url string, referrer string")
    got = {r.hit_id: r for r in v.enrich(hits, sites, aliases).collect()}
    assert got[0].path == "/p?x=2&Utm_Id=5" and got[0].ref_type == "direct"
    assert (got[1].utm_source, got[1].utm_source_raw, got[1].utm_medium, got[1].ref_type) == ("newsletter", " Email ", None, "campaign")
    assert (got[2].utm_source, got[2].utm_source_raw, got[2].utm_medium, got[2].ref_type) == (None, " ", None, "campaign")  # blank text is a campaign value all the same
    assert (got[3].utm_source, got[3].utm_source_raw, got[3].utm_medium) == ("fb", None, "social")
    assert (got[4].path, got[4].ref_type) == ("/?UTM_SOURCE=x", "direct")


def test_missing_pages(spark):
    props = ['{"missing":"/gone?x=1"}', '{"missing":true}', '{"missing":false}', '{"missing":""}', '{"missing":7}', '{"missing":0}', '{"other":"\\\\"missing\\\\":1"}', None, '{"missing":"%s"}' % ("p" * 250)]
    rows = spark.createDataFrame([(n, "pageview", p) for n, p in enumerate(props)] + [(99, "event", props[0])], "n int, type string, props string")
    flags = {r.n: r.f for r in rows.select("n", v.missing_page(F.col("type"), F.col("props")).alias("f")).collect()}
    assert [n for n, f in sorted(flags.items()) if f] == [0, 1, 4, 8]
    full = rows.withColumns({"hit_id": F.col("n"), "site_id": F.lit(1), "ts": F.lit(0), "local_date": F.lit("d"), "local_hour": F.lit(0), "ref_kind": F.lit("referral"), "ref_domain": F.lit("x.test"), "ref_path": F.lit("/l"), "device_type": F.lit("d"), "country": F.lit(None).cast("string"), "not_found": v.missing_page(F.col("type"), F.col("props"))})
    got = {r.hit_id: r for r in v.not_found(full).collect()}
    assert (got[0].path, got[1].path, got[4].path, len(got[8].path), got[0].ref_path, got[0].ref_type) == ("/gone?x=1", None, None, 200, "/l", "referral")


def test_address_shapes_and_heavy_bags(spark):
    texts = {"10:30": False, "::ffff:1.2.3.4": True, "1.2.3.4": True, "999.1.1.1": True, "a:b:c": True, "g:1:2": False, "12:30:45": True, "x 1.2.3.4": False}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", a.address_shaped(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == texts
    bag = {f"k{n}": "v" * 199 for n in range(6)}
    rows = spark.createDataFrame([(1, 1, 0, "d", "pageview", bag), (2, 1, 0, "d", "pageview", {f"k{n:02}": "v" for n in range(12)}), (3, 1, 0, "d", "ping", {"a": "b"}), (4, 1, 0, "d", "pageview", None)], "hit_id long, site_id long, ts long, local_date string, type string, bag map<string,string>")
    assert {r.hit_id for r in a.admitted_props(rows).collect()} == {2} and a.admitted_props(rows).count() == 10
    assert {(r.reason, r.n) for r in a.prop_drops(rows).collect()} == {("oversize", 2), ("on_ping", 1)}


def test_alerts_either_way(spark):
    measured = spark.createDataFrame([(1, "visits", None, None, 50.0, 100.0), (1, "visits", "country", "DE", 3.0, 0.0), (2, "visits", None, None, None, 5.0)], "site_id long, metric string, dim string, value string, current double, previous double")
    rules = [(1, 1, "visits", None, None, "delta_pct", 20.0), (2, 1, "visits", "country", "DE", "above", 2.0), (3, 1, "visits", "country", "DE", "delta_pct", 1.0), (4, 2, "visits", None, None, "below", 1.0), (5, 2, "visits", None, None, "above", -1.0), (6, 1, "visits", None, None, "delta_pct", 51.0), (7, 3, "visits", None, None, "below", 1.0)]
    table = spark.createDataFrame(rules, "rule_id int, site_id long, metric string, dim string, value string, kind string, bound double")
    none = spark.createDataFrame([], "rule_id int, fired_at long")
    assert sorted(r.rule_id for r in s.alerts(measured, table, none, 0).collect()) == [1, 2, 4, 7]


def test_runs_folds_and_shares(spark):
    events = spark.createDataFrame([(1, 1, 1, 0, "pageview", "/a"), (2, 1, 1, 10_000, "pageview", "/b"), (3, 1, 1, 15_000, "pageview", "/c")], "hit_id long, site_id long, visitor long, ts long, type string, path string")
    assert [(r.path, r.page_ms) for r in s.feed_runs(events).orderBy("run").collect()] == [("/a", 10_000), ("/b", 5_000), ("/c", None)]
    edges = [(1, "/a", f"/t{n}", 20 - n) for n in range(10)] + [(1, "/a", "event: x · y", 1)]
    got = {(r["from"], r["to"]): r.sessions for r in s.journey_columns(spark.createDataFrame(edges, "step int, `from` string, `to` string, sessions long")).collect()}
    assert got["/a", "Other"] == 12 + 11 and got["/a", "event: x · y"] == 1 and len(got) == 10
    shares = lambda *rows: [(r.device_type, r.visits, r["rank"]) for r in s.folded_shares(spark.createDataFrame(rows, "device_type string, visits long"), "device_type", "visits").orderBy("rank").collect()]
    assert shares(("desktop", 5), ("mobile", 3), ("tablet", 2)) == [("desktop", 5, 1), ("mobile", 3, 2), ("tablet", 2, 3)]
    assert shares(("desktop", 5), ("mobile", 3), ("tablet", 2), ("other", 9), (None, 1)) == [("desktop", 5, 1), ("mobile", 3, 2), ("Other", 12, 3)]
    assert shares(("a", 4), ("b", 3), ("c", 2), ("d", 1)) == [("a", 4, 1), ("b", 3, 2), ("Other", 3, 3)] and shares(("other", 2)) == [("Other", 2, 1)] and shares() == []


def test_slices_and_bars_are_whole(spark):
    days = spark.range(1000).select(F.format_string("%04d", "id").alias("bucket"), F.lit(1).alias("n"), F.lit(2).alias("place"), (F.col("id") % 2).alias("visits"))
    assert [(r.slice, r.visits) for r in w.sliced(days, "bucket", "visits", 4).orderBy("slice").collect()] == [(k, 0.5) for k in range(4)]
    firsts = [r["first"] for r in w.sliced(days.limit(10), "bucket", "visits", 4).orderBy("slice").collect()]
    assert firsts == ["0000", "0002", "0005", "0007"]
    try:
        w.sliced(spark.range(1001).select(F.col("id").alias("bucket"), F.lit(1).alias("visits")), "bucket", "visits")
        raise AssertionError
    except q.Unsupported:
        pass
    names = spark.range(150).select(F.col("id").cast("string").alias("name"), F.col("id").alias("visits"))
    assert w.bars(names, F.col("name"), "visits").count() == 149 and w.bars(names, F.col("name"), "visits", 3).count() == 3


def test_dwell_takes_the_longest_median(spark):
    legs = spark.createDataFrame([("/often", 5), ("/often", 5), ("/often", 5), ("/long", 90), (None, 50)], "path string, ms long").withColumn("scroll", F.lit(None).cast("int"))
    assert [r.path for r in q.dwell(legs, limit=2).collect()] == ["/long", ""] and q.dwell(legs, path="").count() == 1
