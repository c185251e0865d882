"""Names of visitors and places, formulas, salts and active visitors: cases written out or by plain loops."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import query as q
from tidemark.operators import requests as r
from tidemark.operators import salts
from tidemark.operators.query import Unsupported
from tidemark.streaming import jobs

DAY = names.DAY_MS


def test_visitor_names(spark):
    assert len(names.ADJECTIVES) == len(names.ANIMALS) == 96
    assert all(a[0] == b[0] for a, b in zip(names.ADJECTIVES, names.ANIMALS, strict=True))
    rows = [(f"{n:016x}", n * 7919 * DAY // 50) for n in range(200)]
    got = spark.createDataFrame([*rows, (None, 1), ("00", None), ("not hex", 1)], "v string, ts long").select("v", "ts", *[c.alias(k) for k, c in names.visitor_name(F.col("v"), F.col("ts")).items()], names.visitor_ref(F.col("v"), "ab" * 16).alias("ref")).collect()
    for (v, ts), x in zip(rows, got, strict=False):
        d = hashlib.sha256(f"{ts // DAY}\n".encode() + bytes.fromhex(v)).digest()
        letter, a, b = d[0] % 24, d[1] % 4, d[2] % 4
        assert x["name"] == f"{names.ADJECTIVES[letter * 4 + a]} {names.ANIMALS[letter * 4 + b]}" and x["color"] == (letter * 16 + a * 4 + b) % 3
        assert x["ref"] == hashlib.sha256(bytes.fromhex("ab" * 16) + bytes.fromhex(v)).hexdigest()[:12]
    assert [x["name"] for x in got[200:]] == [None] * 3


def test_codes_without_a_name_show_as_they_are(spark):
    rows = spark.createDataFrame([("us",), ("XX",), (None,), ("",)], "country string")
    table = spark.createDataFrame([("US", "United States"), ("US", "America"), (None, "Nowhere")], "code string, name string")
    assert {(x["country"], x["shown"]) for x in names.with_names(rows, "country", table, "shown").collect()} == {("us", "America"), ("XX", "XX"), (None, None), ("", "")}


@pytest.mark.parametrize(("text", "tree"), [
    ("pageviews / visits", ("/", "pageviews", "visits")), ("1 + 2 * visits - 3", ("-", ("+", 1.0, ("*", 2.0, "visits")), 3.0)), ("((visits))", "visits"), (" 007.50*(events+ 1)", ("*", 7.5, ("+", "events", 1.0))),
    ("visits - events - 1", ("-", ("-", "visits", "events"), 1.0)),
])
def test_formulas(text, tree):
    assert r.formula(text) == tree


@pytest.mark.parametrize("text", ["", " ", "1 + 2", "visits +", "-visits", "+visits", "visits ** 2", "visits // 2", "visits(2)", "nothing", "1e3 + visits", "1_0 + visits", "1. + visits", ".5 + visits", "visits\n+ 1", "visits, events", "visits % 2", "max_ms", "visits.x", "a" * 201, "+".join(["visits"] * 9), "visits if 1 else 2", "not visits"])
def test_no_formulas(text):
    with pytest.raises(Unsupported):
        r.formula(text)


def test_metrics_of_a_formula():
    assert r.metrics_of(r.formula("(visits + events) / visits * 2")) == ["visits", "events"]
    assert r.formula("+".join(["visits"] * 8))  # eight metrics and seven signs


def test_salts_go_forward(spark):
    kept = [("UTC", "2024-01-30", "u0"), ("UTC", "2024-01-31", "u"), ("Asia/Tokyo", "2024-01-30", "t"), ("Europe/Rome", "2023-01-01", "r"), ("America/New_York", "2024-02-05", "n")]
    table = spark.createDataFrame(kept, "timezone string, local_date string, salt string")
    zones = spark.createDataFrame([("UTC",), ("Asia/Tokyo",), ("Asia/Tokyo",), ("America/New_York",), ("Asia/Kolkata",), (None,)], "timezone string")
    now = 1_706_670_000_000  # 2024-01-31 03:00 UTC
    got = {tuple(x) for x in salts.rotated(table, zones, now, F.lit("new")).collect()}
    assert got == {*kept[:2], kept[3], kept[4], ("Asia/Tokyo", "2024-01-31", "new"), ("Asia/Kolkata", "2024-01-31", "new")}
    assert {tuple(x) for x in salts.rotated(spark.createDataFrame(sorted(got), table.schema), zones, now, F.lit("other")).collect()} == got
    random = {x["timezone"]: x["salt"] for x in salts.rotated(table.limit(0), zones, now).collect()}
    assert len(set(random.values())) == 4 and all(len(x) == 32 for x in random.values())


def test_a_moved_site_takes_its_salt_along(spark):
    table = spark.createDataFrame([("UTC", "2024-01-31", "u"), ("Asia/Tokyo", "2024-01-30", "t"), ("Asia/Seoul", "2024-01-31", "s")], "timezone string, local_date string, salt string")
    now = 1_706_670_000_000
    after = lambda a, b: {tuple(x) for x in salts.carried(table, a, b, now).collect()}
    before = {tuple(x) for x in table.collect()}
    assert after("UTC", "Asia/Tokyo") == before - {("Asia/Tokyo", "2024-01-30", "t")} | {("Asia/Tokyo", "2024-01-31", "u")}
    assert after("UTC", "Asia/Seoul") == before  # has one of its own today
    assert after("Asia/Tokyo", "Asia/Kolkata") == before  # no live one to take
    assert after("UTC", "America/New_York") == before | {("America/New_York", "2024-01-30", "u")}


def test_active_visitors_of_stream_and_batch_agree(spark):
    hits = [(1, 7, 1_000), (1, 7, 305_000), (1, 8, 10_000), (2, 7, 0), (2, 9, 1_800_001), (2, 9, 1_800_002)]
    rows = spark.createDataFrame(hits, "site_id long, visitor long, ts long")
    sites = spark.createDataFrame([(1,), (2,), (3,)], "site_id long")
    ticks = list(range(0, 2_200_000, jobs.TICK_MS))
    want = {(s, t): len({v for x, v, ts in hits if x == s and t - 300_000 <= ts < t}) for s in (1, 2, 3) for t in ticks}
    batch = q.active_visitors(rows, sites, spark.createDataFrame([(t,) for t in ticks], "tick long")).collect()
    assert {(x["site_id"], x["tick"]): x["active"] for x in batch} == want and len(batch) == len(want)
    seen = rows.select("site_id", "visitor", (F.floor(F.col("ts") / jobs.TICK_MS) * jobs.TICK_MS).alias("cell")).distinct()
    ticked = {(x["site_id"], x["tick"]): x["active"] for x in jobs.ticked(seen).collect()}
    held = {}
    for (s, t), n in want.items():  # a row of 0 holds until the next
        held[s] = ticked.get((s, t), held.get(s, 0))
        assert held[s] == n and (n > 0) <= ((s, t) in ticked)
    for t in (10_000, 300_000, 310_000, 1_800_000, 1_810_000):
        assert {x["site_id"]: x["active"] for x in jobs.active_at(seen, sites, t).collect()} == {s: want[s, t] for s in (1, 2, 3)}
