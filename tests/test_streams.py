"""Micro-batches give what one batch gives, and a batch that is run again counts once."""

from pyspark.sql import functions as F

from tidemark.operators import query as q
from tidemark.operators import visits as v
from tidemark.sources import demo
from tidemark.streaming import jobs


def test_visits_over_micro_batches(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    for n in range(3):  # a third of the days each
        rows.filter(F.floor((F.dayofmonth("ts") - 1) / 11) == n).coalesce(1).write.parquet(f"{tmp_path}/in/part{n}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    events, hours = jobs.visits_and_hours(v.enrich(demo.hits_of(stream), demo.sites(spark)), f"{tmp_path}/out")
    want = v.sessionize(v.enrich(demo.hits(spark, sf), demo.sites(spark)))
    columns = ["hit_id", "session_id", "seq", "engaged_step", "ref_type", "utm_source"]
    pick = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert pick(events) == pick(want)
    totals = lambda df: tuple(df.agg(F.sum("hits"), F.sum("pageviews")).first())
    assert totals(hours) == totals(q.hour_traffic(want))
    assert spark.read.parquet(f"{tmp_path}/out/events").select("batch").distinct().count() == 3


def test_feed_over_micro_batches(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    for n in range(3):
        rows.filter(F.col("event_id") % 3 == n).coalesce(1).write.parquet(f"{tmp_path}/in/part{n}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    found, ticks = jobs.feed(v.enrich(demo.hits_of(stream), demo.sites(spark)), f"{tmp_path}/out", 20)
    want = sorted((r.site_id, -r.ts, -r.hit_id) for r in v.enrich(demo.hits(spark, sf), demo.sites(spark)).filter("NOT not_found").collect())
    want = [r for s in (1, 2, 3) for r in [w for w in want if w[0] == s][:20]]
    got = sorted((r.site_id, -r.ts, -r.hit_id) for r in found.collect())
    assert got == want
    assert sorted((r.batch, r.site_id) for r in ticks.collect()) == [(b, s) for b in range(3) for s in (1, 2, 3)]
    first = min(got, key=lambda r: r[1:])
    assert jobs.resumed(found, -first[1], -first[2]).count() == 0
