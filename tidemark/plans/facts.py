"""Registered queries over stored facts: what two flushes and a repeated one give is what one batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import query as q
from ..operators import visits as v
from ..sinks import facts
from ..sources import demo
from ..streaming.jobs import scratch
from .queries import EVENT_METRICS, EVENT_METRICS_SQL, _rounded, register
from .reports import HOUR_SQL

#: Noon of 15 January 2024 UTC: the first flush has what came before.
CUT = 1_705_320_000_000


def stored(spark: SparkSession, sf_dir: str) -> facts.Store:
    """A store after two flushes, the second of which ran twice."""
    hits = demo.hits(spark, sf_dir)
    enriched = v.enrich(hits, demo.sites(spark))
    events, missing = v.sessionize(enriched, of=hits), v.not_found(enriched)
    store = facts.create(spark, scratch(spark, "facts"))
    for n, part in ((0, F.col("ts") < CUT), (1, F.col("ts") >= CUT), (1, F.col("ts") >= CUT)):
        facts.flush(store, n, events.filter(part), missing.filter(part))
    return store


@register("facts_events", "SELECT hit_id, site_id, local_date, session_id, seq, path, ref_type FROM ev")
def facts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.read(stored(spark, sf_dir), "events").select("hit_id", "site_id", "local_date", "session_id", "seq", "path", "ref_type")


@register("facts_visits", "SELECT * FROM se")
def facts_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.read(stored(spark, sf_dir), "visits")
    return rows.withColumn("engaged_ms", F.col("engaged_ms").cast("long"))


@register("facts_hours", HOUR_SQL + " GROUP BY ALL")
def facts_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(facts.hours(stored(spark, sf_dir)))


@register("facts_missing", "SELECT * FROM missing")
def facts_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.read(stored(spark, sf_dir), "missing")


@register("facts_compacted_metrics", f"SELECT local_date AS bucket, site_id, {EVENT_METRICS_SQL} FROM ev WHERE site_id = 2 AND local_date >= '2024-01-10' GROUP BY ALL")
def facts_compacted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one site's days, from a store whose twice-written partitions were put together."""
    store = stored(spark, sf_dir)
    facts.compact(store, 2, least=2)
    rows = facts.read(store, "events").filter((F.col("site_id") == 2) & (F.col("local_date") >= "2024-01-10"))
    return _rounded(q.metric(rows, None, EVENT_METRICS, ("site_id",), by="day"))
