"""Registered streaming jobs over the events table, read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import visits as v
from ..sources import demo
from ..streaming import jobs
from .queries import _rounded, register
from .reports import HOUR_SQL


#: What a micro-batch takes at most, in whole files.
TRIGGER_BYTES = 256 << 20


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    # a stream reads folders: the table's own, or, if it is one file, the one it lies in
    single = all(f.rstrip("/").endswith("/events.parquet") for f in table.inputFiles())
    source = spark.readStream.schema(table.schema).option("maxBytesPerTrigger", TRIGGER_BYTES)
    rows = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else source.parquet(f"{sf_dir}/events.parquet")
    return v.enrich(demo.hits_of(rows), demo.sites(spark))


@register("stream_events", "SELECT hit_id, site_id, visitor, ts, type, path, session_id, seq, engaged_step::BIGINT AS engaged_step, ref_type, ref_domain, utm_source, utm_medium, utm_campaign FROM ev")
def stream_events(spark, sf_dir):
    found = jobs.visits_and_hours(_stream(spark, sf_dir), jobs.scratch(spark, "stream-events"))[0]
    return found.select("hit_id", "site_id", "visitor", "ts", "type", "path", "session_id", "seq", "engaged_step", *v.FIRST_TOUCH)


@register("stream_rollup_hour", HOUR_SQL + " GROUP BY ALL")
def stream_rollup_hour(spark, sf_dir):
    return _rounded(jobs.visits_and_hours(_stream(spark, sf_dir), jobs.scratch(spark, "stream-hours"))[1])


@register("stream_active_visitors", """
, w AS (SELECT site_id, visitor, unnest(range(1, 31)) * 10000 + ts // 10000 * 10000 AS tick FROM m1), c AS (SELECT site_id, tick, count(DISTINCT visitor) AS active FROM w GROUP BY ALL)
SELECT * FROM c UNION ALL SELECT site_id, tick + 10000, 0 FROM c WHERE (site_id, tick + 10000) NOT IN (SELECT (site_id, tick) FROM c)""")
def stream_active_visitors(spark, sf_dir):
    return jobs.active_visitors(_stream(spark, sf_dir), jobs.scratch(spark, "stream-active"))


@register("stream_feed", "SELECT hit_id, site_id, visitor, ts, type, path, country FROM m1 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY ts DESC, hit_id DESC) <= 50")
def stream_feed(spark, sf_dir):
    return jobs.feed(_stream(spark, sf_dir), jobs.scratch(spark, "stream-feed"), 50)[0]


@register("stream_ticks", "SELECT DISTINCT site_id, 0 AS batch FROM m1")
def stream_ticks(spark, sf_dir):
    """The table is one file, so one micro-batch."""
    return jobs.feed(_stream(spark, sf_dir), jobs.scratch(spark, "stream-ticks"), 50)[1]
