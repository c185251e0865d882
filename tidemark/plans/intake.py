"""Registered queries of the whole way of hits into the store: stored events, their visits, missing hits, losses, rollups of all dimensions.

The SQL judges hits by the numbers that the demo's addresses, agents and names are made of, keys visitors by its own digests,
and makes visits of them by the same statements as the other queries' SQL, over the admitted hits.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intake
from ..operators import rollups as r
from ..operators import visits as v
from ..operators.requests import session_day_marginals
from ..sources import demo
from .batches import _COUNTS
from .ingest import AGENT_SQL, REFUSED_SQL, RULES
from .queries import HITS_SQL, _rounded, register

EVENT_DIMS = ("path", "hostname", "ref_domain", "ref_type", "utm_source", "utm_medium", "utm_campaign", "country", "region", "city", "browser", "os", "device_type", "screen", "lang", "event_category", "event_action", "event_name", "target_url")
VISIT_DIMS = ("ref_domain", "ref_type", "utm_source", "utm_medium", "utm_campaign", "country", "region", "city", "browser", "os", "device_type", "entry_path", "exit_path")


def _taken(spark: SparkSession, sf_dir: str) -> intake.Taken:
    hits, sites = demo.hits(spark, sf_dir), demo.sites(spark)
    days = hits.join(sites, "site_id").select("timezone", F.date_format(F.from_utc_timestamp(F.timestamp_millis("ts"), F.col("timezone")), "yyyy-MM-dd").alias("local_date")).distinct()
    salts = days.withColumn("salt", F.md5(F.concat("timezone", "local_date").cast("binary")))
    return intake.take(demo.arrivals(hits), sites, salts, RULES, demo.places(spark))


# visits are made of the admitted hits by the same statements, with the key in place of the demo's visitor
_visits = HITS_SQL[HITS_SQL.index("m1 AS (") : HITS_SQL.index("missing AS (")].replace("FROM zoned", "FROM admitted").replace("visitor", "vid")
_visits = re.sub(r"\bse\b", "xs", re.sub(r"\bev\b", "xe", re.sub(r"\bm(\d)\b", r"x\1", _visits))).rstrip().rstrip(",")
INTAKE_SQL = f"""
, judged AS (SELECT *, {REFUSED_SQL} AS refused, CASE visitor % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'UTC' ELSE 'Asia/Tokyo' END AS zone, {AGENT_SQL} AS agent,
    CASE visitor % 11 WHEN 10 THEN '2001:db8:1::' || upper(printf('%x', visitor % 200)) WHEN 9 THEN '::ffff:203.0.113.' || (visitor % 200) ELSE '203.0.113.' || (visitor % 200) END AS address FROM zoned WHERE i % 5 <> 4
), admitted AS (SELECT * REPLACE (
    CASE WHEN visitor % 11 = 10 THEN 'FR' WHEN visitor % 200 < 64 THEN 'DE' WHEN visitor % 200 < 128 THEN 'JP' END AS country,
    ['Chrome', 'Mobile Safari', 'Firefox', NULL, NULL][visitor % 5 + 1] AS browser, ['desktop', 'mobile', 'desktop', 'desktop', 'desktop'][visitor % 5 + 1] AS device_type),
    CASE WHEN visitor % 11 = 10 THEN 'Paris' WHEN visitor % 200 < 64 THEN 'Berlin' WHEN visitor % 200 < 128 THEN 'Tokyo' END AS city, upper(substr(city, 1, 2)) AS region, ['Windows', 'iOS', 'Linux', NULL, NULL][visitor % 5 + 1] AS os,
    CASE i % 3 WHEN 0 THEN 'de-DE' ELSE 'fr' END AS lang, CASE WHEN type = 'pageview' THEN 'Page ' || (i % 5) END AS title, CASE visitor % 3 WHEN 1 THEN '1920x1080' WHEN 2 THEN '390x844' END AS screen, 'site' || site_id || '.test' AS hostname,
    CASE type WHEN 'outlink' THEN 'https://out.test/' || (k % 3) WHEN 'download' THEN 'https://files.test/a.pdf' END AS target_url, CASE WHEN event_category = 'shop' THEN 'item' || (k % 5) END AS event_name,
    substr(sha256(md5(zone || local_date) || site_id || chr(10) || CASE WHEN visitor % 2 = 0 THEN visitor::VARCHAR ELSE address || chr(10) || agent END), 1, 16) AS vid
  FROM judged WHERE refused IS NULL
), {_visits}
"""
_columns = "hit_id, site_id, session_id, seq, local_date, path, title, screen, lang, country, region, city, browser, os, device_type"
BAGS_SQL = """, p AS (SELECT hit_id, site_id, ts, unnest(['plan', 'item']) AS key, unnest([['free', 'pro', 'team'][i % 3 + 1], 'n' || (i % 701)]) AS value FROM admitted WHERE type <> 'ping' AND NOT not_found
), f AS (SELECT site_id, key, value, row_number() OVER (PARTITION BY site_id, key ORDER BY min(ts), value) AS n FROM p GROUP BY site_id, key, value
), b AS (SELECT hit_id, '{"item":"' || max(CASE WHEN n <= 500 THEN value ELSE '(other)' END) FILTER (key = 'item') || '","plan":"' || max(value) FILTER (key = 'plan') || '"}' AS props FROM p JOIN f USING (site_id, key, value) GROUP BY hit_id)
"""


@register("intake_events", f"{INTAKE_SQL}{BAGS_SQL} SELECT {_columns}, vid AS visitor, props FROM xe LEFT JOIN b USING (hit_id)")
def intake_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _taken(spark, sf_dir).events.select(*_columns.split(", "), "visitor", "props")


_visit = "session_id, site_id, local_date, ref_type, country, browser, device_type, pageviews, events, engaged_ms, entry_path, exit_path"


@register("intake_visits", f"{INTAKE_SQL}, o AS (SELECT session_id, max(region) AS region, max(city) AS city, max(os) AS os FROM xe GROUP BY ALL) SELECT {_visit}, region, city, os FROM xs JOIN o USING (session_id)")
def intake_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.sessions(_taken(spark, sf_dir).events).select(*_visit.split(", "), "region", "city", "os")


register("intake_missing", f"{INTAKE_SQL} SELECT hit_id, site_id, local_date, path, ref_kind0 AS ref_type, ref_domain0 AS ref_domain, device_type, country FROM admitted WHERE not_found")(
    lambda spark, sf_dir: _taken(spark, sf_dir).missing.select("hit_id", "site_id", "local_date", "path", "ref_type", "ref_domain", "device_type", "country"))


@register("intake_losses", f"""{INTAKE_SQL}
, w AS (SELECT site_id, local_date, unnest(CASE WHEN type = 'ping' THEN ['on_ping'] ELSE ['bad_key', 'ip_shaped', 'oversize'] || CASE WHEN i % 2 = 0 THEN ['ip_shaped'] ELSE [] END END) AS what FROM admitted WHERE NOT not_found)
SELECT site_id, local_date, refused AS what, count(*) AS n FROM judged WHERE refused IS NOT NULL GROUP BY ALL
UNION ALL SELECT site_id, local_date, what, count(*) AS n FROM w GROUP BY ALL
UNION ALL SELECT NULL AS site_id, NULL AS local_date, 'other.test' AS what, count(*) AS n FROM zoned WHERE i % 5 = 4""")
def intake_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit or property that was lost, by the reason, and the hits of each unknown reference."""
    t = _taken(spark, sf_dir)
    unknown = t.unknown.select(F.lit(None).cast("long").alias("site_id"), F.lit(None).cast("string").alias("local_date"), F.col("ref").alias("what"), F.col("hits").alias("n"))
    return t.refused.withColumnRenamed("refused", "what").unionByName(t.props.withColumnRenamed("reason", "what")).unionByName(unknown)


_counts = re.sub(r"\bvisitor\b", "vid", _COUNTS).replace("FROM ev", "FROM xe")
register("intake_event_days", INTAKE_SQL + f"SELECT site_id, local_date, 'total' AS dim, NULL::VARCHAR AS value, {_counts}" + "".join(f" UNION ALL SELECT site_id, local_date, '{d}' AS dim, {d} AS value, {_counts}" for d in EVENT_DIMS))(
    lambda spark, sf_dir: _rounded(r.event_days(_taken(spark, sf_dir).events, EVENT_DIMS)))
_margins = "count(*) AS visits, count(*) FILTER (engaged_ms > 0) AS measured, sum(engaged_ms)::BIGINT AS engaged_ms, count(*) FILTER (pageviews = 1 AND events = 0 AND engaged_ms < 15000) AS bounced, sum(pageviews)::BIGINT AS views FROM s GROUP BY ALL"
register("intake_visit_days", INTAKE_SQL + f", o AS (SELECT session_id, max(region) AS region, max(city) AS city, max(os) AS os FROM xe GROUP BY ALL), s AS (SELECT * FROM xs JOIN o USING (session_id)) SELECT site_id, local_date, 'total' AS dim, NULL::VARCHAR AS value, {_margins}" + "".join(f" UNION ALL SELECT site_id, local_date, '{d}' AS dim, {d} AS value, {_margins}" for d in VISIT_DIMS))(
    lambda spark, sf_dir: session_day_marginals(v.sessions(_taken(spark, sf_dir).events), VISIT_DIMS))
