"""Registered queries of what comes before visits: tracker formats, refusals, visitor keys, properties, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import web
from ..operators import admission as a
from ..operators import visits as v
from ..sources import demo, tracker
from .queries import register

RULES = [(None, "203.0.113.7"), (2, "203.0.113.64/28"), (1, "2001:db8:1::/48")]


def _clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.clients(demo.hits(spark, sf_dir))


def _parsed(df: DataFrame, *first: str) -> DataFrame:
    return web.with_url(df).select(*first, "site_id", "type", web.page_path().alias("path"), web.referrer_domain(F.col("referrer")).alias("ref"), "target_url", "event_category", "event_action", "event_name", F.round("event_value", 4).alias("event_value"))


PAYLOAD_SQL = "site_id, type, path, ref_domain0 AS ref"
EVENT_SQL = "event_category, event_action, CASE WHEN event_category = 'shop' THEN 'item' || (k % 5) END AS event_name, round(event_value, 4) AS event_value"
TARGET_SQL = "CASE type WHEN 'outlink' THEN 'https://out.test/a?b=c' WHEN 'download' THEN 'https://files.test/a.pdf' END AS target_url"
register("tracker_requests", f"SELECT hit_id AS line, ts, {PAYLOAD_SQL}, {TARGET_SQL}, {EVENT_SQL} FROM zoned")(
    lambda spark, sf_dir: _parsed(tracker.from_requests(demo.requests(demo.hits(spark, sf_dir))), "line", "ts"))
register("tracker_bulk", f"SELECT (i // 10) * 1048576 + row_number() OVER (PARTITION BY i // 10 ORDER BY i) - 1 AS line, {PAYLOAD_SQL}, {TARGET_SQL}, {EVENT_SQL} FROM zoned")(
    lambda spark, sf_dir: _parsed(tracker.from_requests(tracker.from_bulk(demo.bulk(demo.hits(spark, sf_dir)))), "line"))


@register("tracker_envelopes", """
, n AS (SELECT *, (i // 10) * 8 + site_id AS batch, row_number() OVER (PARTITION BY i // 10, site_id ORDER BY i) - 1 AS "at" FROM zoned)
SELECT batch, "at", site_id, type, path, event_category AS category, round(event_value, 4) AS value FROM n WHERE type NOT IN ('outlink', 'download') OR i % 4 <> 0""")
def tracker_envelopes(spark, sf_dir):
    found = web.with_url(tracker.from_envelopes(demo.envelopes(demo.hits(spark, sf_dir))))
    return found.select("batch", F.col("at").cast("long").alias("at"), "site_id", "type", web.page_path().alias("path"), "category", F.round("value", 4).alias("value"))


register("prop_drops", """
, n AS (SELECT site_id, local_date, type, i FROM zoned), r AS (SELECT site_id, local_date, CASE WHEN type = 'ping' THEN ['on_ping'] ELSE ['bad_key', 'ip_shaped', 'oversize'] || CASE WHEN i % 2 = 0 THEN ['ip_shaped'] ELSE [] END END AS why FROM n)
, u AS (SELECT site_id, local_date, unnest(why) AS reason FROM r) SELECT site_id, local_date, reason, count(*) AS n FROM u GROUP BY ALL""")(
    lambda spark, sf_dir: a.prop_drops(v.enrich(_clients(spark, sf_dir), demo.sites(spark))))
register("sites_by_domain", "SELECT hit_id, site_id FROM hits WHERE i % 5 <> 4")(
    lambda spark, sf_dir: v.named_sites(demo.site_names(demo.hits(spark, sf_dir)), demo.sites(spark)).select("hit_id", "site_id"))
register("aliased_sources", "SELECT hit_id, CASE WHEN utm_source = 'google' AND site_id = 2 THEN 'search ads' WHEN utm_source = 'google' THEN 'ads' ELSE utm_source END AS utm_source, CASE utm_source WHEN 'news letter' THEN 'News Letter' WHEN 'z' THEN 'Z' END AS utm_source_raw FROM ev")(
    lambda spark, sf_dir: v.sessionize(v.enrich(demo.hits(spark, sf_dir), demo.sites(spark), demo.aliases(spark))).select("hit_id", "utm_source", "utm_source_raw"))


REFUSED_SQL = "CASE WHEN (visitor % 11 < 10 AND (visitor % 200 = 7 OR (site_id = 2 AND visitor % 200 BETWEEN 64 AND 79))) OR (visitor % 11 = 10 AND site_id = 1) THEN 'excluded' WHEN visitor % 5 = 3 THEN 'bot' END"


@register("refused_hits", f", r AS (SELECT *, {REFUSED_SQL} AS refused FROM zoned) SELECT site_id, local_date, count(*) FILTER (refused = 'excluded') AS excluded, count(*) FILTER (refused = 'bot') AS bots, count(*) FILTER (refused IS NULL) AS admitted FROM r GROUP BY ALL")
def refused_hits(spark, sf_dir):
    tested = a.refuse(v.enrich(_clients(spark, sf_dir), demo.sites(spark)), RULES)
    n = lambda c: F.count_if(c)
    return tested.groupBy("site_id", "local_date").agg(n(F.col("refused") == "excluded").alias("excluded"), n(F.col("refused") == "bot").alias("bots"), n(F.col("refused").isNull()).alias("admitted"))


AGENT_SQL = "CASE visitor % 5 " + " ".join(f"WHEN {n} THEN '{a}'" for n, a in enumerate(demo.AGENTS)) + " END"


@register("agents", """
SELECT [ 'Chrome', 'Mobile Safari', 'Firefox', NULL, NULL][visitor % 5 + 1] AS browser, ['120.0.0.0', '17.1', '121.0', NULL, NULL][visitor % 5 + 1] AS browser_version, ['Windows', 'iOS', 'Linux', NULL, NULL][visitor % 5 + 1] AS os,
  ['desktop', 'mobile', 'desktop', 'desktop', 'desktop'][visitor % 5 + 1] AS device_type, count(*) AS hits FROM hits GROUP BY ALL""")
def agents(spark, sf_dir):
    """Agents are few: they are counted first and looked at once each."""
    few = _clients(spark, sf_dir).groupBy("user_agent").agg(F.count("*").alias("n"))
    return few.withColumns(a.agent_columns(F.col("user_agent"))).groupBy("browser", "browser_version", "os", "device_type").agg(F.sum("n").alias("hits"))


@register("visitor_ids", f"""
, z AS (SELECT *, CASE visitor % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'UTC' ELSE 'Asia/Tokyo' END AS zone,
    {AGENT_SQL} AS agent,
    CASE visitor % 11 WHEN 10 THEN '2001:db8:1::' || upper(printf('%x', visitor % 200)) WHEN 9 THEN '::ffff:203.0.113.' || (visitor % 200) ELSE '203.0.113.' || (visitor % 200) END AS address FROM zoned)
SELECT local_date, site_id, count(DISTINCT address || agent) AS visitors, count(*) AS hits, min(substr(sha256(md5(zone || local_date) || site_id || chr(10) || address || chr(10) || agent), 1, 16)) AS first_id FROM z GROUP BY ALL""")
def visitor_ids(spark, sf_dir):
    zoned = v.enrich(_clients(spark, sf_dir), demo.sites(spark)).join(demo.sites(spark).select("site_id", "timezone"), "site_id")
    salts = zoned.select("timezone", "local_date").distinct().withColumn("salt", F.md5(F.concat("timezone", "local_date").cast("binary")))
    return a.visitor_ids(zoned, salts).groupBy("local_date", "site_id").agg(F.count_distinct("visitor_id").alias("visitors"), F.count("*").alias("hits"), F.min("visitor_id").alias("first_id"))


PROPS_SQL = """
, p AS (SELECT hit_id, site_id, ts, unnest(['plan', 'item']) AS key, unnest([['free', 'pro', 'team'][i % 3 + 1], 'n' || (i % 701)]) AS value FROM hits WHERE type <> 'ping'
), g AS (SELECT site_id, key, value, min(ts) AS ts FROM p GROUP BY site_id, key, value
), f AS (SELECT site_id, key, value, row_number() OVER (PARTITION BY site_id, key ORDER BY ts, value) AS n FROM g
), l AS (SELECT hit_id, site_id, ts, key, CASE WHEN n <= 500 THEN value ELSE '(other)' END AS value FROM p JOIN f USING (site_id, key, value))
"""


def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.limited_props(a.admitted_props(_clients(spark, sf_dir)))


register("prop_registry", PROPS_SQL + "SELECT site_id, key, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS events, count(DISTINCT value) AS distinct_values, count(*) FILTER (value = '(other)') AS over FROM l GROUP BY ALL")(
    lambda spark, sf_dir: a.prop_registry(_props(spark, sf_dir)))
register("prop_bags", PROPS_SQL + """SELECT hit_id, '{"item":"' || max(value) FILTER (key = 'item') || '","plan":"' || max(value) FILTER (key = 'plan') || '"}' AS props FROM l GROUP BY ALL""")(lambda spark, sf_dir: a.prop_bags(_props(spark, sf_dir)))
register("located_hits", "SELECT CASE WHEN visitor % 11 = 10 THEN 'FR' WHEN visitor % 200 < 64 THEN 'DE' WHEN visitor % 200 < 128 THEN 'JP' END AS geo_country, CASE WHEN visitor % 11 = 10 THEN 'Paris' WHEN visitor % 200 < 64 THEN 'Berlin' WHEN visitor % 200 < 128 THEN 'Tokyo' END AS geo_city, count(*) AS hits FROM hits GROUP BY ALL")(
    lambda spark, sf_dir: a.located(_clients(spark, sf_dir), demo.address_blocks(spark)).groupBy("geo_country", "geo_city").agg(F.count("*").alias("hits")))
