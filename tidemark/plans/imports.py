"""Registered imports of a warehouse and of a prior version's tables, both derived from the stored events, in one load and in increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import facts
from ..sources import demo, prior, warehouse
from ..streaming.jobs import scratch
from .queries import events, register

_SQL = """
, a AS (SELECT *, min(hit_id) OVER (PARTITION BY session_id) AS idvisit FROM ev WHERE type <> 'ping')
, v AS (SELECT idvisit, any_value(site_id) AS site_id, any_value(visitor) AS visitor, min(ts) AS started_at, max(ts) AS last_seen_at, count(*) FILTER (type <> 'event') AS pageviews, count(*) FILTER (type = 'event') AS events,
    (sum(engaged_step // 1000) * 1000)::BIGINT AS engaged_ms, arg_min(path, seq) FILTER (type = 'pageview') AS entry_path, arg_max(path, seq) FILTER (type = 'pageview') AS exit_path, any_value(ref_type) AS kind, max(ref_domain) AS domain, max(utm_campaign) AS campaign, max(browser) AS browser, max(device_type) AS device_type, max(country) AS country FROM a GROUP BY idvisit)
, w AS (SELECT * EXCLUDE (kind, domain, campaign), CASE kind WHEN 'internal' THEN 'direct' ELSE kind END AS ref_type, CASE WHEN kind NOT IN ('internal', 'direct') THEN domain END AS ref_domain, CASE WHEN kind = 'campaign' THEN campaign END AS utm_campaign FROM v)
"""


def _imported(spark: SparkSession, sf_dir: str, cuts: list[int | None]) -> facts.Store:
    path = scratch(spark, "warehouse")
    tables = demo.warehouse(events(spark, sf_dir))
    for name, rows in tables.items():
        rows.write.parquet(f"{path}/{name}")
    stored = {name: spark.read.parquet(f"{path}/{name}") for name in tables}
    local = stored["sites"].select(F.col("idsite").alias("site_id"), "timezone", "domains").filter("site_id = 2")
    targets = warehouse.site_targets(stored["sites"], local)
    store = facts.create(spark, scratch(spark, "facts"))
    for n, until in enumerate(cuts):
        warehouse.increment(store, n, stored["visits"], stored["links"], stored["actions"], targets, until)
    return store


@register("imported_events", _SQL + """SELECT hit_id, printf('%016x', a.idvisit) AS session_id, a.site_id, a.visitor, ts, local_date, type, CASE WHEN type IN ('pageview', 'event') THEN path END AS path, CASE type WHEN 'pageview' THEN 'Title of ' || path END AS title,
  CASE type WHEN 'outlink' THEN 'https://out.test/a' WHEN 'download' THEN 'https://files.test/a.pdf' END AS target_url, event_category, event_action, CASE WHEN event_category = 'shop' THEN 'item' || (k % 5) END AS event_name, w.ref_type, w.ref_domain, w.browser,
  row_number() OVER (PARTITION BY a.idvisit ORDER BY hit_id) AS seq FROM a JOIN w USING (idvisit)""")
def imported_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two increments and one that finds nothing new; seq goes on across them."""
    middle = int(spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] // 2)
    rows = facts.read(_imported(spark, sf_dir, [middle, None, None]), "events")
    return rows.select("hit_id", "session_id", "site_id", "visitor", "ts", "local_date", "type", "path", "title", "target_url", "event_category", "event_action", "event_name", "ref_type", "ref_domain", "browser", "seq")


@register("imported_visits", _SQL + """SELECT printf('%016x', idvisit) AS session_id, site_id, visitor, started_at, last_seen_at, pageviews, events, engaged_ms, entry_path, exit_path, ref_type, ref_domain, utm_campaign, browser,
  CASE WHEN device_type IN ('desktop', 'mobile', 'tablet') THEN device_type ELSE 'other' END AS device_type, 'Linux' AS os, country FROM w""")
def imported_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    middle = int(spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] // 2)
    rows = facts.read(_imported(spark, sf_dir, [middle, None]), "visits")
    return rows.select("session_id", "site_id", "visitor", "started_at", "last_seen_at", "pageviews", "events", "engaged_ms", "entry_path", "exit_path", "ref_type", "ref_domain", "utm_campaign", "browser", "device_type", "os", "country")


_PRIOR_SQL = """
, p AS (
  SELECT *, hit_id % 6 AS n, path || CASE WHEN hit_id % 6 = 1 THEN CASE WHEN contains(path, '?') THEN '&b=1' ELSE '?b=1' END ELSE '' END AS clean_path FROM ev
), h AS (
  SELECT * EXCLUDE (ref_type, utm_source, utm_medium), CASE WHEN n IN (0, 2) THEN 'campaign' ELSE ref_type END AS ref_type,
    CASE n WHEN 2 THEN 'instagram' WHEN 3 THEN 'news letter' WHEN 0 THEN CASE site_id WHEN 2 THEN 'search ads' ELSE 'ads' END WHEN 4 THEN CASE site_id WHEN 2 THEN 'search ads' ELSE 'ads' END END AS utm_source,
    CASE n WHEN 0 THEN 'cpc' WHEN 2 THEN 'social' WHEN 3 THEN 'e-mail' END AS utm_medium, CASE n WHEN 3 THEN ' News   Letter' WHEN 4 THEN 'google' END AS utm_source_raw, CASE n WHEN 3 THEN 'E-Mail' END AS utm_medium_raw,
    (n IN (0, 1, 2, 4))::INT AS cleaned FROM p
)
"""


def _prior(spark: SparkSession, sf_dir: str) -> tuple[facts.Store, DataFrame, DataFrame]:
    """A store after two increments and one that finds nothing new, and the source's events and visits."""
    path = scratch(spark, "prior")
    for name, rows in demo.prior(events(spark, sf_dir)).items():
        rows.write.parquet(f"{path}/{name}")
    e, s = spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/visits")
    middle = int(e.agg(F.max("id")).first()[0] // 2)
    store = facts.create(spark, scratch(spark, "facts"))
    for n, until in enumerate(((middle, middle // 2), None, None)):
        prior.increment(store, n, e, s, demo.sites(spark), demo.aliases(spark), until)
    return store, e, s


@register("prior_events", _PRIOR_SQL + "SELECT hit_id AS id, site_id, local_date, session_id, seq, clean_path AS path, ref_type, ref_domain, utm_source, utm_medium, NULL AS utm_campaign, utm_source_raw, utm_medium_raw FROM h")
def prior_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.read(_prior(spark, sf_dir)[0], "events")
    return rows.select("id", "site_id", "local_date", "session_id", "seq", "path", "ref_type", "ref_domain", "utm_source", "utm_medium", "utm_campaign", "utm_source_raw", "utm_medium_raw")


@register("prior_visits", _PRIOR_SQL + """SELECT session_id, a.site_id, a.local_date, a.local_hour, a.clean_path AS entry_path, b.exit_path, a.ref_type, a.utm_source, a.utm_medium, a.utm_source_raw, a.utm_medium_raw, b.engaged_ms
  FROM (SELECT * FROM h WHERE seq = 1) a JOIN (SELECT session_id, arg_max(clean_path, seq) FILTER (type = 'pageview') AS exit_path, sum(engaged_step)::BIGINT AS engaged_ms FROM h GROUP BY session_id) b USING (session_id)""")
def prior_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.read(_prior(spark, sf_dir)[0], "visits")
    return rows.select("session_id", "site_id", "local_date", "local_hour", "entry_path", "exit_path", "ref_type", "utm_source", "utm_medium", "utm_source_raw", "utm_medium_raw", "engaged_ms")


@register("prior_report", _PRIOR_SQL + """SELECT count(*) AS events, count(*) FILTER (seq = 1) AS visits,
  (sum(cleaned) + sum(cleaned) FILTER (seq = 1) + (SELECT sum(c) FROM (SELECT arg_max(cleaned, seq) FILTER (type = 'pageview') AS c FROM h GROUP BY session_id)))::BIGINT AS paths_cleaned,
  count(*) FILTER (n IN (0, 2)) + count(*) FILTER (n IN (0, 2) AND seq = 1) AS attributed, count(*) FILTER (n IN (3, 4)) + count(*) FILTER (n IN (3, 4) AND seq = 1) AS utm_normalized FROM h""")
def prior_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prior.report(_prior(spark, sf_dir)[0])


_LOST = "site_id = 1 AND local_date = '2024-01-10'"


@register("prior_gates", _PRIOR_SQL + f"""
, lost AS (SELECT * FROM h WHERE {_LOST}), views AS (SELECT * FROM h WHERE type = 'pageview' AND site_id = 1)
, day AS (SELECT count(DISTINCT session_id) FILTER (type <> 'ping') AS visits, count(*) FILTER (type = 'pageview') AS pageviews, count(*) FILTER (type = 'event') AS events, count(DISTINCT visitor) FILTER (type <> 'ping') AS visitors FROM lost)
SELECT 'rows' AS gate, NULL AS site_id, 'events' AS cell, 'n' AS measure, count(*) AS source, count(*) - (SELECT count(*) FROM lost) AS target FROM h
UNION ALL SELECT 'events per day', 1, '2024-01-10', measure, source, NULL FROM (UNPIVOT day ON visits, pageviews, events, visitors INTO NAME measure VALUE source)
UNION ALL SELECT 'sessions per day', 2, '2024-01-11', 'engaged_ms', sum(engaged_ms)::BIGINT, (sum(engaged_ms) + count(*))::BIGINT FROM se WHERE site_id = 2 AND local_date = '2024-01-11'
UNION ALL SELECT 'totals', 1, 'all', 'pageviews', count(*), count(*) FILTER (local_date <> '2024-01-10') FROM views
UNION ALL SELECT 'pages', 1, clean_path, 'pageviews', count(*), nullif(count(*) FILTER (local_date <> '2024-01-10'), 0) FROM views GROUP BY clean_path HAVING bool_or(local_date = '2024-01-10')""")
def prior_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of an import from which one site lost a day's events, and another's visits of a day are a millisecond too long."""
    store, e, s = _prior(spark, sf_dir)
    if not prior.finish(store, 3, e, s).isEmpty():
        raise ValueError("the import itself has faults")
    longer = F.when(F.expr("site_id = 2 AND local_date = '2024-01-11'"), 1).otherwise(0)
    kept = facts.read(store, "events").filter(f"NOT ({_LOST})")
    return prior.gate_faults(e, s, kept, facts.read(store, "visits").withColumn("engaged_ms", F.col("engaged_ms") + longer))
