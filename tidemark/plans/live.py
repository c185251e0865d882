"""Registered queries over tallies, cards, digests and rewrites of history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as h
from ..operators import live
from ..operators import query as q
from ..operators import rollups as r
from ..operators import visits as v
from ..sources import demo
from .queries import BEFORE, EVENT_METRICS, EVENT_METRICS_SQL, HITS_SQL, NOW, ORACLE_SQL, _both, _rounded, events, register

#: Noon of 15 January 2024 UTC: the present of the tallies.
NOON = 1_705_320_000_000
WEEK, WEEK_BEFORE = ("2024-01-15", "2024-01-21"), ("2024-01-08", "2024-01-14")
LATELY = f"ts BETWEEN {NOON - live.TALLY_MS} AND {NOON}"
DAYS = f"days AS (SELECT strftime(unnest(generate_series(DATE '{WEEK[0]}', DATE '{WEEK[1]}', INTERVAL 1 DAY)), '%Y-%m-%d') AS day)"

register("visitor_tally", f"SELECT site_id, visitor, count(*) FILTER (type <> 'ping') AS actions, max(country) AS country, sum(engaged_step)::BIGINT AS engaged_ms FROM ev WHERE {LATELY} GROUP BY ALL ORDER BY actions DESC, visitor LIMIT 10")(
    lambda spark, sf_dir: live.visitor_tally(events(spark, sf_dir), NOON))
register("country_tally", f", c AS (SELECT country, count(*) AS hits FROM ev WHERE country IS NOT NULL AND {LATELY} GROUP BY ALL) SELECT *, round(hits / max(hits) OVER () * 100, 1) AS pct FROM c ORDER BY hits DESC, country LIMIT 8")(
    lambda spark, sf_dir: live.country_tally(events(spark, sf_dir), NOON))
register("visitor_trail", ORACLE_SQL["feed_runs"][len(HITS_SQL):].replace("FROM c GROUP BY ALL", "FROM c WHERE site_id = 2 AND visitor = 1 GROUP BY ALL ORDER BY started DESC, run DESC LIMIT 12"))(
    lambda spark, sf_dir: live.visitor_trail(events(spark, sf_dir), 2, 1))
register("top_pages", f"""
, {DAYS}, n AS (SELECT site_id, path, local_date, count(*) AS n FROM ev WHERE type = 'pageview' AND local_date BETWEEN '{WEEK[0]}' AND '{WEEK[1]}' GROUP BY ALL)
, t AS (SELECT site_id, path, sum(n)::BIGINT AS total, row_number() OVER (PARTITION BY site_id ORDER BY sum(n) DESC, path) AS rank FROM n GROUP BY site_id, path QUALIFY rank <= 3)
SELECT t.site_id, t.path, any_value(total) AS total, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY day) AS trend, any_value(rank) AS rank FROM t CROSS JOIN days LEFT JOIN n ON n.site_id = t.site_id AND n.path = t.path AND local_date = day GROUP BY t.site_id, t.path""")(
    lambda spark, sf_dir: live.top_pages(events(spark, sf_dir), *WEEK))
register("site_cards", f"""
, {DAYS}, s AS (SELECT unnest([1, 2, 3]) AS site_id), a AS (SELECT * FROM ev WHERE type <> 'ping'), n AS (SELECT site_id, local_date, count(DISTINCT visitor) AS n FROM a GROUP BY ALL)
, t AS (SELECT s.site_id, count(DISTINCT visitor) FILTER (local_date BETWEEN '{WEEK[0]}' AND '{WEEK[1]}') AS total, count(DISTINCT visitor) FILTER (local_date BETWEEN '{WEEK_BEFORE[0]}' AND '{WEEK_BEFORE[1]}') AS before FROM s LEFT JOIN a USING (site_id) GROUP BY ALL)
, d AS (SELECT s.site_id, string_agg(coalesce(n, 0)::VARCHAR, ',' ORDER BY day) AS trend FROM s CROSS JOIN days LEFT JOIN n ON n.site_id = s.site_id AND local_date = day GROUP BY ALL)
SELECT site_id, 'site' || site_id || '.test' AS domain, total, CASE WHEN total > 0 AND before > 0 THEN floor((total - before) / before * 100 + 0.5)::BIGINT END AS delta_pct, total = 0 AS silent, trend FROM t JOIN d USING (site_id)""")(
    lambda spark, sf_dir: live.site_cards(events(spark, sf_dir), demo.sites(spark), WEEK, WEEK_BEFORE))
register("flows_through_edge", """
, w AS (SELECT session_id, count(*) AS total, to_json(list(label ORDER BY n) FILTER (n <= 4))::VARCHAR AS steps FROM steps GROUP BY session_id)
, f AS (SELECT steps, count(*) AS sessions, round(avg(engaged_ms), 4) AS avg_engaged, round(avg((total <= 4)::INT), 6) AS exit_rate FROM w JOIN se USING (session_id) GROUP BY steps)
SELECT * FROM (SELECT *, round(sessions / max(sessions) OVER () * 100, 4) AS pct FROM f) WHERE steps->>0 = '/p3' AND steps->>1 = 'event: shop · purchase' ORDER BY sessions DESC, steps LIMIT 50""")(
    lambda spark, sf_dir: _rounded(live.flows_through(q.flows(*_both(spark, sf_dir), limit=None), 1, "/p3", "event: shop · purchase")).withColumn("pct", F.round("pct", 4)))
_DIMS = ("ref_domain", "country", "utm_source", "entry_path")
register("digest", f"""
, b AS (SELECT * FROM se WHERE local_date BETWEEN '{WEEK_BEFORE[0]}' AND '{WEEK[1]}')
, p AS ({' UNION ALL '.join(f"SELECT site_id, local_date, '{d}' AS dim, {d} AS value FROM b" for d in _DIMS)})
, c AS (SELECT site_id, dim, value, count(*) FILTER (local_date >= '{WEEK[0]}') AS current, count(*) FILTER (local_date < '{WEEK[0]}') AS previous FROM p GROUP BY ALL)
, t AS (SELECT site_id, count(*) FILTER (local_date >= '{WEEK[0]}') AS visits, count(*) FILTER (local_date < '{WEEK[0]}') AS visits_before FROM b GROUP BY ALL)
, m AS (SELECT site_id, dim, value, current - previous AS delta, row_number() OVER (PARTITION BY site_id, dim ORDER BY abs(current - previous) DESC, current DESC, value NULLS FIRST) AS rank FROM c WHERE current <> previous)
SELECT site_id, visits, visits_before, dim, value, delta, rank FROM m JOIN t USING (site_id) WHERE rank <= 3""")(
    lambda spark, sf_dir: live.digest(_both(spark, sf_dir)[1], _DIMS, WEEK, WEEK_BEFORE))
register("filter_segment", f"SELECT local_date AS bucket, {EVENT_METRICS_SQL} FROM ev WHERE browser = 'Chrome' AND (country = 'US' OR ref_type = 'search') GROUP BY ALL")(
    lambda spark, sf_dir: _rounded(q.metric(events(spark, sf_dir), None, EVENT_METRICS, by="day", where=q.with_segments(
        {"all": [{"dim": "browser", "op": "eq", "value": "Chrome"}, {"segment": "found"}]}, {"found": {"any": [{"dim": "country", "op": "eq", "value": "US"}, {"dim": "ref_type", "op": "eq", "value": "search"}]}}))))


@register("rereferred", "SELECT hit_id, CASE WHEN ref_domain = 'google.com' THEN 'google' ELSE ref_domain END AS ref_domain, CASE WHEN ref_domain = 'google.com' THEN ref_domain END AS ref_domain_raw FROM ev")
def rereferred(spark, sf_dir):
    """Applied twice: a second pass over its own rows changes nothing."""
    table = spark.createDataFrame([("google.com", "google")], "host string, canonical string")
    e = events(spark, sf_dir).withColumn("ref_domain_raw", F.lit(None).cast("string"))
    return h.rereferred(h.rereferred(e, table), table).select("hit_id", "ref_domain", "ref_domain_raw")


register("rezoned", "SELECT hit_id, CASE WHEN site_id = 2 THEN strftime(make_timestamp(ts * 1000) + INTERVAL 9 HOUR, '%Y-%m-%d') ELSE local_date END AS local_date, CASE WHEN site_id = 2 THEN hour(make_timestamp(ts * 1000) + INTERVAL 9 HOUR) ELSE local_hour END AS local_hour FROM ev")(
    lambda spark, sf_dir: h.rezoned(events(spark, sf_dir), spark.createDataFrame([(2, "Asia/Tokyo")], "site_id long, timezone string")).select("hit_id", "local_date", "local_hour"))
register("without_prop", """SELECT hit_id, CASE WHEN type IN ('pageview', 'event') THEN '{' || CASE WHEN site_id = 2 THEN '' ELSE '"beta":' || beta || ',' END || '"plan":"' || plan || '"}' END AS props FROM ev""")(
    lambda spark, sf_dir: h.without_prop(events(spark, sf_dir), 2, "beta").select("hit_id", "props"))
register("without_site", "SELECT site_id, count(*) AS hits FROM ev WHERE site_id <> 2 GROUP BY ALL")(lambda spark, sf_dir: h.without_site(events(spark, sf_dir), 2).groupBy("site_id").agg(F.count("*").alias("hits")))
register("first_hours", "SELECT session_id, local_hour FROM se")(lambda spark, sf_dir: h.with_first_hour(_both(spark, sf_dir)[1], events(spark, sf_dir)).select("session_id", "local_hour"))
_REPORT = "SELECT coalesce(a.site_id, b.site_id) AS site_id, coalesce(a.local_date, b.local_date) AS local_date, coalesce(visits, 0) AS visits, coalesce(pageviews, 0) AS pageviews FROM (SELECT site_id, local_date, count(*) AS visits FROM se GROUP BY ALL) a FULL JOIN (SELECT site_id, local_date, count(*) AS pageviews FROM ev WHERE type = 'pageview' GROUP BY ALL) b ON a.site_id = b.site_id AND a.local_date = b.local_date"
register("import_day_report", _REPORT)(lambda spark, sf_dir: h.day_report(*_both(spark, sf_dir)))


@register("import_faults", f", r AS ({_REPORT}) SELECT site_id, local_date, 'pageviews' AS counter, pageviews AS stored, pageviews - (site_id = 2)::BIGINT AS fresh FROM r WHERE site_id = 2 AND local_date BETWEEN '{NOW[0]}' AND '{NOW[1]}' UNION ALL SELECT site_id, local_date, unnest(['visits', 'pageviews']) AS counter, unnest([visits, pageviews]) AS stored, NULL AS fresh FROM r WHERE local_date = '{BEFORE[1]}'")
def import_faults(spark, sf_dir):
    """An import that lost a page view of site 2 on each late day, and one day of all sites."""
    source = h.day_report(*_both(spark, sf_dir))
    lost = ((F.col("site_id") == 2) & F.col("local_date").between(*NOW)).cast("long")
    return h.import_faults(source, source.filter(F.col("local_date") != BEFORE[1]).withColumn("pageviews", F.col("pageviews") - lost))


VISIT_DIMS = ("country", "ref_domain", "exit_path")
_DAYS_SQL = " UNION ALL ".join(f"SELECT site_id, local_date, '{d}' AS dim, {d} AS value, count(*) AS visits, sum(pageviews)::BIGINT AS pageviews, sum(engaged_ms)::BIGINT AS engaged_ms FROM se GROUP BY ALL" for d in VISIT_DIMS)
register("rollup_visit_days", _DAYS_SQL)(lambda spark, sf_dir: r.visit_days(_both(spark, sf_dir)[1], VISIT_DIMS))


@register("rollup_visits_moved", _DAYS_SQL)
def rollup_visits_moved(spark, sf_dir):
    """The rollup of visits cut after three hits, once the rest of those that are longer came in."""
    e, whole = _both(spark, sf_dir)
    early = v.sessions(e.filter("seq <= 3"))
    longer = e.filter("seq = 4").select("session_id")
    before, after = (s.join(longer, "session_id", "left_semi") for s in (early, whole))
    return r.visits_moved(r.visit_days(early, VISIT_DIMS), before, after, VISIT_DIMS)


register("rollup_movers", ORACLE_SQL["changes"][len(HITS_SQL):])(lambda spark, sf_dir: _rounded(r.movers(r.visit_days(_both(spark, sf_dir)[1], VISIT_DIMS), "ref_domain", NOW, BEFORE)))
