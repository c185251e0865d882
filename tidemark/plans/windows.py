"""Registered queries over windows, goals of a site, parts put together, and what admission tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import web
from ..operators import query as q
from ..operators import visits as v
from ..operators import windows as w
from ..sources import demo
from .live import NOON
from .queries import BUY, HITS_SQL, ORACLE_SQL, _both, _rounded, events, missing_hits, register

#: The local now of each site, of which every window is made.
NOW_SQL = f", z AS (SELECT site_id, make_timestamp({NOON}::BIGINT * 1000) + o * INTERVAL 1 HOUR AS local FROM (VALUES (1, -5), (2, 0), (3, 9)) t(site_id, o))\n"
WEEK_SQL = NOW_SQL + ", b AS (SELECT site_id, strftime(local - INTERVAL 6 DAY, '%Y-%m-%d') AS first, strftime(local, '%Y-%m-%d') AS last, strftime(local - INTERVAL 13 DAY, '%Y-%m-%d') AS first0, strftime(local - INTERVAL 7 DAY, '%Y-%m-%d') AS last0 FROM z)\n"
PRESETS = {"today": "local", "7d": "local - INTERVAL 6 DAY", "30d": "local - INTERVAL 29 DAY", "90d": "local - INTERVAL 89 DAY", "mtd": "date_trunc('month', local)"}


@register("window_bounds", NOW_SQL + ", h AS (SELECT *, site_id IS NULL AS x FROM z) " + " UNION ALL ".join(
    f"SELECT '{p}' AS preset, site_id, strftime({first}, '%Y-%m-%d') AS first, strftime(local, '%Y-%m-%d') AS last, NULL::BIGINT AS from_ts, NULL::BIGINT AS to_ts FROM z WHERE site_id IN (SELECT site_id FROM hits)" for p, first in PRESETS.items())
    + f" UNION ALL SELECT '24h', site_id, strftime(local - INTERVAL 23 HOUR, '%Y-%m-%d'), strftime(local, '%Y-%m-%d'), {NOON - 23 * w.HOUR_MS}, {NOON + w.HOUR_MS} FROM z WHERE site_id IN (SELECT site_id FROM hits)")
def window_bounds(spark, sf_dir):
    """Of the sites that have hits."""
    seen = demo.sites(spark).join(demo.hits(spark, sf_dir).select("site_id").distinct(), "site_id", "left_semi")
    made = [w.bounds(seen, p, NOON).drop("timezone").withColumn("preset", F.lit(p)) for p in (*PRESETS, "24h")]
    out = made[0]
    for one in made[1:]:
        out = out.unionByName(one)
    return out


def _week(spark):
    return w.bounds(demo.sites(spark), "7d", NOON)


register("windowed_pageviews", WEEK_SQL + "SELECT ev.site_id, count(*) FILTER (type = 'pageview') AS pageviews FROM ev JOIN b ON ev.site_id = b.site_id AND local_date BETWEEN first AND last GROUP BY ALL")(
    lambda spark, sf_dir: q.metric(w.inside(events(spark, sf_dir), _week(spark)), None, ["pageviews"], ("site_id",)))
register("rolling_day", f"SELECT site_id, count(*) FILTER (type = 'pageview') AS pageviews FROM ev WHERE ts >= {NOON - 23 * w.HOUR_MS} AND ts < {NOON + w.HOUR_MS} GROUP BY ALL")(
    lambda spark, sf_dir: q.metric(w.inside(events(spark, sf_dir), w.bounds(demo.sites(spark), "24h", NOON)), None, ["pageviews"], ("site_id",)))
register("compared_visits", WEEK_SQL + "SELECT se.site_id, 'current' AS period, count(*) AS visits FROM se JOIN b ON se.site_id = b.site_id AND local_date BETWEEN first AND last GROUP BY ALL UNION ALL SELECT se.site_id, 'previous', count(*) FROM se JOIN b ON se.site_id = b.site_id AND local_date BETWEEN first0 AND last0 GROUP BY ALL")(
    lambda spark, sf_dir: w.with_compare(_both(spark, sf_dir)[1], _week(spark), at="started_at").groupBy("site_id", "period").agg(F.count("*").alias("visits")))
register("enveloped_transitions", WEEK_SQL + """
, chosen AS (SELECT session_id FROM se JOIN b ON se.site_id = b.site_id AND local_date BETWEEN first AND last WHERE browser = 'Chrome' OR browser = 'Firefox')
, edges AS (SELECT n AS step, label AS "from", lead(label) OVER (PARTITION BY session_id ORDER BY n) AS "to" FROM steps WHERE session_id IN (FROM chosen)), c AS (SELECT step, "from", "to", count(*) AS sessions FROM edges WHERE "to" IS NOT NULL AND step <= 3 GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY step ORDER BY sessions DESC, "from", "to") <= 10""")(
    lambda spark, sf_dir: q.transitions(w.envelope(*_both(spark, sf_dir), _week(spark), {"dim": "browser", "op": "in", "value": ["Chrome", "Firefox"]})[0]))
register("edge_visits", "SELECT session_id FROM se WHERE local_date = '2024-01-15' OR (local_date < '2024-01-15' AND strftime(make_timestamp(last_seen_at * 1000) + CASE site_id WHEN 1 THEN INTERVAL '-5 hours' WHEN 2 THEN INTERVAL '0 hours' ELSE INTERVAL '9 hours' END, '%Y-%m-%d') >= '2024-01-15')")(
    lambda spark, sf_dir: w.touching(_both(spark, sf_dir)[1], "2024-01-15", "2024-01-15", demo.sites(spark)).select("session_id"))
for _name, _value, _sql in (("fixed", 5.0, "conversions * 5.0"), ("event_value", "event_value", "value")):
    register(f"goal_of_site_{_name}", f"""
, g AS (SELECT count(DISTINCT session_id) AS conversions, round(sum(event_value), 4) AS value FROM ev WHERE site_id = 2 AND type <> 'ping' AND event_action = 'purchase'), s AS (SELECT site_id, count(*) AS visits FROM se GROUP BY ALL)
SELECT site_id, CASE WHEN site_id = 2 THEN conversions END AS conversions, CASE WHEN site_id = 2 THEN round(conversions / visits, 6) END AS rate, CASE WHEN site_id = 2 THEN {_sql} END AS value FROM s, g""")(
        lambda spark, sf_dir, value=_value: _rounded(w.site_goal(*_both(spark, sf_dir), 2, BUY, value)))
register("weeks_recombined", "SELECT strftime(date_trunc('week', local_date::DATE), '%Y-%m-%d') AS week, count(*) AS visits, round(sum(pageviews) / count(*), 6) AS views_per_visit, round(count(*) FILTER (pageviews = 1 AND events = 0 AND engaged_ms < 15000) / count(*), 6) AS bounce_rate FROM se GROUP BY ALL")(
    lambda spark, sf_dir: _rounded(w.recombined(q.metric(None, _both(spark, sf_dir)[1], ["visits", "views_per_visit", "bounce_rate"], by="day").withColumn("week", F.date_format(F.date_trunc("week", F.to_date("bucket")), "yyyy-MM-dd")), ["week"], ["visits", "views_per_visit", "bounce_rate"])))
register("sliced_days", ", d AS (SELECT local_date, count(*) AS visits FROM se GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY local_date) - 1 AS i, count(*) OVER () AS n FROM d) SELECT s.slice::INT AS slice, min(local_date) AS first, round(avg(visits), 4) AS visits FROM n JOIN (SELECT unnest(range(12)) AS slice) s ON s.slice < least(12, n) AND i >= s.slice * n // least(12, n) AND i < (s.slice + 1) * n // least(12, n) GROUP BY ALL")(
    lambda spark, sf_dir: w.sliced(q.metric(None, _both(spark, sf_dir)[1], ["visits"], by="day"), "bucket", "visits").withColumn("visits", F.round("visits", 4)))
register("country_bars", ", c AS (SELECT coalesce(country, 'Unknown') AS name, count(*) AS visits FROM se GROUP BY ALL) SELECT *, round(visits / max(visits) OVER () * 100, 4) AS pct FROM c")(
    lambda spark, sf_dir: w.bars(q.metric(None, _both(spark, sf_dir)[1], ["visits"], ("country",)), F.coalesce("country", F.lit("Unknown")), "visits").withColumn("pct", F.round("pct", 4)))
register("scroll_histogram", ", s AS (SELECT least(scroll // 10, 9) AS decile, count(*) AS n FROM legs WHERE scroll IS NOT NULL AND path = '/p3' GROUP BY ALL) SELECT d.decile, coalesce(n, 0) AS n FROM (SELECT unnest(range(10)) AS decile) d LEFT JOIN s USING (decile)")(
    lambda spark, sf_dir: w.scroll_histogram(q.scroll_deciles(q.page_legs(events(spark, sf_dir)).filter("path = '/p3'"))))
register("orphan_days", "SELECT DISTINCT site_id, local_date FROM ev WHERE site_id = 2")(
    lambda spark, sf_dir: w.orphan_days(q.hour_traffic(events(spark, sf_dir)), *[t.filter("site_id <> 2") for t in _both(spark, sf_dir)]))
register("dwell_of_page", ORACLE_SQL["dwell"][len(HITS_SQL):].replace("FROM legs", "FROM legs WHERE path = '/p3'"))(lambda spark, sf_dir: _rounded(q.dwell(q.page_legs(events(spark, sf_dir)), "/p3")))
register("dwell_longest", ORACLE_SQL["dwell"][len(HITS_SQL):] + " ORDER BY median_ms DESC, path LIMIT 4")(lambda spark, sf_dir: _rounded(q.dwell(q.page_legs(events(spark, sf_dir)), limit=4)))
register("compared_segment", WEEK_SQL + "SELECT se.site_id, 'current' AS period, count(*) AS visits FROM se JOIN b ON se.site_id = b.site_id AND local_date BETWEEN first AND last GROUP BY ALL UNION ALL SELECT se.site_id, 'previous', count(*) FROM se JOIN b ON se.site_id = b.site_id AND local_date BETWEEN first AND last WHERE browser = 'Firefox' OR ref_type = 'search' GROUP BY ALL")(
    lambda spark, sf_dir: w.with_compare(_both(spark, sf_dir)[1], _week(spark), {"any": [{"dim": "browser", "op": "eq", "value": "Firefox"}, {"dim": "ref_type", "op": "eq", "value": "search"}]}, "started_at").groupBy("site_id", "period").agg(F.count("*").alias("visits")))
register("broken_paths_of_country", "SELECT path, count(*) AS hits, count(ref_domain) AS referred FROM missing WHERE country = 'DE' GROUP BY ALL ORDER BY referred DESC, hits DESC, path LIMIT 3")(
    lambda spark, sf_dir: q.broken_paths(missing_hits(spark, sf_dir), {"dim": "country", "op": "eq", "value": "DE"}, 3).select("path", "hits", "referred"))
register("unknown_sites", "SELECT site_id, count(*) AS hits, max(ts) AS last_ts FROM hits WHERE site_id = 3 GROUP BY ALL")(lambda spark, sf_dir: v.unknown_sites(demo.hits(spark, sf_dir), demo.sites(spark).filter("site_id < 3")))
register("missing_stored", "SELECT hit_id FROM missing QUALIFY row_number() OVER (PARTITION BY site_id, local_date ORDER BY ts, hit_id) <= 2")(lambda spark, sf_dir: v.not_found_stored(missing_hits(spark, sf_dir), 2)[0].select("hit_id"))
register("untombstoned", "SELECT site_id, count(*) AS hits FROM ev WHERE site_id <> 1 GROUP BY ALL")(
    lambda spark, sf_dir: v.without_tombstoned(events(spark, sf_dir), demo.sites(spark).filter("site_id = 1")).groupBy("site_id").agg(F.count("*").alias("hits")))
register("short_urls", "SELECT hit_id, 'https://site' || site_id || '.test' || split_part(path, '?', 1) || CASE k % 10 WHEN 0 THEN '?utm_source=News+Letter' WHEN 1 THEN '?gclid=x1' WHEN 2 THEN '?page=2&fbclid=y2' WHEN 3 THEN '?gbraid=z&mtm_src=Z' ELSE '' END AS url FROM hits")(
    lambda spark, sf_dir: demo.hits(spark, sf_dir).select("hit_id", web.bounded(F.col("url"), 50).alias("url")))
register("languages", "SELECT ['de-DE', 'fr', 'en'][hit_id % 3 + 1] AS lang, count(*) AS hits FROM hits GROUP BY ALL")(
    lambda spark, sf_dir: demo.hits(spark, sf_dir).withColumns({"accept": F.get(F.array(F.lit(" de-DE ;q=0.9, en"), F.lit("fr"), F.lit("")), (F.col("hit_id") % 3).cast("int")), "sent": F.lit(" en ")}).groupBy(web.language(F.col("accept"), F.col("sent")).alias("lang")).agg(F.count("*").alias("hits")))
