"""Registered queries over rollups and shaped results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import query as q
from ..operators import rollups as r
from ..operators import shaping as s
from ..sources import demo
from .queries import BEFORE, BUY, NOW, _both, _rounded, events, register

HOUR_SQL = "SELECT site_id, local_date, local_hour, count(*) AS hits, count(*) FILTER (type <> 'ping') AS actions, count(*) FILTER (type = 'pageview') AS pageviews, count(*) FILTER (type = 'event') AS events, count(*) FILTER (type = 'outlink') AS outlinks, count(*) FILTER (type = 'download') AS downloads, round(coalesce(sum(event_value), 0), 4) AS value_sum FROM ev"


@register("rollup_merge", HOUR_SQL + " GROUP BY ALL")
def rollup_merge(spark, sf_dir):
    """Two batches, the second merged into the first."""
    e = events(spark, sf_dir)
    first, second = (q.hour_traffic(e.filter(F.col("hit_id") % 2 == n)) for n in (0, 1))
    return _rounded(r.merged(first, second, r.HOUR_KEYS))


@register("rollup_correct", HOUR_SQL + " WHERE country IS DISTINCT FROM 'DE' GROUP BY ALL")
def rollup_correct(spark, sf_dir):
    """Rows of one country leave the rollup again."""
    e = events(spark, sf_dir)
    gone = q.hour_traffic(e.filter("country = 'DE'"))
    return _rounded(r.corrected(q.hour_traffic(e), gone, gone.limit(0), r.HOUR_KEYS))


@register("rollup_differences", "SELECT site_id, local_date, local_hour, 'pageviews' AS counter, count(*) FILTER (type = 'pageview') + 1.0 AS stored, count(*) FILTER (type = 'pageview')::DOUBLE AS fresh FROM ev GROUP BY site_id, local_date, local_hour HAVING local_hour = 3")
def rollup_differences(spark, sf_dir):
    """A rollup whose page views are one too many at three o'clock, held against the events."""
    fresh = q.hour_traffic(events(spark, sf_dir))
    stored = fresh.withColumn("pageviews", F.col("pageviews") + F.when(F.col("local_hour") == 3, 1).otherwise(0))
    return r.differences(stored, fresh, r.HOUR_KEYS)


@register("rollup_rebuilt", HOUR_SQL + " GROUP BY ALL")
def rollup_rebuilt(spark, sf_dir):
    e = events(spark, sf_dir)
    fresh = q.hour_traffic(e)
    stored = fresh.withColumn("pageviews", F.col("pageviews") + F.when(F.col("local_hour") == 3, 1).otherwise(0))
    return _rounded(r.rebuilt(stored, e, r.differences(stored, fresh, r.HOUR_KEYS)))


for _bucket, _key in (("hour", "local_date || ' ' || lpad(local_hour::VARCHAR, 2, '0') || ':00'"), ("week", "strftime(date_trunc('week', local_date::DATE), '%Y-%m-%d')")):
    register(f"rollup_answer_{_bucket}", f"SELECT {_key} AS bucket, site_id, count(*) FILTER (type = 'pageview') AS pageviews, count(*) FILTER (type = 'event') AS events, round(coalesce(sum(event_value), 0), 4) AS event_value_sum FROM ev GROUP BY ALL")(
        lambda spark, sf_dir, b=_bucket: _rounded(r.answer(q.hour_traffic(events(spark, sf_dir)), ["pageviews", "events", "event_value_sum"], ("site_id",), b)))


@register("densified_hours", """
, d AS (SELECT site_id, strftime(t, '%Y-%m-%d %H:00') AS bucket FROM (SELECT unnest([1, 2, 3]) AS site_id), (SELECT unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-12 23:00', INTERVAL 1 HOUR)) AS t))
, p AS (SELECT site_id, local_date || ' ' || lpad(local_hour::VARCHAR, 2, '0') || ':00' AS bucket, count(*) FILTER (type = 'pageview') AS pageviews FROM ev GROUP BY ALL)
SELECT site_id, bucket, coalesce(pageviews, 0) AS pageviews FROM d LEFT JOIN p USING (site_id, bucket)""")
def densified_hours(spark, sf_dir):
    counted = q.metric(events(spark, sf_dir), None, ["pageviews"], ("site_id",), by="hour")
    return s.densified(counted, s.hour_axis(demo.sites(spark), "2024-01-10", "2024-01-12"), ["site_id", "bucket"], ["pageviews"])


@register("period_deltas", f"""
, c AS (SELECT country, count(*) FILTER (local_date BETWEEN '{NOW[0]}' AND '{NOW[1]}') AS now, count(*) FILTER (local_date BETWEEN '{BEFORE[0]}' AND '{BEFORE[1]}') AS before FROM se GROUP BY ALL)
SELECT country, now AS current, before AS previous, CASE WHEN before > 0 AND now <> 0 THEN round((now - before) / before * 100, 4) END AS delta FROM c""")
def period_deltas(spark, sf_dir):
    inside = lambda w: F.count_if(F.col("local_date").between(*w))
    both = _both(spark, sf_dir)[1].groupBy("country").agg(inside(NOW).alias("current"), inside(BEFORE).alias("previous"))
    return both.withColumn("delta", F.round(s.delta("count", F.col("current"), F.col("previous")), 4))


register("device_shares", """
, c AS (SELECT nullif(device_type, 'other') AS device_type, count(*) AS visits FROM se GROUP BY 1), k AS (SELECT CASE WHEN bool_or(device_type IS NULL) OR count(device_type) > 3 THEN 2 ELSE 3 END AS keep FROM c), t AS (SELECT device_type AS top FROM c, k WHERE device_type IS NOT NULL QUALIFY row_number() OVER (ORDER BY visits DESC, device_type) <= any_value(keep) OVER ())
, n AS (SELECT coalesce(top, 'Other') AS device_type, sum(visits)::BIGINT AS visits FROM c LEFT JOIN t ON device_type = top GROUP BY ALL)
SELECT device_type, visits, round(visits / sum(visits) OVER (), 6) AS share, row_number() OVER (ORDER BY device_type = 'Other', visits DESC, device_type) AS rank FROM n""")(
    lambda spark, sf_dir: _rounded(s.folded_shares(q.metric(None, _both(spark, sf_dir)[1], ["visits"], ("device_type",)), "device_type", "visits")))
register("rate_and_time_deltas", f"""
, c AS (SELECT country, round(avg((pageviews = 1 AND events = 0 AND engaged_ms < 15000)::INT) FILTER (local_date >= '{NOW[0]}') * 100 - avg((pageviews = 1 AND events = 0 AND engaged_ms < 15000)::INT) FILTER (local_date < '{NOW[0]}') * 100, 4) AS bounce_points,
    round((sum(engaged_ms) FILTER (local_date >= '{NOW[0]}') - sum(engaged_ms) FILTER (local_date < '{NOW[0]}'))::DOUBLE, 4) AS engaged_change FROM se WHERE local_date BETWEEN '{BEFORE[0]}' AND '{NOW[1]}' GROUP BY ALL) SELECT * FROM c""")(
    lambda spark, sf_dir: _rate_deltas(spark, sf_dir))


def _rate_deltas(spark, sf_dir):
    visits = _both(spark, sf_dir)[1]
    now, before = (q.metric(None, visits.filter(F.col("local_date").between(*w)), ["bounce_rate", "engaged_ms"], ("country",)).toDF("country", "b", "e") for w in (NOW, BEFORE))
    both = now.alias("n").join(before.alias("p"), F.col("n.country").eqNullSafe(F.col("p.country")), "full_outer")
    shown = {"bounce_points": s.delta("rate", F.col("n.b"), F.col("p.b")), "engaged_change": s.delta("ms", F.col("n.e"), F.col("p.e")).cast("double")}
    return both.select(F.coalesce("n.country", "p.country").alias("country"), *[F.round(c, 4).alias(k) for k, c in shown.items()])


register("week_grid", """
, c AS (SELECT dayofweek(local_date::DATE) AS weekday, local_hour, count(*) AS n FROM ev WHERE type = 'pageview' GROUP BY ALL)
, s AS (SELECT list(n ORDER BY n) AS a, count(*) AS m FROM c)
, l AS (SELECT c.*, greatest(len(list_filter([a[floor((m - 1) * 0.2)::INT + 1], a[floor((m - 1) * 0.4)::INT + 1], a[floor((m - 1) * 0.6)::INT + 1], a[floor((m - 1) * 0.8)::INT + 1], a[floor((m - 1) * 0.93)::INT + 1]], lambda x: n >= x)), 1) AS level FROM c, s)
, g AS (SELECT unnest(range(168)) AS id)
SELECT (id // 24)::INT AS weekday, (id % 24)::INT AS local_hour, coalesce(n, 0) AS pageviews, coalesce(level, 0)::INT AS level FROM g LEFT JOIN l ON l.weekday = id // 24 AND l.local_hour = id % 24""")(
    lambda spark, sf_dir: s.week_grid(events(spark, sf_dir)))
register("feed_runs", """
, a AS (SELECT *, ts - lag(ts) OVER w AS g, lag(path) OVER w AS before, lead(ts) OVER w AS after FROM ev WINDOW w AS (PARTITION BY site_id, visitor ORDER BY ts, hit_id))
, b AS (SELECT *, g IS NULL OR g > 1800000 OR before IS DISTINCT FROM path AS new FROM a)
, c AS (SELECT *, sum(new::INT) OVER (PARTITION BY site_id, visitor ORDER BY ts, hit_id ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT site_id, visitor, run::BIGINT AS run, any_value(path) AS path, min(ts) AS started, max(ts) AS ended, nullif(sum(coalesce(least(greatest(after - ts, 0), 20000), 0)), 0)::BIGINT AS page_ms, count(*) FILTER (type <> 'ping') AS actions FROM c GROUP BY ALL""")(
    lambda spark, sf_dir: s.feed_runs(events(spark, sf_dir)))
register("journey_columns", """
, edges AS (SELECT n AS step, label AS "from", lead(label) OVER (PARTITION BY session_id ORDER BY n) AS "to" FROM steps), e AS (SELECT step, "from", "to", count(*) AS sessions FROM edges WHERE "to" IS NOT NULL AND step <= 3 GROUP BY ALL)
, n AS (SELECT step, "from", greatest(sum(o), sum(i)) AS n FROM (SELECT step, "from", sessions AS o, 0 AS i FROM e UNION ALL SELECT step + 1, "to", 0, sessions FROM e) GROUP BY step, "from")
, m AS (SELECT *, CASE WHEN starts_with("from", 'event: ') OR (n / sum(n) OVER (PARTITION BY step) >= 0.04 AND row_number() OVER (PARTITION BY step ORDER BY n DESC, "from") <= 8) THEN "from" ELSE 'Other' END AS shown FROM n)
, f AS (SELECT e.step, m.shown AS "from", coalesce(t.shown, e."to") AS "to", sum(sessions)::BIGINT AS sessions FROM e JOIN m ON e.step = m.step AND e."from" = m."from" LEFT JOIN m t ON t.step = e.step + 1 AND t."from" = e."to" GROUP BY ALL)
SELECT *, round(sessions / sum(sessions) OVER (PARTITION BY step), 6) AS share FROM f""")(
    lambda spark, sf_dir: _rounded(s.journey_columns(q.transitions(events(spark, sf_dir), limit=None))))


@register("campaign_status", "SELECT CASE WHEN utm_campaign IS NULL THEN 'untagged' WHEN local_date BETWEEN '2024-01-05' AND '2024-01-20' THEN 'registered' ELSE 'unregistered' END AS campaign_status, count(*) AS hits FROM ev GROUP BY ALL")
def campaign_status(spark, sf_dir):
    table = spark.createDataFrame([("Spring Sale", "2024-01-05", "2024-01-20"), ("Other", "2024-01-01", None)], "name string, starts_on string, ends_on string")
    return s.campaign_status(events(spark, sf_dir), table).groupBy("campaign_status").agg(F.count("*").alias("hits"))


@register("realiased_sources", """
SELECT hit_id, CASE WHEN utm_source = 'google' AND site_id = 2 THEN 'search ads' WHEN utm_source = 'google' THEN 'ads' ELSE utm_source END AS utm_source, CASE WHEN utm_source = 'google' THEN 'google' END AS utm_source_raw FROM ev""")
def realiased_sources(spark, sf_dir):
    """Applied twice: a second pass over its own rows changes nothing."""
    table = spark.createDataFrame([(0, "utm_source", "google", "ads"), (2, "utm_source", "google", "search ads")], "site_id long, field string, alias string, canonical string")
    e = events(spark, sf_dir).withColumn("utm_source_raw", F.lit(None).cast("string"))
    return s.realiased(s.realiased(e, table), table).select("hit_id", "utm_source", "utm_source_raw")


@register("retained_days", "SELECT local_date, count(*) AS hits FROM ev WHERE local_date >= '2024-01-17' GROUP BY ALL")
def retained_days(spark, sf_dir):
    return s.retained(events(spark, sf_dir), 14, "2024-01-31")[0].groupBy("local_date").agg(F.count("*").alias("hits"))


@register("alerts", f"""
, m AS (SELECT site_id, count(*) FILTER (local_date BETWEEN '{NOW[0]}' AND '{NOW[1]}') AS now, count(*) FILTER (local_date BETWEEN '{BEFORE[0]}' AND '{BEFORE[1]}') AS before FROM se GROUP BY ALL)
SELECT rule_id, site_id, now AS current FROM m JOIN (VALUES (1, 1), (2, 2), (3, 3), (4, 1)) t(rule_id, site) ON site = site_id
WHERE (rule_id = 1 AND now > 10) OR (rule_id = 2 AND now < 5) OR (rule_id = 3 AND abs((now - before) / before * 100) >= 1)""")
def alerts(spark, sf_dir):
    inside = lambda w: F.count_if(F.col("local_date").between(*w))
    measured = _both(spark, sf_dir)[1].groupBy("site_id").agg(inside(NOW).alias("current"), inside(BEFORE).alias("previous")).withColumn("metric", F.lit("visits"))
    rules = spark.createDataFrame([(1, 1, "visits", "above", 10.0), (2, 2, "visits", "below", 5.0), (3, 3, "visits", "delta_pct", 1.0), (4, 1, "visits", "above", 0.0)], "rule_id int, site_id long, metric string, kind string, bound double")
    fired = spark.createDataFrame([(4, 1_000_000)], "rule_id int, fired_at long")
    return s.alerts(measured, rules, fired, now_ms=1_060_000).select("rule_id", "site_id", "current")


@register("derived_metric", "SELECT country, round(coalesce(sum(event_value) FILTER (type = 'event'), 0) / nullif(count(DISTINCT visitor) FILTER (type <> 'ping'), 0), 4) AS value FROM ev GROUP BY ALL")
def derived_metric(spark, sf_dir):
    """Value for each visitor: arithmetic over metrics after they are aggregated; division by zero is null."""
    base = q.metric(events(spark, sf_dir), None, ["event_value_sum", "visitors"], ("country",))
    return base.select("country", F.round(F.try_divide("event_value_sum", "visitors"), 4).alias("value"))


@register("goal_by_country", "SELECT country, count(DISTINCT session_id) AS conversions FROM ev WHERE event_action = 'purchase' AND type <> 'ping' GROUP BY ALL")
def goal_by_country(spark, sf_dir):
    return events(spark, sf_dir).filter("type != 'ping'").filter(q.predicate(BUY)).groupBy("country").agg(F.count_distinct("session_id").alias("conversions"))
