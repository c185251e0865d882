"""Registered queries over whose visits, which sites and buckets a request names, and over repaired visits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import query as q
from ..operators import repair
from ..operators import requests as r
from ..operators import visits as v
from ..sources import demo
from .queries import BUY, EVENT_METRICS, EVENT_METRICS_SQL, HITS_SQL, _both, _rounded, events, register

register("events_of_buying_visits", f"SELECT local_date AS bucket, {EVENT_METRICS_SQL} FROM ev WHERE session_id IN (SELECT session_id FROM ev WHERE type <> 'ping' AND event_action = 'purchase') GROUP BY ALL")(
    lambda spark, sf_dir: _rounded(q.metric(r.of_visits_with(*_both(spark, sf_dir), BUY), None, EVENT_METRICS, by="day")))
for _end in ("entry_path", "exit_path"):
    register(f"pages_by_{_end}", f"SELECT path, count(*) FILTER (type = 'pageview') AS pageviews FROM ev WHERE session_id IN (SELECT session_id FROM se WHERE {_end} = '/p3') GROUP BY ALL")(
        lambda spark, sf_dir, end=_end: q.metric(r.of_visits_with(*_both(spark, sf_dir), {"dim": end, "op": "eq", "value": "/p3"}), None, ["pageviews"], ("path",)))
VISIT_MARGINS = ("ref_domain", "ref_type", "utm_source", "utm_medium", "utm_campaign", "country", "browser", "device_type", "entry_path", "exit_path")
_counts = "count(*) AS visits, count(*) FILTER (engaged_ms > 0) AS measured, sum(engaged_ms)::BIGINT AS engaged_ms, count(*) FILTER (pageviews = 1 AND events = 0 AND engaged_ms < 15000) AS bounced, sum(pageviews)::BIGINT AS views FROM se GROUP BY ALL"
register("rollup_session_day_marginals", f"SELECT site_id, local_date, 'total' AS dim, NULL::VARCHAR AS value, {_counts}" + "".join(f" UNION ALL SELECT site_id, local_date, '{d}' AS dim, {d} AS value, {_counts}" for d in VISIT_MARGINS))(
    lambda spark, sf_dir: r.session_day_marginals(_both(spark, sf_dir)[1], VISIT_MARGINS))
register("typical_day", ", d AS (SELECT local_date, count(*) AS visits, sum(pageviews) AS views FROM se GROUP BY ALL) SELECT round(avg(visits), 4) AS visits, round(sum(views) / sum(visits), 4) AS views_per_visit FROM d")(
    lambda spark, sf_dir: r.typical(q.metric(None, _both(spark, sf_dir)[1], ["visits", "views_per_visit"], by="day"), ["visits", "views_per_visit"]).select(*[F.round(c, 4).alias(c) for c in ("visits", "views_per_visit")]))
register("views_a_visitor", "SELECT local_date AS bucket, round(count(*) FILTER (type = 'pageview') / nullif(count(DISTINCT visitor) FILTER (type <> 'ping'), 0), 6) AS views_a_visitor FROM ev GROUP BY ALL")(
    lambda spark, sf_dir: r.derived(q.metric(events(spark, sf_dir), None, ["pageviews", "visitors"], by="day"), "views_a_visitor", ("/", "pageviews", "visitors"), "day").select("bucket", F.round("views_a_visitor", 6).alias("views_a_visitor")))
DAY = "2024-01-15"
register("one_day", f"SELECT local_date || ' ' || lpad(local_hour::VARCHAR, 2, '0') || ':00' AS bucket, count(*) FILTER (type = 'pageview') AS pageviews FROM ev WHERE local_date = '{DAY}' GROUP BY ALL")(
    lambda spark, sf_dir: q.metric(events(spark, sf_dir).filter(F.col("local_date") == DAY), None, ["pageviews"], by=r.bucket_for("day", DAY, DAY)))
register("allowed_sites", "SELECT site_id, count(*) AS visits FROM se WHERE site_id IN (1, 3) GROUP BY ALL")(
    lambda spark, sf_dir: q.metric(None, _both(spark, sf_dir)[1].join(r.sites_in_scope(demo.sites(spark), "all", [1, 3]).select("site_id"), "site_id", "left_semi"), ["visits"], ("site_id",)))

#: Views of /p11 stand for old views of missing pages; all visits are over by then.
LATER = 1_900_000_000_000
REPAIR_SQL = """
, f AS (SELECT *, type = 'pageview' AND starts_with(path, '/p11') AS flag FROM ev)
, m AS (SELECT *, coalesce(last_value(CASE WHEN type = 'pageview' THEN flag END IGNORE NULLS) OVER o, false) AS gone,
    last_value(CASE WHEN type = 'pageview' AND NOT flag THEN path END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f WINDOW o AS (PARTITION BY session_id ORDER BY seq))
, hit AS (SELECT session_id, bool_or(gone) AS hit, count(*) FILTER (type = 'pageview' AND NOT gone) AS pages FROM m GROUP BY session_id)
, kept AS (SELECT m.*, least(greatest(ts - lag(ts) OVER (PARTITION BY session_id ORDER BY seq), 0), 20000) AS step FROM m JOIN hit USING (session_id) WHERE NOT gone AND (NOT hit OR pages > 0))
"""


def _moved(spark, sf_dir):
    return repair.move_missing(events(spark, sf_dir), F.col("path").startswith("/p11"), LATER)


register("repaired_visits", REPAIR_SQL + "SELECT session_id, count(*) FILTER (type = 'pageview') AS pageviews, coalesce(sum(step), 0)::BIGINT AS engaged_ms, max(ts) AS last_seen_at, arg_min(path, seq) FILTER (type = 'pageview') AS first_page, arg_max(path, seq) FILTER (type = 'pageview') AS exit_path FROM kept GROUP BY session_id")(
    lambda spark, sf_dir: v.sessions(_moved(spark, sf_dir)[0]).join(_moved(spark, sf_dir)[0].filter("type = 'pageview'").groupBy("session_id").agg(F.min_by("path", "seq").alias("first_page")), "session_id", "left").select("session_id", "pageviews", F.col("engaged_ms").cast("long").alias("engaged_ms"), "last_seen_at", "first_page", "exit_path"))
register("moved_missing", REPAIR_SQL + "SELECT hit_id, before IS NOT NULL AS inside, split_part(before, '?', 1) AS ref_path FROM m WHERE gone AND flag")(
    lambda spark, sf_dir: _moved(spark, sf_dir)[1].select("hit_id", F.col("ref_path").isNotNull().alias("inside"), "ref_path"))


FORMULA = "100 * (events + outlinks) / (pageviews - 05) + 0.5"


@register("formula_by_country", ", d AS (SELECT country, count(*) FILTER (type = 'pageview') AS p, count(*) FILTER (type = 'event') AS e, count(*) FILTER (type = 'outlink') AS o FROM ev GROUP BY ALL) SELECT country, round(100 * (e + o) / nullif(p - 5, 0) + 0.5, 6) AS made FROM d")
def formula_by_country(spark, sf_dir):
    tree = r.formula(FORMULA)
    return r.derived(q.metric(events(spark, sf_dir), None, r.metrics_of(tree), ("country",)), "made", tree).select("country", F.round("made", 6).alias("made"))
