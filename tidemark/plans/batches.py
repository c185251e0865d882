"""Registered batches of queries, movers of any metric, and the sentences that tell them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batch as b
from ..operators import dashboards
from ..operators import query as q
from ..operators import rollups as r
from ..operators import shaping
from ..operators.requests import session_day_marginals
from ..sinks import facts
from ..streaming.jobs import scratch
from .requests import VISIT_MARGINS
from .queries import BEFORE, EVENT_METRICS, EVENT_METRICS_SQL, NOW, VISIT_METRICS, VISIT_METRICS_SQL, _both, _rounded, events, register

GERMAN = {"dim": "country", "op": "eq", "value": "DE"}
#: An overview as a dashboard asks it: totals, days, and breakdowns of both tables, some filtered, some limited.
OVERVIEW = {
    "totals": b.Query(["visitors", "visits", "pageviews", "bounce_rate", "avg_engagement"]),
    "nothing": b.Query(["pageviews", "visits"], where={"dim": "country", "op": "eq", "value": "XX"}),
    "days": b.Query(["visitors", "pageviews"], by="day"),
    "countries": b.Query([*EVENT_METRICS[:4], *VISIT_METRICS[:4]], ("country",)),
    "pages": b.Query(["pageviews", "visits"], ("path",), limit=5),
    "german_pages": b.Query(["pageviews"], ("path",), where=GERMAN),
    "hours": b.Query(["pageviews"], ("local_hour",), limit=7),
    "entries": b.Query(["visits", "views_per_visit"], ("entry_path", "country")),
}


def _stored_both(spark, sf_dir):
    """Both tables out of a store, so that a batch reads each once."""
    store = facts.create(spark, scratch(spark, "facts"))
    facts.flush(store, 0, events(spark, sf_dir))
    return facts.read(store, "events"), facts.read(store, "visits")


def _nulls(*metrics: str) -> str:
    shown = ["visitors", "pageviews", "events", "outlinks", "visits", "engaged_ms", "engaged_sessions", "avg_engagement", "bounce_rate", "views_per_visit"]
    return ", ".join(m if m in metrics else f"NULL AS {m}" for m in shown)


register("batch_overview", f"""
, e AS (SELECT {EVENT_METRICS_SQL} FROM ev), s AS (SELECT {VISIT_METRICS_SQL} FROM se), ce AS (SELECT country, {EVENT_METRICS_SQL} FROM ev GROUP BY ALL), cs AS (SELECT country, {VISIT_METRICS_SQL} FROM se GROUP BY ALL)
, p AS (SELECT path, count(*) FILTER (type = 'pageview') AS pageviews, count(DISTINCT session_id) FILTER (type <> 'ping') AS visits FROM ev GROUP BY ALL)
, h AS (SELECT local_hour, count(*) FILTER (type = 'pageview') AS pageviews FROM ev GROUP BY ALL)
SELECT 'totals' AS query, NULL AS bucket, NULL AS value, NULL AS value2, {_nulls("visitors", "visits", "pageviews", "bounce_rate", "avg_engagement")}, NULL AS rank FROM e, s
UNION ALL SELECT 'nothing', NULL, NULL, NULL, {_nulls("pageviews", "visits")}, NULL FROM (SELECT 0 AS pageviews, 0 AS visits)
UNION ALL SELECT 'days', local_date, NULL, NULL, {_nulls("visitors", "pageviews")}, NULL FROM (SELECT local_date, {EVENT_METRICS_SQL} FROM ev GROUP BY ALL)
UNION ALL SELECT 'countries', NULL, ce.country, NULL, {_nulls(*EVENT_METRICS[:4], *VISIT_METRICS[:4])}, NULL FROM ce FULL JOIN cs ON ce.country IS NOT DISTINCT FROM cs.country
UNION ALL SELECT 'pages', NULL, path, NULL, {_nulls("pageviews", "visits")}, n FROM (SELECT *, row_number() OVER (ORDER BY pageviews DESC, path) AS n FROM p) WHERE n <= 5
UNION ALL SELECT 'german_pages', NULL, path, NULL, {_nulls("pageviews")}, NULL FROM (SELECT path, count(*) FILTER (type = 'pageview') AS pageviews FROM ev WHERE country = 'DE' GROUP BY ALL)
UNION ALL SELECT 'hours', NULL, local_hour::VARCHAR, NULL, {_nulls("pageviews")}, n FROM (SELECT *, row_number() OVER (ORDER BY pageviews DESC, local_hour) AS n FROM h) WHERE n <= 7
UNION ALL SELECT 'entries', NULL, entry_path, country, {_nulls("visits", "views_per_visit")}, NULL FROM (SELECT entry_path, country, {VISIT_METRICS_SQL} FROM se GROUP BY ALL)""")(
    lambda spark, sf_dir: _rounded(b.batch(*_stored_both(spark, sf_dir), OVERVIEW)))

_DIMS = ("ref_domain", "country", "path")
_movers = lambda metric: " UNION ALL ".join(f"(WITH c AS (SELECT {d} AS value, ({metric}) FILTER (local_date BETWEEN '{NOW[0]}' AND '{NOW[1]}') AS n, ({metric}) FILTER (local_date BETWEEN '{BEFORE[0]}' AND '{BEFORE[1]}') AS p FROM ev WHERE type <> 'ping' GROUP BY ALL HAVING count(*) FILTER (local_date BETWEEN '{BEFORE[0]}' AND '{NOW[1]}') > 0) SELECT '{d}' AS dim, value, n::DOUBLE AS current, p::DOUBLE AS previous, (n - p)::DOUBLE AS delta, round((n - p) / nullif(sum(n - p) OVER (), 0), 6) AS share, row_number() OVER (ORDER BY abs(n - p) DESC, n DESC, value NULLS FIRST) AS rank FROM c QUALIFY rank <= 5)".replace("(count(DISTINCT visitor)) FILTER", "count(DISTINCT visitor) FILTER") for d in _DIMS)
register("movers_of_visitors", f"SELECT * FROM ({_movers('count(DISTINCT visitor)')})")(
    lambda spark, sf_dir: _rounded(b.movers(events(spark, sf_dir).filter("type <> 'ping'"), None, "visitors", _DIMS, NOW, BEFORE, 5)))


@register("change_summaries", f"""
, c AS (SELECT site_id, count(*) FILTER (local_date BETWEEN '{NOW[0]}' AND '{NOW[1]}') AS n, count(*) FILTER (local_date BETWEEN '{BEFORE[0]}' AND '{BEFORE[1]}') AS p FROM se WHERE local_date BETWEEN '{BEFORE[0]}' AND '{NOW[1]}' GROUP BY ALL)
SELECT site_id, n AS current, p AS previous, site_id || CASE WHEN abs((n - p) / p * 100) < 3 THEN ': steady (±' || round(abs((n - p) / p * 100))::INT || '%)' ELSE ': visits ' || CASE WHEN n > p THEN 'up ' ELSE 'down ' END || round(abs((n - p) / p * 100))::INT || '% (' ||
  CASE WHEN p >= 1000 THEN regexp_replace(printf('%.1f', p / 1000), '[.]0$', '') || 'k' ELSE p::VARCHAR END || ' → ' || CASE WHEN n >= 1000 THEN regexp_replace(printf('%.1f', n / 1000), '[.]0$', '') || 'k' ELSE n::VARCHAR END || ')' END AS summary FROM c""")
def change_summaries(spark, sf_dir):
    """Heads without drivers; drivers are tested on written cases."""
    inside = lambda w: F.count_if(F.col("local_date").between(*w))
    totals = _both(spark, sf_dir)[1].filter(F.col("local_date").between(BEFORE[0], NOW[1])).groupBy("site_id").agg(inside(NOW).alias("current"), inside(BEFORE).alias("previous"))
    none = spark.createDataFrame([], "site_id long, dim string, value string, delta double")
    return b.summaries(totals, none, "site_id", "visits")


EVENT_DIMS = ("path", "hostname", "ref_domain", "ref_type", "utm_source", "utm_medium", "utm_campaign", "country", "browser", "device_type", "event_category", "event_action", "event_name")
_VALUES = {**{d: d for d in EVENT_DIMS}, "hostname": "'site' || site_id || '.test'", "event_name": "CASE WHEN event_category = 'shop' THEN 'item' || (k % 5) END"}
_COUNTS = "count(*) AS hits, count(*) FILTER (type <> 'ping') AS actions, count(*) FILTER (type = 'pageview') AS pageviews, count(*) FILTER (type = 'event') AS events, count(*) FILTER (type = 'outlink') AS outlinks, count(*) FILTER (type = 'download') AS downloads, round(coalesce(sum(event_value) FILTER (type = 'event'), 0), 4) AS value_sum, count(DISTINCT visitor) FILTER (type <> 'ping') AS visitors, count(DISTINCT session_id) FILTER (type <> 'ping') AS sessions FROM ev GROUP BY ALL"
register("rollup_event_days", f"SELECT site_id, local_date, 'total' AS dim, NULL::VARCHAR AS value, {_COUNTS}" + "".join(f" UNION ALL SELECT site_id, local_date, '{d}' AS dim, {v} AS value, {_COUNTS}" for d, v in _VALUES.items()))(
    lambda spark, sf_dir: _rounded(r.event_days(events(spark, sf_dir), EVENT_DIMS)))


def rollups(spark, sf_dir) -> r.Rollups:
    e, s = _both(spark, sf_dir)
    return r.Rollups(q.hour_traffic(e), r.event_days(e, EVENT_DIMS), session_day_marginals(s, VISIT_MARGINS), EVENT_DIMS, VISIT_MARGINS)


ROUTED = {
    "hours": (b.Query(["pageviews", "event_value_sum"], ("site_id",), by="hour"), "local_date || ' ' || lpad(local_hour::VARCHAR, 2, '0') || ':00'"),
    "days": (b.Query(["visitors", "pageviews", "visits", "bounce_rate"], ("site_id", "country"), by="day"), "local_date"),
    "weeks": (b.Query(["pageviews", "avg_engagement"], ("ref_type",), by="week", where={"dim": "ref_type", "op": "in", "value": ["search", "campaign"]}), "strftime(date_trunc('week', local_date::DATE), '%Y-%m-%d')"),
}
_day_sql = f"FROM (SELECT local_date, site_id, country, {EVENT_METRICS_SQL} FROM ev GROUP BY ALL) e FULL JOIN (SELECT local_date, site_id, country, {VISIT_METRICS_SQL} FROM se GROUP BY ALL) s ON e.local_date = s.local_date AND e.site_id = s.site_id AND e.country IS NOT DISTINCT FROM s.country"
_week = ROUTED["weeks"][1]
register("rollup_routed", f"""
SELECT 'hours' AS shape, {ROUTED['hours'][1]} AS bucket, site_id::VARCHAR AS value, NULL AS value2, pageviews, event_value_sum, NULL::BIGINT AS visitors, NULL::BIGINT AS visits, NULL::DOUBLE AS bounce_rate, NULL::DOUBLE AS avg_engagement FROM (SELECT local_date, local_hour, site_id, {EVENT_METRICS_SQL} FROM ev GROUP BY ALL)
UNION ALL SELECT 'days', coalesce(e.local_date, s.local_date), coalesce(e.site_id, s.site_id)::VARCHAR, coalesce(e.country, s.country), coalesce(pageviews, 0), NULL, coalesce(visitors, 0), coalesce(visits, 0), bounce_rate, NULL {_day_sql}
UNION ALL SELECT 'weeks', coalesce(e.w, s.w), coalesce(e.ref_type, s.ref_type), NULL, coalesce(pageviews, 0), NULL, NULL, NULL, NULL, avg_engagement
  FROM (SELECT {_week} AS w, ref_type, {EVENT_METRICS_SQL} FROM ev WHERE ref_type IN ('search', 'campaign') GROUP BY ALL) e FULL JOIN (SELECT {_week} AS w, ref_type, {VISIT_METRICS_SQL} FROM se WHERE ref_type IN ('search', 'campaign') GROUP BY ALL) s ON e.w = s.w AND e.ref_type = s.ref_type""")(
    lambda spark, sf_dir: _routed(spark, sf_dir))


def _routed(spark, sf_dir):
    tables, parts = rollups(spark, sf_dir), []
    for shape, (query, _) in ROUTED.items():
        values = [F.col(d).cast("string") for d in query.dims] + [F.lit(None).cast("string")]
        parts.append(r.routed(tables, query).select(F.lit(shape).alias("shape"), "bucket", values[0].alias("value"), values[1].alias("value2"), *query.metrics))
    return _rounded(parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True))


CAMPAIGNS = [("Spring Sale", "2024-01-05", "2024-01-20"), ("Other", "2024-01-01", None)]


def _with_status(spark, sf_dir):
    table = spark.createDataFrame(CAMPAIGNS, "name string, starts_on string, ends_on string")
    return tuple(shaping.campaign_status(rows, table) for rows in _stored_both(spark, sf_dir))


for _board in ("overview", "acquisition", "content", "campaigns", "all-sites"):
    register(f"dashboard_{_board.replace('-', '_')}")(lambda spark, sf_dir, board=_board: _rounded(dashboards.answers(dashboards.SITE[board], *_with_status(spark, sf_dir))["metrics"]))
register("dashboard_of_page_referrers", """SELECT 'refs' AS query, NULL AS bucket, ref_domain AS value, NULL AS value2, visits, row_number() OVER (ORDER BY visits DESC, ref_domain NULLS FIRST) AS rank
FROM (SELECT ref_domain, count(*) AS visits FROM se WHERE session_id IN (SELECT session_id FROM ev WHERE type <> 'ping' AND path = '/p3') GROUP BY ALL) QUALIFY rank <= 8""")(
    lambda spark, sf_dir: dashboards.answers(dashboards.page_detail("/p3"), *_stored_both(spark, sf_dir))["refs"])
register("dashboard_outlinks", "SELECT 'https://out.test/' || (k % 3) AS value, count(*) AS outlinks FROM ev WHERE type = 'outlink' GROUP BY ALL")(
    lambda spark, sf_dir: dashboards.answers(dashboards.SITE["overview"], *_stored_both(spark, sf_dir))["metrics"].filter("query = 'outlinks' AND outlinks > 0").select("value", "outlinks"))
register("dashboard_of_campaign", f"""
, e AS (SELECT {EVENT_METRICS_SQL} FROM ev WHERE utm_campaign = 'spring sale'), s AS (SELECT {VISIT_METRICS_SQL} FROM se WHERE utm_campaign = 'spring sale')
SELECT 'kpis' AS query, NULL AS bucket, NULL AS value, visitors, visits, pageviews, engaged_ms, bounce_rate FROM e, s
UNION ALL SELECT 'trend', local_date, NULL, NULL, count(*), NULL, NULL, NULL FROM se WHERE utm_campaign = 'spring sale' GROUP BY local_date
UNION ALL SELECT 'status', NULL, CASE WHEN local_date BETWEEN '2024-01-05' AND '2024-01-20' THEN 'registered' ELSE 'unregistered' END, NULL, count(*), NULL, NULL, NULL FROM se WHERE utm_campaign = 'spring sale' GROUP BY ALL""")(
    lambda spark, sf_dir: _rounded(dashboards.answers(dashboards.detail("utm_campaign", "spring sale"), *_with_status(spark, sf_dir))["metrics"]).filter("query IN ('kpis', 'trend', 'status')").select("query", "bucket", "value", "visitors", "visits", "pageviews", "engaged_ms", "bounce_rate"))
