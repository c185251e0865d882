"""Registered queries over the derived hits, each with the SQL that gives the same rows.

The SQL derives every enriched value straight from the `events` columns, not through URLs, so it
checks the URL, referrer and campaign functions too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import query as q
from ..operators import visits as v
from ..sources import demo

HITS_SQL = """
WITH raw AS (
  SELECT event_id AS hit_id, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, user_id // 5 AS v, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts, event_type AS et, value, event_id AS i FROM events
), hits AS (
  SELECT hit_id, k, v AS visitor, 1 + v % 3 AS site_id, ts, i, et = 'view' AND i % 37 = 0 AS not_found,
    CASE WHEN et = 'view' THEN 'pageview' WHEN et IN ('purchase', 'signup') THEN 'event' WHEN et = 'error' THEN 'ping' ELSE ['outlink', 'pageview', 'download'][i % 3 + 1] END AS type,
    CASE WHEN et = 'view' AND i % 37 = 0 THEN '/old' || (k % 4) ELSE '/p' || (k % 12) END || CASE WHEN k % 10 = 2 THEN '?page=2' ELSE '' END AS path,
    CASE WHEN et = 'purchase' THEN 'shop' WHEN et = 'signup' AND i % 4 = 0 THEN 'scroll' WHEN et = 'signup' THEN 'account' END AS event_category,
    CASE WHEN et = 'purchase' THEN 'purchase' WHEN et = 'signup' AND i % 4 = 0 THEN 'read' WHEN et = 'signup' THEN 'signup' END AS event_action,
    CASE WHEN et = 'purchase' THEN value END AS event_value, CASE WHEN et = 'error' THEN k END AS scroll_pct,
    CASE WHEN v % 7 <> 0 THEN ['US', 'DE', 'JP', 'BR'][v % 4 + 1] END AS country, ['Chrome', 'Firefox', 'Safari'][v % 3 + 1] AS browser, ['desktop', 'mobile', 'tablet', 'other'][v % 4 + 1] AS device_type,
    ['free', 'pro', 'team'][k % 3 + 1] AS plan, k % 2 = 0 AS beta,
    CASE WHEN k % 10 = 0 THEN 'news letter' WHEN k % 10 = 1 THEN 'google' WHEN k % 10 = 2 THEN 'facebook' WHEN k % 10 = 3 THEN 'z' END AS utm_source0,
    CASE WHEN k % 10 = 0 THEN 'e-mail' WHEN k % 10 = 1 THEN 'cpc' WHEN k % 10 = 2 THEN 'social' END AS utm_medium0,
    CASE WHEN k % 10 = 0 THEN 'spring sale' END AS utm_campaign0,
    ['direct', 'search', 'social', 'social', 'internal', 'referral', 'referral', 'internal', 'social'][i % 9 + 1] AS ref_kind0, CASE WHEN k % 10 < 4 THEN 'campaign' ELSE ref_kind0 END AS ref_type0,
    [NULL, 'google.com', 'facebook.com', 'twitter.com', 'site' || (1 + v % 3) || '.test', 'writer.co.uk', '203.0.113.9', 'site' || (1 + v % 3) || '.test', 'news.ycombinator.com'][i % 9 + 1] AS ref_domain0,
    [NULL, '/search', '/p', '/abc', '/', '/post', '/x', '/help', '/item'][i % 9 + 1] AS ref_path0,
    make_timestamp(ts * 1000) + CASE v % 3 WHEN 0 THEN INTERVAL '-5 hours' WHEN 1 THEN INTERVAL '0 hours' ELSE INTERVAL '9 hours' END AS local
  FROM raw
), zoned AS (
  SELECT *, strftime(local, '%Y-%m-%d') AS local_date, hour(local) AS local_hour FROM hits
), m1 AS (
  SELECT *, type = 'ping' OR coalesce(event_category = 'scroll' AND event_action = 'read', false) AS weak FROM zoned WHERE NOT not_found
), m2 AS (
  SELECT *, sum(CASE WHEN weak THEN 0 ELSE 1 END) OVER (PARTITION BY visitor ORDER BY ts, hit_id ROWS UNBOUNDED PRECEDING) AS grp, ts - lag(ts) OVER (PARTITION BY visitor ORDER BY ts, hit_id) AS gap FROM m1
), m3 AS (
  SELECT *, weak AND (grp = 0 OR max(CASE WHEN weak AND coalesce(gap, 0) > 14400000 THEN 1 ELSE 0 END) OVER (PARTITION BY visitor, grp ORDER BY ts, hit_id ROWS UNBOUNDED PRECEDING) = 1) AS lost FROM m2
), m4 AS (
  SELECT * EXCLUDE (gap), ts - lag(ts) OVER (PARTITION BY visitor ORDER BY ts, hit_id) AS gap FROM m3 WHERE NOT lost
), m5 AS (
  SELECT *, gap IS NULL OR (type = 'pageview' AND gap > 1800000) OR gap > 14400000 AS is_start FROM m4
), m6 AS (
  SELECT *, sum(is_start::INT) OVER (PARTITION BY visitor ORDER BY ts, hit_id ROWS UNBOUNDED PRECEDING) AS visit FROM m5
), ev AS (
  SELECT *, row_number() OVER w AS seq, substr(sha256(concat_ws(':', site_id, visitor, first(hit_id) OVER w)), 1, 16) AS session_id,
    CASE WHEN is_start THEN 0 ELSE least(greatest(gap, 0), 20000) END AS engaged_step,
    first(ref_type0) OVER w AS ref_type, first(ref_domain0) OVER w AS ref_domain, first(utm_source0) OVER w AS utm_source, first(utm_medium0) OVER w AS utm_medium, first(utm_campaign0) OVER w AS utm_campaign
  FROM m6 WINDOW w AS (PARTITION BY visitor, visit ORDER BY ts, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), se AS (
  SELECT session_id, any_value(site_id) AS site_id, any_value(visitor) AS visitor, arg_min(local_date, seq) AS local_date, arg_min(local_hour, seq) AS local_hour, any_value(ref_type) AS ref_type,
    max(ref_domain) AS ref_domain, max(utm_source) AS utm_source, max(utm_medium) AS utm_medium, max(utm_campaign) AS utm_campaign, max(country) AS country, max(browser) AS browser, max(device_type) AS device_type,
    min(ts) AS started_at, max(ts) AS last_seen_at, count(*) FILTER (type = 'pageview') AS pageviews,
    count(*) FILTER (type = 'event' AND NOT coalesce(event_category = 'scroll' AND event_action = 'read', false)) AS events, sum(engaged_step)::BIGINT AS engaged_ms,
    arg_min(path, seq) AS entry_path, arg_max(path, seq) FILTER (type = 'pageview') AS exit_path
  FROM ev GROUP BY session_id
), missing AS (
  SELECT hit_id, site_id, ts, local_date, local_hour, path, ref_kind0 AS ref_type, ref_domain0 AS ref_domain, ref_path0 AS ref_path, device_type, country FROM zoned WHERE not_found
), labelled AS (
  SELECT session_id, seq, coalesce(CASE WHEN type = 'event' THEN 'event: ' || event_category || ' · ' || event_action ELSE path END, '') AS label FROM ev WHERE type <> 'ping'
), ends AS (
  SELECT *, lead(label) OVER (PARTITION BY session_id ORDER BY seq) AS next FROM labelled
), steps AS (
  SELECT session_id, label, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM ends WHERE next IS NULL OR next <> label
), walked AS (
  SELECT *, sum((type = 'pageview')::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS page, lead(ts) OVER (PARTITION BY session_id ORDER BY seq) - ts AS leg FROM ev
), legs AS (
  SELECT session_id, page, arg_min(path, seq) AS path, sum(CASE WHEN leg IS NOT NULL THEN least(leg, 20000) END)::BIGINT AS ms, max(scroll_pct) AS scroll FROM walked WHERE page > 0 GROUP BY session_id, page
)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = demo.hits(spark, sf_dir)
    return v.sessionize(v.enrich(hits, demo.sites(spark)), of=hits)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = HITS_SQL + sql
        return f

    return add


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir)
    return e, v.sessions(e)


@register("events", "SELECT hit_id, site_id, visitor, ts, local_date, local_hour, type, path, session_id, seq, ref_type, ref_domain, utm_source, utm_medium, utm_campaign, engaged_step::BIGINT AS engaged_step, country FROM ev")
def stored_events(spark, sf_dir):
    return events(spark, sf_dir).select("hit_id", "site_id", "visitor", "ts", "local_date", "local_hour", "type", "path", "session_id", "seq", *v.FIRST_TOUCH, F.col("engaged_step").cast("long").alias("engaged_step"), "country")


@register("sessions", "SELECT * FROM se")
def stored_sessions(spark, sf_dir):
    return _both(spark, sf_dir)[1]


@register("missing_hits", "SELECT * FROM missing")
def missing_hits(spark, sf_dir):
    return v.not_found(v.enrich(demo.hits(spark, sf_dir), demo.sites(spark)))


EVENT_METRICS_SQL = "count(DISTINCT visitor) FILTER (type <> 'ping') AS visitors, count(*) FILTER (type = 'pageview') AS pageviews, count(*) FILTER (type = 'event') AS events, count(*) FILTER (type = 'outlink') AS outlinks, count(*) FILTER (type = 'download') AS downloads, round(coalesce(sum(event_value) FILTER (type = 'event'), 0), 4) AS event_value_sum"
VISIT_METRICS_SQL = "count(*) AS visits, sum(engaged_ms)::BIGINT AS engaged_ms, count(*) FILTER (engaged_ms > 0) AS engaged_sessions, round(sum(engaged_ms) / nullif(count(*) FILTER (engaged_ms > 0), 0), 6) AS avg_engagement, round(count(*) FILTER (pageviews = 1 AND events = 0 AND engaged_ms < 15000) / count(*), 6) AS bounce_rate, round(sum(pageviews) / count(*), 6) AS views_per_visit"
EVENT_METRICS = ["visitors", "pageviews", "events", "outlinks", "downloads", "event_value_sum"]
VISIT_METRICS = ["visits", "engaged_ms", "engaged_sessions", "avg_engagement", "bounce_rate", "views_per_visit"]


def _rounded(df: DataFrame) -> DataFrame:
    digits = {"event_value_sum": 4, "value_sum": 4, "avg_engagement": 6, "bounce_rate": 6, "views_per_visit": 6, "rate": 6, "share": 6, "mean_ms": 4, "mean_scroll": 4, "avg_engaged": 4, "exit_rate": 6, "value": 4}
    return df.withColumns({c: F.round(c, digits[c]) for c, t in df.dtypes if c in digits and t == "double"})


for _dim in ("country", "ref_type", "ref_domain", "utm_source", "browser", "device_type", "site_id", "utm_medium", "utm_campaign"):
    register(f"metrics_by_{_dim}", f"""
, e AS (SELECT {_dim}, {EVENT_METRICS_SQL} FROM ev GROUP BY ALL), s AS (SELECT {_dim}, {VISIT_METRICS_SQL} FROM se GROUP BY ALL)
SELECT e.{_dim}, {', '.join(EVENT_METRICS)}, {', '.join(VISIT_METRICS)} FROM e FULL JOIN s ON e.{_dim} IS NOT DISTINCT FROM s.{_dim}""")(
        lambda spark, sf_dir, d=_dim: _rounded(q.metric(*_both(spark, sf_dir), EVENT_METRICS + VISIT_METRICS, (d,))))

for _bucket, _key in (("hour", "local_date || ' ' || lpad(local_hour::VARCHAR, 2, '0') || ':00'"), ("day", "local_date"), ("week", "strftime(date_trunc('week', local_date::DATE), '%Y-%m-%d')"), ("month", "substr(local_date, 1, 7)")):
    register(f"metrics_by_{_bucket}_and_site", f"SELECT {_key} AS bucket, site_id, {EVENT_METRICS_SQL} FROM ev GROUP BY ALL")(
        lambda spark, sf_dir, b=_bucket: _rounded(q.metric(events(spark, sf_dir), None, EVENT_METRICS, ("site_id",), by=b)))

register("metrics_total", f"SELECT {EVENT_METRICS_SQL} FROM ev")(lambda spark, sf_dir: _rounded(q.metric(events(spark, sf_dir), None, EVENT_METRICS)))
register("metrics_by_path_top10", "SELECT path, count(*) FILTER (type = 'pageview') AS pageviews, count(DISTINCT session_id) FILTER (type <> 'ping') AS visits FROM ev GROUP BY path ORDER BY pageviews DESC, path LIMIT 10")(
    lambda spark, sf_dir: q.metric(*_both(spark, sf_dir), ["pageviews", "visits"], ("path",), limit=10))
register("metrics_by_entry_and_exit", "SELECT entry_path, exit_path, count(*) AS visits FROM se GROUP BY ALL")(lambda spark, sf_dir: q.metric(None, _both(spark, sf_dir)[1], ["visits"], ("entry_path", "exit_path")))
register("metrics_by_prop_plan", "SELECT CASE WHEN type IN ('pageview', 'event') THEN plan END AS \"prop:plan\", count(*) FILTER (type = 'pageview') AS pageviews FROM ev GROUP BY ALL")(lambda spark, sf_dir: q.metric(events(spark, sf_dir), None, ["pageviews"], ("prop:plan",)))
register("metrics_by_prop_beta", "SELECT CASE WHEN type IN ('pageview', 'event') THEN beta::INT::VARCHAR END AS \"prop:beta\", count(*) FILTER (type = 'pageview') AS pageviews FROM ev GROUP BY ALL")(lambda spark, sf_dir: q.metric(events(spark, sf_dir), None, ["pageviews"], ("prop:beta",)))
register("heatmap", "SELECT dayofweek(local_date::DATE) AS weekday, local_hour, count(*) FILTER (type = 'pageview') AS pageviews FROM ev GROUP BY ALL")(lambda spark, sf_dir: q.metric(events(spark, sf_dir), None, ["pageviews"], ("weekday", "local_hour")))

FILTERS = {
    "eq": ({"dim": "country", "op": "eq", "value": "DE"}, "country = 'DE'"), "neq": ({"dim": "country", "op": "neq", "value": "DE"}, "country IS DISTINCT FROM 'DE'"),
    "in": ({"dim": "browser", "op": "in", "value": ["Chrome", "Safari"]}, "browser IN ('Chrome', 'Safari')"), "contains": ({"dim": "utm_source", "op": "contains", "value": "S L"}, "contains(utm_source, 's l')"),
    "starts": ({"dim": "path", "op": "starts", "value": "/P1"}, "starts_with(path, '/p1')"), "is_null": ({"dim": "ref_domain", "op": "is_null"}, "ref_domain IS NULL"),
    "glob": ({"dim": "path", "op": "glob", "value": "/p[1-3]*"}, "path GLOB '/p[1-3]*'"), "all": ({"all": [{"dim": "country", "op": "eq", "value": "US"}, {"dim": "ref_type", "op": "eq", "value": "search"}]}, "country = 'US' AND ref_type = 'search'"),
    "any": ({"any": [{"dim": "country", "op": "eq", "value": "US"}, {"dim": "ref_type", "op": "eq", "value": "search"}]}, "country = 'US' OR ref_type = 'search'"),
    "not": ({"not": {"dim": "country", "op": "eq", "value": "US"}}, "NOT coalesce(country = 'US', false)"),
}
for _op, (_tree, _sql) in FILTERS.items():
    register(f"filter_{_op}", f"SELECT local_date AS bucket, {EVENT_METRICS_SQL} FROM ev WHERE {_sql} GROUP BY ALL")(lambda spark, sf_dir, t=_tree: _rounded(q.metric(events(spark, sf_dir), None, EVENT_METRICS, by="day", where=t)))

BUY = {"dim": "event_action", "op": "eq", "value": "purchase"}


@register("filter_session_scope", "SELECT session_id, local_date FROM se WHERE session_id IN (SELECT session_id FROM ev WHERE event_action = 'purchase')")
def session_scope(spark, sf_dir):
    return q.with_session_match(*_both(spark, sf_dir), BUY).select("session_id", "local_date")


register("transitions", """
, edges AS (SELECT n AS step, label AS "from", lead(label) OVER (PARTITION BY session_id ORDER BY n) AS "to" FROM steps), c AS (SELECT step, "from", "to", count(*) AS sessions FROM edges WHERE "to" IS NOT NULL AND step <= 3 GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY step ORDER BY sessions DESC, "from", "to") <= 10""")(lambda spark, sf_dir: q.transitions(events(spark, sf_dir)))
register("flows", """
, w AS (SELECT session_id, count(*) AS total, to_json(list(label ORDER BY n) FILTER (n <= 4))::VARCHAR AS steps FROM steps GROUP BY session_id)
SELECT steps, count(*) AS sessions, round(avg(engaged_ms), 4) AS avg_engaged, round(avg((total <= 4)::INT), 6) AS exit_rate FROM w JOIN se USING (session_id) GROUP BY steps ORDER BY sessions DESC, steps LIMIT 20""")(
    lambda spark, sf_dir: _rounded(q.flows(*_both(spark, sf_dir))))
register("dwell", "SELECT path, count(ms) AS measured, median(ms)::DOUBLE AS median_ms, round(avg(ms), 4) AS mean_ms, max(ms) AS max_ms, count(scroll) AS scrolled, round(avg(scroll) / 100, 4) AS mean_scroll FROM legs GROUP BY path HAVING count(ms) > 0")(
    lambda spark, sf_dir: _rounded(q.dwell(q.page_legs(events(spark, sf_dir)))))
register("dwell_distribution", "SELECT CASE WHEN ms < 10000 THEN '0–10s' WHEN ms < 30000 THEN '10–30s' WHEN ms < 60000 THEN '30–60s' WHEN ms < 180000 THEN '1–3m' ELSE '3m+' END AS band, count(*) AS n FROM legs WHERE ms IS NOT NULL GROUP BY ALL")(
    lambda spark, sf_dir: q.dwell_bands(q.page_legs(events(spark, sf_dir))))
register("scroll_distribution", "SELECT least(scroll // 10, 9) AS decile, count(*) AS n FROM legs WHERE scroll IS NOT NULL GROUP BY ALL")(lambda spark, sf_dir: q.scroll_deciles(q.page_legs(events(spark, sf_dir))))
for _way, _near, _end in (("in", "lag", "(entry)"), ("out", "lead", "(exit)")):
    register(f"adjacency_{_way}", f", a AS (SELECT *, coalesce({_near}(label) OVER (PARTITION BY session_id ORDER BY n), '{_end}') AS neighbour FROM steps) SELECT neighbour, count(DISTINCT session_id) AS sessions FROM a WHERE label = '/p3' GROUP BY ALL ORDER BY sessions DESC, neighbour LIMIT 20")(
        lambda spark, sf_dir, w=_way: q.adjacency(events(spark, sf_dir), "/p3", w))
NOW, BEFORE = ("2024-01-16", "2024-01-31"), ("2024-01-01", "2024-01-15")
register("changes", f"""
, c AS (SELECT ref_domain AS value, count(*) FILTER (local_date BETWEEN '{NOW[0]}' AND '{NOW[1]}') AS current, count(*) FILTER (local_date BETWEEN '{BEFORE[0]}' AND '{BEFORE[1]}') AS previous FROM se WHERE local_date BETWEEN '{BEFORE[0]}' AND '{NOW[1]}' GROUP BY ALL)
SELECT value, current, previous, current - previous AS delta, round((current - previous) / nullif(sum(current - previous) OVER (), 0), 6) AS share FROM c QUALIFY current <> previous ORDER BY abs(delta) DESC, current DESC, value NULLS FIRST LIMIT 10""")(
    lambda spark, sf_dir: _rounded(q.changes(_both(spark, sf_dir)[1], "ref_domain", NOW, BEFORE)))
register("broken_paths", """
, b AS (SELECT path, ref_domain, ref_path, count(*) AS n FROM missing WHERE ref_domain IS NOT NULL GROUP BY path, ref_domain, ref_path QUALIFY row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, ref_domain, ref_path NULLS FIRST) = 1)
SELECT m.path, count(*) AS hits, count(m.ref_domain) AS referred, max(local_date) AS last_date, any_value(b.ref_domain) AS top_referrer, any_value(b.ref_path) AS top_page FROM missing m LEFT JOIN b ON m.path IS NOT DISTINCT FROM b.path GROUP BY m.path""")(lambda spark, sf_dir: q.broken_paths(missing_hits(spark, sf_dir)))
register("rollup_hour", "SELECT site_id, local_date, local_hour, count(*) AS hits, count(*) FILTER (type <> 'ping') AS actions, count(*) FILTER (type = 'pageview') AS pageviews, count(*) FILTER (type = 'event') AS events, count(*) FILTER (type = 'outlink') AS outlinks, count(*) FILTER (type = 'download') AS downloads, round(coalesce(sum(event_value), 0), 4) AS value_sum FROM ev GROUP BY ALL")(
    lambda spark, sf_dir: _rounded(q.hour_traffic(events(spark, sf_dir))))
MARGINS = ("path", "country", "ref_type", "browser", "device_type", "utm_source")
_measures = "count(*) FILTER (type <> 'ping') AS actions, count(*) FILTER (type = 'pageview') AS pageviews, count(DISTINCT visitor) FILTER (type <> 'ping') AS visitors FROM ev GROUP BY ALL"
register("rollup_day_marginals", f"SELECT site_id, local_date, 'total' AS dim, NULL::VARCHAR AS value, {_measures}" + "".join(f" UNION ALL SELECT site_id, local_date, '{d}' AS dim, {d} AS value, {_measures}" for d in MARGINS))(
    lambda spark, sf_dir: q.day_marginals(events(spark, sf_dir), MARGINS))
register("rollup_session_days", "SELECT site_id, local_date, count(*) AS visits, count(*) FILTER (engaged_ms > 0) AS measured, sum(engaged_ms)::BIGINT AS engaged_ms, count(*) FILTER (pageviews = 1 AND events = 0 AND engaged_ms < 15000) AS bounced, sum(pageviews)::BIGINT AS views FROM se GROUP BY ALL")(
    lambda spark, sf_dir: q.session_marginals(_both(spark, sf_dir)[1]))
register("goal_purchase", """
, g AS (SELECT site_id, count(DISTINCT session_id) AS conversions, round(sum(event_value), 4) AS value FROM ev WHERE type <> 'ping' AND event_action = 'purchase' GROUP BY ALL), s AS (SELECT site_id, count(*) AS visits FROM se GROUP BY ALL)
SELECT s.site_id, visits, coalesce(conversions, 0) AS conversions, round(coalesce(conversions, 0) / visits, 6) AS rate, value FROM s LEFT JOIN g ON s.site_id = g.site_id""")(lambda spark, sf_dir: _rounded(q.goal(*_both(spark, sf_dir), BUY)))
register("active_visitors", """
, t AS (SELECT DISTINCT ts // 1800000 * 1800000 AS tick FROM m1), a AS (SELECT tick, site_id, visitor FROM t JOIN m1 ON ts < tick AND ts >= tick - 300000)
SELECT s.site_id, t.tick, count(DISTINCT a.visitor) AS active FROM (SELECT unnest([1, 2, 3]) AS site_id) s CROSS JOIN t LEFT JOIN a ON a.site_id = s.site_id AND a.tick = t.tick GROUP BY s.site_id, t.tick""")(lambda spark, sf_dir: _active(spark, sf_dir))


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked at every half hour that has a hit."""
    hits = demo.hits(spark, sf_dir).filter("NOT not_found").select("site_id", "visitor", "ts")
    ticks = hits.select((F.floor(F.col("ts") / 1_800_000) * 1_800_000).alias("tick")).distinct()
    return q.active_visitors(hits, demo.sites(spark), ticks)
