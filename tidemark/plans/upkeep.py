"""Registered queries of what a store keeps beside its facts (first sightings and the rollup they count), shows to readers, and tells of losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import admission as a
from ..operators import diagnostics, salts
from ..operators import visits as v
from ..sinks import contract, facts, presence
from ..sources import demo
from ..streaming.jobs import scratch
from .batches import _COUNTS, _VALUES
from .facts import CUT, stored
from .ingest import REFUSED_SQL, RULES, _clients
from .queries import _both, _rounded, events, register

DIMS = ("path", "country", "ref_domain")
LATER = CUT + 8 * 86_400_000
#: Every 50th hit before the first cut comes in the last flush.
_FLUSH = f"CASE WHEN ts >= {LATER} OR (ts < {CUT} AND hit_id % 50 = 0) THEN 2 WHEN ts >= {CUT} THEN 1 ELSE 0 END"


def _kept_up(spark: SparkSession, sf_dir: str) -> facts.Store:
    """A store after three flushes with sightings, the last of which brings late hits, too."""
    hits = demo.hits(spark, sf_dir)
    events = v.sessionize(v.enrich(hits, demo.sites(spark)), of=hits).withColumn("flush_no", F.expr(_FLUSH))
    store = facts.create(spark, scratch(spark, "facts"))
    for n in range(3):
        facts.flush(store, n, events.filter(F.col("flush_no") == n).drop("flush_no"), also=lambda landed, n=n: presence.land(store, n, landed, DIMS))
    return store


@register("presence_days", f"SELECT site_id, local_date, 'total' AS dim, NULL::VARCHAR AS value, {_COUNTS}" + "".join(f" UNION ALL SELECT site_id, local_date, '{d}' AS dim, {_VALUES[d]} AS value, {_COUNTS}" for d in DIMS))
def presence_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with late hits are counted again; all others stand as the flushes added them up."""
    store = _kept_up(spark, sf_dir)
    presence.recount(store, 3, presence.stale(store), DIMS)
    return _rounded(presence.event_days(store))


@register("presence_kept", f"""
, f AS (SELECT *, {_FLUSH} AS flush_no FROM ev), newest AS (SELECT site_id, max(local_date) AS newest FROM f WHERE flush_no = 2 GROUP BY ALL)
, kept AS (SELECT * FROM f JOIN newest USING (site_id) WHERE type <> 'ping' AND (flush_no = 2 OR local_date >= strftime(newest::DATE - 3, '%Y-%m-%d')))
, s AS ({' UNION ALL '.join(f"SELECT site_id, local_date, '{d}' AS dim, {e} AS value, visitor, session_id FROM kept" for d, e in (('total', 'NULL'), *((d, d) for d in DIMS)))})
SELECT site_id, local_date, dim, value, count(DISTINCT visitor) AS visitors, count(DISTINCT session_id) AS sessions FROM s GROUP BY ALL""")
def presence_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the sightings."""
    rows = facts.read(_kept_up(spark, sf_dir), "seen")
    of = lambda k: F.count_if(F.col("kind") == k)
    return rows.groupBy(*presence.GROUP).agg(of("visitor").alias("visitors"), of("session").alias("sessions"))


_READ = """SELECT s.name, s.domains, e.local_date, e.type, v.entry_path, count(*) AS hits, count(DISTINCT e.visitor_id) AS visitors, CAST(sum(e.seq) AS BIGINT) AS seqs, count(e.screen) AS screens, count(e.utm_source_raw) AS raws
FROM {p}events e JOIN {p}sites s ON s.id = e.site_id JOIN {p}sessions v ON v.id = e.session_id WHERE e.site_id = 2 GROUP BY s.name, s.domains, e.local_date, e.type, v.entry_path
UNION ALL SELECT NULL, NULL, local_date, ref_type, path, count(*), count(DISTINCT device_type), NULL, NULL, NULL FROM {p}missing_hits GROUP BY local_date, ref_type, path"""


@register("contract_views", """
SELECT 'Site 2' AS name, '["site2.test"]' AS domains, ev.local_date, type, entry_path, count(*) AS hits, count(DISTINCT ev.visitor) AS visitors, sum(seq)::BIGINT AS seqs, 0 AS screens,
  count(*) FILTER (ev.utm_source IN ('news letter', 'z')) AS raws FROM ev JOIN se USING (session_id) WHERE ev.site_id = 2 GROUP BY ALL
UNION ALL SELECT NULL, NULL, local_date, ref_type, path, count(*), count(DISTINCT device_type), NULL, NULL, NULL FROM missing GROUP BY ALL""")
def contract_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's SQL over the views of a store after two flushes."""
    sites = demo.sites(spark).withColumn("name", F.concat(F.lit("Site "), F.col("site_id").cast("string")))
    contract.open_views(stored(spark, sf_dir), sites, prefix="contract_")
    return spark.sql(_READ.format(p="contract_"))


@register("diagnostics", f"""
, r AS (SELECT site_id, local_date, {REFUSED_SQL} AS refused FROM zoned)
, w AS (SELECT site_id, local_date, unnest(CASE WHEN type = 'ping' THEN ['on_ping'] ELSE ['bad_key', 'ip_shaped', 'oversize'] || CASE WHEN i % 2 = 0 THEN ['ip_shaped'] ELSE [] END END) AS reason FROM zoned)
, u AS (SELECT i, ts FROM zoned WHERE i % 5 = 4)
SELECT 'rows' AS section, NULL AS site_id, NULL AS local_date, 'events' AS what, count(*) AS n, NULL AS last_seen FROM ev UNION ALL SELECT 'rows', NULL, NULL, 'missing_hits', count(*), NULL FROM missing
UNION ALL SELECT 'refused', site_id, local_date, refused, count(*), NULL FROM r WHERE refused IS NOT NULL AND local_date BETWEEN '2024-01-19' AND '2024-01-25' GROUP BY ALL
UNION ALL SELECT 'props', site_id, local_date, reason, count(*), NULL FROM w WHERE local_date BETWEEN '2024-01-19' AND '2024-01-25' GROUP BY ALL
UNION ALL SELECT 'unknown', NULL, NULL, 'all', count(*), max(ts) FROM u UNION ALL SELECT 'unknown references', NULL, NULL, 'other.test', count(*), max(ts) FROM u""")
def operator_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    enriched = v.enrich(_clients(spark, sf_dir), demo.sites(spark))
    named = demo.site_names(demo.hits(spark, sf_dir))
    unknown = diagnostics.unknown_references(named, v.named_sites(named, demo.sites(spark)))
    tables = {"events": v.sessionize(enriched), "missing_hits": v.not_found(enriched)}
    return diagnostics.report(tables, diagnostics.drops(a.refuse(enriched, RULES)), a.prop_drops(enriched), unknown, "2024-01-25")


_zones = "CASE site_id WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'UTC' ELSE 'Asia/Tokyo' END AS timezone"
SALT_MS = 1_706_670_000_000  # 2024-01-31 03:00 UTC, the evening before in New York


@register("rotated_salts", f"""
, s AS (SELECT DISTINCT {_zones}, local_date FROM zoned), n AS (SELECT timezone, max(local_date) AS newest, CASE timezone WHEN 'America/New_York' THEN '2024-01-30' ELSE '2024-01-31' END AS today FROM s GROUP BY ALL)
SELECT s.timezone, s.local_date, md5(s.timezone || s.local_date) AS salt FROM s JOIN n USING (timezone) WHERE newest >= today
UNION ALL SELECT timezone, today, md5(timezone) FROM n WHERE newest < today""")
def rotated_salts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The salts of the days that have hits, an evening after the last of them where only some zones have a new day."""
    hits, sites = demo.hits(spark, sf_dir), demo.sites(spark)
    days = hits.join(sites, "site_id").select("timezone", F.date_format(F.from_utc_timestamp(F.timestamp_millis("ts"), F.col("timezone")), "yyyy-MM-dd").alias("local_date")).distinct()
    return salts.rotated(days.withColumn("salt", F.md5(F.concat("timezone", "local_date").cast("binary"))), sites, SALT_MS, F.md5(F.col("timezone").cast("binary")))


_words = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
register("visitor_names", f"""
, h AS (SELECT site_id, visitor, ts // 86400000 AS day, count(*) AS hits FROM ev GROUP BY ALL), d AS (SELECT *, sha256(encode(day || chr(10)) || unhex(printf('%016x', visitor))) AS x FROM h)
, b AS (SELECT *, ('0x' || substr(x, 1, 2))::INT % 24 AS l, ('0x' || substr(x, 3, 2))::INT % 4 AS a, ('0x' || substr(x, 5, 2))::INT % 4 AS c FROM d)
SELECT site_id, visitor, day, hits, {_words(names.ADJECTIVES)}[l * 4 + a + 1] || ' ' || {_words(names.ANIMALS)}[l * 4 + c + 1] AS name, (l * 16 + a * 4 + c) % 3 AS color FROM b""")(
    lambda spark, sf_dir: events(spark, sf_dir).groupBy("site_id", "visitor", F.floor(F.col("ts") / names.DAY_MS).alias("day")).agg(F.count("*").alias("hits")).withColumns(
        names.visitor_name(F.lpad(F.hex("visitor"), 16, "0"), F.col("day") * names.DAY_MS)))
register("named_countries", "SELECT country, CASE country WHEN 'US' THEN 'United States' WHEN 'DE' THEN 'Germany' ELSE country END AS shown, count(*) AS visits FROM se GROUP BY ALL")(
    lambda spark, sf_dir: names.with_names(_both(spark, sf_dir)[1].groupBy("country").agg(F.count("*").alias("visits")), "country", spark.createDataFrame([("us", "United States"), ("DE", "Germany")], "code string, name string"), "shown"))
