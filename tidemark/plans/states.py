"""Registered streams with keyed state: late hits repaired, a restart seeded from stored visits, engaged time, notices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import visits as v
from ..sinks import facts
from ..sources import demo
from ..streaming import state
from ..streaming.jobs import scratch
from .facts import CUT
from .queries import events, register

EVENT_COLUMNS = ("hit_id", "site_id", "visitor", "ts", "session_id", "seq", "engaged_step", "ref_type", "utm_source", "visit_date")
_EVENTS = "hit_id, site_id, visitor, ts, session_id, seq, engaged_step::BIGINT AS engaged_step, ref_type, utm_source, first(local_date) OVER (PARTITION BY session_id ORDER BY seq) AS visit_date"
COOLDOWN = 6 * 3_600_000
RULES = [{"site_id": 2, "event_action": "purchase"}, {"event_category": "account"}, {"event_category": "shop", "event_name": "item1"}]


def _stream(rows: list[DataFrame], spark: SparkSession) -> tuple[DataFrame, list[Callable[[], None]]]:
    """A stream of the rows of each table, one micro-batch a table however many files it has, and what makes each later table arrive."""
    path = scratch(spark, "stream-in")
    rows[0].write.parquet(f"{path}/part0")
    later = [lambda n=n, part=part: part.write.parquet(f"{path}/part{n}") for n, part in enumerate(rows) if n]
    return spark.readStream.schema(rows[0].schema).option("recursiveFileLookup", True).parquet(path), later


def _ms() -> Column:
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) DIV 1000")


@register("stream_late_repaired", f"SELECT {_EVENTS} FROM ev")
def stream_late_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three micro-batches of hits in no order of time: what came late is landed and its visitors' visits made again."""
    state.with_state_store(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = [rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == n) for n in range(3)]
    stream, later = _stream(parts, spark)
    landed = state.run_landing(state.fates(v.enrich(demo.hits_of(stream), demo.sites(spark))), scratch(spark, "stream-fates"), state.FATES, later)
    return state.repaired(landed).select(*EVENT_COLUMNS)


@register("stream_seeded_events", f"SELECT * FROM (SELECT {_EVENTS} FROM ev) WHERE ts >= {CUT}")
def stream_seeded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that goes on at CUT without its checkpoint, from the visits that the store has as still open."""
    state.with_state_store(spark)
    store = facts.create(spark, scratch(spark, "facts"))
    facts.flush(store, 0, events(spark, sf_dir).filter(F.col("ts") < CUT))
    rest = spark.read.parquet(f"{sf_dir}/events.parquet").filter(_ms() >= CUT)
    enriched = v.enrich(demo.hits_of(_stream([rest], spark)[0]), demo.sites(spark))
    landed = state.run_landing(state.fates(enriched, facts.open_visits(store, CUT)), scratch(spark, "stream-fates"), state.FATES)
    return landed.filter("fate = 'stored'").select(*EVENT_COLUMNS)


def _stored_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Callable[[], None]]]:
    rows = events(spark, sf_dir).select("hit_id", "site_id", "visitor", "ts", "type", "event_category", "event_action", "event_name")
    return _stream([rows.filter(F.col("ts") < CUT), rows.filter(F.col("ts") >= CUT)], spark)


@register("stream_engaged", f"""
, g AS (SELECT site_id, visitor, ts, hit_id, ts - lag(ts) OVER (PARTITION BY site_id, visitor ORDER BY ts, hit_id) AS gap FROM ev)
, r AS (SELECT *, sum((gap > 1800000)::INT) OVER (PARTITION BY site_id, visitor ORDER BY ts, hit_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM g)
, e AS (SELECT site_id, visitor, sum(CASE WHEN gap <= 1800000 THEN least(gap, 20000) ELSE 0 END)::BIGINT AS engaged_ms, max(ts) AS last_ts FROM r WHERE coalesce(later, 0) = 0 GROUP BY ALL)
SELECT * FROM e WHERE last_ts >= (SELECT max(last_ts) FROM e) - {state.TALLY_MS} ORDER BY last_ts DESC, site_id, visitor LIMIT {state.TALLY_ROWS}""")
def stream_engaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    state.with_state_store(spark)
    stream, later = _stored_stream(spark, sf_dir)
    return state.run_rolling(state.engaged(stream), scratch(spark, "stream-engaged"), "update", state.newest_engaged, "site_id long, visitor long, engaged_ms long, last_ts long", later)


@register("stream_notices", f"""
, m AS (SELECT CASE WHEN site_id = 2 AND event_action = 'purchase' THEN 0 WHEN event_category = 'account' THEN 1 WHEN event_category = 'shop' AND k % 5 = 1 THEN 2 END AS rule_id, hit_id, ts FROM ev WHERE type <> 'ping')
SELECT rule_id, hit_id, ts FROM (
  WITH RECURSIVE f AS (
    SELECT rule_id, min(ts) AS ts FROM m WHERE rule_id IS NOT NULL GROUP BY rule_id
    UNION ALL SELECT f.rule_id, (SELECT min(m.ts) FROM m WHERE m.rule_id = f.rule_id AND m.ts >= f.ts + {COOLDOWN}) FROM f WHERE f.ts IS NOT NULL
  ) SELECT f.rule_id::INT AS rule_id, min(m.hit_id) AS hit_id, f.ts FROM f JOIN m ON m.rule_id = f.rule_id AND m.ts = f.ts GROUP BY ALL)""")
def stream_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    state.with_state_store(spark)
    stream, later = _stored_stream(spark, sf_dir)
    return state.run_landing(state.notices(stream, RULES, COOLDOWN), scratch(spark, "stream-notices"), "rule_id int, hit_id long, ts long", later)
