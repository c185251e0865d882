"""Structured Streaming jobs: visits, hour rollups and active visitors, the same rows as the batch operators give.

Every sink is a folder of one sub-folder for each micro-batch, written with overwrite: a batch that is run again
after a failure replaces what it had written, so nothing counts twice. Readers add up the batches.
Hits older than the watermark (WATERMARK behind the newest) are dropped by Spark; `late` finds them for a batch repair.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.query import ACTIVE_MS, hour_traffic
from ..operators.visits import FIRST_TOUCH, GAP_MS, IDLE_MS, REVIVE_MS, milestone

WATERMARK, TICK_MS = "4 hours", 10_000
INPUT = ("hit_id", "site_id", "visitor", "ts", "local_date", "local_hour", "type", "path", "event_value", *FIRST_TOUCH)
STATE = "last_ts long, session_id string, seq long, " + ", ".join(f"{c} string" for c in FIRST_TOUCH)
OUTPUT = "hit_id long, site_id long, visitor long, ts long, local_date string, local_hour int, type string, path string, event_value double, session_id string, seq long, engaged_step long, " + ", ".join(f"{c} string" for c in FIRST_TOUCH)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder of the session; a local one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _assign(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Visits of one (site, visitor): keeps the last stored time, the open visit, its next number and its first touch."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(parts)).sort_values(["ts", "hit_id"], kind="stable")
    last, session, seq, touch = None, "", 0, (None,) * len(FIRST_TOUCH)
    if state.exists:
        last, session, seq, *touch = state.get
    found = []
    for at, row in enumerate(zip(rows["hit_id"], rows["ts"], rows["type"], rows["weak"], *(rows[c] for c in FIRST_TOUCH), strict=True)):
        hit, ts, kind, weak, *own = row
        gap = None if last is None else ts - last
        if weak and (gap is None or gap > REVIVE_MS):
            continue  # the clock stays
        opens = gap is None or gap > REVIVE_MS or (kind == "pageview" and gap > IDLE_MS)
        if opens:
            session, seq, touch = hashlib.sha256(f"{key[0]}:{key[1]}:{hit}".encode()).hexdigest()[:16], 0, own
        seq, last = seq + 1, ts
        found.append((at, session, seq, 0 if opens else min(max(gap, 0), GAP_MS), *touch))
    if last is not None:
        state.update((int(last), session, int(seq), *[None if pd.isna(x) else x for x in touch]))
        state.setTimeoutTimestamp(max(int(last) + REVIVE_MS, state.getCurrentWatermarkMs()) + 1)
    kept = rows.iloc[[f[0] for f in found]][list(INPUT[:9])].reset_index(drop=True)
    for k, name in enumerate(("session_id", "seq", "engaged_step", *FIRST_TOUCH), 1):
        kept[name] = pd.Series([f[k] for f in found], dtype="int64" if name in ("seq", "engaged_step") else object)
    yield kept


def sessionized(enriched: DataFrame) -> DataFrame:
    """Stored hits with session_id, seq, engaged_step and first touch, from a stream of enriched hits.

    A task holds one visitor's rows of one micro-batch; the source's rate limit bounds them.
    """
    rows = enriched.filter("NOT not_found").select(*INPUT, ((F.col("type") == "ping") | milestone()).alias("weak"), F.timestamp_millis("ts").alias("at"))
    return rows.withWatermark("at", WATERMARK).groupBy("site_id", "visitor").applyInPandasWithState(_assign, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_sightings(enriched: DataFrame, cell: str = "10 seconds") -> DataFrame:
    """One row for each visitor with any hit, site and cell of time (w), when first seen: one row of state each."""
    acts = enriched.filter(~F.col("not_found")).select("site_id", "visitor", F.timestamp_millis("ts").alias("at"))
    return acts.withWatermark("at", WATERMARK).select("site_id", "visitor", F.window("at", cell).alias("w")).dropDuplicates(["site_id", "visitor", "w"])


def late(enriched: DataFrame, newest_ms: int) -> DataFrame:
    """Rows of a batch that the watermark behind newest_ms would drop: their visitors' days are to be computed again."""
    return enriched.filter(F.col("ts") < newest_ms - REVIVE_MS).select("site_id", "visitor", "local_date").distinct()


def run_available(stream: DataFrame, path: str, outputs: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
    """Process all that is there now; each output's rows of a micro-batch go to path/name/batch=N, the rows computed once."""

    def land(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            for name, make in outputs.items():
                make(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
        finally:
            batch.unpersist()

    stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(land).start().awaitTermination()


def visits_and_hours(enriched: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Run the visit job over a stream; the stored hits, and the hour rollup as the sum of its batches."""
    run_available(sessionized(enriched), path, {"events": lambda b: b, "hours": hour_traffic})
    spark = enriched.sparkSession
    hours = spark.read.parquet(f"{path}/hours").drop("batch")
    keys = ("site_id", "local_date", "local_hour")
    return spark.read.parquet(f"{path}/events").drop("batch"), hours.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in hours.columns if c not in keys])


def active_visitors(enriched: DataFrame, path: str) -> DataFrame:
    """site_id, tick, active: exact distinct visitors in the five minutes before each tick, every ten seconds, as query.active_visitors().

    A site has a row for each tick at which it is active, and one of 0 where it falls silent, which holds until its next.
    """
    run_available(first_sightings(enriched), path, {"seen": lambda b: b.select("site_id", "visitor", F.unix_millis("w.start").alias("cell"))})
    return ticked(enriched.sparkSession.read.parquet(f"{path}/seen").drop("batch"))


def ticked(seen: DataFrame) -> DataFrame:
    """Counts at ticks from sightings (site_id, visitor, cell: its first ms)."""
    ticks = F.explode(F.sequence(F.col("cell") + TICK_MS, F.col("cell") + ACTIVE_MS, F.lit(TICK_MS)))
    counts = seen.select("site_id", "visitor", ticks.alias("tick")).groupBy("site_id", "tick").agg(F.count_distinct("visitor").alias("active"))
    silent = counts.select("site_id", (F.col("tick") + TICK_MS).alias("tick")).join(counts.select("site_id", "tick"), ["site_id", "tick"], "left_anti")
    return counts.unionByName(silent.withColumn("active", F.lit(0).cast("long")))


def active_at(seen: DataFrame, sites: DataFrame, tick: int) -> DataFrame:
    """site_id, active of every known site at a tick (ms); reads the cells of five minutes only."""
    counts = seen.filter((F.col("cell") >= tick - ACTIVE_MS) & (F.col("cell") < tick)).groupBy("site_id").agg(F.count_distinct("visitor").alias("active"))
    return sites.select("site_id").join(counts, "site_id", "left").fillna(0, ["active"])


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The newest n rows of each site, by time and id."""
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.col("ts").desc(), F.col("hit_id").desc()))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def feed(enriched: DataFrame, path: str, n: int = 400) -> tuple[DataFrame, DataFrame]:
    """The newest n hits of each site, and ticks (site_id, batch): the sites that each micro-batch changed.

    A micro-batch lands at most n rows a site, so readers never see more than that for each batch.
    """
    columns = ("hit_id", "site_id", "visitor", "ts", "type", "path", "country")
    run_available(enriched.filter("NOT not_found").select(*columns), path, {"feed": lambda b: newest(b, n), "ticks": lambda b: b.select("site_id").distinct()})
    spark = enriched.sparkSession
    return newest(spark.read.parquet(f"{path}/feed").drop("batch"), n), spark.read.parquet(f"{path}/ticks")


def resumed(rows: DataFrame, ts: int, hit_id: int) -> DataFrame:
    """Feed rows after the last one that a reader has seen."""
    return rows.filter((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("hit_id") > hit_id)))
