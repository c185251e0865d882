"""Keyed state over streams: visits that survive a restart and lose no late hit, engaged time of visitors, notices.

Every job is `transformWithStateInPandas` by key, so Spark deals keys to tasks, keeps their state with the checkpoint and
restores it after a lost executor. These jobs need `spark.sql.streaming.stateStore.providerClass` set to RocksDB's
provider (`with_state_store`). State that wasn't touched for STATE_TTL_MS is dropped by Spark.

Late hits. A visitor's hits are applied in order of time. One that comes after a newer hit of the same visitor can't
be, whatever the watermark, so it is landed as `late` instead; hits that no visit takes are landed as `dropped`. Then
`repaired` computes the visits of the visitors with late hits again, from the last visit that began before the first
late hit on, as nothing before it can change. Other visitors' rows stay.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import visits as v
from ..operators.visits import FIRST_TOUCH, GAP_MS, IDLE_MS, REVIVE_MS, milestone

# The process that sets up a processor on the driver's side is started without the session's search path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_TTL_MS, TALLY_MS, TALLY_ROWS = 24 * 3_600_000, 8 * 3_600_000, 200
HIT = ("hit_id", "site_id", "visitor", "ts", "local_date", "local_hour", "type", "path", "event_category", "event_action", "event_value", *FIRST_TOUCH, "country", "browser", "device_type")
HIT_TYPES = "hit_id long, site_id long, visitor long, ts long, local_date string, local_hour int, type string, path string, event_category string, event_action string, event_value double, " + ", ".join(f"{c} string" for c in (*FIRST_TOUCH, "country", "browser", "device_type"))
OPEN = "last_ts long, session_id string, seq long, visit_date string, " + ", ".join(f"{c} string" for c in FIRST_TOUCH)
#: `own_*`: what the hit itself says, from which visits are computed again; the plain names are the visit's first touch.
FATES = HIT_TYPES + ", fate string, session_id string, seq long, engaged_step long, visit_date string, " + ", ".join(f"own_{c} string" for c in FIRST_TOUCH)


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Visits(StatefulProcessor):
    """Fates of one (site, visitor)'s hits; keeps the last stored time, the open visit, its last number and its first touch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", OPEN, STATE_TTL_MS)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self.open.update((int(row["last_ts"]), row["session_id"], int(row["seq"]), row["visit_date"], *[None if pd.isna(row[c]) else row[c] for c in FIRST_TOUCH]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hits = pd.concat(list(rows)).sort_values(["ts", "hit_id"], kind="stable").reset_index(drop=True)
        last, session, seq, day, touch = None, None, 0, None, (None,) * len(FIRST_TOUCH)
        if self.open.exists():
            last, session, seq, day, *touch = self.open.get()
        fates: list[tuple] = []
        for hit, ts, kind, weak, date, *own in zip(*(hits[c] for c in ("hit_id", "ts", "type", "weak", "local_date", *FIRST_TOUCH)), strict=True):
            gap = None if last is None else ts - last
            if gap is not None and gap < 0:
                fates.append(("late", None, None, None, None, *own))
                continue
            if weak and (gap is None or gap > REVIVE_MS):
                fates.append(("dropped", None, None, None, None, *own))  # the clock stays
                continue
            opens = gap is None or gap > REVIVE_MS or (kind == "pageview" and gap > IDLE_MS)
            if opens:
                session, seq, day, touch = hashlib.sha256(f"{key[0]}:{key[1]}:{hit}".encode()).hexdigest()[:16], 0, date, own
            seq, last = seq + 1, ts
            fates.append(("stored", session, seq, 0 if opens else min(gap, GAP_MS), day, *touch))
        if last is not None:
            self.open.update((int(last), session, int(seq), day, *[None if pd.isna(x) else x for x in touch]))
        out = hits[[c for c in HIT if c not in FIRST_TOUCH]].copy()
        for k, name in enumerate(("fate", "session_id", "seq", "engaged_step", "visit_date", *FIRST_TOUCH)):
            out[name] = pd.Series([f[k] for f in fates], dtype="Int64" if name in ("seq", "engaged_step") else object)
        for c in FIRST_TOUCH:
            out[f"own_{c}"] = hits[c]
        yield out[[f.split(" ")[0] for f in FATES.split(", ")]]

    def close(self) -> None:
        pass


def fates(enriched: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Every hit of a stream of enriched hits with its fate: stored (with its visit), dropped or late.

    seeds: the visits that were open when the stream began, as facts.open_visits() gives them, in place of a lost checkpoint.
    """
    rows = enriched.filter("NOT not_found").select(*HIT, ((F.col("type") == "ping") | milestone()).alias("weak"))
    initial = None if seeds is None else seeds.groupBy("site_id", "visitor")
    return rows.groupBy("site_id", "visitor").transformWithStateInPandas(Visits(), FATES, "Append", "ProcessingTime", initial)


def repaired(landed: DataFrame) -> DataFrame:
    """Stored hits after late ones came in: columns of FATES without fate and own_*, from all landed hits.

    Hits of visitors with late ones, since the last visit that began before the first of them, are put into visits again.
    """
    keys = ["site_id", "visitor"]
    first = landed.filter("fate = 'late'").groupBy(*keys).agg(F.min(F.struct("ts", "hit_id")).alias("late"))
    own = landed.join(first, keys, "left")
    begun = F.max(F.when((F.col("fate") == "stored") & (F.col("seq") == 1) & (F.struct("ts", "hit_id") < F.col("late")), F.struct("ts", "hit_id")))
    since = own.filter("late IS NOT NULL").groupBy(*keys).agg(begun.alias("since"))
    marked = own.join(since, keys, "left").withColumn("again", F.col("late").isNotNull() & (F.col("since").isNull() | (F.struct("ts", "hit_id") >= F.col("since"))))
    out = [f.split(" ")[0] for f in FATES.split(", ") if not f.startswith(("fate ", "own_"))]
    stay = marked.filter("NOT again AND fate = 'stored'").select(*out)
    hits = marked.filter("again").select(*[c for c in HIT if c not in FIRST_TOUCH], *[F.col(f"own_{c}").alias(c) for c in FIRST_TOUCH], F.lit(False).alias("not_found"))
    again = v.sessionize(hits).withColumns({"seq": F.col("seq").cast("long"), "engaged_step": F.col("engaged_step").cast("long")})
    return stay.unionByName(again.select(*out))


class Engaged(StatefulProcessor):
    """Engaged time of one (site, visitor)'s present visit, by every hit; a gap over IDLE_MS starts it over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "engaged_ms long, last_ts long", STATE_TTL_MS)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self.seen.update((int(initialState["engaged_ms"].iloc[0]), int(initialState["last_ts"].iloc[0])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ts = np.sort(np.concatenate([part["ts"].to_numpy(np.int64) for part in rows]))
        engaged, last = self.seen.get() if self.seen.exists() else (0, int(ts[0]))
        gaps = np.diff(ts, prepend=last)
        fresh = np.flatnonzero(gaps > IDLE_MS)
        begin = int(fresh[-1]) + 1 if len(fresh) else 0  # only what follows the last fresh start counts
        engaged = (0 if len(fresh) else int(engaged)) + int(np.clip(gaps[begin:], 0, GAP_MS).sum())
        newest = max(int(last), int(ts[-1]))
        self.seen.update((engaged, newest))
        yield pd.DataFrame({"site_id": [key[0]], "visitor": [key[1]], "engaged_ms": [engaged], "last_ts": [newest]})

    def close(self) -> None:
        pass


def engaged(stored: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """site_id, visitor, engaged_ms, last_ts after each micro-batch, of visitors with stored hits in it. seeds: the same columns."""
    initial = None if seeds is None else seeds.groupBy("site_id", "visitor")
    return stored.select("site_id", "visitor", "ts").groupBy("site_id", "visitor").transformWithStateInPandas(Engaged(), "site_id long, visitor long, engaged_ms long, last_ts long", "Update", "ProcessingTime", initial)


def newest_engaged(rows: DataFrame, n: int = TALLY_ROWS) -> DataFrame:
    """Each visitor's newest row; of those within TALLY_MS of the newest of all, the newest n."""
    last = rows.groupBy("site_id", "visitor").agg(F.max(F.struct("last_ts", "engaged_ms")).alias("s")).select("site_id", "visitor", "s.engaged_ms", "s.last_ts")
    tops = last.orderBy(F.col("last_ts").desc(), "site_id", "visitor").limit(n)
    newest = F.max("last_ts").over(Window.partitionBy())  # n rows
    return tops.withColumn("newest", newest).filter(F.col("last_ts") >= F.col("newest") - TALLY_MS).drop("newest")


class Cooled(StatefulProcessor):
    """The hits of one rule that give a notice: the first one, and then the first at least a cooldown after the last notice."""

    def __init__(self, cooldown_ms: int):
        self.cooldown = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", "ts long", max(STATE_TTL_MS, 2 * self.cooldown))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [(p["ts"].to_numpy(np.int64), p["hit_id"].to_numpy(np.int64)) for p in rows]  # sixteen bytes a hit
        ts, hit = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((hit, ts))
        ts, hit, found = ts[order], hit[order], []
        last = self.fired.get()[0] if self.fired.exists() else None
        at = 0 if last is None else int(np.searchsorted(ts, last + self.cooldown))
        while at < len(ts):
            found.append(at)
            last = int(ts[at])
            at = max(int(np.searchsorted(ts, last + self.cooldown)), at + 1)
        if found:
            self.fired.update((last,))
        yield pd.DataFrame({"rule_id": [key[0]] * len(found), "hit_id": hit[found], "ts": ts[found]})

    def close(self) -> None:
        pass


RULE = ("site_id", "event_category", "event_action", "event_name")


def matched(hits: DataFrame, rules: list[dict]) -> DataFrame:
    """hits that aren't pings with rule_id, the place of the first rule all of whose stated fields (of RULE) they have."""
    say = lambda rule: reduce(lambda a, b: a & b, [F.coalesce(F.col(c) == rule[c], F.lit(False)) for c in RULE if rule.get(c) is not None], F.lit(True))
    which = F.coalesce(*[F.when(say(r), F.lit(n)) for n, r in enumerate(rules)], F.lit(None).cast("int"))
    return hits.filter("type <> 'ping'").withColumn("rule_id", which).filter("rule_id IS NOT NULL")


def notices(stored: DataFrame, rules: list[dict], cooldown_ms: int) -> DataFrame:
    """rule_id, hit_id, ts of what is to be announced: one notice a hit, by its first matching rule, at most one a rule and cooldown."""
    rows = matched(stored, rules).select("rule_id", "hit_id", "ts")
    return rows.groupBy("rule_id").transformWithStateInPandas(Cooled(cooldown_ms), "rule_id int, hit_id long, ts long", "Append", "ProcessingTime")


def _run(stream: DataFrame, path: str, mode: str, land: Callable[[DataFrame, int], None], later: Sequence[Callable[[], None]] = ()) -> int | None:
    """Process all that is there, then, going on from the checkpoint, what each of `later` makes arrive; the number of the last micro-batch.

    Batches without rows, which expiring state would ask for again and again, are left out.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    last = None
    for arrive in (None, *later):
        if arrive is not None:
            arrive()
        before = conf.get(key, "true")
        conf.set(key, "false")
        try:
            query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(land).start()
        finally:
            conf.set(key, before)
        query.awaitTermination()
        last = query.lastProgress["batchId"] if query.lastProgress else last
    return last


def run_rolling(stream: DataFrame, path: str, mode: str, make: Callable[[DataFrame], DataFrame], schema: str, later: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """After each micro-batch the sink holds make(what it held before and the batch), a bounded table; the last of them.

    A batch's table is path/table/batch=N, made of that of N - 1; a batch that is run again makes the same.
    """
    spark = stream.sparkSession

    def land(batch: DataFrame, n: int) -> None:
        before = spark.read.schema(schema).parquet(f"{path}/table/batch={n - 1}") if n else spark.createDataFrame([], schema)
        make(before.unionByName(batch)).write.mode("overwrite").parquet(f"{path}/table/batch={n}")

    last = _run(stream, path, mode, land, later)
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{path}/table/batch={last}")


def run_landing(stream: DataFrame, path: str, schema: str, later: Sequence[Callable[[], None]] = ()) -> DataFrame:
    """The rows of each micro-batch in path/table/batch=N, written over if it is run again; all of them."""
    spark = stream.sparkSession
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/table/batch=-1")
    _run(stream, path, "append", lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/table/batch={n}"), later)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/table")
