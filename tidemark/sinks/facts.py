"""Stored facts: events, visits, missing hits and the hour rollup in site-day partitions, written flush by flush.

A table's rows of flush N lie in table/flush=N/site_id=S/local_date=D. What readers see is told by commits alone: the
last act of a flush writes one small file, commits/flush=N, that names the partitions the flush wrote and whether its
files of a partition replace all earlier ones (`whole`) or add to them. That file appears by one rename, so all outputs
of a flush show together or not at all. A flush that failed before it left files nobody reads, and is simply run again;
one that is run again after it was committed changes nothing. There is one writer at a time.

Events, missing hits and rollup counters only add. A visit lives in the partition of the day it began, so a flush reads
the partitions of the visits it touches, merges by key and writes those partitions whole. Filters on site and day prune
partitions; superseded files are left out by a semi-join with the live partitions, which Spark turns into pruning too.
`compact` rewrites partitions of many flushes into one, `vacuum_list` names the files that nobody reads any more.

Defined cases: an empty flush commits and changes nothing; a table without rows reads as an empty table of its schema;
null sites or days make a partition of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import query as q
from ..operators import visits as v
from ..operators.rollups import HOUR_KEYS, differences

PARTITION = ("site_id", "local_date")
COMMIT = "table string, site_id long, local_date string, whole boolean"
#: Columns of a visit that a flush changes; all others stay as the visit's first hits made them.
ADDED, NEWEST = ("pageviews", "events", "engaged_ms"), "last_seen_at"


@dataclass(frozen=True)
class Store:
    """Tables below `root`; `schemas` of those that hold something, partition columns included."""

    spark: SparkSession
    root: str
    schemas: dict[str, StructType] = field(default_factory=dict)


def create(spark: SparkSession, root: str) -> Store:
    """A new store; its first commit (flush -1) is empty."""
    spark.createDataFrame([], COMMIT).coalesce(1).write.parquet(f"{root}/commits/flush=-1")
    return Store(spark, root)


def commits(store: Store) -> DataFrame:
    """flush, table, site_id, local_date, whole of every commit."""
    schema = StructType([*StructType.fromDDL(COMMIT), StructField("flush", LongType())])
    return store.spark.read.schema(schema).parquet(f"{store.root}/commits")


def flushes(store: Store, table: str | None = None) -> list[int]:
    """Numbers of the flushes that were committed, of those with live rows of a table: as many as since the last compaction."""
    if table is None:  # also those that wrote nothing
        files = store.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{store.root}/commits").select("flush").distinct()
        return sorted(int(r.flush) for r in files.collect())
    return sorted(r.flush for r in live(store, table).select("flush").distinct().collect())


def live(store: Store, table: str) -> DataFrame:
    """flush, site_id, local_date that readers of a table take: those since the partition was last written whole."""
    since = F.max(F.when(F.col("whole"), F.col("flush"))).over(Window.partitionBy(*PARTITION))
    mine = commits(store).filter(F.col("table") == table).withColumn("since", since)
    return mine.filter(F.col("since").isNull() | (F.col("flush") >= F.col("since"))).select("flush", *PARTITION).distinct()


def on_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the partitions in `days` (site_id, local_date)."""
    keys = days.select(F.col("site_id").alias("__site"), F.col("local_date").alias("__date")).distinct()
    return rows.join(keys, F.col("site_id").eqNullSafe(F.col("__site")) & F.col("local_date").eqNullSafe(F.col("__date")), "left_semi")


def read(store: Store, table: str) -> DataFrame:
    """The rows of all committed flushes, superseded ones left out."""
    schema = store.schemas.get(table)
    numbers = flushes(store, table)
    if not numbers:
        return store.spark.createDataFrame([], schema or StructType([StructField("site_id", LongType()), StructField("local_date", StringType())]))
    base = f"{store.root}/{table}"
    if schema is None:
        schema = store.spark.read.option("basePath", base).parquet(f"{base}/flush={numbers[-1]}").drop("flush", *PARTITION).schema
        schema = StructType([*schema, StructField("site_id", LongType()), StructField("local_date", StringType())])
    rows = store.spark.read.option("basePath", base).schema(StructType([*schema, StructField("flush", LongType())])).parquet(*[f"{base}/flush={n}" for n in numbers])
    written = commits(store).filter((F.col("table") == table) & F.col("flush").isin(numbers)).select("flush", *PARTITION).distinct()
    now = live(store, table)
    if written.count() != now.count():
        kept = now.toDF("__flush", "__site", "__date")
        rows = rows.join(kept, (F.col("flush") == F.col("__flush")) & F.col("site_id").eqNullSafe(F.col("__site")) & F.col("local_date").eqNullSafe(F.col("__date")), "left_semi")
    return rows.drop("flush").select(*schema.names)


def _write(store: Store, table: str, rows: DataFrame, flush: int) -> DataFrame:
    """Write rows of a flush, a few files a partition however many rows one has; the rows as read back."""
    path = f"{store.root}/{table}/flush={flush}"
    rows.hint("rebalance", *PARTITION).write.mode("overwrite").partitionBy(*PARTITION).parquet(path)
    store.schemas[table] = StructType([*rows.drop(*PARTITION).schema, StructField("site_id", LongType()), StructField("local_date", StringType())])
    return store.spark.read.schema(store.schemas[table]).parquet(path)


def _commit(store: Store, flush: int, written: dict[str, tuple[DataFrame, bool]], gone: dict[str, DataFrame] | None = None) -> None:
    """Name the partitions that were written; those in `gone` lose the rows of earlier flushes."""
    named = store.spark.createDataFrame([], COMMIT)
    for table, (rows, whole) in written.items():
        named = named.unionByName(rows.select(*PARTITION).distinct().select(F.lit(table).alias("table"), *PARTITION, F.lit(whole).alias("whole")))
    for table, days in (gone or {}).items():
        named = named.unionByName(days.select(F.lit(table).alias("table"), *PARTITION, F.lit(True).alias("whole")))
    named.coalesce(1).write.mode("overwrite").parquet(f"{store.root}/commits/flush={flush}")


def merged_visits(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Visits after a batch: counters add, the newest hit and exit page are the batch's, first-touch columns stay the stored ones'."""
    a, b = stored.alias("a"), batch.alias("b")
    both = a.join(b, F.col("a.session_id") == F.col("b.session_id"), "full_outer")
    known = F.col("a.session_id").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))

    def made(c: str) -> Column:
        old, new = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in ADDED:
            return zero(old) + zero(new)
        if c == NEWEST:
            return F.greatest(old, new)
        if c == "exit_path":
            return F.when(zero(F.col("b.pageviews")) > 0, new).otherwise(old)
        return F.when(known, old).otherwise(new)

    return both.select(*[made(c).alias(c) for c in batch.columns])


def flush(store: Store, number: int, events: DataFrame, missing: DataFrame | None = None, also: Callable[[DataFrame], tuple[dict, dict]] | None = None) -> bool:
    """Land a batch of sessionized events (each once over all flushes), the visits they change, missing hits and hour counters.

    also: given the landed events, writes tables of its own and names them, and partitions that go, for the same commit
    (see presence.land). False, and nothing written, if the flush was committed before.
    """
    if number in flushes(store):
        return False
    landed = _write(store, "events", events, number)
    batch = v.sessions(v.dealt(landed.withColumn("local_date", F.col("visit_date")), "site_id", "visitor", of=landed))
    touched = batch.select(*PARTITION).distinct()
    before = read(store, "visits")
    if "session_id" in before.columns:
        batch = merged_visits(on_days(before, touched), batch)
    written = {"events": (landed, False), "visits": (_write(store, "visits", batch, number), True), "hours": (_write(store, "hours", q.hour_traffic(landed), number), False)}
    if missing is not None:
        written["missing"] = (_write(store, "missing", missing, number), False)
    more, gone = also(landed) if also else ({}, {})
    _commit(store, number, {**written, **more}, gone)
    return True


def hours(store: Store) -> DataFrame:
    """The hour rollup: the counters of all flushes, added up."""
    rows = read(store, "hours")
    keys = ("site_id", "local_date", "local_hour")
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])


def compact(store: Store, number: int, least: int = 8) -> bool:
    """Rewrite partitions that lie in `least` flushes or more as one, of all tables; rows stay the same."""
    if number in flushes(store):
        return False
    written = {}
    for table in sorted(r.table for r in commits(store).select("table").distinct().collect()):
        many = live(store, table).groupBy(*PARTITION).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        if many.isEmpty():
            continue
        written[table] = (_write(store, table, on_days(read(store, table), many), number), True)
    _commit(store, number, written)
    return True


def replace_days(store: Store, number: int, table: str, days: DataFrame, rows: DataFrame) -> bool:
    """Put `rows` in place of a table's partitions `days` (site_id, local_date), those that are left without rows too."""
    if number in flushes(store):
        return False
    _write(store, table, on_days(rows, days), number)
    _commit(store, number, {table: (days, True)})
    return True


def reconcile(store: Store, number: int, day: str) -> bool:
    """Hold the hour rollup of a day against the events and rewrite the sites that drifted; False if none did."""
    fresh = q.hour_traffic(read(store, "events").filter(F.col("local_date") == day))
    drift = differences(hours(store).filter(F.col("local_date") == day), fresh, HOUR_KEYS).select(*PARTITION).distinct()
    if number in flushes(store) or drift.isEmpty():
        return False
    return replace_days(store, number, "hours", drift, on_days(fresh, drift))


def vacuum_list(store: Store, table: str) -> DataFrame:
    """flush, site_id, local_date of files that no reader takes any more."""
    mine, now = commits(store).filter(F.col("table") == table).select("flush", *PARTITION), live(store, table)
    return mine.exceptAll(now)


def data_version(store: Store) -> DataFrame:
    """version, rewrites: the newest flush, and how many commits put something in place of older rows; answers kept under another pair are stale."""
    rewritten = F.count_distinct(F.when(F.col("whole") & (F.col("table") == "events"), F.col("flush")))
    newest = max(flushes(store))
    return commits(store).agg(F.lit(newest).cast("long").alias("version"), rewritten.alias("rewrites"))


def open_visits(store: Store, now_ms: int) -> DataFrame:
    """The newest visit of each visitor that a hit may still continue: seen within REVIVE_MS, with the number of its last hit."""
    newest = F.max(F.struct("last_seen_at", "started_at", "session_id"))
    recent = read(store, "visits").filter(F.col("last_seen_at") >= now_ms - v.REVIVE_MS)
    last = recent.groupBy("site_id", "visitor").agg(newest.alias("n")).select("n.session_id")
    mine = recent.join(last, "session_id", "left_semi")
    # hits of a visit lie on its own day and later ones
    seq = read(store, "events").join(mine.select("session_id"), "session_id", "left_semi").groupBy("session_id").agg(F.max("seq").cast("long").alias("seq"))
    return mine.join(seq, "session_id").select("site_id", "visitor", F.col("last_seen_at").alias("last_ts"), "session_id", "seq", F.col("local_date").alias("visit_date"), *v.FIRST_TOUCH)
