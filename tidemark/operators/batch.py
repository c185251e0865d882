"""Many metric queries over one reading of the events and visits, and what moved between two windows.

`batch` gives each row of a table to the queries whose filter it passes, keyed by query and group, and aggregates all of
them in one pass a table: a scan and a shuffle of the events, and of the visits, however many queries there are. Rows are
combined in the tasks that read them, so what moves is groups, not rows. Distinct counts go along as in any aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import query as q
from .query import Unsupported

MOST_QUERIES, MOST_METRICS = 32, 8
RATIOS = ("avg_engagement", "bounce_rate", "views_per_visit")
NUMBERS = frozenset(("site_id", "weekday", "local_hour"))
KEYS = ("query", "bucket", "value", "value2")


@dataclass(frozen=True)
class Query:
    """What q.metric() takes: metrics by at most two dimensions and a bucket, of rows that pass a filter, the first `limit` groups."""

    metrics: list[str]
    dims: tuple[str, ...] = ()
    by: str | None = None
    where: dict | None = None
    limit: int | None = None
    sides: tuple[list[str], list[str]] = field(init=False, compare=False)

    def __post_init__(self) -> None:
        events, visits = list(q.EVENT_METRICS), list(q.VISIT_METRICS)
        event_only = any(d in q.EVENT_DIMS or d.startswith("prop:") for d in self.dims)
        if event_only:  # under an event dimension a visit counts where it has an action
            events, visits = [*events, "visits"], []
        if len(self.metrics) > MOST_METRICS or not self.metrics or len(self.dims) > 2:
            raise Unsupported(f"one to {MOST_METRICS} metrics by at most two dimensions")
        if self.limit and self.by and self.dims:
            raise Unsupported("a limit with a bucket and a dimension")
        if bad := [m for m in self.metrics if m not in events and m not in visits]:
            raise Unsupported(f"no such metric here: {bad}")
        of_events = [m for m in self.metrics if m in events and not (m == "visits" and not event_only)]
        if any(d in q.SESSION_DIMS for d in self.dims) and of_events:
            raise Unsupported("metric and dimension live on different tables")
        object.__setattr__(self, "sides", (of_events, [m for m in self.metrics if m not in of_events]))


def _side(rows: DataFrame, queries: dict[str, Query], which: int, metrics: dict[str, Column], prefix: str) -> DataFrame:
    """KEYS and all metrics of one table, of the queries that ask it for any."""
    none = F.lit(None).cast("string")
    keyed = []
    for name, one in queries.items():
        if one.sides[which]:
            values = [q.dimension(d).cast("string") for d in one.dims] + [none, none]
            group = F.struct(F.lit(name).alias("query"), (q.bucket(one.by) if one.by else none).alias("bucket"), values[0].alias("value"), values[1].alias("value2"))
            keyed.append(F.when(F.coalesce(q.predicate(one.where), F.lit(False)), group) if one.where else group)
    groups = F.filter(F.array(*keyed), lambda g: g.isNotNull())
    dealt = rows.select("*", F.explode(groups).alias("__g"))
    return dealt.groupBy(*[F.col(f"__g.{k}").alias(k) for k in KEYS]).agg(*[c.alias(prefix + m) for m, c in metrics.items()])


def batch(events: DataFrame, visits: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """query, bucket, value, value2 (text), all metrics any query asks for (null where one doesn't), rank in queries with a limit.

    The rows of each query are those of q.metric() with the same arguments.
    """
    if not 0 < len(queries) <= MOST_QUERIES:
        raise Unsupported(f"one to {MOST_QUERIES} queries in a batch")
    asked = [m for m in (*q.EVENT_METRICS, *q.VISIT_METRICS) if any(m in one.metrics for one in queries.values())]
    on_events, on_visits = q._event_metrics(), q._session_metrics()
    on_events["visits"] = F.count_distinct(F.when(F.col("type") != "ping", F.col("session_id")))
    needed = [{m for one in queries.values() for m in one.sides[k]} for k in (0, 1)]
    tables = []
    for which, (rows, known, prefix) in enumerate(((events, on_events, "e_"), (visits, on_visits, "v_"))):
        if needed[which]:
            tables.append(_side(rows, queries, which, {m: c for m, c in known.items() if m in needed[which]}, prefix))
    # a query without groups has a row even where no row passes its filter
    spark = (events if events is not None else visits).sparkSession
    totals = spark.createDataFrame([(n, None, None, None) for n, one in queries.items() if not one.dims and not one.by], ", ".join(f"{k} string" for k in KEYS))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*tables, totals])
    sums = [c for c in out.columns if c not in KEYS]
    out = out.groupBy(*KEYS).agg(*[F.max(c).alias(c) for c in sums])  # each side gives a group once
    of = lambda names: F.col("query").isin(sorted(names)) if names else F.lit(False)
    shown = {}
    for m in asked:
        parts = [F.when(of(n for n, one in queries.items() if m in one.sides[k]), F.col(prefix + m)) for k, prefix in ((0, "e_"), (1, "v_")) if m in needed[k]]
        value = F.coalesce(*parts)
        shown[m] = value if m in RATIOS else F.when(of(n for n, one in queries.items() if m in one.metrics), F.coalesce(value, F.lit(0.0 if m == "event_value_sum" else 0)))
    out = out.select(*KEYS, *[c.alias(m) for m, c in shown.items()])
    limited = {n: one for n, one in queries.items() if one.limit}
    rest = out.filter(~of(limited)).withColumn("rank", F.lit(None).cast("int"))
    if not limited:
        return rest
    first = F.coalesce(*[F.when(F.col("query") == n, F.col(one.metrics[0]).cast("double")) for n, one in limited.items()])
    number = [of(n for n, one in limited.items() if len(one.dims) > k and one.dims[k] in NUMBERS) for k in (0, 1)]
    order = [F.col("bucket").asc_nulls_first(), first.desc_nulls_last()]
    for k, c in enumerate(("value", "value2")):
        order += [F.when(number[k], F.col(c).try_cast("long")).asc_nulls_first(), F.col(c).asc_nulls_first()]
    most = max(one.limit for one in limited.values())
    ranked = out.filter(of(limited)).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= most)
    return rest.unionByName(ranked.filter(F.coalesce(*[F.when(F.col("query") == n, F.col("rank") <= one.limit) for n, one in limited.items()])))


def movers(events: DataFrame, visits: DataFrame, metric: str, dims: tuple[str, ...], current: tuple[str, str], previous: tuple[str, str], limit: int = 10, where: dict | None = None) -> DataFrame:
    """dim, value, current, previous, delta, share of the dimension's whole net change: the `limit` values of each dimension that moved most.

    Any metric; both windows and all dimensions are one batch. Values of one window only count 0 in the other.
    """
    windows = {"c": current, "p": previous}
    day = lambda rows: rows if rows is None else rows.filter(reduce(lambda a, b: a | b, [F.col("local_date").between(*w) for w in windows.values()]))
    found = []
    for name, w in windows.items():
        inside = lambda rows, w=w: rows if rows is None else rows.filter(F.col("local_date").between(*w))
        rows = batch(inside(day(events)), inside(day(visits)), {d: Query([metric], (d,), where=where) for d in dict.fromkeys(dims)})
        found.append(rows.select(F.col("query").alias("dim"), "value", F.lit(name).alias("w"), F.coalesce(F.col(metric).cast("double"), F.lit(0.0)).alias("n")))
    of = lambda name: F.sum(F.when(F.col("w") == name, F.col("n")).otherwise(0.0))
    both = found[0].unionByName(found[1]).groupBy("dim", "value").agg(of("c").alias("current"), of("p").alias("previous"))
    moved = both.withColumn("delta", F.col("current") - F.col("previous"))
    whole = moved.groupBy("dim").agg(F.sum("delta").alias("whole"))
    number = F.when(F.col("dim").isin(*NUMBERS), F.col("value").try_cast("long"))
    order = [F.abs("delta").desc(), F.col("current").desc(), number.asc_nulls_first(), F.col("value").asc_nulls_first()]
    tops = moved.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(*order))).filter(F.col("rank") <= limit)
    return tops.join(whole, "dim").select("dim", "value", "current", "previous", "delta", F.try_divide("delta", "whole").alias("share"), "rank")


#: Below this many percent a change reads as steady. What a null is called; of other dimensions it is never named.
QUIET_PCT = 3
NULL_NAMES = {"ref_domain": "direct traffic", "utm_campaign": "untagged traffic", "country": "unknown location"}


def compact(value: Column) -> Column:
    """1234 as 1.2k, 2500000 as 2.5m, smaller numbers whole."""
    short = lambda x, unit: F.concat(F.regexp_replace(F.format_string("%.1f", x), r"\.0$", ""), F.lit(unit))
    return F.when(F.abs(value) >= 1_000_000, short(value / 1_000_000, "m")).when(F.abs(value) >= 1000, short(value / 1000, "k")).otherwise(F.round(value).cast("long").cast("string"))


def summaries(totals: DataFrame, moved: DataFrame, label: str, metric: str) -> DataFrame:
    """totals (label, current, previous) with `summary`, one sentence that names up to two of moved (label, dim, value, delta) that pushed the net way.

    The second is of another dimension than the first where one is, and of another name in any case.
    """
    name = F.coalesce("value", F.create_map(*[F.lit(x) for kv in NULL_NAMES.items() for x in kv])[F.col("dim")])
    drivers = moved.select(F.col(label).alias("__label"), F.struct((-F.abs("delta")).alias("order"), F.col("dim").alias("dim"), name.alias("name"), "delta").alias("d")).filter("d.name IS NOT NULL")
    rows = totals.join(drivers.groupBy("__label").agg(F.array_sort(F.collect_list("d")).alias("__d")), F.col(label) == F.col("__label"), "left")  # a few movers a label
    change = F.col("current") - F.col("previous")
    pct = F.when(F.col("previous") > 0, change / F.col("previous") * 100).when(F.col("current") > 0, 100.0).otherwise(0.0)
    rows = rows.withColumn("__way", F.filter(F.coalesce("__d", F.array().cast(dict(drivers.groupBy().agg(F.collect_list("d").alias("d")).dtypes)["d"])), lambda d: F.signum(d["delta"]) == F.signum(change)))
    first = F.get("__way", F.lit(0))
    rest = F.filter("__way", lambda d: d["name"] != F.get(F.col("__way"), F.lit(0))["name"])
    rows = rows.withColumns({"__first": first, "__rest": rest})
    second = F.coalesce(F.get(F.filter("__rest", lambda d: d["dim"] != F.col("__first")["dim"]), F.lit(0)), F.get("__rest", F.lit(0)))
    rows = rows.withColumn("__second", second)
    signed = lambda d: F.concat(F.when(F.round(d) > 0, "+").otherwise(""), F.round(d).cast("long").cast("string"))
    said = lambda d: F.concat(d["name"], F.lit(" ("), signed(d["delta"]), F.lit(")"))
    whole = F.round(F.abs(pct)).cast("long").cast("string")
    head = F.concat(F.lit(f": {metric} "), F.when(change > 0, "up ").otherwise("down "), whole, F.lit("% ("), compact(F.col("previous")), F.lit(" → "), compact(F.col("current")), F.lit(")"))
    tail = F.when(F.col("__first").isNull(), "").otherwise(F.concat(F.lit(" — "), F.concat_ws(" and ", said(F.col("__first")), said(F.col("__second"))), F.when(change > 0, " drove it").otherwise(" drove the drop")))
    steady = F.concat(F.lit(": steady (±"), whole, F.lit("%)"))
    return rows.withColumn("summary", F.concat(F.col(label).cast("string"), F.when(F.abs(pct) < QUIET_PCT, steady).otherwise(F.concat(head, tail)))).drop("__label", "__d", "__way", "__first", "__rest", "__second")
