"""Upkeep of rollups, and answers from them where they give the same rows as the events."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batch import Query
from .query import Unsupported, bucket, changes, dimension, hour_traffic, predicate
from .visits import BOUNCE_MS

HOUR_KEYS = ("site_id", "local_date", "local_hour")
#: Metrics that the hour rollup's additive columns give.
ADDITIVE = {"pageviews": "pageviews", "events": "events", "outlinks": "outlinks", "downloads": "downloads", "event_value_sum": "value_sum"}


def merged(stored: DataFrame, added: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rollup after additive counters of a batch came in; negative ones take back what a changed visit had given."""
    counters = [c for c in stored.columns if c not in keys]
    return stored.unionByName(added).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters]).select(stored.columns)


def corrected(stored: DataFrame, before: DataFrame, after: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rollup after rows that gave `before` became rows that give `after`; groups that end at zero go."""
    counters = [c for c in stored.columns if c not in keys]
    out = merged(merged(stored, before.select(*keys, *[(-F.col(c)).alias(c) for c in counters]), keys), after, keys)
    return out.filter(reduce(lambda a, b: a | b, [F.abs(c) > 1e-9 for c in counters]))


def differences(stored: DataFrame, fresh: DataFrame, keys: tuple[str, ...], tolerance: float = 1e-6) -> DataFrame:
    """Cells (keys, counter, stored, fresh) that differ by more than the relative tolerance, or that one side lacks."""
    counters = [c for c in stored.columns if c not in keys]

    def cells(df: DataFrame, name: str) -> DataFrame:
        return df.unpivot(list(keys), counters, "counter", name) if len({t for c, t in df.dtypes if c in counters}) == 1 else df.withColumns({c: F.col(c).cast("double") for c in counters}).unpivot(list(keys), counters, "counter", name)

    a, b = cells(stored, "stored").alias("a"), cells(fresh, "fresh").alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "counter")])
    both = a.join(b, on, "full_outer").select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in (*keys, "counter")], "stored", "fresh")
    apart = F.abs(F.col("stored") - F.col("fresh")) > tolerance * F.greatest(F.abs("stored"), F.abs("fresh"), F.lit(1.0))
    return both.filter(F.coalesce(apart, F.lit(True)))


def can_answer(metrics: list[str], dims: tuple[str, ...] = (), by: str | None = None, where: dict | None = None) -> bool:
    """Whether the hour rollup gives the same rows: additive metrics, at most the site as dimension, no filter."""
    return all(m in ADDITIVE for m in metrics) and set(dims) <= {"site_id"} and where is None and by in (None, "hour", "day", "week", "month")


def answer(hours: DataFrame, metrics: list[str], dims: tuple[str, ...] = (), by: str | None = None, where: dict | None = None) -> DataFrame:
    """The metric query from the hour rollup; raises where it would not be the same rows."""
    if not can_answer(metrics, dims, by, where):
        raise Unsupported("the hour rollup can't answer this")
    keys = ([bucket(by).alias("bucket")] if by else []) + [F.col(d) for d in dims]
    return hours.groupBy(*keys).agg(*[F.sum(ADDITIVE[m]).alias(m) for m in metrics])


def bounces(session_days: DataFrame, threshold_ms: int) -> DataFrame:
    """Session-day marginals, refused if their bounces were counted at another threshold."""
    if threshold_ms != BOUNCE_MS:
        raise Unsupported("bounces were counted at another threshold; rebuild the rollup")
    return session_days


def rebuilt(stored: DataFrame, events: DataFrame, drifted: DataFrame) -> DataFrame:
    """The hour rollup with every (site_id, local_date) of `drifted` counted again from the events."""
    days = drifted.select("site_id", "local_date").distinct()
    again = hour_traffic(events.join(days, ["site_id", "local_date"], "left_semi"))
    return stored.join(days, ["site_id", "local_date"], "left_anti").unionByName(again)


def visit_days(visits: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """site_id, local_date, dim, value: visits, page views and engaged time of every dimension, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    rows = visits.select("site_id", "local_date", "pageviews", "engaged_ms", pairs.alias("p"))
    return rows.groupBy("site_id", "local_date", "p.dim", "p.value").agg(F.count("*").alias("visits"), F.sum("pageviews").alias("pageviews"), F.sum("engaged_ms").cast("long").alias("engaged_ms"))


VISIT_KEYS = ("site_id", "local_date", "dim", "value")


def visits_moved(stored: DataFrame, before: DataFrame, after: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """visit_days() after visits changed: what `before` gave goes, what `after` gives comes, so an exit page's group can shrink.

    before and after hold the changed visits only, each once.
    """
    return corrected(stored, visit_days(before, dims), visit_days(after, dims), VISIT_KEYS)


def movers(days: DataFrame, dim: str, current: tuple[str, str], previous: tuple[str, str], limit: int = 10) -> DataFrame:
    """changes() of visits, from visit_days() in place of the visits."""
    return changes(days.filter(F.col("dim") == dim), "value", current, previous, limit, weight="visits")


#: Counters of an event-day rollup that add up over days, and those that are exact within a day only.
ADDED = {"hits": "hits", "actions": "actions", "pageviews": "pageviews", "events": "events", "outlinks": "outlinks", "downloads": "downloads", "event_value_sum": "value_sum"}
DISTINCT = {"visitors": "visitors", "visits": "sessions"}
DERIVED = frozenset(("site_id", "weekday", "local_hour"))


def event_days(events: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(site, day, dim, value) with all event counters and exact distinct visitors and visits, for the total and each dimension.

    A null value is a group of its own, apart from ''. Rows are counted by visit, then by visitor, then by group: where a
    visitor's rows lie in one task, as sessionize and dealt leave them, only the groups are shuffled.
    """
    pairs = F.explode(F.array(F.struct(F.lit("total").alias("dim"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    rows = events.select("site_id", "local_date", "type", "visitor", "session_id", "event_value", pairs.alias("p")).select("*", "p.*")
    acts = F.col("type") != "ping"
    count = lambda t: F.count_if(F.col("type") == t)
    keys = ["site_id", "local_date", "dim", "value"]
    counters = {"hits": F.count("*"), "actions": F.count_if(acts), "pageviews": count("pageview"), "events": count("event"), "outlinks": count("outlink"), "downloads": count("download"), "value_sum": F.sum(F.when(F.col("type") == "event", F.col("event_value")))}
    sums = [F.sum(c).alias(c) for c in counters]
    acted = lambda who: F.count_if((F.col("actions") > 0) & F.col(who).isNotNull())
    by_visit = rows.groupBy("visitor", "session_id", *keys).agg(*[c.alias(k) for k, c in counters.items()])
    by_visitor = by_visit.groupBy("visitor", *keys).agg(*sums, acted("session_id").alias("sessions"))
    out = by_visitor.groupBy(*keys).agg(*sums, acted("visitor").alias("visitors"), F.sum("sessions").alias("sessions"))
    return out.withColumn("value_sum", F.coalesce("value_sum", F.lit(0.0)))


@dataclass(frozen=True)
class Rollups:
    """hour_traffic(), event_days() and session_day_marginals() of the same days, the dimensions they have, and the bounce threshold they were counted at."""

    hours: DataFrame
    days: DataFrame
    visits: DataFrame
    event_dims: tuple[str, ...]
    visit_dims: tuple[str, ...]
    bounce_ms: int = BOUNCE_MS


def _leaves(tree: dict | None) -> list[dict]:
    if tree is None:
        return []
    inner = tree.get("all", tree.get("any")) or ([tree["not"]] if "not" in tree else None)
    return [tree] if inner is None else [leaf for t in inner for leaf in _leaves(t)]


def route(rollups: Rollups, query: Query, one_day: bool = False, rolling: bool = False) -> dict[str, str] | None:
    """Which rollup gives each metric of a query the rows that the raw tables give: hours, days or visits; None if raw rows must.

    At most one rolled dimension among keys and filters; hours only without one and only for what adds up; distinct counts
    only by day (or of one day), and under filters that keep a group to one row; no windows cut by instants.
    """
    leaves = _leaves(query.where)
    named = [*query.dims, *[leaf.get("dim", "") for leaf in leaves]]
    rolled = {d for d in named if d not in DERIVED}
    if rolling or len(rolled) > 1 or any(d.startswith("prop:") or d == "" for d in named) or any(leaf.get("scope") == "session" for leaf in leaves):
        return None
    dim = next(iter(rolled), None)
    hours = query.by == "hour" or "local_hour" in named
    if hours and dim:
        return None
    of_events, of_visits = query.sides
    stores = {}
    for m in of_visits:
        if hours or rollups.bounce_ms != BOUNCE_MS or (dim and dim not in rollups.visit_dims):
            return None
        stores[m] = "visits"
    for m in of_events:
        if dim and dim not in rollups.event_dims:
            return None
        if m in DISTINCT:
            # a filter leaves a group one row of a day if the group has the dimension, or if it names one value
            by_row = dim is None or dim in query.dims or (query.where is not None and "dim" in query.where and query.where["op"] in ("eq", "is_null"))
            # days of several sites or hours can't be put together
            if hours or not (query.by == "day" or (query.by is None and one_day)) or "site_id" not in query.dims or not by_row:
                return None
        elif m not in ADDED:
            return None
        stores[m] = "hours" if hours else "days"
    return stores


def routed(rollups: Rollups, query: Query, one_day: bool = False) -> DataFrame:
    """The rows of q.metric() out of rollups; raises where route() says that raw rows must give them."""
    stores = route(rollups, query, one_day)
    if stores is None:
        raise Unsupported("the rollups can't answer this")
    rolled = next((d for d in [*query.dims, *[leaf["dim"] for leaf in _leaves(query.where)]] if d not in DERIVED), None)
    ratios = {"avg_engagement": ("engaged_ms", "measured"), "bounce_rate": ("bounced", "visits"), "views_per_visit": ("views", "visits")}
    sums = {"visits": "visits", "engaged_ms": "engaged_ms", "engaged_sessions": "measured"}
    keys = {**({"bucket": bucket(query.by)} if query.by else {}), **{d: dimension(d) for d in query.dims}}
    sides = []
    for name, rows in (("hours", rollups.hours), ("days", rollups.days), ("visits", rollups.visits)):
        mine = [m for m in query.metrics if stores[m] == name]
        if not mine:
            continue
        if name != "hours":
            rows = rows.filter(F.col("dim") == (rolled or "total"))
            rows = rows.withColumnRenamed("value", rolled) if rolled else rows
        rows = rows.filter(predicate(query.where)) if query.where else rows
        made = {m: F.try_divide(F.sum(ratios[m][0]), F.sum(ratios[m][1])) if m in ratios else F.sum(sums[m]) if name == "visits" else F.sum({**ADDED, **DISTINCT}[m]) for m in mine}
        sides.append(rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*[c.alias(m) for m, c in made.items()]))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    out = out.groupBy(*keys).agg(*[F.max(m).alias(m) for m in query.metrics])  # each side gives a group once
    out = out.select(*keys, *[m if m in ratios else F.coalesce(m, F.lit(0.0 if m == "event_value_sum" else 0)).alias(m) for m in query.metrics])
    order = [F.col("bucket")] * bool(query.by) + [F.col(query.metrics[0]).desc_nulls_last()] + [F.col(d).asc_nulls_first() for d in query.dims]
    return out if not keys else out.orderBy(*order) if query.limit is None else out.orderBy(*order).limit(query.limit)
