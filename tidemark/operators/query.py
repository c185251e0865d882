"""The query vocabulary: filters, metrics, and the session-scoped kinds."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.web import fold
from .visits import BOUNCE_MS


class Unsupported(ValueError):
    """A combination that has no right answer; raised before any job starts."""


EVENT_DIMS = frozenset("path hostname title target_url screen lang event_category event_action event_name local_hour".split())
BOTH_DIMS = frozenset("site_id ref_domain ref_type utm_source utm_medium utm_campaign country region city browser os device_type weekday".split())
SESSION_DIMS = frozenset("entry_path exit_path".split())
GLOB_LIMIT, GLOB_STARS, MOST_DEPTH, MOST_LEAVES, MOST_TOP = 256, 8, 4, 32, 16


def dimension(name: str) -> Column:
    if name == "weekday":  # 0 is Sunday
        return F.dayofweek(F.to_date("local_date")) - 1
    if name.startswith("prop:"):
        if not re.fullmatch(r"[a-z0-9_-]{1,32}", name[5:]):
            raise Unsupported(f"no such property: {name}")
        value = F.get_json_object("props", f"$['{name[5:]}']")
        return F.when(value == "true", "1").when(value == "false", "0").otherwise(value)
    return F.col(name)


def bucket(name: str) -> Column:
    day = F.to_date("local_date")
    made = {"hour": F.concat("local_date", F.lit(" "), F.lpad(F.col("local_hour").cast("string"), 2, "0"), F.lit(":00")), "day": F.col("local_date"),
            "week": F.date_format(F.date_trunc("week", day), "yyyy-MM-dd"), "month": F.date_format(day, "yyyy-MM")}
    if name not in made:
        raise Unsupported(f"no such bucket: {name}")
    return made[name]


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for * ? and [...]."""
    if len(glob) > GLOB_LIMIT or glob.count("*") > GLOB_STARS:
        raise Unsupported("glob too long or too many stars")
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c in "*?":
            out += ".*" if c == "*" else "."
        elif end > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out, i = out + f"[{body}]", end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def leaves(tree: dict) -> int:
    inner = tree.get("all", tree.get("any")) or ([tree["not"]] if "not" in tree else None)
    return 1 if inner is None else sum(map(leaves, inner))


def predicate(tree: dict, depth: int = 1) -> Column:
    """A Column for {"dim", "op", "value"} leaves under {"all": []}, {"any": []}, {"not": {}}. Unknown is false."""
    if depth > MOST_DEPTH:
        raise Unsupported("filters nest too deep")
    if depth == 1 and (leaves(tree) > MOST_LEAVES or len(tree.get("all", tree.get("any", []))) > MOST_TOP):
        raise Unsupported("too many filters")
    if "all" in tree or "any" in tree:
        parts = [predicate(t, depth + 1) for t in tree.get("all", tree.get("any"))]
        both = (lambda a, b: a & b) if "all" in tree else (lambda a, b: a | b)
        return reduce(both, parts, F.lit("all" in tree))
    if "not" in tree:
        return ~F.coalesce(predicate(tree["not"], depth + 1), F.lit(False))
    c, op, value = dimension(tree["dim"]), tree["op"], tree.get("value")
    if (op == "in") != isinstance(value, list):
        raise Unsupported(f"{op} takes {'a list' if op == 'in' else 'one value'}")
    folded = lambda v: str(v).translate({u: u + 32 for u in range(65, 91)})
    ops = {"eq": lambda: c == value, "neq": lambda: ~c.eqNullSafe(F.lit(value)), "in": lambda: c.isin(value) if value else F.lit(False), "contains": lambda: fold(c).contains(folded(value)),
           "starts": lambda: fold(c).startswith(folded(value)), "is_null": lambda: c.isNull(), "glob": lambda: c.rlike(glob_pattern(value))}
    if op not in ops:
        raise Unsupported(f"no such operator: {op}")
    return ops[op]()


def with_segments(tree: dict, saved: dict[str, dict], inside: bool = False) -> dict:
    """The tree with every {"segment": name} replaced by the saved tree; a saved tree may not name another."""
    if "segment" in tree:
        if inside or tree["segment"] not in saved:
            raise Unsupported(f"no such segment, or one inside another: {tree['segment']}")
        return with_segments(saved[tree["segment"]], saved, True)
    if "not" in tree:
        return {"not": with_segments(tree["not"], saved, inside)}
    return {k: [with_segments(t, saved, inside) for t in v] if k in ("all", "any") else v for k, v in tree.items()}


EVENT_METRICS = ("visitors", "pageviews", "events", "outlinks", "downloads", "event_value_sum")
VISIT_METRICS = ("visits", "engaged_ms", "engaged_sessions", "avg_engagement", "bounce_rate", "views_per_visit")


def _event_metrics() -> dict[str, Column]:
    action = F.col("type") != "ping"
    count = lambda t: F.count_if(F.col("type") == t)
    return {"visitors": F.count_distinct(F.when(action, F.col("visitor"))), "pageviews": count("pageview"), "events": count("event"), "outlinks": count("outlink"), "downloads": count("download"),
            "event_value_sum": F.coalesce(F.sum(F.when(F.col("type") == "event", F.col("event_value"))), F.lit(0.0))}


def _session_metrics() -> dict[str, Column]:
    bounced = (F.col("pageviews") == 1) & (F.col("events") == 0) & (F.col("engaged_ms") < BOUNCE_MS)
    n, measured = F.count("*"), F.count_if(F.col("engaged_ms") > 0)
    return {"visits": n, "engaged_ms": F.coalesce(F.sum("engaged_ms"), F.lit(0)), "engaged_sessions": measured, "avg_engagement": F.try_divide(F.sum("engaged_ms"), measured),
            "bounce_rate": F.try_divide(F.count_if(bounced), n), "views_per_visit": F.try_divide(F.sum("pageviews"), n)}


def metric(events: DataFrame, visits: DataFrame, metrics: list[str], dims: tuple[str, ...] = (), by: str | None = None, where: dict | None = None, limit: int | None = None) -> DataFrame:
    """Group keys and metrics. Event and visit sides are one aggregate each, merged on null-safe keys."""
    if limit and by and dims:
        raise Unsupported("a limit with a bucket and a dimension")
    event_only = [d for d in dims if d in EVENT_DIMS or d.startswith("prop:")]
    visit_only = [d for d in dims if d in SESSION_DIMS]
    on_events, on_visits = _event_metrics(), _session_metrics()
    if unknown := [m for m in metrics if m not in on_events and m not in on_visits]:
        raise Unsupported(f"no such metric: {unknown}")
    if event_only:  # under an event dimension a visit counts where it has an action
        on_events["visits"] = F.count_distinct(F.when(F.col("type") != "ping", F.col("session_id")))
        on_visits = {}
    if (visit_only and any(m in on_events for m in metrics)) or (event_only and any(m not in on_events for m in metrics)):
        raise Unsupported("metric and dimension live on different tables")
    keys = {**({"bucket": bucket(by)} if by else {}), **{d: dimension(d) for d in dims}}
    sides = []
    for table, known in ((events, on_events), (visits, on_visits)):
        if own := [m for m in metrics if m in known]:
            rows = table.filter(predicate(where)) if where else table
            sides.append((own, rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*[known[m].alias(m) for m in own])))
    out = sides[0][1]
    if len(sides) == 2:
        right = sides[1][1].withColumnsRenamed({k: f"__{k}" for k in keys})
        same = reduce(lambda a, b: a & b, [out[k].eqNullSafe(right[f"__{k}"]) for k in keys], F.lit(True))
        out = out.join(right, same, "full_outer")
        hit = F.col(sides[0][0][0]).isNotNull()
        out = out.select(*[F.when(hit, F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in keys], *metrics)
        zero = [m for m in metrics if m not in ("avg_engagement", "bounce_rate", "views_per_visit")]
        out = out.fillna(0, subset=zero)
    out = out.select(*keys, *metrics)
    order = [F.col("bucket")] * bool(by) + [F.col(metrics[0]).desc_nulls_last()] + [F.col(d).asc_nulls_first() for d in dims]
    return (out.orderBy(*order) if keys else out) if not limit else out.orderBy(*order).limit(limit)


def with_session_match(events: DataFrame, visits: DataFrame, tree: dict) -> DataFrame:
    """Visits with at least one matching hit that isn't a ping."""
    hit = events.filter("type != 'ping'").filter(predicate(tree)).select("session_id")
    return visits.join(hit, "session_id", "left_semi")


def label() -> Column:
    event = F.concat(F.lit("event: "), F.col("event_category"), F.lit(" · "), F.col("event_action"))
    return F.coalesce(F.when(F.col("type") == "event", event).otherwise(F.col("path")), F.lit(""))


def steps(events: DataFrame) -> DataFrame:
    """(session_id, n, label) of what visitors did, all hits but pings, repeats collapsed."""
    order = Window.partitionBy("session_id").orderBy("seq")
    named = events.filter("type <> 'ping'").select("session_id", "seq", label().alias("label"))
    ends = named.withColumn("next", F.lead("label").over(order)).filter(~F.col("label").eqNullSafe(F.col("next")))
    return ends.select("session_id", "label", F.row_number().over(order).alias("n"))


def transitions(events: DataFrame, n_steps: int = 3, limit: int | None = 10) -> DataFrame:
    """Edges from step n to n + 1, the commonest `limit` of each step, or all."""
    order = Window.partitionBy("session_id").orderBy("n")
    edges = steps(events).withColumn("to", F.lead("label").over(order)).filter(F.col("to").isNotNull() & (F.col("n") <= n_steps))
    counted = edges.groupBy(F.col("n").alias("step"), F.col("label").alias("from"), "to").agg(F.count("*").alias("sessions"))
    if limit is None:
        return counted
    rank = Window.partitionBy("step").orderBy(F.col("sessions").desc(), "from", "to")
    return counted.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= limit).drop("rank")


def flows(events: DataFrame, visits: DataFrame, n_steps: int = 4, limit: int | None = 20) -> DataFrame:
    """First-steps signatures, JSON arrays of labels: sessions, mean engaged time, share that ended within them."""
    whole = steps(events).groupBy("session_id").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("n") <= n_steps, F.struct("n", "label")))).alias("s"))
    signed = whole.select("session_id", "total", F.to_json("s.label").alias("steps")).join(visits.select("session_id", "engaged_ms"), "session_id")
    out = signed.groupBy("steps").agg(F.count("*").alias("sessions"), F.avg("engaged_ms").alias("avg_engaged"), F.avg((F.col("total") <= n_steps).cast("double")).alias("exit_rate"))
    return out if limit is None else out.orderBy(F.col("sessions").desc(), "steps").limit(limit)


def page_legs(events: DataFrame) -> DataFrame:
    """One row a page view: path, ms until the visit's next page, deepest scroll of its pings."""
    order = Window.partitionBy("session_id").orderBy("seq")
    page = (F.col("type") == "pageview").cast("int")
    walked = events.withColumn("page", F.sum(page).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("leg", F.lead("ts").over(order) - F.col("ts")).filter("page > 0")
    own = F.min_by("path", "seq").alias("path")
    return walked.groupBy("session_id", "page").agg(own, F.sum(F.when(F.col("leg").isNotNull(), F.least("leg", F.lit(20_000)))).alias("ms"), F.max("scroll_pct").alias("scroll"))


def dwell(legs: DataFrame, path: str | None = None, limit: int | None = None) -> DataFrame:
    """Measured time and scroll (0 to 1) of pages, of one page, or of the `limit` with the longest median; a page without path is ''."""
    named = legs.withColumn("path", F.coalesce("path", F.lit("")))
    rows = named if path is None else named.filter(F.col("path") == path)
    measured = rows.groupBy("path").agg(F.count("ms").alias("measured"), F.median("ms").alias("median_ms"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"), F.count("scroll").alias("scrolled"), (F.avg("scroll") / 100).alias("mean_scroll")).filter("measured > 0")
    return measured if limit is None else measured.orderBy(F.col("median_ms").desc(), "path").limit(limit)


def of_page(legs: DataFrame, path: str | None) -> DataFrame:
    return legs if path is None else legs.filter(F.coalesce("path", F.lit("")) == path)


BANDS = ((10_000, "0–10s"), (30_000, "10–30s"), (60_000, "30–60s"), (180_000, "1–3m"))


def dwell_bands(legs: DataFrame, path: str | None = None) -> DataFrame:
    """Measured page views by band of time, the shortest first."""
    legs = of_page(legs, path)
    band = reduce(lambda rest, b: F.when(F.col("ms") < b[0], b[1]).otherwise(rest), reversed(BANDS), F.lit("3m+"))
    return legs.filter("ms IS NOT NULL").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.min("ms").alias("__least")).orderBy("__least").drop("__least")


def scroll_deciles(legs: DataFrame, path: str | None = None) -> DataFrame:
    return of_page(legs, path).filter("scroll IS NOT NULL").groupBy(F.least(F.floor(F.col("scroll") / 10), F.lit(9)).alias("decile")).agg(F.count("*").alias("n"))


def adjacency(events: DataFrame, path: str, direction: str = "in", limit: int = 20) -> DataFrame:
    """Labels before (in) or after (out) a page, or (entry) / (exit), by distinct visits."""
    order = Window.partitionBy("session_id").orderBy("n")
    near, end = (F.lag("label"), "(entry)") if direction == "in" else (F.lead("label"), "(exit)")
    found = steps(events).withColumn("neighbour", F.coalesce(near.over(order), F.lit(end))).filter(F.col("label") == path)
    return found.groupBy("neighbour").agg(F.count_distinct("session_id").alias("sessions")).orderBy(F.col("sessions").desc(), "neighbour").limit(limit)


MOST_MOVERS = 1000


def changes(visits: DataFrame, dim: str, current: tuple[str, str], previous: tuple[str, str], limit: int = 10, weight: str | None = None) -> DataFrame:
    """Movers of a dimension's visits between two date windows; share of the whole net change. A row counts once, or its weight."""
    inside = lambda w: F.col("local_date").between(*w)
    counted = lambda w: F.count_if(inside(w)) if weight is None else F.sum(F.when(inside(w), F.col(weight)).otherwise(0))
    both = visits.filter(inside(current) | inside(previous)).groupBy(F.col(dim).alias("value")).agg(counted(current).alias("current"), counted(previous).alias("previous"))
    if limit > MOST_MOVERS:
        raise Unsupported(f"more than {MOST_MOVERS} movers")
    # the whole net change comes from the same aggregate: a grand total beside the values
    both = both.withColumn("all", F.lit(False)).unionByName(both.agg(F.sum("current").alias("current"), F.sum("previous").alias("previous")).withColumns({"value": F.lit(None).cast(dict(both.dtypes)["value"]), "all": F.lit(True)}))
    delta = both.withColumn("delta", F.col("current") - F.col("previous"))
    tops = delta.filter("all OR delta != 0").orderBy(F.col("all").desc(), F.abs("delta").desc(), F.col("current").desc(), F.col("value").asc_nulls_first()).limit(limit + 1)
    total = F.max(F.when(F.col("all"), F.col("delta"))).over(Window.partitionBy())  # over at most limit + 1 rows
    out = tops.withColumn("share", F.try_divide("delta", total)).filter("NOT all").drop("all")
    return out.orderBy(F.abs("delta").desc(), F.col("current").desc(), F.col("value").asc_nulls_first()).limit(limit)


MISSING_DIMS = frozenset("path ref_domain ref_type ref_path device_type country site_id local_hour".split())


def _dims(tree: dict) -> set[str]:
    inner = tree.get("all", tree.get("any")) or ([tree["not"]] if "not" in tree else None)
    return {tree["dim"]} if inner is None else set().union(*map(_dims, inner))


def broken_paths(missing: DataFrame, where: dict | None = None, limit: int | None = None) -> DataFrame:
    """Asked but missing paths: hits, hits with a referrer, the commonest one with its page, last date; most referred first.

    Links belong to no visit, so a filter on a visit's dimension is refused.
    """
    if where:
        if bad := _dims(where) - MISSING_DIMS:
            raise Unsupported(f"broken links know no {sorted(bad)}")
        missing = missing.filter(predicate(where))
    known = F.col("ref_domain").isNotNull()
    by_page = missing.groupBy("path", "ref_domain", "ref_path").agg(F.count("*").alias("n"), F.max("local_date").alias("last"))
    top = Window.partitionBy("path").orderBy(known.desc(), F.col("n").desc(), F.col("ref_domain").asc_nulls_first(), F.col("ref_path").asc_nulls_first())
    ranked = by_page.withColumn("k", F.row_number().over(top))
    first = lambda c: F.max(F.when(F.col("k") == 1, F.col(c)))
    out = ranked.groupBy("path").agg(F.sum("n").alias("hits"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("referred"), F.max("last").alias("last_date"), first("ref_domain").alias("top_referrer"), first("ref_path").alias("top_page"))
    ordered = [F.col("referred").desc(), F.col("hits").desc(), F.col("path").asc_nulls_first()]
    return out.orderBy(*ordered) if limit is None else out.orderBy(*ordered).limit(limit)


def hour_traffic(events: DataFrame) -> DataFrame:
    count = lambda t: F.count_if(F.col("type") == t).alias(f"{t}s")
    return events.groupBy("site_id", "local_date", "local_hour").agg(F.count("*").alias("hits"), F.count_if(F.col("type") != "ping").alias("actions"), *[count(t) for t in ("pageview", "event", "outlink", "download")], F.coalesce(F.sum("event_value"), F.lit(0.0)).alias("value_sum"))


def day_marginals(events: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(site, day, dim, value) counters for the total and each dimension: counted by visitor first, so distinct visitors are a count."""
    pairs = F.explode(F.array(F.struct(F.lit("total").alias("dim"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    counts = [F.count_if(F.col("type") != "ping").alias("actions"), F.count_if(F.col("type") == "pageview").alias("pageviews")]
    keys = ["site_id", "local_date", "dim", "value"]
    by_visitor = events.groupBy("site_id", "local_date", "visitor", *dims).agg(*counts).select("site_id", "local_date", "visitor", "actions", "pageviews", pairs.alias("p"))
    by_visitor = by_visitor.select("*", "p.*").groupBy(*keys, "visitor").agg(F.sum("actions").alias("actions"), F.sum("pageviews").alias("pageviews"))
    return by_visitor.groupBy(*keys).agg(F.sum("actions").alias("actions"), F.sum("pageviews").alias("pageviews"), F.count_if(F.col("actions") > 0).alias("visitors"))


def session_marginals(visits: DataFrame) -> DataFrame:
    bounced = (F.col("pageviews") == 1) & (F.col("events") == 0) & (F.col("engaged_ms") < BOUNCE_MS)
    return visits.groupBy("site_id", "local_date").agg(F.count("*").alias("visits"), F.count_if(F.col("engaged_ms") > 0).alias("measured"), F.sum("engaged_ms").alias("engaged_ms"), F.count_if(bounced).alias("bounced"), F.sum("pageviews").alias("views"))


def goal(events: DataFrame, visits: DataFrame, where: dict) -> DataFrame:
    """Per site: visits with a matching action, their share of visits, and the value of matching events."""
    hits = events.filter("type != 'ping'").filter(predicate(where)).groupBy("site_id").agg(F.count_distinct("session_id").alias("conversions"), F.sum("event_value").alias("value"))
    return visits.groupBy("site_id").agg(F.count("*").alias("visits")).join(hits, "site_id", "left").select("site_id", "visits", F.coalesce("conversions", F.lit(0)).alias("conversions"), F.try_divide(F.coalesce("conversions", F.lit(0)), "visits").alias("rate"), "value")


ACTIVE_MS, PAIR_KEYS = 5 * 60_000, 64


def active_visitors(hits: DataFrame, sites: DataFrame, ticks: DataFrame) -> DataFrame:
    """Distinct visitors of each site, by any hit, in the five minutes before each tick (ms); sites without any have 0.

    A hit at the tick itself shows at the next. It enters the two five-minute cells that its ticks may lie in, so the join
    is on equal cells. The result has a row a site and tick.
    """
    cell = F.floor(F.col("ts") / ACTIVE_MS)
    near = hits.select("site_id", "visitor", "ts", F.explode(F.array(cell, cell + 1)).alias("cell"))
    asked = ticks.select("tick", F.floor(F.col("tick") / ACTIVE_MS).alias("cell"))
    seen = near.join(asked, "cell").filter((F.col("ts") < F.col("tick")) & (F.col("ts") >= F.col("tick") - ACTIVE_MS))
    found = seen.groupBy("site_id", "tick").agg(F.count_distinct("visitor").alias("active"))
    # the result has every pair of a site and a tick; they are made in as many keys as tasks can share
    every = sites.select("site_id", F.pmod(F.xxhash64("site_id"), F.lit(PAIR_KEYS)).alias("key")).join(ticks.select("tick", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PAIR_KEYS - 1).cast("long"))).alias("key")), "key").drop("key")
    return every.join(found, ["site_id", "tick"], "left").fillna(0, ["active"]).select("site_id", "tick", "active")
