"""Saved dashboards as sets of queries, answered together: all metric queries of one in a batch over each table.

A dashboard is a table of parts: a Query, or a kind of its own (dwell, changes, bands of time, scroll deciles, broken
paths, neighbours of a page). Parts in `scoped` ask only visits with an action that passes their filter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import query as q
from .batch import Query, batch, movers
from .requests import of_visits_with

MEASURED = ["engaged_ms", "engaged_sessions", "avg_engagement"]
OUTSIDE = {"dim": "ref_type", "op": "neq", "value": "internal"}
MOVER_DIMS = ("path", "ref_domain", "utm_campaign", "country")


@dataclass(frozen=True)
class Dashboard:
    metrics: dict[str, Query]
    kinds: dict[str, tuple] = field(default_factory=dict)
    scoped: dict[str, tuple[Query, dict]] = field(default_factory=dict)


def _top(metric: str, dim: str, limit: int, where: dict | None = None) -> Query:
    return Query([metric], (dim,), where=where, limit=limit)


# Fixed sets: the parts that each shipped dashboard has, with their metrics, dimensions and limits.
SITE = {
    "overview": Dashboard(
        {"kpis": Query(["visitors", "pageviews", "visits", *MEASURED, "bounce_rate"]), "series": Query(["visitors", "pageviews"], by="day"), "pages": _top("pageviews", "path", 8), "refs": _top("visitors", "ref_domain", 8, OUTSIDE), "countries": _top("visitors", "country", 7),
         "devices": Query(["visitors"], ("device_type",)), "events": Query(["events", "event_value_sum"], ("event_category", "event_action"), limit=7), "outlinks": _top("outlinks", "target_url", 10), "heatmap": Query(["pageviews"], ("local_hour", "weekday"))},
        {"dwell": ("dwell", None, 10), "changes": ("changes", "visits")}),
    "acquisition": Dashboard(
        {"kpis": Query(["visitors", "visits", "pageviews", "bounce_rate"]), "series": Query(["visitors"], by="day"), "refs": _top("visitors", "ref_domain", 10, OUTSIDE), "channels": _top("visits", "ref_type", 6), "sources": _top("visitors", "utm_source", 8),
         "mediums": _top("visitors", "utm_medium", 8), "campaigns": _top("visitors", "utm_campaign", 8), "hygiene": _top("visits", "campaign_status", 3)}),
    "content": Dashboard(
        {"kpis": Query(["pageviews", "visitors", *MEASURED, "views_per_visit"]), "pages": _top("pageviews", "path", 10), "entries": _top("visits", "entry_path", 8), "exits": _top("visits", "exit_path", 8)},
        {"dwell": ("dwell", None, 10), "dwellhist": ("bands", None), "scrollhist": ("deciles", None), "broken": ("missing", 8)}),
    "campaigns": Dashboard(
        {"kpis": Query(["visitors", "visits", "pageviews", "events"]), "series": Query(["visits", "visitors"], by="day"), "campaigns": _top("visitors", "utm_campaign", 10), "bysource": Query(["visits"], ("utm_campaign", "utm_source"), limit=10),
         "hygiene": _top("visits", "campaign_status", 3), "mediums": _top("visits", "utm_medium", 8)}),
    "all-sites": Dashboard({"sites": Query(["visitors"], ("site_id",), "day")}),
}


def page_detail(path: str) -> Dashboard:
    on = {"dim": "path", "op": "eq", "value": path}
    edge = lambda end: Query(["visits"], where={"dim": end, "op": "eq", "value": path})
    return Dashboard(
        {"kpis": Query(["pageviews", "visitors"], where=on), "entries": edge("entry_path"), "exits": edge("exit_path"), "trend": Query(["pageviews", "visitors"], by="day", where=on)},
        {"dwell": ("dwell", path, 1), "prev": ("adjacency", path, "in", 8), "next": ("adjacency", path, "out", 8), "dwellhist": ("bands", path), "scrollhist": ("deciles", path)},
        {"refs": (_top("visits", "ref_domain", 8), on)})


def detail(dim: str, value: str) -> Dashboard:
    """Of a referrer (ref_domain) or a campaign (utm_campaign)."""
    on = {"dim": dim, "op": "eq", "value": value}
    parts = {"kpis": Query(["visitors", "visits", "pageviews", *MEASURED, "bounce_rate"], where=on), "trend": Query(["visits"], by="day", where=on), "landing": _top("visits", "entry_path", 8, on), "pages": _top("pageviews", "path", 8, on)}
    if dim == "ref_domain":
        parts |= {"campaigns": _top("visits", "utm_campaign", 8, on), "countries": _top("visitors", "country", 8, on)}
    else:
        parts |= {"sources": Query(["visits"], ("utm_source", "utm_medium"), where=on, limit=8), "status": Query(["visits"], ("campaign_status",), where=on)}
    return Dashboard(parts)


def answers(dashboard: Dashboard, events: DataFrame, visits: DataFrame, missing: DataFrame | None = None, current: tuple[str, str] | None = None, previous: tuple[str, str] | None = None) -> dict[str, DataFrame]:
    """`metrics` (all of its queries in one table, see batch()) and a table for each part of another kind.

    `changes` is there only with two windows, `missing` only with missing hits. Both tables need campaign_status where a part asks it.
    """
    out = {"metrics": batch(events, visits, dashboard.metrics)}
    legs = q.page_legs(events)
    for name, (kind, *args) in dashboard.kinds.items():
        if kind == "dwell":
            out[name] = q.dwell(legs, *args)
        elif kind == "bands":
            out[name] = q.dwell_bands(legs, *args)
        elif kind == "deciles":
            out[name] = q.scroll_deciles(legs, *args)
        elif kind == "adjacency":
            out[name] = q.adjacency(events, *args)
        elif kind == "missing" and missing is not None:
            out[name] = q.broken_paths(missing, None, *args)
        elif kind == "changes" and current and previous:
            out[name] = movers(events, visits, args[0], MOVER_DIMS if args[0] not in q.VISIT_METRICS else tuple(d for d in MOVER_DIMS if d != "path"), current, previous)
    for name, (query, tree) in dashboard.scoped.items():
        out[name] = batch(of_visits_with(events, visits, tree), q.with_session_match(events, visits, tree), {name: query})
    return out
