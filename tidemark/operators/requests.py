"""What a request asks beside its metrics: whose visits, which sites, which buckets, and what can't be answered."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import BOTH_DIMS, BOUNCE_MS, SESSION_DIMS, Unsupported, predicate


@dataclass(frozen=True)
class Measure:
    """How a metric may be put together again: sum, distinct, max, or a ratio of two others."""

    unit: str
    population: str
    kind: str
    parts: tuple[str, str] | None = None


MEASURES = {
    "visitors": Measure("count", "actions", "distinct"), "visits": Measure("count", "sessions", "sum"), "pageviews": Measure("count", "pageviews", "sum"), "events": Measure("count", "events", "sum"),
    "outlinks": Measure("count", "outlinks", "sum"), "downloads": Measure("count", "downloads", "sum"), "event_value_sum": Measure("value", "events", "sum"), "engaged_ms": Measure("ms", "sessions", "sum"),
    "engaged_sessions": Measure("count", "measured_sessions", "sum"), "avg_engagement": Measure("ms", "measured_sessions", "ratio", ("engaged_ms", "engaged_sessions")),
    "bounce_rate": Measure("rate", "sessions", "ratio", ("bounced", "visits")), "views_per_visit": Measure("number", "sessions", "ratio", ("session_pageviews", "visits")), "max_ms": Measure("ms", "measured_pageviews", "max"),
}


def measures(metrics: list[str], dims: tuple[str, ...] = ()) -> dict[str, Measure]:
    """The header of an answer. Under a dimension of events, visits are the distinct visits with an action."""
    of_events = any(d not in BOTH_DIMS and d not in SESSION_DIMS for d in dims)
    return {m: Measure("count", "actions", "distinct") if m == "visits" and of_events else MEASURES[m] for m in metrics}


def whole(metric: str, columns: list[str]) -> Column:
    """Aggregate that makes a metric of finer buckets one of all of them: sums add, the greatest stay, ratios are their parts'
    quotient or, without the numerator, weighed by what they divide by. Distinct counts refuse."""
    m = MEASURES.get(metric)
    if m is None or m.kind == "distinct":
        raise Unsupported(f"{metric} of parts is not {metric} of the whole")
    if m.kind != "ratio":
        return {"sum": F.sum, "max": F.max}[m.kind](metric)
    over, under = m.parts
    if under not in columns:
        raise Unsupported(f"{metric} needs {under} beside it")
    weighed = F.sum(over) if over in columns else F.sum(F.coalesce(F.col(metric), F.lit(0)) * F.col(under))
    return F.try_divide(weighed, F.sum(under))


def per_bucket(metric: str, columns: list[str]) -> Column:
    """Aggregate of a metric's typical bucket: the mean of sums and of distinct counts, others as of the whole."""
    return F.sum(metric) / F.count("*") if MEASURES[metric].kind in ("sum", "distinct") else whole(metric, columns)


def typical(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row from a row a bucket: per_bucket() of each metric."""
    return rows.agg(*[per_bucket(m, rows.columns).alias(m) for m in metrics])


Tree = str | float | tuple[str, "Tree", "Tree"]


FORMULA_LENGTH, FORMULA_TERMS = 200, 16
_SIGNS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}


def formula(text: str) -> Tree:
    """The tree of a formula as people write it: metrics, plain numbers, + - * / and parentheses; it must read a metric.

    Refused: over FORMULA_LENGTH characters, over FORMULA_TERMS metrics, numbers and signs, any other name, sign or character.
    """
    if len(text) > FORMULA_LENGTH or not re.fullmatch(r"[a-z0-9_.+*/() -]+", text):
        raise Unsupported("a formula has metrics, numbers, + - * / and parentheses, at most 200 characters")
    source = re.sub(r"(?<![\w.])0+(?=\d)", "", text).strip()  # numbers may begin with zeros here, which Python refuses
    try:
        parsed = ast.parse(source, mode="eval")
    except SyntaxError as e:
        raise Unsupported(f"not a formula: {text}") from e
    terms, read = 0, 0

    def tree(n: ast.expr) -> Tree:
        nonlocal terms, read
        terms += 1
        if terms > FORMULA_TERMS:
            raise Unsupported(f"a formula has at most {FORMULA_TERMS} metrics, numbers and signs")
        match n:
            case ast.BinOp(left, op, right) if type(op) in _SIGNS:
                return (_SIGNS[type(op)], tree(left), tree(right))
            case ast.Name(id=name) if name in MEASURES and name != "max_ms":
                read += 1
                return name
            case ast.Constant(value=value) if re.fullmatch(r"\d+(\.\d+)?", ast.get_source_segment(source, n) or ""):
                return float(value)
        raise Unsupported(f"not a metric, a number or a sign of a formula: {ast.unparse(n)}")

    made = tree(parsed.body)
    if not read:
        raise Unsupported("a formula reads at least one metric")
    return made


def metrics_of(tree: Tree) -> list[str]:
    """The metrics that a tree reads, each once, in its order."""
    if isinstance(tree, tuple):
        return list(dict.fromkeys([*metrics_of(tree[1]), *metrics_of(tree[2])]))
    return [tree] if isinstance(tree, str) else []


def derived(rows: DataFrame, name: str, tree: Tree, by: str | None = None, dims: tuple[str, ...] = ()) -> DataFrame:
    """A column of + - * / over metrics, as ("/", "pageviews", "visits"); null where divided by zero.

    Distinct counts of longer or shorter buckets than days aren't sums of days, so they are refused there.
    """
    ops: dict[str, Callable[[Column, Column], Column]] = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide}

    def made(t: Tree) -> Column:
        if isinstance(t, tuple):
            return ops[t[0]](made(t[1]), made(t[2]))
        if isinstance(t, str):
            if by not in (None, "day") and measures([t], dims)[t].kind == "distinct":
                raise Unsupported(f"{name} reads the distinct count {t}: by day or without a bucket only")
            return F.col(t).cast("double")
        return F.lit(float(t))

    return rows.withColumn(name, made(tree))


def of_visits_with(events: DataFrame, visits: DataFrame, tree: dict) -> DataFrame:
    """Events, pings too, of visits with a matching action; or, by entry or exit page, of matching visits."""
    if tree.get("dim") in SESSION_DIMS:
        match = visits.filter(predicate(tree)).select("session_id")
    else:
        match = events.filter("type <> 'ping'").filter(predicate(tree)).select("session_id")
    return events.join(match.distinct(), "session_id", "left_semi")


def sites_in_scope(sites: DataFrame, scope: int | str = "all", allowed: list[int] | None = None) -> DataFrame:
    """All sites that the asker may see, or the one named; one out of reach is refused like one that isn't there."""
    seen = sites if allowed is None else sites.filter(F.col("site_id").isin(allowed))
    if scope == "all":
        return seen
    one = seen.filter(F.col("site_id") == scope)
    if one.isEmpty():
        raise Unsupported(f"unknown site {scope}")
    return one


def refuse_pruned(window: DataFrame, horizon_ms: int | None) -> None:
    """Raises if a site's window starts on or before the local day of the horizon, below which raw rows are gone."""
    if horizon_ms is not None:
        floor = F.date_format(F.from_utc_timestamp(F.timestamp_millis(F.lit(horizon_ms)), F.col("timezone")), "yyyy-MM-dd")
        if not window.filter(F.col("first") <= floor).isEmpty():
            raise Unsupported("raw rows of a part of this range are gone; ask for later days")


def bucket_for(by: str | None, first: str, last: str) -> str | None:
    """Days become hours where a range is one day."""
    return "hour" if by == "day" and first == last else by


def session_day_marginals(visits: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(site, day, dim, value) counters of visits, for the total and each dimension; a null value is a group of its own.

    Visits are combined by group where they are read, so only the groups are shuffled.
    """
    bounced = (F.col("pageviews") == 1) & (F.col("events") == 0) & (F.col("engaged_ms") < BOUNCE_MS)
    counts = {"visits": F.count("*"), "measured": F.count_if(F.col("engaged_ms") > 0), "engaged_ms": F.sum("engaged_ms"), "bounced": F.count_if(bounced), "views": F.sum("pageviews")}
    pairs = F.explode(F.array(F.struct(F.lit("total").alias("dim"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    rows = visits.select("site_id", "local_date", "engaged_ms", "pageviews", "events", pairs.alias("p"))
    return rows.groupBy("site_id", "local_date", "p.dim", "p.value").agg(*[c.alias(k) for k, c in counts.items()])
