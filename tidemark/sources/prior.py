"""Events and visits of the product's prior version, healed on the way in, and the gates that hold the result against its source.

The prior version kept tracking parameters in stored paths, knew no click ids, kept campaign values as received, and gave
a visit a day but no hour. Healing is one pass of projections over each table: paths lose their tracking parameters, a row
without any campaign value takes the source and medium of the click id on its (first) page, other campaign values are
normalized and aliased with what was received kept beside them, and a visit's hour comes from its start in its site's
zone. Each row tells what was changed, so the report is one aggregate of stored rows.

Rows come in by ranges of ids above watermarks, so an import that stopped goes on where it stood; a store that holds
rows of anything else is refused. Sites and aliases are small dimension tables, left to Spark to broadcast.

Defined cases: a null path stays null, one that can't be read as a URL stays as it is and has no click id; a blank
campaign value is null with the blank kept as received; a visit of an unknown site has its hour in UTC; empty tables
land nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import web
from ..operators import query as q
from ..operators.query import Unsupported
from ..operators.visits import aliased
from ..sinks import facts
from .warehouse import above, top, watermarks

UTM = tuple(web.CAMPAIGN)
FLAGS = ("paths_cleaned", "attributed", "utm_normalized")
#: A stored path that names a host must name one that can be.
_NO_URL = r"^([A-Za-z][A-Za-z0-9+.-]*:)?//(?!([^/?#@]*@)?([\p{L}\p{N}._~-]+|\[[0-9A-Fa-f:.]+\])(:\d*)?([/?#]|$))"


def readable(path: Column) -> Column:
    return path.isNotNull() & ~path.rlike(_NO_URL)


def clean_path(path: Column) -> Column:
    """A stored path without its tracking parameters; what stays keeps its order and its text."""
    parts = F.split(F.substr(path, F.instr(path, "?") + 1), "&")
    kept = F.filter(parts, lambda p: ~web.tracks(web.decoded(F.substring_index(p, "=", 1))))
    head = F.substring_index(path, "?", 1)
    cleaned = F.when(F.size(kept) == F.size(parts), path).when(F.size(kept) == 0, head).otherwise(F.concat(head, F.lit("?"), F.array_join(kept, "&")))
    return F.when(F.contains(path, F.lit("?")) & readable(path), cleaned).otherwise(path)


def healed(rows: DataFrame, pages: tuple[str, ...], aliases: DataFrame) -> DataFrame:
    """rows with clean `pages`, attribution and campaign values of today, what was received (`*_raw`), and FLAGS. The first page has the click id."""
    known = web.with_url(rows.withColumn("__url", F.when(readable(F.col(pages[0])), F.concat(F.lit("http://x"), pages[0]))), "__url")
    none = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in UTM])
    known = web.layered(known, **{f"{c}_got": F.col(c) for c in UTM}, __click=none & F.coalesce(web.click_source(1), F.lit(None)).isNotNull())
    clicked = {"utm_source": 1, "utm_medium": 2}
    known = web.layered(known, **{c: F.when(F.col("__click"), web.click_source(clicked[c]) if c in clicked else F.lit(None)).otherwise(web.normalized(F.col(f"{c}_got"))) for c in UTM})
    for c in UTM:
        known = aliased(known, aliases, c)
    kept = {f"{c}_raw": F.when(F.col(f"{c}_got").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"{c}_got")), F.col(f"{c}_got")) for c in UTM}
    known = known.withColumns({**kept, **{f"__{p}": clean_path(F.col(p)) for p in pages}})
    flags = {
        "paths_cleaned": reduce(lambda a, b: a + b, [(~F.col(f"__{p}").eqNullSafe(F.col(p))).cast("int") for p in pages]),
        "attributed": F.col("__click"), "utm_normalized": F.coalesce(*[F.col(f"{c}_raw") for c in UTM]).isNotNull(),
    }
    out = known.withColumns({**flags, "ref_type": F.when(F.col("__click"), "campaign").otherwise(F.col("ref_type"))})
    out = out.withColumns({p: F.col(f"__{p}") for p in pages})
    return out.drop(*web.U_COLUMNS, "__url", "__click", *[f"{c}_got" for c in UTM], *[f"__{p}" for p in pages])


def healed_events(events: DataFrame, aliases: DataFrame) -> DataFrame:
    return healed(events, ("path",), aliases)


def healed_visits(visits: DataFrame, sites: DataFrame, aliases: DataFrame) -> DataFrame:
    """Visits as healed() leaves them, attributed by their entry page, with local_hour of their start."""
    zones = sites.select("site_id", web.zone(F.col("timezone")).alias("__zone"))
    timed = visits.join(zones, "site_id", "left")
    hour = F.hour(web.local_time(F.col("started_at"), F.coalesce("__zone", F.lit("UTC"))))
    return healed(timed.withColumn("local_hour", hour).drop("__zone"), ("entry_path", "exit_path"), aliases)


def increment(store: facts.Store, number: int, events: DataFrame, visits: DataFrame, sites: DataFrame, aliases: DataFrame, until: tuple[int, int] | None = None) -> bool:
    """Land the rows whose `id` is above the watermarks, up to `until` (event id, visit id); False if there are none or the flush was committed before.

    Refused where the store holds rows but no watermarks: it isn't fresh, or its import is finished.
    """
    if number in facts.flushes(store):
        return False
    marks = watermarks(store)
    if not marks and (facts.flushes(store, "events") or facts.flushes(store, "visits")):
        raise Unsupported("the store holds rows of its own; an import of the prior version needs a fresh one")
    tops = dict(zip(("events", "visits"), until or (None, None)))
    new = {name: above(rows, "id", marks.get(name), tops[name]) for name, rows in (("events", events), ("visits", visits))}
    landed = {"events": healed_events(new["events"], aliases), "visits": healed_visits(new["visits"], sites, aliases)}
    written = {name: facts._write(store, name, rows, number) for name, rows in landed.items()}
    tops = {name: rows.agg(top("id")).first()[0] for name, rows in written.items()}
    if all(t is None for t in tops.values()):
        return False
    marks_now = store.spark.createDataFrame([(0, "", name, int(t)) for name, t in tops.items() if t is not None], "site_id long, local_date string, source string, mark long")
    facts._commit(store, number, {**{name: (rows, False) for name, rows in written.items()}, "marks": (facts._write(store, "marks", marks_now, number), False)})
    return True


def report(store: facts.Store) -> DataFrame:
    """events, visits, paths_cleaned, attributed, utm_normalized of all that was landed."""
    sums = lambda rows: rows.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in FLAGS])
    both = sums(facts.read(store, "events")).withColumn("table", F.lit("events")).unionByName(sums(facts.read(store, "visits")).withColumn("table", F.lit("visits")))
    of = lambda t: F.max(F.when(F.col("table") == t, F.col("rows"))).alias(t)
    return both.agg(of("events"), of("visits"), *[F.sum(c).alias(c) for c in FLAGS])


_CELL = ("gate", "site_id", "cell", "measure")


def _long(rows: DataFrame, gate: str, cell: Column, measures: list[str], site: Column | None = None) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("value")) for m in measures]))
    return rows.select(F.lit(gate).alias("gate"), (F.col("site_id") if site is None else site).cast("long").alias("site_id"), cell.cast("string").alias("cell"), pairs.alias("p")).select("gate", "site_id", "cell", "p.measure", "p.value")


def _day_cells(events: DataFrame, visits: DataFrame) -> list[DataFrame]:
    act, none = F.col("type") != "ping", F.lit(None).cast("long")
    by_day = events.groupBy("site_id", "local_date").agg(
        F.count_distinct(F.when(act, F.col("session_id"))).alias("visits"), F.count_if(F.col("type") == "pageview").alias("pageviews"),
        F.count_if(F.col("type") == "event").alias("events"), F.count_distinct(F.when(act, F.col("visitor"))).alias("visitors"))
    of_visits = visits.groupBy("site_id", "local_date").agg(F.count("*").alias("sessions"), F.sum("engaged_ms").alias("engaged_ms"))
    counts = [_long(t.agg(F.count("*").alias("n")), "rows", F.lit(name), ["n"], none) for name, t in (("events", events), ("visits", visits))]
    return [*counts, _long(by_day, "events per day", F.col("local_date"), ["visits", "pageviews", "events", "visitors"]), _long(of_visits, "sessions per day", F.col("local_date"), ["sessions", "engaged_ms"])]


def gate_faults(source_events: DataFrame, source_visits: DataFrame, events: DataFrame, visits: DataFrame) -> DataFrame:
    """gate, site_id, cell, measure, source, target of whatever differs, in both directions; no rows mean that all gates hold.

    Rows of each table; visits, page views, events and visitors of every site's day; sessions and engaged time likewise;
    and three queries about the first site over the source's days (totals, page views of its paths, visits of its days):
    the target answers by `metric`, the source is counted directly, with its paths cleaned. Campaign values may change, so no
    gate groups by them. Day cells that one side lacks count as faults; a day's visits of 0 equal none.
    """
    span = source_events.agg(F.min("local_date").alias("first"), F.max("local_date").alias("last"), F.min("site_id").alias("site")).first()
    here, there = _day_cells(source_events, source_visits), _day_cells(events, visits)
    if span.site is not None:
        inside = (F.col("site_id") == span.site) & F.col("local_date").between(span.first, span.last)
        e, s, views = source_events.filter(inside), source_visits.filter(inside), F.count_if(F.col("type") == "pageview").alias("pageviews")
        site = F.lit(span.site)
        te, ts = events.filter(inside), visits.filter(inside)
        n = F.count("*").alias("visits")
        paths = e.filter("type = 'pageview'").groupBy(clean_path(F.col("path")).alias("path")).agg(F.count("*").alias("pageviews"))
        totals = F.lit("all")
        here += [_long(e.agg(views), "totals", totals, ["pageviews"], site), _long(s.agg(n), "totals", totals, ["visits"], site), _long(paths, "pages", F.col("path"), ["pageviews"], site),
                 _long(s.groupBy("local_date").agg(n), "daily", F.col("local_date"), ["visits"], site)]
        asked = q.metric(te, None, ["pageviews"], ("path",)).filter("pageviews > 0")
        there += [_long(q.metric(te, ts, ["pageviews", "visits"]), "totals", totals, ["pageviews", "visits"], site), _long(asked, "pages", F.col("path"), ["pageviews"], site),
                  _long(q.metric(None, ts, ["visits"], by="day"), "daily", F.col("bucket"), ["visits"], site)]
    # both sides are laid under each other: one shuffle by cell, and null sites and paths are cells like others
    laid = reduce(DataFrame.unionByName, [c.withColumns({"source": F.col("value"), "target": F.lit(None).cast("long")}) for c in here] + [c.withColumns({"source": F.lit(None).cast("long"), "target": F.col("value")}) for c in there])
    both = laid.groupBy(*_CELL).agg(F.max("source").alias("source"), F.max("target").alias("target"))
    same = F.col("source").eqNullSafe(F.col("target")) | ((F.col("gate") == "daily") & (F.coalesce("source", F.lit(0)) == F.coalesce("target", F.lit(0))))
    return both.filter(~same)


def finish(store: facts.Store, number: int, source_events: DataFrame, source_visits: DataFrame) -> DataFrame:
    """The gates' faults; where there are none the watermarks go, so that the store takes no further import."""
    faults = gate_faults(source_events, source_visits, facts.read(store, "events"), facts.read(store, "visits"))
    if faults.isEmpty():
        marks = facts.read(store, "marks")
        if "mark" in marks.columns:
            facts.replace_days(store, number, "marks", marks.select(*facts.PARTITION).distinct(), marks.limit(0))
    return faults
