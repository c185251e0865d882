"""Windows of time in every site's own zone, the visits in them, comparisons, goals of one site, and series put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.web import local_time, zone
from .query import Unsupported, predicate
from .requests import MEASURES, per_bucket, whole

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
PRESET_DAYS = {"today": 1, "7d": 7, "30d": 30, "90d": 90}


def _day(ms: Column) -> Column:
    return F.date_format(local_time(ms, F.col("timezone")), "yyyy-MM-dd")


def bounds(sites: DataFrame, preset: str | tuple[str, str], now_ms: int) -> DataFrame:
    """site_id, timezone, first, last (local days) and, for the rolling 24h, from_ts and to_ts on edges of the local hour.

    A preset counts the site's own today; mtd begins with its month; a pair of days is taken as it is.
    """
    if isinstance(preset, str) and preset not in (*PRESET_DAYS, "mtd", "24h"):
        raise Unsupported(f"no such range: {preset}")
    zoned = sites.select("site_id", zone(F.col("timezone")).alias("timezone")).withColumn("local", local_time(F.lit(now_ms), F.col("timezone")))
    none = F.lit(None).cast("long")
    if preset == "24h":
        into = F.minute("local") * 60_000 + F.second("local") * 1000 + F.lit(now_ms % 1000)
        ends = zoned.withColumn("to_ts", F.lit(now_ms) - into + HOUR_MS).withColumn("from_ts", F.col("to_ts") - DAY_MS)
        return ends.select("site_id", "timezone", _day(F.col("from_ts")).alias("first"), _day(F.col("to_ts") - 1).alias("last"), "from_ts", "to_ts")
    today = F.to_date("local")
    first = {"mtd": lambda: F.trunc(today, "month")}.get(preset, lambda: F.date_sub(today, PRESET_DAYS[preset] - 1)) if isinstance(preset, str) else None
    days = [F.date_format(first(), "yyyy-MM-dd"), F.date_format(today, "yyyy-MM-dd")] if first else [F.lit(preset[0]), F.lit(preset[1])]
    return zoned.select("site_id", "timezone", days[0].alias("first"), days[1].alias("last"), none.alias("from_ts"), none.alias("to_ts"))


def _year_before(day: Column) -> Column:
    """The same day a year earlier; of 29 February the first of March."""
    back = F.add_months(day, -12)
    return F.when(F.date_format(day, "MM-dd") == "02-29", F.date_add(back, 1)).otherwise(back)


def compared(window: DataFrame, to: str | tuple[str, str] = "previous") -> DataFrame:
    """The window that a comparison takes: as long and just before, the same days a year earlier, or two days.

    A rolling window goes back by its own length, or by the days of the year before its last day.
    """
    if isinstance(to, tuple):
        return window.withColumns({"first": F.lit(to[0]), "last": F.lit(to[1]), "from_ts": F.lit(None).cast("long"), "to_ts": F.lit(None).cast("long")})
    if to not in ("previous", "year"):
        raise Unsupported(f"no such comparison: {to}")
    text = lambda d: F.date_format(d, "yyyy-MM-dd")
    first, last = F.to_date("first"), F.to_date("last")
    days = (F.datediff(last, _year_before(last)).cast("long") * DAY_MS) if to == "year" else F.col("to_ts") - F.col("from_ts")
    start, end = (text(_year_before(first)), text(_year_before(last))) if to == "year" else (text(F.date_sub(first, F.datediff(last, first) + 1)), text(F.date_sub(first, 1)))
    rolling = F.col("from_ts").isNotNull()
    return window.select(
        "site_id", "timezone", F.when(rolling, _day(F.col("from_ts") - days)).otherwise(start).alias("first"),
        F.when(rolling, _day(F.col("to_ts") - days - 1)).otherwise(end).alias("last"), (F.col("from_ts") - days).alias("from_ts"), (F.col("to_ts") - days).alias("to_ts"))


def inside(rows: DataFrame, window: DataFrame, at: str = "ts") -> DataFrame:
    """Rows (site_id, local_date and a time in ms) in their site's window; sites without one have none."""
    w = window.select(F.col("site_id").alias("__site"), "first", "last", "from_ts", "to_ts")
    edge = F.col("from_ts").isNull() | ((F.col(at) >= F.col("from_ts")) & (F.col(at) < F.col("to_ts")))
    on = (F.col("site_id") == F.col("__site")) & F.col("local_date").between(F.col("first"), F.col("last")) & edge
    return rows.join(w, on).drop("__site", "first", "last", "from_ts", "to_ts")


def with_compare(rows: DataFrame, window: DataFrame, to: str | tuple[str, str] | dict = "previous", at: str = "ts") -> DataFrame:
    """Rows of the window and of the one it is compared with, with `period`; a row in both is there twice.

    to: a comparison of compared(), or a filter tree: then the rows of the same window that pass it are compared with.
    """
    mine = inside(rows, window, at)
    other = mine.filter(predicate(to)) if isinstance(to, dict) else inside(rows, compared(window, to), at)
    return mine.withColumn("period", F.lit("current")).unionByName(other.withColumn("period", F.lit("previous")))


def envelope(events: DataFrame, visits: DataFrame, window: DataFrame, where: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Visits that start in the window and pass the filter, and all of their events, those after the window too."""
    chosen = inside(visits, window, "started_at")
    chosen = chosen.filter(predicate(where)) if where else chosen
    return events.join(chosen.select("session_id"), "session_id", "left_semi"), chosen


def touching(visits: DataFrame, first: str, last: str, zones: DataFrame) -> DataFrame:
    """Visits that start on the days, and those that started before and were still seen on them: each once."""
    started = visits.filter(F.col("local_date").between(first, last))
    seen = visits.join(zones.select("site_id", "timezone"), "site_id").withColumn("seen", _day(F.col("last_seen_at")))
    crossing = seen.filter((F.col("local_date") < first) & (F.col("seen") >= first)).select(visits.columns)
    return started.union(crossing).distinct()


def clip(axis: DataFrame, window: DataFrame, now_ms: int) -> DataFrame:
    """site_id, clip: the newest hour key of an axis that has begun."""
    begun = F.date_format(local_time(F.lit(now_ms), F.col("timezone")), "yyyy-MM-dd HH:00")
    return axis.join(window.select("site_id", begun.alias("begun")), "site_id").filter(F.col("bucket") <= F.col("begun")).groupBy("site_id").agg(F.max("bucket").alias("clip"))


def annotations_in(notes: DataFrame, window: DataFrame) -> DataFrame:
    """Notes (site_id or null for all, local_date, text) on days of the windows, with the site whose window they meet."""
    w = window.select(F.col("site_id").alias("of_site"), "first", "last")
    own = notes.filter("site_id IS NOT NULL").join(w, (F.col("site_id") == F.col("of_site")) & F.col("local_date").between(F.col("first"), F.col("last")))
    days = w.select("of_site", F.explode(F.sequence(F.to_date("first"), F.to_date("last"))).alias("d")).select("of_site", F.date_format("d", "yyyy-MM-dd").alias("local_date"))
    every = notes.filter("site_id IS NULL").join(days, "local_date")
    return own.select("of_site", "local_date", "text").union(every.select("of_site", "local_date", "text"))


def site_goal(events: DataFrame, visits: DataFrame, site_id: int, where: dict, value: str | float | None = None, by: str | None = None) -> DataFrame:
    """A site's goal by `site_id` or day: conversions (visits with a matching action), rate of its own visits, value.

    value: "event_value" sums the matching events', a number counts for each conversion, None has no value. Rows of
    other sites are null throughout. Visits span hours, so an hourly goal would not add up and is refused.
    """
    if by == "hour":
        raise Unsupported("goals have no hours")
    keys = ["site_id"] + (["local_date"] if by == "day" else [])
    hits = events.filter((F.col("site_id") == site_id) & (F.col("type") != "ping")).filter(predicate(where))
    got = hits.groupBy(*keys).agg(F.count_distinct("session_id").alias("n"), F.sum("event_value").alias("sum"))
    own = F.col("site_id") == site_id
    n = F.coalesce("n", F.lit(0))
    worth = F.lit(None).cast("double") if value is None else F.col("sum") if value == "event_value" else n * F.lit(float(value))
    rows = visits.groupBy(*keys).agg(F.count("*").alias("visits")).join(got, keys, "full_outer" if by else "left")
    return rows.select(*keys, F.when(own, n).alias("conversions"), F.when(own, F.try_divide(n, "visits")).alias("rate"), F.when(own, worth).alias("value"))


def recombined(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of finer buckets as those of coarser ones (requests.whole); distinct counts refuse."""
    if bad := [m for m in metrics if m not in MEASURES or MEASURES[m].kind == "distinct"]:
        raise Unsupported(f"{bad} of parts are not those of the whole")
    return rows.groupBy(*keys).agg(*[whole(m, rows.columns).alias(m) for m in metrics])


MOST_BUCKETS = 1000


def sliced(series: DataFrame, key: str, metric: str, slices: int = 12) -> DataFrame:
    """A series in `slices` contiguous parts: slice, first bucket, the metric's typical bucket in it. Over MOST_BUCKETS buckets are refused."""
    if series.limit(MOST_BUCKETS + 1).count() > MOST_BUCKETS:
        raise Unsupported(f"more than {MOST_BUCKETS} buckets")
    all_ = Window.partitionBy()  # at most MOST_BUCKETS rows
    place, n = (free_column(series, name) for name in ("place", "n"))
    numbered = series.withColumns({place: F.row_number().over(all_.orderBy(key)) - 1, n: F.count("*").over(all_)})
    count = F.least(F.lit(slices), F.col(n))
    # slice s has the places from floor(s * n / count) to before floor((s + 1) * n / count)
    part = F.floor(((F.col(place) + 1) * count - 1) / F.col(n)).cast("int")
    return numbered.groupBy(part.alias("slice")).agg(F.min(key).alias("first"), per_bucket(metric, series.columns).alias(metric))


def free_column(df: DataFrame, name: str) -> str:
    """name with as many underscores before it as no column of df has."""
    while name in df.columns:
        name = f"_{name}"
    return name


def bars(rows: DataFrame, display: Column, value: str, limit: int | None = None) -> DataFrame:
    """Rows merged by the name shown, without zeros, the largest first, with their share of it in percent; all of them, or the first `limit`."""
    merged = rows.groupBy(display.alias("name")).agg(F.sum(value).alias(value)).filter(F.col(value) > 0)
    largest = merged.agg(F.greatest(F.max(value), F.lit(1))).scalar()
    shown = merged.withColumn("pct", F.col(value) / largest * 100).orderBy(F.col(value).desc(), "name")
    return shown if limit is None else shown.limit(limit)


def scroll_histogram(deciles: DataFrame) -> DataFrame:
    """All ten deciles, those without page views as 0."""
    return deciles.sparkSession.range(10).select(F.col("id").alias("decile")).join(deciles, "decile", "left").fillna(0, ["n"])


def orphan_days(rolled: DataFrame, *raw: DataFrame) -> DataFrame:
    """Days (site_id, local_date) that a rollup has and no raw table."""
    days = [r.select("site_id", "local_date") for r in raw]
    known = days[0]
    for d in days[1:]:
        known = known.union(d)
    return rolled.select("site_id", "local_date").distinct().join(known.distinct(), ["site_id", "local_date"], "left_anti")
