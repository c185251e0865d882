"""What happened lately and how sites do: tallies, trails, top pages, site cards, journeys through an edge, the weekly digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .query import Unsupported
from .shaping import feed_runs

TALLY_MS = 8 * 3_600_000


def _lately(events: DataFrame, now_ms: int) -> DataFrame:
    return events.filter(F.col("ts").between(now_ms - TALLY_MS, now_ms))


def visitor_tally(events: DataFrame, now_ms: int, top: int = 10) -> DataFrame:
    """The busiest visitors by actions; place of the newest hit that has one; engaged time."""
    located = F.when(F.col("country").isNotNull(), F.struct("ts", "hit_id"))
    rows = _lately(events, now_ms).groupBy("site_id", "visitor").agg(
        F.count_if(F.col("type") != "ping").alias("actions"), F.max_by("country", located).alias("country"), F.sum("engaged_step").cast("long").alias("engaged_ms"))
    return rows.orderBy(F.col("actions").desc(), "visitor").limit(top)


def country_tally(events: DataFrame, now_ms: int, top: int = 8) -> DataFrame:
    """Countries by hits, with their share of the leader in percent."""
    counted = _lately(events, now_ms).filter("country IS NOT NULL").groupBy("country").agg(F.count("*").alias("hits"))
    tops = counted.orderBy(F.col("hits").desc(), "country").limit(top)  # a window over these few rows is small
    return tops.withColumn("pct", F.round(F.col("hits") / F.max("hits").over(Window.partitionBy()) * 100, 1))


def visitor_trail(events: DataFrame, site_id: int, visitor: int, last: int = 12) -> DataFrame:
    """The newest runs of one visitor; the filter goes before the windows."""
    mine = events.filter((F.col("site_id") == site_id) & (F.col("visitor") == visitor))
    return feed_runs(mine).orderBy(F.col("started").desc(), F.col("run").desc()).limit(last)


def _trend(first: str, last: str, days: str) -> Column:
    """Values of the days first to last out of an array of (day, n), 0 where there is none, joined by commas."""
    axis = F.transform(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last))), lambda d: F.date_format(d, "yyyy-MM-dd"))
    known = F.map_from_entries(F.coalesce(F.col(days), F.array().cast("array<struct<day:string,n:bigint>>")))
    return F.array_join(F.transform(axis, lambda d: F.coalesce(F.try_element_at(known, d), F.lit(0)).cast("string")), ",")


def top_pages(events: DataFrame, first: str, last: str, top: int = 3) -> DataFrame:
    """A site's most viewed pages with their views of each day."""
    views = events.filter((F.col("type") == "pageview") & F.col("path").isNotNull() & F.col("local_date").between(first, last))
    daily = views.groupBy("site_id", "path", F.col("local_date").alias("day")).agg(F.count("*").alias("n"))
    pages = daily.groupBy("site_id", "path").agg(F.sum("n").alias("total"), F.collect_list(F.struct("day", "n")).alias("days"))
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.col("total").desc(), "path"))
    return pages.withColumn("rank", rank).filter(F.col("rank") <= top).select("site_id", "path", "total", _trend(first, last, "days").alias("trend"), "rank")


def site_cards(events: DataFrame, sites: DataFrame, current: tuple[str, str], previous: tuple[str, str], sort: str = "traffic") -> DataFrame:
    """Every site's visitors, whole percent of change (null unless both periods have some), days, and whether it is silent."""
    orders = {"traffic": [F.col("total").desc(), "site_id"], "name": ["domain", "site_id"], "id": ["site_id"]}
    if sort not in orders:
        raise Unsupported(f"no such order: {sort}")
    acts = events.filter("type != 'ping'")
    seen = lambda w: F.count_distinct(F.when(F.col("local_date").between(*w), F.col("visitor")))
    totals = acts.groupBy("site_id").agg(seen(current).alias("total"), seen(previous).alias("before"))
    daily = acts.filter(F.col("local_date").between(*current)).groupBy("site_id", F.col("local_date").alias("day")).agg(F.count_distinct("visitor").alias("n"))
    days = daily.groupBy("site_id").agg(F.collect_list(F.struct("day", "n")).alias("days"))
    rows = sites.join(totals, "site_id", "left").join(days, "site_id", "left").fillna(0, ["total", "before"])
    change = F.floor((F.col("total") - F.col("before")) / F.col("before") * 100 + 0.5)
    shown = rows.select("site_id", "domain", "total", F.when((F.col("total") > 0) & (F.col("before") > 0), change).alias("delta_pct"), (F.col("total") == 0).alias("silent"), _trend(*current, "days").alias("trend"))
    return shown.orderBy(*orders[sort])


def flows_through(flows: DataFrame, step: int, source: str, target: str, limit: int = 50) -> DataFrame:
    """The commonest rows of `flows` whose labels number step and step + 1 (from 1) are the edge's; share of the largest of all rows, in percent."""
    label = lambda n: F.get_json_object("steps", f"$[{n}]")
    mine = flows.filter((label(step - 1) == source) & (label(step) == target)).withColumn("most", F.lit(None).cast("long"))
    largest = flows.agg(F.max("sessions").alias("most"))
    # the one row of the largest count lies beside those of the edge, of which at most `limit` are kept
    tops = mine.orderBy(F.col("sessions").desc(), "steps").limit(limit).unionByName(largest, allowMissingColumns=True)
    shared = tops.withColumn("pct", F.col("sessions") / F.max("most").over(Window.partitionBy()) * 100)
    return shared.filter("steps IS NOT NULL").drop("most")


def digest(visits: DataFrame, dims: tuple[str, ...], current: tuple[str, str], previous: tuple[str, str], movers: int = 3) -> DataFrame:
    """A site's visits in both periods and, for each dimension, the values that moved most; one pass for all sites."""
    inside = lambda w: F.count_if(F.col("local_date").between(*w))
    both = visits.filter(F.col("local_date").between(*current) | F.col("local_date").between(*previous))
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims], F.struct(F.lit("").alias("dim"), F.lit(None).cast("string").alias("value"))))
    counted = both.select("site_id", "local_date", pairs.alias("p")).groupBy("site_id", "p.dim", "p.value").agg(inside(current).alias("current"), inside(previous).alias("previous"))
    totals = counted.filter("dim = ''").select("site_id", F.col("current").alias("visits"), F.col("previous").alias("visits_before"))
    moved = counted.filter("dim <> ''").withColumn("delta", F.col("current") - F.col("previous")).filter("delta <> 0")
    rank = F.row_number().over(Window.partitionBy("site_id", "dim").orderBy(F.abs("delta").desc(), F.col("current").desc(), F.col("value").asc_nulls_first()))
    return moved.withColumn("rank", rank).filter(F.col("rank") <= movers).join(totals, "site_id").select("site_id", "visits", "visits_before", "dim", "value", "delta", "rank")
