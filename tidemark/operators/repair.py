"""Stored page views of missing pages moved out of the traffic, and the visits they were in counted again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import web
from .visits import GAP_MS, IDLE_MS

REFERRERS = ("internal", "search", "social", "referral")


def move_missing(events: DataFrame, missing: Column, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(events that stay, missing hits). `missing` tells a page view of a missing page.

    What follows such a page view up to the next page view goes with it. A visit without a page view left goes
    whole. seq stays as it was; engaged steps are counted anew over the rows that stay. Visits seen in the last
    30 minutes are left for the next run. A moved hit was referred by the page before it, else by what brought the visit.
    """
    order = Window.partitionBy("session_id").orderBy("seq")
    whole = Window.partitionBy("session_id")
    page = F.col("type") == "pageview"
    flag = page & F.coalesce(missing, F.lit(False))
    marked = events.withColumns({"open": F.max("ts").over(whole) > now_ms - IDLE_MS, "flag": flag})
    marked = marked.withColumn("gone", ~F.col("open") & F.coalesce(F.last(F.when(page, F.col("flag")), ignorenulls=True).over(order), F.lit(False)))
    before = F.last(F.when(page & ~F.col("flag"), F.col("path")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumns({"before": before, "hit": F.max("gone").over(whole), "pages": F.count_if(page & ~F.col("gone")).over(whole)})
    kept = marked.filter(~F.col("gone") & (~F.col("hit") | (F.col("pages") > 0)))
    gap = F.col("ts") - F.lag("ts").over(order)
    step = F.coalesce(F.least(F.greatest(gap, F.lit(0)), F.lit(GAP_MS)), F.lit(0))
    stay = kept.withColumn("engaged_step", F.when(F.col("hit"), step).otherwise(F.col("engaged_step"))).select(*events.columns)
    inner = F.col("before").isNotNull()
    kind = F.when(inner, "internal").when(F.col("ref_domain").isNull(), "direct").when(F.col("ref_type").isin(*REFERRERS), F.col("ref_type")).otherwise(web.referrer_type(F.col("ref_domain"), F.lit(False)))
    moved = marked.filter("gone AND flag").select(
        "hit_id", "site_id", "ts", "local_date", "local_hour", "path", kind.alias("ref_type"), F.when(inner, web.canonical_domain(F.col("hostname"))).otherwise(F.col("ref_domain")).alias("ref_domain"),
        F.substring_index("before", "?", 1).alias("ref_path"), "device_type", "country")
    return stay, moved
