"""Rewrites of stored rows: referrers, zones, properties, sites, first hours; and how an import is held against its source."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.web import local_time
from .query import Unsupported
from .rollups import differences


def rereferred(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """ref_domain again from its raw value after the table (host, canonical; one row a host) changed. The same when run twice."""
    raw = F.coalesce("ref_domain_raw", "ref_domain")
    out = events.join(aliases.select(F.col("host").alias("__host"), F.col("canonical").alias("__name")), raw == F.col("__host"), "left")
    new = F.coalesce("__name", raw)
    return out.withColumns({"ref_domain": new, "ref_domain_raw": F.when(~new.eqNullSafe(raw), raw)}).drop("__host", "__name")


def table_mark(table: DataFrame) -> DataFrame:
    """One row, mark: the same for the same rows in any order; a rewrite is due when it differs from the stored one."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(table.columns)])
    return table.agg(F.concat_ws(":", F.count("*"), F.sum(row.cast("decimal(38,0)"))).alias("mark"))


def rezoned(events: DataFrame, zones: DataFrame) -> DataFrame:
    """Local date and hour of the sites in zones (site_id, timezone) again from ts; other sites stay."""
    out = events.join(zones.select("site_id", F.col("timezone").alias("__zone")), "site_id", "left")
    local = local_time(F.col("ts"), F.col("__zone"))
    moved = F.col("__zone").isNotNull()
    date, hour = F.date_format(local, "yyyy-MM-dd"), F.hour(local)
    return out.withColumns({"local_date": F.when(moved, date).otherwise(F.col("local_date")), "local_hour": F.when(moved, hour).otherwise(F.col("local_hour"))}).drop("__zone")


def without_prop(events: DataFrame, site_id: int, key: str) -> DataFrame:
    """A site's property bags (flat JSON) without one key; an empty bag is null. Other values keep their text."""
    if not re.fullmatch(r"[a-z0-9_-]{1,32}", key):
        raise Unsupported(f"no such property: {key}")
    member = rf'(^\{{|,)"{re.escape(key)}":("(?:[^"\\]|\\.)*"|[^,}}]*)'
    cut = F.regexp_replace("props", member + r"(,?)", "$1")
    tidy = F.regexp_replace(F.regexp_replace(cut, r",\}$", "}"), r"^\{,", "{")
    return events.withColumn("props", F.when(F.col("site_id") == site_id, F.nullif(tidy, F.lit("{}"))).otherwise(F.col("props")))


def without_site(rows: DataFrame, site_id: int) -> DataFrame:
    return rows.filter(F.col("site_id") != site_id)


def aged(registry: DataFrame, floor_ms: int) -> DataFrame:
    """Registry rows that were seen since the floor."""
    return registry.filter(F.col("last_seen") >= floor_ms)


def with_first_hour(visits: DataFrame, events: DataFrame) -> DataFrame:
    """visits with local_hour of their first event; null where no event is left."""
    first = events.groupBy("session_id").agg(F.min_by("local_hour", "seq").alias("local_hour"))
    return visits.drop("local_hour").join(first, "session_id", "left")


def day_report(events: DataFrame, visits: DataFrame) -> DataFrame:
    """site_id, local_date, visits, pageviews; days that only one side has count 0 on the other."""
    keys = ["site_id", "local_date"]
    views = events.filter("type = 'pageview'").groupBy(*keys).agg(F.count("*").alias("pageviews"))
    return visits.groupBy(*keys).agg(F.count("*").alias("visits")).join(views, keys, "full_outer").fillna(0, ["visits", "pageviews"]).select(*keys, "visits", "pageviews")


def import_faults(source: DataFrame, imported: DataFrame) -> DataFrame:
    """Cells of two day reports that differ, in both directions (a day that one side lacks is null there)."""
    return differences(source, imported, ("site_id", "local_date"))
