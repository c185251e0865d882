"""The salts of visitor keys: one a zone and local day, made when the day begins there, after which older ones are gone.

A salts table has timezone, local_date and salt. Salts only go forward: a zone whose newest salt is of today or later gets
none. Zones that no site is in keep theirs. Tables are small, a row a zone. Nulls in zones are left out; of zones that
repeat one is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _today(now_ms: int, zone: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(F.lit(now_ms)), zone), "yyyy-MM-dd")


def rotated(salts: DataFrame, zones: DataFrame, now_ms: int, fresh: Column | None = None) -> DataFrame:
    """The salts table at now_ms. zones: timezone. Fresh salts are random unless given, so write the result before it is read twice."""
    made = F.replace(F.expr("uuid()"), F.lit("-")) if fresh is None else fresh
    newest = salts.groupBy("timezone").agg(F.max("local_date").alias("newest"))
    asked = zones.select("timezone").filter("timezone IS NOT NULL").distinct().withColumn("local_date", _today(now_ms, F.col("timezone")))
    new = asked.join(newest, "timezone", "left").filter(F.col("newest").isNull() | (F.col("newest") < F.col("local_date"))).select("timezone", "local_date", made.alias("salt"))
    return salts.select("timezone", "local_date", "salt").join(new.select("timezone"), "timezone", "left_anti").unionByName(new)


def carried(salts: DataFrame, source: str, target: str, now_ms: int) -> DataFrame:
    """The salts table after a site moved from zone `source` to `target`: a target without a salt of its today takes the source's live one.

    So visitors of today keep their keys until the target's next midnight. A salt that the target has for today stays.
    """
    of = lambda zone: (F.col("timezone") == zone) & (F.col("local_date") == _today(now_ms, F.lit(zone)))
    live = salts.filter(of(source)).select(F.lit(target).alias("timezone"), _today(now_ms, F.lit(target)).alias("local_date"), "salt")
    new = live.join(salts.filter(of(target)).select("timezone"), "timezone", "left_anti")
    gone = new.select("timezone", F.col("local_date").alias("__day"))
    kept = salts.join(gone, (salts["timezone"] == gone["timezone"]) & (F.col("local_date") < F.col("__day")), "left_anti")
    return kept.select("timezone", "local_date", "salt").unionByName(new)
