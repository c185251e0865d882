"""What an operator looks at to see whether data comes in: rows held, and what was refused at the door, by kind.

Every kind of loss is reported apart, so that a rule that quietly eats real traffic shows as itself.
Defined cases: days before the window, and counters of 0, are left out; a reference that is null counts as ''; of references seen last at
the same time the smaller text goes first.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS, RECENT = 7, 20
COLUMNS = ("section", "site_id", "local_date", "what", "n", "last_seen")


def _section(rows: DataFrame, section: str, what: Column, n: Column, last_seen: Column | None = None) -> DataFrame:
    have = set(rows.columns)
    key = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    return rows.select(F.lit(section).alias("section"), key("site_id", "long"), key("local_date", "string"), what.cast("string").alias("what"), n.cast("long").alias("n"), (F.lit(None) if last_seen is None else last_seen).cast("long").alias("last_seen"))


def unknown_references(named: DataFrame, known: DataFrame, by: str = "site") -> DataFrame:
    """ref, hits, last_seen of the texts in column `by` that name no known site. known: the hits (hit_id) that named one."""
    lost = named.join(known.select("hit_id"), "hit_id", "left_anti")
    return lost.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("ref")).agg(F.count("*").alias("hits"), F.max("ts").alias("last_seen"))


def drops(tested: DataFrame) -> DataFrame:
    """site_id, local_date, refused, n of hits that a rule or a crawler's agent kept out."""
    return tested.filter("refused IS NOT NULL").groupBy("site_id", "local_date", "refused").agg(F.count("*").alias("n"))


def report(tables: dict[str, DataFrame], refused: DataFrame, props: DataFrame, unknown: DataFrame, today: str, days: int = DAYS) -> DataFrame:
    """One table of COLUMNS: rows of each table; refused hits and properties of the last `days` local days; unknown references.

    tables: name and rows; refused: site_id, local_date, refused, n; props: site_id, local_date, reason, n; unknown: ref,
    hits, last_seen. Of unknown references the total and the RECENT newest are shown.
    """
    since = (date.fromisoformat(today) - timedelta(days=days - 1)).isoformat()
    inside = F.col("local_date").between(since, today) & (F.col("n") > 0)
    counted = [_section(rows.agg(F.count("*").alias("n")), "rows", F.lit(name), F.col("n")) for name, rows in tables.items()]
    newest = unknown.orderBy(F.col("last_seen").desc(), "ref").limit(RECENT)
    total = unknown.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("n"), F.max("last_seen").alias("last_seen"))
    return reduce(DataFrame.unionByName, [
        *counted, _section(refused.filter(inside), "refused", F.col("refused"), F.col("n")), _section(props.filter(inside), "props", F.col("reason"), F.col("n")),
        _section(total, "unknown", F.lit("all"), F.col("n"), F.col("last_seen")), _section(newest, "unknown references", F.col("ref"), F.col("hits"), F.col("last_seen")),
    ])
