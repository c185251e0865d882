"""The event-day rollup kept up flush by flush, with exact distinct visitors and visits from first sightings.

A sighting is a visitor or visit within one (site, day, dimension, value). A flush keeps those of its hits that no earlier
flush had, and adds as many to its groups' counters; it reads only the partitions of the days it touches, and lands in the
same commit as the events it counts. Sightings serve a day that is still filling: when a flush brings a site's new day,
the site's partitions from more than HORIZON days before it are dropped.

Defined cases: pings are hits but no sightings; a null value is a group apart from ''; hits on a day whose sightings were
dropped count their visitors again, so `stale` names such days and `recount` counts them from the stored events; an empty
flush adds nothing and drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rollups as r
from ..operators import visits as v
from . import facts

HORIZON = 3
GROUP = (*facts.PARTITION, "dim", "value")


def sightings(events: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """site_id, local_date, dim, value, kind (visitor or session), who: each once."""
    groups = F.explode(F.array(F.struct(F.lit("total").alias("dim"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("who")) for k, c in (("visitor", "visitor"), ("session", "session_id"))]))
    rows = events.filter("type <> 'ping'").select(*facts.PARTITION, "visitor", "session_id", groups.alias("g")).select(*facts.PARTITION, "g.*", kinds.alias("k"))
    return rows.select(*GROUP, "k.*").filter("who IS NOT NULL").distinct()


def outdated(store: facts.Store, landed: DataFrame) -> DataFrame:
    """Partitions of sightings that a flush of these hits drops: those HORIZON days behind a site's day that is new."""
    kept = facts.live(store, "seen").select(*facts.PARTITION).distinct()
    newest = landed.groupBy("site_id").agg(F.max("local_date").alias("__new"))
    known = kept.groupBy("site_id").agg(F.max("local_date").alias("__known"))
    moved = newest.join(known, "site_id").filter("__new > __known").select(F.col("site_id").alias("__site"), F.date_format(F.date_sub(F.col("__new").cast("date"), HORIZON), "yyyy-MM-dd").alias("__floor"))
    return kept.join(moved, (F.col("site_id") == F.col("__site")) & (F.col("local_date") < F.col("__floor")), "left_semi")


def _unseen(found: DataFrame, known: DataFrame) -> DataFrame:
    a, b = found.alias("a"), known.alias("b")
    same = (F.col("a.dim") == F.col("b.dim")) & (F.col("a.kind") == F.col("b.kind")) & (F.col("a.who") == F.col("b.who"))
    for c in (*facts.PARTITION, "value"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left_anti")


def land(store: facts.Store, number: int, landed: DataFrame, dims: tuple[str, ...]) -> tuple[dict[str, tuple[DataFrame, bool]], dict[str, DataFrame]]:
    """What flush() commits along with its events: first sightings and counters that were written, and partitions that go."""
    known, gone = facts.read(store, "seen"), outdated(store, landed)
    found = sightings(landed, dims)
    if "who" in known.columns:
        current = facts.on_days(known, landed.select(*facts.PARTITION).distinct())
        dropped = gone.toDF("__site", "__date")
        found = _unseen(found, current.join(dropped, (F.col("site_id") == F.col("__site")) & (F.col("local_date") == F.col("__date")), "left_anti"))
    seen = facts._write(store, "seen", found, number)
    counted = r.event_days(v.dealt(landed, "site_id", "visitor"), dims)
    first = seen.groupBy(*GROUP).agg(F.count_if(F.col("kind") == "visitor").alias("visitors"), F.count_if(F.col("kind") == "session").alias("sessions"))
    both = counted.drop("visitors", "sessions").unionByName(first, allowMissingColumns=True)
    return {"seen": (seen, False), "days": (facts._write(store, "days", _added(both), number), False)}, {"seen": gone}


def _added(rows: DataFrame) -> DataFrame:
    counters = [c for c in rows.columns if c not in GROUP]
    return rows.groupBy(*GROUP).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def event_days(store: facts.Store) -> DataFrame:
    """The rollup that event_days() of operators.rollups gives of the stored events."""
    return _added(facts.read(store, "days"))


def stale(store: facts.Store) -> DataFrame:
    """site_id, local_date of days that got hits after their sightings were dropped and weren't counted again since; told from commits alone."""
    named = facts.commits(store)
    of = lambda table, whole: F.when((F.col("table") == table) & (F.col("whole") == whole), F.col("flush"))
    days = named.groupBy(*facts.PARTITION).agg(F.min(of("seen", True)).alias("dropped"), F.max(of("seen", False)).alias("hit"), F.max(of("days", True)).alias("counted"))
    return days.filter("hit >= dropped AND hit > coalesce(counted, -1)").select(*facts.PARTITION)


def recount(store: facts.Store, number: int, days: DataFrame, dims: tuple[str, ...]) -> bool:
    """Count these days' rollup again from the stored events; False if the flush was committed before or there are no days."""
    if days.isEmpty():
        return False
    events = facts.on_days(facts.read(store, "events"), days)
    return facts.replace_days(store, number, "days", days, r.event_days(v.dealt(events, "site_id", "visitor"), dims))
