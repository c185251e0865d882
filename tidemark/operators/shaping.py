"""Results as reports show them: changes between periods, whole axes, shares, grids, runs; rewrites of history; alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_GAP_MS, CLAMP_MS = 30 * 60_000, 20_000
#: Quantiles of the cells that have any traffic; the top step is rare.
LEVELS = (0.2, 0.4, 0.6, 0.8, 0.93)


def delta(kind: str, current: Column, previous: Column) -> Column:
    """Percent for counts (null without a previous or current value), difference for times, percentage points for rates."""
    percent = F.when((previous > 0) & (current != 0), (current - previous) / previous * 100)
    return {"count": percent, "value": percent, "ms": current - previous, "rate": (current - previous) * 100}[kind]


def hour_axis(sites: DataFrame, first: str, last: str) -> DataFrame:
    """site_id, bucket: every local hour that exists on the local days first to last; a repeated hour is one bucket, a skipped one none."""
    utc = F.explode(F.sequence(F.to_timestamp(F.lit(first)) - F.expr("INTERVAL 1 DAY"), F.to_timestamp(F.lit(last)) + F.expr("INTERVAL 2 DAYS"), F.expr("INTERVAL 15 MINUTES"))).alias("t")
    local = F.from_utc_timestamp("t", F.col("timezone"))
    return sites.select("site_id", "timezone", utc).select("site_id", F.date_format(local, "yyyy-MM-dd HH:00").alias("bucket")).filter(F.substring("bucket", 1, 10).between(first, last)).distinct()


def densified(sparse: DataFrame, axis: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return axis.join(sparse, keys, "left").select(*keys, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def folded_shares(rows: DataFrame, dim: str, value: str, most: int = 3, other: str = "other") -> DataFrame:
    """At most `most` groups, the largest; the rest, null and `other` are one, Other, which takes a place if it has anything. Share of the whole; Other comes last."""
    named = rows.filter(F.col(value) > 0).groupBy(F.when(F.col(dim) != other, F.col(dim)).alias(dim)).agg(F.sum(value).alias(value))
    tops = named.filter(F.col(dim).isNotNull()).orderBy(F.col(value).desc(), dim).limit(most)
    # the rest is the sum of all less that of the groups kept: no window over all groups
    whole = named.agg(F.sum(value).alias("whole"), F.sum(F.when(F.col(dim).isNull(), F.col(value))).alias("nameless"), F.count(dim).alias("names"))
    both = tops.withColumn("whole", F.lit(None).cast("double")).unionByName(whole.withColumns({dim: F.lit(None).cast(dict(named.dtypes)[dim]), value: F.lit(None).cast(dict(named.dtypes)[value])}), allowMissingColumns=True)
    all_ = Window.partitionBy()  # at most `most` + 1 rows from here on
    fold = (F.max("nameless").over(all_) > 0) | (F.max("names").over(all_) > most)
    rank = F.row_number().over(Window.orderBy(F.col("whole").isNotNull(), F.col(value).desc(), dim))
    kept = both.withColumns({"total": F.max("whole").over(all_), "keep": F.when(F.coalesce(fold, F.lit(False)), most - 1).otherwise(most), "rank": rank}).filter(F.col("whole").isNotNull() | (F.col("rank") <= F.col("keep")))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("whole").isNull(), F.col(value))).over(all_), F.lit(0))
    shown = kept.withColumns({value: F.when(F.col("whole").isNull(), F.col(value)).otherwise(rest.cast(dict(named.dtypes)[value])), dim: F.when(F.col("whole").isNull(), F.col(dim)).otherwise("Other")}).filter(F.col(value) > 0)
    return shown.select(dim, value, F.try_divide(F.col(value), F.col("total")).alias("share"), F.row_number().over(Window.orderBy(F.col("whole").isNotNull(), F.col("rank"))).alias("rank"))


def week_grid(events: DataFrame) -> DataFrame:
    """All 168 cells of hour by weekday: page views, and level 0 (none), 1 to 5 by how many of LEVELS' quantiles of the other cells it reaches."""
    cells = events.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("local_hour"))
    found = events.filter("type = 'pageview'").groupBy((F.dayofweek(F.to_date("local_date")) - 1).alias("weekday"), "local_hour").agg(F.count("*").alias("pageviews"))
    full = cells.join(found, ["weekday", "local_hour"], "left").withColumn("pageviews", F.coalesce("pageviews", F.lit(0)))
    some = F.array_sort(F.collect_list(F.when(F.col("pageviews") > 0, F.col("pageviews"))).over(Window.partitionBy()))  # 168 cells at most
    cuts = F.array(*[F.get(some, F.floor((F.size(some) - 1) * q).cast("int")) for q in LEVELS])
    level = F.greatest(F.size(F.filter(cuts, lambda c: F.col("pageviews") >= c)), F.lit(1))
    return full.withColumn("level", F.when(F.col("pageviews") > 0, level).otherwise(0))


def feed_runs(events: DataFrame) -> DataFrame:
    """Consecutive hits of a visitor on one site and page, within 30 minutes of each other, as one row.

    The time until the visitor's next hit, clamped, is credited to the run that the hit ends in; page_ms is null if there is none.
    """
    order = Window.partitionBy("site_id", "visitor").orderBy("ts", "hit_id")
    gap = F.col("ts") - F.lag("ts").over(order)
    new = gap.isNull() | (gap > RUN_GAP_MS) | ~F.lag("path").over(order).eqNullSafe(F.col("path"))
    stay = F.least(F.greatest(F.lead("ts").over(order) - F.col("ts"), F.lit(0)), F.lit(CLAMP_MS))
    marked = events.withColumns({"step": F.coalesce(stay, F.lit(0)), "new": new.cast("int")}).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("site_id", "visitor", "run").agg(F.min_by("path", F.struct("ts", "hit_id")).alias("path"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.nullif(F.sum("step").cast("long"), F.lit(0)).alias("page_ms"), F.count_if(F.col("type") != "ping").alias("actions"))


def journey_columns(edges: DataFrame, most: int = 8, least_share: float = 0.04) -> DataFrame:
    """Transitions with rare pages of a column folded into Other (events never fold), edges summed again, share of their step.

    A column's nodes are what its edges leave and what those of the step before reach; the larger of both counts.
    """
    left = edges.select("step", F.col("from").alias("label"), F.col("sessions").alias("out"), F.lit(0).cast("long").alias("into"))
    reached = edges.select((F.col("step") + 1).alias("step"), F.col("to").alias("label"), F.lit(0).cast("long").alias("out"), F.col("sessions").alias("into"))
    nodes = left.unionByName(reached).groupBy("step", "label").agg(F.greatest(F.sum("out"), F.sum("into")).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("step"))
    rank = F.row_number().over(Window.partitionBy("step").orderBy(F.col("n").desc(), "label"))
    named = nodes.withColumns({"share": share, "rank": rank}).withColumn("shown", F.when(F.col("label").startswith("event: ") | ((F.col("share") >= least_share) & (F.col("rank") <= most)), F.col("label")).otherwise("Other"))
    targets = named.select((F.col("step") - 1).alias("step"), F.col("label").alias("to"), F.col("shown").alias("shown_to"))
    both = edges.join(named.select("step", F.col("label").alias("from"), "shown"), ["step", "from"]).join(targets, ["step", "to"])
    folded = both.groupBy("step", F.col("shown").alias("from"), F.col("shown_to").alias("to")).agg(F.sum("sessions").alias("sessions"))
    return folded.withColumn("share", F.col("sessions") / F.sum("sessions").over(Window.partitionBy("step")))


def campaign_status(events: DataFrame, campaigns: DataFrame) -> DataFrame:
    """events with campaign_status: untagged, registered (name and lifespan match), unregistered. campaigns: name, starts_on, ends_on (null: open)."""
    spans = campaigns.select(F.lower("name").alias("__name"), "starts_on", "ends_on").distinct()
    alive = (F.col("utm_campaign") == F.col("__name")) & (F.col("local_date") >= F.col("starts_on")) & (F.col("ends_on").isNull() | (F.col("local_date") <= F.col("ends_on")))
    known = events.filter("utm_campaign IS NOT NULL").select("utm_campaign", "local_date").distinct().join(spans, alive, "left_semi").withColumn("known", F.lit(True))
    status = F.when(F.col("utm_campaign").isNull(), "untagged").when(F.col("known"), "registered").otherwise("unregistered")
    return events.join(known, ["utm_campaign", "local_date"], "left").withColumn("campaign_status", status).drop("known")


def realiased(events: DataFrame, aliases: DataFrame, field: str = "utm_source") -> DataFrame:
    """field again from its raw value after alias edits; a site's alias goes before one for all sites (site_id 0). The same when run twice."""
    raw = F.coalesce(F.col(f"{field}_raw"), F.col(field))
    of = lambda name, rows: rows.select(F.col("site_id").alias(f"__s{name}"), F.col("alias").alias(f"__a{name}"), F.col("canonical").alias(f"__c{name}"))
    mine = aliases.filter(F.col("field") == field)
    own, every = of("1", mine.filter("site_id <> 0")), of("0", mine.filter("site_id = 0"))
    out = events.join(own, (F.col("site_id") == F.col("__s1")) & (raw == F.col("__a1")), "left").join(every, raw == F.col("__a0"), "left")
    new = F.coalesce("__c1", "__c0", raw)
    return out.withColumns({field: new, f"{field}_raw": F.when(~new.eqNullSafe(raw), raw)}).drop(*[f"__{c}{n}" for c in "sac" for n in "01"])


def retained(events: DataFrame, days: int, today: str) -> tuple[DataFrame, str]:
    """Rows of the last whole local days, and the floor before which raw rows are gone."""
    from datetime import date, timedelta

    floor = (date.fromisoformat(today) - timedelta(days=days)).isoformat()
    return events.filter(F.col("local_date") >= floor), floor


def alerts(measured: DataFrame, rules: DataFrame, fired: DataFrame, now_ms: int, cooldown_ms: int = 6 * 3_600_000) -> DataFrame:
    """Rules that fire: measured is (site_id, metric, current, previous), rules (rule_id, site_id, metric, kind, bound).

    Where both have dim and value, a rule asks its own value of its dimension (null: the whole site). Kinds: above, below,
    delta_pct (the change either way, in percent of a previous value that isn't 0). A value that isn't there fires
    nothing, except that below reads it as 0. Rules fired within the cooldown are silent.
    """
    keys = ["site_id", "metric", *[c for c in ("dim", "value") if c in rules.columns and c in measured.columns]]
    found = measured.withColumnsRenamed({k: f"__{k}" for k in keys})
    known = rules.join(found, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left").drop(*[f"__{k}" for k in keys])
    change = F.abs(F.try_divide(F.col("current") - F.col("previous"), F.col("previous")) * 100)
    hit = (
        F.when(F.col("kind") == "above", F.col("current") > F.col("bound")).when(F.col("kind") == "below", F.coalesce("current", F.lit(0)) < F.col("bound"))
        .when(F.col("kind") == "delta_pct", change >= F.col("bound"))
    )
    recent = fired.filter(F.col("fired_at") > now_ms - cooldown_ms).select("rule_id")
    return known.filter(F.coalesce(hit, F.lit(False))).join(recent, "rule_id", "left_anti")


def csv_text(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Columns as an export orders them, all text: keys, metrics, the rest sorted; null is empty, arrays are joined by ' > '."""
    order = [*keys, *metrics, *sorted(set(rows.columns) - {*keys, *metrics})]
    kinds = dict(rows.dtypes)
    return rows.select(*[F.coalesce(F.array_join(c, " > ") if kinds[c].startswith("array") else F.col(c).cast("string"), F.lit("")).alias(c) for c in order])


def write_csv(rows: DataFrame, path: str, keys: list[str], metrics: list[str]) -> None:
    csv_text(rows, keys, metrics).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("escape", '"').option("emptyValue", "").csv(path)


def union_periods(current: DataFrame, previous: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [d.withColumn("period", F.lit(n)) for d, n in ((current, "current"), (previous, "previous"))])
