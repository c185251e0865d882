"""Enrichment of hits and their assignment to visits, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import web

IDLE_MS, REVIVE_MS, GAP_MS, BOUNCE_MS = 30 * 60_000, 4 * 3_600_000, 20_000, 15_000
FIRST_TOUCH = ("ref_type", "ref_domain", "utm_source", "utm_medium", "utm_campaign")
#: Values as received where what is stored differs; they go along with the first touch.
FIRST_RAW = ("ref_domain_raw", "utm_source_raw", "utm_medium_raw", "utm_campaign_raw")
#: Rows that a task of a large table has: its sorts and hash tables stay as small however large the table is.
TASK_ROWS = 50_000
#: The property under which a page of missing pages tells what was asked for, and how much of it is stored.
MISSING, MISSING_PATH = "missing", 200


def milestone() -> Column:
    return F.coalesce((F.col("type") == "event") & (F.col("event_category") == "scroll") & (F.col("event_action") == "read"), F.lit(False))


def site_hosts(sites: DataFrame) -> DataFrame:
    """site_id, timezone, domains, carved: a site's domains in bare form, and the domains below them that other sites own.

    sites is a dimension table, a row a site, with `domain` or an array `domains`.
    """
    all_ = F.col("domains") if "domains" in sites.columns else F.array("domain")
    own = sites.select("site_id", web.zone(F.col("timezone")).alias("timezone"), F.transform(all_, web.bare_host).alias("domains"))
    flat = own.select("site_id", F.explode("domains").alias("d"))
    labels = F.split("d", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    below = flat.filter(F.size(labels) > 1).select(F.col("site_id").alias("other"), F.col("d").alias("sub"), F.explode(above).alias("d"))
    carved = flat.join(below, "d").filter("site_id <> other").groupBy("site_id").agg(F.collect_set("sub").alias("carved"))
    return own.join(carved, "site_id", "left").withColumn("carved", F.coalesce("carved", F.array().cast("array<string>")))


def _covers(domains: Column, host: Column) -> Column:
    return F.exists(domains, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def site_references(sites: DataFrame) -> DataFrame:
    """__name, site_id: every text that names a site, its id or any of its domains in lower case.

    Of several sites with one domain the smallest id has it; an id goes before a domain.
    """
    all_ = F.col("domains") if "domains" in sites.columns else F.array("domain")
    own = sites.select("site_id", F.explode(F.transform(all_, F.lower)).alias("__name")).groupBy("__name").agg(F.min("site_id").alias("site_id"))
    ids = sites.select(F.col("site_id").cast("string").alias("__name"), "site_id")
    return ids.union(own.join(ids.select("__name"), "__name", "left_anti").select("__name", "site_id"))


def _reference(by: str) -> Column:
    return F.lower(F.trim(F.col(by).cast("string")))


def named_sites(hits: DataFrame, sites: DataFrame, by: str = "site") -> DataFrame:
    """hits with site_id of the site that column `by` names, by its id or any of its domains, whatever their case; hits that name none go."""
    return hits.withColumn("__name", _reference(by)).join(F.broadcast(site_references(sites)), "__name").drop("__name")


def unnamed(hits: DataFrame, sites: DataFrame, by: str = "site") -> DataFrame:
    """ref, hits, last_seen of the texts in column `by` that name no site; null counts as ''. Joins the few references, not the hits."""
    lost = hits.withColumn("__name", _reference(by)).join(F.broadcast(site_references(sites).select("__name")), "__name", "left_anti")
    return lost.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("ref")).agg(F.count("*").alias("hits"), F.max("ts").alias("last_seen"))


def aliased(rows: DataFrame, aliases: DataFrame, field: str) -> DataFrame:
    """rows with column `field` (normalized) replaced by its alias: a site's own, else that of all sites (site_id 0)."""
    mine = aliases.filter(F.col("field") == field).select("site_id", "alias", "canonical").dropDuplicates(["site_id", "alias"])
    own = mine.filter("site_id <> 0").select(F.col("site_id").alias("__s"), F.col("alias").alias("__a"), F.col("canonical").alias("__own"))
    every = mine.filter("site_id = 0").select(F.col("alias").alias("__e"), F.col("canonical").alias("__every"))
    found = rows.join(own, (F.col("site_id") == F.col("__s")) & (F.col(field) == F.col("__a")), "left").join(every, F.col(field) == F.col("__e"), "left")
    return found.withColumn(field, F.coalesce("__own", "__every", field)).drop("__s", "__a", "__own", "__e", "__every")


def enrich(hits: DataFrame, sites: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Local time, page identity and attribution; hits of unknown sites go (see unknown_sites).

    A campaign on the URL goes before a click id, which counts only where no campaign value is, and both go before the
    referrer, whose domain is kept all the same. The received host decides whether a referrer is the site itself. What
    was received is kept (`*_raw`) where the stored value differs. aliases: site_id (0 for all), field, alias, canonical.
    Columns come in layers, so what a query doesn't read isn't computed. Sites are broadcast: a shuffle by site would put a
    site's hits in one task.
    """
    known = web.with_url(hits.join(F.broadcast(site_hosts(sites)), "site_id"))
    known = web.layered(known, ref_host=web.url_host(F.col("referrer")), local=web.local_time(F.col("ts"), F.col("timezone")),
                        **{f"{c}_got": web.campaign(c) for c in web.CAMPAIGN})
    own = F.coalesce((F.col("ref_host") == F.col("u_host")) | (_covers(F.col("domains"), F.col("ref_host")) & ~_covers(F.col("carved"), F.col("ref_host"))), F.lit(False))
    got = F.coalesce(*[F.col(f"{c}_got") for c in web.CAMPAIGN]).isNotNull()
    clicked = {"utm_source": 1, "utm_medium": 2}
    known = web.layered(known, ref_domain=web.canonical_domain(F.col("ref_host")), own=own, got=got,
                        **{c: F.when(got, web.normalized(F.col(f"{c}_got"))).otherwise(web.click_source(clicked[c]) if c in clicked else F.lit(None)) for c in web.CAMPAIGN})
    if aliases is not None:
        for c in web.CAMPAIGN:
            known = aliased(known, aliases, c)
    known = web.layered(known, ref_kind=web.referrer_type(F.col("ref_domain"), F.col("own")))
    out = known.withColumns({
        "local_date": F.date_format("local", "yyyy-MM-dd"), "local_hour": F.hour("local"), "path": web.page_path(), "hostname": F.col("u_host"),
        "ref_domain_raw": F.when(F.col("ref_host") != F.col("ref_domain"), F.col("ref_host")), "ref_path": F.when(F.col("ref_domain").isNotNull(), F.coalesce(F.nullif(F.regexp_extract("referrer", web.URL, 3), F.lit("")), F.lit("/"))),
        "ref_type": F.when(F.col("got") | F.col("utm_source").isNotNull(), "campaign").otherwise(F.col("ref_kind")),
        **{f"{c}_raw": F.when(~F.col(c).eqNullSafe(F.col(f"{c}_got")), F.col(f"{c}_got")) for c in web.CAMPAIGN},
    })
    return out.drop(*web.U_COLUMNS, *[f"{c}_got" for c in web.CAMPAIGN], "got", "url", "referrer", "domains", "carved", "timezone", "ref_host", "local", "own")


def unknown_sites(hits: DataFrame, sites: DataFrame) -> DataFrame:
    """Hits that name no known site: site_id, hits, last time."""
    return hits.join(sites.select("site_id"), "site_id", "left_anti").groupBy("site_id").agg(F.count("*").alias("hits"), F.max("ts").alias("last_ts"))


MISSING_A_DAY = 500


# Of a flat bag: a value of the property that counts as true, and one that is a text.
_TRUE = r'(?<!\\)"missing":\s*("([^"\\]|\\.)|true|-?0\.0*[1-9]|-?[1-9])'
_TEXT = r'(?<!\\)"missing":\s*"'


def missing_page(kind: Column, props: Column) -> Column:
    """Whether a hit is a page view of a missing page: its property `missing` is a text that isn't blank, a number other than 0, or true."""
    return (kind == "pageview") & F.coalesce(props.rlike(_TRUE), F.lit(False))


def not_found(enriched: DataFrame) -> DataFrame:
    """Page views of missing pages, apart from the traffic: the path asked for (null if no text tells it), and their own referrer with its page."""
    asked = F.substring(F.nullif(F.get_json_object("props", f"$.{MISSING}"), F.lit("")), 1, MISSING_PATH)
    path = F.when(F.col("props").rlike(_TEXT), asked)
    return enriched.filter("not_found").select("hit_id", "site_id", "ts", "local_date", "local_hour", path.alias("path"), F.col("ref_kind").alias("ref_type"), "ref_domain", "ref_path", "device_type", "country")


def not_found_stored(missing: DataFrame, most: int = MISSING_A_DAY) -> tuple[DataFrame, DataFrame]:
    """The first `most` missing hits of a site's day, which are all that is stored; and the count of all of them.

    The limit is the product's own: a flood of broken links is counted whole and kept in part. The first of each
    hour are ranked before those of the day, so that no task sorts a flooded day.
    """
    counted = missing.groupBy("site_id", "local_date").agg(F.count("*").alias("hits"))
    first = missing
    for keys in (("site_id", "local_date", "local_hour", F.pmod("hit_id", F.lit(16))), ("site_id", "local_date")):
        order = Window.partitionBy(*keys).orderBy("ts", "hit_id")
        first = first.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k")
    return first, counted


def without_tombstoned(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of sites that aren't deleted, as every write takes them."""
    return rows.join(tombstones.select("site_id").distinct(), "site_id", "left_anti")


def dealt(rows: DataFrame, *keys: str, most: int = TASK_ROWS, of: DataFrame | None = None) -> DataFrame:
    """rows shuffled by keys into so many partitions that a task has about `most` of them, however large the table; small tables and streams as they are.

    of: a table with as many rows or more that is cheaper to count.
    """
    if rows.isStreaming:
        return rows
    parts = -(-(rows if of is None else of).count() // most)
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism), *keys) if parts > 1 else rows


def sessionize(enriched: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Stored hits with session_id, seq, is_start, first-touch attribution and visit_date, the local day on which their visit began.

    A page view over 30 minutes after the last stored hit opens a visit; other hits revive one for
    4 hours; later pings and milestones are dropped without moving the clock. Windows over one shuffle by
    (site_id, visitor) and one order of a visitor's hits, so rows are sorted once, and a task has about
    TASK_ROWS of them (a visitor's hits are in one). of: as in dealt, such as the hits as received.
    """
    order = Window.partitionBy("site_id", "visitor").orderBy("ts", "hit_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = dealt(enriched, "site_id", "visitor", of=of).filter("NOT not_found").withColumn("weak", (F.col("type") == "ping") | milestone())
    marked = marked.withColumn("grp", F.sum(F.when(~F.col("weak"), 1).otherwise(0)).over(so_far)).withColumn("gap", F.col("ts") - F.lag("ts").over(order))
    late = F.col("weak") & (F.coalesce("gap", F.lit(0)) > REVIVE_MS)
    marked = marked.withColumn("late_grp", F.max(F.when(late, F.col("grp"))).over(so_far))  # of the last hit that came too late
    kept = marked.withColumn("lost", F.col("weak") & ((F.col("grp") == 0) | F.coalesce(F.col("late_grp") == F.col("grp"), F.lit(False)))).filter("NOT lost")
    kept = kept.withColumn("gap", F.col("ts") - F.lag("ts").over(order))
    starts = F.col("gap").isNull() | ((F.col("type") == "pageview") & (F.col("gap") > IDLE_MS)) | (F.col("gap") > REVIVE_MS)
    kept = kept.withColumn("is_start", starts).withColumn("place", F.row_number().over(order))
    raw = [c for c in FIRST_RAW if c in kept.columns]
    begun = F.when(F.col("is_start"), F.struct("hit_id", "place", F.col("local_date").alias("visit_date"), *FIRST_TOUCH, *raw))
    out = kept.withColumn("first", F.last(begun, ignorenulls=True).over(so_far))  # the hit that began the visit
    key = F.concat_ws(":", "site_id", "visitor", "first.hit_id")
    out = out.withColumns({
        "seq": F.col("place") - F.col("first.place") + 1, "session_id": F.substring(F.sha2(key, 256), 1, 16),
        "engaged_step": F.when(F.col("is_start"), 0).otherwise(F.least(F.greatest("gap", F.lit(0)), F.lit(GAP_MS))),
        **{c: F.col(f"first.{c}") for c in (*FIRST_TOUCH, *raw, "visit_date")},
    })
    return out.drop("weak", "grp", "gap", "late_grp", "lost", "place", "first", "not_found", "ref_kind")


def sessions(events: DataFrame) -> DataFrame:
    """One row a visit; region, city and system too where the events have them.

    A visit is one visitor's, so what sessionize left in one task is counted there, without a shuffle.
    """
    first = lambda c: F.min_by(c, "seq").alias(c)
    page = F.when(F.col("type") == "pageview", F.col("seq"))
    rows = events.groupBy("site_id", "visitor", "session_id").agg(
        *[first(c) for c in ("local_date", "local_hour", *FIRST_TOUCH, "country", "browser", "device_type", *[c for c in ("region", "city", "os") if c in events.columns])],
        F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at"), F.count_if(F.col("type") == "pageview").alias("pageviews"),
        F.count_if((F.col("type") == "event") & ~milestone()).alias("events"), F.sum("engaged_step").alias("engaged_ms"),
        F.min_by("path", "seq").alias("entry_path"), F.max_by("path", page).alias("exit_path"),
    )
    return rows.select("session_id", *[c for c in rows.columns if c != "session_id"])
