"""Visits and actions out of another tracker's warehouse: a visit table, a table of links between visits and actions, an action table.

Reading is by ranges of ids: an increment takes the ids above a watermark, so a load can be cut into any number of
increments, and one without new rows writes nothing. An action plays up to four roles in a link (its URL, its name, an
event's category and action) and two in a visit (first and last page). The roles are laid under each other, so the action
table is joined once, on one shuffle by action, and laid side by side again by link; a common action is a hot key that
Spark splits, as its side of the join is one row.

Defined cases: rows without a readable time or visitor go; links of kinds that aren't modelled go; unknown codes of
browsers and systems stay as they are, unknown devices are `other`, unknown kinds of referrers count as direct; ids of
visits become session ids, so the same row is the same visit in every increment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import web
from ..operators.query import Unsupported
from ..sinks import facts

# Fixed values of the warehouse: what stands before a stored URL, kinds of actions and referrers, codes of agents and devices.
PREFIXES = ("http://", "http://www.", "https://", "https://www.")
PAGE, OUTLINK, DOWNLOAD, TITLE, EVENT_NAME = 1, 2, 3, 4, 12
REFERRERS = {"1": "direct", "2": "search", "3": "referral", "6": "campaign", "7": "social"}
BROWSERS = {"CH": "Chrome", "CM": "Chrome", "CI": "Chrome", "FF": "Firefox", "FM": "Firefox", "SF": "Safari", "MF": "Mobile Safari", "IE": "IE", "ED": "Edge", "OP": "Opera", "OM": "Opera", "SM": "Samsung Browser", "BR": "Brave", "VI": "Vivaldi", "UC": "UC Browser", "AN": "Android Browser"}
SYSTEMS = {"WIN": "Windows", "MAC": "Mac OS", "LIN": "Linux", "AND": "Android", "IOS": "iOS", "UBT": "Ubuntu", "COS": "Chrome OS"}
DEVICES = {"0": "desktop", "1": "mobile", "2": "tablet", "3": "mobile", "10": "mobile"}


def action_url(name: Column, prefix: Column) -> Column:
    """The whole URL of an action: its scheme was stored as a number, unless it is in the name."""
    before = F.coalesce(F.get(F.array(*map(F.lit, PREFIXES)), F.coalesce(prefix.cast("int"), F.lit(0))), F.lit(PREFIXES[0]))
    return F.when(name != "", F.when(name.rlike("(?i)^https?://"), name).otherwise(F.concat(before, name)))


def zone_name(zone: Column) -> Column:
    """A warehouse's zone as one of the zone database or an offset: UTC+10 is Etc/GMT-10, UTC-3.5 is -0330; null if it is none."""
    part = lambda n: F.regexp_extract(zone, r"^UTC([+-])(\d{1,2})(?:\.(\d+))?$", n)
    minutes = F.round(F.concat(F.lit("0."), part(3)).try_cast("double") * 60).cast("int")
    hours = part(2).try_cast("int")
    fixed = F.concat(part(1), F.lpad(part(2), 2, "0"), F.lpad(minutes.cast("string"), 2, "0"))
    etc = F.concat(F.lit("Etc/GMT"), F.when(part(1) == "+", "-").otherwise("+"), hours.cast("string"))
    made = F.when(hours.isNull(), zone).when(F.coalesce(minutes, F.lit(0)) > 0, fixed).when(hours == 0, "UTC").otherwise(etc)
    known = web.zone(made)
    return F.when((known != "UTC") | (made == "UTC"), made)


def site_targets(source: DataFrame, local: DataFrame, site_map: dict[int, int] | None = None) -> DataFrame:
    """idsite, site_id, timezone: where each site of the source goes. Refused, before anything is written, unless all have one.

    source: idsite, timezone, domains; local: site_id, timezone, domains. A site keeps its id, or takes the one the map
    names; a local site of that id must share a domain, or be named by the map, and then its zone holds.
    """
    named = source.sparkSession.createDataFrame(sorted((site_map or {}).items()), "idsite long, to long")
    mapped = source.join(named, "idsite", "left").withColumn("site_id", F.coalesce("to", F.col("idsite")))
    here = local.select("site_id", F.col("timezone").alias("__zone"), F.col("domains").alias("__domains"))
    both = mapped.join(here, "site_id", "left")
    claims = F.count("*").over(Window.partitionBy("site_id"))
    problem = (
        F.when(claims > 1, F.format_string("more than one site maps to %d", "site_id"))
        .when(F.col("__zone").isNotNull() & F.col("to").isNull() & ~F.coalesce(F.arrays_overlap("domains", "__domains"), F.lit(False)), F.format_string("site %d shares no domain with the local site of that id", "idsite"))
        .when(F.col("__zone").isNull() & zone_name(F.col("timezone")).isNull(), F.format_string("site %d has an unknown zone", "idsite"))
    )
    out = both.withColumn("problem", problem)
    bad = out.filter("problem IS NOT NULL").select("problem").distinct().orderBy("problem").limit(20).collect()
    missing = named.join(source, "idsite", "left_anti").limit(20).collect()
    if bad or missing:
        raise Unsupported("; ".join([r.problem for r in bad] + [f"no site {r.idsite} in the source" for r in missing]))
    return out.select("idsite", "site_id", F.coalesce("__zone", zone_name(F.col("timezone"))).alias("timezone"))


def with_actions(rows: DataFrame, key: str, roles: dict[str, str], actions: DataFrame) -> DataFrame:
    """rows with a struct (type, name, url_prefix) for each role, of the action whose id the role's column holds."""
    # two rows of one id may name other actions, and an id may be null, so a row is known by its id and its actions
    rows = rows.withColumn("__row", F.struct(key, *roles.values()))
    laid = rows.select("__row", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).cast("long").alias("idaction")) for r, c in roles.items()])).alias("r")).select("__row", "r.*").filter("idaction IS NOT NULL")
    found = laid.join(actions.select("idaction", F.struct("type", "name", "url_prefix").alias("a")), "idaction")
    side = found.groupBy("__row").agg(*[F.first(F.when(F.col("role") == r, F.col("a")), ignorenulls=True).alias(r) for r in roles])
    return rows.join(side, "__row", "left").drop("__row")


def session_id(idvisit: Column) -> Column:
    return F.lpad(F.lower(F.hex(idvisit)), 16, "0")


def _code(table: dict[str, str], value: Column, rest: Column) -> Column:
    return F.coalesce(web.mapped(table, value.cast("string")), rest)


def _of_visit(rows: DataFrame) -> dict[str, Column]:
    """Attribution and agent, which a visit gives to all of its rows."""
    kind = _code(REFERRERS, F.col("referer_type"), F.lit("direct"))
    host = web.referrer_domain(F.col("referer_url"))
    none = F.lit(None).cast("string")
    return {"ref_type": kind, "ref_domain": F.when(kind != "direct", host), "utm_source": none, "utm_medium": none, "utm_campaign": F.when(kind == "campaign", web.normalized(F.col("referer_name"))),
            "browser": _code(BROWSERS, F.col("config_browser_name"), F.nullif(F.col("config_browser_name"), F.lit(""))), "os": _code(SYSTEMS, F.col("config_os"), F.nullif(F.col("config_os"), F.lit(""))),
            "device_type": _code(DEVICES, F.col("config_device_type"), F.lit("other")), "country": F.nullif(F.upper("location_country"), F.lit("")), "region": F.col("location_region"), "city": F.col("location_city")}


def _paths(rows: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """rows with <role>_path and <role>_host of the URLs of those roles."""
    for role in roles:
        url = f"__{role}"
        rows = web.with_url(rows.withColumn(url, action_url(F.col(f"{role}.name"), F.col(f"{role}.url_prefix"))), url)
        rows = rows.withColumns({f"{role}_path": F.when(F.col(url).isNotNull(), web.page_path(url)), f"{role}_host": F.col("u_host")}).drop(*web.U_COLUMNS, url)
    return rows


def _local(ts: str) -> dict[str, Column]:
    local = web.local_time(F.col(ts), F.col("timezone"))
    return {"local_date": F.date_format(local, "yyyy-MM-dd"), "local_hour": F.hour(local)}


def imported_visits(visits: DataFrame, actions: DataFrame, targets: DataFrame) -> DataFrame:
    """Visit rows: times in ms, first and last page, counters as the warehouse has them (actions stand for page views)."""
    rows = _paths(with_actions(visits, "idvisit", {"entry": "visit_entry_idaction_url", "exit": "visit_exit_idaction_url"}, actions), ("entry", "exit"))
    rows = rows.join(targets, "idsite").filter("visit_first_action_time IS NOT NULL AND idvisitor IS NOT NULL")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = rows.withColumns({"started_at": F.unix_millis("visit_first_action_time"), "last_seen_at": F.unix_millis(F.coalesce("visit_last_action_time", "visit_first_action_time"))})
    return rows.withColumns({**_of_visit(rows), **_local("started_at")}).select(
        session_id(F.col("idvisit")).alias("session_id"), "site_id", F.col("idvisitor").alias("visitor"), "local_date", "local_hour", "ref_type", "ref_domain", "utm_source", "utm_medium", "utm_campaign", "country", "browser", "device_type", "os", "region", "city",
        "started_at", "last_seen_at", count("visit_total_actions").alias("pageviews"), count("visit_total_events").alias("events"), (F.greatest(count("visit_total_time"), F.lit(0)) * 1000).alias("engaged_ms"), F.col("entry_path"), F.col("exit_path"))


ROLES = {"url": "idaction_url", "label": "idaction_name", "category": "idaction_event_category", "deed": "idaction_event_action"}


def imported_events(links: DataFrame, visits: DataFrame, actions: DataFrame, targets: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Event rows of links: an event (category and action), outlink, download, page, or a title alone; other kinds go.

    seq numbers a visit's rows by link id and goes on after those of `stored` (session_id, seq).
    """
    rows = _paths(with_actions(links, "idlink_va", ROLES, actions), ("url",))
    of_visits = visits.select("idvisit", "referer_type", "referer_name", "referer_url", "config_browser_name", "config_os", "config_device_type", "location_country", "location_region", "location_city")
    rows = rows.join(of_visits, "idvisit").join(targets, "idsite").filter("server_time IS NOT NULL AND idvisitor IS NOT NULL")
    kind_of = F.col("url.type")
    title = F.when(F.col("label.type") == TITLE, F.col("label.name"))
    event = (F.col("category.name") != "") & (F.col("deed.name") != "")
    page = (kind_of == PAGE) & F.col("url_path").isNotNull()
    kind = F.when(event, "event").when(kind_of == OUTLINK, "outlink").when(kind_of == DOWNLOAD, "download").when(page | title.isNotNull(), "pageview")
    rows = rows.withColumns({"type": kind, "ts": F.unix_millis("server_time"), "title": title, "of_page": page}).filter("type IS NOT NULL")
    linked = F.col("type").isin("outlink", "download")
    is_event = F.col("type") == "event"
    rows = rows.withColumns({**_of_visit(rows), **_local("ts"), "session_id": session_id(F.col("idvisit"))})
    before = F.lit(0)
    if stored is not None:
        rows = rows.join(stored.groupBy("session_id").agg(F.max("seq").alias("__seq")), "session_id", "left")
        before = F.coalesce("__seq", F.lit(0))
    seq = before + F.row_number().over(Window.partitionBy("session_id").orderBy("idlink_va"))
    return rows.select(
        F.col("idlink_va").alias("hit_id"), "session_id", "site_id", F.col("idvisitor").alias("visitor"), "ts", "local_date", "local_hour", "type", F.when(F.col("of_page") & ~linked, F.col("url_path")).alias("path"),
        F.when(F.col("of_page") & ~linked, F.col("url_host")).alias("hostname"), F.when(~linked & ~is_event, F.col("title")).alias("title"), F.when(linked, action_url(F.col("url.name"), F.col("url.url_prefix"))).alias("target_url"),
        F.when(is_event, F.col("category.name")).alias("event_category"), F.when(is_event, F.col("deed.name")).alias("event_action"), F.when(is_event & (F.col("label.type") == EVENT_NAME), F.col("label.name")).alias("event_name"),
        F.when(is_event, F.col("custom_float")).alias("event_value"), "ref_type", "ref_domain", "utm_source", "utm_medium", "utm_campaign", "country", "browser", "device_type", "os", "region", "city", seq.cast("long").alias("seq"))


def watermarks(store: facts.Store) -> dict[str, int]:
    """The largest ids that a store has taken of each source; a source that has given none yet isn't there."""
    marks = facts.read(store, "marks")
    if "mark" not in marks.columns:
        return {}
    return {r.source: r.mark for r in marks.groupBy("source").agg(F.max("mark").alias("mark")).collect()}


#: The watermark of a source that has given rows without ids only; all ids are above it but its own.
_LEAST = -(1 << 63)


def above(rows: DataFrame, key: str, mark: int | None, until: int | None) -> DataFrame:
    """Rows with ids over the watermark, up to `until`. Before a source's first watermark its ids of 0 and below count, and its rows without an id."""
    if mark is not None:
        rows = rows.filter(F.col(key) > mark)
    return rows if until is None else rows.filter((F.col(key) <= until) | F.col(key).isNull())


def top(key: str) -> Column:
    """The watermark after rows were taken; null if there were none."""
    return F.max(F.coalesce(key, F.lit(_LEAST)))


def increment(store: facts.Store, number: int, visits: DataFrame, links: DataFrame, actions: DataFrame, targets: DataFrame, until: int | None = None) -> bool:
    """Land the rows above the watermarks, links up to `until` and the visits they touch; False if there are none.

    A visit that grew since an earlier increment is taken again and replaces its row; seq goes on where it stood.
    """
    if number in facts.flushes(store):
        return False
    marks = watermarks(store)
    fresh = above(links, "idlink_va", marks.get("links"), until)
    if fresh.isEmpty():
        return False
    old = facts.read(store, "events")
    events = facts._write(store, "events", imported_events(fresh, visits, actions, targets, old.select("session_id", "seq") if "seq" in old.columns else None), number)
    touched = visits.join(fresh.select("idvisit").distinct(), "idvisit", "left_semi")
    new = imported_visits(touched, actions, targets)
    before = facts.read(store, "visits")
    if "session_id" in before.columns:
        kept = facts.on_days(before, new).join(new.select("session_id"), "session_id", "left_anti")
        new = new.unionByName(kept.select(*new.columns))
    landed = facts._write(store, "visits", new, number)
    tops = fresh.agg(top("idlink_va").alias("links"), top("idvisit").alias("visits")).first().asDict()
    tops = {name: max(t, marks.get(name, t)) for name, t in tops.items()}
    mark = store.spark.createDataFrame([(0, "", name, t) for name, t in tops.items()], "site_id long, local_date string, source string, mark long")
    facts._commit(store, number, {"events": (events, False), "visits": (landed, True), "marks": (facts._write(store, "marks", mark, number), False)})
    return True
