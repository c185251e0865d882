"""Hits from what trackers send: query-string requests, bulk bodies, JSON envelopes. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.web import RECEIVED_LENGTH, bounded, fenced

#: Hits that one envelope may hold; the rest of it is ignored.
ENVELOPE_HITS = 50
HIT = "type string, url string, title string, referrer string, target_url string, category string, action string, name string, value double, screen string, lang string, scroll double, props string"
#: Most characters of a field; a longer one is dropped and the hit stays. URLs are cut instead.
TITLE, PAYLOAD, NAME, SCREEN, LANG, USER = 512, 200, 500, 20, 35, 200


def pairs(text: Column) -> Column:
    """Name and decoded value of every parameter, in order."""
    def decoded(raw: Column) -> Column:
        plus = F.replace(raw, F.lit("+"), F.lit(" "))
        return F.when(F.contains(raw, F.lit("%")), F.coalesce(F.try_url_decode(raw), raw)).otherwise(plus)

    parts = F.filter(F.split(F.regexp_replace(text, r"^[^?]*\?", ""), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("name"), F.when(F.contains(p, F.lit("=")), decoded(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("value")))


def value_of(name: str, longest: int | None = None) -> Column:
    """First value of that name among p_names and p_values; blank or over-long is null, the hit stays."""
    at = F.array_position("p_names", name)
    found = F.when(at > 0, F.get("p_values", at.cast("int") - 1))
    return F.when((found != "") & (F.length(found) <= longest if longest else F.lit(True)), found)


def from_requests(log: DataFrame) -> DataFrame:
    """line, site_id and a typed hit of each request (columns line, received_at, request, body); form body before query.

    Only requests with rec=1 are taken. Type: event (both category and action), outlink, download, ping, pageview, the
    first whose parameters are there; a page view needs a URL or a title, and none of the parameters that declare
    another kind (ca=1; a goal or content interaction, however blank). Over-long URLs are cut (`web.bounded`).
    """
    body = F.when(F.col("body").isNotNull(), pairs(F.col("body"))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    # parsed once a request: a filter on what comes out can't reach behind these columns
    p = fenced(fenced(log, p_all=F.concat(body, pairs(F.coalesce("request", F.lit(""))))), p_names=F.col("p_all.name"), p_values=F.col("p_all.value"))
    get = value_of
    link = lambda name: bounded(get(name))
    category, action = get("e_c", PAYLOAD), get("e_a", PAYLOAD)
    other = F.coalesce(get("ca") == "1", F.lit(False)) | F.arrays_overlap("p_names", F.array(*map(F.lit, ("idgoal", "c_n", "c_i"))))
    kind = (
        F.when(category.isNotNull() & action.isNotNull(), "event").when(get("link").isNotNull(), "outlink").when(get("download").isNotNull(), "download")
        .when(get("ping") == "1", "ping").when((get("url").isNotNull() | get("action_name", TITLE).isNotNull()) & ~other, "pageview")
    )
    event = F.col("type") == "event"
    visitor = F.lower(get("_id"))
    out = fenced(
        p, ts=F.col("received_at"), recorded=F.coalesce(get("rec") == "1", F.lit(False)), site_id=get("idsite", 20).try_cast("long"), type=kind, url=F.nullif(link("url"), F.lit("")), title=get("action_name", TITLE), referrer=link("urlref"),
        target_url=F.coalesce(link("link"), link("download")), event_category=category, event_action=action, event_name=get("e_n", NAME), event_value=get("e_v").try_cast("double"), uid=get("uid", USER),
        tracker_id=F.when(visitor.rlike("^[0-9a-f]{16}$"), visitor), screen=get("res", SCREEN), lang=get("lang", LANG),
    )
    out = out.filter("recorded AND site_id > 0 AND type IS NOT NULL").drop("received_at", "request", "body", "p_all", "p_names", "p_values", "recorded")
    payload = {c: F.when(event, F.col(c)) for c in ("event_category", "event_action", "event_name", "event_value")}
    return out.withColumns({**payload, "target_url": F.when(F.col("type").isin("outlink", "download"), F.col("target_url"))})


def from_bulk(bodies: DataFrame) -> DataFrame:
    """Requests of bodies like {"requests": ["?idsite=1&…", …]} (columns batch, received_at, payload); malformed bodies give none."""
    found = bodies.select("batch", "received_at", F.posexplode(F.from_json("payload", "requests array<string>")["requests"]).alias("at", "request"))
    return found.select((F.col("batch") * F.lit(1 << 20) + F.col("at")).alias("line"), "received_at", "request", F.lit(None).cast("string").alias("body"))


def from_envelopes(bodies: DataFrame) -> DataFrame:
    """Hits of JSON envelopes (columns batch, received_at, payload), each checked alone; at most ENVELOPE_HITS of one.

    `site` stays as the envelope names it, an id or a domain (see visits.named_sites); site_id is it where it is a number. A field that is
    too long or no such value is null and its hit stays; URLs are cut. scroll is 0 to 100 or null, props a JSON bag.
    """
    fields = ", ".join(f"{n}:{t}" for n, t in (f.split(" ") for f in HIT.split(", ")))
    parsed = F.from_json("payload", f"site string, hits array<struct<{fields}>>")
    rows = bodies.select("batch", F.col("received_at").alias("ts"), parsed.alias("b")).select("batch", "ts", F.col("b.site").alias("site"), F.posexplode(F.slice("b.hits", 1, ENVELOPE_HITS)).alias("at", "h")).select("batch", "at", "ts", "site", "h.*")
    short = lambda c, n: F.when((F.length(c) <= n) & ((F.col(c) != "") | F.lit(c not in ("category", "action"))), F.col(c))
    link = lambda c: F.when(F.length(c) <= RECEIVED_LENGTH, bounded(F.col(c)))
    kept = rows.withColumns({
        "site_id": F.col("site").try_cast("long"), "url": link("url"), "referrer": link("referrer"), "target_url": F.nullif(link("target_url"), F.lit("")),
        **{c: short(c, n) for c, n in (("title", TITLE), ("category", PAYLOAD), ("action", PAYLOAD), ("name", NAME), ("screen", SCREEN), ("lang", LANG))},
        "scroll_pct": F.when(F.col("scroll").between(0, 100) & (F.col("scroll") == F.floor("scroll")), F.col("scroll").cast("int")),
    }).drop("scroll")
    known = F.col("type").isin("pageview", "event", "outlink", "download", "ping")
    whole = ~F.col("type").isin("event") | (F.col("category").isNotNull() & F.col("action").isNotNull())
    aimed = ~F.col("type").isin("outlink", "download") | F.col("target_url").isNotNull()
    return kept.filter(known & whole & aimed & (F.col("site") != ""))
