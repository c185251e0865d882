"""Tracker hits derived from the driver's `events` table, so that every query grows with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SITES = ((1, "site1.test", "America/New_York"), (2, "site2.test", "UTC"), (3, "site3.test", "Asia/Tokyo"))


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITES, "site_id long, domain string, timezone string")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a hit: what a tracker sends, with url, referrer and payload still raw."""
    return hits_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def hits_of(e: DataFrame) -> DataFrame:
    """Hits of rows of `events`, a batch or a stream."""
    k, v, i = F.get_json_object("props", "$.k").cast("int"), F.floor(F.col("user_id") / 5), F.col("event_id")
    ms = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) DIV 1000")
    e = e.select("event_id", ms.alias("ms"), "event_type", "value", k.alias("k"), v.alias("v"))
    k, v = F.col("k"), F.col("v")
    site = F.lit(1) + v % 3
    kind = (
        F.when(F.col("event_type") == "view", "pageview").when(F.col("event_type").isin("purchase", "signup"), "event").when(F.col("event_type") == "error", "ping")
        .otherwise(F.element_at(F.array(F.lit("outlink"), F.lit("pageview"), F.lit("download")), (i % 3 + 1).cast("int")))
    )
    host = F.concat(F.lit("site"), site.cast("string"), F.lit(".test"))
    query = F.when(k % 10 == 0, "?utm_source=News+Letter&utm_medium=%20E-Mail&utm_campaign=Spring++SALE").when(k % 10 == 1, "?gclid=x1").when(k % 10 == 2, "?page=2&fbclid=y2").when(k % 10 == 3, "?gbraid=z&mtm_src=Z&utm_content=b").otherwise("")
    missing = (F.col("event_type") == "view") & (i % 37 == 0)
    path = F.when(missing, F.concat(F.lit("/old"), (k % 4).cast("string"))).otherwise(F.concat(F.lit("/p"), (k % 12).cast("string")))
    referrers = F.array(F.lit(None).cast("string"), F.lit("https://www.google.com/search?q=x"), F.lit("https://www.facebook.com/p"), F.lit("https://t.co/abc"), F.concat(F.lit("https://"), host, F.lit("/")), F.lit("https://blog.writer.co.uk/post"), F.lit("http://203.0.113.9/x"), F.concat(F.lit("https://docs."), host, F.lit("/help")), F.lit("https://news.ycombinator.com/item"))
    buys, milestone = F.col("event_type") == "purchase", (F.col("event_type") == "signup") & (i % 4 == 0)
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    event = kind == "event"
    return e.select(
        i.alias("hit_id"), site.cast("long").alias("site_id"), v.cast("long").alias("visitor"), F.col("ms").alias("ts"), kind.alias("type"), missing.alias("not_found"),
        F.concat(F.lit("https://"), host, path, query).alias("url"), F.get(referrers, (i % 9).cast("int")).alias("referrer"),
        F.when(event, F.when(buys, "shop").when(milestone, "scroll").otherwise("account")).alias("event_category"),
        F.when(event, F.when(buys, "purchase").when(milestone, "read").otherwise("signup")).alias("event_action"),
        F.when(kind == "outlink", F.concat(F.lit("https://out.test/"), (k % 3).cast("string"))).when(kind == "download", "https://files.test/a.pdf").alias("target_url"),
        F.when(event & buys, F.concat(F.lit("item"), (k % 5).cast("string"))).alias("event_name"), F.when(event & buys, F.col("value")).alias("event_value"),
        F.when(kind == "ping", k).alias("scroll_pct"),
        F.when(missing, F.to_json(F.struct(F.concat(path, F.when(k % 10 == 2, "?page=2").otherwise("")).alias("missing")))).when(kind.isin("pageview", "event"), F.to_json(F.struct((k % 2 == 0).alias("beta"), pick(["free", "pro", "team"], k).alias("plan")))).alias("props"),
        F.when(v % 7 != 0, pick(["US", "DE", "JP", "BR"], v)).alias("country"), pick(["Chrome", "Firefox", "Safari"], v).alias("browser"), pick(["desktop", "mobile", "tablet", "other"], v).alias("device_type"),
    )


# Agents of the demo's visitors, one of them a crawler.
AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_1 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.1 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (compatible; ExampleBot/2.1; +https://bot.test/)",
    "",
)


def clients(hits: DataFrame) -> DataFrame:
    """hits with the address and agent that sent them, and a bag of raw properties."""
    v, i = F.col("visitor"), F.col("hit_id")
    bag = F.create_map(F.lit("plan"), F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("team")), (i % 3 + 1).cast("int")), F.lit("item"), F.concat(F.lit("n"), (i % 701).cast("string")),
                       F.lit("Bad Key"), F.lit("x"), F.lit("addr"), F.lit("10.0.0.1"), F.lit("mapped"), F.when(i % 2 == 0, "::ffff:1.2.3.4"), F.lit("long"), F.repeat(F.lit("y"), 201))
    return hits.withColumns({"ip": F.when(v % 11 == 10, F.concat(F.lit("2001:db8:1::"), F.hex(v % 200))).when(v % 11 == 9, F.concat(F.lit("::ffff:203.0.113."), (v % 200).cast("string"))).otherwise(F.concat(F.lit("203.0.113."), (v % 200).cast("string"))), "user_agent": F.get(F.array(*map(F.lit, AGENTS)), (v % 5).cast("int")), "tracker_id": F.lit(None).cast("string"), "bag": bag})


def requests(hits: DataFrame) -> DataFrame:
    """The query-string log that would give these hits; every fifth request has its parameters in a form body."""
    q = lambda name, c: F.concat(F.lit(f"&{name}="), F.url_encode(c))
    kind = F.col("type")
    text = F.concat(
        F.lit("idsite="), F.col("site_id").cast("string"), q("url", F.concat("url", F.lit("#part"))), F.coalesce(q("urlref", F.col("referrer")), F.lit("")),
        F.when(kind == "event", F.concat(q("e_c", F.col("event_category")), q("e_a", F.col("event_action")), F.coalesce(q("e_n", F.col("event_name")), F.lit("")), F.coalesce(q("e_v", F.col("event_value").cast("string")), F.lit(""))))
        .when(kind == "outlink", q("link", F.lit("https://out.test/a?b=c"))).when(kind == "download", q("download", F.lit("https://files.test/a.pdf"))).when(kind == "ping", F.lit("&ping=1")).otherwise(""),
    )
    form = F.col("hit_id") % 5 == 0
    return hits.select(F.col("hit_id").alias("line"), F.col("ts").alias("received_at"), F.when(form, "?rec=1&url=https%3A%2F%2Fwrong.test%2F").otherwise(F.concat(F.lit("/t.php?rec=1&"), text)).alias("request"), F.when(form, text).alias("body"))


def bulk(hits: DataFrame) -> DataFrame:
    """Bodies of up to ten requests."""
    lines = requests(hits).select((F.col("line") / 10).cast("long").alias("batch"), "received_at", "line", F.coalesce("body", "request").alias("r"))
    many = F.transform(F.array_sort(F.collect_list(F.struct("line", "r"))), lambda x: F.concat(F.lit("?rec=1&"), F.regexp_replace(x["r"], r"^[^?]*\?", "")))
    return lines.groupBy("batch").agg(F.max("received_at").alias("received_at"), F.to_json(F.struct(many.alias("requests"))).alias("payload"))


def envelopes(hits: DataFrame) -> DataFrame:
    """JSON envelopes of up to ten hits of one site; links lose their target when the hit's id divides by 4."""
    target = F.when(F.col("type").isin("outlink", "download") & (F.col("hit_id") % 4 != 0), "https://out.test/")
    h = F.struct("hit_id", "type", "url", "referrer", target.alias("target_url"), F.col("event_category").alias("category"), F.col("event_action").alias("action"), F.col("event_name").alias("name"), F.col("event_value").alias("value"))
    batch = (F.col("hit_id") / 10).cast("long") * 8 + F.col("site_id")
    return hits.groupBy(batch.alias("batch"), "site_id").agg(F.max("ts").alias("received_at"), F.array_sort(F.collect_list(h)).alias("hits")).select("batch", "received_at", F.to_json(F.struct(F.col("site_id").alias("site"), "hits")).alias("payload"))


def site_names(hits: DataFrame) -> DataFrame:
    """hits with `site`, the text that names their site in place of site_id: its id, its domain in any case, or an unknown name."""
    i, domain = F.col("hit_id"), F.concat(F.lit("site"), F.col("site_id").cast("string"), F.lit(".test"))
    named = F.when(i % 5 == 4, "other.test").when(i % 5 < 2, F.col("site_id").cast("string")).when(i % 5 == 2, domain).otherwise(F.upper(domain))
    return hits.withColumn("site", named).drop("site_id")


def aliases(spark: SparkSession) -> DataFrame:
    table = [(0, "utm_source", "google", "ads"), (2, "utm_source", "google", "search ads"), (3, "utm_medium", "google", "none")]
    return spark.createDataFrame(table, "site_id long, field string, alias string, canonical string")


def address_blocks(spark: SparkSession) -> DataFrame:
    from ..operators.admission import address_range

    table = (("203.0.113.0/26", "DE", "Berlin"), ("203.0.113.64/26", "JP", "Tokyo"), ("198.51.0.0/15", "US", "Austin"), ("2001:db8::/32", "FR", "Paris"))
    return spark.createDataFrame([(*address_range(a), c, t) for a, c, t in table], "lo string, hi string, geo_country string, geo_city string")


def arrivals(hits: DataFrame) -> DataFrame:
    """Hits as a collector gets them: the site as text, address, agent, languages, title, screen, raw properties; nothing looked up yet."""
    v, i = F.col("visitor"), F.col("hit_id")
    sent = site_names(clients(hits).drop("country", "browser", "device_type", "not_found"))
    return sent.withColumns({
        "tracker_id": F.when(v % 2 == 0, v.cast("string")), "accept_language": F.get(F.array(F.lit("de-DE,de;q=0.9"), F.lit(None), F.lit("")), (i % 3).cast("int")), "lang": F.lit("fr"),
        "title": F.when(F.col("type") == "pageview", F.concat(F.lit("Page "), (i % 5).cast("string"))), "screen": F.when(v % 3 > 0, F.when(v % 3 == 1, "1920x1080").otherwise("390x844")),
    }).drop("visitor")


def places(spark: SparkSession) -> DataFrame:
    """The address blocks under the names that stored events have."""
    return address_blocks(spark).select("lo", "hi", F.col("geo_country").alias("country"), F.upper(F.substring("geo_city", 1, 2)).alias("region"), F.col("geo_city").alias("city"))


def warehouse(stored: DataFrame) -> dict[str, DataFrame]:
    """The warehouse another tracker would hold of these stored events: visits, links, actions, sites. Pings aren't in it."""
    e = stored.filter("type <> 'ping'").withColumn("idvisit", F.min("hit_id").over(Window.partitionBy("session_id")))
    host = F.concat(F.lit("site"), F.col("site_id").cast("string"), F.lit(".test"))
    page = F.concat(host, F.col("path"))
    link = F.col("type").isin("outlink", "download")
    kinds = {  # role: its name, its kind
        "idaction_url": (F.when(F.col("type") == "outlink", "https://out.test/a").when(F.col("type") == "download", "files.test/a.pdf").otherwise(page), F.when(F.col("type") == "outlink", 2).when(F.col("type") == "download", 3).otherwise(1)),
        "idaction_name": (F.when(F.col("type") == "event", F.col("event_name")).when(~link, F.concat(F.lit("Title of "), F.col("path"))), F.when(F.col("type") == "event", 12).otherwise(4)),
        "idaction_event_category": (F.when(F.col("type") == "event", F.col("event_category")), F.lit(10)), "idaction_event_action": (F.when(F.col("type") == "event", F.col("event_action")), F.lit(11)),
    }
    named = e.withColumns({c: F.when(n.isNotNull(), F.struct(k.cast("int").alias("type"), n.alias("name"))) for c, (n, k) in kinds.items()})
    key = lambda a: F.when(a.isNotNull(), F.xxhash64(a["type"], a["name"]))
    actions = named.select(F.explode(F.array(*kinds)).alias("a")).filter("a IS NOT NULL").select(key(F.col("a")).alias("idaction"), "a.type", "a.name", F.lit(2).alias("url_prefix")).distinct()
    time = F.timestamp_millis("ts")
    links = named.select(F.col("hit_id").alias("idlink_va"), "idvisit", F.col("site_id").alias("idsite"), F.col("visitor").alias("idvisitor"), time.alias("server_time"), F.col("event_value").alias("custom_float"), *[key(F.col(c)).alias(c) for c in kinds])
    pages = F.when(F.col("type") == "pageview", F.col("seq"))
    first = lambda c, by="seq": F.min_by(c, by)
    codes = {"Chrome": "CH", "Firefox": "FM", "Safari": "SF"}
    visits = named.groupBy("idvisit").agg(
        F.first("site_id").alias("idsite"), F.first("visitor").alias("idvisitor"), F.min(time).alias("visit_first_action_time"), F.max(time).alias("visit_last_action_time"), F.sum((F.col("engaged_step") / 1000).cast("long")).alias("visit_total_time"),
        F.count_if(F.col("type") != "event").alias("visit_total_actions"), F.count_if(F.col("type") == "event").alias("visit_total_events"), first(key(F.col("idaction_url")), pages).alias("visit_entry_idaction_url"), F.max_by(key(F.col("idaction_url")), pages).alias("visit_exit_idaction_url"),
        F.when(first("ref_type") == "campaign", 6).when(first("ref_type") == "search", 2).when(first("ref_type") == "social", 7).when(first("ref_type") == "referral", 3).otherwise(1).alias("referer_type"),
        first("utm_campaign").alias("referer_name"), F.concat(F.lit("https://"), first("ref_domain"), F.lit("/x")).alias("referer_url"), F.coalesce(*[F.when(first("browser") == n, F.lit(c)) for n, c in codes.items()]).alias("config_browser_name"),
        F.lit("LIN").alias("config_os"), F.coalesce(*[F.when(first("device_type") == n, F.lit(c)) for n, c in (("desktop", 0), ("mobile", 10), ("tablet", 2))], F.lit(99)).alias("config_device_type"), F.lower(first("country")).alias("location_country"), F.lit(None).cast("string").alias("location_region"), F.lit(None).cast("string").alias("location_city"))
    own = stored.sparkSession.createDataFrame([(i, z, [d]) for i, d, z in SITES], "idsite long, timezone string, domains array<string>")
    return {"visits": visits, "links": links, "actions": actions, "sites": own}


def prior(stored: DataFrame) -> dict[str, DataFrame]:
    """Events and visits as the prior version would hold these stored events: paths with tracking parameters, campaign values as received, visits without an hour."""
    i, n = F.col("hit_id"), F.col("hit_id") % 6
    tail = F.when(n == 0, "gclid=a").when(n == 1, "utm_source=x&b=1").when(n == 2, "fbclid=&igsh=q").when(n == 4, "utm_content=z")
    path = F.when(tail.isNull(), F.col("path")).otherwise(F.concat("path", F.when(F.contains("path", F.lit("?")), "&").otherwise("?"), tail))
    old = {"id": i, "path": path, "utm_source": F.when(n == 3, " News   Letter").when(n == 4, "google"), "utm_medium": F.when(n == 3, "E-Mail"), "utm_campaign": F.lit(None).cast("string")}
    rows = stored.withColumns(old).select("id", "site_id", "visitor", "ts", "local_date", "local_hour", "type", "session_id", "seq", "path", "ref_domain", "ref_type", "utm_source", "utm_medium", "utm_campaign", "event_category", "event_action", "event_value", "country", "browser", "device_type", "engaged_step")
    first, page = lambda c: F.min_by(c, "seq").alias(c), F.when(F.col("type") == "pageview", F.col("seq"))
    visits = rows.groupBy("session_id").agg(
        F.min("id").alias("id"), *[first(c) for c in ("site_id", "visitor", "local_date", "ref_domain", "ref_type", "utm_source", "utm_medium", "utm_campaign", "country", "browser", "device_type")], F.min("ts").alias("started_at"), F.max("ts").alias("last_seen_at"),
        F.min_by("path", "seq").alias("entry_path"), F.max_by("path", page).alias("exit_path"), F.count_if(F.col("type") == "pageview").alias("pageviews"), F.count_if(F.col("type") == "event").alias("events"), F.sum("engaged_step").cast("long").alias("engaged_ms"))
    return {"events": rows.drop("engaged_step"), "visits": visits}
