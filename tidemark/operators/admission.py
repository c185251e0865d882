"""What happens to a hit before it joins a visit: refusals, agents, visitor keys, properties, places."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .query import Unsupported

#: Rules that one predicate takes; they are compiled into it.
MOST_RULES = 256
KEYS_OF_SITE, VALUES_OF_KEY, PROPS_OF_EVENT, VALUE_LENGTH, BAG_BYTES = 30, 500, 10, 200, 1024
# Names and patterns of agents, the first that matches wins: name, pattern whose group is the version. Others may be passed.
CRAWLERS = (
    r"(?i)bot\b|bot[/;) ]|crawl|spider|slurp|preview|scrap|fetch|archiver|monitor|validator|lighthouse|headless|phantomjs|wget|\bcurl\b|httpclient|http-client|okhttp"
    r"|python|java/|go-http|libwww|\bruby\b|\bperl\b|\bnode\b|axios|feed|facebookexternalhit|whatsapp|mediapartners|ia_archiver|pingdom|uptime|scan|^\S{1,20}$"
)
_V = r"/([0-9.]+)"
BROWSERS = (
    ("Edge", r"Edg(?:e|A|iOS)?" + _V), ("Opera Mini", "Opera Mini" + _V), ("Opera", "(?:OPR|Opera)" + _V), ("Samsung Internet", "SamsungBrowser" + _V), ("Yandex", "YaBrowser" + _V), ("Vivaldi", "Vivaldi" + _V),
    ("UCBrowser", "UC ?Browser" + _V), ("DuckDuckGo", "(?:DuckDuckGo|Ddg)" + _V), ("Silk", "Silk" + _V), ("MIUI Browser", "MiuiBrowser" + _V), ("Huawei Browser", "HuaweiBrowser" + _V), ("Facebook", "FBAV" + _V), ("Instagram", "Instagram ([0-9.]+)"),
    ("GSA", "GSA" + _V), ("Firefox", "(?:Firefox|FxiOS)" + _V), ("Chrome", "CriOS" + _V), ("Chrome WebView", "; wv\\).*Chrome" + _V), ("Chrome", "Chrom(?:e|ium)" + _V), ("Android Browser", "Android.*Version" + _V),
    ("Mobile Safari", "Version" + _V + ".*Mobile.*Safari"), ("Safari", "Version" + _V + ".*Safari"), ("IE", "MSIE ([0-9.]+)"), ("IE", "Trident.*rv:([0-9.]+)"),
)
SYSTEMS = (("Windows Phone", "Windows Phone"), ("HarmonyOS", "HarmonyOS"), ("Tizen", "Tizen"), ("webOS", "(?i)webos|web0s"), ("KAIOS", "KAIOS"), ("Android", "Android"), ("iOS", "iPhone|iPad|iPod"), ("Xbox", "Xbox"), ("PlayStation", "PlayStation"), ("Nintendo", "Nintendo"),
           ("Windows", "Windows"), ("Mac OS", "Mac OS X|Macintosh"), ("Chromium OS", "CrOS"), ("Ubuntu", "Ubuntu"), ("Fedora", "Fedora"), ("Linux", "Linux|X11"))
DEVICES = (("other", r"(?i)smart-?tv|googletv|appletv|hbbtv|bravia|web0s|tizen.*tv|\btv\b|playstation|xbox|nintendo|\bwatch\b|oculus|\bquest\b"), ("tablet", r"iPad|Tablet|Kindle|Silk/|PlayBook|Android(?!.*Mobile)"), ("mobile", r"Mobi|iPhone|iPod|Android|Opera Mini|BlackBerry|KAIOS"))
Names = tuple[tuple[str, str], ...]


def address_hex(ip: Column) -> Column:
    """32 hexadecimal digits that sort like the address; IPv4, mapped or not, lies at ::ffff:0:0. Null for other texts."""
    ip = F.regexp_replace(ip, r"^(?i)::ffff:(\d+\.\d+\.\d+\.\d+)$", "$1")
    octets = F.transform(F.split(ip, r"\."), lambda p: F.lpad(F.lower(F.hex(p.cast("int"))), 2, "0"))
    four = F.concat(F.lit("0" * 20 + "ffff"), F.array_join(octets, ""))
    groups = lambda text: F.transform(F.filter(F.split(text, ":"), lambda g: g != ""), lambda g: F.lpad(F.lower(g), 4, "0"))
    head = groups(F.substring_index(ip, "::", 1))
    tail = F.when(F.contains(ip, F.lit("::")), groups(F.substring_index(ip, "::", -1))).otherwise(F.array().cast("array<string>"))
    six = F.array_join(F.concat(head, F.array_repeat(F.lit("0000"), F.greatest(F.lit(8) - F.size(head) - F.size(tail), F.lit(0))), tail), "")
    v4 = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(v4, four).when(ip.rlike("^[0-9A-Fa-f]{0,4}(:[0-9A-Fa-f]{0,4}){2,7}$") & (F.length(six) == 32), six)


def address_range(rule: str) -> tuple[str, str]:
    """First and last address of an address or prefix, as in address_hex()."""
    net = ipaddress.ip_network(rule, strict=False)
    base = 0xFFFF << 32 if net.version == 4 else 0
    return tuple(f"{base + int(a):032x}" for a in (net.network_address, net.broadcast_address))


def excluded(rules: list[tuple[int | None, str]], ip: str = "ip", site: str = "site_id") -> Column:
    """Whether a rule (site or None for all, address or prefix) covers the row's address."""
    if len(rules) > MOST_RULES:
        raise Unsupported(f"more than {MOST_RULES} exclusion rules")
    at = address_hex(F.col(ip))
    tests = [at.between(*address_range(r)) & (F.lit(True) if s is None else F.col(site) == s) for s, r in rules]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def crawler(agent: Column, patterns: str = CRAWLERS) -> Column:
    """An empty or unknown agent is no crawler; a name alone, without an engine's other words, is one."""
    return F.coalesce((agent != "") & agent.rlike(patterns), F.lit(False))


def agent_columns(agent: Column, browsers: Names = BROWSERS, systems: Names = SYSTEMS, devices: Names = DEVICES) -> dict[str, Column]:
    """Browser with its whole version, system, and device: desktop unless a pattern tells another."""
    first = lambda table, value, rest: reduce(lambda out, row: F.when(agent.rlike(row[1]), value(row)).otherwise(out), reversed(table), rest)
    none = F.lit(None).cast("string")
    return {"browser": first(browsers, lambda r: F.lit(r[0]), none), "browser_version": first(browsers, lambda r: F.regexp_extract(agent, r[1], 1), none),
            "os": first(systems, lambda r: F.lit(r[0]), none), "device_type": first(devices, lambda r: F.lit(r[0]), F.lit("desktop"))}


def refuse(hits: DataFrame, rules: list[tuple[int | None, str]]) -> DataFrame:
    """hits with `refused`: excluded (tested first), bot, or null for those that go on."""
    return hits.withColumn("refused", F.when(excluded(rules), "excluded").when(crawler(F.col("user_agent")), "bot"))


def visitor_ids(hits: DataFrame, salts: DataFrame) -> DataFrame:
    """Eight bytes of SHA-256 over the zone's newest salt up to the local day, the site, and a tracker id or address and agent.

    salts: timezone, local_date, salt. One row a zone and day, so each salt becomes a span of days and no hit meets two;
    hits before the first salt take that one (salts only go forward). Where hits have uid and uid_salt (of sites
    that opted in), these give the id, the same on every day.
    """
    days = Window.partitionBy("timezone").orderBy("local_date")
    begin = F.when(F.lag("local_date").over(days).isNull(), "").otherwise(F.col("local_date"))
    spans = salts.select(F.col("timezone").alias("__zone"), begin.alias("__from"), F.lead("local_date").over(days).alias("__to"), "salt")
    print_ = F.coalesce("tracker_id", F.concat(F.coalesce("ip", F.lit("")), F.lit("\n"), F.coalesce("user_agent", F.lit(""))))
    inside = (F.col("timezone") == F.col("__zone")) & (F.col("local_date") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("local_date") < F.col("__to")))
    salted = hits.join(spans, inside)
    key = F.concat(F.col("salt"), F.col("site_id").cast("string"), F.lit("\n"), print_)
    if {"uid", "uid_salt"} <= set(hits.columns):
        key = F.coalesce(F.concat("uid_salt", "uid"), key)
    return salted.withColumn("visitor_id", F.substring(F.sha2(key, 256), 1, 16)).drop("__zone", "__from", "__to", "salt")


def address_shaped(text: Column) -> Column:
    """Whether a text looks like an address: four groups of digits, or nothing but hexadecimal digits, dots and at least two colons."""
    return text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | (text.rlike(r"^[0-9A-Fa-f:.]+$") & text.rlike(":.*:"))


def _faults(bag: str) -> tuple[Column, Column, Column]:
    """(reasons of refused entries, entries that pass in key order, whether the bag is dropped whole)."""
    entries = F.filter(F.array_sort(F.map_entries(bag)), lambda e: e["value"].isNotNull())
    why = lambda e: F.when(~e["key"].rlike("^[a-z0-9_-]{1,32}$"), "bad_key").when(F.length(e["value"]) > VALUE_LENGTH, "oversize").when(address_shaped(e["value"]), "ip_shaped")
    good = F.filter(entries, lambda e: why(e).isNull())
    first = F.slice(good, 1, PROPS_OF_EVENT)
    heavy = F.octet_length(F.to_json(F.map_from_entries(first))) > BAG_BYTES
    reasons = F.concat(F.filter(F.transform(entries, why), lambda r: r.isNotNull()), F.when((F.size(good) > PROPS_OF_EVENT), F.array(F.lit("oversize"))).otherwise(F.array().cast("array<string>")),
                       F.when(F.coalesce(heavy, F.lit(False)), F.array(F.lit("oversize"))).otherwise(F.array().cast("array<string>")))
    return reasons, first, F.coalesce(heavy, F.lit(False))


def admitted_props(events: DataFrame, bag: str = "bag") -> DataFrame:
    """hit_id, site_id, ts, key, value of admitted properties: good keys, short values, no addresses, ten a hit in key order and
    BAG_BYTES of them as JSON, or the bag goes whole; none on pings."""
    _, first, heavy = _faults(bag)
    rows = events.filter("type != 'ping'").filter(~heavy).select("hit_id", "site_id", "ts", F.explode(first).alias("e"))
    return rows.select("hit_id", "site_id", "ts", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def prop_drops(events: DataFrame, bag: str = "bag") -> DataFrame:
    """site_id, local_date, reason, n: what was refused of bags, by reason (on_ping, bad_key, oversize, ip_shaped)."""
    reasons, _, _ = _faults(bag)
    given = F.when(F.col("type") == "ping", F.array(F.lit("on_ping"))).otherwise(reasons)
    rows = events.filter(F.col(bag).isNotNull()).select("site_id", "local_date", F.explode(given).alias("reason"))
    return rows.groupBy("site_id", "local_date", "reason").agg(F.count("*").alias("n"))


def first_values(props: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """site_id, key, value, ts of every value when first seen, in props and in what earlier batches knew: the `known` of the next batch."""
    seen = props.groupBy("site_id", "key", "value").agg(F.min("ts").alias("ts"))
    return seen if known is None else seen.unionByName(known.select("site_id", "key", "value", "ts")).groupBy("site_id", "key", "value").agg(F.min("ts").alias("ts"))


def limited_props(props: DataFrame, keys: int = KEYS_OF_SITE, values: int = VALUES_OF_KEY, known: DataFrame | None = None) -> DataFrame:
    """The first keys of a site stay; of a key's values the first stay, later ones read (other). First by time, then by name.

    known: first_values() of earlier batches, whose keys and values take their places too.
    """
    seen = first_values(props, known)
    of_site = seen.groupBy("site_id", "key").agg(F.min("ts").alias("ts"))
    kept = of_site.withColumn("k", F.row_number().over(Window.partitionBy("site_id").orderBy("ts", "key"))).filter(F.col("k") <= keys).select("site_id", "key")
    early = seen.withColumn("k", F.row_number().over(Window.partitionBy("site_id", "key").orderBy("ts", "value"))).filter(F.col("k") <= values)
    early = early.select("site_id", "key", "value", F.lit(True).alias("early"))
    named = props.join(kept, ["site_id", "key"]).join(early, ["site_id", "key", "value"], "left")
    return named.withColumn("value", F.when(F.col("early"), F.col("value")).otherwise("(other)")).drop("early")


def prop_registry(props: DataFrame) -> DataFrame:
    return props.groupBy("site_id", "key").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("events"), F.count_distinct("value").alias("distinct_values"), F.count_if(F.col("value") == "(other)").alias("over"))


def prop_bags(props: DataFrame) -> DataFrame:
    """hit_id, props: JSON with sorted keys and no spaces."""
    return props.groupBy("hit_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("props"))


def located(hits: DataFrame, blocks: DataFrame, ip: str = "ip") -> DataFrame:
    """hits with the columns of the address block they lie in (blocks: lo, hi as in address_hex(), and places).

    A range join in equal buckets: an IPv4 block enters every bucket of 65,536 addresses that it spans. Other blocks are
    prefixes: one enters the bucket of its shared leading digits, at most 16, and an address asks the bucket of each
    number of digits. So no nested loop runs over all blocks; of blocks that lie in each other the smallest wins.
    """
    four = lambda h: h.startswith("0" * 20 + "ffff")
    number = lambda h: F.conv(F.substring(h, 25, 4), 16, 10).cast("int")
    shared = F.filter(F.sequence(F.lit(0), F.lit(16)), lambda n: F.substring("lo", F.lit(1), n) == F.substring("hi", F.lit(1), n))
    prefix = F.substring("lo", F.lit(1), F.array_max(shared))
    spans = blocks.withColumn("__bucket", F.explode(F.when(four(F.col("lo")), F.transform(F.sequence(number(F.col("lo")), number(F.col("hi"))), lambda n: n.cast("string"))).otherwise(F.array(F.concat(F.lit("p"), prefix)))))
    rows = hits.withColumn("__at", address_hex(F.col(ip)))
    asked = F.when(four(F.col("__at")), F.array(number(F.col("__at")).cast("string"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda n: F.concat(F.lit("p"), F.substring("__at", F.lit(1), n))))
    at = rows.select("__at").distinct().filter("__at IS NOT NULL").withColumn("__bucket", F.explode(asked))
    found = at.join(spans, (at["__bucket"] == spans["__bucket"]) & at["__at"].between(F.col("lo"), F.col("hi")))
    places = [c for c in blocks.columns if c not in ("lo", "hi")]
    # the block that begins last, then ends first, is the innermost
    best = found.groupBy("__at").agg(F.max_by(F.struct(*places), F.struct("lo", F.translate("hi", "0123456789abcdef", "fedcba9876543210"))).alias("__place"))
    return rows.join(best, "__at", "left").select(*[F.col(f"`{c}`") for c in hits.columns if c not in places], *[F.col(f"__place.`{c}`").alias(c) for c in places])
