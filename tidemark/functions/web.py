"""URL, referrer, campaign and time columns, in built-in functions.

A URL is taken apart in layers of columns (`with_url`), and everything else looks the parts up: the optimiser does not
copy a costly column into several readers, and drops those that nobody reads, so a query that never asks for a path
parses no URL. `fenced` is for sources that filter on what they parse: nothing is pushed or pruned through it.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::\d+)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

# Fixed names and values that results depend on: click ids in order of precedence, with the source and medium they name;
# spellings of campaign parameters in order of precedence; ids that only identify a recipient.
CLICK_IDS = (
    ("gclid", "google", "cpc"), ("gbraid", "google", "cpc"), ("wbraid", "google", "cpc"), ("dclid", "google", "cpc"),
    ("fbclid", "facebook", "social"), ("msclkid", "bing", "cpc"), ("twclid", "twitter", "social"), ("ttclid", "tiktok", "social"),
    ("li_fat_id", "linkedin", "social"), ("igshid", "instagram", "social"), ("igsh", "instagram", "social"),
)
CAMPAIGN = {
    "utm_source": ("utm_source", "mtm_source", "mtm_src", "pk_source", "pk_src"),
    "utm_medium": ("utm_medium", "mtm_medium", "mtm_med", "pk_medium", "pk_med"),
    "utm_campaign": ("utm_campaign", "mtm_campaign", "mtm_cpn", "pk_campaign", "pk_cpn", "matomo_campaign", "piwik_campaign"),
}
RECIPIENT_IDS = ("mc_eid", "mc_cid", "yclid", "_hsenc", "_hsmi", "mkt_tok", "oly_enc_id", "oly_anon_id", "vero_id", "s_kwcid")
KEYWORDS = ("matomo_kwd", "piwik_kwd")
#: Parameters that are tracking by name, and the families that are whole.
TRACKING = (*(n for n, _, _ in CLICK_IDS), *CAMPAIGN["utm_campaign"][-2:], *KEYWORDS, *RECIPIENT_IDS)
FAMILIES = ("utm_", "mtm_", "pk_")
URL_LENGTH, RECEIVED_LENGTH = 2048, 16_384
# Fixed hosts: brands that search on every suffix, channels by domain, hosts that stay apart, hosts that mean another domain.
SEARCH_BRANDS = ("google", "bing", "yahoo", "yandex")
SEARCH = (
    "duckduckgo.com", "baidu.com", "ecosia.org", "qwant.com", "brave.com", "startpage.com", "kagi.com", "ask.com", "aol.com", "naver.com", "seznam.cz",
    "chatgpt.com", "chat.openai.com", "claude.ai", "perplexity.ai", "copilot.microsoft.com", "gemini.google.com", "you.com", "phind.com",
)
SOCIAL = (
    "facebook.com", "fb.com", "twitter.com", "x.com", "t.co", "instagram.com", "threads.net", "linkedin.com", "lnkd.in", "reddit.com", "pinterest.com", "tiktok.com", "youtube.com", "youtu.be",
    "news.ycombinator.com", "mastodon.social", "bsky.app", "discord.com", "discord.gg", "t.me", "telegram.org", "whatsapp.com", "snapchat.com", "tumblr.com", "vk.com", "weibo.com",
)
KEPT_HOSTS = ("news.google.com", "scholar.google.com", "groups.google.com", "mail.google.com", "translate.google.com", "gemini.google.com", "news.ycombinator.com", "chat.openai.com", "copilot.microsoft.com")
HOST_ALIASES = {
    "t.co": "twitter.com", "fb.me": "facebook.com", "lnkd.in": "linkedin.com", "youtu.be": "youtube.com", "redd.it": "reddit.com", "t.me": "telegram.org", "wa.me": "whatsapp.com",
    "discord.gg": "discord.com", "flip.it": "flipboard.com", "goo.gl": "google.com", "g.co": "google.com", "com.slack": "slack.com", "com.google.android.gm": "gmail.com",
    "com.google.android.googlequicksearchbox": "google.com", "com.facebook.katana": "facebook.com", "com.facebook.orca": "facebook.com", "com.twitter.android": "twitter.com",
    "com.linkedin.android": "linkedin.com", "com.instagram.android": "instagram.com", "com.reddit.frontpage": "reddit.com", "com.microsoft.office.outlook": "outlook.com", "org.telegram.messenger": "telegram.org",
}
#: Public suffixes of two labels, which callers with the whole public list replace.
TWO_PART_SUFFIXES = (
    "co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "ac.jp", "com.br", "net.br", "org.br", "co.nz", "org.nz", "co.za", "co.in", "co.kr",
    "com.cn", "com.tw", "com.hk", "com.sg", "com.mx", "com.ar", "com.tr", "com.ua", "com.pl", "co.il", "co.id", "co.th", "com.my", "com.ph", "com.vn",
)


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, whoever reads them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def decoded(raw: Column) -> Column:
    plus = F.replace(raw, F.lit("+"), F.lit(" "))
    return F.when(F.contains(raw, F.lit("%")), F.coalesce(F.try_url_decode(raw), plus)).otherwise(plus)


def layered(df: DataFrame, **columns: Column) -> DataFrame:
    """df with one more layer of columns, each computed once a row if anybody reads it."""
    return df.withColumns(columns)


def with_url(df: DataFrame, url: str = "url") -> DataFrame:
    """df with u_known, u_host, u_path, u_parts, u_names, u_values: the parameters as they stand, their names and values decoded."""
    split = layered(df, u_known=F.coalesce(F.col(url).rlike(URL), F.lit(False)), u_host=url_host(F.col(url)), u_path=F.regexp_extract(url, URL, 3),
                    u_parts=F.filter(F.split(F.regexp_extract(url, URL, 4), "&"), lambda p: p != ""))
    # "name" of a parameter without "=" is all of it, and its value is blank
    return layered(split, u_names=F.transform("u_parts", lambda p: decoded(F.substring_index(p, "=", 1))),
                   u_values=F.transform("u_parts", lambda p: F.when(F.contains(p, F.lit("=")), decoded(F.substr(p, F.instr(p, "=") + 1)))))


U_COLUMNS = ("u_known", "u_host", "u_path", "u_parts", "u_names", "u_values")


def tracks(name: Column) -> Column:
    """Whether a parameter says where a visitor came from rather than which page it is; names are told by case."""
    return F.coalesce(name.isin(*TRACKING) | name.rlike(f"^({'|'.join(FAMILIES)})"), F.lit(False))


def bare_host(host: Column) -> Column:
    """Lower-case host without www. and the dot of the root; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(host), r"^www\.|\.$", ""), F.lit(""))


def url_host(url: Column) -> Column:
    """Host of a URL, bare; null if the text is no URL."""
    return bare_host(F.regexp_extract(url, URL, 2))


def page_path(url: str = "url") -> Column:
    """Path and query of a row of with_url() without tracking parameters, order kept; a text that is no URL stays whole."""
    kept = F.filter("u_parts", lambda p, k: ~tracks(F.get("u_names", k)))
    path = F.coalesce(F.nullif(F.col("u_path"), F.lit("")), F.lit("/"))
    return F.when(~F.col("u_known"), F.col(url)).when(F.size("u_parts") == 0, path).otherwise(F.concat(path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def param(name: str) -> Column:
    """Value of the first parameter of that name of a row of with_url(), at most 200 characters; blank is null."""
    at = F.array_position("u_names", name)
    return F.nullif(F.substring(F.when(at > 0, F.get("u_values", at.cast("int") - 1)), 1, 200), F.lit(""))


def campaign(field: str) -> Column:
    """First spelling with a value, as received."""
    return F.when(F.size("u_names") > 0, F.coalesce(*[param(n) for n in CAMPAIGN[field]]))


def normalized(value: Column) -> Column:
    """Trimmed, blanks single, lower case; blank is null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))), F.lit(""))


def click_source(which: int) -> Column:
    """Source (which=1) or medium (which=2) that the first click id on the URL implies."""
    return F.when(F.size("u_names") > 0, F.coalesce(*[F.when(param(c[0]).isNotNull(), F.lit(c[which])) for c in CLICK_IDS]))


def mapped(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def canonical_domain(host: Column, suffixes: tuple[str, ...] = TWO_PART_SUFFIXES) -> Column:
    """The domain that a bare host counts as: kept hosts, aliases, else the registrable domain, and its alias; addresses stay whole."""
    labels = F.split(host, r"\.")
    parts = F.when(F.substring_index(host, ".", -2).isin(*suffixes), 3).otherwise(2)
    registrable = F.array_join(F.slice(labels, F.greatest(F.size(labels) - parts + 1, F.lit(1)), parts), ".")
    address = host.rlike(r"^\d+(\.\d+){3}$|:|^\[")
    whole = F.coalesce(mapped(HOST_ALIASES, host), F.when(host.isin(*KEPT_HOSTS) | address, host).otherwise(F.coalesce(mapped(HOST_ALIASES, registrable), registrable)))
    return F.when(host.isNotNull(), whole)


def referrer_domain(referrer: Column, suffixes: tuple[str, ...] = TWO_PART_SUFFIXES) -> Column:
    return canonical_domain(url_host(referrer), suffixes)


def referrer_type(domain: Column, own: Column, suffixes: tuple[str, ...] = TWO_PART_SUFFIXES) -> Column:
    """Channel of a canonical domain; a host's parents count for it, so a kept host has its parent's channel."""
    labels = F.split(domain, r"\.")
    walk = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    parts = F.when(F.substring_index(domain, ".", -2).isin(*suffixes), 3).otherwise(2)
    brand = F.when(F.size(labels) >= parts, F.get(labels, F.size(labels) - parts))
    known = lambda table: F.arrays_overlap(walk, F.array(*map(F.lit, table)))
    return F.when(domain.isNull(), "direct").when(own, "internal").when(known(SEARCH), "search").when(known(SOCIAL), "social").when(brand.isin(*SEARCH_BRANDS), "search").otherwise("referral")


def zone(name: Column) -> Column:
    """A zone that local times can be made in: an offset like +0545, a name of the zone database, or UTC for anything else. For dimension tables."""
    offset = r"^[+-](0\d|1[0-4])[0-5]\d$"
    return F.when(name.rlike(offset), F.concat(F.substring(name, 1, 3), F.lit(":"), F.substring(name, 4, 2))).when(name.isin(*sorted(available_timezones())), name).otherwise("UTC")


def local_time(ts_ms: Column, zone_name: Column) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ts_ms), zone_name)


def language(accept: Column, tracker: Column) -> Column:
    """First tag of the Accept-Language header, else the tracker's, at most 35 characters."""
    first = F.nullif(F.trim(F.substring_index(F.substring_index(accept, ",", 1), ";", 1)), F.lit(""))
    return F.substring(F.coalesce(first, F.nullif(F.trim(tracker), F.lit(""))), 1, 35)


def bounded(url: Column, longest: int = URL_LENGTH) -> Column:
    """The URL, without its fragment, cut at a parameter's edge to at most `longest` characters; tracking parameters are kept first."""
    whole = F.substring_index(url, "#", 1)
    base = F.substring_index(whole, "?", 1)
    parts = F.filter(F.split(F.substr(whole, F.length(base) + 2), "&"), lambda p: p != "")
    mark = lambda p: tracks(decoded(F.substring_index(p, "=", 1)))
    add = lambda text, p: F.when(F.length(text) + F.length(p) + 1 <= longest, F.concat(text, F.when(text == base, "?").otherwise("&"), p)).otherwise(text)
    cut = F.aggregate(F.concat(F.filter(parts, mark), F.filter(parts, lambda p: ~mark(p))), base, add)
    return F.when(F.length(whole) <= longest, whole).when(F.length(base) >= longest, F.substring(whole, 1, longest)).otherwise(cut)


def fold(text: Column) -> Column:
    """ASCII lower case only, as LIKE folds."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
