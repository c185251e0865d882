"""The whole way of a hit from the collector into the store, in the order in which hits are refused.

A hit is refused by the first that applies: its site is unknown, its address is excluded, its agent is a crawler's. A page
view of a missing page is then kept apart. What is left has its properties admitted, gets a visitor key and joins a visit;
a ping or milestone without a visit to continue is lost there. Only the first refusal of a hit is counted, and properties
are judged on hits that go on. Addresses, agents, tracker ids and raw bags don't leave this module.

Defined cases: hits need hit_id, `site`, ts, type, url, referrer, props, ip, user_agent, tracker_id and a map `bag`, and any
of these may be null: a null site is unknown, a null address lies nowhere, a null agent is a desktop without a name. Other
columns go along; country, region, city, browser, browser_version, os, device_type, lang, visitor and props of that name are
made anew. Empty tables give empty results. hit_id is unique; rows that repeat one are hits of their own, but share a bag.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import web
from . import admission, visits
from .diagnostics import drops

#: Columns that identify who sent a hit, or that are spent once it is admitted.
UNSTORED = ("ip", "user_agent", "tracker_id", "uid", "uid_salt", "accept_language", "bag", "refused", "zone_name", "site")


@dataclass(frozen=True)
class Taken:
    """Stored events and missing hits, and counts of what was lost: refused (site_id, local_date, refused, n), props
    (site_id, local_date, reason, n), unknown (ref, hits, last_seen). The tables are lazy and share their plan up to `refused`."""

    events: DataFrame
    missing: DataFrame
    refused: DataFrame
    props: DataFrame
    unknown: DataFrame


def take(hits: DataFrame, sites: DataFrame, salts: DataFrame, rules: list[tuple[int | None, str]] | None = None, blocks: DataFrame | None = None, aliases: DataFrame | None = None, known: DataFrame | None = None) -> Taken:
    """All hits of a batch, judged and made into events of visits.

    sites, salts, rules, blocks and aliases are as in visits, admission.visitor_ids, admission.excluded, admission.located
    (country, region, city) and visits.aliased; known are the property values of earlier batches, as in admission.limited_props. Hits are shuffled by visitor for their visits, and their properties by hit;
    places are looked up once an address.
    """
    named = visits.named_sites(hits, sites).withColumn("not_found", visits.missing_page(F.col("type"), F.col("props")))
    zones = sites.select("site_id", F.col("timezone").alias("zone_name"))
    tested = admission.refuse(visits.enrich(named, sites, aliases).join(F.broadcast(zones), "site_id"), rules or [])
    passed = tested.filter("refused IS NULL").withColumns({
        **admission.agent_columns(F.col("user_agent")),
        "lang": web.language(*[F.col(c) if c in hits.columns else F.lit(None).cast("string") for c in ("accept_language", "lang")]),
    })
    passed = admission.located(passed, blocks) if blocks is not None else passed.withColumns({c: F.lit(None).cast("string") for c in ("country", "region", "city")})
    traffic = passed.filter("NOT not_found")
    bags = admission.prop_bags(admission.limited_props(admission.admitted_props(traffic), known=known))
    keyed = admission.visitor_ids(traffic.drop("props", "visitor").withColumnRenamed("zone_name", "timezone"), salts).withColumnRenamed("visitor_id", "visitor")
    stored = visits.sessionize(keyed.drop(*UNSTORED, "timezone"), of=hits).join(bags, "hit_id", "left")
    return Taken(stored, visits.not_found(passed), drops(tested), admission.prop_drops(traffic), visits.unnamed(hits, sites))
