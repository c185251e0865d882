"""The published read contract: four tables whose names, columns, order and types hold from version to version, as views.

Readers query `sites`, `events`, `sessions` and `missing_hits` by SQL and needn't know how facts are stored. A view is a
projection of a store's table, so filters on site and day still prune partitions and only named columns are read. Joins
with `sites`, a row a site, broadcast it: a shuffle by site would put a site's hits in one task.

Defined cases: a column that this store doesn't hold is null, as the contract allows for all but the KEYS; a store without
a key is refused; a table without rows is an empty view of its columns; sites that were deleted stay, marked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.query import Unsupported
from . import facts

VERSION = 2
_TOUCH = "ref_domain string, ref_domain_raw string, ref_type string, utm_source string, utm_source_raw string, utm_medium string, utm_medium_raw string, utm_campaign string, utm_campaign_raw string"
#: Fixed names and types that readers rely on.
TABLES = {
    "sites": "id long, name string, domains string, timezone string, created_at long, deleted_at long",
    "events": "id long, site_id long, ts long, local_date string, local_hour int, type string, visitor_id string, session_id string, seq long, hostname string, path string, title string, target_url string, "
              f"{_TOUCH}, event_category string, event_action string, event_name string, event_value double, browser string, browser_version string, os string, device_type string, screen string, lang string, "
              "country string, region string, city string, lat double, lon double, scroll_pct int, props string",
    "sessions": "id string, site_id long, visitor_id string, started_at long, last_seen_at long, local_date string, local_hour int, entry_path string, exit_path string, pageviews long, events long, engaged_ms long, "
                f"{_TOUCH}, browser string, os string, device_type string, country string, region string, city string",
    "missing_hits": "id long, site_id long, ts long, local_date string, local_hour int, path string, ref_type string, ref_domain string, ref_path string, device_type string, country string",
}
#: Where a stored column's name differs from the published one: table, published name, stored name.
STORED = {"sites": {"id": "site_id"}, "events": {"id": "hit_id", "visitor_id": "visitor"}, "sessions": {"id": "session_id", "visitor_id": "visitor"}, "missing_hits": {"id": "hit_id"}}
KEYS = {"sites": ("id", "timezone"), "events": ("id", "site_id", "ts", "local_date", "type", "visitor_id", "session_id", "seq"), "sessions": ("id", "site_id", "visitor_id", "started_at", "local_date"), "missing_hits": ("id", "site_id", "ts", "local_date")}
FACTS = {"events": "events", "sessions": "visits", "missing_hits": "missing"}


def published(rows: DataFrame, table: str) -> DataFrame:
    """rows as the contract's table: its columns, in order and of their types."""
    schema, names, have = StructType.fromDDL(TABLES[table]), STORED[table], set(rows.columns)
    if table == "sites" and "domains" not in have and "domain" in have:
        rows, have = rows.withColumn("domains", F.array("domain")), have | {"domains"}
    if "domains" in have and dict(rows.dtypes)["domains"].startswith("array"):
        rows = rows.withColumn("domains", F.to_json("domains"))
    # `events` of a visit is a counter; of published names, one that is stored under another name isn't asked for
    stored = {f.name: names.get(f.name, f.name) for f in schema}
    if lacking := [k for k in KEYS[table] if stored[k] not in have]:
        raise Unsupported(f"{table} without {', '.join(lacking)}")
    return rows.select(*[(F.col(stored[f.name]) if stored[f.name] in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def open_views(store: facts.Store, sites: DataFrame, version: int = VERSION, prefix: str = "") -> None:
    """Temporary views of the four tables in the store's session, as of now; refused for readers of another version."""
    if version != VERSION:
        raise Unsupported(f"version {version} was asked for, this is {VERSION}")
    F.broadcast(published(sites, "sites")).createOrReplaceTempView(f"{prefix}sites")
    for table, stored in FACTS.items():
        rows = facts.read(store, stored)
        empty = store.spark.createDataFrame([], TABLES[table])
        bare = len(rows.columns) == len(facts.PARTITION)  # nothing was ever stored
        (empty if bare else published(rows, table)).createOrReplaceTempView(f"{prefix}{table}")


def versions() -> dict[str, str]:
    """Name and type of every published column, for a reader that wants to compare."""
    return {f"{t}.{f.name}": f.dataType.simpleString() for t, ddl in TABLES.items() for f in StructType.fromDDL(ddl)}


def breaks(older: dict[str, str]) -> list[str]:
    """Columns that an older reader relies on and this version lacks or types otherwise; new columns break nobody."""
    now = versions()
    return reduce(lambda out, c: out + ([c] if now.get(c) != older[c] else []), sorted(older), [])
