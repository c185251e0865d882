"""First sightings of small flushes, by loops: late hits, dropped days, recounts, refusals of repeats."""

from tidemark.sinks import facts, presence

SCHEMA = "hit_id long, site_id long, visitor long, ts long, local_date string, local_hour int, visit_date string, type string, path string, session_id string, seq int, event_category string, event_action string, event_value double, engaged_step int, ref_type string, ref_domain string, utm_source string, utm_medium string, utm_campaign string, country string, browser string, device_type string"


def hit(n, visitor, day, path, type="pageview", site=1):
    date = f"2024-01-{day:02d}"
    return (n, site, visitor, n, date, 1, date, type, path, f"s{visitor}-{day}", n, None, None, None, 0, "direct", None, None, None, None, None, "b", "d")


def test_counts_of_flushes_and_of_days_counted_again(spark, tmp_path):
    flushes = [
        [hit(1, 1, 1, "/a"), hit(2, 2, 1, None), hit(3, 9, 1, "/a", "ping"), hit(4, 1, 1, "", site=2)],
        [hit(5, 1, 1, "/a"), hit(6, 3, 1, "/b"), hit(7, 1, 2, "/a")],
        [hit(8, 1, 5, "/a"), hit(9, 1, 1, "/a"), hit(10, 4, 1, None)],  # day 5 drops day 1, whose visitor 1 counts again
    ]
    store = facts.create(spark, str(tmp_path / "store"))
    for n, rows in enumerate(flushes):
        made = spark.createDataFrame(rows, SCHEMA)
        assert facts.flush(store, n, made, also=lambda landed, n=n: presence.land(store, n, landed, ("path",)))
        assert not facts.flush(store, n, made, also=lambda landed, n=n: presence.land(store, n, landed, ("path",)))

    def want(hits):
        seen = {}
        for _, site, visitor, _, date, _, _, type_, path, *_ in hits:
            for group in ((site, date, "total", None), (site, date, "path", path)):
                seen.setdefault(group, [0, set()])
                seen[group][0] += 1
                seen[group][1] |= {visitor} if type_ != "ping" else set()
        return {g: (n, len(v)) for g, (n, v) in seen.items()}

    got = lambda: {(r.site_id, r.local_date, r.dim, r.value): (r.hits, r.visitors) for r in presence.event_days(store).collect()}
    all_ = want([h for rows in flushes for h in rows])
    assert got() == all_ | {(1, "2024-01-01", "total", None): (7, 5), (1, "2024-01-01", "path", "/a"): (4, 2)}
    assert [tuple(r) for r in presence.stale(store).collect()] == [(1, "2024-01-01")]
    assert {(r.site_id, r.local_date) for r in facts.read(store, "seen").collect()} == {(1, "2024-01-01"), (1, "2024-01-02"), (1, "2024-01-05"), (2, "2024-01-01")}
    assert presence.recount(store, 3, presence.stale(store), ("path",)) and got() == all_
    assert not presence.recount(store, 4, presence.stale(store), ("path",))
