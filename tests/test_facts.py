"""Stored facts, batches and keyed streams: replays, failures, pruning, and micro-batches against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import batch as b
from tidemark.operators import query as q
from tidemark.operators import visits as v
from tidemark.operators.query import Unsupported
from tidemark.sinks import facts
from tidemark.sources import demo
from tidemark.streaming import state


@pytest.fixture(scope="module")
def ev(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ev") / "events")
    v.sessionize(v.enrich(demo.hits(spark, sf), demo.sites(spark))).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_flushes_show_together_and_once(spark, ev, tmp_path, monkeypatch):
    store = facts.create(spark, str(tmp_path / "store"))
    assert facts.flushes(store) == [-1] and facts.read(store, "visits").count() == 0
    cuts = [1_705_000_000_000, 1_706_000_000_000]
    parts = [ev.filter(F.col("ts") < cuts[0]), ev.filter(F.col("ts").between(cuts[0], cuts[1] - 1)), ev.filter(F.col("ts") >= cuts[1])]
    assert facts.flush(store, 0, parts[0])
    before = rows_of(facts.read(store, "visits"), "session_id", "pageviews", "engaged_ms", "exit_path")
    with monkeypatch.context() as m:  # a flush that dies before its commit shows nothing
        m.setattr(facts, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            facts.flush(store, 1, parts[1])
    assert rows_of(facts.read(store, "visits"), "session_id", "pageviews", "engaged_ms", "exit_path") == before and facts.read(store, "events").count() == parts[0].count()
    assert facts.flush(store, 1, parts[1]) and not facts.flush(store, 1, parts[1]) and facts.flush(store, 2, parts[2]) and facts.flush(store, 3, parts[0].limit(0))
    columns = [c for c in v.sessions(ev).columns if c != "engaged_ms"]
    assert rows_of(facts.read(store, "visits"), *columns) == rows_of(v.sessions(ev), *columns)
    assert rows_of(facts.hours(store), "site_id", "local_date", "local_hour", "hits", "pageviews") == rows_of(q.hour_traffic(ev), "site_id", "local_date", "local_hour", "hits", "pageviews")
    version = tuple(facts.data_version(store).first())
    assert version == (3, 0) and facts.compact(store, 4, least=2)
    assert tuple(facts.data_version(store).first()) == (4, 1 if facts.vacuum_list(store, "events").count() else 0)
    assert rows_of(facts.read(store, "visits"), *columns) == rows_of(v.sessions(ev), *columns) and facts.read(store, "events").count() == ev.count()
    day = ev.filter("site_id = 2").agg(F.max("local_date")).first()[0]
    days = spark.createDataFrame([(2, day)], "site_id long, local_date string")
    assert facts.replace_days(store, 5, "events", days, facts.read(store, "events").filter("type = 'ping'"))
    assert facts.read(store, "events").filter(f"(site_id = 2 AND local_date = '{day}') AND type <> 'ping'").count() == 0
    assert facts.read(store, "events").filter(f"NOT (site_id = 2 AND local_date = '{day}')").count() == ev.filter(f"NOT (site_id = 2 AND local_date = '{day}')").count()


def test_reads_prune_partitions_and_columns(spark, ev, tmp_path):
    store = facts.create(spark, str(tmp_path / "store"))
    facts.flush(store, 0, ev)
    rows = facts.read(store, "events").filter("site_id = 2 AND local_date = '2024-01-10'").groupBy("path").count()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site_id" in plan and "ReadSchema: struct<path:string>" in plan
    assert len(facts.read(store, "events").filter("site_id = 2 AND local_date = '2024-01-10'").inputFiles()) <= len(facts.read(store, "events").inputFiles())


def test_open_visits_are_the_newest(spark, ev, tmp_path):
    store = facts.create(spark, str(tmp_path / "store"))
    facts.flush(store, 0, ev)
    now = ev.agg(F.max("ts")).first()[0]
    open_ = {(r.site_id, r.visitor): (r.session_id, r.last_ts, r.seq) for r in facts.open_visits(store, now).collect()}
    last = {}
    for r in ev.orderBy("ts", "hit_id").collect():
        last[r.site_id, r.visitor] = (r.session_id, r.ts, r.seq)
    assert open_ == {k: x for k, x in last.items() if x[1] >= now - v.REVIVE_MS}


def test_thirty_two_queries_read_each_table_once(spark, ev, tmp_path):
    ev.write.parquet(str(tmp_path / "e"))
    e = spark.read.parquet(str(tmp_path / "e"))
    v.sessions(e).write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    eq = {"dim": "browser", "op": "eq", "value": "Chrome"}
    asked = {}
    for k, dims in enumerate([(), ("country",), ("site_id",), ("ref_type", "country"), ("weekday",), ("browser",), ("utm_source",), ("device_type",)]):
        asked[f"a{k}"] = b.Query(["visitors", "visits", "bounce_rate", "event_value_sum"], dims)
        asked[f"b{k}"] = b.Query(["pageviews", "avg_engagement"], dims, by="day", where=eq)
        asked[f"c{k}"] = b.Query(["events", "engaged_sessions"], dims, where={"not": eq}, limit=3)
        asked[f"d{k}"] = b.Query(["pageviews", "visits"], ("path",) if k % 2 else ("local_hour",), where=eq if k < 4 else None, limit=k + 1)
    out = b.batch(e, s, asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 * plan.count("FileScan") // 2 and plan.count(f"{tmp_path}/e]") <= 2
    found = out.collect()
    text = lambda x: None if x is None else str(x)
    number = lambda x: None if x is None else round(float(x), 6)
    for name, one in asked.items():
        single = q.metric(e, s, one.metrics, one.dims, one.by, one.where, one.limit).collect()
        want = sorted(([text(r["bucket"]) if one.by else None, *[text(r[d]) for d in one.dims], *[None] * (2 - len(one.dims)), *[number(r[m]) for m in one.metrics]] for r in single), key=str)
        got = sorted(([r["bucket"], r["value"], r["value2"], *[number(r[m]) for m in one.metrics]] for r in found if r["query"] == name), key=str)
        assert got == want, name
    for bad in (lambda: b.Query([]), lambda: b.Query(["visits"], ("a", "b", "c")), lambda: b.Query(["pageviews"], ("entry_path",)), lambda: b.Query(["bounce_rate"], ("path",)), lambda: b.batch(e, s, {}), lambda: b.batch(e, s, {str(k): b.Query(["visits"]) for k in range(33)})):
        with pytest.raises(Unsupported):
            bad()


def test_sentences(spark):
    totals = spark.createDataFrame([("a", 1400, 1200), ("b", 101, 100), ("c", 0, 50), ("d", 5, 0), ("e", 50, 100), ("f", 2_500_000, 1_000_000)], "site string, current long, previous long")
    moved = spark.createDataFrame([("a", "path", "/x", 212.0), ("a", "path", "/y", 190.0), ("a", "ref_domain", "news.test", 180.0), ("a", "country", "DE", -500.0), ("c", "path", None, -40.0), ("c", "country", None, -30.0),
                                   ("e", "path", "/only", -30.4), ("e", "path", "/next", -20.0), ("f", "ref_domain", "same", 10.0), ("f", "path", "same", 9.0)], "site string, dim string, value string, delta double")
    got = {r.site: r.summary for r in b.summaries(totals, moved, "site", "visits").collect()}
    assert got == {
        "a": "a: visits up 17% (1.2k → 1.4k) — /x (+212) and news.test (+180) drove it", "b": "b: steady (±1%)", "c": "c: visits down 100% (50 → 0) — unknown location (-30) drove the drop",
        "d": "d: visits up 100% (0 → 5)", "e": "e: visits down 50% (100 → 50) — /only (-30) and /next (-20) drove the drop", "f": "f: visits up 150% (1m → 2.5m) — same (+10) drove it"}


def micro_batches(spark, tmp_path, rows, schema, parts):
    for n, part in enumerate(parts):
        spark.createDataFrame([rows[k] for k in part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{n}")
    state.with_state_store(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")


def test_engaged_and_notices_over_micro_batches(spark, tmp_path):
    r = random.Random(4)
    rows, ts = [], 1_700_000_000_000
    for hit in range(90):
        ts += r.choice([1000, 9_000, 25_000, 400_000, 1_900_000])
        rows.append((hit, r.randint(1, 2), r.randint(1, 3), ts, r.choice(["pageview", "event", "ping"]), r.choice(["shop", "account"]), r.choice(["purchase", "signup"]), r.choice(["item1", None])))
    schema = "hit_id long, site_id long, visitor long, ts long, type string, event_category string, event_action string, event_name string"
    stream = micro_batches(spark, tmp_path, rows, schema, [range(0, 30), range(30, 60), range(60, 90)])
    got = state.run_rolling(state.engaged(stream), f"{tmp_path}/engaged", "update", lambda rows: state.newest_engaged(rows, 4), "site_id long, visitor long, engaged_ms long, last_ts long")
    seen = {}
    for _, site, visitor, ts, *_ in rows:
        ms, last = seen.get((site, visitor), (0, ts))
        seen[site, visitor] = (0 if ts - last > v.IDLE_MS else ms + min(ts - last, 20_000), ts)
    newest = max(x[1] for x in seen.values())
    want = sorted(((*k, *x) for k, x in seen.items() if x[1] >= newest - state.TALLY_MS), key=lambda x: (-x[3], x[0], x[1]))[:4]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    rules, cooldown = [{"site_id": 2, "event_action": "purchase"}, {"event_category": "shop"}, {"event_name": "item1"}], 3_000_000
    found = state.run_landing(state.notices(stream, rules, cooldown), f"{tmp_path}/notices", "rule_id int, hit_id long, ts long")
    fired, told = {}, []
    for hit, site, _, ts, kind, category, action, name in rows:
        own = {"site_id": site, "event_category": category, "event_action": action, "event_name": name}
        rule = next((n for n, x in enumerate(rules) if kind != "ping" and all(own[c] == y for c, y in x.items())), None)
        if rule is not None and (rule not in fired or ts - fired[rule] >= cooldown):
            fired[rule] = ts
            told.append((rule, hit, ts))
    assert sorted(map(tuple, found.collect())) == sorted(told) and len(told) > 5
    seeded = state.engaged(micro_batches(spark, tmp_path / "again", rows, schema, [range(0, 90)]), spark.createDataFrame([(1, 1, 7_000, rows[0][3] - 500)], "site_id long, visitor long, engaged_ms long, last_ts long"))
    assert state.run_rolling(seeded, f"{tmp_path}/seeded", "update", state.newest_engaged, "site_id long, visitor long, engaged_ms long, last_ts long").count() >= 4


@pytest.fixture(scope="module")
def rolled(spark, ev, tmp_path_factory):
    from tidemark.operators import rollups as r
    from tidemark.operators.requests import session_day_marginals

    path, visits = tmp_path_factory.mktemp("rolled"), v.sessions(ev)
    dims = (("path", "country", "ref_type", "event_action"), ("country", "ref_type", "entry_path"))
    made = {}
    for name, rows in (("hours", q.hour_traffic(ev)), ("days", r.event_days(ev, dims[0])), ("visits", session_day_marginals(visits, dims[1])), ("se", visits)):
        rows.coalesce(1).write.parquet(f"{path}/{name}")
        made[name] = spark.read.parquet(f"{path}/{name}")
    return r.Rollups(made["hours"], made["days"], made["visits"], *dims), made["se"]


def test_rollups_answer_as_raw_rows_do(ev, rolled):
    from tidemark.operators import rollups as r

    tables, visits = rolled
    additive, distinct, ratio = ["pageviews", "event_value_sum", "outlinks"], ["visitors", "pageviews"], ["bounce_rate", "visits", "avg_engagement"]
    de, not_de = {"dim": "country", "op": "eq", "value": "DE"}, {"not": {"dim": "country", "op": "eq", "value": "DE"}}
    site = {"dim": "site_id", "op": "eq", "value": 2}
    shapes = [b.Query(m, d, by, where) for m in (additive, distinct, ratio) for d, where in (((), None), (("site_id",), None), (("country",), None), (("site_id", "country"), None), (("path",), site), (("site_id",), de), (("site_id",), not_de), (("weekday",), None)) for by in (None, "day", "month") if not (m == ratio and d == ("path",))]
    shapes += [b.Query(additive, ("site_id",), "hour"), b.Query(additive, ("local_hour",)), b.Query(["visits"], ("entry_path",), limit=3), b.Query(["pageviews", "visits"], ("ref_type",), limit=2), b.Query(["visits", "visitors"], ("site_id", "path"), "day")]
    number = lambda x: round(x, 6) if isinstance(x, float) else x
    said = {"yes": 0, "no": 0}
    for one in shapes:
        if r.route(tables, one) is None:
            said["no"] += 1
            with pytest.raises(Unsupported):
                r.routed(tables, one)
            continue
        said["yes"] += 1
        keys = ["bucket"] * bool(one.by) + list(one.dims)
        rows = [sorted((tuple(number(x[c]) for c in (*keys, *one.metrics)) for x in df.collect()), key=str) for df in (r.routed(tables, one), q.metric(ev, visits, one.metrics, one.dims, one.by, one.where, one.limit))]
        assert rows[0] == rows[1], one
    assert said["yes"] >= 40 and said["no"] >= 10
    refused = [b.Query(["pageviews"], ("path", "country")), b.Query(["pageviews"], ("browser",)), b.Query(["visitors"], ("site_id",), "week"), b.Query(["visits"], (), "hour"), b.Query(["pageviews"], ("prop:plan",)), b.Query(["visitors"], ("site_id",), "hour"), b.Query(["visits"], ("path",))]
    assert [r.route(tables, one) for one in refused] == [None] * len(refused)
    old = r.Rollups(tables.hours, tables.days, tables.visits, tables.event_dims, tables.visit_dims, bounce_ms=1)
    assert r.route(old, b.Query(["visits"])) is None and r.route(old, b.Query(["pageviews"])) and r.route(tables, b.Query(["pageviews"]), rolling=True) is None


def test_drifted_days_are_rewritten(spark, ev, tmp_path):
    store = facts.create(spark, str(tmp_path / "store"))
    facts.flush(store, 0, ev)
    day = ev.filter("site_id = 1").agg(F.min("local_date")).first()[0]
    assert not facts.reconcile(store, 1, day)
    wrong = facts.hours(store).filter((F.col("local_date") == day) & (F.col("site_id") == 1)).withColumn("pageviews", F.col("pageviews") + 1)
    facts.replace_days(store, 1, "hours", wrong.select("site_id", "local_date").distinct(), wrong)
    assert facts.reconcile(store, 2, day) and not facts.reconcile(store, 3, day)
    assert rows_of(facts.hours(store), "site_id", "local_date", "local_hour", "pageviews") == rows_of(q.hour_traffic(ev), "site_id", "local_date", "local_hour", "pageviews")


def test_sites_of_an_import(spark):
    from tidemark.sources import warehouse

    source = spark.createDataFrame([(1, "UTC+10", ["a.test"]), (2, "UTC-3.5", ["b.test", "c.test"]), (3, "Europe/Berlin", ["d.test"])], "idsite long, timezone string, domains array<string>")
    local = spark.createDataFrame([(2, "UTC", ["c.test"]), (7, "UTC", ["x.test"])], "site_id long, timezone string, domains array<string>")
    found = lambda m=None: sorted(map(tuple, warehouse.site_targets(source, local, m).collect()))
    assert found() == [(1, 1, "Etc/GMT-10"), (2, 2, "UTC"), (3, 3, "Europe/Berlin")] and found({3: 7})[2] == (3, 7, "UTC")
    for bad, said in ((({1: 2}), "more than one"), ({9: 9}, "no site 9")):
        with pytest.raises(Unsupported, match=said):
            found(bad)
    with pytest.raises(Unsupported, match="shares no domain"):
        warehouse.site_targets(source, spark.createDataFrame([(1, "UTC", ["other.test"])], local.schema))
    with pytest.raises(Unsupported, match="unknown zone"):
        warehouse.site_targets(spark.createDataFrame([(4, "Nowhere", ["z.test"])], source.schema), local)


def test_an_increment_without_news_writes_nothing(spark, tmp_path, ev):
    from tidemark.sources import warehouse

    tables = {}
    for name, rows in demo.warehouse(ev).items():
        rows.write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    targets = warehouse.site_targets(tables["sites"], spark.createDataFrame([], "site_id long, timezone string, domains array<string>"))
    stores = []
    for cuts in ([None], [300, 600, None]):
        store = facts.create(spark, f"{tmp_path}/store{len(cuts)}")
        assert all(warehouse.increment(store, n, tables["visits"], tables["links"], tables["actions"], targets, cut) for n, cut in enumerate(cuts))
        assert not warehouse.increment(store, 9, tables["visits"], tables["links"], tables["actions"], targets) and 9 not in facts.flushes(store)
        stores.append(store)
    for table, columns in (("events", ("hit_id", "session_id", "seq", "path")), ("visits", ("session_id", "pageviews", "exit_path", "local_date"))):
        assert rows_of(facts.read(stores[0], table), *columns) == rows_of(facts.read(stores[1], table), *columns)
