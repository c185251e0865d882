"""The read contract and the operator's report on written rows."""

import pytest

from tidemark.operators import diagnostics as d
from tidemark.operators.query import Unsupported
from tidemark.sinks import contract, facts


def test_views_hold_their_columns_with_and_without_rows(spark, tmp_path):
    sites = spark.createDataFrame([(1, ["a.test", "b.test"], "UTC", 5)], "site_id long, domains array<string>, timezone string, deleted_at long")
    contract.open_views(facts.create(spark, str(tmp_path / "store")), sites, prefix="empty_")
    for table, ddl in contract.TABLES.items():
        assert [f"{c} {'long' if t == 'bigint' else t}" for c, t in spark.table(f"empty_{table}").dtypes] == ddl.split(", ")
    assert tuple(spark.table("empty_sites").first()) == (1, None, '["a.test","b.test"]', "UTC", None, 5) and spark.table("empty_events").count() == 0
    with pytest.raises(Unsupported):
        contract.open_views(facts.create(spark, str(tmp_path / "other")), sites, version=1)
    visits = spark.createDataFrame([("s", 1, 7, 3, "2024-01-01", 4)], "session_id string, site_id long, visitor long, started_at long, local_date string, events long")
    assert contract.published(visits, "sessions").select("id", "visitor_id", "events", "exit_path").first() == ("s", "7", 4, None)
    with pytest.raises(Unsupported):
        contract.published(visits.drop("visitor"), "sessions")


def test_joins_with_sites_do_not_shuffle_by_site(spark, tmp_path):
    sites = spark.createDataFrame([(1, "a.test", "UTC")], "site_id long, domain string, timezone string")
    contract.open_views(facts.create(spark, str(tmp_path / "store")), sites, prefix="joined_")
    spark.createDataFrame([(1,), (1,), (2,)], "site_id long").createOrReplaceTempView("joined_hits")
    rows = spark.sql("SELECT s.domains, h.site_id FROM joined_hits h JOIN joined_sites s ON s.id = h.site_id WHERE h.site_id = 1")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert [tuple(r) for r in rows.collect()] == [('["a.test"]', 1)] * 2


def test_new_columns_break_nobody():
    now = contract.versions()
    assert contract.breaks(now) == [] and contract.breaks({"events.id": "bigint"}) == []
    assert contract.breaks({"events.gone": "string", "events.seq": "int"}) == ["events.gone", "events.seq"]


def test_losses_are_told_apart(spark):
    day = "site_id long, local_date string, {} string, n long"
    refused = spark.createDataFrame([(1, "2024-01-10", "bot", 3), (1, "2024-01-04", "bot", 2), (1, "2024-01-03", "bot", 9), (2, "2024-01-11", "bot", 9), (2, "2024-01-10", "excluded", 0), (None, None, "bot", 1)], day.format("refused"))
    unknown = spark.createDataFrame([(f"r{n:02d}", 2, 100 + n // 2) for n in range(30)], "ref string, hits long, last_seen long")
    rows = d.report({"events": refused}, refused, spark.createDataFrame([], day.format("reason")), unknown, "2024-01-10").collect()
    assert [tuple(r)[:5] for r in rows if r.section in ("rows", "refused")] == [("rows", None, None, "events", 6), ("refused", 1, "2024-01-10", "bot", 3), ("refused", 1, "2024-01-04", "bot", 2)]
    assert [(r.n, r.last_seen) for r in rows if r.section == "unknown"] == [(60, 114)]
    shown = [r.what for r in rows if r.section == "unknown references"]
    assert len(shown) == 20 and set(shown) == {f"r{n:02d}" for n in range(10, 30)}
    none = d.report({}, refused.limit(0), spark.createDataFrame([], day.format("reason")), unknown.limit(0), "2024-01-10").collect()
    assert [tuple(r) for r in none] == [("unknown", None, None, "all", 0, None)]
    named = spark.createDataFrame([(1, None, 5), (2, "x", 6), (3, "1", 7)], "hit_id long, site string, ts long")
    assert {tuple(r) for r in d.unknown_references(named, named.filter("hit_id = 3")).collect()} == {("", 1, 5), ("x", 1, 6)}
