"""Tasks of large tables stay small: one sort of a visitor's hits, a bounded number of rows a task, no shuffle by site."""

import re

from tidemark.operators import visits as v
from tidemark.sources import demo


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, node):
    return len(re.findall(rf"[+:]- (?:\*\(\d+\) )?{node}", plan_of(df)))


def made(spark, sf, monkeypatch, most=None):
    if most:
        monkeypatch.setattr(v.dealt, "__kwdefaults__", {**v.dealt.__kwdefaults__, "most": most})
    hits = demo.hits(spark, sf)
    return v.sessionize(v.enrich(hits, demo.sites(spark)), of=hits)


def test_hits_are_sorted_once_in_tasks_of_bounded_size(spark, sf, monkeypatch):
    small, large = made(spark, sf, monkeypatch), made(spark, sf, monkeypatch, most=20)
    assert count(small, r"Sort \[[^\n]*\bts#") == 1 and count(large, r"Sort \[[^\n]*\bts#") == 1
    n = demo.hits(spark, sf).count()
    assert f", {-(-n // 20)}), REPARTITION_BY_NUM" in plan_of(large) and "REPARTITION_BY_NUM" not in plan_of(small)
    columns = sorted(small.columns)
    assert sorted(map(str, small.select(columns).collect())) == sorted(map(str, large.select(columns).collect()))


def test_hits_are_not_shuffled_by_site(spark, sf, monkeypatch):
    events = made(spark, sf, monkeypatch)
    hits_side = plan_of(events).split("Exchange hashpartitioning(site_id")  # what lies below the shuffle by visitor
    assert len(hits_side) > 1 and "visitor" in hits_side[1].split(")")[0] and "SortMergeJoin [site_id" not in hits_side[0] + hits_side[1].split("BroadcastExchange")[0]


def test_visits_are_counted_without_a_shuffle(spark, sf, monkeypatch):
    events = made(spark, sf, monkeypatch, most=20)
    assert count(v.sessions(events), "Exchange") == count(events, "Exchange")
