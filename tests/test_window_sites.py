"""The sites that have hits reach the windows once each, not once a hit."""

from tidemark.plans.queries import QUERIES


def test_sites_are_distinct_before_they_are_joined(spark, sf):
    assert "Aggregate [site_id" in QUERIES["window_bounds"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
