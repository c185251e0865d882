"""Visit rollups of days shuffle groups only."""

from tidemark.operators import visits as v
from tidemark.operators.requests import session_day_marginals

from .test_sizes import count, made


def test_visit_days_shuffle_groups_only(spark, sf, monkeypatch):
    events = made(spark, sf, monkeypatch, most=20)
    assert count(session_day_marginals(v.sessions(events), ("country", "entry_path")), "Exchange") == count(events, "Exchange") + 1
