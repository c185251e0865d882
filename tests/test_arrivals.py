"""The streams of registered queries: a table is one micro-batch, however many files it has and in whatever order they lie."""

import os

from tidemark.plans import states
from tidemark.streaming import state


def test_a_table_of_many_files_is_one_micro_batch(spark, tmp_path):
    state.with_state_store(spark)
    at = lambda hit: 1_700_000_000_000 + hit * 1000
    rows = [(hit, 2, 1, at(hit), "event", "shop", "purchase", None) for hit in range(40)]
    table = spark.createDataFrame(rows, "hit_id long, site_id long, visitor long, ts long, type string, event_category string, event_action string, event_name string")
    scattered = lambda part: table.filter(part).repartition(4, "hit_id")
    stream, later = states._stream([scattered("hit_id < 20"), scattered("hit_id >= 20")], spark)
    schema = "rule_id int, hit_id long, ts long"
    found = state.run_landing(state.notices(stream, [{"site_id": 2}], 5_000), f"{tmp_path}/out", schema, later)
    assert sorted(map(tuple, found.collect())) == [(0, hit, at(hit)) for hit in range(0, 40, 5)]
    assert sorted(os.listdir(f"{tmp_path}/out/table")) == ["batch=-1", "batch=0", "batch=1"]
