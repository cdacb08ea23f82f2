"""A sample of the named queries against SQL on the smallest tables; all are run by compare.py."""

import pytest

from newsflow.plans import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["top_sources", "near_dup_keep_first", "batch_dedup", "event_clusters", "divergence_signal", "ema_bias", "threshold_grid", "source_stalls",
          "asof_change", "priority_scores", "classified_alerts", "stream_source_stalls"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, name):
    ok, message = compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, message


def test_entry_and_contract(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
