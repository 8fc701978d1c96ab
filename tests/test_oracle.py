"""Registered queries against their SQL twins.

By default a cross-section runs; LEDGERLOOM_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as contract
from tests.oracle import compare, connect

SF = os.environ.get("LEDGERLOOM_SF", "/root/testdata/sf0.001")
SOME = [
    "parse_blocks", "trace_statuses", "extract_contracts", "enrich_logs", "block_bundles", "all_periods", "address_index", "pattern_features",
    "cycle_3_flows", "address_features", "edge_seq_same_time", "fraud_rings", "component_density", "position_encoding", "pr_auc", "rdt",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return connect(SF)


@pytest.mark.parametrize("name", list(contract.oracle_sql()) if os.environ.get("LEDGERLOOM_ALL") else SOME)
def test_query_matches_sql(spark, con, name):
    assert compare(contract.queries()[name](spark, SF), con, contract.oracle_sql()[name]) in (None, "EMPTY")


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
