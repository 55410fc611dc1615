"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract  # noqa: E402
from compare import compare, connect  # noqa: E402

from barloom.plans.catalogue import load  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(load())
# Training has no SQL; the companions below run the same queries and have. The windows of the returns take minutes:
# test_learning runs them with few rounds.
BARE = {"train_direction", "train_return", "feature_importance_topk", "score_holdout", "training_log"}
SLOW = BARE | {"train_return_windows"}


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in SLOW])
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF, need_rows=False)
    assert ok, note


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(NAMES) - set(contract.oracle_sql()) <= BARE


def test_entry(spark):
    df = contract.entry(spark)
    assert "label" in df.columns and df.count() > 0
