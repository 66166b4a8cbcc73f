"""Every registered query: no cross products, no unpartitioned windows.

The only global window allowed is the export manifest's chunk numbering, which
runs over one row per written chunk file.
"""

import re

import pytest

from logloom import session
from logloom.checks.registry import REGISTRY

from .conftest import SF_SMALL

GLOBAL_WINDOW_OK = {"export_manifest", "export_chunks"}
# a window whose spec starts with an ordering key has no partition keys
UNPARTITIONED = re.compile(r"windowspecdefinition\([^,()]+? (ASC|DESC) NULLS")


@pytest.fixture
def executed(spark, monkeypatch):
    """Plans of everything a query writes, checkpoints or streams on its way."""
    from pyspark.sql import DataFrameWriter

    plans, frame = [], type(spark.range(0))
    note = lambda df: None if df.isStreaming else plans.append(
        df._jdf.queryExecution().executedPlan().toString())
    parquet, save, checkpoint = DataFrameWriter.parquet, DataFrameWriter.save, frame.checkpoint
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (note(self._df), parquet(self, *a, **b))[1])
    monkeypatch.setattr(DataFrameWriter, "save", lambda self, *a, **b: (note(self._df), save(self, *a, **b))[1])
    monkeypatch.setattr(frame, "checkpoint", lambda self, *a, **b: (note(self), checkpoint(self, *a, **b))[1])
    return plans


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_plan_has_no_cross_product_or_global_window(spark, name, executed):
    df = REGISTRY[name][0](spark, SF_SMALL)
    for plan in [df._jdf.queryExecution().executedPlan().toString(), *executed]:
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan
        if name not in GLOBAL_WINDOW_OK:
            assert not UNPARTITIONED.search(plan), plan


def test_plans_before_writes_are_seen(spark, executed):
    REGISTRY["compact_logs"][0](spark, SF_SMALL)
    assert any("Window" in p for p in executed)


def test_detector_sees_the_known_global_window(spark):
    from logloom.plans import export
    path = session.scratch_path(spark, "t-export")
    from logloom.plans import tables
    m = export.export_logs(tables.logs(spark, SF_SMALL), path, 1, "0x0")
    assert UNPARTITIONED.search(m._jdf.queryExecution().executedPlan().toString())
