"""Plan shape: pruning and push-down reach the scan, no Python in hot paths."""

from logloom.checks import registry as R
from logloom.plans import query as Q
from logloom.plans import tables
from logloom.session import scratch_path
from logloom.sources import fixtures as FX
from logloom.sources import table as TB

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_served_table_prunes_and_pushes(spark):
    dst = TB.compact_logs(tables.landed_logs(spark, SF_SMALL), scratch_path(spark, "t-served"), 1000)
    served = TB.read_logs(spark, dst)
    page = Q.get_logs(served, 1, R.PAGE_TOPIC, from_block=1000, to_block=3000, limit=10, bucket_blocks=1000)
    p = _plan(page)
    assert "TakeOrderedAndProject" in p
    assert "PartitionFilters: [isnotnull(chain_id" in p and "block_bucket" in p and "isnotnull(bucket_blocks" in p
    assert "PushedFilters: [IsNotNull(topic0), EqualTo(topic0" in p or "EqualTo(topic0" in p
    assert page.count() == 10


def test_decode_has_no_python(spark):
    p = _plan(tables.logs(spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in p


def test_known_chain_is_broadcast(spark):
    from logloom.operators.filters import known_chain
    ok, _ = known_chain(FX.log_requests(spark, SF_SMALL), FX.chains(spark))
    assert "BroadcastHashJoin" in _plan(ok) or "BroadcastExchange" in _plan(ok)


def test_footprint_reads_footers_only(spark):
    dst = TB.compact_logs(tables.landed_logs(spark, SF_SMALL), scratch_path(spark, "t-served"), 1000)
    files = TB.storage_files(spark, dst)
    assert "ReadSchema: struct<path:string,length:bigint>" in _plan(files)
    fp = TB.storage_footprint(spark, dst).collect()
    assert sum(r.rows for r in fp) == tables.logs(spark, SF_SMALL).count()
    assert all(r.compressed_bytes > 0 for r in fp)


def test_chain_stats_from_footers(spark):
    from logloom.plans.stats import chain_stats
    dst = TB.compact_logs(tables.landed_logs(spark, SF_SMALL), scratch_path(spark, "t-served"), 1000)
    st = chain_stats(spark, dst, [1, 10])
    assert "PushedAggregation: [COUNT(*), MAX(block_number)]" in _plan(st)
    got = {r.chain_id: (r.total, r.maxIndexedBlock) for r in st.collect()}
    logs = tables.logs(spark, SF_SMALL)
    for c in (1, 10):
        sub = logs.where(f"chain_id = {c}")
        assert got[c] == (sub.count(), sub.agg({"block_number": "max"}).collect()[0][0])


def test_stats_report_footer_path_equals_scan(spark):
    from logloom.plans.stats import log_stats_report
    dst = TB.compact_logs(tables.landed_logs(spark, SF_SMALL), scratch_path(spark, "t-served"), 1000)
    tips, chains = FX.chain_tips(spark, SF_SMALL), FX.chains(spark)
    a = log_stats_report(spark, dst, tips, chains, from_footers=False).collect()
    b = log_stats_report(spark, dst, tips, chains, from_footers=True)
    assert "PushedAggregation: [COUNT(*), MAX(block_number)]" in _plan(b)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b.collect()))
    assert sorted(map(tuple, a)) == sorted(map(tuple, log_stats_report(spark, dst, tips, chains).collect()))
