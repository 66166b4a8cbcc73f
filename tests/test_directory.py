"""The directory of a served table, and batched plans that use it."""

import re

import pytest
from pyspark.sql import functions as F

from logloom.operators.aggregates import chain_state, log_height, log_stats
from logloom.operators.requests import check_requests
from logloom.plans import batch as B
from logloom.plans import query as Q
from logloom.plans import stats as S
from logloom.plans import tables
from logloom.session import materialize, scratch_path
from logloom.sources import directory
from logloom.sources import fixtures as FX
from logloom.sources import table as TB

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def landed(spark):
    return tables.landed_logs(spark, SF_SMALL).cache()


@pytest.fixture()
def merged(spark, landed):
    path = TB.compact_logs(landed.where("ingest_seq = 1"), scratch_path(spark, "t-dir"), 500, cell_blocks=100)
    TB.compact_incremental(spark, landed.where("ingest_seq = 2 and block_number < 900"), path, scratch_path(spark, "t-st"))
    TB.compact_incremental(spark, landed.where("ingest_seq = 2"), path, scratch_path(spark, "t-st"))
    return path


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect())


def check(spark, path):
    served, chains = TB.read_logs(spark, path), FX.chains(spark)
    cols = [*directory.PARTITIONS, "rows", "low", "high"]
    assert rows(directory.buckets(served, path).select(*cols)) == rows(directory.bucket_rows(served).select(*cols))
    cols = [*directory.PARTITIONS, "topic0", "skey", "cell", "cell_rows"]
    assert rows(directory.streams(served, path).select(*cols)) == rows(directory.stream_rows(served).select(*cols))
    assert rows(S.served_stats(spark, path, chains)) == rows(log_stats(served, chains=chains))
    assert rows(S.served_height(spark, path)) == rows(log_height(served))
    assert rows(S.served_state(spark, path)) == rows(chain_state(served))
    assert rows(Q.list_served_chains(spark, path)) == rows(Q.list_chains(served))


def test_directory_equals_a_full_scan_after_replays(spark, merged):
    check(spark, merged)
    assert TB.table_width(spark, merged) == (500, 100)
    # the figures read the latest generation: a row per stored bucket, no log
    stats = S.served_stats(spark, merged)
    assert _plan(stats).count("FileScan") == 1 and all("_directory/buckets/generation=2/" in f for f in stats.inputFiles())
    kept = [x for x in directory._Files(spark, merged).generations()]
    assert len(kept) == directory.KEPT_GENERATIONS
    # scans of the table do not see the directory
    assert "_directory" not in "".join(TB.read_logs(spark, merged).inputFiles())
    assert "_directory" not in "".join(r.path for r in TB.storage_files(spark, merged).collect())


def test_a_compaction_that_dies_leaves_no_stale_figures(spark, landed, monkeypatch):
    path = TB.compact_logs(landed.where("ingest_seq = 1 and block_number < 800"), scratch_path(spark, "t-dir"), 500)

    def die(*_):
        raise RuntimeError("lost between the rows and the directory")

    with monkeypatch.context() as m:
        m.setattr(directory, "record", die)
        with pytest.raises(RuntimeError, match="lost between"):
            TB.compact_incremental(spark, landed, path, scratch_path(spark, "t-st"))
    assert TB.read_logs(spark, path).count() == tables.logs(spark, SF_SMALL).count()
    check(spark, path)  # from the rows
    TB.compact_incremental(spark, landed, path, scratch_path(spark, "t-st"))
    assert not directory._Files(spark, path).exists("pending")
    check(spark, path)


def test_a_merge_does_not_shuffle_its_rows_twice(spark, merged):
    staged = TB.read_logs(spark, merged).sortWithinPartitions(*TB.SORT_KEY)
    assert "Exchange" not in _plan(staged)


def _scans(spark, df):
    """Partition filters and pushed filters of every scan of a stored table."""
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", length)
    return re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\], ReadSchema", text)


def test_request_predicates_reach_the_scan(spark, merged):
    ok = materialize(check_requests(FX.log_requests(spark, SF_SMALL), FX.chains(spark))[0].where("chain_id = 10 and address is not null"))
    served = TB.read_logs(spark, merged)
    for df in (B.served_streams(served, [], requests=ok), B.stored_counts(served, merged, ok)):
        scans = _scans(spark, df)
        assert scans
        for partitions, pushed in scans:
            assert "chain_id" in partitions and "= 10" in partitions and "block_bucket" in partitions
            assert "In(topic0" in pushed or "EqualTo(topic0" in pushed
    assert any("In(address" in pushed for _, pushed in _scans(spark, B.served_streams(served, [], requests=ok)))
    none = ok.limit(0)
    assert B.served_streams(served, [], requests=none).count() == 0 and B.stored_counts(served, merged, none).count() == 0


def test_many_values_and_partitions_fall_back_to_joins(spark, merged, monkeypatch):
    ok = check_requests(FX.log_requests(spark, SF_SMALL), FX.chains(spark))[0].cache()

    def pages():
        rows_at, plan = B.stored_plan(spark, merged, ok, first_page_only=True)
        out = B.get_logs_batch(rows_at, ok, plan=plan, payload_from=TB.read_logs(spark, merged), path=merged)
        return rows(out.select("request_id", "n", "block_number", "log_index", "data"))

    want = pages()
    raw = B.rank_streams(tables.logs(spark, SF_SMALL), ["data"], 100, requests=ok)
    assert want == rows(B.get_logs_batch(raw, ok, 100).select("request_id", "n", "block_number", "log_index", "data"))
    monkeypatch.setattr(B, "LISTED_VALUES", 1)
    monkeypatch.setattr(TB, "LISTED_PARTITIONS", 2)
    assert pages() == want
    touched = TB.in_partitions(TB.read_logs(spark, merged), TB.read_logs(spark, merged).where("block_number < 1300"))
    assert any("block_bucket" in partitions for partitions, _ in _scans(spark, touched))
    assert touched.count() == TB.read_logs(spark, merged).where("block_number < 1500").count()


def test_planning_reads_rows_of_cut_cells_only(spark, merged):
    """Whole-range requests cut no cell but their first: of the others only
    the directory's counts are read."""
    ok = check_requests(FX.log_requests(spark, SF_SMALL), FX.chains(spark))[0].withColumn("lo_block", F.lit(0).cast("bigint")) \
        .withColumn("lo_index", F.lit(-1).cast("bigint")).withColumn("hi_block", F.lit(None).cast("bigint")).cache()
    asked = []
    served = TB.read_logs(spark, merged)
    rows_at, cell = B.stored_streams(served, merged, ok)

    def spy(cells):
        asked.extend(r[0] for r in cells.select("block_bucket").distinct().collect())
        return rows_at(cells)

    plan = B.bucket_plan(spy, ok, cell, counts=B.stored_counts(served, merged, ok))
    totals = {r.request_id: r.total for r in plan.select("request_id", "total").distinct().collect()}
    assert set(asked) <= {0} and len(totals) > 50
    ranked = B.rank_streams(tables.logs(spark, SF_SMALL), [], 100, requests=ok)
    assert totals == {r.request_id: r.total for r in B.bucket_plan(ranked, ok, 100).select("request_id", "total").distinct().collect()}
