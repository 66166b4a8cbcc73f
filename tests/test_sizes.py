"""What is shuffled and written grows with the rows, not with their text or
the number of buckets."""

import gzip
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logloom import session
from logloom.checks import registry as R
from logloom.checks.registry import REGISTRY
from logloom.plans import tables
from logloom.session import scratch_path
from logloom.plans import batch as B
from logloom.sources import archive as AR
from logloom.sources import fixtures as FX
from logloom.sources import table as TB
from logloom.streaming import ingest as IN

from .conftest import SF_SMALL


def _files(path, pattern):
    return [p for p in Path(path.removeprefix("file:")).rglob(pattern) if "_directory" not in p.parts]


@pytest.mark.parametrize("name", ["quarantine", "quarantine_reasons", "chain_state", "dedup_logs", "readable_size"])
def test_text_is_not_shuffled_for_the_header_join(spark, name):
    """A sort-merge join takes over the exchange of the tables' own columns."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plan = REGISTRY[name][0](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "SortMergeJoin" in plan
    # headed logs get the window's exchange and order
    assert re.search(r"Exchange hashpartitioning\(chain_id#\d+L, l_orderkey#\d+L", plan)
    assert not re.search(r"Exchange hashpartitioning\(chain_id#\d+L, block_number#", plan)
    if name not in ("quarantine", "quarantine_reasons"):  # these need no log index, so no window
        assert not re.search(r"Sort \[chain_id#\d+L ASC NULLS FIRST, block_number#\d+L ASC NULLS FIRST\]", plan)


def test_partitions_of_raw_logs_keep_their_size(spark, monkeypatch):
    """More rows are more partitions, so no task sorts more wide rows on a larger table."""
    want = FX.raw_logs(spark, SF_SMALL).count()
    monkeypatch.setattr(FX, "PART_ROWS", 300, raising=False)
    logs = tables.logs(spark, SF_SMALL)
    sizes = [r["count"] for r in FX.raw_logs(spark, SF_SMALL).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == want and len(sizes) > 16
    assert max(sizes) < 3 * 300
    assert logs.exceptAll(logs.dropDuplicates(["chain_id", "block_number", "log_index", "address", "topic0"])).count() == 0


def test_bloom_filter_is_sized_by_its_addresses(spark):
    """Many small buckets cost what their rows cost, and keep their filter."""
    import pyarrow.parquet as pq

    landed = tables.landed_logs(spark, SF_SMALL)
    path = TB.compact_logs(landed, scratch_path(spark, "t-bloom"), 100)
    files = _files(path, "*.parquet")
    assert len(files) > 40
    for f in files:
        assert f.stat().st_size < 20_000 + 1_000 * pq.ParquetFile(f).metadata.num_rows
    address = landed.first().address
    assert TB.read_logs(spark, path).where(F.col("address") == F.lit(bytes(address))).count() == \
        tables.logs(spark, SF_SMALL).where(F.col("address") == F.lit(bytes(address))).count() > 0


@pytest.mark.parametrize("bucket, cell, exchanges", [(1_000, None, 1), (7_500, None, 1), (7_500, 500, 2)])
def test_compaction_shuffles_its_rows_once_where_a_bucket_is_a_cell(spark, bucket, cell, exchanges):
    landed = spark.read.schema(TB.LANDED_WITH_SOURCE).parquet(
        TB.append_logs(tables.landed_logs(spark, SF_SMALL), scratch_path(spark, "t-once"), 1))
    cells = cell or TB.default_cell(bucket)
    rows = TB.layout(TB.served_rows(landed, bucket, cell), None, bucket == cells)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == exchanges
    path = TB.compact_logs(landed, scratch_path(spark, "t-once-served"), bucket, cell_blocks=cell)
    stored = TB.read_logs(spark, path)
    if cells == bucket:  # a file for each bucket
        assert len(_files(path, "*.parquet")) == stored.select("chain_id", "block_bucket").distinct().count()
    # ranks without gaps in every cell of a stream, whatever the exchange
    cell_of = F.expr("block_number div cell_blocks")
    for rank, stream in (("topic_rank", ["chain_id", "topic0"]), ("address_rank", ["chain_id", "topic0", "address"])):
        found = stored.groupBy(*stream, cell_of).agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("m"), F.countDistinct(rank).alias("d"))
        assert found.where("n <> m or n <> d").count() == 0
    kept = [c for c in TB.LOGS_LANDED.fieldNames() if c != "ingest_seq"]
    assert stored.count() == tables.logs(spark, SF_SMALL).count()
    assert stored.select(*kept).exceptAll(tables.logs(spark, SF_SMALL).select(*kept)).count() == 0


def test_raw_json_is_compressed_and_whole(spark):
    events = FX.raw_events(spark, SF_SMALL)
    path = IN.write_raw_files(events, scratch_path(spark, "t-gz"))
    files = _files(path, "part-*")
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert sum(len(gzip.open(f).read().splitlines()) for f in files) == events.count()
    text = sum(len(gzip.open(f).read()) for f in files)
    assert sum(f.stat().st_size for f in files) < text / 2
    back = IN.read_raw_logs(spark, path)
    same = lambda df: df.select(F.to_json(F.struct(*sorted(df.columns))).alias("j"))
    assert same(back).exceptAll(same(events)).count() == 0 and same(events).exceptAll(same(back)).count() == 0


def test_a_backlog_is_not_one_batch(spark, monkeypatch):
    src = IN.write_raw_files(FX.raw_events(spark, SF_SMALL), scratch_path(spark, "t-backlog"), 4)
    monkeypatch.setattr(IN, "FLUSH_BYTES", 1)
    landing = scratch_path(spark, "t-backlog-landing")
    IN.ingest_stream(spark, src, landing, scratch_path(spark, "t-backlog-ckpt")).awaitTermination()
    landed = TB.read_landed(spark, landing)
    assert landed.select("batch_id").distinct().count() == 4
    assert landed.count() == tables.landed_logs(spark, SF_SMALL).count()


def _exchanges(df):
    return [int(n) for n in re.findall(r"Exchange (?:hash|range)partitioning\(.*?, (\d+)\), REPARTITION_BY_NUM",
                                       df._jdf.queryExecution().executedPlan().toString())]


def test_exchanges_of_wide_rows_grow_with_the_rows(spark, monkeypatch):
    """Compaction, keep-last of landed rows and ranks have partitions by their rows, so no task sorts more on a larger table."""
    monkeypatch.setattr(session, "TASK_ROWS", 300)
    landed = spark.read.schema(TB.LANDED_WITH_SOURCE).parquet(
        TB.append_logs(tables.landed_logs(spark, SF_SMALL), scratch_path(spark, "t-grow"), 1))
    n, least = landed.count(), 16
    for width, cell in ((1_000, 1_000), (7_500, 500)):
        out = TB.served_rows(landed, width, cell, rows=n)
        assert _exchanges(out) == [session.partitions_for(spark, n)] and session.partitions_for(spark, n) > least
        assert out.count() == tables.logs(spark, SF_SMALL).count()
    kept = TB.dedup_landed(landed)
    assert _exchanges(kept) == [session.partitions_for(spark, n)]
    assert kept.count() == tables.logs(spark, SF_SMALL).count()
    ranked = B.rank_streams(landed, ["data"], 1_000, rows=n)
    assert _exchanges(ranked) == [session.partitions_for(spark, n)]
    assert ranked.exceptAll(B.rank_streams(landed, ["data"], 1_000)).count() == 0


def test_archive_segments_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 300)
    events = FX.raw_events(spark, SF_SMALL)
    n = events.count()
    root = AR.append_archive(events, scratch_path(spark, "t-grow-archive"), rows=n)
    found = AR.segments(spark, root)
    assert found.count() > 16 and found.agg(F.max("rows")).first()[0] < 3 * 300
    assert found.agg(F.sum("rows")).first()[0] == n


def test_registered_queries_tell_their_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 300)
    seen = []
    monkeypatch.setattr(TB, "served_rows", lambda *a, _f=TB.served_rows, **kw: seen.append(_exchanges(_f(*a, **kw))) or _f(*a, **kw))
    R.q_served_get_log(spark, SF_SMALL)
    assert max(seen[0]) >= FX.log_rows(spark, SF_SMALL) / 300 > 16


def test_deduped_stream_is_written_with_zstd(spark):
    files = R.q_stream_dedup(spark, SF_SMALL).inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)


@pytest.mark.parametrize("name", ["chain_state", "indexing_progress", "list_chains", "log_height", "get_log_batch"])
def test_queries_over_decoded_logs_have_partitions_by_their_rows(spark, monkeypatch, name):
    """The wide rows are sorted in partitions that keep their size, so they do not spill on a larger table."""
    monkeypatch.setattr(FX, "PART_ROWS", 300, raising=False)
    plan = REGISTRY[name][0](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    found = [int(n) for n in re.findall(r"Exchange hashpartitioning\(chain_id#\d+L, l_orderkey#\d+L, (\d+)\)", plan)]
    assert found and min(found) >= FX.log_rows(spark, SF_SMALL) / 300 > 16


@pytest.mark.parametrize("name", ["served_chain_stats", "served_get_log", "served_get_log_batch"])
def test_served_queries_shuffle_their_rows_once_in_partitions_by_their_rows(spark, monkeypatch, name):
    monkeypatch.setattr(session, "TASK_ROWS", 300, raising=False)
    seen = []

    def layout(df, partitions=None, clustered=False, _f=TB.layout):
        seen.append((clustered, max(_exchanges(df))))
        return _f(df, partitions, clustered)

    monkeypatch.setattr(TB, "layout", layout)
    REGISTRY[name][0](spark, SF_SMALL)
    assert len(seen) == 1 and seen[0][0] and seen[0][1] >= FX.log_rows(spark, SF_SMALL) / 300 > 16
