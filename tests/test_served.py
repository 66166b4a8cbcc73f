"""The served table: its own width, losses that must not happen, pruning, ties."""

import re

import pytest
from pyspark.sql import functions as F

from logloom.checks import registry as R
from logloom.functions.formatting import hex_projection
from logloom.operators.dedup import dedup_logs
from logloom.operators.requests import check_requests, request_fault
from logloom.plans import batch as B
from logloom.plans import query as Q
from logloom.plans import tables
from logloom.session import checkpoint_root, scratch_path
from logloom.sources import fixtures as FX
from logloom.sources import table as TB
from logloom.streaming import finality as FN
from logloom.streaming import ingest as IN

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _filters(df):
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", _plan(df))


@pytest.fixture(scope="module")
def landed(spark):
    return tables.landed_logs(spark, SF_SMALL).persist()


@pytest.mark.parametrize("width", [300, 10_000])
def test_any_width_is_read_back_whole(spark, landed, width):
    served = TB.read_logs(spark, TB.compact_logs(landed, scratch_path(spark, "t-w"), width))
    logs = tables.logs(spark, SF_SMALL)
    want = Q.select_logs(logs, 1, R.PAGE_TOPIC, from_block=700, to_block=4200).count()
    assert Q.select_logs(served, 1, R.PAGE_TOPIC, from_block=700, to_block=4200).count() == want
    pos = FX.log_positions(spark, SF_SMALL)
    assert B.get_log_batch(served, pos).where("found").count() == B.get_log_batch(logs, pos).where("found").count()
    some = logs.where("chain_id = 10").first()
    assert Q.get_log(served, 10, some.block_number, some.log_index).count() == 1
    with pytest.raises(ValueError, match="buckets"):
        Q.select_logs(served, 1, R.PAGE_TOPIC, bucket_blocks=width + 1)


def test_rank_cells_are_narrower_than_buckets(spark, landed):
    with pytest.raises(ValueError, match="whole cells"):
        TB.compact_logs(landed, scratch_path(spark, "t-cell"), 1000, cell_blocks=300)
    path = TB.compact_logs(landed.where("ingest_seq = 1"), scratch_path(spark, "t-cell"), 6000, cell_blocks=500)
    assert TB.table_width(spark, path) == (6000, 500)
    TB.compact_incremental(spark, landed.where("ingest_seq = 2"), path, scratch_path(spark, "t-cell-st"))
    served = TB.read_logs(spark, path)
    per_cell = served.groupBy("chain_id", "topic0", F.expr("block_number div 500").alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.max("topic_rank").alias("top"), F.countDistinct("topic_rank").alias("d"))
    assert per_cell.where("n <> top or n <> d").count() == 0
    ranked = B.served_streams(served, [])
    assert B.stream_width(ranked) == 500
    with pytest.raises(ValueError, match="500"):
        B.stream_width(ranked, 6000)


def test_lookups_and_merges_prune_without_caller_filters(spark, landed):
    path = TB.compact_logs(landed.where("ingest_seq = 1"), scratch_path(spark, "t-prune"), 500)
    served = TB.read_logs(spark, path)
    pos = spark.createDataFrame([(1, 1, 300, 0), (2, 10, 1000, 1)], "request_id bigint, chain_id bigint, block_number bigint, log_index bigint")
    assert any("block_bucket" in f and "chain_id" in f for f in _filters(B.get_log_batch(served, pos)))
    assert "block_bucket" in str(_filters(TB.in_partitions(served, served.where("block_number = 300"))))
    with pytest.raises(ValueError, match="500"):
        TB.compact_incremental(spark, landed, path, scratch_path(spark, "t-st"), 400)
    TB.compact_incremental(spark, landed.where("ingest_seq = 2"), path, scratch_path(spark, "t-st"))
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    got, want = TB.read_logs(spark, path).count(), tables.logs(spark, SF_SMALL).count()
    assert got == want


def test_served_files_stay_in_key_order_after_a_merge(spark, landed):
    """Several staging files per bucket; every served file is sorted."""
    import pyarrow.parquet as pq
    path = TB.compact_logs(landed.where("ingest_seq = 1"), scratch_path(spark, "t-order"), 3000, partitions=7)
    TB.compact_incremental(spark, landed.where("ingest_seq = 2"), path, scratch_path(spark, "t-st2"), partitions=7)
    files = [r[0] for r in TB.storage_files(spark, path).select("path").collect()]
    for f in files:
        t = pq.read_table(f.removeprefix("file:"), columns=["topic0", "block_number", "log_index", "address"], partitioning=None)
        rows = list(zip(*[c.to_pylist() for c in t.columns]))
        assert rows == sorted(rows)


def test_footer_sums_match_an_independent_reading(spark, landed):
    import pyarrow.parquet as pq
    path = TB.compact_logs(landed, scratch_path(spark, "t-foot"), 2000)
    want = 0
    for r in TB.storage_files(spark, path).collect():
        md = pq.ParquetFile(r.path.removeprefix("file:")).metadata
        want += sum(md.row_group(g).column(c).total_compressed_size for g in range(md.num_row_groups)
                    for c in range(md.row_group(g).num_columns))
    assert TB.storage_footprint(spark, path, per_chain=False).first().compressed_bytes == want


def test_two_sources_with_one_batch_number_both_stay(spark, landed):
    root = scratch_path(spark, "t-two")
    TB.append_logs(landed.where("chain_id = 1"), root, 0, source="one")
    TB.append_logs(landed.where("chain_id = 10"), root, 0, source="two/b")
    got = TB.read_landed(spark, root, with_source=True).select("chain_id", "source").distinct().collect()
    assert sorted((r.chain_id, r.source) for r in got) == [(1, "one"), (10, "two/b")]
    assert IN.stream_source("/a/ckpt") == IN.stream_source("/a/ckpt/") != IN.stream_source("/b/ckpt")


def test_changed_replay_without_a_sequence_keeps_the_newest(spark):
    ev = FX.raw_events(spark, SF_SMALL).where("ingest_seq = 1").withColumn("ingest_seq", F.lit(None).cast("bigint"))
    changed = ev.withColumn("log", F.col("log").withField("data", F.concat("log.data", F.lit("ee"))))
    root = scratch_path(spark, "t-seq")
    IN.ingest_batch(spark, ev, root, 0, source="a")
    IN.ingest_batch(spark, changed, root, 0, source="b")
    kept = dedup_logs(TB.read_landed(spark, root).drop("batch_id"))
    assert kept.count() > 0 and kept.where("lower(hex(data)) not like '%ee'").count() == 0


def test_ties_of_a_position_rank_by_address(spark, landed):
    one = landed.where("chain_id = 1 and ingest_seq = 1").limit(1)
    two = one.withColumn("address", F.unhex(F.lit("ff" * 20)))
    served = TB.read_logs(spark, TB.compact_logs(one.unionByName(two), scratch_path(spark, "t-tie"), 100))
    ranks = {bytes(r.address): r.topic_rank for r in served.collect()}
    assert ranks[b"\xff" * 20] == 2
    raw = B.rank_streams(dedup_logs(one.unionByName(two)), [], 100, address_streams=False)
    assert {bytes(r.address): r.local_rank for r in raw.collect()} == ranks


def test_many_requests_in_one_bucket_of_a_hot_topic(spark):
    """Requests on one bucket cost rows plus requests; results are exact."""
    n = 400
    logs = spark.range(n).select(F.lit(1).cast("bigint").alias("chain_id"), F.unhex(F.lit("aa" * 32)).alias("topic0"),
                                 F.unhex(F.lit("bb" * 20)).alias("address"), (F.col("id") % 97).alias("block_number"),
                                 F.floor(F.col("id") / 97).cast("bigint").alias("log_index"))
    req = spark.range(200).select(
        F.col("id").alias("request_id"), F.lit(1).cast("bigint").alias("chain_id"), F.unhex(F.lit("aa" * 32)).alias("topic0"),
        F.lit(None).cast("binary").alias("address"), (F.col("id") % 90).alias("lo_block"), (F.col("id") % 3 - 1).alias("lo_index"),
        F.when(F.col("id") % 2 == 0, F.col("id") % 90 + 5).alias("hi_block"), F.lit(7).cast("bigint").alias("page_limit"))
    ranked = B.rank_streams(logs, [], 1000, requests=req)
    plan = B.bucket_plan(ranked, req, 1000)
    got = {(r.request_id, r.n): (r.block_number, r.log_index) for r in B.get_logs_batch(ranked, req, 1000, plan).collect()}
    rows = sorted((i % 97, i // 97) for i in range(n))
    want = {}
    for q in range(200):
        lo, hi = (q % 90, q % 3 - 1), (q % 90 + 5 if q % 2 == 0 else 10**9)
        for k, p in enumerate([p for p in rows if p > lo and p[0] <= hi][:7]):
            want[q, k + 1] = p
    assert got == want
    first = B.bucket_plan(ranked, req, 1000, first_page_only=True)
    assert "total" not in first.columns
    with pytest.raises(ValueError, match="first-page"):
        B.page_manifest(ranked, req, 1000, first)


def test_batched_pages_plan_on_keys_and_fetch_payload_last(spark, landed):
    served = TB.read_logs(spark, TB.compact_logs(landed, scratch_path(spark, "t-late"), 1000))
    ok, _ = check_requests(FX.log_requests(spark, SF_SMALL), FX.chains(spark))
    narrow = B.served_streams(served, [], requests=ok)
    assert "data" not in narrow.columns
    pages = B.get_logs_batch(narrow, ok, 1000, payload_from=served)
    assert "data" in pages.columns and any("block_bucket" in f for f in _filters(pages))


@pytest.mark.parametrize("bad, reason", [
    (dict(cursor="abc"), "bad_cursor"), (dict(cursor="99999999999999999999:0"), "bad_cursor"),
    (dict(limit=5_000_000), "bad_limit"), (dict(limit=0), "bad_limit"), (dict(from_block=-5), "from_block_negative"),
    (dict(to_block=-1), "to_block_negative"), (dict(topic="0xzz"), "topic_invalid"), (dict(address="0x"), "address_invalid")])
def test_single_and_batched_requests_reject_alike(spark, bad, reason):
    row = {"topic": R.PAGE_TOPIC} | bad
    with pytest.raises(ValueError, match=reason):
        Q.get_logs(tables.logs(spark, SF_SMALL), 1, row.pop("topic"), **row)
    row = {"topic": R.PAGE_TOPIC} | bad
    df = spark.createDataFrame([(1, 1, row["topic"], row.get("address"), row.get("from_block"), row.get("to_block"),
                                 row.get("cursor"), row.get("limit"))],
                               "request_id bigint, chain_id bigint, topic string, address string, from_block bigint, "
                               "to_block bigint, cursor string, page_limit bigint")
    _, rejected = check_requests(df, FX.chains(spark))
    assert [r.reject_reason for r in rejected.collect()] == [reason]
    assert request_fault(R.PAGE_TOPIC, cursor="5:0") is None


def test_ceiling_never_steps_back(spark):
    ev = [(1, 1, "Height", 100, None, None), (2, 1, "Height", 200, None, None), (3, 1, "Height", 150, None, None)]
    from logloom.schema import HEIGHT_EVENTS
    safes = FN.safe_ceiling(spark.createDataFrame(ev, HEIGHT_EVENTS), FX.chains(spark))
    assert FN.latest_ceiling(safes).first().safe == 200 - 12


def test_no_page_serves_an_unfinal_block(spark):
    logs = tables.logs(spark, SF_SMALL)
    ceilings = spark.createDataFrame([(1, 900)], "chain_id bigint, safe bigint")
    page = Q.get_logs(logs, 1, R.PAGE_TOPIC, ceilings=ceilings, limit=1_000_000)
    assert page.count() > 0 and page.where("blockNumber > 900").count() == 0


def test_gaps_leading_trailing_and_unplanned(spark):
    ddl = "chain_id bigint, from_block bigint, to_block bigint"
    covered = spark.createDataFrame([(1, 10, 19), (1, 30, 39), (1, 70, 75)], ddl)
    planned = spark.createDataFrame([(1, 0, 49), (1, 60, 80), (2, 5, 6)], ddl)
    got = sorted(tuple(r) for r in FN.coverage_gaps(covered, planned=planned).collect())
    assert got == [(1, 0, 9), (1, 20, 29), (1, 40, 49), (1, 60, 69), (1, 76, 80), (2, 5, 6)]
    assert sorted(tuple(r) for r in FN.coverage_gaps(covered).collect()) == [(1, 20, 29), (1, 40, 69)]


def test_a_shared_folder_is_asked_for_off_local():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())


def test_scratch_can_be_dropped(spark, monkeypatch):
    from logloom import session
    monkeypatch.setattr(session, "_made", [])
    path = scratch_path(spark, "t-drop")
    spark.range(3).write.parquet(path)
    assert session.drop_scratch(spark) == 1 and session.drop_scratch(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_hex_projection_still_reads_the_served_table(spark, landed):
    served = TB.read_logs(spark, TB.compact_logs(landed, scratch_path(spark, "t-hex")))
    assert hex_projection(served).count() == tables.logs(spark, SF_SMALL).count()
