"""What is shuffled and written: packed rows, one exchange, partitions moved into place."""

import re
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.checks import registry as R
from logloom.checks.registry import REGISTRY
from logloom.operators import packed as PK
from logloom.plans import batch as B
from logloom.plans import tables
from logloom.schema import LOGS_LANDED
from logloom.session import scratch_path
from logloom.sources import directory
from logloom.sources import fixtures as FX
from logloom.sources import table as TB
from logloom.streaming import holdback as HB
from logloom.streaming import ledger as LG

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(df):
    return re.findall(r"Exchange (?:hash|range)partitioning\((.*?), \d+\), REPARTITION", _plan(df))


def _landed(spark, rows=None):
    df = tables.landed_logs(spark, SF_SMALL) if rows is None else rows
    return spark.read.schema(TB.LANDED_WITH_SOURCE).parquet(TB.append_logs(df, scratch_path(spark, "t-disk"), 1))


def _same(one, other):
    return one.dtypes == other.dtypes and one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


def _odd_logs(spark):
    def row(k, **kw):
        out = dict(chain_id=1, block_number=k, block_hash=b"\1" * 32, timestamp=k, transaction_hash=b"\2" * 32, transaction_index=0,
                   log_index=k, address=b"\3" * 20, data=b"", topic0=b"\4" * 32, topic1=None, topic2=b"\5" * 32, topic3=None,
                   removed=0, ingest_seq=1)
        return tuple((out | kw)[f.name] for f in LOGS_LANDED.fields)

    return spark.createDataFrame([
        row(0), row(1, data=None), row(2, data=b"\0" * 70, topic1=b"\6" * 32, topic3=b"\7" * 32), row(3, address=b"", topic0=b"\4"),
        row(4, **{c: None for c in ("block_hash", "transaction_hash", "address", "topic0", "data")}), row(5, address=b"\3" * 33, data=b"x"),
        row(6, chain_id=None, block_number=None, timestamp=None), row(6, chain_id=None, block_number=None, timestamp=None)], T.StructType([T.StructField(f.name, f.dataType) for f in LOGS_LANDED.fields]))


def test_packed_logs_come_back_as_they_were(spark):
    for logs in (_odd_logs(spark), tables.landed_logs(spark, SF_SMALL)):
        for keep in ((), ("topic0",)):
            assert _same(PK.exchanged_logs(logs, lambda rows: rows.repartition(3, "chain_id", "block_number"), keep), logs)


def test_wide_rows_are_exchanged_packed_and_once(spark):
    landed = _landed(spark)
    for width, cell, by in ((1_000, 1_000, 2), (7_500, 500, 3)):
        rows = TB.served_rows(landed, width, cell)
        assert "_bytes" in _plan(rows) and [len(x.split(", ")) for x in _exchanges(rows)] == [by]
    kept = TB.dedup_landed(landed.drop("batch_id", "source"))
    assert "_bytes" in _plan(kept) and [len(x.split(", ")) for x in _exchanges(kept)] == [2]
    assert _same(kept, tables.logs(spark, SF_SMALL).select(*kept.columns))


def test_block_hashes_are_made_after_the_exchange(spark):
    """The header join shuffles two numbers of a block, not its hash as text."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        plans = [_plan(tables.logs(spark, SF_SMALL)), _plan(FX.raw_events(spark, SF_SMALL))]
    finally:
        spark.conf.set(key, before)
    for plan in plans:
        assert re.search(r"Exchange hashpartitioning\(chain_id#\d+L, o_orderkey#\d+L", plan)
        assert not re.search(r"Exchange hashpartitioning\((_b_)?chain(_id)?#\d+L, (_b_)?number#", plan)


def test_compacted_files_are_in_key_order(spark):
    path = TB.compact_logs(_landed(spark), scratch_path(spark, "t-disk-order"), 500)
    files = [r[0] for r in TB.storage_files(spark, path).select("path").collect()]
    assert len(files) > 3
    for f in files:
        t = pq.read_table(f.removeprefix("file:"), columns=["topic0", "block_number", "log_index", "address"], partitioning=None)
        rows = list(zip(*[c.to_pylist() for c in t.columns]))
        assert rows == sorted(rows)


def test_stream_counts_come_with_the_rows(spark):
    for width, cell in ((500, None), (2_000, 100)):
        stored = TB.read_logs(spark, TB.compact_logs(_landed(spark), scratch_path(spark, "t-disk-dir"), width, cell_blocks=cell))
        found = directory.counted_streams(stored)
        assert "Exchange" not in _plan(found)
        want = directory.stream_rows(stored).select(*found.columns)
        assert found.exceptAll(want).count() == 0 and found.count() == want.count()


def test_a_merge_writes_its_rows_once_and_lists_runs(spark, monkeypatch):
    landed = _landed(spark)
    path = TB.compact_logs(landed.where("ingest_seq = 1"), scratch_path(spark, "t-disk-merge"), 100)
    stored = TB.read_logs(spark, path)
    buckets = stored.select("chain_id", "block_bucket").distinct().count()
    assert buckets > 20
    monkeypatch.setattr(TB, "LISTED_PARTITIONS", 6)
    some = TB.in_partitions(stored, stored.where("block_number between 300 and 999"))
    assert "Join" not in _plan(some)
    assert some.count() == stored.where("block_number between 300 and 999").count()
    writes, f = [], TB._writer
    monkeypatch.setattr(TB, "_writer", lambda df: writes.append(1) or f(df))
    staging = scratch_path(spark, "t-disk-staging")
    TB.compact_incremental(spark, landed.where("ingest_seq = 2 and block_number < 700"), path, staging)
    TB.compact_incremental(spark, landed.where("ingest_seq = 2"), path, scratch_path(spark, "t-disk-staging"))
    assert len(writes) == 2
    assert not [*Path(staging.removeprefix("file:")).rglob("*.parquet")]
    kept = [c for c in LOGS_LANDED.fieldNames() if c != "ingest_seq"]
    assert _same(TB.read_logs(spark, path).select(*kept), tables.logs(spark, SF_SMALL).select(*kept))


def test_a_merge_adds_partitions_and_keeps_the_others(spark):
    landed = _landed(spark)
    path = TB.compact_logs(landed.where("block_number < 400"), scratch_path(spark, "t-disk-new"), 100)
    TB.compact_incremental(spark, landed.where("block_number >= 300"), path, scratch_path(spark, "t-disk-new-st"))
    kept = [c for c in LOGS_LANDED.fieldNames() if c != "ingest_seq"]
    assert _same(TB.read_logs(spark, path).select(*kept), tables.logs(spark, SF_SMALL).select(*kept))
    rows = directory.streams(TB.read_logs(spark, path), path)
    want = directory.stream_rows(TB.read_logs(spark, path)).select(*rows.columns)
    assert rows.exceptAll(want).count() == 0 and want.exceptAll(rows).count() == 0


def test_landed_copies_converge(spark):
    assert REGISTRY["replay_converges"][0](spark, SF_SMALL).count() == tables.logs(spark, SF_SMALL).count()


def test_ranked_streams_are_packed_and_stored_compressed(spark):
    ranked, _, _ = R._plan(spark, SF_SMALL, first_page_only=True)
    files = ranked.inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    logs = tables.logs(spark, SF_SMALL)
    for payload in (R.PAYLOAD, [], ["topic1"]):
        want = B.rank_streams(logs, payload, 1_000)
        got = B.rank_streams(logs, payload, 1_000, rows=10)
        assert "_bytes" in _plan(got) and _same(got, want)


def test_requests_meet_only_the_buckets_they_need(spark):
    """A bucket is a row for the requests that need it, however long their ranges are."""
    stream = "1L chain_id, unhex('aa') topic0, unhex('') skey"
    sizes = {0: 3, 2: 1, 5: 4, 900_000: 2, 5_000_000_000: 6, 5_000_000_001: 1}
    counts = spark.createDataFrame([*sizes.items()], "block_bucket bigint, bucket_rows bigint").selectExpr(*stream.split(", "), "*")
    asked = [(k, lo, hi, limit) for k, (lo, hi, limit) in enumerate(
        (lo, hi, limit) for lo in (0, 1, 2, 6, 900_000, 5_000_000_001, 5_000_000_002) for hi in (0, 4, 5_000_000_000, 5_000_000_001)
        for limit in (1, 2, 4, 5, 100))]
    req = spark.createDataFrame(asked, "request_id bigint, _lo_b bigint, _hi_b bigint, page_limit bigint").selectExpr(*stream.split(", "), "*")
    for first in (False, True):
        got = {}
        for r in B._bucket_pairs(req, counts, first).collect():
            assert r.bucket_rows == sizes[r.block_bucket]
            got.setdefault(r.request_id, []).append(r.block_bucket)
        for k, lo, hi, limit in asked:
            want, full = [], 0
            for b in sorted(sizes):
                if lo <= b <= hi and not (first and full >= limit):
                    want.append(b)
                    full += sizes[b] if b > lo else 0
            assert sorted(got.get(k, [])) == want


def test_held_logs_come_back_as_they_were(spark):
    for logs in (_odd_logs(spark), tables.landed_logs(spark, SF_SMALL)):
        held = HB.packed_log(logs)
        assert sorted(held.columns) == ["block_number", "chain_id", "log"]
        assert _same(HB.unpacked_log(held), logs)
    small = held.agg(F.sum(F.octet_length("log"))).first()[0]
    assert small < 0.6 * logs.agg(F.sum(F.length(F.to_json(F.struct(*HB.PACKED.names))))).first()[0]


def test_ranges_that_follow_each_other_are_one_row_a_cell(spark):
    def ranges(pairs):
        return spark.createDataFrame([(c, k, a, b) for k, (c, a, b) in enumerate(pairs)], "chain_id bigint, seq bigint, from_block bigint, to_block bigint")

    rows = spark.range(0, 4_000).selectExpr("cast(1 + id % 2 as bigint) chain_id", "id block_number")
    dense = [(1, 10 * k, 10 * k + 9) for k in range(20, 300)]
    gaps = [(2, 7 * k, 7 * k + 3) for k in range(400)] + [(2, 3_500, 3_500), (1, 3_990, 5_000)]
    found = LG.covered_blocks(ranges(dense + gaps))
    assert found.where("chain_id = 1 and _from < 3000").count() == 3
    want = LG.in_ranges(rows, ranges(dense + gaps), F.col("block_number"), 100).select("chain_id", "block_number")
    got = rows.withColumn("_cell", F.floor(F.col("block_number") / LG.CELL_BLOCKS)).join(found, ["chain_id", "_cell"]) \
        .where("block_number between _from and _to").select("chain_id", "block_number")
    assert _same(got, want) and want.count() > 1_000
