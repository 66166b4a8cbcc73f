"""Live planner, ledger, source by height, streaming hold-back."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.operators.dedup import dedup_logs
from logloom.plans import tables
from logloom.schema import HEIGHT_EVENTS, RAW_EVENTS
from logloom.session import scratch_path
from logloom.sources import archive as AR
from logloom.sources import fixtures as FX
from logloom.sources import table as TB
from logloom.streaming import finality as FN
from logloom.streaming import holdback as HB
from logloom.streaming import ledger as LG
from logloom.streaming import planner as PL
from logloom.streaming.state import STORE, finished

from .conftest import SF_SMALL


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# --- planner -------------------------------------------------------------------

def plain_ranges(start, safes, strict):
    out = []
    for seq, safe in safes:
        if safe > start or (safe == start and not strict):
            out.append((seq, start, safe))
            start = safe + 1
    return start, out


@pytest.mark.parametrize("strict", [True, False])
def test_next_ranges_equal_a_fold_under_any_split(strict):
    rng = random.Random(1)
    for _ in range(300):
        n, first = rng.randint(1, 40), rng.choice([0, 0, 7])
        safes = [(k, rng.randint(-5, 40) if rng.random() < 0.3 else k + rng.randint(-3, 3)) for k in range(n)]
        start, got, at = first, [], 0
        while at < n:
            some = safes[at:at + rng.randint(1, 12)]
            at += len(some)
            rng.shuffle(some)  # rows of a micro-batch come in any order
            seq, safe = (np.array(x, np.int64) for x in zip(*some))
            start, found = PL.next_ranges(start, seq, safe, strict)
            got += found
        assert (start, got) == plain_ranges(first, safes, strict)


def test_live_planner_resumes_from_chain_state_and_its_checkpoint(spark):
    """Two micro-batches with a restart between; the first start blocks come
    from what is stored, later ones from the state."""
    events, chains = FX.height_events(spark, SF_SMALL), FX.chains(spark)
    start = spark.createDataFrame([(1, 100), (10, 40)], "chain_id bigint, startBlock bigint")
    src, out, checkpoint = (scratch_path(spark, x) for x in ("t-heights", "t-ranges", "t-ckpt"))
    before = spark.conf.get(STORE, None)
    for half in (F.col("seq") < 317, F.col("seq") >= 317):
        events.where(half).repartition(3).write.mode("append").parquet(src)
        finished(PL.live_ranges(spark.readStream.schema(HEIGHT_EVENTS).parquet(src), chains, PL.ranges_to(out), checkpoint, start))
    assert spark.conf.get(STORE, None) == before
    got = PL.read_ranges(spark, out)
    want = FN.plan_ranges_strict(FN.safe_ceiling(events, chains), start.withColumnRenamed("startBlock", "start_block"))
    assert got.count() and same(got, want.select(*got.columns))


def test_unknown_planner_mode_is_refused(spark):
    with pytest.raises(ValueError):
        PL.plan_ranges_stream(spark.range(1), mode="loose")


# --- ledger ----------------------------------------------------------------------

def test_crash_between_rows_and_ledger_replays_exactly_the_range(spark, monkeypatch):
    events, chains = FX.height_events(spark, SF_SMALL), FX.chains(spark)
    archive, src, landing, ledger, checkpoint = (scratch_path(spark, x) for x in ("t-arch", "t-heights", "t-land", "t-led", "t-ckpt"))
    AR.append_archive(FX.raw_events(spark, SF_SMALL), archive, segment_rows=500)
    commit, attempts = LG.commit_ranges, []

    def crash(ranges, landing, ledger, source, batch_id):
        attempts.append((batch_id, sorted(map(tuple, ranges.collect()))))
        if len(attempts) == 2:
            raise RuntimeError("lost before the commit")
        commit(ranges, landing, ledger, source, batch_id)

    monkeypatch.setattr(LG, "commit_ranges", crash)

    def run():
        stream = spark.readStream.schema(HEIGHT_EVENTS).parquet(src)
        return finished(LG.ingest_planned(stream, chains, LG.archive_fetch(archive), landing, ledger, checkpoint))

    events.where("seq < 400").write.mode("append").parquet(src)
    run()
    events.where("seq >= 400").write.mode("append").parquet(src)
    with pytest.raises(Exception, match="lost before the commit"):
        run()
    # the rows are there, but no reader sees them
    seen = LG.read_committed(spark, landing, ledger).count()
    assert TB.read_landed(spark, landing).count() > seen
    planned = FN.plan_ranges_strict(FN.safe_ceiling(events, chains))
    assert FN.coverage_gaps(LG.read_ledger(spark, ledger), planned=planned).count() > 0
    run()
    assert attempts[1] == attempts[2] and attempts[1][1]
    got = LG.read_ledger(spark, ledger)
    assert same(got.select(*planned.columns), planned)
    assert FN.coverage_gaps(got, planned=planned).count() == 0
    reached = planned.groupBy("chain_id").agg(F.max("to_block").alias("safe"))
    want = FN.final_logs(tables.logs(spark, SF_SMALL), reached)
    rows = LG.read_committed(spark, landing, ledger)
    assert same(dedup_logs(rows).select(*want.columns), want)
    assert got.agg(F.sum("rows")).first()[0] == rows.count()


def test_committed_batch_is_not_fetched_again(spark):
    landing, ledger = scratch_path(spark, "t-land"), scratch_path(spark, "t-led")
    ranges = spark.createDataFrame([(1, 5, 0, 90), (1, 6, 91, 91), (8453, 7, 0, 3)], PL.RANGES)
    calls = []

    def fetch(r):
        calls.append(1)
        return LG.in_ranges(FX.raw_events(spark, SF_SMALL), r, F.col("log.blockNumber"), cell_blocks=10)

    assert LG.ingest_ranges(ranges, 0, fetch, landing, ledger, "s")
    assert not LG.ingest_ranges(ranges, 0, fetch, landing, ledger, "s") and calls == [1]
    want = FX.raw_logs(spark, SF_SMALL).where("chain_id = 1 and block_number <= 91").count()
    assert LG.read_committed(spark, landing, ledger).count() == want
    assert [r.rows for r in LG.read_ledger(spark, ledger).where("chain_id = 8453").collect()] == [0]
    empty = ranges.limit(0)  # a micro-batch without ranges commits as well
    assert LG.ingest_ranges(empty, 1, fetch, landing, ledger, "s") and not LG.ingest_ranges(empty, 1, fetch, landing, ledger, "s")


# --- source by height -------------------------------------------------------------

def test_rows_meet_the_few_ranges_of_their_cell(spark):
    """Cells are as wide as ranges are on the mean, so pairs grow with rows, not with rows times ranges."""
    spans, at = [], 0
    for k in range(600):
        spans.append((1, k, at, at + (k % 3 == 0)))
        at += 1 + (k % 3 == 0)
    wide = [(10, 0, 0, 4_999)]
    schema = "chain_id bigint, seq bigint, from_block bigint, to_block bigint"
    narrow, all_ranges = spark.createDataFrame(spans, schema), spark.createDataFrame(spans + wide, schema)
    assert LG.cell_width(narrow) == 2
    assert LG.cell_width(spark.createDataFrame(wide, schema)) == LG.CELL_BLOCKS
    assert LG.cell_width(narrow.where("false")) == 1
    rows = spark.range(6_000).selectExpr("if(id % 2 = 0, 1, 10) as chain_id", "id div 2 as block_number")
    rows = rows.unionByName(rows.where("block_number < 5")).unionByName(rows.limit(1).selectExpr("chain_id", "cast(null as bigint) as block_number"))
    for ranges in (narrow, all_ranges, narrow.where("false")):
        got = LG.in_ranges(rows, ranges, F.col("block_number")).select("chain_id", "block_number", "_seq")
        r = ranges.withColumnRenamed("chain_id", "c")
        want = rows.join(r, (r.c == rows.chain_id) & rows.block_number.between(r.from_block, r.to_block)) \
            .select("chain_id", "block_number", F.col("seq").alias("_seq"))
        assert same(got, want) and got.count() == want.count()


def test_heights_advance_within_the_row_bound():
    segs = [(1, 0, 9, 100, "a"), (1, 9, 20, 100, "b"), (1, 20, 20, 50, "c"), (1, 20, 30, 100, "d"), (10, 5, 6, 10, "e")]
    steps, at = [], {}
    while True:
        new = AR.next_heights(iter(segs), at, 150)
        if new == at:
            break
        steps.append(new)
        at = new
    # block 9 goes with the second segment, block 20 with the fourth
    assert steps == [{"1": 9, "10": 7}, {"1": 20, "10": 7}, {"1": 31, "10": 7}]
    assert AR.next_heights(iter(segs), {}, 1) == {"1": 9}  # one segment at least
    assert AR.next_heights(iter(segs), {}, 10**6, to_block=12) == {"1": 13, "10": 7}
    assert AR.next_heights(iter(segs), {"1": 31, "10": 7}, 10**6) == {"1": 31, "10": 7}
    assert AR.next_heights(iter([]), {}, 5) == {}


def test_source_by_height_restarts_without_loss_or_repeat(spark):
    events = FX.raw_events(spark, SF_SMALL)
    archive, out, checkpoint = (scratch_path(spark, x) for x in ("t-arch", "t-out", "t-ckpt"))
    sizes = []

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        sizes.append(spark.read.schema(RAW_EVENTS).parquet(f"{out}/batch_id={batch_id}").count())
        if len(sizes) == 3:
            raise RuntimeError("lost before the batch is committed")

    def run():
        q = AR.stream_blocks(spark, archive, rows_per_batch=900).writeStream.foreachBatch(sink) \
            .option("checkpointLocation", checkpoint).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    AR.append_archive(events.where("log.blockNumber < 700"), archive, segment_rows=300)
    with pytest.raises(Exception, match="lost before"):
        run()
    run()
    AR.append_archive(events.where("log.blockNumber >= 700"), archive, segment_rows=300)
    run()
    got = spark.read.schema(RAW_EVENTS).parquet(out).drop("batch_id")
    assert same(got, events)
    assert len(sizes) > 6 and max(sizes) <= 900 + 30  # a shared block may come on top


def test_block_ranges_are_read_by_bounds(spark):
    events, archive = FX.raw_events(spark, SF_SMALL), scratch_path(spark, "t-arch")
    AR.append_archive(events, archive, segment_rows=400)
    got = AR.read_blocks(spark, archive, [1, 137], 100, 499)
    assert same(got, events.where("chain_id in (1, 137) and log.blockNumber between 100 and 499"))
    touched = AR.BlockReader({"path": archive, "from_block": "100", "to_block": "499"}).partitions()
    assert 0 < len(touched) < AR.segments(spark, archive).count()
    assert all(100 <= p.low <= p.high <= 499 for p in touched)
    first = AR.stream_blocks(spark, archive, 10**6, [1], 100, 499)
    out = scratch_path(spark, "t-out")
    q = first.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "t-ckpt")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert same(spark.read.schema(RAW_EVENTS).parquet(out), events.where("chain_id = 1 and log.blockNumber between 100 and 499"))
    with pytest.raises(ValueError):
        AR.stream_blocks(spark, archive, from_block=5)


# --- hold-back ---------------------------------------------------------------------

def test_state_holds_unfinal_logs_only(spark):
    landed = tables.landed_logs(spark, SF_SMALL)
    src, ranges, out, checkpoint = (scratch_path(spark, x) for x in ("t-land", "t-ranges", "t-out", "t-ckpt"))
    steps = [("block_number < 600", [(1, 1, 0, 149), (10, 2, 0, 700)]),
             ("block_number >= 900", [(1, 3, 150, 333), (137, 4, 0, 0)]),
             ("block_number between 600 and 899", [(1, 5, 334, 1000)])]  # logs of chain 10 up to 700 come late
    ceilings, arrived = {}, None
    for k, (which, released) in enumerate(steps):
        TB.append_logs(landed.where(which), src, k)
        spark.createDataFrame(released, PL.RANGES).write.mode("append").parquet(ranges)
        finished(HB.serve_final(spark.readStream.schema(TB.LANDED_WITH_SOURCE).parquet(src),
                                spark.readStream.schema(PL.RANGES).parquet(ranges), out, checkpoint, cell_blocks=100))
        ceilings |= {c: to for c, _, _, to in released}
        arrived = landed.where(which) if arrived is None else arrived.unionByName(landed.where(which))
        safe = spark.createDataFrame(list(ceilings.items()), "chain_id bigint, safe bigint")
        want = FN.final_logs(arrived, safe)
        got = spark.read.schema(TB.LANDED_WITH_BATCH).parquet(out).drop("batch_id")
        assert same(got.select(*want.columns), want)
        held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "pending").load()
        assert held.count() == arrived.count() - want.count()
        assert held.where("list_element.chain_id = 1").where(f"list_element.block_number <= {ceilings[1]}").count() == 0


def test_held_logs_are_three_values_and_come_out_whole(spark):
    """State keeps a log as its position and one text; nulls, empty data and high bytes come out as they went in."""
    rows = [(c, b, bytes([b % 256]) * 32, b + 7, b"\xff\x00" * 16, 3, i, b"\x80" * 20, d, b"\x01" * 32, t, None, t, 1, 2)
            for c, b, i, d, t in [(1, 5, 0, b"", None), (1, 5, 1, b"\x00\xfe\"\\\n", b"\x9f" * 32), (1, 6, 0, b"x" * 300, None),
                                  (1, 7, 0, b"", b""), (10, 5, 0, b"\xc3\x28", b"\x9f" * 32)]]
    landed = spark.createDataFrame(rows, TB.LOGS_LANDED)
    src, ranges, out, checkpoint = (scratch_path(spark, x) for x in ("t-land", "t-ranges", "t-out", "t-ckpt"))
    TB.append_logs(landed, src, 1)
    for released, blocks in (((1, 1, 0, 4), []), ((1, 2, 5, 6), [5, 5, 6]), ((10, 3, 0, 9), [5, 5, 5, 6])):
        spark.createDataFrame([released], PL.RANGES).write.mode("append").parquet(ranges)
        finished(HB.serve_final(spark.readStream.schema(TB.LANDED_WITH_SOURCE).parquet(src),
                                spark.readStream.schema(PL.RANGES).parquet(ranges), out, checkpoint))
        got = spark.read.schema(TB.LANDED_WITH_BATCH).parquet(out).drop("batch_id")
        assert sorted(r.block_number for r in got.collect()) == blocks
    assert same(got.select(*landed.columns), landed.where("not (chain_id = 1 and block_number = 7)"))
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "pending").load()
    assert [r.list_element.block_number for r in held.collect()] == [7]
    assert held.schema["list_element"].dataType.names == ["chain_id", "block_number", "log"]
