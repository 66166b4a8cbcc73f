"""Properties: cursor walks, batched = single, planners = fold, export order."""

import random

from pyspark.sql import functions as F

from logloom.checks import registry as R
from logloom.operators.requests import check_requests
from logloom.plans import batch as B
from logloom.plans import query as Q
from logloom.plans import tables
from logloom.sources import fixtures as FX
from logloom.streaming import finality as FN

from .conftest import SF_SMALL


def test_cursor_walk_concatenates_to_unlimited(spark):
    logs = tables.logs(spark, SF_SMALL).cache()
    full = [(r.blockNumber, r.logIndex) for r in
            Q.get_logs(logs, 1, R.PAGE_TOPIC, limit=None).collect()]
    walked, cursor = [], None
    for _ in range(200):
        page = Q.get_logs(logs, 1, R.PAGE_TOPIC, cursor=cursor, limit=37).cache()
        walked += [(r.blockNumber, r.logIndex) for r in page.collect()]
        nxt = Q.page_cursor(page, 37).collect()[0].next_cursor
        if nxt is None:
            break
        cursor = nxt
    assert walked == full and len(full) > 37
    logs.unpersist()


def test_batched_equals_single(spark):
    logs = tables.logs(spark, SF_SMALL)
    reqs = FX.log_requests(spark, SF_SMALL)
    ok, _ = check_requests(reqs, FX.chains(spark))
    ranked = B.rank_streams(logs, R.PAYLOAD, R.BATCH_BUCKET)
    batch = B.get_logs_batch(ranked, ok, R.BATCH_BUCKET)
    raw = {r.request_id: r for r in reqs.collect()}
    ids = [r.request_id for r in ok.orderBy("request_id").limit(12).collect()]
    got = {}
    for r in batch.where(F.col("request_id").isin(ids)).collect():
        got.setdefault(r.request_id, []).append((r.n, r.block_number, r.log_index))
    for rid in ids:
        q = raw[rid]
        single = Q.get_logs(logs, q.chain_id, q.topic, q.address, q.from_block, q.to_block,
                            q.cursor, q.page_limit or 1000, formatted=False).collect()
        assert [(b, i) for _, b, i in sorted(got.get(rid, []))] == \
            [(r.block_number, r.log_index) for r in single]


def _fold(safes, start, strict):
    out = []
    for seq, safe in safes:
        if (safe > start) if strict else (safe >= start):
            out.append((seq, start, safe))
            start = safe + 1
    return out


def test_planners_equal_fold_on_random_heights(spark):
    rnd = random.Random(7)
    rows, expect_g, expect_s = [], {}, {}
    for chain in range(1, 41):
        safes, h = [], rnd.randint(-3, 5)
        for seq in range(rnd.randint(0, 60)):
            h += rnd.choice([0, 1, 1, 1, 2, 5, -1, -3])
            safes.append((chain * 1000 + seq, h))
            rows.append((chain * 1000 + seq, chain, h))
        start = chain % 4
        expect_g[chain] = _fold(safes, start, False)
        expect_s[chain] = _fold(safes, start, True)
    df = spark.createDataFrame(rows, "seq bigint, chain_id bigint, safe bigint")
    starts = spark.createDataFrame([(c, c % 4) for c in range(1, 41)], "chain_id bigint, start_block bigint")
    for fn, expect in ((FN.plan_ranges_gapless, expect_g), (FN.plan_ranges_strict, expect_s)):
        got = {}
        for r in fn(df, starts).collect():
            got.setdefault(r.chain_id, []).append((r.seq, r.from_block, r.to_block))
        for chain in range(1, 41):
            assert sorted(got.get(chain, [])) == expect[chain], (fn.__name__, chain)


def test_export_chunks_are_ordered(spark):
    from logloom.plans import export as X
    from logloom.session import scratch_path
    path = scratch_path(spark, "t-export")
    man = X.export_logs(tables.logs(spark, SF_SMALL), path, 1, R.PAGE_TOPIC, chunks=4).orderBy("chunk").collect()
    assert len(man) >= 2
    for a, b in zip(man, man[1:]):
        la = tuple(map(int, a.last_cursor.split(":")))
        fb = tuple(map(int, b.first_cursor.split(":")))
        assert la < fb
    rows = X.read_export(spark, path).count()
    assert rows == sum(m.rows for m in man)


def test_stored_ranks_survive_incremental_compaction(spark):
    """Pages answered from ranks stored by (incremental) compaction equal
    pages answered from ranks computed on the fly."""
    from logloom.session import scratch_path
    from logloom.sources import table as TB
    landed = tables.landed_logs(spark, SF_SMALL)
    served = TB.compact_logs(landed.where(F.col("ingest_seq") == 1), scratch_path(spark, "t-inc"), 1000)
    TB.compact_incremental(spark, landed.where(F.col("ingest_seq") == 2), served,
                           scratch_path(spark, "t-stage"), 1000)
    ok, _ = check_requests(FX.log_requests(spark, SF_SMALL), FX.chains(spark))
    stored = B.get_logs_batch(B.served_streams(TB.read_logs(spark, served), R.PAYLOAD, requests=ok),
                              ok, 1000)
    fresh = B.get_logs_batch(B.rank_streams(tables.logs(spark, SF_SMALL), R.PAYLOAD, 1000), ok, 1000)
    cols = ["request_id", "n", "block_number", "log_index"]
    a, b = stored.select(*cols), fresh.select(*cols)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_resume_from_chain_state(spark):
    """Planning from the resume point of chain_state equals planning from the
    same numbers given explicitly (T4)."""
    from logloom.operators.aggregates import chain_state
    safes = FN.safe_ceiling(FX.height_events(spark, SF_SMALL), FX.chains(spark))
    state = chain_state(tables.logs(spark, SF_SMALL))
    starts = {r.chain_id: r.startBlock for r in state.collect()}
    got = FN.plan_ranges(safes, state, "strict").collect()
    rows = [(r.seq, r.chain_id, r.safe) for r in safes.collect()]
    for chain, start in starts.items():
        seq_safes = sorted((s, v) for s, c, v in rows if c == chain)
        want = _fold(seq_safes, start, True)
        assert sorted((r.seq, r.from_block, r.to_block) for r in got if r.chain_id == chain) == want
