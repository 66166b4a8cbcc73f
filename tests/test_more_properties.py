"""More properties from the test plan: tiling, replay order, hex round trip."""

import random

from pyspark.sql import functions as F

from logloom.functions.hexcodec import bare_hex, hex_to_bytes
from logloom.operators.dedup import dedup_logs
from logloom.plans import tables
from logloom.session import scratch_path
from logloom.sources import fixtures as FX
from logloom.sources import table as TB
from logloom.streaming import finality as FN

from .conftest import SF_SMALL


def test_gapless_ranges_tile_to_last_safe(spark):
    safes = FN.safe_ceiling(FX.height_events(spark, SF_SMALL), FX.chains(spark))
    ranges = FN.plan_ranges_gapless(safes, 0).orderBy("chain_id", "seq").collect()
    top = {r.chain_id: r.m for r in safes.groupBy("chain_id").agg(F.max("safe").alias("m")).collect()}
    by = {}
    for r in ranges:
        by.setdefault(r.chain_id, []).append((r.from_block, r.to_block))
    for chain, rs in by.items():
        assert rs[0][0] == 0
        for (a, b), (c, d) in zip(rs, rs[1:]):
            assert a <= b and c == b + 1
        assert rs[-1][1] == top[chain]


def test_replay_order_does_not_matter(spark):
    landed = tables.landed_logs(spark, SF_SMALL)
    first, second = landed.where(F.col("ingest_seq") == 1), landed.where(F.col("ingest_seq") == 2)
    a, b = scratch_path(spark, "t-order-a"), scratch_path(spark, "t-order-b")
    TB.append_logs(first, a, 1)
    TB.append_logs(second, a, 2)
    TB.append_logs(second, b, 1)          # replays land first here
    TB.append_logs(first, b, 2)
    TB.append_logs(second, b, 3)          # and once more
    ra = dedup_logs(TB.read_landed(spark, a).drop("batch_id"))
    rb = dedup_logs(TB.read_landed(spark, b).drop("batch_id"))
    assert ra.count() == rb.count() == tables.logs(spark, SF_SMALL).count()
    assert ra.exceptAll(rb).count() == 0


def test_hex_round_trip_random(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(500):
        width = rnd.choice([20, 32])
        raw = bytes(rnd.getrandbits(8) for _ in range(rnd.randint(0, width)))
        text = raw.hex().lstrip("0") if rnd.random() < 0.3 else raw.hex()
        text = text.upper() if rnd.random() < 0.5 else text
        text = rnd.choice(["0x", "0X", ""]) + text
        rows.append((text, width, raw.rjust(width, b"\0").hex()))
    df = spark.createDataFrame(rows, "text string, width int, want string")
    got = df.select("want", "width",
                    F.when(F.col("width") == 20, bare_hex(hex_to_bytes("text", 20)))
                     .otherwise(bare_hex(hex_to_bytes("text", 32))).alias("got"))
    assert got.where(F.col("got") != F.col("want")).count() == 0
    assert got.where(F.col("got").isNull()).count() == 0
