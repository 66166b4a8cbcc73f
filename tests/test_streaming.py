"""Streaming ingest: stop/restart on one checkpoint equals the batch result."""

from pyspark.sql import functions as F

from logloom.operators.dedup import dedup_logs
from logloom.plans import tables
from logloom.session import scratch_path
from logloom.sources import fixtures as FX
from logloom.sources import table as TB
from logloom.streaming import ingest as IN

from .conftest import SF_SMALL


def test_restart_on_checkpoint_equals_batch(spark):
    ev = FX.raw_events(spark, SF_SMALL)
    src = scratch_path(spark, "t-src")
    landing, ckpt = scratch_path(spark, "t-land"), scratch_path(spark, "t-ckpt")
    IN.write_raw_files(ev.where(F.col("ingest_seq") == 1), f"{src}/part=1", 3)
    q = IN.ingest_stream(spark, f"{src}/*", landing, ckpt)
    q.awaitTermination()
    first = TB.read_landed(spark, landing).count()
    IN.write_raw_files(ev.where(F.col("ingest_seq") == 2), f"{src}/part=2", 2)
    q = IN.ingest_stream(spark, f"{src}/*", landing, ckpt)
    q.awaitTermination()
    landed = TB.read_landed(spark, landing)
    assert landed.count() > first
    got = dedup_logs(landed.drop("batch_id"))
    want = tables.logs(spark, SF_SMALL)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert q.lastProgress is None or "ingest" in (q.lastProgress.get("observedMetrics") or {"ingest": 1})


def test_processing_time_trigger_lands_everything(spark):
    """The timed trigger (the flush timeout) with a per-trigger file cap
    lands the same rows as the one-shot run."""
    ev = FX.raw_events(spark, SF_SMALL)
    src = IN.write_raw_files(ev, scratch_path(spark, "t-src-timed"), 4)
    landing = scratch_path(spark, "t-land-timed")
    q = IN.ingest_stream(spark, src, landing, scratch_path(spark, "t-ckpt-timed"),
                         available_now=False, trigger_seconds=1, max_files_per_trigger=1)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    landed = TB.read_landed(spark, landing)
    assert landed.select("batch_id").distinct().count() >= 4
    assert landed.count() == tables.landed_logs(spark, SF_SMALL).count()
