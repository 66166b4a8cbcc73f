"""Finality and range planning over the height stream.

``safe = height - margin(chain)``: the newest ``margin`` blocks are held back
(a block-number analogue of a watermark).  The planner turns a chain's height
events into the block ranges to fetch:

* ``gapless``: emit ``[start, safe]`` when ``safe >= start``, then
  ``start = safe + 1``.  Closed form: an event emits iff its ``safe`` beats
  the running max of earlier safes (a *record*), and its range starts after
  the previous record.
* ``strict`` (the service's own rule): emit only when ``safe > start``.  That
  is a fold, but its emissions are a subset of the records: within a run of
  consecutive record values ``v, v+1, v+2, ..`` every other one is emitted,
  starting with the run's first; a record after a jump of 2 or more always
  is.  So: mark run starts with an anti-join on ``value - 1``, take parity
  against the running max of run starts, and start each range after the
  previous emitted value.

All running maxima are two-level (see ``operators.scan``): no chain's full
history is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import split_height_events
from ..operators.scan import running_agg
from ..session import materialize

SEQ_CHUNK = 100_000      # events per chunk of the running max
VALUE_CHUNK = 1_000_000  # block numbers per chunk of the value-ordered scans


def safe_ceiling(events: DataFrame, chains: DataFrame) -> DataFrame:
    """Height events -> ``seq, chain_id, height, margin, safe``.

    Reconnect notices are set aside (T1); chains are a fixed configuration
    list, so they are broadcast.
    """
    heights, _notices = split_height_events(events)
    j = heights.join(F.broadcast(chains.select("chain_id", "margin")), "chain_id", "inner")
    return j.select("seq", "chain_id", "height", "margin",
                    (F.col("height") - F.col("margin")).alias("safe"))


def latest_ceiling(safes: DataFrame) -> DataFrame:
    """The ceiling per chain: the highest safe block so far (partial
    aggregation).  It never steps back: what was final stays final, also when
    a later event reports a lower height."""
    return safes.groupBy("chain_id").agg(F.max("safe").alias("safe"))


def final_logs(logs: DataFrame, ceilings: DataFrame) -> DataFrame:
    """Logs at or below their chain's ceiling (T2).  One row per chain, so the
    ceiling table is broadcast; the logs stay where they are."""
    c = F.broadcast(ceilings.select("chain_id", F.col("safe").alias("_ceiling")))
    return logs.join(c, "chain_id", "inner").where(F.col("block_number") <= F.col("_ceiling")) \
        .drop("_ceiling")


def _starts(safes: DataFrame, start) -> DataFrame:
    if isinstance(start, DataFrame):
        # per-chain start points, e.g. chain_state()'s resume block (T4)
        col = "start_block" if "start_block" in start.columns else "startBlock"
        s = start.select("chain_id", F.col(col).cast("bigint").alias("_start"))
        return safes.join(F.broadcast(s), "chain_id", "left") \
            .withColumn("_start", F.coalesce(F.col("_start"), F.lit(0).cast("bigint")))
    return safes.withColumn("_start", F.lit(int(start)).cast("bigint"))


def _records(safes: DataFrame, start) -> DataFrame:
    s = _starts(safes, start)
    s = running_agg(s, ["chain_id"], ["seq"], "safe", F.floor(F.col("seq") / SEQ_CHUNK), "max",
                    inclusive=False, out="_prev_max")
    floor_ = F.greatest(F.col("_start") - 1, F.col("_prev_max"))
    return s.where(F.col("safe") > floor_).withColumn("_prev", floor_)


def plan_ranges_gapless(safes: DataFrame, start=0) -> DataFrame:
    """``chain_id, seq, from_block, to_block`` for the gapless mode."""
    r = _records(safes, start)
    return r.select("chain_id", "seq", (F.col("_prev") + 1).alias("from_block"),
                    F.col("safe").alias("to_block"))


def plan_ranges_strict(safes: DataFrame, start=0) -> DataFrame:
    """``chain_id, seq, from_block, to_block`` for the strict mode.

    Each running aggregate reads its input twice (rows and chunk totals), so
    stacked ones multiply the plan; the records (one row per new high) and
    the run starts are written once with a reliable checkpoint in between.
    """
    r = materialize(_records(safes, start).select("chain_id", "seq", F.col("safe").alias("v"),
                                                  "_start"))
    virtual = r.groupBy("chain_id").agg(F.first("_start").alias("_start")).select(
        "chain_id", F.lit(None).cast("bigint").alias("seq"), (F.col("_start") - 1).alias("v"),
        "_start")
    s = r.unionByName(virtual)
    prev = s.select("chain_id", (F.col("v") + 1).alias("v"), F.lit(True).alias("_has_prev"))
    s = s.join(prev, ["chain_id", "v"], "left")
    s = s.withColumn("_run_mark", F.when(F.col("_has_prev").isNull(), F.col("v")))
    vchunk = F.floor(F.col("v") / VALUE_CHUNK)
    s = running_agg(s, ["chain_id"], ["v"], "_run_mark", vchunk, "max", True, "_run_start")
    s = materialize(s.withColumn("_picked", ((F.col("v") - F.col("_run_start")) % 2) == 0))
    s = running_agg(s, ["chain_id"], ["v"], F.when(F.col("_picked"), F.col("v")), vchunk, "max",
                    inclusive=False, out="_prev_pick")
    out = s.where(F.col("_picked") & F.col("seq").isNotNull())
    return out.select("chain_id", "seq", (F.col("_prev_pick") + 1).alias("from_block"),
                      F.col("v").alias("to_block"))


def plan_ranges(safes: DataFrame, start=0, mode: str = "gapless") -> DataFrame:
    """Block ranges to fetch per height event (T3); ``start`` is an int or a
    DataFrame ``chain_id, start_block`` (e.g. ``chain_state``'s startBlock)."""
    if mode == "gapless":
        return plan_ranges_gapless(safes, start)
    if mode == "strict":
        return plan_ranges_strict(safes, start)
    raise ValueError(f"unknown mode {mode!r}")


def coverage_gaps(ranges: DataFrame, chunk_blocks: int = VALUE_CHUNK,
                  planned: DataFrame | None = None) -> DataFrame:
    """Blocks not covered by any ingested range, per chain.

    ``ranges``: ``chain_id, from_block, to_block`` (inclusive).  A gap starts
    after the running max of earlier ``to_block``s.  Without ``planned`` these
    are the gaps between covered blocks.  With ``planned`` (the same columns,
    e.g. the planner's ranges) every planned block that is not covered is
    reported, before the first and after the last covered one too, and for
    chains without any covered block; blocks that no plan asks for are none.
    """
    cols = ["chain_id", "from_block", "to_block"]
    ranges = ranges.select(*cols)
    if planned is not None:
        planned = planned.select(*cols)
        extent = planned.groupBy("chain_id").agg(F.min("from_block").alias("lo"), F.max("to_block").alias("hi"))
        # guards just outside the plan, and what lies between its ranges, count as covered
        guards = extent.select("chain_id", F.explode(F.array(F.col("lo") - 1, F.col("hi") + 1)).alias("from_block")) \
            .withColumn("to_block", F.col("from_block"))
        unplanned = coverage_gaps(planned, chunk_blocks).toDF(*cols)
        inside = ranges.join(F.broadcast(extent), "chain_id").select(
            "chain_id", F.greatest("from_block", "lo").alias("from_block"), F.least("to_block", "hi").alias("to_block")) \
            .where("from_block <= to_block")
        ranges = inside.unionByName(guards).unionByName(unplanned)
    r = running_agg(ranges, ["chain_id"], ["from_block", "to_block"], "to_block",
                    F.floor(F.col("from_block") / chunk_blocks), "max", inclusive=False,
                    out="_prev_to")
    g = r.where(F.col("from_block") > F.col("_prev_to") + 1)
    return g.select("chain_id", (F.col("_prev_to") + 1).alias("gap_from"),
                    (F.col("from_block") - 1).alias("gap_to"))
