"""Streaming hold-back: logs wait in state until their block is final.

Two streams meet: landed logs, and releases (the planner's ranges: blocks of a
chain that have become safe).  Both are keyed by (chain, cell of blocks); a
release is cut into the cells it covers, so no key ever holds more than one
cell of one chain, and a busy chain is spread over its cells.

A cell's state is the highest block released in it and a list of the logs
above that.  A log at or below it passes at once, also when it comes late; a
release gives out the logs it covers and the rest of the list is kept.  So the
list state holds unfinal logs only; of a log it has the position and one value
with the rest packed (:func:`packed_log`), as every value of a row costs time
on its way through Python and every byte is shuffled and kept.  Ranges of a chain come in rising order
without gaps (as the planner makes them), which makes one number enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.packed import pack_logs, unpack_logs
from ..schema import LOGS_LANDED
from .state import keyed_state

CELL_BLOCKS = 1_000
#: what state and its Python rows need of a log; the rest of it is one value
HELD = T.StructType([T.StructField("chain_id", T.LongType(), True), T.StructField("block_number", T.LongType(), True),
                     T.StructField("log", T.BinaryType(), True)])
#: packed and unpacked by Spark, so a row through Python has three values, not sixteen
PACKED = T.StructType([T.StructField(f.name, f.dataType, True) for f in LOGS_LANDED.fields
                       if f.name not in ("chain_id", "block_number")])


_NUMBERS = [f.name for f in PACKED.fields if not isinstance(f.dataType, T.BinaryType)]


def packed_log(logs: DataFrame) -> DataFrame:
    """``logs`` with the columns of ``PACKED`` as one binary ``log``: the length
    of a text of the numbers, that text, then the bytes of the other columns.
    A row that :func:`pack_logs` cannot take whole is JSON after a zero."""
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*_NUMBERS, "_bits")])
    length = F.unhex(F.lpad(F.hex(F.length(text)), 2, "0"))
    rows = pack_logs(logs.withColumn("_json", F.to_json(F.struct(*PACKED.names))))
    log = F.when(F.col("_odd").isNull(), F.concat(length, text.cast("binary"), F.col("_bytes"))) \
        .otherwise(F.concat(F.unhex(F.lit("00")), F.col("_json").cast("binary")))
    return rows.select(*[c for c in logs.columns if c not in PACKED.names], log.alias("log"))


def unpacked_log(rows: DataFrame) -> DataFrame:
    """``LOGS_LANDED`` columns of rows with ``chain_id, block_number`` and ``log``."""
    length = F.conv(F.hex(F.substring("log", 1, 1)), 16, 10).cast("int")
    rest = F.substring("log", F.lit(2), F.lit(1 << 30))
    rows = rows.withColumn("_length", length).withColumn(
        "_odd", F.from_json(F.when(F.col("_length") == 0, rest.cast("string")), PACKED))
    text = F.split(F.substring("log", F.lit(2), F.col("_length")).cast("string"), ",")
    rows = rows.withColumn("_text", F.when(F.col("_length") > 0, text))
    number = {c: F.nullif(F.get("_text", F.lit(i)), F.lit("")).cast("bigint") for i, c in enumerate([*_NUMBERS, "_bits"])}
    there = F.col("_length") > 0
    rows = rows.select("chain_id", "block_number", F.col("_odd"), *[
        F.when(there, n).otherwise(F.lit(0) if c == "_bits" else F.col(f"_odd.{c}")).alias(c) for c, n in number.items()],
        F.col("_odd.data").alias("_data"), F.substring("log", F.col("_length") + 2, F.lit(1 << 30)).alias("_bytes"))
    data = F.coalesce(F.col("data"), F.col("_data")).alias("data")
    out = unpack_logs(rows, [*LOGS_LANDED.names, "_data"])
    return out.select(*[data if f.name == "data" else F.col(f.name).cast(f.dataType).alias(f.name) for f in LOGS_LANDED.fields])


class HoldBack(StatefulProcessor):
    """State of a cell: the highest block released, and the logs above it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ceiling = handle.getValueState("ceiling", "block bigint")
        self.pending = handle.getListState("pending", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.ceiling.get()
        before = ceiling = known[0] if known else -1
        logs = []
        for some in rows:
            ceiling = max(ceiling, int(some["release"].max()))
            logs.append(some.loc[some["release"] < 0, HELD.names])
        logs = pd.concat(logs)
        passes = logs["block_number"] <= ceiling
        waiting = [*logs[~passes].itertuples(index=False, name=None)]
        if passes.any():
            yield logs[passes]
        if ceiling > before:
            self.ceiling.update((ceiling,))
            held = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
            final = [r for r in held if r[1] <= ceiling]
            waiting += [r for r in held if r[1] > ceiling]
            if not final:  # the list stays as it is, with the new logs after it
                waiting = waiting[:len(waiting) - len(held)]
            elif waiting:
                self.pending.put(waiting)
                waiting = []
            else:
                self.pending.clear()
            if final:
                yield pd.DataFrame(final, columns=HELD.names)
        if waiting:
            self.pending.appendList(waiting)

    def close(self) -> None:
        pass


def hold_back(logs: DataFrame, releases: DataFrame, cell_blocks: int = CELL_BLOCKS) -> DataFrame:
    """The stream of final logs (``LOGS_LANDED`` columns).

    ``logs``: a stream of landed rows; ``releases``: a stream of ``chain_id,
    from_block, to_block``."""
    cell = F.floor(F.col("block_number") / cell_blocks).cast("bigint")
    waiting = packed_log(logs.select(*LOGS_LANDED.names)).select(
        "chain_id", "block_number", "log", F.lit(-1).cast("bigint").alias("release"), cell.alias("cell"))
    first, last = (F.floor(F.col(c) / cell_blocks).cast("bigint") for c in ("from_block", "to_block"))
    cut = releases.where("from_block <= to_block and to_block >= 0").select(
        "chain_id", "to_block", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("bigint")), last)).alias("cell"))
    # a release has no log; its numbers must not turn into floats in pandas
    news = cut.select("chain_id", F.lit(0).cast("bigint").alias("block_number"), F.unhex(F.lit("")).alias("log"),
                      F.least(F.col("to_block"), (F.col("cell") + 1) * cell_blocks - 1).alias("release"), "cell")
    held = waiting.unionByName(news).groupBy("chain_id", "cell").transformWithStateInPandas(
        statefulProcessor=HoldBack(), outputStructType=HELD, outputMode="Append", timeMode="None")
    return unpacked_log(held)


def serve_final(logs: DataFrame, releases: DataFrame, out: str, checkpoint: str, cell_blocks: int = CELL_BLOCKS,
                available_now: bool = True, trigger_seconds: int = 1):
    """Write the final logs to ``out``, each micro-batch to a directory of its
    own (``batch_id=N``).  Returns the query."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out.rstrip('/')}/batch_id={int(batch_id)}")

    with keyed_state(logs.sparkSession):
        w = hold_back(logs, releases, cell_blocks).writeStream.foreachBatch(sink).outputMode("append") \
            .option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{trigger_seconds} seconds")
        return w.start()
