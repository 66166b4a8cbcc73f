"""Decode raw events into typed ``logs`` rows (one ``select``, no UDF).

Raw input comes in two shapes:

* nested events ``{chain_id, ingest_seq, block{number,timestamp}, log{...}}``
  as the archive delivers them (:func:`flatten_events`);
* flat logs + block headers (:func:`attach_block_header`).

Both become one flat frame with a ``topics`` array and a ``has_block``
flag; :func:`decode_logs` turns that into binary columns plus a
``reject_reason`` (NULL for good rows) and :func:`split_valid` separates the
two.  Required-field violations are quarantined instead of guessed at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexcodec import hex_digits_ok, hex_to_bytes, strip_prefix, var_hex_ok
from ..schema import FIXED_WIDTH_BYTES, LOGS_LANDED

FLAT_COLUMNS = ["chain_id", "ingest_seq", "block_number", "block_hash", "timestamp",
                "transaction_hash", "transaction_index", "log_index", "address", "data",
                "topics", "removed", "has_block"]


def flatten_events(events: DataFrame) -> DataFrame:
    """Nested raw events -> flat frame (S4 field selection)."""
    return events.select(
        F.col("chain_id").cast("bigint").alias("chain_id"),
        F.coalesce(F.col("ingest_seq"), F.lit(0)).cast("bigint").alias("ingest_seq"),
        F.col("log.blockNumber").alias("block_number"),
        F.col("log.blockHash").alias("block_hash"),
        F.col("block.timestamp").alias("timestamp"),
        F.col("log.transactionHash").alias("transaction_hash"),
        F.col("log.transactionIndex").alias("transaction_index"),
        F.col("log.logIndex").alias("log_index"),
        F.col("log.address").alias("address"),
        F.col("log.data").alias("data"),
        F.col("log.topics").alias("topics"),
        F.col("log.removed").alias("removed"),
        F.col("block").isNotNull().alias("has_block"),
    )


def select_fields(events: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The 12 log + 2 block fields of nested events, flat (S4); ``cols``
    narrows further (Catalyst prunes nested fields in the scan)."""
    flat = flatten_events(events)
    return flat.select(*cols) if cols else flat


def tag_chain(df: DataFrame, chain_id: int) -> DataFrame:
    """Constant chain column for single-chain input."""
    return df.withColumn("chain_id", F.lit(chain_id).cast("bigint"))


def topics_from_columns(t0="t0", t1="t1", t2="t2", t3="t3") -> Column:
    """Flat ``t0..t3`` -> topics array without NULLs (order kept)."""
    return F.filter(F.array(F.col(t0), F.col(t1), F.col(t2), F.col(t3)), lambda x: x.isNotNull())


def attach_block_header(logs: DataFrame, blocks: DataFrame, how: str = "left") -> DataFrame:
    """Join each flat raw log to its block header.

    Equi-join on ``(chain_id, block_number)``; many logs to one block.  The
    join is left so that logs without a header are kept and quarantined
    (``has_block`` false) rather than silently dropped.  Catalyst picks the
    strategy: a broadcast when the header side is measured small by AQE,
    otherwise a sort-merge join co-partitioned on the key.
    """
    b = blocks.select(
        F.col("chain_id").alias("_b_chain"), F.col("number").alias("_b_number"),
        F.col("timestamp").alias("_b_timestamp"), F.col("block_hash").alias("_b_hash"))
    j = logs.join(b, (logs.chain_id == b._b_chain) & (logs.block_number == b._b_number), how)
    topics = F.col("topics") if "topics" in logs.columns else topics_from_columns()
    return j.select(
        F.col("chain_id"), F.coalesce(F.col("ingest_seq"), F.lit(0)).cast("bigint").alias("ingest_seq"),
        F.col("block_number"), F.col("_b_hash").alias("block_hash"),
        F.col("_b_timestamp").alias("timestamp"),
        "transaction_hash", "transaction_index", "log_index", "address", "data",
        topics.alias("topics"), "removed",
        F.col("_b_number").isNotNull().alias("has_block"),
    )


def split_topics(topics: Column) -> list[Column]:
    """``topics`` array -> topic0 text (missing -> '') and nullable topic1..3.

    ``get`` returns NULL past the end (``element_at`` would raise under ANSI
    mode); empty strings count as absent.  Items beyond the fourth are ignored.
    """
    t0 = F.coalesce(F.get(topics, 0), F.lit(""))
    rest = [F.nullif(F.get(topics, i), F.lit("")) for i in (1, 2, 3)]
    return [t0, *rest]


def _fixed_reason(name: str, c: Column, width: int, required: bool = True) -> Column:
    digits = strip_prefix(c)
    missing = c.isNull() if required else F.lit(False)
    return (F.when(missing, F.lit(f"{name}_missing"))
            .when(~hex_digits_ok(c), F.lit(f"{name}_hex"))
            .when(F.length(digits) > 2 * width, F.lit(f"{name}_length")))


def decode_logs(flat: DataFrame, chain_id: int | None = None) -> DataFrame:
    """Flat raw frame -> LOGS_LANDED columns + ``reject_reason``.

    ``chain_id`` tags single-chain input (S13); multi-chain input carries the
    column already.
    """
    if chain_id is not None:
        flat = tag_chain(flat, chain_id)
    t0, t1, t2, t3 = split_topics(F.col("topics"))
    text = {
        "block_hash": F.col("block_hash"),
        "transaction_hash": F.col("transaction_hash"),
        "address": F.col("address"),
        "topic0": t0,
        "topic1": t1,
        "topic2": t2,
        "topic3": t3,
    }
    checks = [
        F.when(~F.col("has_block"), F.lit("block_missing")),
        F.when(F.col("chain_id").isNull(), F.lit("chain_id_missing")),
        F.when(F.col("block_number").isNull(), F.lit("block_number_missing")),
        F.when(F.col("timestamp").isNull(), F.lit("timestamp_missing")),
        F.when(F.col("log_index").isNull(), F.lit("log_index_missing")),
        F.when(F.col("transaction_index").isNull(), F.lit("transaction_index_missing")),
        _fixed_reason("block_hash", text["block_hash"], 32),
        _fixed_reason("transaction_hash", text["transaction_hash"], 32),
        _fixed_reason("address", text["address"], 20),
        F.when(F.col("data").isNull(), F.lit("data_missing"))
         .when(~var_hex_ok(F.col("data")), F.lit("data_hex")),
        _fixed_reason("topic0", t0, 32),
        _fixed_reason("topic1", t1, 32, required=False),
        _fixed_reason("topic2", t2, 32, required=False),
        _fixed_reason("topic3", t3, 32, required=False),
    ]
    reason = F.coalesce(*checks)
    cols = {
        "chain_id": F.col("chain_id").cast("bigint"),
        "block_number": F.col("block_number").cast("bigint"),
        "timestamp": F.col("timestamp").cast("bigint"),
        "transaction_index": F.col("transaction_index").cast("bigint"),
        "log_index": F.col("log_index").cast("bigint"),
        "data": hex_to_bytes(F.col("data")),
        "removed": F.coalesce(F.col("removed").cast("boolean"), F.lit(False)).cast("smallint"),
        "ingest_seq": F.col("ingest_seq").cast("bigint"),
    }
    for name, c in text.items():
        cols[name] = hex_to_bytes(c, FIXED_WIDTH_BYTES[name])
    out = [cols[f.name].alias(f.name) for f in LOGS_LANDED.fields]
    return flat.select(*out, reason.alias("reject_reason"))


def split_valid(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows in LOGS_LANDED shape, quarantined rows with their reason)."""
    good = decoded.where(F.col("reject_reason").isNull()).drop("reject_reason")
    bad = decoded.where(F.col("reject_reason").isNotNull())
    return conform(good), bad


def conform(df: DataFrame) -> DataFrame:
    """Fixed column order, types and nullability of the landed table."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOGS_LANDED.fields])
