"""Predicates of the log queries.

Every filter is a plain ``where`` so Catalyst pushes it to the Parquet scan.
When the frame carries the partition columns ``block_bucket`` and
``bucket_blocks`` (the width the table was written with), block bounds also
add the implied bucket bound (Catalyst cannot infer it), which turns into
partition pruning on the stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexcodec import hex_literal


def _check_hex(value: str, width: int, what: str) -> str:
    """Validate a request literal: optional ``0x``, 0..2*width hex digits."""
    digits = value[2:] if value[:2] in ("0x", "0X") else value
    if len(digits) > 2 * width or any(c not in "0123456789abcdefABCDEF" for c in digits):
        raise ValueError(f"invalid {what}: {value!r}")
    return value


def _bucket_bound(df: DataFrame, op: str, n: int) -> DataFrame:
    """The bucket bound that a block bound implies, for a table that carries
    its own bucket width (``bucket_blocks``, a partition column like
    ``block_bucket``): pruned by partition at any width, also mixed ones."""
    if "block_bucket" not in df.columns or "bucket_blocks" not in df.columns:
        return df
    return df.where(F.expr(f"block_bucket {op} {int(n)}L div bucket_blocks"))


def check_width(df: DataFrame, bucket_blocks: int | None) -> None:
    """Refuse a width that is not the table's own (metadata of a few values)."""
    if bucket_blocks is not None and "bucket_blocks" in df.columns:
        found = [r[0] for r in df.select("bucket_blocks").distinct().collect()]
        if any(w != bucket_blocks for w in found):
            raise ValueError(f"the table's buckets hold {found} blocks, not {bucket_blocks}")


def by_chain(df: DataFrame, chain_id: int) -> DataFrame:
    return df.where(F.col("chain_id") == F.lit(chain_id).cast("bigint"))


def by_topic0(df: DataFrame, topic_hex: str) -> DataFrame:
    """Required topic; any case, any length up to 32 bytes (left-padded)."""
    return df.where(F.col("topic0") == hex_literal(_check_hex(topic_hex, 32, "topic"), 32))


def by_address(df: DataFrame, address_hex: str | None) -> DataFrame:
    """Optional emitting address; ``None`` adds no clause."""
    if address_hex is None:
        return df
    if address_hex in ("", "0x", "0X"):
        raise ValueError("empty address: pass None for no address filter")
    return df.where(F.col("address") == hex_literal(_check_hex(address_hex, 20, "address"), 20))


def from_block(df: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return df
    return _bucket_bound(df.where(F.col("block_number") >= F.lit(n).cast("bigint")), ">=", n)


def to_block(df: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return df
    return _bucket_bound(df.where(F.col("block_number") <= F.lit(n).cast("bigint")), "<=", n)


def block_range(df: DataFrame, lo: int | None, hi: int | None,
                block_col: str = "block_number") -> DataFrame:
    """Blocks ``lo..hi``, inclusive on both ends (S2); ``None`` = open."""
    if block_col != "block_number":
        c = F.col(block_col)
        if lo is not None:
            df = df.where(c >= lo)
        if hi is not None:
            df = df.where(c <= hi)
        return df
    return to_block(from_block(df, lo), hi)


def cursor_condition(block: Column, index: Column) -> Column:
    """``(block_number, log_index) > (block, index)``, written so that the
    ``block_number >= block`` half is pushed down to the scan (P6)."""
    return (F.col("block_number") >= block) & (
        (F.col("block_number") > block) | (F.col("log_index") > index))


def after_cursor(df: DataFrame, block: int, index: int) -> DataFrame:
    out = df.where(cursor_condition(F.lit(block).cast("bigint"), F.lit(index).cast("bigint")))
    return _bucket_bound(out, ">=", block)


def at_position(df: DataFrame, chain_id: int, block: int, index: int) -> DataFrame:
    """One position of one chain."""
    out = df.where((F.col("chain_id") == F.lit(chain_id).cast("bigint"))
                   & (F.col("block_number") == F.lit(block).cast("bigint"))
                   & (F.col("log_index") == F.lit(index).cast("bigint")))
    return _bucket_bound(out, "=", block)


def known_chain(df: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of configured chains, rows of unknown chains).

    The chain table is a fixed configuration list (tens of rows), so it is
    broadcast; semi and anti joins keep the large side in place.
    """
    c = F.broadcast(chains.select("chain_id").distinct())
    return df.join(c, "chain_id", "left_semi"), df.join(c, "chain_id", "left_anti")


def split_height_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``Height`` events, ``Reconnecting`` notices)."""
    return (events.where(F.col("type") == "Height"),
            events.where(F.col("type") == "Reconnecting"))
