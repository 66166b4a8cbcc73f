"""Request tables: validation and normalisation.

A request table has one row per ``/logs`` call:
``request_id, chain_id, topic, address, from_block, to_block, cursor,
page_limit``.  :func:`check_requests` splits it into valid requests in a
normalised form (binary topic/address, one lower bound, defaults applied)
and rejected ones with a ``reject_reason``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cursor import cursor_fits, decode_cursor
from ..functions.hexcodec import hex_to_bytes, strip_prefix
from ..schema import CURSOR_PATTERN, DEFAULT_PAGE_LIMIT, MAX_PAGE_LIMIT


def check_requests(requests: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejected requests).

    Valid rows carry ``topic0``/``address`` as binary, ``lo_block``/``lo_index``
    (strict lower bound on ``(block_number, log_index)``; ``lo_index = -1``
    means ``block_number >= lo_block``), ``hi_block`` (NULL = open) and
    ``page_limit``.  A cursor replaces ``from_block``.

    The chain list is configuration (tens of rows): broadcast.
    """
    known = F.broadcast(chains.select(F.col("chain_id").alias("_known")).distinct())
    r = requests.join(known, requests.chain_id == known._known, "left")
    topic_digits = strip_prefix(F.col("topic"))
    addr_digits = strip_prefix(F.col("address"))
    limit = F.coalesce(F.col("page_limit"), F.lit(DEFAULT_PAGE_LIMIT).cast("bigint"))
    from_b = F.coalesce(F.col("from_block"), F.lit(0).cast("bigint"))
    reason = F.coalesce(
        F.when(F.col("_known").isNull(), F.lit("unknown_chain")),
        F.when(F.col("topic").isNull(), F.lit("topic_missing")),
        F.when(~topic_digits.rlike(r"^[0-9a-fA-F]{0,64}$"), F.lit("topic_invalid")),
        F.when(F.col("address").isNotNull() & ~addr_digits.rlike(r"^[0-9a-fA-F]{1,40}$"),
               F.lit("address_invalid")),
        F.when(from_b < 0, F.lit("from_block_negative")),
        F.when(F.col("to_block") < 0, F.lit("to_block_negative")),
        F.when((limit < 1) | (limit > MAX_PAGE_LIMIT), F.lit("bad_limit")),
        F.when(F.col("cursor").isNotNull() & ~(F.col("cursor").rlike(CURSOR_PATTERN)
                                               & F.coalesce(cursor_fits("cursor"), F.lit(False))),
               F.lit("bad_cursor")),
    )
    checked = r.withColumn("reject_reason", reason).drop("_known")
    cb, ci = decode_cursor(F.col("cursor"))
    has_cursor = F.col("cursor").isNotNull()
    ok = checked.where(F.col("reject_reason").isNull()).select(
        "request_id", "chain_id",
        hex_to_bytes(F.col("topic"), 32).alias("topic0"),
        hex_to_bytes(F.col("address"), 20).alias("address"),
        F.when(has_cursor, cb).otherwise(from_b).alias("lo_block"),
        F.when(has_cursor, ci).otherwise(F.lit(-1).cast("bigint")).alias("lo_index"),
        F.col("to_block").alias("hi_block"),
        limit.alias("page_limit"),
    )
    bad = checked.where(F.col("reject_reason").isNotNull())
    return ok, bad


_LONG_MAX = (1 << 63) - 1


def request_fault(topic: str | None, address: str | None = None, from_block: int | None = None,
                  to_block: int | None = None, cursor: str | None = None,
                  page_limit: int | None = None) -> str | None:
    """The ``reject_reason`` that :func:`check_requests` gives such a request
    (its chain aside), or None.  The single-request API raises it."""
    bare = lambda x: x[2:] if x[:2] in ("0x", "0X") else x
    limit = DEFAULT_PAGE_LIMIT if page_limit is None else page_limit
    if topic is None:
        return "topic_missing"
    if not re.fullmatch("[0-9a-fA-F]{0,64}", bare(topic)):
        return "topic_invalid"
    if address is not None and not re.fullmatch("[0-9a-fA-F]{1,40}", bare(address)):
        return "address_invalid"
    if from_block is not None and from_block < 0:
        return "from_block_negative"
    if to_block is not None and to_block < 0:
        return "to_block_negative"
    if not 1 <= limit <= MAX_PAGE_LIMIT:
        return "bad_limit"
    if cursor is not None and not (re.fullmatch(CURSOR_PATTERN.strip("^$"), cursor)
                                   and all(int(x) <= _LONG_MAX for x in cursor.split(":"))):
        return "bad_cursor"
    return None
