"""Single-request queries: a page of logs, one log, height, chains (Q1, Q4, Q5, Q7).

A request becomes a DataFrame plan with literal predicates (no SQL text with
spliced parameters); Catalyst prunes chain/bucket partitions, pushes the
topic/address/block predicates into the Parquet scan and plans
``ORDER BY .. LIMIT`` as a ``TakeOrderedAndProject`` (a k-heap per task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cursor import encode_cursor
from ..functions.formatting import format_logs, hex_projection
from ..operators import filters as P
from ..operators.requests import request_fault
from ..sources import directory
from ..sources.table import read_logs
from ..schema import CHAIN_URL_TEMPLATE, DEFAULT_PAGE_LIMIT, LOG_POSITION
from ..streaming.finality import final_logs


def select_logs(logs: DataFrame, chain_id: int, topic: str, address: str | None = None,
                from_block: int | None = None, to_block: int | None = None,
                cursor: str | None = None, bucket_blocks: int | None = None) -> DataFrame:
    """All logs matching one request, unordered.

    A cursor replaces ``from_block``; ``to_block`` still applies (P7).  A
    request that ``check_requests`` would reject raises ``ValueError`` with its
    reason.  The bucket width comes from the table; ``bucket_blocks`` only
    states what the caller expects, and a different one is refused.
    """
    fault = request_fault(topic, address, from_block, to_block, cursor)
    if fault:
        raise ValueError(fault)
    P.check_width(logs, bucket_blocks)
    df = P.by_topic0(P.by_chain(logs, chain_id), topic)
    df = P.by_address(df, address)
    if cursor is not None:
        b, i = map(int, cursor.split(":"))
        df = P.after_cursor(df, b, i)
    else:
        df = P.from_block(df, from_block if from_block is not None else 0)
    return P.to_block(df, to_block)


def in_position_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*LOG_POSITION)


def get_logs(logs: DataFrame, chain_id: int, topic: str, address: str | None = None,
             from_block: int | None = None, to_block: int | None = None,
             cursor: str | None = None, limit: int | None = DEFAULT_PAGE_LIMIT,
             bucket_blocks: int | None = None, formatted: bool = True,
             ceilings: DataFrame | None = None) -> DataFrame:
    """One page (Q1): matching logs in position order, at most ``limit``.

    With ``ceilings`` (``chain_id, safe``) no block above its chain's ceiling
    is served."""
    if limit is not None:
        fault = request_fault(topic, page_limit=limit)
        if fault:
            raise ValueError(fault)
    if ceilings is not None:
        logs = final_logs(logs, ceilings)
    df = select_logs(logs, chain_id, topic, address, from_block, to_block, cursor, bucket_blocks)
    df = in_position_order(df)
    if limit is not None:
        df = df.limit(limit)
    if not formatted:
        return df
    return format_logs(hex_projection(df))


def page_cursor(page: DataFrame, limit: int, block="blockNumber", index="logIndex") -> DataFrame:
    """Next-page cursor of a page (L7): the last position iff the page is full."""
    last = F.max(F.struct(F.col(block).alias("b"), F.col(index).alias("i")))
    agg = page.agg(F.count(F.lit(1)).alias("page_rows"), last.alias("_last"))
    return agg.select(
        "page_rows",
        F.when(F.col("page_rows") >= limit, encode_cursor(F.col("_last.b"), F.col("_last.i")))
         .alias("next_cursor"))


def get_log(logs: DataFrame, chain_id: int, block: int, index: int,
            bucket_blocks: int | None = None) -> DataFrame:
    """The log at one position (Q4): 0 rows = not found.

    Two different logs can share a position (the key also has topic0 and
    address); the first by ``(topic0, address)`` is returned.
    """
    P.check_width(logs, bucket_blocks)
    df = P.at_position(logs, chain_id, block, index)
    df = df.orderBy("topic0", "address").limit(1)
    return format_logs(hex_projection(df))


def list_chains(logs: DataFrame, url_template: str = CHAIN_URL_TEMPLATE) -> DataFrame:
    """Chains present in the table with their API URL.

    One partial aggregate over the rows, of which only ``chain_id`` is read (on
    a stored table a partition column, but every file is opened);
    :func:`list_served_chains` reads the table's directory instead.
    """
    return _with_url(logs.select("chain_id").distinct(), url_template)


def list_served_chains(spark: SparkSession, path: str, url_template: str = CHAIN_URL_TEMPLATE) -> DataFrame:
    """:func:`list_chains` of a served table, from its directory."""
    return _with_url(directory.per_chain(read_logs(spark, path), path).select("chain_id"), url_template)


def _with_url(ids: DataFrame, url_template: str) -> DataFrame:
    return ids.select(F.col("chain_id").alias("id"),
                      F.format_string(url_template, F.col("chain_id")).alias("url")).orderBy("id")
