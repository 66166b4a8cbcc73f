"""Output projections and number formatting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SIZE_UNITS
from .hexcodec import hex_col


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The 12-column log projection (F3): numbers as they are, binary as 0x-hex.
LOG_COLUMNS = ["block_number", "timestamp", "block_hash", "transaction_hash",
               "transaction_index", "log_index", "address", "data",
               "topic0", "topic1", "topic2", "topic3"]
_BINARY = {"block_hash", "transaction_hash", "address", "data",
           "topic0", "topic1", "topic2", "topic3"}


def hex_projection(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Select the log projection with ``<col>_hex`` columns for binary ones."""
    cols = [hex_col(c) if c in _BINARY else F.col(c) for c in LOG_COLUMNS]
    return df.select(*(keep or []), *cols)


def topics_array(t0="topic0_hex", t1="topic1_hex", t2="topic2_hex", t3="topic3_hex") -> Column:
    """topic0..3 -> array without NULL or '' entries, order kept."""
    return F.filter(F.array(_c(t0), _c(t1), _c(t2), _c(t3)),
                    lambda x: x.isNotNull() & (x != F.lit("")))


def format_logs(hexed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Hex projection -> API record: camelCase names, numbers as bigint."""
    return hexed.select(
        *(keep or []),
        F.col("address_hex").alias("address"),
        F.col("block_hash_hex").alias("blockHash"),
        F.col("block_number").cast("bigint").alias("blockNumber"),
        F.col("timestamp").cast("bigint").alias("timestamp"),
        F.col("data_hex").alias("data"),
        F.col("log_index").cast("bigint").alias("logIndex"),
        topics_array().alias("topics"),
        F.col("transaction_hash_hex").alias("transactionHash"),
        F.col("transaction_index").cast("bigint").alias("transactionIndex"),
    )


def _exact_div(a: Column, b: Column) -> Column:
    """Integer division of non-negative decimals without rounding artefacts."""
    return ((a - F.pmod(a, b)) / b).cast("decimal(38,0)")


def readable_size(c) -> Column:
    """Bytes -> ``"1.50 MiB"`` in binary units with two decimals.

    The unit is the largest power of 1024 not above the value; the mantissa is
    rounded half-up with exact integer arithmetic, so every engine prints the
    same text.  NULL (no parts at all) -> ``"0 B"``.
    """
    b = _c(c).cast("bigint")
    unit_ix = F.lit(0)
    for i in range(1, len(SIZE_UNITS)):
        unit_ix = F.when(b >= F.lit(1024 ** i), F.lit(i)).otherwise(unit_ix)
    divisor = F.pow(F.lit(1024), unit_ix).cast("decimal(38,0)")
    units = F.array(*[F.lit(u) for u in SIZE_UNITS])
    # cents = (bytes * 100 + divisor / 2) div divisor, exact on decimals
    m = b.cast("decimal(38,0)") * 100 + _exact_div(divisor, F.lit(2).cast("decimal(38,0)"))
    cents = _exact_div(m, divisor).cast("bigint")
    text = F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" "),
                    F.get(units, unit_ix))
    return F.when(b.isNull(), F.lit("0 B")).otherwise(text)


def ratio_half_even(num, den, scale: int = 2) -> Column:
    """``round(num / den, scale)`` with exact half-to-even rounding.

    Computed on integers, so the result does not depend on how an engine
    rounds a binary double.  Division by zero -> 0 (the service's default).
    """
    n = _c(num).cast("decimal(38,0)")
    d = _c(den).cast("decimal(38,0)")
    p = 10 ** scale
    q = _exact_div(n * p, d)
    r = F.pmod(n * p, d)
    up = (2 * r > d) | ((2 * r == d) & (q % 2 == 1))
    res = (q + F.when(up, 1).otherwise(0)).cast("bigint") / F.lit(float(p))
    return F.when((d == 0) | d.isNull() | n.isNull(), F.lit(0.0)).otherwise(res)


def percent_half_up(num, den, scale: int = 2) -> Column:
    """``round(100 * num / den, scale)`` rounding half up, exactly.

    For non-negative inputs; ``den <= 0`` -> 0 (the service's guard).
    """
    n = _c(num).cast("decimal(38,0)")
    d = _c(den).cast("decimal(38,0)")
    p = 10 ** scale
    q = _exact_div(n * (100 * p) * 2 + d, d * 2)
    return F.when((d <= 0) | d.isNull() | n.isNull(), F.lit(0.0)) \
        .otherwise(q.cast("bigint") / F.lit(float(p)))
