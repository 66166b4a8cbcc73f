"""Logs as few narrow values, for an exchange.

A shuffled row pays for every column.  :func:`pack_logs` puts the binary columns
of landed logs into one value: those that have their declared width one after
another, a bit for each that is there, then ``data``.  A row with a value of
another width keeps it beside, in a column that is NULL otherwise.  Packing is
plain expressions, and unpacking gives back exactly what was packed, nulls and
odd widths included.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FIXED_WIDTH_BYTES

_BITS = {name: 1 << i for i, name in enumerate([*FIXED_WIDTH_BYTES, "data"])}
_REST = 1 << 30  # more bytes than a value has


def _nothing() -> Column:
    return F.unhex(F.lit(""))


def pack_logs(logs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``logs`` with ``_bits``, ``_bytes`` and ``_odd`` in place of those binary
    columns of landed logs that it has; those of ``keep`` stay columns."""
    fixed = {c: w for c, w in FIXED_WIDTH_BYTES.items() if c in logs.columns and c not in keep}
    fits = {c: F.coalesce(F.octet_length(c) == w, F.lit(False)) for c, w in fixed.items()}
    odd = F.lit(False)
    for c in fixed:
        odd = odd | (F.col(c).isNotNull() & ~fits[c])
    there = fits | ({"data": F.col("data").isNotNull()} if "data" in logs.columns else {})
    bits = sum((F.when(yes, _BITS[c]).otherwise(0) for c, yes in there.items()), F.lit(0))
    parts = [F.when(yes, F.col(c)).otherwise(_nothing()) for c, yes in there.items()]
    rest = [c for c in logs.columns if c not in fixed and c != "data"]
    # what rows of one block share comes first, for the sake of compression
    places = [c for c in rest if c in ("transaction_index", "log_index")]
    shared = [c for c in rest if c not in places and c not in ("block_number", "timestamp")]
    odd = F.when(odd, F.struct(*[F.when(~fits[c], F.col(c)).alias(c) for c in fixed]))
    return logs.select(*shared, *[c for c in ("block_number", "timestamp") if c in rest], odd.alias("_odd"),
                       bits.alias("_bits"), *places, F.concat(*parts).alias("_bytes"))


def unpack_logs(packed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that :func:`pack_logs` was given, with its ``columns``."""
    kept = [c for c in packed.columns if c not in ("_bits", "_bytes", "_odd")]
    out, start = {c: F.col(c) for c in kept}, F.lit(1)
    for c, w in FIXED_WIDTH_BYTES.items():
        if c in kept or c not in columns:
            continue
        there = F.col("_bits").bitwiseAND(F.lit(_BITS[c])) != 0
        out[c] = F.when(there, F.substring("_bytes", start, F.lit(w))).otherwise(F.col(f"_odd.{c}"))
        start = start + F.when(there, w).otherwise(0)
    there = F.col("_bits").bitwiseAND(F.lit(_BITS["data"])) != 0
    if "data" in columns:
        out["data"] = F.when(there, F.substring("_bytes", start, F.lit(_REST)))
    return packed.select(*[out[c].alias(c) for c in columns])


def exchanged_logs(logs: DataFrame, exchange: Callable[[DataFrame], DataFrame], keep: tuple[str, ...] = ()) -> DataFrame:
    """``exchange(logs)``, a repartition by columns that stay columns, of packed rows."""
    return unpack_logs(exchange(pack_logs(logs, keep)), logs.columns)
