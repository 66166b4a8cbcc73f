"""Distributed running aggregates (prefix sum / prefix max / row number).

A plain ``Window.partitionBy(k).orderBy(o)`` sorts a whole key group in one
task.  When a key can hold a large share of the rows (one chain, one hot
topic), that is one task doing all the work.  These helpers use the two-level
scan instead:

1. cut each key group into chunks of the ordering column (``chunk`` is a
   monotone function of the order, e.g. ``floor(seq / 100_000)``) and run the
   window inside ``(key, chunk)``;
2. aggregate each chunk to one row and run the same window over the chunk
   totals of a key (a few rows per chunk, so the second window is small);
3. combine the carry of the preceding chunks with the in-chunk value.

Every task holds at most one chunk, whatever the skew of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def running_agg(df: DataFrame, by: list[str], order: list[str], value: str | Column,
                chunk: Column, how: str = "sum", inclusive: bool = True,
                out: str = "running") -> DataFrame:
    """Add ``out`` = running ``how`` (``sum`` or ``max``) of ``value`` over
    ``order`` within ``by``; ``inclusive=False`` excludes the current row.

    ``order`` must be a total order inside each ``by`` group and ``chunk``
    must not decrease along it.
    """
    if how not in ("sum", "max"):
        raise ValueError(how)
    agg = F.sum if how == "sum" else F.max
    val = F.col(value) if isinstance(value, str) else value
    keyed = df.withColumn("_chunk", chunk).withColumn("_val", val)
    upper = Window.currentRow if inclusive else -1
    w_local = (Window.partitionBy(*by, "_chunk").orderBy(*_cols(order))
               .rowsBetween(Window.unboundedPreceding, upper))
    local = keyed.withColumn("_local", agg("_val").over(w_local))

    totals = local.groupBy(*by, "_chunk").agg(agg("_val").alias("_tot"))
    w_carry = (Window.partitionBy(*by).orderBy("_chunk")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = totals.select(*by, "_chunk", agg("_tot").over(w_carry).alias("_carry"))

    joined = local.join(carry, on=[*by, "_chunk"], how="left")
    if how == "sum":
        # an empty frame (first row, exclusive) counts as 0
        res = F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0))
    else:
        # greatest() skips NULLs; NULL only when nothing precedes
        res = F.greatest(F.col("_carry"), F.col("_local"))
    return joined.withColumn(out, res).drop("_chunk", "_val", "_local", "_carry")


def chunked_row_number(df: DataFrame, by: list[str], order: list[str], chunk: Column,
                       out: str = "n") -> DataFrame:
    """1-based row number over ``order`` within ``by``, computed chunk-wise."""
    return running_agg(df, by, order, F.lit(1).cast("bigint"), chunk, "sum", True, out)
