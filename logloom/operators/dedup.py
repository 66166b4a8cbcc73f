"""Keep-last deduplication of the logs table.

One row per key ``(chain_id, topic0, block_number, log_index, address)``;
the newest insertion (highest ``ingest_seq``) wins.  Rows with the same key
and the same ``ingest_seq`` are broken deterministically by
``transaction_hash, data``.

The key is (near) unique, so hashing on it spreads rows evenly whatever the
skew of any single column; each window group holds only the copies of one
log.  ``row_number() = 1`` lets Spark insert a ``WindowGroupLimit`` that
drops superseded copies before the sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import LOG_KEY


def dedup_logs(landed: DataFrame, key: list[str] = LOG_KEY, keep_seq: bool = False,
               partitions: int | None = None) -> DataFrame:
    """Keep the newest copy of every key.

    Extra columns that are functions of the key (``block_bucket``) may be added
    to ``key``; that lets an enclosing job reuse one exchange for this window
    and its own windows.  ``partitions`` is the number for the exchange on the
    key (the session's if not given), for rows that are not clustered yet.
    """
    if partitions:
        landed = landed.repartition(partitions, *key)
    w = Window.partitionBy(*key).orderBy(F.col("ingest_seq").desc(),
                                         F.col("transaction_hash"), F.col("data"))
    out = landed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    return out if keep_seq else out.drop("ingest_seq")
