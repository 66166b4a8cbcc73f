"""The derived tables every query starts from.

``landed_logs``: raw logs joined to their block headers and decoded (all
copies, with ``ingest_seq``); ``logs``: the keep-last table the queries
serve.  Both are pure DataFrame plans over the given parquet tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decode import attach_block_header, decode_logs, split_valid
from ..operators.dedup import dedup_logs
from ..schema import DEFAULT_BUCKET_BLOCKS
from ..sources import fixtures


def decoded_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = fixtures.raw_blocks(spark, sf_dir, fixtures.log_partitions(spark, sf_dir))
    flat = attach_block_header(fixtures.raw_logs(spark, sf_dir), blocks)
    return decode_logs(flat)


def landed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _bad = split_valid(decoded_logs(spark, sf_dir))
    return good


def logs(spark: SparkSession, sf_dir: str, bucket_blocks: int | None = None) -> DataFrame:
    out = dedup_logs(landed_logs(spark, sf_dir))
    if bucket_blocks:
        out = with_bucket(out, bucket_blocks)
    return out


def with_bucket(df: DataFrame, bucket_blocks: int = DEFAULT_BUCKET_BLOCKS) -> DataFrame:
    """``block_bucket`` and the width it stands for, ``bucket_blocks``."""
    return df.withColumn("bucket_blocks", F.lit(bucket_blocks).cast("bigint")) \
        .withColumn("block_bucket", F.expr("block_number div bucket_blocks"))
