"""The directory of a served table: small aggregates that compaction maintains.

Beside the rows of a served table, under ``<table>/_directory`` (which scans of
the table skip), compaction keeps

* ``buckets``: one row per (chain, bucket) with its rows and lowest and highest
  block, and the table's widths.  Every compaction writes a whole new
  generation, a row per directory of the table, so readers always see one
  state; the last two generations are kept.
* ``streams``: rows per (topic stream or topic+address stream, rank cell),
  partitioned like the table, so a compaction replaces exactly the partitions
  that it rewrites.

Heights, counts, chains, widths and the plans of batched requests read these
instead of the table.  While a compaction replaces partitions, and after one
that died in between, the directory is marked pending and the same aggregates
are taken from the rows: slower, never stale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = ["bucket_blocks", "cell_blocks", "chain_id", "block_bucket"]
_KEY = "bucket_blocks bigint, cell_blocks bigint, chain_id bigint, block_bucket bigint"
BUCKETS = f"{_KEY}, rows bigint, low bigint, high bigint"
STREAMS = f"topic0 binary, skey binary, cell bigint, cell_rows bigint, {_KEY}"
KEPT_GENERATIONS = 2


class _Files:
    """Files of a table's directory, through the cluster's file system."""

    def __init__(self, spark: SparkSession, table: str) -> None:
        self.root = f"{table.rstrip('/')}/_directory"
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.root}/{name}"))

    def touch(self, name: str) -> None:
        self.fs.create(self.path(f"{self.root}/{name}"), True).close()

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)

    def generations(self) -> list[int]:
        """Complete generations of ``buckets``, oldest first."""
        if not self.exists("buckets"):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.root}/buckets"))]
        numbers = sorted(int(x.partition("=")[2]) for x in found if x.startswith("generation="))
        return [n for n in numbers if self.exists(f"buckets/generation={n}/_SUCCESS")]


def bucket_rows(served: DataFrame) -> DataFrame:
    """Rows and block extent of every (chain, bucket) of stored rows."""
    return served.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("rows"), F.min("block_number").alias("low"),
                                           F.max("block_number").alias("high"))


def stream_rows(served: DataFrame) -> DataFrame:
    """Rows of every stream in every rank cell; ``skey`` is empty for a topic
    stream and the address for a topic+address stream."""
    cell = F.expr("block_number div cell_blocks").alias("cell")
    streams = served.select(*PARTITIONS, "topic0", cell, F.explode(F.array(F.unhex(F.lit("")), F.col("address"))).alias("skey"))
    return streams.groupBy(*PARTITIONS, "topic0", "skey", "cell").agg(F.count(F.lit(1)).alias("cell_rows"))


def counted_streams(rewritten: DataFrame) -> DataFrame:
    """:func:`stream_rows` of rows that carry their streams' counts, as
    compaction writes them: no exchange, and a bucket's rows stay in the task
    that reads its file."""
    last = F.array(F.when(F.col("topic_rows").isNotNull(), F.struct(F.unhex(F.lit("")).alias("skey"), F.col("topic_rows").alias("n"))),
                   F.when(F.col("address_rows").isNotNull(), F.struct(F.col("address").alias("skey"), F.col("address_rows").alias("n"))))
    found = rewritten.select(*PARTITIONS, "topic0", F.expr("block_number div cell_blocks").alias("cell"),
                             F.explode(F.filter(last, lambda x: x.isNotNull())).alias("s"))
    return found.select(*PARTITIONS, "topic0", F.col("s.skey").alias("skey"), "cell", F.col("s.n").alias("cell_rows"))


def begin(spark: SparkSession, table: str) -> None:
    """Mark the directory before rows of the table are replaced."""
    _Files(spark, table).touch("pending")


def record(served: DataFrame, rewritten: DataFrame, table: str) -> None:
    """Bring the directory up to date after a compaction.

    ``rewritten``: the rows of the partitions that were replaced (all rows for
    a new table); ``served``: the whole table, read only where there is no
    earlier generation to build on."""
    spark, files = served.sparkSession, _Files(served.sparkSession, table)
    streams = counted_streams(rewritten).sortWithinPartitions(*PARTITIONS, "topic0", "skey", "cell")
    (streams.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").mode("overwrite")
     .partitionBy(*PARTITIONS).parquet(f"{files.root}/streams"))
    known = files.generations()
    if known:
        new = bucket_rows(rewritten)
        old = _generation(spark, files, known[-1]).join(new.select(*PARTITIONS), PARTITIONS, "left_anti")
        buckets = old.unionByName(new)
    else:
        buckets = bucket_rows(served)
    number = known[-1] + 1 if known else 0
    buckets.hint("rebalance").write.mode("overwrite").parquet(f"{files.root}/buckets/generation={number}")
    files.drop("pending")
    for old in known[:-(KEPT_GENERATIONS - 1)]:
        files.drop(f"buckets/generation={old}")


def _generation(spark: SparkSession, files: _Files, number: int) -> DataFrame:
    return spark.read.schema(BUCKETS).parquet(f"{files.root}/buckets/generation={number}")


def buckets(served: DataFrame, table: str) -> DataFrame:
    """``BUCKETS`` of the table as it is now."""
    spark, files = served.sparkSession, _Files(served.sparkSession, table)
    known = [] if files.exists("pending") else files.generations()
    return _generation(spark, files, known[-1]) if known else bucket_rows(served)


def streams(served: DataFrame, table: str) -> DataFrame:
    """``STREAMS`` of the table as it is now."""
    spark, files = served.sparkSession, _Files(served.sparkSession, table)
    if files.exists("pending") or not files.exists("streams"):
        return stream_rows(served)
    return spark.read.schema(STREAMS).parquet(f"{files.root}/streams")


def widths(served: DataFrame, table: str) -> list[tuple[int, int]]:
    """(blocks per bucket, blocks per rank cell) of the table; one pair unless
    layouts are mixed."""
    return sorted(tuple(r) for r in buckets(served, table).select("bucket_blocks", "cell_blocks").distinct().collect())


def per_chain(served: DataFrame, table: str) -> DataFrame:
    """``chain_id, rows, high`` of every chain in the table."""
    return buckets(served, table).groupBy("chain_id").agg(F.sum("rows").alias("rows"), F.max("high").alias("high"))
