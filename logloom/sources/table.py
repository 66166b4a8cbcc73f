"""The stored ``logs`` table: landing batches, compaction, reads, footprint.

Layout (SURVEY §4.3):

* **landing** (append only): ``<root>/source=S/batch_id=N/`` Parquet, every
  copy of every row with its ``ingest_seq``.  Re-writing a batch overwrites exactly
  its own directory, so a replayed batch is harmless (S15, T5).
* **served**: the output of :func:`compact_logs`: keep-last rows,
  ``partitionBy(bucket_blocks, cell_blocks, chain_id, block_bucket)``, so the
  table itself tells the widths of its buckets and rank cells, sorted inside files by
  ``(topic0, block_number, log_index, address)`` so Parquet min/max statistics
  prune row groups for topic and block predicates, zstd, and a bloom filter
  on ``address`` (dictionary encoding is switched off for that column, else
  no bloom filter is written).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import dedup_logs
from ..operators.packed import exchanged_logs
from ..plans.tables import with_bucket
from ..streaming.finality import final_logs
from . import directory
from ..session import materialize, partitions_for
from ..schema import DEFAULT_BUCKET_BLOCKS, FLUSH_ROWS, LOG_KEY, LOGS_LANDED, LOGS_STORED

LANDED_WITH_BATCH = T.StructType(LOGS_LANDED.fields + [T.StructField("batch_id", T.LongType(), True)])
LANDED_WITH_SOURCE = T.StructType(LANDED_WITH_BATCH.fields + [T.StructField("source", T.StringType(), True)])
SORT_KEY = ["bucket_blocks", "cell_blocks", "chain_id", "block_bucket", "topic0", "block_number", "log_index", "address"]


def append_logs(df: DataFrame, root: str, batch_id: int, max_records_per_file: int = FLUSH_ROWS,
                source: str = "batch") -> str:
    """Write one landed batch to ``root/source=S/batch_id=N`` (replay-safe
    overwrite).  Batch numbers are a source's own: two streams, or a stream
    restarted on a new checkpoint, never overwrite each other."""
    path = f"{root.rstrip('/')}/source={quote(source, safe='')}/batch_id={int(batch_id)}"
    (df.select(*[f.name for f in LOGS_LANDED.fields])
       .write.mode("overwrite").option("compression", "zstd")
       .option("maxRecordsPerFile", max_records_per_file).parquet(path))
    return path


def read_landed(spark: SparkSession, root: str, with_source: bool = False) -> DataFrame:
    """All landed batches (with ``batch_id``), fixed schema, no inference."""
    df = spark.read.schema(LANDED_WITH_SOURCE).parquet(root)
    return df if with_source else df.drop("source")


def read_logs(spark: SparkSession, path: str, footer_aggregates: bool = False) -> DataFrame:
    """The served table (S19); ``chain_id``/``block_bucket`` are partition
    columns typed by the declared schema.

    ``footer_aggregates=True`` binds the read to the DataSource V2 Parquet
    scan, which answers ``count``/``min``/``max`` (optionally under a
    partition filter) from file footers without reading rows.  The choice is
    made when the relation is created, so the session setting is restored
    right after.
    """
    if not footer_aggregates:
        return spark.read.schema(LOGS_STORED).parquet(path)
    key = "spark.sql.sources.useV1SourceList"
    prev = spark.conf.get(key)
    spark.conf.set(key, ",".join(x for x in prev.split(",") if x.strip() != "parquet"))
    try:
        return spark.read.schema(LOGS_STORED).parquet(path)
    finally:
        spark.conf.set(key, prev)


BLOOM_SIZES = 14


def _writer(df: DataFrame):
    # The bloom filter is sized by the addresses that its row group has: the
    # smallest of BLOOM_SIZES halvings of 1 MB that holds them at 1%.  A file
    # holds at most FLUSH_ROWS rows, which 1 MB is enough for, so the
    # false-positive rate holds however large the table is, and many small
    # buckets cost no more than their rows.
    return (df.write
            .option("compression", "zstd")
            .option("maxRecordsPerFile", FLUSH_ROWS)
            .option("parquet.bloom.filter.enabled#address", "true")
            .option("parquet.bloom.filter.fpp#address", "0.01")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .option("parquet.bloom.filter.candidates.number#address", str(BLOOM_SIZES))
            .option("parquet.bloom.filter.max.bytes", str(1024 * 1024))
            .option("parquet.enable.dictionary#address", "false")
            .partitionBy("bucket_blocks", "cell_blocks", "chain_id", "block_bucket"))


def layout(df: DataFrame, partitions: int | None = None, clustered: bool = False) -> DataFrame:
    """Cluster rows by output partition and sort them inside each task.

    ``clustered`` rows have each output partition in one task already and are
    only sorted.  Else ``rebalance`` hashes on the partition columns and lets AQE split a skewed
    ``(chain, bucket)`` over several tasks (and merge small ones) from the
    measured shuffle sizes -- no sampling pass over the input, unlike a range
    partitioner.  ``partitions`` forces a range partitioning instead.
    """
    if partitions:
        df = df.repartitionByRange(partitions, *SORT_KEY[:6])
    elif not clustered:
        df = df.hint("rebalance", "bucket_blocks", "cell_blocks", "chain_id", "block_bucket")
    return df.sortWithinPartitions(*SORT_KEY)


def default_cell(bucket_blocks: int) -> int:
    """Blocks of a rank cell: a storage bucket, or a narrower standard cell
    where the bucket is a multiple of it."""
    return DEFAULT_BUCKET_BLOCKS if bucket_blocks % DEFAULT_BUCKET_BLOCKS == 0 else bucket_blocks


def dedup_landed(landed: DataFrame) -> DataFrame:
    """Keep-last of stored landed rows, whose number their footers tell.

    The one exchange is on (chain, block), as for the header join: the logs of
    a block travel side by side, packed, so what they share is sent once."""
    parts = partitions_for(landed.sparkSession, landed.count())
    return dedup_logs(exchanged_logs(landed, lambda rows: rows.repartition(parts, "chain_id", "block_number")))


def served_rows(landed: DataFrame, bucket_blocks: int = DEFAULT_BUCKET_BLOCKS,
                cell_blocks: int | None = None, rows: int | None = None) -> DataFrame:
    """Keep-last rows with ``block_bucket`` and the two stream ranks.

    Storage buckets may be wide (few directories) while ranks are counted in
    narrower cells of ``cell_blocks`` blocks.  All three windows (keep-last on
    the log key, rank in the topic stream, rank in the topic+address stream)
    are clustered by a superset of ``(chain_id, topic0, cell)``, so Spark
    satisfies them with a single hash exchange on those columns.  A group is
    at most one cell of one topic, however hot the topic and wide the bucket.
    Where a bucket is one cell the exchange is on ``(chain_id, cell)``, which
    is the layout's clustering too, so the wide rows are shuffled once.  With
    ``rows``, about how many there are, its partitions grow with them.
    """
    cell_blocks = cell_blocks or default_cell(bucket_blocks)
    if bucket_blocks % cell_blocks:
        raise ValueError(f"a bucket of {bucket_blocks} blocks does not hold whole cells of {cell_blocks}")
    spread = [partitions_for(landed.sparkSession, rows)] if rows else []
    one_cell = bucket_blocks == cell_blocks
    by = ["chain_id", "_cell"] if one_cell else ["chain_id", "topic0", "_cell"]
    rows = landed.withColumn("_cell", F.expr(f"block_number div {int(cell_blocks)}"))
    rows = exchanged_logs(rows, lambda x: x.repartition(*spread, *by), keep=() if one_cell else ("topic0",))
    # the widths are no literals here: Spark leaves these out of a sort's known
    # order, and then sorts the rows again by the partition columns alone when
    # they are written, which loses the order inside files
    zero = F.coalesce(F.col("block_number") * 0, F.lit(0)).cast("bigint")
    rows = rows.withColumn("bucket_blocks", zero + bucket_blocks).withColumn("cell_blocks", zero + cell_blocks) \
        .withColumn("block_bucket", F.expr("block_number div bucket_blocks"))
    rows = dedup_logs(rows, key=[*LOG_KEY, "_cell"], keep_seq=True)
    pos = ["block_number", "log_index", "address"]  # two logs may share a position
    w_topic = Window.partitionBy("chain_id", "topic0", "_cell").orderBy(*pos)
    w_addr = Window.partitionBy("chain_id", "topic0", "_cell", "address").orderBy(*pos)
    rows = rows.withColumn("topic_rank", F.row_number().over(w_topic).cast("bigint")) \
        .withColumn("address_rank", F.row_number().over(w_addr).cast("bigint"))
    # the last row of a stream carries its count, for the directory
    for name, w in (("topic", w_topic), ("address", w_addr)):
        rows = rows.withColumn(f"{name}_rows", F.when(F.lead(F.lit(1)).over(w).isNull(), F.col(f"{name}_rank")))
    return rows.select(*[f.name for f in LOGS_STORED.fields])


def compact_logs(landed: DataFrame, dst: str, bucket_blocks: int = DEFAULT_BUCKET_BLOCKS,
                 partitions: int | None = None, ceilings: DataFrame | None = None,
                 cell_blocks: int | None = None, rows: int | None = None) -> str:
    """Keep-last + stream ranks + layout, written to a fresh ``dst`` (S16+S17).

    One exchange on ``(chain_id, cell)`` where a bucket is one cell.  Else two:
    one on ``(chain_id, topic0, cell)`` for the three windows of
    :func:`served_rows`, one ``rebalance`` on the output partition columns so
    each ``(chain, bucket)`` directory gets a few large files instead of one
    small file per task (AQE splits a skewed bucket).  With ``ceilings``
    (``chain_id, safe``) only final blocks are served; later ones stay in the
    landing table until a run with a higher ceiling.  ``rows`` (about how many
    are landed) makes the exchange's partitions grow with them, so that its
    sorts stay in memory; else they are the session's.
    """
    if ceilings is not None:
        landed = final_logs(landed, ceilings)
    cell_blocks = cell_blocks or default_cell(bucket_blocks)
    out = layout(served_rows(landed, bucket_blocks, cell_blocks, rows), partitions, bucket_blocks == cell_blocks)
    _writer(out).mode("errorifexists").parquet(dst)
    stored = read_logs(landed.sparkSession, dst)
    directory.record(stored, stored, dst)
    return dst


def table_width(spark: SparkSession, path: str, expected: int | None = None) -> tuple[int, int]:
    """Blocks per bucket and per rank cell of a served table, from its
    directory; a different ``expected`` bucket is refused."""
    found = directory.widths(read_logs(spark, path), path)
    if len(found) > 1:
        raise ValueError(f"{path} mixes widths: {sorted(found)}")
    if expected is not None and found and found[0][0] != expected:
        raise ValueError(f"{path} has buckets of {found[0][0]} blocks, not {expected}")
    width = expected or DEFAULT_BUCKET_BLOCKS
    return found[0] if found else (width, default_cell(width))


#: partitions that :func:`in_partitions` names one by one
LISTED_PARTITIONS = 2_000


def in_partitions(df: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of ``df`` in the ``(chain_id, block_bucket)`` partitions of
    ``touched``, by literal partition filters.

    Dynamic pruning depends on the caller's predicates; this does not.  Up to
    ``LISTED_PARTITIONS`` runs of neighbouring buckets are listed, so a change
    to a whole table is a few.  Beyond that each chain's lowest and highest
    bucket are the filter (two numbers a chain), and a semi-join on the
    partition columns keeps the result the same."""
    keys = touched.select("chain_id", "block_bucket").where("chain_id is not null and block_bucket is not null").distinct()
    place = F.row_number().over(Window.partitionBy("chain_id").orderBy("block_bucket"))
    runs = keys.withColumn("_run", F.col("block_bucket") - place).groupBy("chain_id", "_run").agg(
        F.min("block_bucket").alias("low"), F.max("block_bucket").alias("high")).select("chain_id", "low", "high")
    some = runs.take(LISTED_PARTITIONS + 1)
    by_chain: dict[int, list[tuple[int, int]]] = {}
    for chain, low, high in some[:LISTED_PARTITIONS]:
        by_chain.setdefault(chain, []).append((low, high))
    keep = F.lit(False)
    if len(some) <= LISTED_PARTITIONS:
        for chain, found in sorted(by_chain.items()):
            within = F.col("block_bucket").isin(sorted(low for low, high in found if low == high))
            for low, high in sorted(found):
                if low < high:
                    within = within | F.col("block_bucket").between(low, high)
            keep = keep | ((F.col("chain_id") == chain) & within)
        return df.where(keep)
    keys = materialize(keys)
    for chain, low, high in keys.groupBy("chain_id").agg(F.min("block_bucket"), F.max("block_bucket")).collect():
        keep = keep | ((F.col("chain_id") == chain) & F.col("block_bucket").between(low, high))
    return df.where(keep).join(keys, ["chain_id", "block_bucket"], "left_semi")


def compact_incremental(spark: SparkSession, new_landed: DataFrame, served: str, staging: str,
                        bucket_blocks: int | None = None,
                        partitions: int | None = None, ceilings: DataFrame | None = None) -> str:
    """Merge newly landed rows into the served table, bucket by bucket.

    1. read served rows of only the ``(chain, bucket)`` partitions the new rows
       touch, union the new rows, keep-last, write to a fresh ``staging`` path;
    2. move staging's partitions over those of ``served``: they have the layout
       and order of the table already, so rows are written once;
    3. replace the same partitions in the table's directory.

    The bucket width is the table's own.  Never reads and overwrites the same
    path in one job.
    """
    bucket_blocks, cell_blocks = table_width(spark, served, bucket_blocks)
    if ceilings is not None:
        new_landed = final_logs(new_landed, ceilings)
    new = with_bucket(new_landed, bucket_blocks).select(*[f.name for f in LOGS_LANDED.fields], "block_bucket")
    old = in_partitions(read_logs(spark, served), new).select(*new.columns)
    # ranks are recomputed over whole touched partitions (old rows + new)
    merged = layout(served_rows(old.unionByName(new).drop("block_bucket"), bucket_blocks, cell_blocks, old.count()),
                    partitions, bucket_blocks == cell_blocks)
    _writer(merged).mode("errorifexists").parquet(staging)
    directory.begin(spark, served)
    moved = move_partitions(spark, staging, served)
    stored = read_logs(spark, served)
    directory.record(stored, in_partitions(stored, moved), served)
    return served


#: partitions that the driver moves at a time
MOVERS = 16


def move_partitions(spark: SparkSession, staging: str, served: str) -> DataFrame:
    """Put the partitions of ``staging`` in the place of those of ``served``;
    their ``chain_id, block_bucket``.

    Renames in one file system, as a dynamic overwrite's commit does.  Replaced
    rows lie under ``staging/_replaced`` until all new ones are in place: if the
    driver dies between, a partition may be missing from the table, but it is
    still there or in staging."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    source = path(staging)
    fs = source.getFileSystem(conf)
    if fs.getUri().toString() != path(served).getFileSystem(conf).getUri().toString():
        raise ValueError(f"{staging} and {served} must lie in one file system")
    root = fs.makeQualified(source).toString().rstrip("/")
    pattern = "/".join(f"{c}=*" for c in directory.PARTITIONS)
    found = [s.getPath().toString() for s in fs.globStatus(path(f"{root}/{pattern}"))]

    def move(partition: str) -> tuple[str, str]:
        name = partition[len(root) + 1:]
        new, there, aside = path(partition), path(f"{served.rstrip('/')}/{name}"), path(f"{root}/_replaced/{name}")
        if fs.exists(there):
            fs.mkdirs(aside.getParent())
            if not fs.rename(there, aside):
                raise RuntimeError(f"{there} could not be moved")
        else:
            fs.mkdirs(there.getParent())
        if not fs.rename(new, there):
            raise RuntimeError(f"{partition} could not be moved")
        return tuple(x.partition("=")[2] for x in name.split("/")[2:])

    with ThreadPoolExecutor(MOVERS) as pool:
        keys = list(pool.map(move, found))
    fs.delete(path(f"{root}/_replaced"), True)
    spark.catalog.refreshByPath(served)
    return spark.createDataFrame(keys, "chain_id string, block_bucket string").select(
        *[F.col(c).try_cast("bigint").alias(c) for c in ("chain_id", "block_bucket")])


FOOTPRINT_SCHEMA = ("path string, chain_id bigint, rows bigint, compressed_bytes bigint, "
                    "uncompressed_bytes bigint, file_bytes bigint")


def _footers(batches):
    """Executor side: read the footer of each listed Parquet file."""
    import pandas as pd
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    for pdf in batches:
        out = []
        for path, chain_id, length in zip(pdf["path"], pdf["chain_id"], pdf["length"]):
            fs, inner = pafs.FileSystem.from_uri(path)
            with fs.open_input_file(inner) as fh:
                md = pq.ParquetFile(fh).metadata
            comp = unc = 0
            for g in range(md.num_row_groups):
                rg = md.row_group(g)
                for c in range(rg.num_columns):
                    col = rg.column(c)
                    comp += col.total_compressed_size
                    unc += col.total_uncompressed_size
            out.append((path, chain_id, md.num_rows, comp, unc, int(length)))
        yield pd.DataFrame(out, columns=["path", "chain_id", "rows", "compressed_bytes",
                                         "uncompressed_bytes", "file_bytes"])


def storage_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per Parquet file: listing via ``binaryFile`` with the content
    column pruned (only path and length are read), footers read on executors."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
             .option("recursiveFileLookup", "true").load(path).select("path", "length"))
    files = files.withColumn("chain_id",
                             F.regexp_extract("path", r"chain_id=(\d+)", 1).try_cast("bigint"))
    return files.mapInPandas(_footers, FOOTPRINT_SCHEMA)


def storage_footprint(spark: SparkSession, path: str, per_chain: bool = True) -> DataFrame:
    """Compressed / uncompressed bytes of the live files (A4), per chain or whole."""
    from ..functions.formatting import ratio_half_even, readable_size

    f = storage_files(spark, path)
    g = f.groupBy("chain_id") if per_chain else f.groupBy()
    s = g.agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"),
              F.sum("compressed_bytes").alias("compressed_bytes"),
              F.sum("uncompressed_bytes").alias("uncompressed_bytes"))
    return s.withColumn("compressedSize", readable_size("compressed_bytes")) \
        .withColumn("compressionRatio", ratio_half_even("uncompressed_bytes", "compressed_bytes"))
