"""Declared schemas and fixed configuration values.

Every reader in the package passes one of these schemas explicitly; nothing
is inferred (partition inference would, for example, turn ``chain_id`` into
an ``int``).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the indexed service's own constants.
# ---------------------------------------------------------------------------
DEFAULT_PAGE_LIMIT = 1_000          # rows per page when no limit is given
MAX_PAGE_LIMIT = 1_000_000          # largest accepted page limit
FLUSH_ROWS = 500_000                # ingest flush threshold (rows)
FLUSH_SECONDS = 30                  # ingest flush timeout (seconds)
FLUSH_BYTES = 1 << 30               # ingest flush threshold (bytes of event files)
FIXED_WIDTH_BYTES = {               # byte widths of the fixed-size columns
    "block_hash": 32,
    "transaction_hash": 32,
    "address": 20,
    "topic0": 32,
    "topic1": 32,
    "topic2": 32,
    "topic3": 32,
}
CURSOR_PATTERN = r"^[0-9]+:[0-9]+$"  # "blockNumber:logIndex"
CHAIN_URL_TEMPLATE = "https://%d.logs.example.org"  # domain is a parameter

# Supported chains and their reorg safety margins (blocks held back from the
# tip), fixed values: (chain id, name, margin).
DEFAULT_CHAINS = [
    (1, "mainnet", 12),
    (10, "optimism", 5),
    (56, "bsc", 15),
    (100, "gnosis", 12),
    (137, "polygon", 64),
    (146, "sonic", 5),
    (4326, "megaeth", 5),
    (5000, "mantle", 5),
    (8453, "base", 5),
    (9745, "plasma", 5),
    (42161, "arbitrum", 5),
    (42220, "celo", 12),
    (43114, "avalanche", 12),
    (57073, "ink", 5),
    (59144, "linea", 5),
    (84532, "base-sepolia", 5),
    (534352, "scroll", 5),
]

# Size units of the readable-size format, fixed values.
SIZE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]

# Blocks per ``block_bucket`` when a table is written; readers take the width
# from the table itself.  Real chains use 100_000 or more.
DEFAULT_BUCKET_BLOCKS = 1_000

# Column order of the logs table (the sort key is
# chain_id, topic0, block_number, log_index, address).
LOG_KEY = ["chain_id", "topic0", "block_number", "log_index", "address"]
LOG_POSITION = ["block_number", "log_index"]

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------
LOGS = T.StructType([
    T.StructField("chain_id", T.LongType(), False),
    T.StructField("block_number", T.LongType(), False),
    T.StructField("block_hash", T.BinaryType(), False),
    T.StructField("timestamp", T.LongType(), False),
    T.StructField("transaction_hash", T.BinaryType(), False),
    T.StructField("transaction_index", T.LongType(), False),
    T.StructField("log_index", T.LongType(), False),
    T.StructField("address", T.BinaryType(), False),
    T.StructField("data", T.BinaryType(), False),
    T.StructField("topic0", T.BinaryType(), False),
    T.StructField("topic1", T.BinaryType(), True),
    T.StructField("topic2", T.BinaryType(), True),
    T.StructField("topic3", T.BinaryType(), True),
    T.StructField("removed", T.ShortType(), False),
])

# Landed rows also carry the insertion order used by keep-last dedup.
LOGS_LANDED = T.StructType(LOGS.fields + [
    T.StructField("ingest_seq", T.LongType(), False),
])

# Stored layout: the landed schema, the stream ranks kept by compaction
# (position of the row inside its (chain, topic0, cell) and
# (chain, topic0, address, cell) streams) and the partition columns: the
# widths of the table's storage buckets and rank cells, and the bucket.
LOGS_STORED = T.StructType(LOGS_LANDED.fields + [
    T.StructField("topic_rank", T.LongType(), False),
    T.StructField("address_rank", T.LongType(), False),
    T.StructField("topic_rows", T.LongType(), True),
    T.StructField("address_rows", T.LongType(), True),
    T.StructField("bucket_blocks", T.LongType(), False),
    T.StructField("cell_blocks", T.LongType(), False),
    T.StructField("block_bucket", T.LongType(), False),
])

RAW_LOG_STRUCT = T.StructType([
    T.StructField("removed", T.BooleanType(), True),
    T.StructField("logIndex", T.LongType(), True),
    T.StructField("transactionIndex", T.LongType(), True),
    T.StructField("transactionHash", T.StringType(), True),
    T.StructField("blockNumber", T.LongType(), True),
    T.StructField("blockHash", T.StringType(), True),
    T.StructField("address", T.StringType(), True),
    T.StructField("data", T.StringType(), True),
    T.StructField("topics", T.ArrayType(T.StringType(), True), True),
])

RAW_BLOCK_STRUCT = T.StructType([
    T.StructField("number", T.LongType(), True),
    T.StructField("timestamp", T.LongType(), True),
])

# Nested event as delivered by the upstream archive: one {block, log} pair.
RAW_EVENTS = T.StructType([
    T.StructField("chain_id", T.LongType(), True),
    T.StructField("ingest_seq", T.LongType(), True),
    T.StructField("block", RAW_BLOCK_STRUCT, True),
    T.StructField("log", RAW_LOG_STRUCT, True),
])

RAW_BLOCKS = T.StructType([
    T.StructField("chain_id", T.LongType(), True),
    T.StructField("number", T.LongType(), True),
    T.StructField("timestamp", T.LongType(), True),
    T.StructField("block_hash", T.StringType(), True),
])

RAW_LOGS = T.StructType([
    T.StructField("chain_id", T.LongType(), True),
    T.StructField("block_number", T.LongType(), True),
    T.StructField("log_index", T.LongType(), True),
    T.StructField("transaction_index", T.LongType(), True),
    T.StructField("transaction_hash", T.StringType(), True),
    T.StructField("address", T.StringType(), True),
    T.StructField("data", T.StringType(), True),
    T.StructField("ingest_seq", T.LongType(), True),
    T.StructField("t0", T.StringType(), True),
    T.StructField("t1", T.StringType(), True),
    T.StructField("t2", T.StringType(), True),
    T.StructField("t3", T.StringType(), True),
    T.StructField("removed", T.BooleanType(), True),
])

CHAINS = T.StructType([
    T.StructField("chain_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("margin", T.LongType(), False),
])

HEIGHT_EVENTS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("chain_id", T.LongType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("height", T.LongType(), True),
    T.StructField("delay_millis", T.LongType(), True),
    T.StructField("error_msg", T.StringType(), True),
])

LOG_REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("chain_id", T.LongType(), True),
    T.StructField("topic", T.StringType(), True),
    T.StructField("address", T.StringType(), True),
    T.StructField("from_block", T.LongType(), True),
    T.StructField("to_block", T.LongType(), True),
    T.StructField("cursor", T.StringType(), True),
    T.StructField("page_limit", T.LongType(), True),
])


def chains_df(spark, rows=None):
    """Chain configuration as a small DataFrame (size fixed by the list)."""
    return spark.createDataFrame(rows if rows is not None else DEFAULT_CHAINS, CHAINS)
