"""Input views derived from the given benchmark tables (see FIXTURES.md).

An order is a block, a line item is a log of that block, ``orderkey % 3``
picks the chain, the part is the emitting address, return flag + line status
is the event signature.  Everything here is DataFrame code over the parquet
tables, so the work grows with them.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import chunked_row_number
from ..schema import chains_df

# Fixture chain set: (chain id, name, margin), fixed values.
FIXTURE_CHAINS = [
    (1, "mainnet", 12),
    (10, "optimism", 5),
    (56, "bsc", 15),
    (100, "gnosis", 12),
    (137, "polygon", 64),
    (8453, "base", 5),
]
REPLAY_EVERY = 10       # blocks divisible by this are ingested twice
BATCH_BLOCKS = 500      # blocks per ingest batch
EVENT_CHUNK = 100_000   # event ids per chunk of the distributed row number
PART_ROWS = 100_000     # line items per partition of the raw logs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chain_of(key: Column) -> Column:
    return (F.when(key % 3 == 0, 1).when(key % 3 == 1, 10).otherwise(137)).cast("bigint")


def _sha(prefix: str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(prefix), value.cast("string")), 256)


def raw_blocks(spark: SparkSession, sf_dir: str, partitions: int | None = None) -> DataFrame:
    """Block headers.  ``partitions`` (that of the logs they are joined to) puts
    them by (chain, block) before their hash is made text, so the join does not
    shuffle it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    o = o.withColumn("chain_id", _chain_of(F.col("o_orderkey")))
    if partitions:
        o = o.repartition(partitions, "chain_id", "o_orderkey")
    return o.select(
        "chain_id",
        F.col("o_orderkey").alias("number"),
        F.unix_timestamp(F.col("o_orderdate")).cast("bigint").alias("timestamp"),
        F.concat(F.lit("0x"), _sha("block:", F.col("o_orderkey"))).alias("block_hash"),
    )


def log_partitions(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the raw logs: the session's number, or more, by their rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(log_rows(spark, sf_dir) / PART_ROWS))


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    # one exchange on (chain, block), of narrow rows: the window, the header
    # join and keep-last take its partitioning and order over, so the wide text
    # below is neither shuffled nor sorted for them.  The number is given, as
    # partitions merged by their narrow size would be too large once wide, and
    # grows with the rows (a count from footers), so that the sorts of the wide
    # rows keep their size, in memory, however large the table is
    l = l.withColumn("chain_id", _chain_of(F.col("l_orderkey"))) \
        .repartition(log_partitions(spark, sf_dir), "chain_id", "l_orderkey")
    # every log lands once; logs of every tenth block land a second time with
    # different data (a replayed batch) -- one scan, no join
    one, two = F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
    seqs = F.when(F.col("l_orderkey") % REPLAY_EVERY == 0, F.array(one, two)) \
        .otherwise(F.array(one))
    l = l.withColumn("ingest_seq", F.explode(seqs))
    # log index inside the block, the same in both copies; a block holds a
    # handful of logs, so the window group is small
    w = Window.partitionBy("chain_id", "l_orderkey", "ingest_seq").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    l = l.withColumn("li", F.row_number().over(w) - 1)
    word = F.lpad(F.lower(F.hex(F.col("l_quantity").cast("bigint"))), 64, "0")
    data = F.when(F.col("l_tax") < 0.005, F.lit("")).otherwise(
        F.repeat(word, F.round(F.col("l_tax") * 100).cast("int")))
    sig = F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("sig:"), F.col("l_returnflag"),
                                                F.col("l_linestatus")), 256))
    t0 = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), F.lit(None)) \
        .otherwise(sig)
    b = l.select(
        "chain_id", "ingest_seq",
        F.col("l_orderkey").alias("block_number"),
        F.col("li").cast("bigint").alias("log_index"),
        (F.col("l_partkey") % 5).cast("bigint").alias("transaction_index"),
        F.concat(F.lit("0x"), F.sha2(F.concat(F.lit("tx:"), F.col("l_orderkey").cast("string"),
                                              F.lit(":"), (F.col("l_partkey") % 5).cast("string")),
                                     256)).alias("transaction_hash"),
        F.concat(F.lit("0x"), F.upper(F.regexp_replace(
            F.substring(_sha("addr:", F.col("l_partkey")), 25, 40), "^0+", ""))).alias("address"),
        F.concat(F.lit("0x"), data).alias("data"),
        t0.alias("t0"),
        F.when(F.col("l_discount") > 0.025, F.concat(F.lit("0x"), F.regexp_replace(
            _sha("t1:", F.col("l_suppkey")), "^0+", ""))).alias("t1"),
        F.when(F.col("l_discount") > 0.045,
               F.concat(F.lit("0x"), _sha("t2:", F.col("l_partkey")))).alias("t2"),
        F.when(F.col("l_discount") > 0.075,
               F.concat(F.lit("0x"), _sha("t3:", F.col("l_linenumber")))).alias("t3"),
        ((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.075)).alias("removed"),
    )
    has_t0 = F.col("t0").isNotNull()
    return b.select(
        "chain_id", "block_number", "log_index", "transaction_index", "transaction_hash",
        "address",
        F.when(F.col("ingest_seq") == 2, F.concat(F.col("data"), F.lit("01")))
         .otherwise(F.col("data")).alias("data"),
        "ingest_seq", "t0",
        F.when(has_t0, F.col("t1")).alias("t1"),
        F.when(has_t0, F.col("t2")).alias("t2"),
        F.when(has_t0, F.col("t3")).alias("t3"),
        "removed",
    )


def log_rows(spark: SparkSession, sf_dir: str) -> int:
    """About how many raw logs there are: the line items (a count from footers)."""
    return table(spark, sf_dir, "lineitem").count()


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested ``{block, log}`` form of the raw logs (as the archive sends it).

    Logs whose block header is missing get ``block = NULL``.
    """
    logs = raw_logs(spark, sf_dir)
    blocks = raw_blocks(spark, sf_dir, log_partitions(spark, sf_dir))
    j = logs.join(blocks, (logs.chain_id == blocks.chain_id) & (logs.block_number == blocks.number),
                  "left")
    topics = F.filter(F.array(logs.t0, logs.t1, logs.t2, logs.t3), lambda x: x.isNotNull())
    return j.select(
        logs.chain_id.alias("chain_id"),
        logs.ingest_seq.alias("ingest_seq"),
        F.when(blocks.number.isNotNull(),
               F.struct(blocks.number.alias("number"), blocks.timestamp.alias("timestamp")))
         .alias("block"),
        F.struct(
            logs.removed.alias("removed"),
            logs.log_index.alias("logIndex"),
            logs.transaction_index.alias("transactionIndex"),
            logs.transaction_hash.alias("transactionHash"),
            logs.block_number.alias("blockNumber"),
            blocks.block_hash.alias("blockHash"),
            logs.address.alias("address"),
            logs.data.alias("data"),
            topics.alias("topics"),
        ).alias("log"),
    )


def chains(spark: SparkSession) -> DataFrame:
    return chains_df(spark, FIXTURE_CHAINS)


def chain_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_blocks(spark, sf_dir).groupBy("chain_id").agg(
        F.max("number").alias("archive_height"))


def height_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id", "value", "event_type", _chain_of(F.col("user_id")).alias("chain_id"))
    # n = position of the event inside its chain; three chains hold a third
    # of the events each, so rank chunk-wise instead of one window per chain
    e = chunked_row_number(e, ["chain_id"], ["event_id"],
                           F.floor(F.col("event_id") / EVENT_CHUNK), out="n")
    typ = F.when(F.col("event_type") == "error", "Reconnecting").otherwise("Height")
    e = e.withColumn("type", typ)
    n = F.col("n")
    height = n + 3 * F.floor(n / 4.0).cast("bigint") - F.when(n % 10 == 0, 2).otherwise(0)
    return e.select(
        F.col("event_id").alias("seq"), "chain_id", "type",
        F.when(F.col("type") == "Height", height).cast("bigint").alias("height"),
        F.when(F.col("type") == "Reconnecting", F.floor("value").cast("bigint"))
         .alias("delay_millis"),
        F.when(F.col("type") == "Reconnecting", F.lit("connection lost")).alias("error_msg"),
    )


def log_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    chain = (F.when(k % 50 == 9, 999).when(k % 3 == 0, 1).when(k % 3 == 1, 10).otherwise(137)) \
        .cast("bigint")
    topic = (F.when(F.col("c_mktsegment") == "BUILDING",
                    F.concat(F.lit("0x"), F.sha2(F.lit("sig:NO"), 256)))
             .when(F.col("c_mktsegment") == "MACHINERY", F.lit("0x0"))
             .otherwise(F.concat(F.lit("0x"), F.upper(F.sha2(F.lit("sig:AF"), 256)))))
    address = F.when(k % 5 == 0, F.concat(F.lit("0x"), F.substring(
        _sha("addr:", k % 100), 25, 40)))
    return c.select(
        k.alias("request_id"), chain.alias("chain_id"), topic.alias("topic"),
        address.alias("address"),
        F.when(k % 8 != 0, k * 5).alias("from_block"),
        F.when(k % 6 != 0, k * 5 + 2000).alias("to_block"),
        F.when(k % 50 == 8, F.lit("abc")).when(k % 50 == 12, F.lit("99999999999999999999:0"))
         .when(k % 4 == 1, F.concat((k * 6).cast("string"), F.lit(":0"))).alias("cursor"),
        F.when(k % 50 == 7, F.lit(0).cast("bigint"))
         .when(k % 9 != 0, (5 + k % 7).cast("bigint")).alias("page_limit"),
    )


def log_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("request_id"),
        _chain_of(F.col("o_orderkey")).alias("chain_id"),
        F.col("o_orderkey").alias("block_number"),
        (F.col("o_custkey") % 6).alias("log_index"),
    )


def ingest_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_logs(spark, sf_dir)
    batch = F.floor(F.col("block_number") / float(BATCH_BLOCKS)).cast("bigint")
    return r.groupBy("chain_id", batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("chunk_size"),
        (F.max("block_number") + 1).alias("next_block"))


def covered_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ingest_batches(spark, sf_dir)
    # every seventh batch range is missing (a gap); odd ones overlap by one
    return b.where(F.col("batch") % 7 != 2).select(
        "chain_id",
        (F.col("batch") * BATCH_BLOCKS - F.col("batch") % 2).alias("from_block"),
        (F.col("batch") * BATCH_BLOCKS + BATCH_BLOCKS - 1).alias("to_block"))
