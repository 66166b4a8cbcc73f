"""Registered queries (Spark) and their DuckDB oracle statements.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
Conventions shared by both sides so that results hash alike:

* binary columns come out as lower-case hex text (no ``0x`` unless the API
  format says so);
* counts are ``bigint``; floats only after exact rounding;
* arrays are joined with ``,`` into one string;
* every computed column is aliased to the same name on both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formatting as FM
from ..functions import hexcodec as H
from ..functions.cursor import decode_cursor
from ..functions.cursor import encode_cursor
from ..functions.hexcodec import bare_hex
from ..operators import aggregates as A
from ..operators import decode as D
from ..operators import filters as P
from ..operators.filters import known_chain
from ..operators.requests import check_requests
from ..plans import batch as B
from ..plans import export as X
from ..plans import query as Q
from ..plans import resume as XR
from ..plans import tables
from ..plans.stats import chain_stats
from ..plans.stats import log_stats_report
from ..plans.stats import served_stats
from ..session import materialize, stored
from ..schema import HEIGHT_EVENTS, RAW_EVENTS
from ..session import scratch_path
from ..sources import archive as AR
from ..sources import directory
from ..sources import fixtures as FX
from ..sources import table as TB
from ..streaming import finality as FN
from ..streaming import holdback as HB
from ..streaming import ingest as IN
from ..streaming import ledger as LG
from ..streaming import metrics as SM
from ..streaming import planner as PL
from ..streaming.state import finished
from .fixture_sql import with_views

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# request parameters of the single-request queries (fixed values)
PAGE_CHAIN = 1
PAGE_TOPIC = "0x" + sha("sig:NO").upper()
PAGE_FROM = 1000
PAGE_LIMIT = 25

LOG_BINARY = ["block_hash", "transaction_hash", "address", "data",
              "topic0", "topic1", "topic2", "topic3"]
LOG_FIELDS = ["chain_id", "block_number", "block_hash", "timestamp", "transaction_hash",
              "transaction_index", "log_index", "address", "data", "topic0", "topic1",
              "topic2", "topic3", "removed"]


def compare_form(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Binary columns as bare hex, in the oracle's column names."""
    cols = [bare_hex(c) if c in LOG_BINARY else F.col(c) for c in LOG_FIELDS if c in df.columns]
    return df.select(*(extra or []), *cols)


def api_compare(df: DataFrame) -> DataFrame:
    """API-shaped rows with the topics array joined to text."""
    return df.withColumn("topics", F.array_join("topics", ","))


API_SQL_COLUMNS = """
  '0x' || address AS address, '0x' || block_hash AS blockHash, block_number AS blockNumber,
  timestamp, '0x' || data AS data, log_index AS logIndex,
  array_to_string(list_filter(['0x' || topic0, '0x' || topic1, '0x' || topic2, '0x' || topic3],
                              lambda x: x IS NOT NULL), ',') AS topics,
  '0x' || transaction_hash AS transactionHash, transaction_index AS transactionIndex
"""

# ---------------------------------------------------------------------------
# decode, dedup
# ---------------------------------------------------------------------------


@register("decode_logs", with_views("SELECT * FROM logs_landed", "logs_landed"))
def q_decode_logs(spark, sf_dir):
    return compare_form(tables.landed_logs(spark, sf_dir), ["ingest_seq"])


@register("dedup_logs", with_views("SELECT * FROM logs", "logs"))
def q_dedup_logs(spark, sf_dir):
    return compare_form(tables.logs(spark, sf_dir))


# ---------------------------------------------------------------------------
# Q1: one page
# ---------------------------------------------------------------------------


@register("get_logs_page", with_views(f"""
SELECT {API_SQL_COLUMNS} FROM logs
WHERE chain_id = {PAGE_CHAIN} AND topic0 = lower('{PAGE_TOPIC[2:]}') AND block_number >= {PAGE_FROM}
ORDER BY block_number, log_index LIMIT {PAGE_LIMIT}
""", "logs"))
def q_get_logs_page(spark, sf_dir):
    page = Q.get_logs(tables.logs(spark, sf_dir), PAGE_CHAIN, PAGE_TOPIC, from_block=PAGE_FROM,
                      limit=PAGE_LIMIT)
    return api_compare(page)


# ---------------------------------------------------------------------------
# requests: validation, batched pages, cursors, manifests, point lookups
# ---------------------------------------------------------------------------

BATCH_BUCKET = 1_000  # blocks per bucket in the fixture (orders are blocks)
PAYLOAD = ["block_hash", "timestamp", "transaction_hash", "transaction_index", "data",
           "topic1", "topic2", "topic3", "removed"]


def _requests(spark, sf_dir):
    return check_requests(FX.log_requests(spark, sf_dir), FX.chains(spark))


def _plan(spark, sf_dir, first_page_only=False, payload=PAYLOAD):
    """Ranked streams of the requested topics/addresses and the per-request
    bucket plan, each written once under the checkpoint folder (several
    branches read them)."""
    ok, _ = _requests(spark, sf_dir)
    ok = materialize(ok)
    ranked = stored(B.rank_streams(tables.logs(spark, sf_dir), payload, BATCH_BUCKET,
                                   requests=ok, rows=FX.log_rows(spark, sf_dir)), "ranked")
    plan = B.bucket_plan(ranked, ok, BATCH_BUCKET, first_page_only=first_page_only)
    return ranked, ok, materialize(plan)


@register("check_requests", with_views("""
SELECT request_id, reject_reason,
  CASE WHEN reject_reason IS NULL THEN lower(lpad(regexp_replace(topic, '^0[xX]', ''), 64, '0')) END AS topic0,
  CASE WHEN reject_reason IS NULL AND address IS NOT NULL THEN lower(lpad(regexp_replace(address, '^0[xX]', ''), 40, '0')) END AS address,
  CASE WHEN reject_reason IS NULL THEN coalesce(page_limit, 1000) END AS page_limit
FROM req_checked
""", "req_checked"))
def q_check_requests(spark, sf_dir):
    ok, bad = _requests(spark, sf_dir)
    good = ok.select("request_id", F.lit(None).cast("string").alias("reject_reason"),
                     bare_hex("topic0"), bare_hex("address"), "page_limit")
    rej = bad.select("request_id", "reject_reason", F.lit(None).cast("string").alias("topic0"),
                     F.lit(None).cast("string").alias("address"),
                     F.lit(None).cast("bigint").alias("page_limit"))
    return good.unionByName(rej)


@register("known_chain", with_views("""
SELECT request_id, chain_id FROM log_requests WHERE chain_id IN (SELECT chain_id FROM chains)
""", "log_requests", "chains"))
def q_known_chain(spark, sf_dir):
    ok, _unknown = known_chain(FX.log_requests(spark, sf_dir), FX.chains(spark))
    return ok.select("request_id", "chain_id")


@register("decode_cursor", with_views("""
SELECT request_id, cursor,
  coalesce(TRY_CAST(split_part(cursor, ':', 1) AS BIGINT), 0) AS cursor_block,
  coalesce(TRY_CAST(split_part(cursor, ':', 2) AS BIGINT), 0) AS cursor_log_index
FROM log_requests WHERE cursor IS NOT NULL
""", "log_requests"))
def q_decode_cursor(spark, sf_dir):
    r = FX.log_requests(spark, sf_dir).where(F.col("cursor").isNotNull())
    b, i = decode_cursor("cursor")
    return r.select("request_id", "cursor", b.alias("cursor_block"), i.alias("cursor_log_index"))


@register("get_logs_batch", with_views("""
SELECT request_id, n, block_number, log_index, address, data, topic0, transaction_hash
FROM req_matched WHERE n <= page_limit
""", "req_matched"))
def q_get_logs_batch(spark, sf_dir):
    ranked, ok, plan = _plan(spark, sf_dir, first_page_only=True)
    rows = B.get_logs_batch(ranked, ok, BATCH_BUCKET, plan)
    return rows.select("request_id", "n", "block_number", "log_index", bare_hex("address"),
                       bare_hex("data"), bare_hex("topic0"), bare_hex("transaction_hash"))


@register("next_cursor", with_views("""
SELECT r.request_id, CAST(count(m.n) AS BIGINT) AS page_rows,
  CASE WHEN count(m.n) >= r.page_limit
       THEN CAST(arg_max(m.block_number, m.n) AS VARCHAR) || ':' || CAST(arg_max(m.log_index, m.n) AS VARCHAR) END AS next_cursor
FROM req_ok r LEFT JOIN req_matched m ON m.request_id = r.request_id AND m.n <= r.page_limit
GROUP BY r.request_id, r.page_limit
""", "req_matched"))
def q_next_cursor(spark, sf_dir):
    ranked, ok, plan = _plan(spark, sf_dir, first_page_only=True, payload=[])
    pages = B.get_logs_batch(ranked, ok, BATCH_BUCKET, plan)
    return B.batch_cursors(pages, ok)


@register("page_manifest", with_views("""
, tot AS (
  SELECT r.request_id, r.page_limit, count(m.n) AS total
  FROM req_ok r LEFT JOIN req_matched m ON m.request_id = r.request_id
  GROUP BY r.request_id, r.page_limit),
pages AS (
  SELECT request_id, page_limit, total, unnest(generate_series(0, total // page_limit)) AS page
  FROM tot)
SELECT p.request_id, CAST(p.page AS BIGINT) AS page,
  CAST(least(p.page_limit, p.total - p.page * p.page_limit) AS BIGINT) AS page_rows,
  CASE WHEN m.n IS NOT NULL THEN CAST(m.block_number AS VARCHAR) || ':' || CAST(m.log_index AS VARCHAR) END AS next_cursor
FROM pages p LEFT JOIN req_matched m
  ON m.request_id = p.request_id AND m.n = (p.page + 1) * p.page_limit
""", "req_matched"))
def q_page_manifest(spark, sf_dir):
    ranked, ok, plan = _plan(spark, sf_dir, payload=[])
    return B.page_manifest(ranked, ok, BATCH_BUCKET, plan)


GET_LOG_CHAIN, GET_LOG_BLOCK, GET_LOG_INDEX = 10, 1000, 2


@register("get_log", with_views(f"""
SELECT {API_SQL_COLUMNS} FROM logs
WHERE chain_id = {GET_LOG_CHAIN} AND block_number = {GET_LOG_BLOCK} AND log_index = {GET_LOG_INDEX}
ORDER BY topic0, address LIMIT 1
""", "logs"))
def q_get_log(spark, sf_dir):
    return api_compare(Q.get_log(tables.logs(spark, sf_dir), GET_LOG_CHAIN, GET_LOG_BLOCK,
                                 GET_LOG_INDEX))


@register("get_log_batch", with_views("""
SELECT request_id, found, block_number, log_index, address, topic0 FROM (
  SELECT p.request_id, l.topic0 IS NOT NULL AS found, p.block_number, p.log_index, l.address, l.topic0,
    row_number() OVER (PARTITION BY p.request_id ORDER BY l.topic0 NULLS LAST, l.address NULLS LAST) AS rn
  FROM log_positions p LEFT JOIN logs l
    ON l.chain_id = p.chain_id AND l.block_number = p.block_number AND l.log_index = p.log_index) x
WHERE rn = 1
""", "log_positions", "logs"))
def q_get_log_batch(spark, sf_dir):
    res = B.get_log_batch(tables.logs(spark, sf_dir), FX.log_positions(spark, sf_dir))
    return res.select("request_id", "found", "block_number", "log_index", bare_hex("address"),
                      bare_hex("topic0"))


# ---------------------------------------------------------------------------
# sources and decode steps
# ---------------------------------------------------------------------------

RANGE_LO, RANGE_HI = 1000, 5000


@register("select_fields", with_views("""
SELECT r.chain_id, r.ingest_seq, r.block_number, r.log_index, r.transaction_index, b.timestamp,
       b.block_hash, r.transaction_hash, r.address, r.data,
       array_to_string(list_filter([r.t0, r.t1, r.t2, r.t3], lambda x: x IS NOT NULL), ',') AS topics,
       r.removed
FROM raw_logs r JOIN raw_blocks b ON b.chain_id = r.chain_id AND b.number = r.block_number
""", "raw_logs", "raw_blocks"))
def q_select_fields(spark, sf_dir):
    flat = D.flatten_events(FX.raw_events(spark, sf_dir))
    return flat.select("chain_id", "ingest_seq", "block_number", "log_index", "transaction_index",
                       "timestamp", "block_hash", "transaction_hash", "address", "data",
                       F.array_join("topics", ",").alias("topics"), "removed")


@register("block_range", with_views(f"""
SELECT chain_id, block_number, log_index, ingest_seq FROM raw_logs
WHERE block_number BETWEEN {RANGE_LO} AND {RANGE_HI}
""", "raw_logs"))
def q_block_range(spark, sf_dir):
    r = P.block_range(FX.raw_logs(spark, sf_dir), RANGE_LO, RANGE_HI)
    return r.select("chain_id", "block_number", "log_index", "ingest_seq")


@register("join_block_header", with_views("""
SELECT r.chain_id, r.block_number, r.log_index, r.ingest_seq, b.timestamp, b.block_hash,
       b.number IS NOT NULL AS has_block
FROM raw_logs r LEFT JOIN raw_blocks b ON b.chain_id = r.chain_id AND b.number = r.block_number
""", "raw_logs", "raw_blocks"))
def q_join_block_header(spark, sf_dir):
    j = D.attach_block_header(FX.raw_logs(spark, sf_dir), FX.raw_blocks(spark, sf_dir))
    return j.select("chain_id", "block_number", "log_index", "ingest_seq", "timestamp",
                    "block_hash", "has_block")


@register("decode_fixed_hex", with_views("""
SELECT chain_id, block_number, log_index, ingest_seq,
  lower(lpad(substring(address, 3), 40, '0')) AS address,
  lower(lpad(substring(transaction_hash, 3), 64, '0')) AS transaction_hash,
  lower(lpad(coalesce(substring(t0, 3), ''), 64, '0')) AS topic0,
  lower(lpad(substring(t1, 3), 64, '0')) AS topic1
FROM raw_logs
""", "raw_logs"))
def q_decode_fixed_hex(spark, sf_dir):
    r = FX.raw_logs(spark, sf_dir)
    return r.select("chain_id", "block_number", "log_index", "ingest_seq",
                    bare_hex(H.hex_to_bytes("address", 20), "address"),
                    bare_hex(H.hex_to_bytes("transaction_hash", 32), "transaction_hash"),
                    bare_hex(H.hex_to_bytes(F.coalesce(F.col("t0"), F.lit("")), 32), "topic0"),
                    bare_hex(H.hex_to_bytes("t1", 32), "topic1"))


@register("decode_data_hex", with_views("""
SELECT chain_id, block_number, log_index, ingest_seq, lower(substring(data, 3)) AS data,
       CAST(length(data) / 2 - 1 AS BIGINT) AS data_bytes
FROM raw_logs
""", "raw_logs"))
def q_decode_data_hex(spark, sf_dir):
    r = FX.raw_logs(spark, sf_dir).withColumn("_b", H.hex_to_bytes("data"))
    return r.select("chain_id", "block_number", "log_index", "ingest_seq", bare_hex("_b", "data"),
                    F.octet_length("_b").cast("bigint").alias("data_bytes"))


@register("split_topics", with_views("""
SELECT chain_id, block_number, log_index, ingest_seq,
  coalesce(t0, '') AS topic0_text, t1 AS topic1_text, t2 AS topic2_text, t3 AS topic3_text
FROM raw_logs
""", "raw_logs"))
def q_split_topics(spark, sf_dir):
    ev = D.flatten_events(FX.raw_events(spark, sf_dir))
    t0, t1, t2, t3 = D.split_topics(F.col("topics"))
    return ev.select("chain_id", "block_number", "log_index", "ingest_seq", t0.alias("topic0_text"),
                     t1.alias("topic1_text"), t2.alias("topic2_text"), t3.alias("topic3_text"))


@register("removed_flag", with_views("""
SELECT chain_id, block_number, log_index, ingest_seq,
  CAST(CASE WHEN removed THEN 1 ELSE 0 END AS SMALLINT) AS removed
FROM raw_logs
""", "raw_logs"))
def q_removed_flag(spark, sf_dir):
    d = D.decode_logs(D.attach_block_header(FX.raw_logs(spark, sf_dir), FX.raw_blocks(spark, sf_dir)))
    return d.select("chain_id", "block_number", "log_index", "ingest_seq", "removed")


@register("quarantine", with_views("""
SELECT coalesce(reason, 'ok') AS reject_reason, count(*) AS n FROM (
  SELECT CASE
    WHEN b.number IS NULL THEN 'block_missing'
    WHEN NOT regexp_full_match(regexp_replace(r.address, '^0[xX]', ''), '[0-9a-fA-F]*') THEN 'address_hex'
    WHEN length(regexp_replace(r.address, '^0[xX]', '')) > 40 THEN 'address_length'
    WHEN NOT regexp_full_match(regexp_replace(r.data, '^0[xX]', ''), '([0-9a-fA-F]{2})*') THEN 'data_hex'
  END AS reason
  FROM raw_logs r LEFT JOIN raw_blocks b ON b.chain_id = r.chain_id AND b.number = r.block_number) x
GROUP BY 1
""", "raw_logs", "raw_blocks"))
def q_quarantine(spark, sf_dir):
    d = tables.decoded_logs(spark, sf_dir)
    return d.groupBy(F.coalesce(F.col("reject_reason"), F.lit("ok")).alias("reject_reason")) \
        .agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# filters over the logs table
# ---------------------------------------------------------------------------
ADDR_PART = 7
FILTER_ADDRESS = "0x" + sha(f"addr:{ADDR_PART}")[24:64].lstrip("0").upper()
CURSOR_BLOCK, CURSOR_INDEX = 3000, 1


@register("filter_chain", with_views("SELECT * FROM logs WHERE chain_id = 10", "logs"))
def q_filter_chain(spark, sf_dir):
    return compare_form(P.by_chain(tables.logs(spark, sf_dir), 10))


@register("filter_topic0", with_views(f"""
SELECT * FROM logs WHERE topic0 = '{PAGE_TOPIC[2:].lower()}'
""", "logs"))
def q_filter_topic0(spark, sf_dir):
    return compare_form(P.by_topic0(tables.logs(spark, sf_dir), PAGE_TOPIC))


@register("filter_address", with_views(f"""
SELECT * FROM logs WHERE address = '{sha(f"addr:{ADDR_PART}")[24:64]}'
""", "logs"))
def q_filter_address(spark, sf_dir):
    return compare_form(P.by_address(tables.logs(spark, sf_dir), FILTER_ADDRESS))


@register("filter_from_to", with_views(f"""
SELECT * FROM logs WHERE block_number >= {RANGE_LO} AND block_number <= {RANGE_HI}
""", "logs"))
def q_filter_from_to(spark, sf_dir):
    logs = tables.logs(spark, sf_dir, bucket_blocks=BATCH_BUCKET)
    out = P.to_block(P.from_block(logs, RANGE_LO), RANGE_HI)
    return compare_form(out)


@register("after_cursor", with_views(f"""
SELECT * FROM logs WHERE chain_id = 1 AND (block_number > {CURSOR_BLOCK}
   OR (block_number = {CURSOR_BLOCK} AND log_index > {CURSOR_INDEX}))
""", "logs"))
def q_after_cursor(spark, sf_dir):
    logs = tables.logs(spark, sf_dir, bucket_blocks=BATCH_BUCKET)
    return compare_form(P.after_cursor(P.by_chain(logs, 1), CURSOR_BLOCK, CURSOR_INDEX))


@register("cursor_over_from", with_views(f"""
SELECT {API_SQL_COLUMNS} FROM logs
WHERE chain_id = 1 AND topic0 = '{PAGE_TOPIC[2:].lower()}'
  AND (block_number > {CURSOR_BLOCK} OR (block_number = {CURSOR_BLOCK} AND log_index > {CURSOR_INDEX}))
  AND block_number <= {RANGE_HI}
ORDER BY block_number, log_index LIMIT {PAGE_LIMIT}
""", "logs"))
def q_cursor_over_from(spark, sf_dir):
    # the cursor replaces from_block (which alone would start at block 0)
    page = Q.get_logs(tables.logs(spark, sf_dir), 1, PAGE_TOPIC, from_block=0, to_block=RANGE_HI,
                      cursor=f"{CURSOR_BLOCK}:{CURSOR_INDEX}", limit=PAGE_LIMIT)
    return api_compare(page)


@register("height_events", with_views("""
SELECT seq, chain_id, height FROM height_events WHERE type = 'Height'
""", "height_events"))
def q_height_events(spark, sf_dir):
    heights, _ = P.split_height_events(FX.height_events(spark, sf_dir))
    return heights.select("seq", "chain_id", "height")


# ---------------------------------------------------------------------------
# projections and scalar functions
# ---------------------------------------------------------------------------


@register("hex_projection", with_views("""
SELECT chain_id, block_number, timestamp, '0x' || block_hash AS block_hash_hex,
  '0x' || transaction_hash AS transaction_hash_hex, transaction_index, log_index,
  '0x' || address AS address_hex, '0x' || data AS data_hex, '0x' || topic0 AS topic0_hex,
  '0x' || topic1 AS topic1_hex, '0x' || topic2 AS topic2_hex, '0x' || topic3 AS topic3_hex
FROM logs
""", "logs"))
def q_hex_projection(spark, sf_dir):
    return FM.hex_projection(tables.logs(spark, sf_dir), keep=["chain_id"])


@register("topics_array", with_views("""
SELECT chain_id, block_number, log_index,
  array_to_string(list_filter(['0x' || topic0, '0x' || topic1, '0x' || topic2, '0x' || topic3],
                              lambda x: x IS NOT NULL), ',') AS topics,
  CAST(len(list_filter([topic0, topic1, topic2, topic3], lambda x: x IS NOT NULL)) AS BIGINT) AS n_topics
FROM logs
""", "logs"))
def q_topics_array(spark, sf_dir):
    h = FM.hex_projection(tables.logs(spark, sf_dir), keep=["chain_id"])
    t = FM.topics_array()
    return h.select("chain_id", "block_number", "log_index", F.array_join(t, ",").alias("topics"),
                    F.size(t).cast("bigint").alias("n_topics"))


@register("format_logs", with_views(f"SELECT chain_id, {API_SQL_COLUMNS} FROM logs", "logs"))
def q_format_logs(spark, sf_dir):
    return api_compare(FM.format_logs(FM.hex_projection(tables.logs(spark, sf_dir), keep=["chain_id"]),
                                      keep=["chain_id"]))


@register("encode_cursor", with_views("""
SELECT chain_id, topic0, CAST(block_number AS VARCHAR) || ':' || CAST(log_index AS VARCHAR) AS cursor
FROM logs
""", "logs"))
def q_encode_cursor(spark, sf_dir):
    return tables.logs(spark, sf_dir).select("chain_id", bare_hex("topic0"),
                                             encode_cursor().alias("cursor"))


_SIZE_SQL = """CASE
    WHEN {b} >= 1152921504606846976 THEN 6 WHEN {b} >= 1125899906842624 THEN 5
    WHEN {b} >= 1099511627776 THEN 4 WHEN {b} >= 1073741824 THEN 3
    WHEN {b} >= 1048576 THEN 2 WHEN {b} >= 1024 THEN 1 ELSE 0 END"""


def _size_sql(b: str) -> str:
    u = _SIZE_SQL.format(b=b)
    d = f"CAST(pow(1024, {u}) AS HUGEINT)"
    cents = f"((CAST({b} AS HUGEINT) * 100 + {d} // 2) // {d})"
    units = "['B','KiB','MiB','GiB','TiB','PiB','EiB']"
    return (f"CAST({cents} // 100 AS VARCHAR) || '.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0') "
            f"|| ' ' || {units}[{u} + 1]")


@register("readable_size", with_views(f"""
SELECT chain_id, block_bucket, bytes,
  {_size_sql('bytes')} AS size_b,
  {_size_sql('bytes * 1000')} AS size_k,
  {_size_sql('bytes * 1000000')} AS size_m,
  {_size_sql('bytes * 1000000000')} AS size_g
FROM (SELECT chain_id, block_number // 1000 AS block_bucket,
             CAST(sum(length(data) / 2 + 120) AS BIGINT) AS bytes
      FROM logs GROUP BY ALL) x
""", "logs"))
def q_readable_size(spark, sf_dir):
    logs = tables.logs(spark, sf_dir, bucket_blocks=BATCH_BUCKET)
    s = logs.groupBy("chain_id", "block_bucket").agg(
        F.sum(F.octet_length("data") + 120).cast("bigint").alias("bytes"))
    b = F.col("bytes")
    return s.select("chain_id", "block_bucket", "bytes", FM.readable_size(b).alias("size_b"),
                    FM.readable_size(b * 1000).alias("size_k"),
                    FM.readable_size(b * 1000000).alias("size_m"),
                    FM.readable_size(b * 1000000000).alias("size_g"))


@register("ratio_round", with_views("""
SELECT chain_id, block_bucket, text_bytes, data_bytes,
  CASE WHEN data_bytes = 0 THEN 0.0 ELSE CAST(
    (text_bytes * 100) // data_bytes
    + CASE WHEN 2 * ((text_bytes * 100) % data_bytes) > data_bytes
             OR (2 * ((text_bytes * 100) % data_bytes) = data_bytes AND ((text_bytes * 100) // data_bytes) % 2 = 1)
           THEN 1 ELSE 0 END AS DOUBLE) / 100.0 END AS ratio
FROM (SELECT r.chain_id, r.block_number // 1000 AS block_bucket,
             CAST(sum(length(r.data) + length(r.address) + 7) AS BIGINT) AS text_bytes,
             CAST(sum(length(r.data) / 2 - 1) AS BIGINT) AS data_bytes
      FROM raw_logs r GROUP BY ALL) x
""", "raw_logs"))
def q_ratio_round(spark, sf_dir):
    r = FX.raw_logs(spark, sf_dir)
    s = r.groupBy("chain_id", F.floor(F.col("block_number") / 1000).cast("bigint").alias("block_bucket")) \
        .agg(F.sum(F.length("data") + F.length("address") + 7).cast("bigint").alias("text_bytes"),
             F.sum(F.octet_length(H.hex_to_bytes("data"))).cast("bigint").alias("data_bytes"))
    return s.withColumn("ratio", FM.ratio_half_even("text_bytes", "data_bytes"))


# ---------------------------------------------------------------------------
# aggregates, stats, chains
# ---------------------------------------------------------------------------


@register("log_height", with_views("""
SELECT c.chain_id, CAST(coalesce(max(l.block_number), 0) AS BIGINT) AS height
FROM chains c LEFT JOIN logs l ON l.chain_id = c.chain_id GROUP BY c.chain_id
""", "chains", "logs"))
def q_log_height(spark, sf_dir):
    return A.log_height(tables.logs(spark, sf_dir), FX.chains(spark))


@register("block_height", with_views("""
SELECT c.chain_id, CAST(coalesce(max(b.number), 0) AS BIGINT) AS height
FROM chains c LEFT JOIN raw_blocks b ON b.chain_id = c.chain_id GROUP BY c.chain_id
""", "chains", "raw_blocks"))
def q_block_height(spark, sf_dir):
    return A.log_height(FX.raw_blocks(spark, sf_dir), FX.chains(spark), block_col="number")


@register("chain_state", with_views("""
SELECT c.chain_id, CAST(coalesce(max(l.block_number), 0) AS BIGINT) AS startBlock,
       CAST(count(l.chain_id) AS BIGINT) AS totalLogs
FROM chains c LEFT JOIN logs l ON l.chain_id = c.chain_id GROUP BY c.chain_id
""", "chains", "logs"))
def q_chain_state(spark, sf_dir):
    return A.chain_state(tables.logs(spark, sf_dir), FX.chains(spark))


@register("log_stats", with_views("""
SELECT c.chain_id, CAST(count(l.chain_id) AS BIGINT) AS total,
       CAST(coalesce(max(l.block_number), 0) AS BIGINT) AS maxIndexedBlock
FROM chains c LEFT JOIN logs l ON l.chain_id = c.chain_id GROUP BY c.chain_id
""", "chains", "logs"))
def q_log_stats(spark, sf_dir):
    return A.log_stats(tables.logs(spark, sf_dir), chains=FX.chains(spark))


_PROGRESS_SQL = """
SELECT c.chain_id, CAST(count(l.chain_id) AS BIGINT) AS total,
  CAST(coalesce(max(l.block_number), 0) AS BIGINT) AS maxIndexedBlock, t.archive_height, c.margin,
  CASE WHEN coalesce(t.archive_height, 0) - c.margin <= 0 THEN 0.0 ELSE
    CAST((2 * CAST(coalesce(max(l.block_number), 0) AS HUGEINT) * 10000 + (t.archive_height - c.margin))
         // (2 * (t.archive_height - c.margin)) AS DOUBLE) / 100.0 END AS progress
FROM chains c LEFT JOIN logs l ON l.chain_id = c.chain_id LEFT JOIN chain_tips t ON t.chain_id = c.chain_id
GROUP BY c.chain_id, t.archive_height, c.margin
"""


@register("indexing_progress", with_views(_PROGRESS_SQL, "logs", "chain_tips", "chains"))
def q_indexing_progress(spark, sf_dir):
    stats = A.log_stats(tables.logs(spark, sf_dir), chains=FX.chains(spark))
    return A.indexing_progress(stats, FX.chain_tips(spark, sf_dir), FX.chains(spark))


@register("chain_margin", with_views("""
SELECT r.request_id, r.chain_id, c.name, c.margin
FROM log_requests r LEFT JOIN chains c ON c.chain_id = r.chain_id
""", "log_requests", "chains"))
def q_chain_margin(spark, sf_dir):
    r = FX.log_requests(spark, sf_dir).select("request_id", "chain_id")
    return A.with_chain_config(r, FX.chains(spark))


@register("list_chains", with_views("""
SELECT DISTINCT chain_id AS id, printf('https://%d.logs.example.org', chain_id) AS url FROM logs
""", "logs"))
def q_list_chains(spark, sf_dir):
    return Q.list_chains(tables.logs(spark, sf_dir))


@register("ingest_progress", with_views("""
SELECT b.chain_id, b.batch, b.chunk_size,
  CAST(sum(b.chunk_size) OVER (PARTITION BY b.chain_id ORDER BY b.batch) AS BIGINT) AS total_logs,
  b.next_block,
  CAST((2 * CAST(b.next_block AS HUGEINT) * 10000 + t.archive_height) // (2 * t.archive_height) AS DOUBLE) / 100.0 AS progress
FROM ingest_batches b LEFT JOIN chain_tips t ON t.chain_id = b.chain_id
""", "ingest_batches", "chain_tips"))
def q_ingest_progress(spark, sf_dir):
    return A.ingest_progress(FX.ingest_batches(spark, sf_dir), FX.chain_tips(spark, sf_dir))


# ---------------------------------------------------------------------------
# finality and range planning
# ---------------------------------------------------------------------------


def _safes(spark, sf_dir):
    return FN.safe_ceiling(FX.height_events(spark, sf_dir), FX.chains(spark))


_SAFES_SQL = """
, safes AS (
  SELECT h.seq, h.chain_id, h.height - c.margin AS safe
  FROM height_events h JOIN chains c ON c.chain_id = h.chain_id WHERE h.type = 'Height')
"""


@register("safe_ceiling", with_views(_SAFES_SQL + "SELECT seq, chain_id, safe FROM safes",
                                     "height_events", "chains"))
def q_safe_ceiling(spark, sf_dir):
    return _safes(spark, sf_dir).select("seq", "chain_id", "safe")


@register("final_logs", with_views(_SAFES_SQL + """
, ceil AS (SELECT chain_id, max(safe) AS ceiling FROM safes GROUP BY chain_id)
SELECT l.* FROM logs l JOIN ceil c ON c.chain_id = l.chain_id WHERE l.block_number <= c.ceiling
""", "height_events", "chains", "logs"))
def q_final_logs(spark, sf_dir):
    ceilings = FN.latest_ceiling(_safes(spark, sf_dir))
    return compare_form(FN.final_logs(tables.logs(spark, sf_dir), ceilings))


@register("plan_ranges_gapless", with_views(_SAFES_SQL + """
SELECT chain_id, seq, greatest(0, coalesce(prev_max + 1, 0)) AS from_block, safe AS to_block FROM (
  SELECT *, max(safe) OVER (PARTITION BY chain_id ORDER BY seq
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max
  FROM safes) x
WHERE safe >= greatest(0, coalesce(prev_max + 1, 0))
""", "height_events", "chains"))
def q_plan_ranges_gapless(spark, sf_dir):
    return FN.plan_ranges_gapless(_safes(spark, sf_dir), 0)


@register("plan_ranges_strict", with_views(_SAFES_SQL + """
, h AS (SELECT chain_id, seq, safe, row_number() OVER (PARTITION BY chain_id ORDER BY seq) AS k FROM safes)
, fold AS (
  WITH RECURSIVE f(chain_id, k, start, seq, from_block, to_block) AS (
    SELECT DISTINCT chain_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT),
           CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM h
    UNION ALL
    SELECT f.chain_id, h.k,
           CASE WHEN h.safe > f.start THEN h.safe + 1 ELSE f.start END,
           h.seq,
           CASE WHEN h.safe > f.start THEN f.start END,
           CASE WHEN h.safe > f.start THEN h.safe END
    FROM f JOIN h ON h.chain_id = f.chain_id AND h.k = f.k + 1)
  SELECT * FROM f)
SELECT chain_id, seq, from_block, to_block FROM fold WHERE to_block IS NOT NULL
""", "height_events", "chains"))
def q_plan_ranges_strict(spark, sf_dir):
    return FN.plan_ranges_strict(_safes(spark, sf_dir), 0)


@register("coverage_gaps", with_views("""
SELECT chain_id, prev_to + 1 AS gap_from, from_block - 1 AS gap_to FROM (
  SELECT *, max(to_block) OVER (PARTITION BY chain_id ORDER BY from_block, to_block
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_to
  FROM covered_ranges) x
WHERE from_block > prev_to + 1
""", "covered_ranges"))
def q_coverage_gaps(spark, sf_dir):
    return FN.coverage_gaps(FX.covered_ranges(spark, sf_dir))


# ---------------------------------------------------------------------------
# storage, export, streaming ingest
# Scratch output goes under the session's checkpoint folder.
# ---------------------------------------------------------------------------


@register("raw_source_json", REGISTRY["select_fields"][1])
def q_raw_source_json(spark, sf_dir):
    path = IN.write_raw_files(FX.raw_events(spark, sf_dir), scratch_path(spark, "raw-json"))
    flat = D.flatten_events(IN.read_raw_logs(spark, path, "json"))
    return flat.select("chain_id", "ingest_seq", "block_number", "log_index", "transaction_index",
                       "timestamp", "block_hash", "transaction_hash", "address", "data",
                       F.array_join("topics", ",").alias("topics"), "removed")


@register("append_roundtrip", REGISTRY["decode_logs"][1])
def q_append_roundtrip(spark, sf_dir):
    root = scratch_path(spark, "landing")
    TB.append_logs(tables.landed_logs(spark, sf_dir), root, 1)
    return compare_form(TB.read_landed(spark, root), ["ingest_seq"])


@register("replay_converges", REGISTRY["dedup_logs"][1])
def q_replay_converges(spark, sf_dir):
    """First copies as batch 1, everything as batch 2, then batch 1 replayed."""
    root = scratch_path(spark, "replay")
    landed = tables.landed_logs(spark, sf_dir)
    TB.append_logs(landed.where(F.col("ingest_seq") == 1), root, 1)
    TB.append_logs(landed, root, 2)
    TB.append_logs(landed.where(F.col("ingest_seq") == 1), root, 1)
    return compare_form(TB.dedup_landed(TB.read_landed(spark, root).drop("batch_id")))


@register("compact_logs", REGISTRY["dedup_logs"][1])
def q_compact_logs(spark, sf_dir):
    dst = TB.compact_logs(tables.landed_logs(spark, sf_dir), scratch_path(spark, "served"),
                          BATCH_BUCKET, rows=FX.log_rows(spark, sf_dir))
    return compare_form(TB.read_logs(spark, dst))


@register("storage_footprint", with_views("""
SELECT chain_id, CAST(count(*) AS BIGINT) AS rows, TRUE AS has_files, TRUE AS has_sizes FROM logs GROUP BY chain_id
""", "logs"))
def q_storage_footprint(spark, sf_dir):
    """Rows per chain from the footers; sizes depend on the writer, so only
    their presence is compared here (a test sums the footers independently)."""
    dst = TB.compact_logs(tables.landed_logs(spark, sf_dir), scratch_path(spark, "served"),
                          BATCH_BUCKET, rows=FX.log_rows(spark, sf_dir))
    f = TB.storage_footprint(spark, dst)
    return f.select("chain_id", F.col("rows").cast("bigint").alias("rows"), (F.col("files") > 0).alias("has_files"),
                    ((F.col("compressed_bytes") > 0) & (F.col("uncompressed_bytes") > 0)).alias("has_sizes"))


@register("stats_report", with_views("""
SELECT chain_id, total, maxIndexedBlock, progress, total > 0 AS has_size FROM (""" + _PROGRESS_SQL + """) p
""", "logs", "chain_tips", "chains"))
def q_stats_report(spark, sf_dir):
    dst = TB.compact_logs(tables.landed_logs(spark, sf_dir), scratch_path(spark, "served"),
                          BATCH_BUCKET, rows=FX.log_rows(spark, sf_dir))
    r = log_stats_report(spark, dst, FX.chain_tips(spark, sf_dir), FX.chains(spark))
    return r.select("chain_id", "total", "maxIndexedBlock", "progress",
                    (F.col("compressedSize") != "0 B").alias("has_size"))


@register("export_chunks", with_views(f"""
SELECT {API_SQL_COLUMNS} FROM logs
WHERE chain_id = {PAGE_CHAIN} AND topic0 = lower('{PAGE_TOPIC[2:]}')
""", "logs"))
def q_export_chunks(spark, sf_dir):
    path = scratch_path(spark, "export")
    X.export_logs(tables.logs(spark, sf_dir), path, PAGE_CHAIN, PAGE_TOPIC)
    return api_compare(X.read_export(spark, path))


def _manifest_totals(m):
    (fb, fi), (lb, li) = decode_cursor("first_cursor"), decode_cursor("last_cursor")
    m = m.select("chunk", "rows", F.struct(fb.alias("b"), fi.alias("i")).alias("first"),
                 F.struct(lb.alias("b"), li.alias("i")).alias("last"))
    nxt = m.select((F.col("chunk") - 1).alias("chunk"), F.col("first").alias("next_first"))
    t = m.join(nxt, "chunk", "left").agg(
        F.sum("rows").alias("rows"), F.min("first").alias("f"), F.max("last").alias("l"),
        F.count(F.when(F.col("next_first") < F.col("last"), 1)).alias("out_of_order"))
    return t.select(F.col("rows").cast("bigint").alias("rows"), encode_cursor(F.col("f.b"), F.col("f.i")).alias("first_cursor"),
                    encode_cursor(F.col("l.b"), F.col("l.i")).alias("last_cursor"), "out_of_order")


@register("export_manifest", with_views(f"""
SELECT CAST(count(*) AS BIGINT) AS rows,
  CAST(arg_min(block_number, pos) AS VARCHAR) || ':' || CAST(arg_min(log_index, pos) AS VARCHAR) AS first_cursor,
  CAST(arg_max(block_number, pos) AS VARCHAR) || ':' || CAST(arg_max(log_index, pos) AS VARCHAR) AS last_cursor,
  CAST(0 AS BIGINT) AS out_of_order
FROM (SELECT *, block_number * 100000 + log_index AS pos FROM logs
      WHERE chain_id = {PAGE_CHAIN} AND topic0 = lower('{PAGE_TOPIC[2:]}')) l
""", "logs"))
def q_export_manifest(spark, sf_dir):
    """The manifest's totals: rows of all chunks, first and last position, and
    chunks that begin before the one ahead of them ends (none)."""
    path = scratch_path(spark, "export")
    return _manifest_totals(X.export_logs(tables.logs(spark, sf_dir), path, PAGE_CHAIN, PAGE_TOPIC))


#: an eighth of the rows is a chunk, so the export takes several commits at every size
RESUME_CHUNKS, RESUME_STEP = 8, 3


def _export_in_two_runs(spark, sf_dir) -> str:
    """An export of the served table that stops after its first commit and goes
    on when the table has gained rows, which it must not see."""
    path = scratch_path(spark, "export-resumed")
    logs = TB.read_logs(spark, TB.compact_logs(tables.landed_logs(spark, sf_dir), scratch_path(spark, "served"), BATCH_BUCKET,
                           rows=FX.log_rows(spark, sf_dir)))
    size = Q.select_logs(logs, PAGE_CHAIN, PAGE_TOPIC).count() // RESUME_CHUNKS + 1
    XR.export_resumable(logs, path, PAGE_CHAIN, PAGE_TOPIC, chunk_rows=size, chunks_per_commit=RESUME_STEP, max_commits=1)
    later = logs.unionByName(logs.withColumn("block_number", F.col("block_number") + 1))
    XR.export_resumable(later, path, PAGE_CHAIN, PAGE_TOPIC)
    return path


@register("export_resumed", REGISTRY["export_chunks"][1])
def q_export_resumed(spark, sf_dir):
    return api_compare(XR.read_committed_export(spark, _export_in_two_runs(spark, sf_dir)))


@register("export_commits", REGISTRY["export_manifest"][1])
def q_export_commits(spark, sf_dir):
    """Totals of a resumed export's manifest, and chunks out of order (none)."""
    return _manifest_totals(XR.committed_manifest(spark, _export_in_two_runs(spark, sf_dir)))


def _run_stream(spark, source, landing, fmt="json"):
    q = IN.ingest_stream(spark, source, landing, scratch_path(spark, "ckpt"), fmt=fmt,
                         quarantine=scratch_path(spark, "quarantine"))
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


@register("stream_ingest", REGISTRY["dedup_logs"][1])
def q_stream_ingest(spark, sf_dir):
    src = IN.write_raw_files(FX.raw_events(spark, sf_dir), scratch_path(spark, "raw-stream"))
    landing = scratch_path(spark, "stream-landing")
    _run_stream(spark, src, landing)
    return compare_form(TB.dedup_landed(TB.read_landed(spark, landing).drop("batch_id")))


@register("stream_dedup", with_views("""
SELECT chain_id, block_number, block_hash, timestamp, transaction_hash, transaction_index, log_index,
       address, data, topic0, topic1, topic2, topic3, removed
FROM logs_landed WHERE ingest_seq = 1
""", "logs_landed"))
def q_stream_dedup(spark, sf_dir):
    """First copies land newest blocks first, then a backfill of the older
    ones, then the replays; the streaming keep-first dedup, with a finite
    delay, keeps every first copy."""
    src = scratch_path(spark, "raw-dedup")
    landed = tables.landed_logs(spark, sf_dir)
    first, half = landed.where(F.col("ingest_seq") == 1), F.col("block_number") % 1000 >= 500
    TB.append_logs(first.where(half), src, 1)
    out = scratch_path(spark, "dedup-out")
    sdf = spark.readStream.schema(TB.LANDED_WITH_SOURCE).parquet(src)
    q = (IN.dedup_stream(sdf, delay="1 hour").writeStream.format("parquet").option("path", out)
         .option("compression", "zstd").option("checkpointLocation", scratch_path(spark, "ckpt")).start())
    try:
        q.processAllAvailable()
        TB.append_logs(first.where(~half), src, 2)
        q.processAllAvailable()
        TB.append_logs(landed.where(F.col("ingest_seq") == 2), src, 3)
        q.processAllAvailable()
    finally:
        q.stop()
    return compare_form(spark.read.schema(TB.LANDED_WITH_SOURCE).parquet(out))


# ---------------------------------------------------------------------------
# chain tag (S13), single-page cursor (L7), micro-batch metrics
# ---------------------------------------------------------------------------
TAG_CHAIN = 10


@register("tag_chain", with_views(f"""
SELECT * FROM logs_landed WHERE chain_id = {TAG_CHAIN}
""", "logs_landed"))
def q_tag_chain(spark, sf_dir):
    """Single-chain input carries no chain column; decode tags it."""
    ev = FX.raw_events(spark, sf_dir).where(F.col("chain_id") == TAG_CHAIN).drop("chain_id") \
        .withColumn("chain_id", F.lit(None).cast("bigint"))
    good, _ = D.split_valid(D.decode_logs(D.flatten_events(ev), chain_id=TAG_CHAIN))
    return compare_form(good, ["ingest_seq"])


@register("page_cursor", with_views(f"""
SELECT CAST(count(*) AS BIGINT) AS page_rows,
  CASE WHEN count(*) >= {PAGE_LIMIT} THEN CAST(arg_max(block_number, pos) AS VARCHAR) || ':' ||
       CAST(arg_max(log_index, pos) AS VARCHAR) END AS next_cursor
FROM (SELECT block_number, log_index, block_number * 100000 + log_index AS pos FROM logs
      WHERE chain_id = {PAGE_CHAIN} AND topic0 = lower('{PAGE_TOPIC[2:]}') AND block_number >= {PAGE_FROM}
      ORDER BY block_number, log_index LIMIT {PAGE_LIMIT}) p
""", "logs"))
def q_page_cursor(spark, sf_dir):
    page = Q.get_logs(tables.logs(spark, sf_dir), PAGE_CHAIN, PAGE_TOPIC, from_block=PAGE_FROM,
                      limit=PAGE_LIMIT)
    return Q.page_cursor(page, PAGE_LIMIT)


@register("stream_metrics", with_views("""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(b.number) AS BIGINT) AS good_rows,
       max(CASE WHEN b.number IS NOT NULL THEN r.block_number END) AS max_block
FROM raw_logs r LEFT JOIN raw_blocks b ON b.chain_id = r.chain_id AND b.number = r.block_number
""", "raw_logs", "raw_blocks"))
def q_stream_metrics(spark, sf_dir):
    """Totals of the metrics table of a rate-limited ingest (T6, T9): one row
    for each micro-batch, recorded by a listener and settled against what landed."""
    src = IN.write_raw_files(FX.raw_events(spark, sf_dir), scratch_path(spark, "raw-metrics"))
    metrics, landing, bad = (scratch_path(spark, n) for n in ("metrics", "metrics-landing", "metrics-quarantine"))
    recorder = SM.record_metrics(spark, metrics)
    q = IN.ingest_stream(spark, src, landing, scratch_path(spark, "ckpt"), quarantine=bad, max_files_per_trigger=2)
    recorder.close(q)
    SM.settle_metrics(spark, metrics, landing, bad)
    return SM.read_metrics(spark, metrics).agg(F.sum("rows").alias("rows"), F.sum("good_rows").alias("good_rows"),
                                               F.max("max_block").alias("max_block"))


@register("compact_incremental", REGISTRY["dedup_logs"][1])
def q_compact_incremental(spark, sf_dir):
    """Served table built from the first copies, then the replays merged in
    bucket by bucket (only touched partitions are rewritten)."""
    landed = tables.landed_logs(spark, sf_dir)
    served = TB.compact_logs(landed.where(F.col("ingest_seq") == 1), scratch_path(spark, "served"),
                             BATCH_BUCKET, rows=FX.log_rows(spark, sf_dir))
    TB.compact_incremental(spark, landed.where(F.col("ingest_seq") == 2), served,
                           scratch_path(spark, "staging"), BATCH_BUCKET)
    return compare_form(TB.read_logs(spark, served))


@register("served_batch", REGISTRY["get_logs_batch"][1])
def q_served_batch(spark, sf_dir):
    """Batched pages answered from the compacted table: planned on its
    directory, rows by their stored ranks."""
    path = TB.compact_logs(tables.landed_logs(spark, sf_dir), scratch_path(spark, "served"), BATCH_BUCKET,
                           rows=FX.log_rows(spark, sf_dir))
    ok = materialize(_requests(spark, sf_dir)[0])
    rows_at, plan = B.stored_plan(spark, path, ok, first_page_only=True)
    rows = B.get_logs_batch(rows_at, ok, plan=materialize(plan), payload_from=TB.read_logs(spark, path), path=path)
    return rows.select("request_id", "n", "block_number", "log_index", bare_hex("address"),
                       bare_hex("data"), bare_hex("topic0"), bare_hex("transaction_hash"))


@register("served_manifest", REGISTRY["page_manifest"][1])
def q_served_manifest(spark, sf_dir):
    """Page manifest answered from the compacted table: planned on its
    directory, cursors by their stored ranks."""
    path = TB.compact_logs(tables.landed_logs(spark, sf_dir), scratch_path(spark, "served"), BATCH_BUCKET,
                           rows=FX.log_rows(spark, sf_dir))
    ok = materialize(_requests(spark, sf_dir)[0])
    rows_at, plan = B.stored_plan(spark, path, ok)
    return B.page_manifest(rows_at, ok, plan=materialize(plan))


@register("served_chain_stats", with_views("""
SELECT c.chain_id, CAST(count(l.chain_id) AS BIGINT) AS total,
       CAST(coalesce(max(l.block_number), 0) AS BIGINT) AS maxIndexedBlock
FROM chains c LEFT JOIN logs l ON l.chain_id = c.chain_id GROUP BY c.chain_id
""", "chains", "logs"))
def q_served_chain_stats(spark, sf_dir):
    """Per-chain count and height of the compacted table, answered from
    Parquet footers (one partition-filtered aggregate per configured chain)."""
    served = TB.compact_logs(tables.landed_logs(spark, sf_dir), scratch_path(spark, "served"),
                             BATCH_BUCKET, rows=FX.log_rows(spark, sf_dir))
    return chain_stats(spark, served, [c for c, _name, _margin in FX.FIXTURE_CHAINS])


# ---------------------------------------------------------------------------
# the served table tells its own width (S16, Q1, Q4) and serves final blocks
# ---------------------------------------------------------------------------
OTHER_WIDTH = 7_500


def _served_wide(spark, sf_dir, **kw):
    return TB.read_logs(spark, TB.compact_logs(tables.landed_logs(spark, sf_dir), scratch_path(spark, "served"),
                                               OTHER_WIDTH, rows=FX.log_rows(spark, sf_dir), **kw))


@register("served_page", REGISTRY["get_logs_page"][1])
def q_served_page(spark, sf_dir):
    return api_compare(Q.get_logs(_served_wide(spark, sf_dir), PAGE_CHAIN, PAGE_TOPIC, from_block=PAGE_FROM,
                                  limit=PAGE_LIMIT))


@register("served_get_log", REGISTRY["get_log"][1])
def q_served_get_log(spark, sf_dir):
    return api_compare(Q.get_log(_served_wide(spark, sf_dir), GET_LOG_CHAIN, GET_LOG_BLOCK, GET_LOG_INDEX))


@register("served_get_log_batch", REGISTRY["get_log_batch"][1])
def q_served_get_log_batch(spark, sf_dir):
    path = TB.compact_logs(tables.landed_logs(spark, sf_dir), scratch_path(spark, "served"), OTHER_WIDTH,
                           rows=FX.log_rows(spark, sf_dir))
    res = B.get_log_batch(TB.read_logs(spark, path), FX.log_positions(spark, sf_dir), path)
    return res.select("request_id", "found", "block_number", "log_index", bare_hex("address"),
                      bare_hex("topic0"))


@register("served_final", REGISTRY["final_logs"][1])
def q_served_final(spark, sf_dir):
    """Compaction with the chains' ceilings: no unfinal block is ever served."""
    ceilings = FN.latest_ceiling(_safes(spark, sf_dir))
    return compare_form(_served_wide(spark, sf_dir, ceilings=ceilings))


@register("planned_gaps", with_views("""
, planned AS (SELECT chain_id, lo - 1200 AS lo, hi + 700 AS hi FROM (
    SELECT chain_id, min(from_block) AS lo, max(to_block) AS hi FROM covered_ranges GROUP BY chain_id) e
  UNION ALL SELECT CAST(56 AS BIGINT), CAST(10 AS BIGINT), CAST(99 AS BIGINT))
, r AS (SELECT chain_id, from_block, to_block FROM covered_ranges
        UNION ALL SELECT chain_id, lo - 1, lo - 1 FROM planned UNION ALL SELECT chain_id, hi + 1, hi + 1 FROM planned)
SELECT chain_id, prev_to + 1 AS gap_from, from_block - 1 AS gap_to FROM (
  SELECT *, max(to_block) OVER (PARTITION BY chain_id ORDER BY from_block, to_block
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_to FROM r) x
WHERE from_block > prev_to + 1
""", "covered_ranges"))
def q_planned_gaps(spark, sf_dir):
    """Gaps against a plan that starts before and ends after what is covered,
    and one chain that has nothing yet."""
    covered = FX.covered_ranges(spark, sf_dir)
    planned = covered.groupBy("chain_id").agg((F.min("from_block") - 1200).alias("from_block"),
                                              (F.max("to_block") + 700).alias("to_block"))
    alone = spark.createDataFrame([(56, 10, 99)], "chain_id bigint, from_block bigint, to_block bigint")
    return FN.coverage_gaps(covered, planned=planned.unionByName(alone))


# ---------------------------------------------------------------------------
# every reject reason (S11): raw rows spoiled by their key, one way each
# ---------------------------------------------------------------------------
SPOILED = [("chain_id", None, "chain_id_missing"), ("log_index", None, "log_index_missing"),
           ("transaction_index", None, "transaction_index_missing"), ("transaction_hash", None, "transaction_hash_missing"),
           ("transaction_hash", "0xzz", "transaction_hash_hex"), ("transaction_hash", "0x" + "a" * 65, "transaction_hash_length"),
           ("address", None, "address_missing"), ("address", "0xg1", "address_hex"), ("address", "0x" + "b" * 41, "address_length"),
           ("data", None, "data_missing"), ("data", "0xabc", "data_hex"), ("t0", "0xq", "topic0_hex"),
           ("t0", "0x" + "c" * 66, "topic0_length"), ("block_number", None, "block_missing")]
_SPOIL_EVERY = len(SPOILED) + 3


@register("quarantine_reasons", with_views(f"""
, s AS (SELECT block_number % {_SPOIL_EVERY} AS k FROM raw_logs)
SELECT CASE k {' '.join(f"WHEN {i} THEN '{r}'" for i, (_c, _v, r) in enumerate(SPOILED))} ELSE 'ok' END AS reject_reason,
       count(*) AS n
FROM s GROUP BY 1
""", "raw_logs"))
def q_quarantine_reasons(spark, sf_dir):
    r, b = FX.raw_logs(spark, sf_dir), FX.raw_blocks(spark, sf_dir)
    kind = F.col("_k")
    flat = r.withColumn("_k", F.col("block_number") % _SPOIL_EVERY)
    headed = D.attach_block_header(flat, b).withColumn("_k", F.col("block_number") % _SPOIL_EVERY)
    for i, (col, value, _reason) in enumerate(SPOILED):
        if col == "t0":
            headed = headed.withColumn("topics", F.when(kind == i, F.array(F.lit(value))).otherwise(F.col("topics")))
        elif col == "block_number":
            headed = headed.withColumn("has_block", F.when(kind == i, F.lit(False)).otherwise(F.col("has_block")))
        else:
            headed = headed.withColumn(col, F.when(kind == i, F.lit(value)).otherwise(F.col(col)))
    d = D.decode_logs(headed)
    return d.groupBy(F.coalesce(F.col("reject_reason"), F.lit("ok")).alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))


@register("served_batch_cells", REGISTRY["get_logs_batch"][1])
def q_served_batch_cells(spark, sf_dir):
    """Batched pages from wide storage buckets with narrow rank cells."""
    path = TB.compact_logs(tables.landed_logs(spark, sf_dir), scratch_path(spark, "served"), OTHER_WIDTH, cell_blocks=500,
                           rows=FX.log_rows(spark, sf_dir))
    ok = materialize(_requests(spark, sf_dir)[0])
    rows_at, plan = B.stored_plan(spark, path, ok, first_page_only=True)
    rows = B.get_logs_batch(rows_at, ok, plan=materialize(plan), payload_from=TB.read_logs(spark, path), path=path)
    return rows.select("request_id", "n", "block_number", "log_index", bare_hex("address"),
                       bare_hex("data"), bare_hex("topic0"), bare_hex("transaction_hash"))


def _merged_in_two(spark, sf_dir):
    """A served table whose replays came by an incremental compaction, twice."""
    landed = tables.landed_logs(spark, sf_dir)
    path = TB.compact_logs(landed.where(F.col("ingest_seq") == 1), scratch_path(spark, "served"), OTHER_WIDTH,
                           rows=FX.log_rows(spark, sf_dir))
    for _ in range(2):
        TB.compact_incremental(spark, landed.where(F.col("ingest_seq") == 2), path, scratch_path(spark, "staging"))
    return path


@register("served_log_stats", REGISTRY["served_chain_stats"][1])
def q_served_log_stats(spark, sf_dir):
    """Count and height per chain from the directory, after replays."""
    return served_stats(spark, _merged_in_two(spark, sf_dir), FX.chains(spark))


@register("served_chains", REGISTRY["list_chains"][1])
def q_served_chains(spark, sf_dir):
    return Q.list_served_chains(spark, _merged_in_two(spark, sf_dir))


@register("stream_directory", with_views(f"""
, s AS (SELECT chain_id, topic0, block_number, unnest(['', address]) AS skey FROM logs)
SELECT chain_id, topic0, skey, block_number // {OTHER_WIDTH} AS cell, count(*) AS cell_rows FROM s GROUP BY ALL
""", "logs"))
def q_stream_directory(spark, sf_dir):
    """Rows per stream and cell as the directory keeps them, after replays."""
    path = _merged_in_two(spark, sf_dir)
    rows = directory.streams(TB.read_logs(spark, path), path)
    return rows.select("chain_id", bare_hex("topic0"), bare_hex("skey"), "cell", "cell_rows")


# ---------------------------------------------------------------------------
# live ingest: source by height# live ingest: source by height, planner with state, ledger, hold-back
# (S1, S2, T1-T4, T6, Q9).  Each stream is stopped and started again on its
# checkpoint, with new input in between.
# ---------------------------------------------------------------------------
LIVE_PARTS = 3


def _parts(df, key, parts=LIVE_PARTS):
    """``df`` in parts of rising ``key``, to arrive one after another."""
    n = df.agg(F.max(key)).first()[0]
    n = 1 if n is None else n + 1
    return [df.where(F.floor(F.col(key) * parts / n) == k) for k in range(parts)]


@register("raw_source_ranges", REGISTRY["select_fields"][1])
def q_raw_source_ranges(spark, sf_dir):
    """Raw events through the source by block height, segments added midway."""
    events = FX.raw_events(spark, sf_dir).withColumn("_height", F.col("log.blockNumber"))
    archive, out, checkpoint = (scratch_path(spark, x) for x in ("archive", "by-height", "ckpt"))

    def sink(batch, batch_id):
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/batch_id={batch_id}")

    for part in _parts(events, "_height", 2):
        AR.append_archive(part.drop("_height"), archive, segment_rows=2_000)
        q = AR.stream_blocks(spark, archive, rows_per_batch=20_000).writeStream.foreachBatch(sink) \
            .option("checkpointLocation", checkpoint).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    flat = D.flatten_events(spark.read.schema(RAW_EVENTS).parquet(out).drop("batch_id"))
    return flat.select("chain_id", "ingest_seq", "block_number", "log_index", "transaction_index",
                       "timestamp", "block_hash", "transaction_hash", "address", "data",
                       F.array_join("topics", ",").alias("topics"), "removed")


def _heights_in_parts(spark, sf_dir, start):
    """Height events arrive in parts; ``start(stream)`` runs on each."""
    events, src = materialize(FX.height_events(spark, sf_dir)), scratch_path(spark, "heights")
    for part in _parts(events, "seq"):
        part.write.mode("append").parquet(src)
        finished(start(spark.readStream.schema(HEIGHT_EVENTS).parquet(src)))


def _live_ranges(spark, sf_dir, mode):
    out, checkpoint = scratch_path(spark, "ranges"), scratch_path(spark, "ckpt")
    _heights_in_parts(spark, sf_dir, lambda events: PL.live_ranges(
        events, FX.chains(spark), PL.ranges_to(out), checkpoint, mode=mode))
    return out


@register("plan_ranges_live", REGISTRY["plan_ranges_strict"][1])
def q_plan_ranges_live(spark, sf_dir):
    return PL.read_ranges(spark, _live_ranges(spark, sf_dir, "strict"))


@register("ingest_ranges", with_views(f"""
SELECT l.* FROM logs l JOIN (
  SELECT chain_id, max(to_block) AS reached FROM ({REGISTRY["plan_ranges_strict"][1]}) p GROUP BY chain_id) c
ON c.chain_id = l.chain_id WHERE l.block_number <= c.reached
""", "logs"))
def q_ingest_ranges(spark, sf_dir):
    """Height events drive the ingest: planned ranges are fetched from the
    archive, landed and committed; what is committed is compared."""
    archive, landing, ledger, checkpoint = (scratch_path(spark, x) for x in ("archive", "landing", "ledger", "ckpt"))
    AR.append_archive(FX.raw_events(spark, sf_dir), archive, segment_rows=20_000, rows=FX.log_rows(spark, sf_dir))
    _heights_in_parts(spark, sf_dir, lambda events: LG.ingest_planned(
        events, FX.chains(spark), LG.archive_fetch(archive), landing, ledger, checkpoint))
    return compare_form(TB.dedup_landed(LG.read_committed(spark, landing, ledger)))


@register("ledger_ranges", with_views(f"""
SELECT p.chain_id, p.seq, p.from_block, p.to_block, count(l.block_number) AS rows
FROM ({REGISTRY["plan_ranges_strict"][1]}) p
LEFT JOIN logs_landed l ON l.chain_id = p.chain_id AND l.block_number BETWEEN p.from_block AND p.to_block
GROUP BY ALL
""", "logs_landed"))
def q_ledger_ranges(spark, sf_dir):
    """The ledger after a live ingest: every planned range and what it landed."""
    archive, landing, ledger, checkpoint = (scratch_path(spark, x) for x in ("archive", "landing", "ledger", "ckpt"))
    AR.append_archive(FX.raw_events(spark, sf_dir), archive, segment_rows=20_000, rows=FX.log_rows(spark, sf_dir))
    _heights_in_parts(spark, sf_dir, lambda events: LG.ingest_planned(
        events, FX.chains(spark), LG.archive_fetch(archive), landing, ledger, checkpoint))
    return LG.read_ledger(spark, ledger).drop("source", "batch_id")


@register("stream_final", REGISTRY["final_logs"][1])
def q_stream_final(spark, sf_dir):
    """Landed logs wait in state until the live planner's ranges release their
    blocks; logs arrive by block remainder, so every part has late ones."""
    landed, landing, ranges = tables.landed_logs(spark, sf_dir), scratch_path(spark, "landing"), scratch_path(spark, "ranges")
    out, planner, checkpoint = (scratch_path(spark, x) for x in ("final", "ckpt", "ckpt"))
    arrive = iter(range(LIVE_PARTS))

    def start(events):
        finished(PL.live_ranges(events, FX.chains(spark), PL.ranges_to(ranges), planner, mode="gapless"))
        k = next(arrive)
        TB.append_logs(landed.where(F.col("block_number") % LIVE_PARTS == k), landing, k)
        return HB.serve_final(spark.readStream.schema(TB.LANDED_WITH_SOURCE).parquet(landing),
                              spark.readStream.schema(PL.RANGES + ", batch_id bigint").parquet(ranges), out, checkpoint)

    _heights_in_parts(spark, sf_dir, start)
    return compare_form(TB.dedup_landed(spark.read.schema(TB.LANDED_WITH_BATCH).parquet(out).drop("batch_id")))
