"""The fixture views of FIXTURES.md as DuckDB SQL, composable into CTEs.

Used only by the correctness oracle: DuckDB sees the given tables as views,
so every oracle statement is ``WITH <needed fixture views> <query>``.
"""

from __future__ import annotations

FIXTURE_VIEWS: dict[str, str] = {}
DEPENDS: dict[str, list[str]] = {}


def _view(name: str, sql: str, deps: list[str] | None = None) -> None:
    FIXTURE_VIEWS[name] = sql.strip()
    DEPENDS[name] = deps or []


_view("raw_blocks", """
SELECT CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 137 END AS BIGINT) AS chain_id,
       o_orderkey AS number,
       CAST(epoch(o_orderdate) AS BIGINT) AS timestamp,
       '0x' || sha256('block:' || CAST(o_orderkey AS STRING)) AS block_hash
FROM orders
""")

_view("raw_logs", """
WITH l AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS li
  FROM lineitem),
b AS (
  SELECT CAST(CASE l_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 137 END AS BIGINT) AS chain_id,
    l_orderkey AS block_number,
    CAST(li AS BIGINT) AS log_index,
    CAST(l_partkey % 5 AS BIGINT) AS transaction_index,
    '0x' || sha256('tx:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_partkey % 5 AS STRING)) AS transaction_hash,
    '0x' || upper(regexp_replace(substring(sha256('addr:' || CAST(l_partkey AS STRING)), 25, 40), '^0+', '')) AS address,
    '0x' || CASE WHEN l_tax < 0.005 THEN '' ELSE
        repeat(lpad(lower(hex(CAST(l_quantity AS BIGINT))), 64, '0'), CAST(round(l_tax * 100) AS INT)) END AS data,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN NULL
         ELSE '0x' || sha256('sig:' || l_returnflag || l_linestatus) END AS t0,
    CASE WHEN l_discount > 0.025 THEN '0x' || regexp_replace(sha256('t1:' || CAST(l_suppkey AS STRING)), '^0+', '') END AS t1,
    CASE WHEN l_discount > 0.045 THEN '0x' || sha256('t2:' || CAST(l_partkey AS STRING)) END AS t2,
    CASE WHEN l_discount > 0.075 THEN '0x' || sha256('t3:' || CAST(l_linenumber AS STRING)) END AS t3,
    (l_linestatus = 'F' AND l_tax > 0.075) AS removed
  FROM l)
-- every log lands once; logs of every tenth block land again (a replay)
SELECT chain_id, block_number, log_index, transaction_index, transaction_hash, address,
       data, CAST(1 AS BIGINT) AS ingest_seq,
       t0, CASE WHEN t0 IS NOT NULL THEN t1 END AS t1,
       CASE WHEN t0 IS NOT NULL THEN t2 END AS t2,
       CASE WHEN t0 IS NOT NULL THEN t3 END AS t3,
       removed
FROM b
UNION ALL
SELECT chain_id, block_number, log_index, transaction_index, transaction_hash, address,
       data || '01', CAST(2 AS BIGINT),
       t0, CASE WHEN t0 IS NOT NULL THEN t1 END,
       CASE WHEN t0 IS NOT NULL THEN t2 END,
       CASE WHEN t0 IS NOT NULL THEN t3 END,
       removed
FROM b WHERE block_number % 10 = 0
""")

_view("logs_landed", """
SELECT r.chain_id, r.block_number,
  lower(lpad(substring(b.block_hash, 3), 64, '0')) AS block_hash,
  b.timestamp,
  lower(lpad(substring(r.transaction_hash, 3), 64, '0')) AS transaction_hash,
  r.transaction_index, r.log_index,
  lower(lpad(substring(r.address, 3), 40, '0')) AS address,
  lower(substring(r.data, 3)) AS data,
  lower(lpad(coalesce(substring(r.t0, 3), ''), 64, '0')) AS topic0,
  lower(lpad(substring(r.t1, 3), 64, '0')) AS topic1,
  lower(lpad(substring(r.t2, 3), 64, '0')) AS topic2,
  lower(lpad(substring(r.t3, 3), 64, '0')) AS topic3,
  CAST(CASE WHEN r.removed THEN 1 ELSE 0 END AS SMALLINT) AS removed,
  r.ingest_seq
FROM raw_logs r JOIN raw_blocks b ON b.chain_id = r.chain_id AND b.number = r.block_number
""", ["raw_logs", "raw_blocks"])

_view("logs", """
SELECT chain_id, block_number, block_hash, timestamp, transaction_hash, transaction_index, log_index,
       address, data, topic0, topic1, topic2, topic3, removed
FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, topic0, block_number, log_index, address
                                   ORDER BY ingest_seq DESC) AS rn FROM logs_landed) x
WHERE rn = 1
""", ["logs_landed"])

_view("chains", """
SELECT CAST(id AS BIGINT) AS chain_id, name, CAST(margin AS BIGINT) AS margin
FROM (VALUES (1,'mainnet',12),(10,'optimism',5),(56,'bsc',15),(100,'gnosis',12),(137,'polygon',64),(8453,'base',5)) AS v(id, name, margin)
""")

_view("chain_tips", """
SELECT chain_id, max(number) AS archive_height FROM raw_blocks GROUP BY chain_id
""", ["raw_blocks"])

_view("height_events", """
SELECT seq, chain_id, type,
  CASE WHEN type = 'Height' THEN n + 3 * CAST(floor(n / 4.0) AS BIGINT) - CASE WHEN n % 10 = 0 THEN 2 ELSE 0 END END AS height,
  CASE WHEN type = 'Reconnecting' THEN CAST(floor(value) AS BIGINT) END AS delay_millis,
  CASE WHEN type = 'Reconnecting' THEN 'connection lost' END AS error_msg
FROM (SELECT event_id AS seq, chain_id, value,
        CASE WHEN event_type = 'error' THEN 'Reconnecting' ELSE 'Height' END AS type,
        CAST(row_number() OVER (PARTITION BY chain_id ORDER BY event_id) AS BIGINT) AS n
      FROM (SELECT *, CAST(CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 137 END AS BIGINT) AS chain_id FROM events) e) x
""")

_view("log_requests", """
SELECT c_custkey AS request_id,
  CAST(CASE WHEN c_custkey % 50 = 9 THEN 999 WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 1 THEN 10 ELSE 137 END AS BIGINT) AS chain_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '0x' || sha256('sig:NO')
       WHEN c_mktsegment = 'MACHINERY' THEN '0x0'
       ELSE '0x' || upper(sha256('sig:AF')) END AS topic,
  CASE WHEN c_custkey % 5 = 0 THEN '0x' || substring(sha256('addr:' || CAST(c_custkey % 100 AS STRING)), 25, 40) END AS address,
  CASE WHEN c_custkey % 8 <> 0 THEN c_custkey * 5 END AS from_block,
  CASE WHEN c_custkey % 6 <> 0 THEN c_custkey * 5 + 2000 END AS to_block,
  CASE WHEN c_custkey % 50 = 8 THEN 'abc' WHEN c_custkey % 50 = 12 THEN '99999999999999999999:0' WHEN c_custkey % 4 = 1 THEN CAST(c_custkey * 6 AS STRING) || ':0' END AS cursor,
  CASE WHEN c_custkey % 50 = 7 THEN CAST(0 AS BIGINT) WHEN c_custkey % 9 <> 0 THEN CAST(5 + c_custkey % 7 AS BIGINT) END AS page_limit
FROM customer
""")

_view("log_positions", """
SELECT o_orderkey AS request_id,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 137 END AS BIGINT) AS chain_id,
  o_orderkey AS block_number, o_custkey % 6 AS log_index
FROM orders
""")

_view("ingest_batches", """
SELECT chain_id, CAST(floor(block_number / 500.0) AS BIGINT) AS batch, count(*) AS chunk_size, max(block_number) + 1 AS next_block
FROM raw_logs GROUP BY chain_id, CAST(floor(block_number / 500.0) AS BIGINT)
""", ["raw_logs"])

_view("covered_ranges", """
SELECT chain_id, batch * 500 - batch % 2 AS from_block, batch * 500 + 499 AS to_block
FROM ingest_batches WHERE batch % 7 <> 2
""", ["ingest_batches"])


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in DEPENDS[n]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_views(query: str, *names: str) -> str:
    """``WITH`` the named fixture views (and what they depend on) ``query``."""
    parts = [f"{n} AS (\n{FIXTURE_VIEWS[n]}\n)" for n in _closure(list(names))]
    return "WITH " + ",\n".join(parts) + "\n" + query.strip()


# ---------------------------------------------------------------------------
# Helper views of the oracle (not fixtures): the plain formulation of the
# request semantics, used to check the Spark plans.
# ---------------------------------------------------------------------------
_view("req_checked", """
SELECT r.*,
  CASE
    WHEN r.chain_id NOT IN (SELECT chain_id FROM chains) THEN 'unknown_chain'
    WHEN r.topic IS NULL THEN 'topic_missing'
    WHEN NOT regexp_full_match(regexp_replace(r.topic, '^0[xX]', ''), '[0-9a-fA-F]{0,64}') THEN 'topic_invalid'
    WHEN r.address IS NOT NULL AND NOT regexp_full_match(regexp_replace(r.address, '^0[xX]', ''), '[0-9a-fA-F]{1,40}') THEN 'address_invalid'
    WHEN coalesce(r.from_block, 0) < 0 THEN 'from_block_negative'
    WHEN r.to_block < 0 THEN 'to_block_negative'
    WHEN coalesce(r.page_limit, 1000) NOT BETWEEN 1 AND 1000000 THEN 'bad_limit'
    WHEN r.cursor IS NOT NULL AND (NOT regexp_full_match(r.cursor, '[0-9]+:[0-9]+')
         OR TRY_CAST(split_part(r.cursor, ':', 1) AS BIGINT) IS NULL
         OR TRY_CAST(split_part(r.cursor, ':', 2) AS BIGINT) IS NULL) THEN 'bad_cursor'
  END AS reject_reason
FROM log_requests r
""", ["log_requests", "chains"])

_view("req_ok", """
SELECT request_id, chain_id,
  lower(lpad(regexp_replace(topic, '^0[xX]', ''), 64, '0')) AS topic0,
  CASE WHEN address IS NOT NULL THEN lower(lpad(regexp_replace(address, '^0[xX]', ''), 40, '0')) END AS address,
  CASE WHEN cursor IS NOT NULL THEN coalesce(TRY_CAST(split_part(cursor, ':', 1) AS BIGINT), 0)
       ELSE coalesce(from_block, 0) END AS lo_block,
  CASE WHEN cursor IS NOT NULL THEN coalesce(TRY_CAST(split_part(cursor, ':', 2) AS BIGINT), 0)
       ELSE -1 END AS lo_index,
  to_block AS hi_block,
  coalesce(page_limit, 1000) AS page_limit
FROM req_checked WHERE reject_reason IS NULL
""", ["req_checked"])

_view("req_matched", """
SELECT r.request_id, r.page_limit, l.*,
  row_number() OVER (PARTITION BY r.request_id ORDER BY l.block_number, l.log_index) AS n
FROM req_ok r JOIN logs l
  ON l.chain_id = r.chain_id AND l.topic0 = r.topic0
 AND (r.address IS NULL OR l.address = r.address)
 AND (l.block_number > r.lo_block OR (l.block_number = r.lo_block AND l.log_index > r.lo_index))
 AND (r.hi_block IS NULL OR l.block_number <= r.hi_block)
""", ["req_ok", "logs"])
