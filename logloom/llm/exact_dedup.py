"""Exact dedup by composable polynomial fingerprints.

Every text (A-Z lower-cased, null as empty) is cut into chunks of ``CHUNK``
bytes.  A chunk's fingerprint is ``sum(s[i] * B^(n-1-i)) mod p`` for two
primes, all chunks of a text at once; fingerprints of neighbours combine by
``F(ab) = F(a) * B^|b| + F(b)`` (:func:`combine`), so a huge text is hashed
chunk by chunk and in any grouping, without ever holding more than its bytes.

Equal (fingerprint, length) is only a candidate.  Candidates' texts are
compared chunk by chunk: their chunks stream out as rows and ``(fingerprint,
length, chunk number)`` must have one distinct content.  The distinct runs
with map-side partial aggregation, so a group holding a third of all rows
costs each task one row per chunk.  Where contents differ (a collision), the
group is split by SHA-256.

Defined cases: null text equals the empty text; of equal texts the largest
``doc_id`` stays, a null id counting as smallest; rows that repeat one id and
text are one group of which one row stays; an empty table gives an empty
result; extra columns pass through :func:`drop_copies` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batch_of, batches, boxed, schema_of, text_bytes, written

CHUNK = 4096
#: two primes below 2^31: products of residues stay inside 64 bits
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
#: bits of the bitmap that keeps texts of unique fingerprints out of the
#: compare; a full bitmap only costs time, never a result (2^24 bits = 2 MB)
BITMAP_BITS = 24


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    for i in range(1, n):
        out[i] = int(out[i - 1]) * base % prime
    return out[::-1].copy()


_POWERS = [_powers(b, p, CHUNK) for b, p in zip(BASES, PRIMES)]
_SHIFTS = [pow(b, CHUNK, p) for b, p in zip(BASES, PRIMES)]


def combine(a: tuple[int, int], b: tuple[int, int], b_len: int) -> tuple[int, int]:
    """Fingerprint of the joined text from those of its two parts."""
    return tuple((x * pow(base, b_len, p) + y) % p for x, y, base, p in zip(a, b, BASES, PRIMES))


def chunk_fingerprints(data: bytes) -> list[np.ndarray]:
    """For each prime the fingerprints of all chunks; the first chunk is the
    short one (padding in front with zero bytes changes no fingerprint)."""
    pad = -len(data) % CHUNK
    rows = np.frombuffer(b"\0" * pad + data, np.uint8).reshape(-1, CHUNK).astype(np.uint64)
    return [(rows @ w) % np.uint64(p) for w, p in zip(_POWERS, PRIMES)]


def fingerprint(data: bytes) -> int:
    """62-bit fingerprint of a whole text; its length is kept beside it."""
    out = []
    for parts, shift, p in zip(chunk_fingerprints(data), _SHIFTS, PRIMES):
        acc = 0
        for f in parts.tolist():
            acc = (acc * shift + f) % p
        out.append(acc)
    return out[0] << 31 | out[1]


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and (fp, n_bytes, sha) of every row's normalised text."""
    inner = docs.select(*[F.col(f"`{k}`") for k in keys], F.col("text"))
    fields = [f for f in inner.schema.fields if f.name != "text"]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "fp bigint, n_bytes bigint, sha string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(ddl)
        for b in it:
            texts = [x.lower() for x in text_bytes(b.column(b.num_columns - 1))]
            cols = [b.column(i).cast(schema.field(i).type) for i in range(b.num_columns - 1)]
            cols += [pa.array([fingerprint(x) for x in texts], pa.int64()), pa.array([len(x) for x in texts], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return inner.mapInArrow(run, ddl)


def _bitmap(keys: DataFrame) -> bytes:
    """Bitmap of the low fingerprint bits; its size is fixed by BITMAP_BITS."""
    pos = F.col("fp").bitwiseAND((1 << BITMAP_BITS) - 1)
    rows = (keys.select(F.bitmap_bucket_number(pos).alias("b"), F.bitmap_bit_position(pos).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect())
    out = np.zeros((1 << BITMAP_BITS) // 8 + 4096, np.uint8)
    for r in rows:
        at = (r["b"] - 1) * 4096 if r["b"] > 0 else 0
        out[at:at + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def collisions(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(fp, n_bytes) of candidate groups whose texts are not all the same,
    found by comparing the candidates chunk by chunk."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_bitmap(repeated))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("fp bigint, n_bytes bigint, k int, chunk binary")
        look = np.frombuffer(bits.value, np.uint8)

        def rows():
            for b in it:
                for x in text_bytes(b.column(0)):
                    x = x.lower()
                    fp = fingerprint(x)
                    at = _bit_index(fp)
                    if look[at >> 3] >> (at & 7) & 1:
                        for k in range(0, len(x), CHUNK):
                            yield fp, len(x), k // CHUNK, x[k:k + CHUNK]

        yield batch_of([], schema)
        yield from batches(rows(), schema, 2_000)

    chunks = docs.select("text").mapInArrow(run, "fp bigint, n_bytes bigint, k int, chunk binary")
    different = chunks.groupBy("fp", "n_bytes", "k", "chunk").agg(F.lit(1).alias("one"))
    return (different.groupBy("fp", "n_bytes", "k").count().filter("count > 1")
            .select("fp", "n_bytes").distinct())


def _bit_index(fp: int) -> int:
    """Where bitmap_construct_agg puts a position: bucket n holds 32768 bits
    for positions (n-1)*32768+1 .. n*32768, position 0 and below apart."""
    v = fp & ((1 << BITMAP_BITS) - 1)
    if v == 0:
        return 0
    return ((v - 1) // 32768) * 32768 + (v - 1) % 32768


def group_copies(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` of every row with its group (fp, n_bytes, variant) and sha."""
    rows = written(fingerprints(docs, *keys), "fingerprints")
    repeated = rows.groupBy("fp", "n_bytes").count().filter("count > 1").select("fp", "n_bytes")
    # written: the join then sees two plain exchanges and can split a hot group
    split = written(collisions(docs, repeated).withColumn("collides", F.lit(True)), "collisions")
    return (rows.join(split, ["fp", "n_bytes"], "left")
            .withColumn("variant", F.when(F.col("collides"), F.col("sha")).otherwise(F.lit("")))
            .drop("collides"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``kept`` marks one row of each group, also where rows repeat the id."""
    ided = docs.select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id())
    rows = written(group_copies(ided, "doc_id", "__row"), "copies")
    key = ["fp", "n_bytes", "variant"]
    # written, so that both sides of the join are plain exchanges and a hot group can be split
    best = written(rows.groupBy(*key).agg(
        F.max(F.struct("doc_id", "__row")).alias("best"), F.count(F.lit(1)).alias("group_size")), "best-copies")
    return (rows.join(best, key)
            .select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                    (F.col("__row") == F.col("best.__row")).alias("kept"), F.col("sha").alias("text_sha256")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the largest id."""
    ided = written(boxed(docs), "docs-in")
    rows = group_copies(ided.select("__doc.doc_id", "__doc.text", "__row"), "doc_id", "__row")
    keep = (rows.groupBy("fp", "n_bytes", "variant").agg(F.max(F.struct("doc_id", "__row")).alias("best"))
            .select(F.col("best.__row").alias("__row")))
    return ided.join(keep, "__row", "left_semi").select("__doc.*")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id,
             count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
