"""Helpers shared by the training-data operators.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``.  On bytes that is
exactly ``bytes.split()``, and ``bytes.lower()`` changes A-Z only, so Python
tasks work on UTF-8 bytes; SQL expressions use the same character class.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: mixing constant of 64-bit hashes (odd, from the golden ratio)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def removed(spark: SparkSession, path: str) -> None:
    """Delete part of a scratch table that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back.

    Cuts the lineage with replicated storage, so lost executors never force
    the whole history to run again and several branches may read the result.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame) -> DataFrame:
    """(__row, __doc): a row number and the whole row as one column, so that no
    name in ``docs`` can clash with a column of an operator."""
    return docs.select(F.monotonically_increasing_id().alias("__row"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))


def id_text(doc_id: Column) -> Column:
    """Document id as text; null ids count as the empty text."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def held_out(doc_id: Column, folds: int) -> Column:
    return F.crc32(id_text(doc_id).cast("binary")) % folds == 0


def lower_az(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def text_bytes(batch_column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    return [b"" if x is None else x for x in batch_column.cast(pa.binary()).to_pylist()]


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
          "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
_TYPES |= {f"array<{k}>": pa.list_(v) for k, v in _TYPES.items()}


def schema_of(ddl: str) -> pa.Schema:
    """Arrow schema of a flat DDL text; needs no session, so tasks can call it."""
    pairs = [x.strip().rsplit(" ", 1) for x in ddl.split(",")]
    return pa.schema([(name.strip().strip("`"), _TYPES[kind]) for name, kind in pairs])


def worker_memory() -> dict:
    """A dict that lives as long as the Python worker, which Spark uses for
    many tasks one after another.  For memories of bounded size only."""
    return vars(sys.modules.setdefault("_logloom_worker_memory", types.ModuleType("_logloom_worker_memory")))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mix (wraps)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: base of the words' polynomial hash (odd, so that it has an inverse)
_BASE = 0x9E6F0F2D3C1B5A8F
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers (mod 2^64) of an odd base and of its inverse."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        known = tuple(np.full(max(n, 1 << 16), b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        for x in known:
            x[0] = 1
            np.cumprod(x, out=x)
        _powers[base] = known
    return known[0][:n], known[1][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word, all at once: differences of
    the running polynomial, shifted back to the word's start.  Two of a
    million different words share a hash with probability 3e-8."""
    raw = np.frombuffer(data, np.uint8)
    power, inverse = powers(_BASE, len(raw))
    space = np.concatenate([[True], _IS_SPACE[raw], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[0::2], edges[1::2]
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, out=run[1:])
    h = (run[ends] - run[starts]) * inverse[starts]
    return starts, ends, mixed(h ^ ((ends - starts).astype(np.uint64) * GOLD))


#: words (or bytes) whose running polynomial is taken at once
SEGMENT = 1 << 20
_WINDOW_BASE = 0xD1342543DE82EF95


def batch_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and where each
    text's words begin (one more at the end)."""
    out, counts, group, size = [], [], [], 0

    def flush():
        starts, _, h = word_hashes(b"\n".join(group))
        out.append(h)
        counts.append(np.diff(np.searchsorted(starts, np.cumsum([len(x) + 1 for x in group])), prepend=0))

    for x in texts:
        group.append(x)
        size += len(x)
        if size >= SEGMENT:
            flush()
            group, size = [], 0
    if group:
        flush()
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(n)])


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` consecutive word hashes."""
    out = []
    for at in range(0, len(h) - width + 1, SEGMENT):
        part = h[at:at + SEGMENT + width - 1]
        power, inverse = powers(_WINDOW_BASE, len(part))
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power, out=run[1:])
        out.append(mixed((run[width:] - run[:-width]) * inverse[:len(part) - width + 1]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes; the whole
    sequence as one when it is shorter; empty for no words."""
    return window_hashes(h, min(width, len(h))) if len(h) else h


def batches(rows: Iterator, schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    """Record batches from an iterator of tuples."""
    buf: list[tuple] = []
    for row in rows:
        buf.append(row)
        if len(buf) >= size:
            yield batch_of(buf, schema)
            buf = []
    if buf:
        yield batch_of(buf, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
