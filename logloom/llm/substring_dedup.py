"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` = 50 consecutive words; a word goes when a window that
covers it also starts in a document of a smaller id.

1. Anchors are windows of ``WINDOW - period + 1`` words that start at a word
   number whose residue modulo ``period`` is in a perfect difference set.  Two
   documents that share a window share an anchor inside it at the same place
   of the window, whatever their alignment: the set's differences cover every
   offset.  Only 6 of 31 word positions are hashed and moved.
2. Anchors seen in two or more rows make a Bloom filter of bounded size
   (false positives only cost work).
3. Windows around such anchors are candidates; the match is extended to full
   windows by hashing all 50 words.  Per chunk of documents (about
   ``CHUNK_WORDS`` words) one entry per distinct candidate goes to its hash
   bucket, with the smallest and the largest id; the bucket answers each chunk
   with the smallest id of all.
4. Each chunk removes the words of its documents that are covered by a window
   with a smaller id.

A passage in a third of all documents is one entry per chunk, never a pair.
Windows are compared by 64-bit hashes of their words.

Defined cases: null text has no words; a null id counts as larger than all
others (its copies of other documents' passages go); equal ids do not remove
from each other; texts shorter than a window lose nothing; an empty table
gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batch_of, batch_words, schema_of, text_bytes, window_hashes, written
from logloom.llm.sketch import FLUSH, SlicedBloom, bucket_bits, by_bucket, collected, pack, summed, unpack

WINDOW = 50
#: perfect difference sets by their modulus
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
PERIOD = 31
CHUNK_WORDS = 4_000_000
#: filter: bits for each shared anchor, probes, and the most bits of all (64 MB)
KEY_BITS, PROBES, MOST_BITS = 16, 4, 1 << 29
NO_ID = np.iinfo(np.int64).max


def anchors(h: np.ndarray, begin: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of a batch's words."""
    width = window - period + 1
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    at = np.arange(len(h) - width + 1)
    at = at[cover[(at - begin[doc[at]]) % period] & (at + width <= begin[doc[at] + 1])]
    return at, window_hashes(h, width)[at]


def window_starts(h: np.ndarray, begin: np.ndarray, window: int) -> np.ndarray:
    """Whether a window of one document starts at each word."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    at = np.arange(len(h))
    return at + window <= begin[doc + 1] if len(h) else np.zeros(0, bool)


def _spread(marks: np.ndarray, n: int, before: int, after: int, low: np.ndarray | None = None) -> np.ndarray:
    """Positions within [mark - before, mark + after] of some mark; ``low``:
    the least position for each mark."""
    step = np.zeros(n + 1, np.int64)
    first = marks - before if low is None else np.maximum(marks - before, low)
    np.add.at(step, np.maximum(first, 0), 1)
    np.add.at(step, np.minimum(marks + after + 1, n), -1)
    return np.cumsum(step)[:n] > 0


def shared_anchors(docs: DataFrame, bits: int, window: int, period: int) -> DataFrame:
    """(bucket, n, keys): anchors that two or more rows hold."""

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("bucket int, keys binary, counts binary")
        held, size = [], 0

        def flush():
            keys, counts = summed(np.concatenate(held), np.ones(size, np.int64))
            yield batch_of([(b, pack(keys[s], ordered=True), pack(counts[s])) for b, s in by_bucket(keys, bits)], schema)

        yield batch_of([], schema)
        for big in it:
            for k in range(0, big.num_rows, 400):
                h, begin = batch_words(text_bytes(big.column(0).slice(k, 400)))
                at, key = anchors(h, begin, window, period)
                doc = np.searchsorted(begin, at, side="right")
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                once = np.ones(len(key), bool)  # a row counts once for an anchor
                once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                held.append(key[once])
                size += int(once.sum())
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = summed(np.concatenate([unpack(x, ordered=True) for x in pdf["keys"]]),
                              np.concatenate([unpack(x) for x in pdf["counts"]]))
        keys = keys[counts > 1]
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "n": [len(keys)], "keys": [pack(keys, ordered=True)]})

    return (docs.select("text").mapInArrow(gather, "bucket int, keys binary, counts binary")
            .groupBy("bucket").applyInPandas(merge, "bucket int, n bigint, keys binary"))


def anchor_filter(shared: DataFrame, bits: int) -> tuple[bytearray, int]:
    n = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width = min(MOST_BITS >> bits, max(64, -(-n * KEY_BITS // (1 << bits)) + 63)) // 64 * 64

    def slices(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("bucket int, data binary")
        yield batch_of([], schema)
        for b in it:
            for bucket, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield batch_of([(bucket, SlicedBloom.slice_of(unpack(keys, ordered=True), width, PROBES))], schema)

    return collected(shared.select("bucket", "keys").mapInArrow(slices, "bucket int, data binary"), 1 << bits, width), width


_SCAN = "kind int, chunk bigint, row bigint, doc_id bigint, n_words bigint, sha string, text binary, bucket int, keys binary, lo binary, hi binary"


def scanned(docs: DataFrame, bloom, bits: int, width: int, window: int, period: int) -> DataFrame:
    """Rows of kind 0: documents (text only where there is a candidate window);
    of kind 1: each chunk's candidate windows by bucket."""
    reach = window - (window - period + 1)

    def run(it: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = schema_of(_SCAN)
        seen = SlicedBloom(bloom.value, bits, width, PROBES)
        part, number = TaskContext.get().partitionId(), 0
        held, words = [], 0

        def requests(chunk):
            key, doc = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            if not len(key):
                return
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lo, hi = doc[first], np.concatenate([doc[first[1:] - 1], doc[-1:]])
            key = key[first]
            yield batch_of([(1, chunk, None, None, None, None, None, b, pack(key[s], ordered=True), pack(lo[s]),
                             pack(hi[s] - lo[s])) for b, s in by_bucket(key, bits)], schema)

        yield batch_of([], schema)
        for big in it:
            for k in range(0, big.num_rows, 400):
                b = big.slice(k, 400)
                chunk = (part << 24) + number
                texts = text_bytes(b.column(2))
                ids = [NO_ID if x is None else x for x in b.column(0).to_pylist()]
                h, begin = batch_words(texts)
                at, key = anchors(h, begin, window, period)
                at = at[seen.holds(key, key)]
                low = begin[np.searchsorted(begin, at, side="right") - 1]
                cand = _spread(at, len(h), reach, 0, low) & window_starts(h, begin, window)
                pos = np.flatnonzero(cand)
                doc = np.searchsorted(begin, pos, side="right") - 1
                full = window_hashes(h, window)[pos] if len(pos) else np.zeros(0, np.uint64)
                held.append((full, np.array(ids, np.int64)[doc]))
                words += len(h)
                has = np.zeros(len(texts), bool)
                has[doc] = True
                yield batch_of([(0, chunk, row, doc_id, int(n), None if c else kept_sha(x.split()), x if c else None,
                                 None, None, None, None) for row, doc_id, n, c, x in
                                zip(b.column(1).to_pylist(), b.column(0).to_pylist(), np.diff(begin), has, texts)], schema)
                if words >= CHUNK_WORDS:
                    yield from requests(chunk)
                    held, words, number = [], 0, number + 1
        if held:
            yield from requests((part << 24) + number)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, _SCAN)


def kept_sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def answers(asked: DataFrame) -> DataFrame:
    """(chunk, keys, lo): to each chunk its windows that start in a smaller id
    than one of its own."""

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack(x, ordered=True) for x in pdf["keys"]]
        lo = [unpack(x).view(np.int64) for x in pdf["lo"]]
        hi = [a + unpack(x).view(np.int64) for a, x in zip(lo, pdf["hi"])]
        key, low = np.concatenate(keys), np.concatenate(lo)
        order = np.lexsort((low, key))
        key, low = key[order], low[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        key, low = key[first], low[first]
        out = []
        for chunk, k, top in zip(pdf["chunk"], keys, hi):
            least = low[np.searchsorted(key, k)]
            gone = top > least
            if gone.any():
                out.append((chunk, pack(k[gone], ordered=True), pack(least[gone])))
        return pd.DataFrame(out, columns=["chunk", "keys", "lo"])

    return (asked.select("bucket", "chunk", "keys", "lo", "hi").groupBy("bucket")
            .applyInPandas(answer, "chunk bigint, keys binary, lo binary"))


_OUT = "row bigint, doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary"


def removed(texts: DataFrame, replies: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """Each chunk's documents without the words that its replies cover."""

    def cut(_: tuple, docs: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack(x, ordered=True) for x in got["keys"]] or [np.zeros(0, np.uint64)])
        low = np.concatenate([unpack(x).view(np.int64) for x in got["lo"]] or [np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, low = keys[order], low[order]
        out = []
        for a in range(0, len(docs), 400):
            part = docs.iloc[a:a + 400]
            own = [bytes(x) for x in part["text"]]
            ids = np.array([NO_ID if pd.isna(x) else int(x) for x in part["doc_id"]], np.int64)
            h, begin = batch_words(own)
            pos = np.flatnonzero(window_starts(h, begin, window))
            if len(pos) and len(keys):
                full = window_hashes(h, window)[pos]
                k = np.minimum(np.searchsorted(keys, full), len(keys) - 1)
                doc = np.searchsorted(begin, pos, side="right") - 1
                pos = pos[(keys[k] == full) & (low[k] < ids[doc])]
            else:
                pos = pos[:0]
            gone = _spread(pos, len(h), 0, window - 1)
            for x, row, doc_id, b, e in zip(own, part["row"], part["doc_id"], begin[:-1], begin[1:]):
                kept = [w for w, g in zip(x.split(), gone[b:e].tolist()) if not g]
                text = b" ".join(kept)
                out.append((row, None if pd.isna(doc_id) else int(doc_id), int(e - b), int(e - b) - len(kept),
                            hashlib.sha256(text).hexdigest(), text if keep_text else None))
        made = pd.DataFrame(out, columns=["row", "doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
        return made.astype({"doc_id": "Int64"})

    return texts.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(cut, _OUT)


def substring_report(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, keep_text: bool = False) -> DataFrame:
    """row, doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``,
    ``kept`` (UTF-8) of documents that may have changed."""
    bits = bucket_bits(docs)
    shared = written(shared_anchors(docs, bits, window, period), "anchors")
    data, width = anchor_filter(shared, bits)
    bloom = docs.sparkSession.sparkContext.broadcast(bytes(data))
    scan = written(scanned(docs, bloom, bits, width, window, period), "scanned")
    replies = answers(scan.filter("kind = 1"))
    rows = scan.filter("kind = 0")
    changed = removed(rows.filter("text is not null").select("chunk", "row", "doc_id", "text"), replies, window, keep_text)
    same = rows.filter("text is null").select("row", "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"),
                                              F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    return same.unionByName(changed)


def substring_digest(docs: DataFrame) -> DataFrame:
    return substring_report(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id,
                  coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
h AS (SELECT r, id, unnest(list_transform(range(1, greatest(len(ws) - 48, 1)),
                                          lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS t,
             unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM w),
m AS (SELECT r, i, min(id) OVER (PARTITION BY t) < id AS gone FROM h),
g AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS k FROM m WHERE gone),
k AS (SELECT r, list(k) AS ks, count(*) AS n FROM g GROUP BY r)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(k.n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT coalesce(list_contains(k.ks, i), FALSE)), ' ')) AS kept_sha256
FROM w LEFT JOIN k ON k.r = w.r
"""
