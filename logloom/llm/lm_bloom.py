"""Language-model scoring from a log-frequency Bloom filter.

Training counts of unigrams and bigrams are quantised to levels (level ``j``:
the count reaches the ``j``-th step of a nearly geometric scale) and an n-gram
of level ``q`` puts the events ``(n-gram, 1) .. (n-gram, q)`` into a Bloom
filter.  Workers get the filter by broadcast; an n-gram's level is how many
probes in a row hit.  A bigram's conditional probability interpolates with the
unigram model,

    P(w | v) = P(w) * (a * R + 1 - a),   R <= (c(v w) / c(v)) / P(w),

with P as in the base score, ``R`` rounded down to a quarter of a power of two,
``c(v w)`` and P's count from the lower edge of their level and ``c(v)`` from
the upper edge, so quantising alone never adds up to more than one.  A bigram
counts at most what its words count, which undoes most false positives.  The
weight ``a`` depends on the size class of ``c(v)`` and is fitted by
expectation maximisation on leave-one-out counts over all training tokens.

As ``R`` has few values, one round of probing does for both: it leaves every
document's counts by (size class, R), and the leave-one-out counts of all
training documents; the weights follow from those, and the scores from the
weights.

The filter holds every n-gram of the training texts: it is sized by its events
(``EVENT_BITS`` bits each) and cut into slices by the keys' top bits.  As it
grows with the corpus, it is broadcast in passes, each a group of slices of at
most ``PASS_BYTES`` (or one slice, if that is larger; a slice stays under some
7 MB, as slices follow the bytes of text).  A batch of documents asks for each
of its distinct n-grams once: its keys are written by group, so a pass reads
the keys of its own slices only and all passes together probe every key once.
The answers (levels, in key order) go back to the batches by a join on the
batch number, where they meet the batch's tokens, written as places in its
list of words.

The base score needs exact counts.  Every document sends its distinct tokens'
counts; the ``HEAVY`` most frequent training tokens at most are broadcast as
sorted hashes with counts, and the rest are joined with the count table.

Tokens are told apart by 64-bit hashes, bigrams by ``KEY_BITS`` bits more than
the slices' number takes: as a slice holds under 2^23 n-grams, two share a key
with under 1e-5 at any size, far below the filter's own errors.

Defined cases: null and empty texts are one end token; a null id is hashed as
the empty text (held out); rows that repeat an id are scored each for itself;
without training tokens N = V = 0, base scores follow the formula and the
model's score is the base score; an empty table gives an empty result; extra
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import GOLD, batch_of, batch_words, held_out, mixed, removed, schema_of, text_bytes, written
from logloom.llm.sketch import SlicedBloom, bucket_bits, by_bucket, collected, pack, summed, unpack
from logloom.session import scratch_path

FOLDS = 10
SMOOTH = 0.1
END = np.uint64(0x5EED0FE2D)
#: filter: bits for each event, probes
EVENT_BITS, PROBES = 10, 6
#: bits of a bigram's key inside its slice
KEY_BITS = 40
#: bytes of slices that one pass broadcasts
PASS_BYTES = 32 << 20
#: bytes of text of a batch of documents, which asks for each n-gram once (a longer document is a batch of its own)
BATCH_BYTES = 2 << 20
#: keys that a pass probes at once
PROBED_AT_ONCE = 2_000_000
#: growth of the level scales of unigrams and bigrams
GROWTH = {1: 1.1, 2: 1.5}
#: most training tokens whose exact counts are broadcast (16 bytes each)
HEAVY = 1 << 19
#: cells: size classes of the context, and values of R (0, then quarters of a power of two)
CLASSES, RATIOS = 48, 256
_RATIO_LOW, _RATIO_STEP = -30.0, 0.25
#: distinct n-grams that a counting task gathers before it sends them on
FLUSH = 1_500_000


def scale(growth: float, most: int = 1 << 50) -> np.ndarray:
    """Lower edges of the levels: 1, 2, 3, ... growing by ``growth``."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return np.array(out, np.int64)


STEPS = {n: scale(g) for n, g in GROWTH.items()}


def bigram_keys(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Keys for ``1 << bits`` slices."""
    drop = np.uint64(max(0, 64 - bits - KEY_BITS))
    return mixed(left * GOLD ^ (right + GOLD)) >> drop << drop


def events(keys: np.ndarray, level: int) -> np.ndarray:
    """Hash of (n-gram, level)."""
    return mixed(keys + np.uint64(level * int(GOLD) & 0xFFFFFFFFFFFFFFFF))


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens (words and ends), the token before each, and each text's
    token count.  Before the first token stands the end of another text."""
    h, begin = batch_words([x.lower() for x in texts])
    n = np.diff(begin) + 1
    out = np.full(len(h) + len(texts), END, np.uint64)
    ends = np.cumsum(n) - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = h
    before = np.concatenate([[END], out[:-1]]) if len(out) else out
    return out, before, n


def counted(train: DataFrame, bits: int) -> DataFrame:
    """(bucket, n, keys, counts, hist): exact counts of one bucket's n-grams of
    order n, and how many have each level."""

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("n int, bucket int, keys binary, counts binary")
        held: dict[int, list] = {1: [], 2: []}
        size = 0

        def flush():
            for n, xs in held.items():
                keys, counts = summed(np.concatenate([k for k, _ in xs]), np.concatenate([c for _, c in xs]))
                yield batch_of([(n, b, pack(keys[s], ordered=True), pack(counts[s])) for b, s in by_bucket(keys, bits)], schema)
                xs.clear()

        yield batch_of([], schema)
        for big in it:
            for k in range(0, big.num_rows, 400):
                tok, before, _ = tokens_of(text_bytes(big.column(0).slice(k, 400)))
                for n, keys in ((1, tok), (2, bigram_keys(before, tok, bits))):
                    held[n].append(summed(keys, np.ones(len(keys), np.int64)))
                    size += len(held[n][-1][0])
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        keys, counts = summed(np.concatenate([unpack(x, ordered=True) for x in pdf["keys"]]),
                              np.concatenate([unpack(x) for x in pdf["counts"]]).astype(np.int64))
        level = np.searchsorted(STEPS[n], counts, side="right")
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "n": [n], "keys": [pack(keys, ordered=True)],
                             "counts": [pack(counts)], "hist": [np.bincount(level).tolist()], "total": [int(counts.sum())]})

    return (train.select("text").mapInArrow(gather, "n int, bucket int, keys binary, counts binary")
            .groupBy("n", "bucket")
            .applyInPandas(merge, "bucket int, n int, keys binary, counts binary, hist array<bigint>, total bigint"))


def histogram(table: DataFrame) -> dict[int, np.ndarray]:
    """How many n-grams have each level, by order; as long as the scale at most."""
    rows = table.select("n", F.posexplode("hist").alias("level", "c")).groupBy("n", "level").agg(F.sum("c").alias("c")).collect()
    out = {n: np.zeros(len(STEPS[n]) + 1, np.int64) for n in STEPS}
    for r in rows:
        out[r["n"]][r["level"]] = r["c"]
    return out


def filter_width(hist: dict[int, np.ndarray], bits: int) -> int:
    """Bits of one slice: room for the events of all n-grams."""
    load = sum(int((h * np.arange(len(h))).sum()) for h in hist.values())
    return (-(-load * EVENT_BITS // (1 << bits)) * 21 // 20 + 127) // 64 * 64


def filter_slices(table: DataFrame, width: int) -> DataFrame:
    """(bucket, data): the filter's slices, each from its bucket's n-grams alone."""

    def slices(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for n, keys, counts in zip(pdf["n"], pdf["keys"], pdf["counts"]):
            keys, level = unpack(keys, ordered=True), np.searchsorted(STEPS[n], unpack(counts).astype(np.int64), side="right")
            for j in range(1, int(level.max(initial=0)) + 1):
                found.append(events(keys[level >= j], j))
        data = SlicedBloom.slice_of(np.concatenate(found) if found else np.zeros(0, np.uint64), width, PROBES)
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "data": [data]})

    made = table.select("bucket", "n", "keys", "counts").groupBy("bucket").applyInPandas(slices, "bucket int, data binary")
    return written(made, "slices")


def levels(bloom: SlicedBloom, keys: np.ndarray, most: int) -> np.ndarray:
    """The level of each key: how many probes in a row hit."""
    out = np.zeros(len(keys), np.int64)
    left = np.arange(len(keys))
    for j in range(1, most + 1):
        left = left[bloom.holds(keys[left], events(keys[left], j))]
        if not len(left):
            break
        out[left] = j
    return out


def token_values(uni: np.ndarray, both: np.ndarray, tok: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of a batch: its count (lower edge), its bigram's count
    (lower edge), and the count of the token before (upper edge).  ``uni`` and
    ``both``: levels of the batch's words and bigrams; ``tok``, ``at``: each
    token's word and bigram."""
    low = np.where(uni > 0, STEPS[1][np.maximum(uni, 1) - 1], 0)
    high = np.where(uni > 0, STEPS[1][uni] - 1, 0)
    before = np.concatenate([tok[-1:], tok[:-1]])  # a batch ends with an end, and one stands before every text
    context, low = high[before], low[tok]
    pair = np.where(both > 0, STEPS[2][np.maximum(both, 1) - 1], 0)[at]
    return low, np.minimum(pair, np.minimum(low, context)), context  # a bigram is in no more often than its words


def cells_of(low: np.ndarray, both: np.ndarray, context: np.ndarray, n_tokens: int, kinds: int,
             less: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Unigram probability and cell of each token; ``less`` 1: as if this very
    token had not been counted."""
    uni = (np.maximum(low - less, 0) + SMOOTH) / (n_tokens + SMOOTH * (kinds + 1))
    ratio = np.maximum(both - less, 0) / np.maximum(context - less, 1) / uni
    with np.errstate(divide="ignore"):
        at = np.floor((np.log2(ratio) - _RATIO_LOW) / _RATIO_STEP)
    at = np.where(ratio > 0, np.clip(at, 0, RATIOS - 1), 0).astype(np.int64)
    kind = np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), CLASSES - 1)
    return uni, kind * RATIOS + at


def ratio_values() -> np.ndarray:
    """The value of R of each column of the cells."""
    return np.where(np.arange(RATIOS) > 0, 2.0 ** (_RATIO_LOW + _RATIO_STEP * np.arange(RATIOS)), 0.0)


def weights(table: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Interpolation weight of each size class, by expectation maximisation."""
    ratio = ratio_values()
    a = np.full((CLASSES, 1), 0.5)
    n = table.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        share = a * ratio / (a * ratio + 1 - a)
        a = np.clip(np.where(n > 0, (table * share).sum(axis=1, keepdims=True) / np.maximum(n, 1), 0.0), 0.0, 0.999)
    return a[:, 0]


def heavy_tokens(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and exact counts of the most frequent tokens: those whose
    level is at least the smallest for which no more than HEAVY remain."""
    hist = histogram(table.filter("n = 1"))[1]
    over = np.cumsum(hist[::-1])[::-1]
    least = int(np.argmax(over <= HEAVY)) if (over <= HEAVY).any() else len(over)
    edge = int(STEPS[1][max(least, 1) - 1])

    def pick(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("keys binary, counts binary")
        yield batch_of([], schema)
        for b in it:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys, counts = unpack(keys, ordered=True), unpack(counts)
                some = counts >= edge
                yield batch_of([(keys[some].tobytes(), counts[some].tobytes())], schema)

    rows = table.filter("n = 1").orderBy("bucket").select("keys", "counts").mapInArrow(pick, "keys binary, counts binary").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    order = np.argsort(keys)
    return keys[order], counts[order].astype(np.int64)


def token_counts(table: DataFrame) -> DataFrame:
    """(key, c) of every training token."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("key bigint, c bigint")
        for b in it:
            for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(unpack(keys, ordered=True).view(np.int64)),
                                                  pa.array(unpack(counts).astype(np.int64))], schema=schema)

    return table.filter("n = 1").select("keys", "counts").mapInArrow(run, "key bigint, c bigint")


#: parts of the table of questions beside the groups of slices (0, 1, ...)
DOCS, BODIES = -2, -1
_ASKED = ("grp int, batch bigint, ones binary, twos binary, places binary, rows array<bigint>, learns array<boolean>, "
          "sizes array<bigint>, row bigint, doc_id bigint, held_out boolean, n_tokens bigint, heavy_known bigint, "
          "heavy_log double, keys array<bigint>, times array<bigint>")


def _cut(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive runs that end where their sum first reaches ``most``."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        total += n
        if total >= most:
            out.append((start, i + 1))
            start, total = i + 1, 0
    return out + ([(start, len(sizes))] if start < len(sizes) else [])


def asked(docs: DataFrame, heavy, bits: int, per_group: int, path: str) -> DataFrame:
    """What batches of documents ask, and what they keep until the answers come.

    Part ``DOCS``: each document's base sums over the heavy tokens, and its
    other tokens with their counts.  ``BODIES``: each batch's sorted words, and
    its tokens as places in them.  Others: the batch's words and bigrams of one group of slices,
    in key order.  Written to ``path`` by part, so that a part can be removed
    when it has served."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(_ASKED)
        known, exact = heavy.value
        logs = np.log10(exact + SMOOTH)
        groups = -(-(1 << bits) // per_group)
        edges = np.arange(1, groups, dtype=np.uint64) * np.uint64(per_group) << np.uint64(64 - bits)
        yield batch_of([], schema)
        for big in it:
            texts = text_bytes(big.column(3))
            for lo, hi in _cut(np.array([len(x) + 1 for x in texts]), BATCH_BYTES):
                b = big.slice(lo, hi - lo)
                tok, before, n = tokens_of(texts[lo:hi])
                ends = np.cumsum(n)
                held, rows = np.array(b.column(2).to_pylist(), bool), b.column(1).to_pylist()
                words, place = np.unique(tok, return_inverse=True)
                pairs = np.unique(bigram_keys(before, tok, bits))
                one, two = ([0, *np.searchsorted(x, edges).tolist(), len(x)] for x in (words, pairs))
                out = [(g, rows[0], pack(words[one[g]:one[g + 1]], ordered=True), pack(pairs[two[g]:two[g + 1]], ordered=True),
                        *[None] * 12) for g in range(groups)]
                out.append((BODIES, rows[0], pack(words, ordered=True), None, pack(place), rows, ~held, n, *[None] * 8))
                spot = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                hit = (known[spot] == words)[place] if len(known) else np.zeros(len(tok), bool)
                part = np.add.reduceat(np.where(hit, logs[spot][place], 0.0), ends - n) if len(known) else np.zeros(len(n))
                count = np.add.reduceat(hit.astype(np.int64), ends - n)
                for i, (d, e) in enumerate(zip(b.column(0).to_pylist(), ends.tolist())):
                    rest, often = np.unique(tok[e - n[i]:e][~hit[e - n[i]:e]], return_counts=True)
                    out.append((DOCS, None, *[None] * 6, rows[i], d, bool(held[i]), int(n[i]), int(count[i]), float(part[i]),
                                rest.view(np.int64), often))
                yield batch_of(out, schema)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"),
                       held_out(F.col("doc_id"), FOLDS).alias("held_out"), "text")
    made = rows.mapInArrow(run, _ASKED)
    made.write.option("compression", "zstd").partitionBy("grp").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


_ANSWERS = "batch bigint, grp int, ones binary, twos binary"


def answered(questions: DataFrame, path: str, slices: DataFrame, bits: int, width: int, per_group: int) -> DataFrame:
    """(batch, grp, ones, twos): levels of the asked words and bigrams, by one
    pass for each group of slices, whose filter is broadcast.  A group's
    questions, in ``path``, are removed when its answers are written."""
    spark, base, paths = questions.sparkSession, scratch_path(questions.sparkSession, "answers"), []

    def prober(bloom, low: int):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = schema_of(_ANSWERS)
            probe = SlicedBloom(bloom.value, bits, width, PROBES, low)
            held, size = [], 0

            def flush():
                found = []
                for n in (1, 2):
                    keys = [row[1 + n] for row in held]
                    kinds, back = np.unique(np.concatenate(keys), return_inverse=True)
                    cut = np.cumsum([len(k) for k in keys])[:-1]
                    found.append(np.split(levels(probe, kinds, len(STEPS[n]) - 1)[back], cut))
                return batch_of([(r[0], r[1], pack(x), pack(y)) for r, x, y in zip(held, *found)], schema)

            yield batch_of([], schema)
            for b in it:
                for row in zip(*[c.to_pylist() for c in b.columns]):
                    held.append((row[0], row[1], unpack(row[2], ordered=True), unpack(row[3], ordered=True)))
                    size += len(held[-1][2]) + len(held[-1][3])
                    if size >= PROBED_AT_ONCE:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

        return run

    for group in range(-(-(1 << bits) // per_group)):
        low = group * per_group
        mine = slices.filter(F.col("bucket").between(low, low + per_group - 1)).withColumn("bucket", F.col("bucket") - low)
        bloom = spark.sparkContext.broadcast(bytes(collected(mine, per_group, width)))
        paths.append(f"{base}/{group}")
        (questions.filter(F.col("grp") == group).select("batch", "grp", "ones", "twos")
         .mapInArrow(prober(bloom, low), _ANSWERS).write.option("compression", "zstd").parquet(paths[-1]))
        bloom.destroy()
        removed(spark, f"{path}/grp={group}")
    return spark.read.schema(_ANSWERS).parquet(*paths)


_PROBED = "kind int, row bigint, uni_log double, cells array<int>, cell_times array<bigint>"


def probed(questions: DataFrame, answers: DataFrame, bits: int, n_tokens: int, kinds: int) -> DataFrame:
    """Rows of kind 0: each document's log10 unigram probability and its tokens
    by cell.  Kind 1: each batch's training tokens by leave-one-out cell."""

    def run(body: pd.DataFrame, levels_of: pd.DataFrame) -> pd.DataFrame:
        if not len(body):
            return pd.DataFrame({c.split()[0]: [] for c in _PROBED.split(", ")})
        r, found = body.iloc[0], levels_of.sort_values("grp")
        uni, both = (np.concatenate([unpack(x) for x in found[c]]).astype(np.int64) for c in ("ones", "twos"))
        place = unpack(r["places"]).astype(np.int64)
        tok = unpack(r["words"], ordered=True)[place]
        at = np.unique(bigram_keys(np.concatenate([tok[-1:], tok[:-1]]), tok, bits), return_inverse=True)[1]
        low, pair, context = token_values(uni, both, place, at)
        prob, cell = cells_of(low, pair, context, n_tokens, kinds)
        n = np.asarray(r["sizes"])
        ends, doc, size = np.cumsum(n), np.repeat(np.arange(len(n)), n), CLASSES * RATIOS
        learn = np.asarray(r["learns"], bool)[doc]
        table = np.bincount(cells_of(low[learn], pair[learn], context[learn], n_tokens, kinds, 1)[1], minlength=size)
        uni_log = np.add.reduceat(np.log10(prob), ends - n)
        pairs, times = np.unique(doc * size + cell, return_counts=True)
        cut = np.searchsorted(pairs, np.arange(1, len(n)) * size)
        some = np.flatnonzero(table)
        return pd.DataFrame({"kind": [0] * len(n) + [1], "row": pd.array([*np.asarray(r["rows"]).tolist(), None], "Int64"),
                             "uni_log": [*uni_log.tolist(), None],
                             "cells": [*np.split((pairs % size).astype(np.int32), cut), some.astype(np.int32)],
                             "cell_times": [*np.split(times, cut), table[some]]})

    bodies = questions.filter(F.col("grp") == BODIES).select("batch", F.col("ones").alias("words"), "places", "rows", "learns", "sizes")
    return written(bodies.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(run, _PROBED), "probed")


def evidence(rows: DataFrame) -> np.ndarray:
    """Training tokens by cell, from the tasks' tables: CLASSES x RATIOS."""
    out = np.zeros(CLASSES * RATIOS, np.int64)
    cells = rows.filter("kind = 1").select(F.explode(F.arrays_zip("cells", "cell_times")).alias("c"))
    for r in cells.groupBy("c.cells").agg(F.sum("c.cell_times").alias("n")).collect():
        out[r["cells"]] = r["n"]
    return out.reshape(CLASSES, RATIOS)


def with_scores(rows: DataFrame, a: np.ndarray) -> DataFrame:
    """(row, score): the model's log10 probability of each document, from rows of kind 0."""
    logs = np.log10(np.outer(a, ratio_values()) + (1 - a)[:, None]).ravel()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("row bigint, score double")
        for b in it:
            cells, times, uni = b.column(1), b.column(2), b.column(3).to_numpy(zero_copy_only=False)
            gain = logs[cells.flatten().to_numpy(zero_copy_only=False)] * times.flatten().to_numpy(zero_copy_only=False)
            total = np.concatenate([[0.0], np.cumsum(gain)])
            n = cells.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(uni + total[ends] - total[ends - n])], schema=schema)

    return rows.filter("kind = 0").select("row", "cells", "cell_times", "uni_log").mapInArrow(run, "row bigint, score double")


def score_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    train = docs.filter(~held_out(F.col("doc_id"), FOLDS))
    bits = bucket_bits(docs)
    table = written(counted(train, bits), "ngrams")
    sums = table.filter("n = 1").agg(F.coalesce(F.sum("total"), F.lit(0)).alias("N"),
                                     F.coalesce(F.sum(F.aggregate("hist", F.lit(0).cast("bigint"), lambda x, y: x + y)),
                                                F.lit(0)).alias("V")).first()
    n_tokens, kinds = sums["N"], sums["V"]
    width = filter_width(histogram(table), bits)
    per_group = min(1 << bits, max(1, PASS_BYTES * 8 // width))
    heavy = spark.sparkContext.broadcast(heavy_tokens(table))
    path = scratch_path(spark, "asked")
    questions = asked(docs, heavy, bits, per_group, path)
    answers = answered(questions, path, filter_slices(table, width), bits, width, per_group)
    rows = probed(questions, answers, bits, n_tokens, kinds)
    removed(spark, f"{path}/grp={BODIES}")
    a = weights(evidence(rows))
    docs_part = questions.filter(F.col("grp") == DOCS)
    rest = (docs_part.select("row", F.explode(F.arrays_zip("keys", "times")).alias("t")).select("row", "t.keys", "t.times")
            .join(token_counts(table).withColumnRenamed("key", "keys"), "keys", "left"))
    per_row = rest.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("known"),
                                      F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("logs"))
    bottom = float(np.log10(n_tokens + SMOOTH * (kinds + 1)))
    base = docs_part.select("row", "doc_id", "held_out", "n_tokens", "heavy_known", "heavy_log")
    return base.join(with_scores(rows, a), "row").join(per_row, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("heavy_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("heavy_log") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(bottom)).alias("base_score"), "score")
