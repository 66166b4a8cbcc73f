"""Toxicity by gradient-boosted trees over dense features, isotonically calibrated.

1. A lexicon is learned from labelled training documents: words (A-Z
   lower-cased, common letter substitutions undone, edge punctuation off) whose
   smoothed log odds between toxic and other documents are significant.
2. Each text becomes a few dense numbers: lexicon densities and weights,
   lexicon hits near a second-person word, capitals, punctuation, digits,
   obfuscation, repeated characters, length.
3. Boosted trees are fitted on the folds below the last training fold, and an
   isotonic regression of their margin on the last one, so that a score is a
   probability.

Only (text, label) of the training rows is used; the model never sees
``lang``, ``source`` or ``doc_id``.  At most about ``MAX_TRAIN`` labelled rows
are learned from (``max_train``): a sample by id hash when there are more.
Scoring covers every row and whole text.

Defined cases: null text counts as empty and gets the score of a text without
words; rows without label or with a null label are not learned from; with no
labelled row, or with labels of one kind only, every score is the share of
toxic among them (0 without any); repeated label rows count each; an empty
table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import (batch_of, batch_words, batches, boxed, id_text, schema_of, shingle_hashes, text_bytes,
                                written)

FOLDS = 5
MAX_TRAIN = 60_000
LEXICON = 200
#: a lexicon word occurs in so many toxic training documents, and this share of them
MIN_DOCS = 3
MIN_SHARE = 0.01
#: at most so many words are remembered by one task while it counts
MOST_WORDS = 500_000

YOU = frozenset(b"you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tus ti usted".split())
_UNDO = bytes.maketrans(b"@013457$!|", b"aoieastsil")
_EDGE = b"\"'`.,;:!?()[]{}<>*#%&$_-+=~/\\|^"
_DOUBTFUL = re.compile(rb"[a-z]*[@013457$!*|]+[a-z]+[a-z@013457$!*|]*")

NAMES = ("hits", "weight", "strongest", "distinct", "density", "near_you", "you", "capitals", "punctuation", "digits",
         "obfuscated", "repeats", "log_words", "mean_word")


def plain(word: bytes) -> bytes:
    """A lower-cased word without edge punctuation, letter substitutions undone."""
    core = word.strip(_EDGE)
    return core if core.isalpha() or not core else core.translate(_UNDO)


def learnable(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(text, label, fold) of the labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("label")).filter(
        "label is not null and __id is not null")
    known = known.withColumn("fold", F.crc32(id_text(F.col("__id")).cast("binary")) % FOLDS).filter("fold <> 0")
    n = known.count()
    share = min(1.0, max_train / max(1, n))
    sampled = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else known
    # at most about max_train rows of 16 bytes: broadcast, so that no other text moves
    return written(docs.select("doc_id", "text").join(F.broadcast(sampled), F.col("doc_id") == F.col("__id")).select("text", "label", "fold"), "labelled")


def smallest_shingle(text: Column) -> Column:
    """The smallest 5-word shingle hash of each text (0 without words)."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        h, begin = batch_words([b"" if x is None else x.encode().lower() for x in texts])
        found = [shingle_hashes(h[a:b], 5) for a, b in zip(begin[:-1], begin[1:])]
        return pd.Series([int(h.min().view(np.int64)) if len(h) else 0 for h in found], dtype="int64")

    return of(text)


def lexicon(train: DataFrame, most: int = LEXICON) -> dict[bytes, float]:
    """The ``most`` words with the most significant log odds, and their weights.

    Documents with the same smallest 5-word shingle count once: the rare words
    of one text that was copied many times are not a lexicon."""
    ddl = "word binary, toxic bigint, other bigint"

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(ddl)
        seen = {0: Counter(), 1: Counter()}

        def flush():
            words = list(seen[1].keys() | seen[0].keys())
            yield from batches(((w, seen[1][w], seen[0][w]) for w in words), schema, 20_000)
            seen[0].clear()
            seen[1].clear()

        yield batch_of([], schema)
        for b in it:
            for text, label in zip(text_bytes(b.column(0)), b.column(1).to_pylist()):
                seen[int(label == 1)].update({plain(w) for w in set(text.lower().split())} - {b""})
            if len(seen[0]) + len(seen[1]) > MOST_WORDS:
                yield from flush()
        yield from flush()

    train = train.withColumn("first", smallest_shingle(F.col("text"))).dropDuplicates(["first", "label"])
    docs = train.groupBy().agg(F.count(F.when(F.col("label") == 1, 1)).alias("t"),
                               F.count(F.when(F.col("label") != 1, 1)).alias("o")).first()
    t, o = docs["t"], docs["o"]
    if not t or not o:
        return {}
    words = (train.select("text", "label").mapInArrow(count, ddl).groupBy("word")
             .agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).filter(F.col("t") >= max(MIN_DOCS, MIN_SHARE * t)))
    odds = F.log((F.col("t") + 0.5) / (t - F.col("t") + 0.5)) - F.log((F.col("o") + 0.5) / (o - F.col("o") + 0.5))
    sd = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("o") + 0.5))
    best = (words.withColumn("odds", odds).withColumn("z", odds / sd).filter("z > 3 and odds > 0.7")
            .orderBy(F.desc("z"), "word").limit(most).collect())
    return {bytes(r["word"]): float(r["odds"]) for r in best}


def features(text: bytes, words: dict[bytes, float], memory: dict) -> list[float]:
    low = text.lower().split()
    n = len(low)
    hits: list[float] = []
    kinds, near, you, at_you, at_hit = set(), 0, 0, -99, []
    get = memory.get
    for i, w in enumerate(low):
        k = get(w)
        if k is None:
            if len(memory) > MOST_WORDS:
                memory.clear()
            core = plain(w)
            k = memory[w] = (words.get(core, 0.0), core if core in words else b"", core in YOU)
        if k[0]:
            hits.append(k[0])
            kinds.add(k[1])
            at_hit.append(i)
            near += i - at_you <= 5
        elif k[2]:
            you += 1
            at_you = i
            near += sum(1 for j in at_hit[-3:] if i - j <= 5)
    size = max(1, len(text))
    raw = np.frombuffer(text, np.uint8)
    letters = np.count_nonzero(((raw | 32) >= 97) & ((raw | 32) <= 122))
    capitals = np.count_nonzero((raw >= 65) & (raw <= 90))
    digits = np.count_nonzero((raw >= 48) & (raw <= 57))
    punct = np.count_nonzero((raw > 32) & (raw < 127)) - letters - digits
    repeats = np.count_nonzero((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])) if len(raw) > 2 else 0
    odd = sum(1 for w in set(low) if not w.isalpha() and _DOUBTFUL.fullmatch(w.strip(b".,;:\"'()?")))
    per = max(1, n)
    return [float(len(hits)), float(sum(hits)), max(hits, default=0.0), float(len(kinds)), 100.0 * len(hits) / per, float(near),
            100.0 * you / per, capitals / max(1, letters), punct / size, digits / size, 100.0 * odd / per,
            repeats / size, float(np.log1p(n)), letters / per]


def feature_column(words: dict[bytes, float]) -> Column:
    """Array of the features of column ``text``, batch by batch in Arrow."""
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        memory: dict = {}
        return pd.Series([features(b"" if x is None else x.encode(), words, memory) for x in texts], dtype=object)

    return of(F.col("text"))


class Model:
    """A fitted scorer: lexicon, trees and calibration; ``share`` when labels are of one kind."""

    def __init__(self, words, trees, isotonic, share: float) -> None:
        self.words, self.trees, self.isotonic, self.share = words, trees, isotonic, share

    def scored(self, docs: DataFrame, column: str = "score") -> DataFrame:
        if self.trees is None:
            return docs.withColumn(column, F.lit(self.share))
        inner = docs.withColumn("__vector", array_to_vector(feature_column(self.words)))
        out = margins(self.trees, inner)
        return (self.isotonic.transform(out).withColumn(column, F.least(F.greatest(F.col("__score"), F.lit(0.0)), F.lit(1.0)))
                .select(*docs.columns, column))


def margins(trees, df: DataFrame) -> DataFrame:
    out = trees.transform(df)
    return out.withColumn("__margin", vector_to_array("__raw")[1]).drop("__raw", "__prob", "__pred")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    train = learnable(docs, labels, max_train)
    by = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("label") == 1, 1)), F.lit(0)).alias("t"),
                   F.count(F.when((F.col("fold") < FOLDS - 1) & (F.col("label") == 1), 1)).alias("ft"),
                   F.count(F.when((F.col("fold") < FOLDS - 1) & (F.col("label") != 1), 1)).alias("fo"),
                   F.count(F.when(F.col("fold") == FOLDS - 1, 1)).alias("c")).first()
    if not by["ft"] or not by["fo"] or not by["c"]:
        return Model({}, None, None, by["t"] / by["n"] if by["n"] else 0.0)
    words = lexicon(train.filter(F.col("fold") < FOLDS - 1))
    rows = written(train.select("label", "fold", feature_column(words).alias("f"))
                   .select(F.when(F.col("label") == 1, 1.0).otherwise(0.0).alias("label"), "fold", "f"), "features")
    rows = rows.withColumn("__vector", array_to_vector("f"))
    gbt = GBTClassifier(featuresCol="__vector", labelCol="label", predictionCol="__pred", maxIter=20,
                        maxDepth=3, stepSize=0.2, minInstancesPerNode=5, seed=7)
    gbt = gbt.setRawPredictionCol("__raw").setProbabilityCol("__prob")
    trees = gbt.fit(rows.filter(F.col("fold") < FOLDS - 1).coalesce(8))
    held = margins(trees, rows.filter(F.col("fold") == FOLDS - 1))
    isotonic = IsotonicRegression(featuresCol="__margin", labelCol="label", predictionCol="__score").fit(held)
    return Model(words, trees, isotonic, by["t"] / by["n"])


def toxicity_report(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = fit(docs, labels, max_train).scored(docs.select("doc_id", "text"), "score")
    return scored.select("doc_id", (F.crc32(id_text(F.col("doc_id")).cast("binary")) % FOLDS == 0).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``docs`` without the rows that the model predicts toxic."""
    rows = boxed(docs).select("__doc", "__doc.text")
    return fit(docs, labels, max_train).scored(rows, "__toxicity").filter(F.col("__toxicity") < 0.5).select("__doc.*")
