"""Product codes of vectors, with entries found through LAESA pivots.

Components become integers ``floor(256 * x)``.  A vector is cut into ``PARTS``
equal consecutive parts; each part position has a codebook of at most
``ENTRIES`` integer entries, which starts as the parts of the smallest ids.  A
round assigns every part to its nearest entry and replaces each entry by the
floored mean of its parts.

Pivots are entries of the first codebook, far from each other, that stay fixed
for all rounds.  Every part's distances to its position's pivots are computed
once and written with the vector.  A round computes only the distances from
pivots to entries; by the triangle inequality their differences to the part's
own are lower bounds of the part's distances to the entries.  The entry of the
least bound is evaluated first, in integers; the others follow by rising bound
as long as their bound does not exceed the best distance found.  Bounds are
lowered by more than the rounding error of a double before they prune, so the
result is that of evaluating every entry, ties to the lower index included.

A round's partial sums are one row per task, part and entry.  What the driver
holds are codebooks and pivots: ``PARTS * ENTRIES`` entries, whatever the
number of vectors.

Defined cases: vectors that are null or hold null or non-finite components are
left out; repeated ids are rows of their own, and among equal ids the lesser
vector starts the codebook first; null ids come last.  The number of
components is that of the longest vector, filled up to a multiple of
``PARTS``; shorter vectors (empty ones too) are filled up with zeros.  Integer
components saturate where a vector's squared distance could pass 62 bits (at
64 components: beyond 2^27, components beyond 524,288).  Fewer than
``ENTRIES`` vectors give smaller codebooks, an empty table an empty result.
Null labels are one group.  Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batch_of, schema_of, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: pivots of each part position
PIVOTS = 4
#: vectors that are compared at once in a task
BLOCK = 1024
#: bounds are lowered by this share; doubles err by less than 1e-14 of the distances
SLACK = 1e-9

_PREPARED = "row bigint, ints array<bigint>, near array<double>"
_SUMS = "part int, entry int, n bigint, total array<bigint>"
_CODES = "row bigint, code string, error bigint"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x of the vectors without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    return vectors.filter(F.col("embedding").isNotNull() & finite).select("vec_id", "label", x.alias("x"))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), saturated where squared distances could pass 62 bits."""
    most = math.isqrt((1 << 62) // max(x.shape[1], 1)) // 2
    return np.floor(np.clip(x * SCALE, -most, most)).astype(np.int64)


def _matrix(rows: list, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix, filled up with zeros."""
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, :len(r)] = r
    return out


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between all rows of ``a`` and of ``b``, in integers."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        d = a[:, k, None] - b[None, :, k]
        out += d * d
    return out


def pick_pivots(book: np.ndarray) -> np.ndarray:
    """At most PIVOTS distinct entries of one codebook, each the one whose
    summed distance to those before it is largest."""
    far = np.sqrt(_squares(book, book).astype(float))
    chosen = [0]
    while len(chosen) < PIVOTS:
        total = far[:, chosen].sum(axis=1)
        total[far[:, chosen].min(axis=1) == 0] = -1
        if total.max() <= 0:
            break
        chosen.append(int(total.argmax()))
    return book[chosen]


def nearest(parts: np.ndarray, near: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of ``book`` to each of
    ``parts``, whose distances to the pivots are ``near``; and how many exact
    distances were evaluated."""
    to_entry = np.sqrt(_squares(pivots, book).astype(float))
    bound = np.zeros((len(parts), len(book)))
    reach = np.zeros((len(parts), 1))
    for k in range(len(pivots)):
        np.maximum(bound, np.abs(near[:, k, None] - to_entry[k]), out=bound)
        np.maximum(reach, near[:, k, None], out=reach)
    bound -= SLACK * (reach + to_entry.max() + 1)
    everyone = np.arange(len(parts))
    index = bound.argmin(axis=1)
    best = ((parts - book[index]) ** 2).sum(axis=1)
    done, evaluated = index.copy(), len(parts)
    row, entry = np.nonzero(bound <= np.sqrt(best.astype(float))[:, None])
    left = entry != done[row]
    row, entry = row[left], entry[left]
    order = np.lexsort((bound[row, entry], row))
    row, entry = row[order], entry[order]
    turn = np.arange(len(row)) - np.searchsorted(row, everyone)[row]
    for k in range(int(turn.max(initial=-1)) + 1):
        at = turn == k
        r, e = row[at], entry[at]
        open_ = bound[r, e] <= np.sqrt(best[r].astype(float))
        r, e = r[open_], e[open_]
        if not len(r):  # bounds only rise from here
            break
        d = ((parts[r] - book[e]) ** 2).sum(axis=1)
        evaluated += len(r)
        better = (d < best[r]) | ((d == best[r]) & (e < index[r]))
        index[r[better]], best[r[better]] = e[better], d[better]
    return index, best, evaluated


def _prepared(kept: DataFrame, pivots: list[np.ndarray], width: int) -> DataFrame:
    """Every vector's integers and its parts' distances to the pivots."""
    step = width // PARTS

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(_PREPARED)
        yield batch_of([], schema)
        for b in it:
            for at in range(0, b.num_rows, BLOCK):
                some = b.slice(at, BLOCK)
                ints = integers(_matrix(some.column(1).to_pylist(), width))
                near = [np.sqrt(_squares(ints[:, j * step:(j + 1) * step], pivots[j]).astype(float)) for j in range(PARTS)]
                yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), _lists(ints, pa.int64()),
                                                  _lists(np.concatenate(near, axis=1), pa.float64())], schema=schema)

    return kept.select("row", "x").mapInArrow(run, _PREPARED)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.ravel(), kind))


def _flat(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _assigned(b: pa.RecordBatch, books: list[np.ndarray], pivots: list[np.ndarray]) -> Iterator[tuple]:
    """(rows, part, integers of the part, index, squared distance), blockwise."""
    for at in range(0, b.num_rows, BLOCK):
        some = b.slice(at, BLOCK)
        n = some.num_rows
        ints, near = _flat(some.column(1), n), _flat(some.column(2), n)
        step, begin = ints.shape[1] // PARTS, 0
        for j in range(PARTS):
            parts, k = ints[:, j * step:(j + 1) * step], len(pivots[j])
            index, best, _ = nearest(parts, near[:, begin:begin + k], books[j], pivots[j])
            begin += k
            yield some.column(0), j, parts, index, best


def _round(prepared: DataFrame, books: list[np.ndarray], pivots: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(_SUMS)
        total = [np.zeros_like(x) for x in books]
        count = [np.zeros(len(x), np.int64) for x in books]
        for b in it:
            for _, j, parts, index, _ in _assigned(b, books, pivots):
                np.add.at(total[j], index, parts)
                count[j] += np.bincount(index, minlength=len(count[j]))
        yield batch_of([(j, e, int(n), total[j][e].tolist()) for j in range(PARTS)
                        for e, n in enumerate(count[j]) if n], schema)

    sums = prepared.mapInArrow(run, _SUMS)
    step = books[0].shape[1]
    totals = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(step)]
    out = [x.copy() for x in books]
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # PARTS * ENTRIES rows
        out[r["part"]][r["entry"]] = [int(r[f"t{k}"]) // r["n"] for k in range(step)]
    return out


def _coded(prepared: DataFrame, books: list[np.ndarray], pivots: list[np.ndarray]) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(_CODES)
        yield batch_of([], schema)
        for b in it:
            codes, error = [], 0
            for rows, j, _, index, best in _assigned(b, books, pivots):
                codes.append(index.astype(np.uint8))
                error = error + best
                if j == PARTS - 1:
                    text = [x.tobytes().hex() for x in np.stack(codes, axis=1)]
                    yield pa.RecordBatch.from_arrays([rows, pa.array(text), pa.array(error)], schema=schema)
                    codes, error = [], 0

    return prepared.mapInArrow(run, _CODES)


def book_text(books: list[np.ndarray]) -> str:
    """All entries' components by part, entry and position, comma-joined."""
    return ",".join(str(x) for book in books for x in book.ravel().tolist())


def compress(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every usable vector, and the codebooks:
    per part position the integer entries that the codes index."""
    kept = written(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    longest = kept.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), []
    width = max(math.ceil(longest / PARTS), 1) * PARTS
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    start = integers(_matrix([r["x"] for r in first], width))
    books = np.split(start, PARTS, axis=1)
    pivots = [pick_pivots(x) for x in books]
    prepared = written(_prepared(kept, pivots, width), "pivot-distances")
    for _ in range(ROUNDS):
        books = _round(prepared, books, pivots)
    coded = _coded(prepared, books, pivots)
    return kept.select("row", "vec_id", "label").join(coded, "row").select("vec_id", "label", "code", "error"), books


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector."""
    coded, books = compress(vectors)
    coded = written(coded, "codes")
    per_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error"))
                        .withColumnRenamed("label", "name"), "label-errors")
    return (coded.join(per_label, F.col("label").eqNullSafe(F.col("name")))
            .select("vec_id", "code", "error", "label_error",
                    F.lit(hashlib.sha256(book_text(books).encode()).hexdigest()).alias("codebooks_sha256")))


def _step(k: int, book: str) -> str:
    """SQL: the parts' assignment ``a{k}`` by the codebook table ``book``."""
    return f"""
d{k} AS MATERIALIZED (SELECT p.r, p.j, b.e, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
      FROM p JOIN {book} b USING (j)),
a{k} AS MATERIALIZED (SELECT r, j, min(struct_pack(d := d, e := e)) AS m FROM d{k} GROUP BY r, j)"""


def _means(k: int, book: str) -> str:
    """SQL: codebook ``b{k + 1}``, the floored means of assignment ``a{k}``."""
    return f"""
f{k} AS (SELECT j, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
        SELECT a.j, a.m.e AS e, unnest(p.v) AS x, unnest(range(1, len(p.v) + 1)) AS i FROM a{k} a JOIN p USING (r, j)) GROUP BY ALL),
g{k} AS (SELECT j, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM f{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.j, b.e, coalesce(g.v, b.v) AS v FROM {book} b LEFT JOIN g{k} g USING (j, e))"""


SQL = f"""
WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding::DOUBLE[]) AS r
      FROM embeddings WHERE embedding IS NOT NULL
      AND len(list_filter(embedding::DOUBLE[], lambda c: c IS NULL OR NOT isfinite(c))) = 0),
w AS (SELECT greatest(ceil(max(len(x)) / {PARTS}), 1)::BIGINT AS step FROM u),
q AS (SELECT r, list_transform(list_resize(x, step * {PARTS}, 0), lambda c: floor({SCALE} * c)::BIGINT) AS v, step FROM u, w),
p AS MATERIALIZED (SELECT r, j, v[j * step + 1:(j + 1) * step] AS v FROM q, range({PARTS}) t(j)),
b0 AS MATERIALIZED (SELECT j, r - 1 AS e, v FROM p WHERE r <= {ENTRIES}),{_step(0, "b0")},{_means(0, "b0")},{_step(1, "b1")},{_means(1, "b1")},{_step(2, "b2")},
c AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY j) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY r),
s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY j, e)) AS h FROM b2)
SELECT u.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY u.label))::BIGINT AS label_error, s.h AS codebooks_sha256
FROM c JOIN u USING (r), s
"""
