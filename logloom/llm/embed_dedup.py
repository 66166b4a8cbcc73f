"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Vectors are scaled to length one and quantised to int8 (``x = s * q + e``,
``|e|`` known for each vector).  For two vectors

    x . y = s_x s_y (q_x . q_y) + x^ . e_y + e_x . y^ + e_x . e_y
    |x . y - s_x s_y (q_x . q_y)| <= |x^||e_y| + |e_x||y^| + |e_x||e_y|

with ``x^ = s q``, so an integer tile product tells for every pair whether its
cosine can reach the threshold; only those pairs are computed again in double
precision from the given components, and only they link.

Identical vectors (same components) are one class from the start, with its
multiplicity.  Classes are dealt into blocks of about ``BLOCK``; a tile is a
pair of blocks, and every tile is its own task row, so the data is moved
``classes / BLOCK`` times and a task holds two blocks.  A tile returns per-class
link counts and a spanning forest of its links, never its pairs.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite
component link with nothing and are their own component; vectors of different
lengths do not link; rows that repeat an id are separate vectors; a null id
has a null component unless it links; an empty table gives an empty result;
extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batch_of, schema_of, written
from logloom.llm.components import components

THRESHOLD = 0.9
BLOCK = 4096
#: rows of a tile that are multiplied at once
STRIP = 256


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (row, vec_id, data, usable); one class (v, data,
    copies) for each distinct usable vector."""
    ddl = "row bigint, vec_id bigint, data binary, usable boolean"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(ddl)
        yield batch_of([], schema)
        for b in it:
            out = []
            for row, vec, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                a = np.array([np.nan if c is None else c for c in x or []], np.float64) + 0.0  # -0.0 is 0.0
                with np.errstate(over="ignore", invalid="ignore"):
                    ok = len(a) > 0 and bool(np.isfinite(a).all()) and bool(a.any())
                out.append((row, vec, a.tobytes() if ok else None, ok))
            yield batch_of(out, schema)

    inner = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint"),
                           F.col("embedding").cast("array<double>"))
    rows = written(inner.mapInArrow(run, ddl), "vectors")
    found = rows.filter("usable").groupBy("data").agg(F.min("row").alias("v"), F.count(F.lit(1)).alias("copies"))
    return rows, written(found, "classes")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without over- or underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, their scale, and the lengths of the decoded
    vector and of the error."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127.0
    codes = np.rint(x / scale).astype(np.int8)
    near = codes * scale
    return codes, scale[:, 0], np.sqrt((near * near).sum(axis=1)), np.sqrt(((x - near) ** 2).sum(axis=1))


def blocks(found: DataFrame) -> tuple[DataFrame, int]:
    """(dim, block, v, copies, data): packed blocks of vectors of one length."""
    n = found.count()
    count = max(1, -(-n // BLOCK))
    dealt = found.select(F.length("data").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(count)).alias("block"), "v", "copies", "data")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1].tolist(), "block": pdf["block"].iloc[:1].tolist(),
                             "v": [pdf["v"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()],
                             "data": [b"".join(pdf["data"])]})

    made = dealt.groupBy("dim", "block").applyInPandas(join, "dim int, block bigint, v binary, copies binary, data binary")
    return written(made, "blocks"), count


def tile_links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of ``x`` and ``y`` whose cosine reaches the
    threshold; with ``same`` each pair of one block once."""
    x, y = unit(x), unit(y)
    qx, sx, nx, ex = quantised(x)
    qy, sy, ny, ey = quantised(y)
    # int8 products up to 127^2 * n are exact in float32 for n < 1040, in float64 far beyond
    kind = np.float32 if x.shape[1] < 1040 else np.float64
    fy = qy.astype(kind).T
    for at in range(0, len(x), STRIP):
        some = slice(at, at + STRIP)
        product = (qx[some].astype(kind) @ fy) * (sx[some, None] * sy)
        bound = nx[some, None] * ey + ex[some, None] * (ny + ey)
        i, j = np.nonzero(product + bound >= threshold - 1e-9)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        i = i + at
        good = [np.zeros(0, bool)]
        for k in range(0, len(i), 1 << 16):
            good.append((x[i[k:k + (1 << 16)]] * y[j[k:k + (1 << 16)]]).sum(axis=1) >= threshold)
        good = np.concatenate(good)
        yield i[good], j[good]


def _forest(a: np.ndarray, b: np.ndarray, up: dict) -> Iterator[tuple[int, int]]:
    """Pairs that join two parts not yet joined; ``up`` goes on."""

    def find(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            up[p] = q
            yield x, y


def links(packed: DataFrame, count: int, threshold: float) -> DataFrame:
    """From every tile: link counts (a, null, n) and forest links (a, b, 0)."""
    ddl = "a bigint, b bigint, n bigint"
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    tiles = packed.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("block")  # a block beside itself comes once
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        part = {int(b): (np.frombuffer(v, np.int64), np.frombuffer(c, np.int64), np.frombuffer(d, np.float64).reshape(len(v) // 8, -1))
                for b, v, c, d in zip(pdf["block"], pdf["v"], pdf["copies"], pdf["data"])}
        out = []
        if lo in part and hi in part:
            (va, ca, xa), (vb, cb, xb) = part[lo], part[hi]
            na, nb, up = np.zeros(len(va), np.int64), np.zeros(len(vb), np.int64), {}
            for i, j in tile_links(xa, xb, lo == hi, threshold):
                np.add.at(na, i, cb[j])
                np.add.at(nb, j, ca[i])
                out.extend((x, y, 0) for x, y in _forest(va[i], vb[j], up))
            out.extend((int(v), None, int(n)) for v, n in [*zip(va, na), *zip(vb, nb)] if n)
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype({"b": "Int64"})

    return tiles.groupBy("dim", "lo", "hi").applyInPandas(tile, ddl)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    rows, found = classes(vectors)
    packed, count = blocks(found)
    made = written(links(packed, count, threshold), "tile-links")
    counts = made.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    comps = components(made.filter("b is not null").select("a", "b"))
    each = (found.select("data", "v", "copies").join(counts.withColumnRenamed("a", "v"), "v", "left")
            .join(comps.withColumnRenamed("vertex", "v"), "v", "left")
            .select("data", F.coalesce("component", "v").alias("root"),
                    (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    placed = written(rows.join(written(each, "placed-classes"), "data", "left")
                     .select("vec_id", "row", F.coalesce("root", "row").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")),
                     "placed")
    least = written(placed.groupBy("root").agg(F.min("vec_id").alias("component_id")), "least")
    return placed.join(least, "root").select("vec_id", F.col("n_links").cast("bigint").alias("n_links"), "component_id",
                                             F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, x FROM e WHERE x IS NOT NULL AND len(x) > 0
      AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (WITH RECURSIVE c(v, reach) AS (SELECT a, b FROM p UNION SELECT c.v, p.b FROM c JOIN p ON c.reach = p.a)
      SELECT v, min(reach) AS least FROM c GROUP BY v),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.least, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(r.least, e.vec_id) AS kept
FROM e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN r ON r.v = e.vec_id
"""
