"""Near-duplicate documents by a chosen-path set-similarity join.

A document is its set of distinct 5-word shingles (A-Z lower-cased; a shorter
text is one shingle; no words, no set).  Equal sets are one vertex from the
start, so exact copies, however many, cost one row.  Every vertex carries
``WIDTH`` minwise tokens.

A tree is a recursion: a node picks one minwise position from its own path and
branches its documents by their token there.  A node of at most ``LEAF``
documents is compared exhaustively; a larger one branches again, and a node
still larger after ``DEPTH`` branchings is compared exhaustively as well, in
tiles of two blocks.  Sixteen independent trees reach the recall: a pair of
similarity 0.75 stays together with probability 0.75 per branching, so 16
trees miss it with probability 2e-10 after one branching, 2.3e-3 after four and
4.3e-2 after six, the most there are.

A small node's comparison estimates similarity from the minwise tokens and
leaves out pairs under ``SCREEN`` (over 4 standard errors below the threshold).  A pair of
similarity 0.75 is under it with probability 3e-6 to 5e-6, the same in
every tree, so no repetition mends that; it adds to the probabilities above.
Tiles have no screen.

Trees run in two rounds (``ROUNDS``).  The first joins most of every group: two
trees, large nodes only in blocks that hold one common pivot, and only
``FORESTS`` spanning forests of a node's pairs are confirmed on the full sets,
best estimates first, which are as many pairs as documents and not their
square.  The second takes all sixteen trees, these two again.  It drops every
node whose documents are in one component by then.  In a node that is left, the
full sets of its documents (of a small node: those in a pair above the screen,
where the same ones meet in several trees only once) travel to the node, and
every pair of different components is tested there on the sets themselves: the numbers of common shingles of all pairs are a
product of incidence matrices.  A node gives out links that join its components
and no others, so what it returns grows with its documents and not their pairs.

Defined cases: null and empty texts have no set, link with nothing and are
their own component; rows that repeat an id are separate rows, equal sets
link; ``component_id`` is the smallest non-null id reached, null if there is
none; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import (GOLD, batch_of, batch_words, batches, boxed, mixed, schema_of, shingle_hashes,
                                text_bytes, written)
from logloom.llm.components import components

SHINGLE = 5
THRESHOLD_PCT = 75
WIDTH = 64
LEAF = 64
DEPTH = 6
ROUNDS = (range(0, 2), range(0, 16))
#: documents and shingles of one block of a tile, and shingles that one product of matrices takes
BLOCK = 2048
BLOCK_SHINGLES = 1 << 20
PRODUCT = 1024
SCREEN = 0.5
FORESTS = 3
#: bits of the bitmap that spares texts outside the candidates; fixed size,
#: false positives only cost time
BITMAP_BITS = 24

_SEEDS = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * GOLD)
_ODD = mixed(_SEEDS ^ GOLD) | np.uint64(1)


def text_sets(texts: list[bytes], width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every (lower-cased) text."""
    for at in range(0, len(texts), 400):
        h, begin = batch_words(texts[at:at + 400])
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            yield np.unique(shingle_hashes(h[a:b], width))


def text_hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128-bit fingerprint of a set as two signed 64-bit numbers."""
    if not len(s):
        return 0, 0
    a, b = mixed(s ^ GOLD).sum(dtype=np.uint64), mixed(s * GOLD).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def minwise(s: np.ndarray) -> np.ndarray:
    """WIDTH minwise tokens (32 bits each) of a non-empty set."""
    best = None
    for k in range(0, len(s), 8192):
        part = (((s[k:k + 8192, None] ^ _SEEDS) * _ODD) >> np.uint64(32)).min(axis=0)
        best = part if best is None else np.minimum(best, part)
    return best.astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_shingles, set_a, set_b, text_hash, sig of every row."""
    ddl = "doc_id bigint, row bigint, n_shingles bigint, set_a bigint, set_b bigint, text_hash bigint, sig array<int>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(ddl)

        def rows():
            for b in it:
                texts = [x.lower() for x in text_bytes(b.column(2))]
                for doc, row, x, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, text_sets(texts)):
                    yield doc, row, len(s), *set_key(s), text_hash(x), minwise(s).tolist() if len(s) else None

        yield batch_of([], schema)
        yield from batches(rows(), schema, 2_000)

    inner = docs.select(F.col("doc_id").cast("bigint"), F.monotonically_increasing_id().alias("row"), "text")
    return inner.mapInArrow(run, ddl)


def _child(path: Column, at: Column) -> Column:
    """The path of a node's child: by the token at position ``at``."""
    return F.xxhash64(path, at, F.element_at("sig", (at + 1).cast("int")))


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of nodes worth comparing, with the node's size."""
    nodes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"),
                                     F.max("comp").alias("hi")).filter("n > 1")
    # written first, so that the join's sides are plain exchanges: a hot node can be split
    return rows.join(written(nodes.filter("lo <> hi").select("path", "n"), "node-sizes"), "path")


def _pivoted(rows: DataFrame) -> DataFrame:
    """(node, v, comp, side): blocks of large nodes, all with the node's pivot."""
    blocks = F.ceil(F.col("n") / (LEAF - 4)).cast("bigint")
    own = rows.select("path", F.pmod(F.xxhash64("v", "path"), blocks).alias("block"), "v", "comp")
    pivot = (rows.groupBy("path").agg(F.min(F.struct("v", "comp")).alias("p"), F.max(blocks).alias("m"))
             .select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("block"), "p.v", "p.comp"))
    both = own.unionByName(pivot).dropDuplicates(["path", "block", "v"])
    return both.select(F.xxhash64("path", "block").alias("node"), "v", "comp", F.lit(0).alias("side"))


def _tiled(rows: DataFrame, vertices: DataFrame) -> DataFrame:
    """(node, v, comp, side): large nodes cut into blocks, and a node for every
    two blocks (sides 1 and 2) and every block (side 0) that can hold a pair of
    different components.

    A component that fills a block has blocks of its own, which are not
    compared with each other."""
    rows = rows.select("path", "v", "comp").join(vertices.select("v", "n_shingles"), "v")
    # a document's share of a block, by number or by its shingles
    share = F.greatest(F.lit(1 / BLOCK), F.col("n_shingles") / BLOCK_SHINGLES)
    sizes = rows.groupBy("path", "comp").agg(F.sum(share).alias("c"))
    sizes = written(sizes.withColumn("own", F.when(F.col("c") >= 1, F.col("comp"))), "tile-comps")
    shared = sizes.filter("own is null").groupBy("path").agg(F.ceil(F.sum("c")).cast("bigint").alias("m"))
    cut = sizes.join(written(shared, "tile-shared"), "path", "left")
    # documents of a component that shares blocks stay together, those of a large one are dealt
    many = F.when(F.col("own").isNull(), F.col("m")).otherwise(F.ceil("c")).cast("bigint")
    cut = written(cut.select("path", "comp", "own", many.alias("m")), "tile-cut")
    number = F.when(F.col("own").isNull(), F.pmod(F.xxhash64("comp", "path"), F.col("m"))).otherwise(
        F.pmod(F.xxhash64("v", "path"), F.col("m")))
    dealt = written(rows.join(cut, ["path", "comp"]).select("path", "v", "comp", "own", number.alias("number")), "tile-rows")
    blocks = written(dealt.groupBy("path", "own", "number").agg(F.count(F.lit(1)).alias("c")).drop("c")
                     .withColumn("block", F.xxhash64("path", F.coalesce("own", F.lit(-1)), "number")), "tile-blocks")
    one = blocks.select("path", F.col("own").alias("own_1"), F.col("block").alias("b1"))
    two = blocks.select("path", F.col("own").alias("own_2"), F.col("block").alias("b2"))
    tiles = written(one.join(two, "path").filter("b1 <= b2 and (own_1 is null or own_2 is null or own_1 <> own_2)")
                    .select(F.xxhash64("path", "b1", "b2").alias("node"), "path", "b1", "b2"), "tiles")
    sides = tiles.select("path", "node", F.explode(F.when(F.col("b1") == F.col("b2"), F.array(
        F.struct(F.col("b1").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(
            F.struct(F.col("b1").alias("block"), F.lit(1).alias("side")),
            F.struct(F.col("b2").alias("block"), F.lit(2).alias("side"))))).alias("s")).select("path", "node", "s.*")
    named = dealt.withColumn("block", F.xxhash64("path", F.coalesce("own", F.lit(-1)), "number"))
    return named.join(sides, ["path", "block"]).select("node", "v", "comp", "side")


def leaves(vertices: DataFrame, trees: range) -> tuple[DataFrame, DataFrame | None]:
    """(node, v, comp, side) of the small nodes of the given trees, and (path,
    v, comp, n) of the nodes that are still large after DEPTH branchings.

    ``vertices``: (v, sig, comp)."""
    start = F.explode(F.array(*[F.struct(F.xxhash64(F.lit(f"tree {t}")).alias("path"), F.lit(t).alias("at"))
                                for t in trees]))
    rows = vertices.withColumn("t", start).select(
        "v", "comp", _child(F.col("t.path"), F.col("t.at") % WIDTH).alias("path"))
    out = None
    for depth in range(1, DEPTH + 1):
        rows = written(_sized(rows), f"nodes-{depth}")
        small = rows.filter(F.col("n") <= LEAF).select(F.col("path").alias("node"), "v", "comp", F.lit(0).alias("side"))
        out = small if out is None else out.unionByName(small)
        rows = rows.filter(F.col("n") > LEAF)
        if rows.isEmpty():
            return out, None
        if depth < DEPTH:
            at = F.pmod(F.xxhash64("path", F.lit(depth)), F.lit(WIDTH))
            rows = rows.drop("n").join(vertices.select("v", "sig"), "v").select(
                "v", "comp", _child(F.col("path"), at).alias("path"))
    return out, rows


def _forests(a: np.ndarray, b: np.ndarray, est: np.ndarray) -> np.ndarray:
    """Which pairs to confirm: best estimates first, each pair goes into the
    first of ``FORESTS`` forests in which it joins two trees, and is left out
    if there is none."""
    ups: list[dict] = [{} for _ in range(FORESTS)]

    def find(up, x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    keep = np.zeros(len(a), bool)
    for k in np.argsort(-est, kind="stable").tolist():
        for up in ups:
            x, y = find(up, int(a[k])), find(up, int(b[k]))
            if x != y:
                keep[k] = True
                up[x] = y
                break
    return keep


def _screened(b: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i and j and the estimate of all pairs of a node's different
    components whose sizes and minwise tokens allow the similarity."""
    node = b.column("node").to_numpy()
    v, comp, n = (b.column(c).to_numpy() for c in ("v", "comp", "n_shingles"))
    sig = b.column("sig").combine_chunks().flatten().to_numpy().reshape(len(node), WIDTH)
    left, right, est = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    idx = np.arange(len(node))
    for shift in range(1, len(node)):
        idx = idx[idx + shift < len(node)]
        idx = idx[node[idx] == node[idx + shift]]
        if not len(idx):
            break
        k = idx[(comp[idx] != comp[idx + shift]) & (v[idx] != v[idx + shift])]
        lo, hi = np.minimum(n[k], n[k + shift]), np.maximum(n[k], n[k + shift])
        k = k[100 * lo >= THRESHOLD_PCT * hi]
        for at in range(0, len(k), 4096):
            some = k[at:at + 4096]
            e = (sig[some] == sig[some + shift]).mean(axis=1)
            good = e >= SCREEN
            left.append(some[good])
            right.append(some[good] + shift)
            est.append(e[good])
    return np.concatenate(left), np.concatenate(right), np.concatenate(est)


def _by_node(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole nodes, from batches of rows sorted by node."""
    rest = None  # the last node may go on in the next batch
    for b in it:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        node = t.column("node").to_numpy()
        if not len(node):
            continue
        cut = int(np.flatnonzero(node != node[-1])[-1]) + 1 if node[0] != node[-1] else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None:
        yield rest


def _with_sketches(nodes: DataFrame, vertices: DataFrame) -> DataFrame:
    return (nodes.join(vertices.select("v", "sig", "n_shingles"), "v").select("node", "v", "comp", "side", "n_shingles", "sig")
            .repartition("node").sortWithinPartitions("node", "v"))


def candidates(nodes: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) to confirm: FORESTS spanning forests of every
    node's pairs above the screen."""
    ddl = "a bigint, b bigint"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(ddl)

        def rows():
            for t in _by_node(it):
                i, j, e = _screened(t)
                v, comp = t.column("v").to_numpy(), t.column("comp").to_numpy()
                keep = _forests(comp[i], comp[j], e)
                a, b = v[i[keep]], v[j[keep]]
                yield from zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())

        yield batch_of([], schema)
        yield from batches(rows(), schema)

    return _with_sketches(nodes, vertices).mapInArrow(run, ddl).distinct()


_NODE = "node bigint, v bigint, comp bigint, side int"


def _parts(v: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are in a pair, and for each the number of its part: rows that
    pairs connect, named by the ``v`` that it holds."""
    label = np.arange(len(v))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        if (new == label).all():
            break
        label = new
    rows = np.unique(np.concatenate([i, j]))
    kinds, part = np.unique(label[rows], return_inverse=True)
    total = np.zeros(len(kinds), np.uint64)
    np.add.at(total, part, mixed(v[rows].view(np.uint64) ^ GOLD))
    return rows, mixed(total)[part].view(np.int64)


def doubtful(nodes: DataFrame, vertices: DataFrame) -> DataFrame:
    """(node, v, comp, side) of small nodes' rows that are in a pair above the
    screen.  Such pairs cut a node into parts, which are nodes of their own; a
    part that several trees find is one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(_NODE)
        yield batch_of([], schema)
        for t in _by_node(it):
            i, j, _ = _screened(t)
            if len(i):
                v, comp, side = (t.column(c).to_numpy() for c in ("v", "comp", "side"))
                rows, part = _parts(v, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(v[rows]), pa.array(comp[rows]), pa.array(side[rows])],
                                                 schema=schema)

    return _with_sketches(nodes, vertices).mapInArrow(run, _NODE).distinct()


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles of all pairs of two lists of sets: products
    of incidence matrices over the shingles that both lists hold, some at a
    time (exact, as sums stay far below 2^24)."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    found = []
    for sets, x in zip((left, right), flat):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(both, x)
        at[at == len(both)] = 0
        known = both[at] == x if len(both) else np.zeros(len(x), bool)
        order = np.argsort(at[known], kind="stable")
        found.append((row[known][order], at[known][order]))
    for begin in range(0, len(both), PRODUCT):
        parts = []
        for (row, at), sets in zip(found, (left, right)):
            some = slice(*np.searchsorted(at, (begin, begin + PRODUCT)))
            m = np.zeros((len(sets), min(PRODUCT, len(both) - begin)), np.float32)
            m[row[some], at[some] - begin] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def node_links(comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs of rows of one node that are similar on their sets and join its
    components; every pair of different components is tested."""
    ones, twos = np.flatnonzero(side < 2), np.flatnonzero(side != 1)
    size = np.array([len(s) for s in sets])
    common = common_shingles([sets[k] for k in ones], [sets[k] for k in twos])
    group = np.unique(comp, return_inverse=True)[1]  # joined as links are found
    for k, counts in zip(ones.tolist(), common):
        counts = counts.astype(np.int64)
        union = size[k] + size[twos] - counts
        near = twos[100 * counts >= THRESHOLD_PCT * union]
        near = near[group[near] != group[k]]
        for other, at in zip(*np.unique(group[near], return_index=True)):
            yield k, int(near[at])
            group[group == other] = group[k]


def links(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct links (a, b) that join components, from testing all pairs of
    every node on the full sets, which travel to the node."""
    ddl = "a bigint, b bigint"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(ddl)

        def rows():
            for t in _by_node(it):
                node, v, comp, side = (t.column(c).to_numpy() for c in ("node", "v", "comp", "side"))
                items = t.column("items").combine_chunks()
                flat, cut = items.flatten().to_numpy(), np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy())])
                edge = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1, [len(node)]])
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    held = [flat[x:y] for x, y in zip(cut[a:b].tolist(), cut[a + 1:b + 1].tolist())]
                    for i, j in node_links(comp[a:b], side[a:b], held):
                        yield sorted((int(v[a + i]), int(v[a + j])))

        yield batch_of([], schema)
        yield from batches(rows(), schema)

    full = nodes.join(sets, "v").select("node", "v", "comp", "side", "items")
    return full.repartition("node").sortWithinPartitions("node", "v").mapInArrow(run, ddl).distinct()


def _bitmap(sets: DataFrame) -> bytes:
    pos = F.col("text_hash").bitwiseAND((1 << BITMAP_BITS) - 1)
    rows = (sets.select(F.bitmap_bucket_number(pos + 1).alias("b"), F.bitmap_bit_position(pos + 1).alias("p"))
            .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect())
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096:r["b"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.tobytes()


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, items) for the vertices in ``wanted`` (v, set_a, set_b, text_hash).

    Only texts whose hash is in a bitmap of the wanted ones are cut into
    shingles again."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of("set_a bigint, set_b bigint, items array<bigint>")
        look = np.frombuffer(bits.value, np.uint8)

        def rows():
            for b in it:
                found = []
                for x in text_bytes(b.column(0)):
                    x = x.lower()
                    at = text_hash(x) & ((1 << BITMAP_BITS) - 1)
                    if look[at >> 3] >> (at & 7) & 1:
                        found.append(x)
                for s in text_sets(found):
                    yield *set_key(s), s.view(np.int64)

        yield batch_of([], schema)
        yield from batches(rows(), schema, 200)

    found = docs.select("text").mapInArrow(run, "set_a bigint, set_b bigint, items array<bigint>")
    return found.dropDuplicates(["set_a", "set_b"]).join(wanted.drop("text_hash"), ["set_a", "set_b"]).select("v", "items")


def _sets_of(docs: DataFrame, found: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, items) of the vertices ``v`` in ``found``, written out."""
    wanted = found.select("v").distinct().join(vertices, "v").select("v", "set_a", "set_b", "text_hash")
    return written(full_sets(docs, written(wanted, "wanted")), "sets")


def confirmed(docs: DataFrame, pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Those pairs whose full sets have the similarity."""
    sets = _sets_of(docs, pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))), vertices)
    both = (pairs.join(sets.select(F.col("v").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("v").alias("b"), F.col("items").alias("y")), "b")
            .withColumn("common", F.size(F.array_intersect("x", "y"))))
    union = F.size("x") + F.size("y") - F.col("common")
    return both.filter(100 * F.col("common") >= THRESHOLD_PCT * union).select("a", "b")


def near_components(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, row, n_shingles and component: component_id (smallest
    doc_id) and first_row (its row that stays)."""
    rows = written(sketches(docs), "sketches")
    grouped = rows.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(
        F.min("row").alias("v"), F.first("n_shingles").alias("n_shingles"), F.first("text_hash").alias("text_hash"),
        F.first("sig").alias("sig"))
    vertices = written(grouped, "vertices")
    few, many = ROUNDS
    small, large = leaves(vertices.withColumn("comp", F.col("v")), few)
    found = written(candidates(small if large is None else small.unionByName(_pivoted(large)), vertices), "pairs")
    good = written(confirmed(docs, found, vertices), "links")
    comps = components(good)

    now = (vertices.join(comps.select(F.col("vertex").alias("v"), "component"), "v", "left")
           .withColumn("comp", F.coalesce("component", "v")).drop("component"))
    small, large = leaves(now, many)
    nodes = doubtful(small, vertices)
    nodes = written(nodes if large is None else nodes.unionByName(_tiled(large, vertices)), "doubtful")
    more = written(links(nodes, _sets_of(docs, nodes, vertices)), "links")
    if not more.isEmpty():
        comps = components(good.unionByName(more))
    placed = rows.join(vertices.select("set_a", "set_b", "v"), ["set_a", "set_b"], "left").join(
        comps.withColumnRenamed("vertex", "v"), "v", "left")
    placed = placed.select("doc_id", "row", "n_shingles", F.coalesce("component", "v", "row").alias("root"),
                           F.col("n_shingles") == 0)
    placed = written(placed.select("doc_id", "row", "n_shingles", "root"), "placed")
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("f"))
    first = written(first, "first")
    return placed.join(first, "root").select("doc_id", "row", "n_shingles", F.col("f.doc_id").alias("component_id"),
                                             F.col("f.row").alias("first_row"))


def near_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return near_components(docs).select("doc_id", "n_shingles", "component_id",
                                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest id."""
    ided = written(boxed(docs), "near-in")
    named = ided.select(F.col("__row").alias("doc_id"), "__doc.text")
    order = ided.select("__row", F.col("__doc.doc_id").alias("id"))
    groups = near_components(named).select(F.col("doc_id").alias("__row"), F.col("component_id").alias("root"))
    keep = (groups.join(order, "__row").groupBy("root")
            .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row")).alias("f"))
            .select(F.col("f.__row").alias("__row")))
    return ided.join(keep, "__row", "left_semi").select("__doc.*")


SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(
             range(1, greatest(len(ws) - 3, 2)), lambda i: md5(array_to_string(ws[i:i + 4], ' ')))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * n >= 75 * (na + nb - n)),
p AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE q(v, reach) AS (SELECT a, b FROM p UNION SELECT q.v, p.b FROM q JOIN p ON q.reach = p.a)
      SELECT v, min(reach) AS least FROM q GROUP BY v)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(r.least, s.doc_id)) AS component_id,
       s.doc_id <= coalesce(r.least, s.doc_id) AS kept
FROM s LEFT JOIN r ON r.v = s.doc_id
"""
