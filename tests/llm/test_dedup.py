"""Exact, near, substring and embedding dedup against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from logloom.llm import chosen_path, embed_dedup, exact_dedup, substring_dedup
from logloom.llm.common import read, window_hashes, word_hashes
from logloom.llm.components import components
from tests.conftest import SF_SMALL
from tests.llm.conftest import rows_of


def words(text):
    return (text or "").encode().split()


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def near_brute(rows):
    """rows: (doc_id, text) -> sorted (doc_id, n_shingles, component_id, kept)."""
    sets = []
    for _, t in rows:
        w = words((t or "").encode().lower().decode())
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    u, where = Union(), defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x])
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                u.join(i, j)
        for x in s:
            where[x].append(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = u.find(i)
        if k is not None:
            least[r] = min(least.get(r, k), k)
    out = [(k, len(sets[i]), least.get(u.find(i)), k == least.get(u.find(i))) for i, (k, _) in enumerate(rows)]
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def noisy(rng, base, share):
    return " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(999)) if rng.random() < share else w for w in base)


@pytest.fixture(scope="module")
def crowded(spark):
    """A large group of near copies, one of exact copies, a passage in many
    documents, pairs on both sides of the threshold."""
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(120)]
    passage = " ".join(rng.choice(vocab) for _ in range(80))
    rows = [(i, noisy(rng, base, 0.012)) for i in range(400)]
    rows += [(1000 + i, " ".join(base[:60])) for i in range(300)]
    rows += [(2000 + i, " ".join([*[rng.choice(vocab) for _ in range(30)], passage, *[rng.choice(vocab) for _ in range(30)]]))
             for i in range(200)]
    for i in range(100):
        one = [rng.choice(vocab) for _ in range(rng.randrange(5, 200))]
        rows += [(3000 + 2 * i, " ".join(one)), (3001 + 2 * i, noisy(rng, one, 0.02 + 0.04 * (i % 3)))]
    rng.shuffle(rows)
    return rows


def test_near_groups_match_brute_force(spark, crowded):
    df = spark.createDataFrame(crowded, "doc_id bigint, text string")
    assert rows_of(chosen_path.near_report(df)) == near_brute(crowded)


def test_near_query_matches_brute_force(spark):
    docs = read(spark, SF_SMALL, "documents")
    want = near_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(chosen_path.near_report(docs)) == want


def test_near_odd_rows(odd_docs, no_docs):
    got = rows_of(chosen_path.near_report(odd_docs))
    assert len(got) == odd_docs.count()
    by = {(r[0], r[1]): r for r in got}
    assert by[2, 2] == (2, 2, 1, False)  # equal sets after lower-casing
    assert by[3, 0] == (3, 0, 3, True) and by[4, 0] == (4, 0, 4, True) and by[7, 0] == (7, 0, 7, True)
    assert by[None, 4] == (None, 4, None, True) and by[None, 0] == (None, 0, None, True)
    assert by[6, 978][2] == 5
    assert chosen_path.near_report(no_docs).collect() == []
    kept = chosen_path.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 3, 4, 5, 7, 8]
    assert kept.filter("doc_id is null").count() == 2


def test_deep_nodes_end_in_blocks_with_a_pivot(spark):
    """Documents that no minwise token tells apart still end up compared."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join([*base, f"x{rng.randrange(10**9)}"])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.component_id for r in chosen_path.near_report(df).collect()} == {0}


def changed(rng, words, n, spare=()):
    out = list(words)
    for at in rng.sample([i for i in range(len(out)) if i not in spare], n):
        out[at] = f"x{rng.randrange(10**9)}"
    return out


def just_under(rng, n, planted):
    """A family of similarity just under the threshold, and some pairs over it."""
    family = [changed(rng, [f"w{i}" for i in range(400)], 9) for _ in range(n)]
    rows = [(i, " ".join(x)) for i, x in enumerate(family)]
    return rows + [(1000 + i, " ".join(changed(rng, x, 10))) for i, x in enumerate(family[:planted])]


def test_large_nodes_compare_every_pair(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "DEPTH", 1)
    monkeypatch.setattr(chosen_path, "LEAF", 16)
    rows = just_under(random.Random(11), 300, 40)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = near_brute(rows)
    assert sum(not r[3] for r in want) >= 40
    assert rows_of(chosen_path.near_report(df)) == want


def test_pairs_over_the_threshold_among_others_just_under_it(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "DEPTH", 1)
    monkeypatch.setattr(chosen_path, "BLOCK", 50)  # several blocks and tiles
    rng = random.Random(12)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(changed(rng, base, 9))) for i in range(150)]
    for i in range(30):  # pairs over the threshold, as far from the others as those from each other
        one = changed(rng, base, 4)
        common = {k for k in range(400) if one[k] != base[k]}
        rows += [(1000 + 2 * i + k, " ".join(changed(rng, one, 5, common))) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(chosen_path.near_report(df)) == near_brute(rows)


@pytest.mark.parametrize("block, shingles", [(256, 1 << 20), (2048, 25_600)])
def test_tiles_hold_every_pair_once(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(chosen_path, "BLOCK", block)
    monkeypatch.setattr(chosen_path, "BLOCK_SHINGLES", shingles)
    comp_of = {v: 0 if v < 600 else 600 if v < 900 else 900 if v < 920 else v for v in range(1100)}
    rows = spark.createDataFrame([(7, v, c, 1100) for v, c in comp_of.items()], "path bigint, v bigint, comp bigint, n bigint")
    vertices = spark.createDataFrame([(v, 100) for v in comp_of], "v bigint, n_shingles bigint")
    nodes = defaultdict(list)
    for r in chosen_path._tiled(rows, vertices).collect():
        assert r.comp == comp_of[r.v]
        nodes[r.node].append((r.v, r.side))
    met = Counter((min(a, b), max(a, b)) for xs in nodes.values() for a, s in xs for b, t in xs
                  if a < b and (s + t) % 3 == 0 and comp_of[a] != comp_of[b])
    assert set(met.values()) == {1}
    assert len(met) == sum(comp_of[a] != comp_of[b] for a in range(1100) for b in range(a + 1, 1100))


def test_node_links_equal_a_plain_comparison(monkeypatch):
    monkeypatch.setattr(chosen_path, "PRODUCT", 7)
    rng = np.random.default_rng(8)
    for _ in range(60):
        n = int(rng.integers(2, 30))
        base = rng.choice(10**6, 60, replace=False)
        sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(45, 60)), replace=False),
                                          rng.choice(10**6, int(rng.integers(0, 6)))])) for _ in range(n)]
        comp, side = rng.integers(0, n, n), rng.integers(1, 3, n) if rng.random() < 0.5 else np.zeros(n, int)
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if (side[i] + side[j]) % 3 == 0 and comp[i] != comp[j]
                 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
        got = [tuple(sorted(x)) for x in chosen_path.node_links(comp, side, sets)]
        assert set(got) <= set(pairs)

        def joined(edges):
            label = comp.copy()
            for i, j in edges:
                label[label == label[i]] = label[j]
            return [tuple(np.flatnonzero(label == x)) for x in label]

        assert joined(got) == joined(pairs)
        assert len(got) == len(set(comp.tolist())) - len(set(joined(got)))  # a forest


def test_parts_are_named_by_their_documents():
    v = np.array([50, 7, 9, 11, 13, 9, 7, 11, 99], np.int64)
    i, j = np.array([1, 3, 5, 0]), np.array([2, 4, 6, 8])  # 7-9, 11-13, 9-7 again, 50-99; row 7 is in no pair
    rows, part = chosen_path._parts(v, i, j)
    assert rows.tolist() == [0, 1, 2, 3, 4, 5, 6, 8]
    of = dict(zip(rows.tolist(), part.tolist()))
    assert of[1] == of[2] == of[5] == of[6] and of[3] == of[4] and of[0] == of[8] and len(set(of.values())) == 3
    chain = np.arange(40, dtype=np.int64)
    assert len(set(chosen_path._parts(chain, chain[:-1], chain[1:])[1].tolist())) == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 400)] + [(500, 500)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in range(100, 400)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_fingerprints_compose():
    rng = random.Random(2)
    for _ in range(30):
        a, b = (bytes(rng.randrange(256) for _ in range(rng.choice((0, 1, 50, 4096, 9000)))) for _ in range(2))
        part = lambda f: (f >> 31, f & ((1 << 31) - 1))
        whole = exact_dedup.fingerprint(a + b)
        assert exact_dedup.combine(part(exact_dedup.fingerprint(a)), part(exact_dedup.fingerprint(b)), len(b)) == part(whole)
        assert part(whole)[0] == sum(c * pow(exact_dedup.BASES[0], len(a + b) - 1 - i, exact_dedup.PRIMES[0])
                                     for i, c in enumerate(a + b)) % exact_dedup.PRIMES[0]


def test_exact_odd_rows(odd_docs, no_docs):
    got = rows_of(exact_dedup.exact_groups(odd_docs))
    assert len(got) == odd_docs.count()
    two = [r for r in got if r[0] == 2]
    assert [r[3] for r in two] == [False, True] and all(r[1] == 2 and r[2] == 3 for r in two)
    empty = [r for r in got if r[4] == hashlib.sha256(b"").hexdigest()]
    assert [(r[0], r[1], r[2], r[3]) for r in empty] == [(3, 4, 3, False), (4, 4, 3, True), (None, 4, 3, False)]
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 4
    assert kept.filter("`__row` = 1").count() == 1  # a column of the input, untouched
    assert exact_dedup.exact_groups(no_docs).collect() == [] and exact_dedup.drop_copies(no_docs).collect() == []


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "fingerprint", lambda data: len(data) % 2)
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA"), (4, "abc")], "doc_id bigint, text string")
    assert [r[:4] for r in rows_of(exact_dedup.exact_groups(df))] == [
        (1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True)]


def substring_brute(rows):
    far = math.inf
    first = {}
    for k, t in rows:
        w = words(t)
        for i in range(len(w) - 49):
            x = tuple(w[i:i + 50])
            first[x] = min(first.get(x, far), far if k is None else k)
    out = []
    for k, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i:i + 50])] < (far if k is None else k):
                gone[i:i + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def test_covers_reach_every_offset():
    for period, cover in substring_dedup.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_substrings_match_brute_force(spark, crowded):
    rng = random.Random(9)
    rows = crowded + [(9000, crowded[0][1]), (None, crowded[5][1])]
    passage = " ".join(str(rng.randrange(9)) for _ in range(49 + 8))
    rows += [(9100 + i, " ".join([*["a"] * rng.randrange(70), passage[i:], *["b"] * 10])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(substring_dedup.substring_digest(df)) == substring_brute(rows)


def test_substring_query_and_odd_rows(spark, odd_docs, no_docs):
    for docs in (read(spark, SF_SMALL, "documents"), odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert rows_of(substring_dedup.substring_digest(docs)) == substring_brute(rows)
    assert substring_dedup.substring_digest(no_docs).collect() == []


def test_kept_text_is_returned(spark):
    one = " ".join(f"a{i}" for i in range(60))
    df = spark.createDataFrame([(1, one), (2, "start " + one + " end")], "doc_id bigint, text string")
    got = {r.doc_id: bytes(r.kept) for r in substring_dedup.substring_report(df, keep_text=True).collect()}
    assert got == {1: one.encode(), 2: b"start end"}


def test_hashes_of_words_and_windows():
    a, b = b"one two  three\tfour", b"\nthree four"
    sa, ea, ha = word_hashes(a)
    sb, eb, hb = word_hashes(b)
    assert [a[i:j] for i, j in zip(sa, ea)] == a.split() and [b[i:j] for i, j in zip(sb, eb)] == b.split()
    assert ha[2:].tolist() == hb.tolist()
    assert window_hashes(ha, 2)[2] == window_hashes(hb, 2)[0]


def vector_brute(rows, threshold=0.9):
    u, n = Union(), Counter()
    good = {}
    for i, (_, x) in enumerate(rows):
        if x is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x):
            a = np.array(x, np.float64)
            good[i] = a / np.abs(a).max()
    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]):
                a, b = good[i], good[j]
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    u.join(i, j)
                    n[i] += 1
                    n[j] += 1
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[u.find(i)] = min(least.get(u.find(i), k), k)
    return sorted(((k, n[i], least.get(u.find(i)), k == least.get(u.find(i))) for i, (k, _) in enumerate(rows)),
                  key=lambda r: tuple((x is None, x) for x in r))


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 60)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(size=16) * (0.1 + 0.4 * (i % 5) / 4)).tolist()) for i in range(300)]
    rows += [(1000 + i, base[0].tolist()) for i in range(50)] + [(2000, (base[0] * 1e-200).tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [None] * 16),
             (3005, [float("inf")] + [0.0] * 15), (3006, [1.0, 2.0]), (3007, [1.0, 2.0]), (None, base[1].tolist()),
             (None, None), (3006, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = vector_brute(rows)
    want = [(k, n, k if c is None else c, True if k is None and c is None else kept) for k, n, c, kept in want]
    assert rows_of(embed_dedup.near_vectors(df)) == want
    assert embed_dedup.near_vectors(df.limit(0)).collect() == []


def test_quantised_bounds_hold():
    rng = np.random.default_rng(4)
    x, y = embed_dedup.unit(rng.normal(size=(200, 64))), embed_dedup.unit(rng.normal(size=(200, 64)))
    qx, sx, nx, ex = embed_dedup.quantised(x)
    qy, sy, ny, ey = embed_dedup.quantised(y)
    near = (qx.astype(float) @ qy.T.astype(float)) * sx[:, None] * sy
    bound = nx[:, None] * ey + ex[:, None] * (ny + ey)
    assert (np.abs(x @ y.T - near) <= bound + 1e-12).all() and bound.max() < 0.05
