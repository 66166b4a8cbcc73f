"""Byte-level BPE, conversation repair and vector codes."""

import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from logloom.llm import byte_bpe, turn_repair, vector_codes
from logloom.llm.common import read
from tests.conftest import SF_SMALL
from tests.llm.conftest import rows_of

# --- byte-level BPE ------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    with open(byte_bpe.default_ranks(), "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    pattern = public_tokenizers.PATTERN
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    newer = byte_bpe.newer_characters(pattern)
    cut, encoder = byte_bpe.Cutter(pattern, newer), byte_bpe.Encoder(ranks)
    return (lambda t: b"".join(map(encoder.__getitem__, cut(t)))), (lambda t: own.encode_ordinary(t)), byte_bpe.Decoder(ranks), newer


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_equals_the_library_on_random_texts(bpe):
    mine, library, decode, newer = bpe
    rng = random.Random(5)
    pool = ([chr(c) for c in range(1, 0x300)] + [" "] * 300 + list(newer[::40]) + list("　東京😀é١５  \x1c\x85")
            + list("abcde'strevmdl") * 20)
    for _ in range(2000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        assert mine(t) == packed(library(t)), t
        assert decode(mine(t)) == t.encode()


def test_bpe_equals_the_library_on_very_long_matches(bpe):
    mine, library, _, _ = bpe
    rng = random.Random(6)
    for t in ("a" * 5000, "ab" * 20_000, " " * 30_000 + "x", "".join(rng.choice("abcdef") for _ in range(100_000)),
              "\n\n  \n" * 1000, "東京" * 20_000):
        assert mine(t) == packed(library(t))


def test_bpe_characters_that_only_newer_tables_know(bpe):
    mine, library, _, newer = bpe
    for c in itertools.chain(newer[:50], newer[-50:]):
        for t in (f"a{c}b", f"1{c}", f" !{c}?", c * 3):
            assert mine(t) == packed(library(t)), hex(ord(c))


def test_merges_go_by_least_rank_then_leftmost():
    """Against a plain search for the least pair, with vocabularies in which a
    merge can make a pair of lesser rank, and with ranks far apart."""
    rng = random.Random(7)
    for _ in range(300):
        tokens = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(rng.randint(1, 40))}
        ranks = dict(zip([*(bytes([b]) for b in range(256)), *tokens], [*range(256), *rng.sample(range(256, 70_000), len(tokens))]))
        encoder = byte_bpe.Encoder(ranks)
        for _ in range(10):
            data = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40))).encode()
            parts = [data[k:k + 1] for k in range(len(data))]
            while True:
                found = min(((ranks[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks), default=None)
                if found is None:
                    break
                parts[found[1]:found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
            assert encoder.merged(data) == [ranks[x] for x in parts]
            assert encoder.queue.pop() == (-1, -1) and not any(encoder.queue.words)


def test_rank_queue_gives_least_rank_then_leftmost():
    rng, queue, waiting = random.Random(7), byte_bpe.RankQueue(70_000), []
    for _ in range(5000):
        if waiting and rng.random() < 0.45:
            waiting.sort()
            assert queue.pop() == waiting.pop(0)
        else:
            waiting.append((rng.choice((0, 255, 256, 65_535, 65_536, rng.randrange(70_000))), rng.randrange(10**6)))
            queue.push(*waiting[-1])
    assert [queue.pop() for _ in waiting] == sorted(waiting) and queue.pop() == (-1, -1)


def check_bpe(docs, bpe):
    _, library, _, _ = bpe
    want = []
    for r in docs.collect():
        ids = packed(library(r.text or ""))
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert rows_of(byte_bpe.bpe_report(docs)) == sorted(want, key=lambda r: tuple((x is None, x) for x in r))


def test_bpe_on_given_odd_and_empty_documents(spark, odd_docs, no_docs, bpe, monkeypatch):
    check_bpe(read(spark, SF_SMALL, "documents"), bpe)
    check_bpe(odd_docs, bpe)
    assert byte_bpe.bpe_report(no_docs).collect() == []
    monkeypatch.setattr(byte_bpe, "MOST_LENGTH", 2)
    small = byte_bpe.Encoder({bytes([b]): b for b in range(256)}, most=3)
    assert [small[x] for x in "abcdea"] == [packed([ord(x)]) for x in "abcdea"] and len(small) <= 3 and len(small.older) <= 3


# --- conversation repair ---------------------------------------------------------

NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def plain_repair(rows):
    """The figures of one conversation's repair by a plain recursion over rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = {0: (0, "", ())}

    def put(ways, q, way):
        if q not in ways or way[:2] < ways[q][:2]:
            ways[q] = way

    def with_inserts(ways):
        for _ in range(3):
            more = dict(ways)
            for q, (c, a, lines) in ways.items():
                for role in ("user", "assistant"):
                    if (role[0], q) in NEXT:
                        put(more, NEXT[role[0], q], (c + 2, a + "I", (*lines, (role, ""))))
            ways = more
        return ways

    for (_, role, text), fault in zip(rows, faults):
        ways = {}
        for q, (c, a, lines) in with_inserts(best).items():
            put(ways, q, (c + 3, a + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if (role[:1], q) in NEXT:
                put(ways, NEXT[role[:1], q], (c + extra, a + "K", (*lines, (role, text))))
            for new in ("user", "assistant"):
                if (new[0], q) in NEXT:
                    put(ways, NEXT[new[0], q], (c + 2 + extra, a + "R", (*lines, (new, text))))
        best = ways
    cost, audit, lines = min((w for q, w in with_inserts(best).items() if q in (0, 3)), key=lambda w: w[:2])
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def plain_damage(rows):
    for conv, turn, role, text in rows:
        k = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if k == 2 else text
        yield from [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)


def plain_report(rows, damage=True):
    groups = {r[0]: [] for r in rows}
    for r in plain_damage(rows) if damage else rows:
        groups[r[0]].append(r[1:])
    return {conv: plain_repair(group) for conv, group in groups.items()}


def of_letters(letters):
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "d": "user"}
    return [(k, names[c.lower()], "" if c == "d" else f"{k}" if c.isupper() else f"{k}.") for k, c in enumerate(letters)]


def test_search_equals_plain_recursion_whole_and_in_parts():
    rng = random.Random(3)
    strings = ["".join(s) for k in range(4) for s in itertools.product("suaxUAd", repeat=k)]
    strings += ["".join(rng.choice("suaxSUAXdua") for _ in range(rng.randint(4, 14))) for _ in range(1500)]
    for s in strings:
        want = plain_repair(of_letters(s))[5:7]
        assert turn_repair.search(s, 0, turn_repair._FINAL) == want, s
        cut = sorted(rng.randint(0, len(s)) for _ in range(2))
        parts = []
        for part in (s[cut[1]:], s[cut[0]:cut[1]], s[:cut[0]]):
            found = [turn_repair.search(part, p, (q,)) or (-1, "") for p in range(4) for q in range(4)]
            parts.append(([c for c, _ in found], [a for _, a in found]))
        assert "".join(turn_repair.joined(parts)) == want[1], (s, cut)


TURNS = "conv_id bigint, turn bigint, role string, text string"


def reported(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def odd_turns():
    rng = random.Random(9)
    texts = ["", " \t\n", None, "Well.", "well", "Why? ", "So!\r\n", "東京。", "a.\x85", "x" * 50_000 + "."]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(6), 2**62, -2**62]),
             rng.choice([None, "", "user", "assistant", "system", "tool", "unknown", "User"]), rng.choice(texts)) for _ in range(400)]
    return rows + rows[:60] + [(77, 1, "user", "Same.")] * 500


def test_repair_on_odd_and_empty_rows(spark):
    rows = odd_turns()
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", pos string, seg int")
    assert reported(turn_repair.damage_report(turns)) == plain_report(rows)
    assert turn_repair.damage_report(turns.limit(0)).collect() == []
    gone = [k for k in range(3000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    lone = spark.createDataFrame([(k, 0, "user", "Yes.") for k in gone], TURNS)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert set(reported(turn_repair.damage_report(lone)).values()) == {nothing} and gone


def test_repair_of_conversations_longer_than_a_segment(spark, monkeypatch):
    """Segments of 4 rows and several partitions: most conversations span some."""
    monkeypatch.setattr(turn_repair, "SEGMENT", 4)
    rng = random.Random(12)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), k, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]),
             rng.choice(["", "Yes.", f"{k}.", f"{k}.", f"{k}"])) for k in range(600)]
    turns = spark.createDataFrame(rows, TURNS).repartition(5)
    assert reported(turn_repair.repair_report(turns, turns)) == plain_report(rows, damage=False)


def test_repaired_rows_are_what_the_digest_says(spark):
    turns = read(spark, SF_SMALL, "conversations")
    hurt = turn_repair.damaged(turns)
    want = {k: v[-1] for k, v in reported(turn_repair.repair_report(hurt, turns)).items()}
    lines = {k: [] for k in want}
    for r in sorted(turn_repair.repaired(hurt).collect(), key=lambda r: (r.conv_id, r.place)):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert {k: hashlib.sha256("\n".join(x).encode()).hexdigest() for k, x in lines.items()} == want
    for x in lines.values():
        roles = "".join(y[0] for y in x)
        assert roles.removeprefix("s").replace("ua", "") == "" and (roles != "s")


# --- vector codes --------------------------------------------------------------

def plain_codes(rows):
    """(vec_id, label, x) to the report, by evaluating every entry."""
    rows = [(k, lab, x) for k, lab, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    if not rows:
        return []
    width = max(-(-max(len(x) for _, _, x in rows) // 16), 1) * 16
    most = np.floor(np.sqrt((1 << 62) / width) / 2)
    ints = [[int(np.floor(np.clip(float(c) * 256, -most, most))) for c in (*x, *[0.0] * (width - len(x)))] for _, _, x in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, list(rows[k][2])))
    step = width // 16
    part = lambda v, j: v[j * step:(j + 1) * step]
    books = [[part(ints[k], j) for k in order[:64]] for j in range(16)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, book: min((dist(v, e), k) for k, e in enumerate(book))
    for _ in range(2):
        for j, book in enumerate(books):
            mine = {}
            for v in ints:
                mine.setdefault(nearest(part(v, j), book)[1], []).append(part(v, j))
            books[j] = [[sum(c) // len(c) for c in zip(*mine[k])] if k in mine else e for k, e in enumerate(book)]
    found = [[nearest(part(v, j), books[j]) for j in range(16)] for v in ints]
    per = {}
    for (_, lab, _), f in zip(rows, found):
        per[lab] = per.get(lab, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(k, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), per[lab], digest) for (k, lab, _), f in zip(rows, found)]


VECTORS = "vec_id bigint, embedding array<float>, label int, row string, error double"


def check_codes(spark, rows):
    got = rows_of(vector_codes.code_report(spark.createDataFrame([(k, x, lab, "r", 0.5) for k, lab, x in rows], VECTORS)))
    floats = [(k, lab, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for k, lab, x in rows]
    assert got == sorted(plain_codes(floats), key=lambda r: tuple((x is None, x) for x in r))


def test_codes_on_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(k) % 5 if k % 7 else None, rng.normal(size=32).round(2).tolist()) for k in rng.permutation(150)]
    rows += rows[:30] + [(3, 1, [0.5] * 32)] * 90  # repeated rows and ids, a hot vector
    rows += [(900, 1, None), (901, None, [1.0, None] * 16), (902, 2, [float("nan")] * 32), (903, 2, [float("inf")] + [0.0] * 31),
             (None, None, [0.25] * 32), (904, 2, []), (905, 3, [1.0] * 20), (906, 3, [3e38, -3e38] * 16), (-5, 3, [-0.001] * 32)]
    check_codes(spark, rows)
    check_codes(spark, rows[:9])  # fewer vectors than entries
    check_codes(spark, [(1, 1, []), (2, None, [])])
    check_codes(spark, [(1, 1, None)])
    assert vector_codes.code_report(spark.createDataFrame([], VECTORS)).collect() == []


def test_pivots_prune_and_ties_go_to_the_lower_index():
    rng = np.random.default_rng(5)
    centers = rng.integers(-5000, 5000, (64, 4))
    parts = centers[rng.integers(0, 64, 5000)] + rng.integers(-30, 30, (5000, 4))
    pivots = vector_codes.pick_pivots(centers)
    assert len(pivots) == vector_codes.PIVOTS and len(np.unique(pivots, axis=0)) == len(pivots)
    near = np.sqrt(vector_codes._squares(parts, pivots).astype(float))
    index, best, evaluated = vector_codes.nearest(parts, near, centers, pivots)
    every = vector_codes._squares(parts, centers)
    assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert evaluated < 3 * len(parts)  # of 64 a part
    book = np.repeat(rng.integers(-3, 3, (32, 4)), 2, axis=0)  # every entry twice, many ties besides
    parts = rng.integers(-4, 4, (3000, 4))
    pivots = vector_codes.pick_pivots(book)
    near = np.sqrt(vector_codes._squares(parts, pivots).astype(float))
    index, best, _ = vector_codes.nearest(parts, near, book, pivots)
    every = vector_codes._squares(parts, book)
    assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    same = np.zeros((5, 4), np.int64)
    assert len(vector_codes.pick_pivots(same)) == 1
