"""Repair of conversation structure by cheapest edits.

Conversations are rows (conv_id, turn, role, text), taken by turn (nulls
first; rows of one turn by role and text).  A row's first fault counts: blank
(no character but white space), duplicate (role and text seen earlier in the
conversation), truncated (the last character but white space is not ``.!?``).
Edits: K keeps a row (0), R gives it the role user or assistant (2), D deletes
it (3, and the only edit of blank and duplicate rows), I inserts a user or
assistant row without text anywhere (2); a truncated row that stays adds 1.
The roles' initials that are left must read ``(s?(ua)+)?``.  Of all cheapest
edits the audit, the edits' letters in order, is the least in ASCII.

**Search.**  Edits are paths in a lattice: rows consumed times four states of
the grammar.  :func:`search` runs Dijkstra from both ends, one heap each.  When
the two least costs reach the best crossing, both go on until every crossing
of that cost is known; the least concatenated audit wins.  Parts compose: of
two audits of equal cost between the same two lattice points none is a prefix
of the other (it would lack an insertion that costs), so the least whole is
made of least parts.

**At scale.**  The cheapest edits depend only on each row's initial and fault,
one letter a row, and not on its text.  Rows are range-partitioned by
conversation, turn, role and text, so that a conversation that holds a third
of all rows is spread too, and numbered in that order.  A conversation's
letters are gathered by segments of ``SEGMENT`` numbers: one or two segments
for most, many for a hot one.  Every distinct string of letters is searched
once, between all states at its ends if the conversation has more segments;
those are then joined back to front, one small row a segment.  At the end each
conversation's rows stream past its audit in order; a task holds one Arrow
batch and the audit.  (SHA-256 reads a conversation's repaired text from the
start, so that last step takes one task a conversation.)  Equal rows are one
row with a count, so any number of them is one row as well.

Defined cases: a null role or text counts as one space, a null conv_id is a
conversation of its own; rows that repeat wholly are duplicates of each other;
a conversation of which nothing is left has zeros, an empty audit and the hash
of the empty string; an empty table gives an empty result; extra columns do
not matter; a gap beyond 64 bits wraps.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batch_of, batches, schema_of, written

#: row numbers of one segment
SEGMENT = 4096
#: parts that the damage of :func:`damaged` deals rows to
FOLDS = 20

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: grammar states: nothing yet, after s, after u, after a
STATES = 4
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_FINAL = (0, 3)
_LEGAL = ("su", "ua", "au")


# --- the search ---------------------------------------------------------------

def _row_edits(letter: str, q: int) -> Iterator[tuple[int, str, int]]:
    """(cost, edit, next state) of the edits that consume a row in state ``q``.

    Letters: the initial s, u, a, or x for any other; upper case if truncated;
    d if the row must be deleted."""
    yield DELETE, "D", q
    if letter != "d":
        extra = TRUNCATED if letter.isupper() else 0
        to = _NEXT.get(letter.lower(), {}).get(q)
        if to is not None:
            yield extra, "K", to
        for role in "ua":
            if q in _NEXT[role]:
                yield REROLE + extra, "R", _NEXT[role][q]


_INSERTS = [[_NEXT[role][q] for role in "ua" if q in _NEXT[role]] for q in range(STATES)]


def search(letters: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits that lead over ``letters``
    from state ``start`` to one of ``ends``; None if there are none."""
    n = len(letters)
    # a side's entries: best (cost, audit) known of a point, points done, heap of (cost, order, point)
    fore, back = {(0, start): (0, "")}, {(n, q): (0, "") for q in ends}
    fore_done, back_done = set(), set()
    fore_heap, back_heap = [(0, 0, start)], [(0, 0, q) for q in ends]
    into: dict[str, list] = {}

    def arrivals(letter: str) -> list:
        """Edits over ``letter`` by the state they lead to."""
        if letter not in into:
            into[letter] = [[] for _ in range(STATES)]
            for q in range(STATES):
                for cost, edit, to in _row_edits(letter, q):
                    into[letter][to].append((cost, edit, q))
        return into[letter]

    def offer(known, heap, done, point, cost, audit, order):
        old = known.get(point)
        if point not in done and (old is None or (cost, audit) < old):
            known[point] = cost, audit
            if old is None or cost < old[0]:
                heapq.heappush(heap, (cost, order, point[1]))

    best = None

    def crossing(cost, prefix, suffix):
        nonlocal best
        best = (cost, prefix + suffix) if best is None else min(best, (cost, prefix + suffix))

    while fore_heap and back_heap:
        # a crossing found later costs at least what both heaps begin with
        if best is not None and fore_heap[0][0] + back_heap[0][0] > best[0]:
            break
        ahead = fore_heap[0][0] <= back_heap[0][0]
        heap, known, done, other, other_done = ((fore_heap, fore, fore_done, back, back_done) if ahead
                                                else (back_heap, back, back_done, fore, fore_done))
        cost, order, q = heapq.heappop(heap)
        i = order if ahead else n - order
        if (i, q) in done or known[i, q][0] != cost:
            continue
        done.add((i, q))
        audit = known[i, q][1]
        if (i, q) in other_done:
            rest, tail = other[i, q]
            crossing(cost + rest, *((audit, tail) if ahead else (tail, audit)))
        # rows cost nothing at the least, insertions cost: points of one cost
        # are done in the order of rows, so all their equals are known by then
        if ahead:
            steps = [(INSERT, "I", i, to) for to in _INSERTS[q]]
            if i < n:
                steps += [(c, edit, i + 1, to) for c, edit, to in _row_edits(letters[i], q)]
        else:
            steps = [(INSERT, "I", i, p) for p in range(STATES) if q in _INSERTS[p]]
            if i:
                steps += [(c, edit, i - 1, p) for c, edit, p in arrivals(letters[i - 1])[q]]
        for c, edit, k, to in steps:
            longer = audit + edit if ahead else edit + audit
            if (k, to) in other_done:  # the edge joins what both sides have done
                rest, tail = other[k, to]
                crossing(cost + c + rest, *((longer, tail) if ahead else (tail, longer)))
            offer(known, heap, done, (k, to), cost + c, longer, k if ahead else n - k)
    return best


# --- rows, letters and segments -------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the id and turn of a row
    decide: one part of FOLDS each is dropped, emptied, robbed of its ``.!?``,
    repeated, or given the role user."""
    key = F.concat_ws(":", *[_plain(F.col(c)) for c in ("conv_id", "turn")])
    fold = F.crc32(key.cast("binary")) % FOLDS
    role, text = _plain(F.col("role")), _plain(F.col("text"))
    return (conversations.withColumn("__fold", fold).filter("__fold <> 0").select(
        "conv_id", "turn", F.when(F.col("__fold") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("__fold") == 1, "").when(F.col("__fold") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("__fold") == 3, 2).otherwise(1))).alias("copy")).drop("copy"))


def _plain(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(" "))


def ordered_rows(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n (equal rows), fault, marks, pos, seg: rows
    numbered by conversation, turn, role and text, written out.

    ``marks`` are the row's letters for the search: its own, and a d for any
    number of copies."""
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), _plain(F.col("role")).alias("role"),
                        _plain(F.col("text")).alias("text"))
    rows = written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")), "turns")
    trimmed = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumn("end", F.right(trimmed, F.lit(1))).withColumn("place", F.struct(F.col("turn").isNotNull().alias("some"), "turn"))
    rows = rows.withColumn("said", F.sha2("text", 256))
    # the first place of what a conversation says more than once
    again = (rows.filter("end <> ''").groupBy("conv_id", "role", "said").agg(F.count(F.lit(1)).alias("times"), F.min("place").alias("first"))
             .filter("times > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("said").alias("s"), "first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s"))
    rows = rows.join(again, same, "left").withColumn(
        "fault", F.when(F.col("end") == "", "blank").when(F.coalesce(F.col("place") > F.col("first"), F.lit(False)), "duplicate")
        .when(~F.col("end").isin(".", "!", "?"), "truncated").otherwise(""))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    letter = F.when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    marks = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("n") > 1, F.concat(letter, F.lit("d"))).otherwise(letter)
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.select(*order, "n", "fault", marks.alias("marks")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    return written(rows.withColumn("seg", F.floor(F.col("pos") / SEGMENT)), "ordered-turns")


_WHOLE = "letters string, audit string"
_ENDS = "letters string, costs array<bigint>, audits array<string>"


def _searched(letters: DataFrame, whole: bool) -> DataFrame:
    """Every distinct string of letters with its least audit, or with the cost
    (-1 if there is no way) and audit between all states at its ends."""
    ddl = _WHOLE if whole else _ENDS

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(ddl)

        def rows():
            for x in itertools.chain.from_iterable(b.column(0).to_pylist() for b in it):
                if whole:
                    yield x, search(x, 0, _FINAL)[1]
                else:
                    found = [search(x, p, (q,)) or (-1, "") for p in range(STATES) for q in range(STATES)]
                    yield x, [c for c, _ in found], [a for _, a in found]

        yield batch_of([], schema)
        yield from batches(rows(), schema, 500)

    return letters.select("letters").distinct().mapInArrow(run, ddl)


class _Chain:
    """An audit as a chain of segments' audits, compared without joining them."""

    def __init__(self, audit: str, state: int, rest: _Chain | None) -> None:
        self.audit, self.state, self.rest = audit, state, rest

    def chars(self) -> Iterator[str]:
        at: _Chain | None = self
        while at is not None:
            yield from at.audit
            at = at.rest

    def before(self, other: _Chain) -> bool:
        for a, b in zip(self.chars(), other.chars()):
            if a != b:
                return a < b
        return False


def joined(parts: list[tuple[list[int], list[str]]]) -> list[str]:
    """Audits of a conversation's segments, given all their costs and audits
    between states, last segment first."""
    # the best way from a state before the segments seen so far to the end
    ways: dict[int, tuple[int, _Chain | None]] = {q: (0, None) for q in _FINAL}
    for costs, audits in parts:
        longer = {}
        for p in range(STATES):
            for q, (cost, chain) in ways.items():
                step = costs[p * STATES + q]
                if step < 0:
                    continue
                found = step + cost, _Chain(audits[p * STATES + q], q, chain)
                old = longer.get(p)
                if old is None or found[0] < old[0] or (found[0] == old[0] and found[1].before(old[1])):
                    longer[p] = found
        ways = longer
    out, chain = [], ways[0][1]
    while chain is not None:
        out.append(chain.audit)
        chain = chain.rest
    return out


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, seg, audit: every segment's part of its conversation's audit
    (one D stands for a run of rows that must go)."""
    parts = written(rows.groupBy("conv_id", "seg").agg(F.regexp_replace(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("pos", "marks"))), lambda x: x["marks"]), ""), "d+", "d").alias("letters")), "letters")
    per = written(parts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"), F.min("seg").alias("seg"),
                                               F.first("letters").alias("letters")), "letters-whole")
    single = per.filter("k = 1").drop("k")
    single = single.join(_searched(single, True), "letters").select("conv_id", "seg", "audit")
    many = per.filter("k > 1").select(F.col("conv_id").alias("c"))
    many = written(parts.join(many, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"), "letters-parts")
    solved = many.join(_searched(many, False), "letters").select("conv_id", "seg", "costs", "audits")
    ddl = f"conv_id {dict(rows.dtypes)['conv_id']}, seg bigint, audit string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(ddl)
        stream = itertools.chain.from_iterable(zip(*[c.to_pylist() for c in b.columns]) for b in it)

        def out():
            for conv, group in itertools.groupby(stream, key=lambda r: r[0]):
                segs, found = [], []
                for _, seg, costs, audit in group:
                    segs.append(seg)
                    found.append((costs, audit))
                yield from zip(itertools.repeat(conv), reversed(segs), joined(found))

        yield batch_of([], schema)
        yield from batches(out(), schema, 500)

    folded = solved.repartition("conv_id").sortWithinPartitions("conv_id", F.col("seg").desc()).mapInArrow(run, ddl)
    return single.unionByName(folded)


# --- applying the audits ----------------------------------------------------------

_STATS = ("gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")
_LEFT = "place bigint, edit string, turn bigint, role string, text string"


class _Conversation:
    """Applies one conversation's audit to its rows as they pass by."""

    def __init__(self) -> None:
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.turns = self.place = 0
        self.low = self.high = self.last = None
        self.initial: str | None = None
        self.state, self.edits, self.in_run = 0, iter(""), False
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def left(self, edit: str, turn: int | None, role: str, text: str) -> tuple:
        line = f"{role}:{text}".encode()
        self.digest.update(b"\n" + line if self.place else line)
        self.place += 1
        return self.place - 1, edit, turn, role, text

    def next_role(self) -> str:
        return "assistant" if self.state == 2 else "user"

    def until_edit(self) -> Iterator[tuple]:
        """Rows inserted here; the edit that follows is left in ``self.edit``."""
        self.edit = None
        for e in self.edits:
            if e != "I":
                self.edit = e
                return
            role = self.next_role()
            self.audit.append("I")
            self.cost += INSERT
            self.state = _NEXT[role[0]][self.state]
            yield self.left("I", None, role, "")

    def segment(self, audit: str) -> Iterator[tuple]:
        yield from self.until_edit()  # what is inserted after the last segment's rows
        self.edits, self.in_run = iter(audit), False

    def row(self, turn: int | None, role: str, text: str, n: int, fault: str, marks: str) -> Iterator[tuple]:
        if turn is not None:
            if turn != self.last:
                self.turns += 1
            self.last = self.high = turn
            self.low = turn if self.low is None else self.low
        pair = (self.initial or "") + role[:1]
        self.illegal += (self.initial is not None and pair not in _LEGAL) + n - 1
        self.initial = role[:1]
        if fault:
            self.faults[fault] += n if fault == "blank" or fault == "duplicate" else 1
        if n > 1 and marks != "d":
            self.faults["duplicate"] += n - 1
        for mark in marks:
            gone = n if marks == "d" else n - 1
            if mark == "d":
                if not self.in_run:
                    yield from self.until_edit()
                    self.in_run = True
                self.audit.append("D" * gone)
                self.cost += DELETE * gone
                continue
            self.in_run = False
            yield from self.until_edit()
            self.audit.append(self.edit)
            if self.edit == "D":
                self.cost += DELETE
                continue
            self.cost += (REROLE if self.edit == "R" else 0) + (TRUNCATED if fault == "truncated" else 0)
            if self.edit == "R":
                role = self.next_role()
            self.state = _NEXT[role[0]][self.state]
            yield self.left(self.edit, turn, role, text)

    def stats(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        gaps = (gaps + (1 << 63)) % (1 << 64) - (1 << 63)
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def _applied(turns: DataFrame, conversations: DataFrame, stats: bool) -> DataFrame:
    """One row of figures a conversation, or the rows that are left."""
    rows = ordered_rows(turns)
    plans = audits(rows)
    none = {"turn": "bigint", "role": "string", "text": "string", "n": "bigint", "fault": "string", "marks": "string"}
    blanks = [F.lit(None).cast(t).alias(c) for c, t in none.items()]
    ids = conversations.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("bigint").alias("seg"), F.lit(-1).cast("bigint").alias("pos"), *blanks,
        F.lit(None).cast("string").alias("audit"))
    plans = plans.select("conv_id", "seg", F.lit(-1).cast("bigint").alias("pos"), *blanks, "audit")
    rows = rows.select("conv_id", "seg", "pos", *none, F.lit(None).cast("string").alias("audit"))
    stream = (ids.unionByName(plans).unionByName(rows).repartition("conv_id")
              .sortWithinPartitions("conv_id", "seg", "pos"))
    ddl = f"conv_id {dict(rows.dtypes)['conv_id']}, " + (_STATS if stats else _LEFT)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = schema_of(ddl)
        lines = itertools.chain.from_iterable(zip(*[c.to_pylist() for c in b.columns]) for b in it)

        def out():
            for conv, group in itertools.groupby(lines, key=lambda r: r[0]):
                c = _Conversation()
                steps = (c.segment(r[9]) if r[9] is not None else c.row(*r[3:9]) for r in group if r[1] >= 0)
                for left in itertools.chain(itertools.chain.from_iterable(steps), c.segment("")):
                    if not stats:
                        yield conv, *left
                if stats:
                    yield conv, *c.stats()

        yield batch_of([], schema)
        yield from batches(out(), schema, 500)

    return stream.mapInArrow(run, ddl)


def repaired(conversations: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R or I), turn, role, text: the repaired rows."""
    return _applied(conversations, conversations, False)


def repair_report(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The figures, audit and digest of the repair of ``turns``, one row for
    every conv_id of ``conversations``."""
    return _applied(turns, conversations, True)


def damage_report(conversations: DataFrame) -> DataFrame:
    """:func:`repair_report` of the rows that :func:`damaged` leaves."""
    return repair_report(damaged(conversations), conversations)


# SQL: CRC-32 of an ASCII text, bit by bit; the lattice as a recursion over
# rows that keeps the least (cost, audit, text) of every state
SQL = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
        lambda ch: ascii(ch)::BIGINT),
      lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295) % 20 AS k
  FROM conversations),
dam AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
  CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE k <> 0),
pos AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said,
  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS y, lag(role) OVER w AS prior
  FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, CASE WHEN y = '' THEN 'blank' WHEN said > 1 THEN 'duplicate' WHEN right(y, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  left(role, 1) AS ini FROM pos),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (i > 1 AND left(prior, 1) || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
nxt(ini, q, p) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
ins AS (SELECT q, q AS p, 0 AS cost, '' AS audit, []::VARCHAR[] AS said FROM range(4) t(q)
  UNION ALL SELECT q, p, 2, 'I', [CASE ini WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM nxt WHERE ini <> 's'
  UNION ALL SELECT a.q, b.p, 4, 'II', [CASE a.ini WHEN 'u' THEN 'user:' ELSE 'assistant:' END, CASE b.ini WHEN 'u' THEN 'user:' ELSE 'assistant:' END]
  FROM nxt a JOIN nxt b ON a.p = b.q WHERE a.ini <> 's' AND b.ini <> 's'),
way(conv_id, i, q, cost, audit, said) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM stat
  UNION ALL
  SELECT conv_id, i, q, cost, audit, said FROM (
    SELECT w.conv_id, w.i + 1 AS i, e.p AS q, w.cost + s.cost + e.cost AS cost, w.audit || s.audit || e.edit AS audit,
           list_concat(w.said, s.said, e.line) AS said
    FROM way w JOIN ins s ON s.q = w.q, LATERAL (
      SELECT 3 AS cost, 'D' AS edit, s.p AS p, []::VARCHAR[] AS line FROM f WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
      UNION ALL SELECT (fault = 'truncated')::INT, 'K', t.p, [role || ':' || text] FROM f JOIN nxt t ON t.ini = f.ini
        WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 AND fault NOT IN ('blank', 'duplicate') AND t.q = s.p
      UNION ALL SELECT 2 + (fault = 'truncated')::INT, 'R', t.p, [CASE t.ini WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM f JOIN nxt t ON t.ini <> 's'
        WHERE f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 AND fault NOT IN ('blank', 'duplicate') AND t.q = s.p) e)
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY cost, audit) = 1),
won AS (SELECT w.conv_id, w.cost + s.cost AS cost, w.audit || s.audit AS audit, list_concat(w.said, s.said) AS said
  FROM way w JOIN stat t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i JOIN ins s ON s.q = w.q WHERE s.p IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + s.cost, w.audit || s.audit) = 1)
SELECT c.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate,
  coalesce(t.truncated, 0) AS truncated, coalesce(t.illegal, 0) AS illegal, coalesce(w.cost, 0)::BIGINT AS cost,
  coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stat t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
"""
