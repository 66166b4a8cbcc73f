"""Secret scans with a trigram inverted index (native DataFrame functions only).

From each rule's regular expression a Boolean trigram query is derived: an OR
over the strings it can be unrolled to (branches, optional parts, small
classes) of the AND of the trigrams that such a match must hold
(:func:`trigram_query`).
The index has a posting for every (trigram of some query, document) that
occurs; queries are answered by intersecting postings, and only the candidates
are verified with the regular expression.  A rule without a mandatory trigram
(a run of hex digits) has no query and scans every text.

Postings of the query trigrams are held as bits of one number per document
(bit k: the document is in the posting list of trigram k), so intersecting is
``bitwise AND`` on the rows where they are and no text is shuffled;
:func:`posting_lists` gives the same index turned round, trigram -> documents.

Spans are half-open code-point ranges.  The text between matches comes from
``split``, so start and end are running sums of lengths.

Defined cases: a null or empty text has no span; equal spans of two kinds are
both listed; repeated rows are scanned each for itself; an empty table gives
an empty result; extra columns do not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as parsed, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import UPPER, LOWER


@dataclass(frozen=True)
class Rule:
    """``pattern``: regular expression that Java and Python read alike.
    ``shortest``: code points that ``measure`` (the part that counts: all, or
    the assigned value) needs at least."""

    kind: str
    pattern: str
    measure: str
    shortest: int
    base: bool = False


#: fixed values: the three base rules, in this order.  Matches of ``AKIA[A-Z0-9]+``
#: and ``[0-9a-f]+`` end where their run of characters ends, so asking for the
#: shortest length in the pattern gives just the matches that are long enough,
#: without listing every "e" of a text; ``assign`` has to match first and be
#: measured then, since a short match may hide a later one.
BASE = (
    Rule("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
         r"value", 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", r"all", 18, True),
    Rule("hex", r"[0-9a-f]{16,}", r"all", 16, True),
)
#: further kinds, with the shapes their issuers document
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", "all", 27),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", "all", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", "all", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", "all", 39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}", "all", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", "all", 28),
)
RULES = BASE + MORE


def trigrams(literal: str) -> list[str]:
    return [literal[i:i + 3] for i in range(len(literal) - 2)]


#: what may stand here is left open
_OPEN = "\0"
#: most characters of a class, and most strings of a pattern, that are told apart
_CLASS, _STRINGS = 8, 1000


def _joined(left: list[str], right: list[str]) -> list[str]:
    """Every string of ``left`` before every one of ``right``; an open end where those are too many."""
    if len(left) * len(right) > _STRINGS:
        right = [_OPEN]
    return list(dict.fromkeys(re.sub(f"{_OPEN}+", _OPEN, x + y) for x in left for y in right))


def _unrolled(nodes) -> list[str]:
    """The strings that parsed nodes stand for, case aside, with ``_OPEN``
    where anything may follow; every match has the pieces of one of them."""
    out = [""]
    for kind, arg in nodes:
        if kind is parsed.LITERAL:
            each = [chr(arg).lower()]
        elif kind is parsed.IN:
            found = set()
            for what, x in arg:
                span = [x] if what is parsed.LITERAL else range(x[0], x[1] + 1) if what is parsed.RANGE else range(_CLASS + 1)
                found |= {chr(c).lower() for c in span} if len(span) <= _CLASS else {_OPEN}
            each = [_OPEN] if len(found) > _CLASS or _OPEN in found else sorted(found)
        elif kind is parsed.BRANCH:
            each = list(dict.fromkeys(x for branch in arg[1] for x in _unrolled(branch)))
        elif kind is parsed.SUBPATTERN:
            each = _unrolled(arg[-1])
        elif kind in (parsed.MAX_REPEAT, parsed.MIN_REPEAT, parsed.POSSESSIVE_REPEAT):
            least, most, inner = arg
            once, each = _unrolled(inner), [""]
            for _ in range(min(least, 3)):
                each = _joined(each, once)
            if least == 0 and most == 1:
                each = ["", *once]
            elif most > min(least, 3):
                each = _joined(each, [_OPEN])
        elif kind in (parsed.AT, parsed.ASSERT, parsed.ASSERT_NOT):
            each = [""]  # takes no characters
        else:
            each = [_OPEN]
        out = _joined(out, each)
    return out


def trigram_query(rule: Rule) -> list[list[str]]:
    """OR of ANDs of mandatory trigrams of the rule's pattern, without lists
    that a shorter one implies; no list at all if some string of the pattern
    has no trigram (then all texts are scanned)."""
    every = {frozenset(t for piece in x.split(_OPEN) for t in trigrams(piece)) for x in _unrolled(_parser.parse(rule.pattern))}
    if frozenset() in every:
        return []
    return sorted(sorted(x) for x in every if not any(y < x for y in every))


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    """The trigrams that the index has postings for; at most 63 to a mask, so
    the masks of a long rule set are several."""
    return sorted({t for r in rules for alt in trigram_query(r) for t in alt})


def posting_masks(lowered: Column, rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """For each 60 trigrams of the vocabulary the mask of those in the
    A-Z lower-cased text."""
    words = vocabulary(rules)
    masks = []
    for k in range(0, len(words), 60):
        bits = [F.when(F.contains(lowered, F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0).cast("bigint"))
                for i, t in enumerate(words[k:k + 60])]
        mask = bits[0]
        for b in bits[1:]:
            mask = mask.bitwiseOR(b)
        masks.append(mask)
    return masks


def in_query(masks: list[Column], rule: Rule, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether the postings of the rule's Boolean query intersect in this document."""
    words, query = vocabulary(rules), trigram_query(rule)
    if not query:
        return F.lit(True)
    out = F.lit(False)
    for alt in query:
        need = F.lit(True)
        for k, mask in enumerate(masks):
            want = sum(1 << (i - 60 * k) for i in map(words.index, alt) if 60 * k <= i < 60 * k + 60)
            if want:
                need = need & (mask.bitwiseAND(F.lit(want)) == want)
        out = out | need
    return out


def posting_lists(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, doc_id): the inverted index as a table."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    every = F.array(*[F.lit(t) for t in vocabulary(rules)])
    return docs.select("doc_id", F.explode(F.filter(every, lambda t: F.contains(low, t))).alias("trigram"))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end, kind) of the rule's leftmost non-overlapping
    matches that are long enough."""
    found = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    between = F.split(text, rule.pattern, -1)
    walk = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("gap")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint,kind:string,text:string>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).cast("bigint").alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["gap"])).cast("bigint").alias("start"),
                (acc["at"] + F.length(x["gap"]) + F.length(x["m"])).cast("bigint").alias("end"),
                F.lit(rule.kind).alias("kind"), x["m"].alias("text")))).alias("out")),
        lambda acc: acc["out"])
    return F.filter(walk, lambda s: F.length(counted(s["text"], rule)) >= rule.shortest)


def counted(match: Column, rule: Rule) -> Column:
    """The part of a match whose length counts: all of it, or the assigned value."""
    if rule.measure == "all":
        return match
    return F.regexp_extract(match, r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """Spans by start, then by the order of the rules."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"),
                                                  s["end"].alias("end"), s["kind"].alias("kind"), s["text"].alias("text")))
    return F.array_sort(keyed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and ``found``: its spans (start, rank, end, kind, text) in order."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.translate("text", UPPER, LOWER).alias("low"))
    masks = posting_masks(F.col("low"), rules)
    rows = rows.select("doc_id", "text", *[m.alias(f"mask{k}") for k, m in enumerate(masks)])
    look = [F.col(f"mask{k}") for k in range(len(masks))]
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,text:string>>")
    each = [F.when(in_query(look, r, rules) & F.col("text").rlike(r.pattern), spans_of(F.col("text"), r)).otherwise(none)
            for r in rules]
    return rows.select("doc_id", in_order(F.concat(*each), rules).alias("found"))


def secrets_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = [r.kind for r in rules if r.base]
    found = scan(docs, rules)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    of_base = F.filter("found", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in base],
                        F.sha2(joined(of_base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same result as DuckDB SQL."""
    value = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    esc = lambda p: p.replace("'", "''")
    lists = []
    for i, r in enumerate(rules):
        part = "s.txt" if r.measure == "all" else f"regexp_extract(s.txt, '{esc(value)}', 1)"
        lists.append(f"""list_filter(list_transform(range(1, len(f{i}) + 1), lambda i: {{
            'start': list_sum(list_transform(g{i}[1:i], lambda y: length(y)))::BIGINT
                     + coalesce(list_sum(list_transform(f{i}[1:i - 1], lambda y: length(y))), 0)::BIGINT,
            'rank': {i}, 'kind': '{r.kind}', 'txt': f{i}[i]}}), lambda s: length({part}) >= {r.shortest})""")
    found = ", ".join(f"regexp_extract_all(text, '{esc(r.pattern)}') AS f{i}, string_split_regex(text, '{esc(r.pattern)}') AS g{i}"
                      for i, r in enumerate(rules))
    every = lists[0]
    for x in lists[1:]:
        every = f"list_concat({every}, {x})"
    text = lambda xs: ("array_to_string(list_transform(" + xs + ", lambda s: s.kind || ':' || s.start || ':' "  # noqa: E731
                       "|| (s.start + length(s.txt))), ',')")
    base = ", ".join(f"'{r.kind}'" for r in rules if r.base)
    counts = ", ".join(f"len(list_filter(found, lambda s: s.kind = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in rules if r.base)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, {found} FROM t),
a AS (SELECT doc_id, list_sort({every}) AS found FROM m)
SELECT doc_id, {counts},
       sha256({text(f"list_filter(found, lambda s: s.kind IN ({base}))")}) AS base_sha256,
       {text("found")} AS spans
FROM a
"""
