"""Byte-level BPE encoding and decoding with a rank file.

A text is cut by the pattern; each match is encoded by itself.  A match that
is a token as a whole is that token; any other starts as single bytes and the
adjacent pair of least rank, the leftmost of equals, is merged until no pair
is a token.

Pairs wait in a rank queue (:class:`RankQueue`): one bucket per rank holds the
positions of pairs of that rank, and a bitmap over bitmaps of 256 buckets marks
those in use, so the least rank is found by one find-first-set a level.
Positions are places in a doubly linked list of the current tokens.  A merge
changes the rank of two neighbouring pairs, whose old entries stay in their
buckets and are skipped as stale when they come up.  A match of n bytes costs
n merges with a constant number of words touched each, and bucket order
besides, whatever its length.

Workers remember the ids of short matches, in a memory of bounded size.

Defined cases: null text counts as empty and has no ids; very long texts and
matches are encoded whole; repeated rows are encoded each for itself; an empty
table gives an empty result; extra columns do not matter.  Ids that are not in
the rank file fail when decoded.  Characters are letters and digits as the
tiktoken library's Unicode tables say, where those of ``regex`` are newer.
"""

from __future__ import annotations

import base64
import heapq
import struct
import unicodedata
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batch_of, batches, schema_of, worker_memory

#: matches in each half of a worker's memory, and the longest such match in characters (under 200 MB)
MOST_KNOWN = 400_000
MOST_LENGTH = 64

_ENCODED = "row bigint, n_tokens bigint, ids binary"


def default_ranks() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def newer_characters(pattern: str) -> str:
    """Characters that ``regex`` takes for letters or digits and the tiktoken
    library does not (its Unicode tables are older), found by asking it."""
    kinds = regex.compile(r"[\p{L}\p{N}]")
    unsure = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000)))
              if unicodedata.category(c) == "Cn" and kinds.match(c)]
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {("!" + c).encode(): 256 + k for k, c in enumerate(unsure)}
    asked = tiktoken.Encoding("asked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return "".join(c for c in unsure if len(asked.encode_ordinary("!" + c)) == 1)


class Cutter:
    """Cuts texts into the pattern's matches."""

    def __init__(self, pattern: str, newer: str) -> None:
        self.plain = regex.compile(pattern).findall
        points, spans = sorted(map(ord, newer)), []
        for p in points:
            if spans and spans[-1][1] == p - 1:
                spans[-1][1] = p
            else:
                spans.append([p, p])
        members = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans)
        self.rare = regex.compile(f"[{members}]").search if spans else None
        # letters and digits without the newer ones, inside and outside of sets
        old = {k: f"[\\p{{{k}}}--[{members}]]" for k in "LN"}
        inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s{old['L']}{old['N']}]") if spans else pattern
        parts = regex.split(r"(\[(?:[^\[\]]|(?R))*\])", inside)
        self.careful = regex.compile("".join(x if x.startswith("[") else x.replace(r"\p{L}", old["L"]).replace(r"\p{N}", old["N"])
                                             for x in parts) if spans else pattern, regex.V1).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.rare is None or not self.rare(text):
            return self.plain(text)
        return self.careful(text)


class RankQueue:
    """Positions by rank, least rank first and leftmost first within a rank.

    ``top`` marks the words in use, a word the buckets in use."""

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.words, self.top = [0] * ((ranks >> 8) + 1), 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket:
            heapq.heappush(bucket, position)
            return
        bucket.append(position)
        at = rank >> 8
        if not self.words[at]:
            self.top |= 1 << at
        self.words[at] |= 1 << (rank & 255)

    def pop(self) -> tuple[int, int]:
        """The least rank in use and its leftmost position; (-1, -1) if none is left."""
        top = self.top
        if not top:
            return -1, -1
        at = (top & -top).bit_length() - 1
        word = self.words[at]
        low = word & -word
        rank = at << 8 | low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        self.words[at] = word = word ^ low
        if not word:
            self.top = top & (top - 1)
        return rank, bucket.pop()


class Encoder(dict):
    """Packed ids (four bytes each, little-endian) of the pattern's matches;
    learns a match when it is first asked for.  When ``most`` are known they
    become the older half of the memory, from which those asked for come back."""

    def __init__(self, ranks: dict[bytes, int], most: int = MOST_KNOWN) -> None:
        super().__init__()
        self.ranks, self.most, self.older = ranks, most, {}
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)

    def __missing__(self, match: str) -> bytes:
        packed = self.older.get(match)
        if packed is None:
            data = match.encode()
            whole = self.ranks.get(data)
            ids = [whole] if whole is not None else self.merged(data)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(match) <= MOST_LENGTH:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[match] = packed
        return packed

    def merged(self, data: bytes) -> list[int]:
        """Ids of ``data`` by merging pairs in the order of the rank queue."""
        ranks, n, push, pop = self.ranks.get, len(data), self.queue.push, self.queue.pop
        after = list(range(1, n + 1))  # where a token ends and the next begins
        before = list(range(-1, n - 1))
        pair = [-1] * n  # rank of the pair that begins at a token, the only entry that is not stale
        for k in range(n - 1):
            r = ranks(data[k:k + 2])
            if r is not None:
                pair[k] = r
                push(r, k)
        while True:
            rank, k = pop()
            if rank < 0:
                break
            if pair[k] != rank:
                continue
            gone = after[k]
            end = after[k] = after[gone]
            pair[k] = pair[gone] = -1
            if end < n:
                before[end] = k
                r = ranks(data[k:after[end]])
                if r is not None:
                    pair[k] = r
                    push(r, k)
            if k:
                left = before[k]
                r = ranks(data[left:end])
                if r is None:
                    pair[left] = -1
                elif pair[left] != r:
                    pair[left] = r
                    push(r, left)
        out, k = [], 0
        while k < n:
            out.append(self.ranks[data[k:after[k]]])
            k = after[k]
        return out


class Decoder:
    """Token bytes by id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.token = {r: t for t, r in ranks.items()}.__getitem__

    def __call__(self, packed: bytes) -> bytes:
        return b"".join(map(self.token, struct.unpack(f"<{len(packed) // 4}I", packed)))


def _file(df: DataFrame, ranks: str | None):
    """The rank file, broadcast: its size is the vocabulary's, not the data's."""
    with open(ranks or default_ranks(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encoded(texts: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """row, n_tokens, ids (packed little-endian 32-bit numbers) of ``texts`` (row, text)."""
    shared, newer = _file(texts, ranks), newer_characters(pattern)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, memory, key = schema_of(_ENCODED), worker_memory(), ("bpe encoder", hash(shared.value), pattern)
        if key not in memory:
            memory[key] = Cutter(pattern, newer), Encoder(read_ranks(shared.value))
        cut, encoder = memory[key]

        def rows():
            for b in it:
                for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = b"".join(map(encoder.__getitem__, cut(text.as_py() or "")))
                    yield row, len(ids) // 4, ids

        yield batch_of([], schema)
        yield from batches(rows(), schema, 500)

    return texts.select(F.col("row").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _ENCODED)


def decoded(coded: DataFrame, ranks: str | None = None) -> DataFrame:
    """``coded`` (with packed ``ids``) and the ids' bytes as ``data``."""
    shared = _file(coded, ranks)
    ddl = ", ".join(f"`{n}` {t}" for n, t in coded.dtypes) + ", data binary"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, key = worker_memory(), ("bpe decoder", hash(shared.value))
        if key not in memory:
            memory[key] = Decoder(read_ranks(shared.value))
        decoder = memory[key]
        for b in it:
            for at in range(0, max(b.num_rows, 1), 500):
                some = b.slice(at, 500)
                data = [None if x is None else decoder(x) for x in some.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(data, pa.binary())], [*some.schema.names, "data"])

    return coded.mapInArrow(run, ddl)


def bpe_report(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    The id travels as ``row``, so rows need no number and no join."""
    there_and_back = decoded(encoded(docs.select(F.col("doc_id").alias("row"), "text"), ranks), ranks)
    return there_and_back.select(F.col("row").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                 F.sha2("data", 256).alias("decoded_sha256"))
