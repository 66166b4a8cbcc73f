"""Best-fit packing into sequences by hierarchical residual packing.

Documents are tokenised, ended by one id and cut into pieces of at most
``capacity`` tokens.  Pieces are dealt by hash into groups of about
``GROUP`` items; each group packs best-fit decreasing.  Nearly full bins are
final; underfull bins go on as items of the next round, dealt anew into
groups, until one group has packed them or a round merges nothing.  No task
ever holds more than a group, whatever the number of documents.

Texts are tokenised with a bounded memory of the words and pieces of words
seen (:class:`TokenIds`), whose ids joined are the ids of the text.

Defined cases: null text is empty and gives the end id alone; documents longer
than ``capacity`` are cut from the front, the last piece may be shorter;
repeated rows are packed each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import batch_of, batches, schema_of, text_bytes, word_hashes, worker_memory, written

CAPACITY = 4096
END_ID = 1
#: items of a packing group, and words or pieces of words a worker remembers (under 200 MB)
GROUP = 20_000
#: most rounds of merging (the round has 7 bits of a bin's number)
ROUNDS = 100
MOST_KNOWN = 600_000
#: a bin with less room than this is nearly full
NEARLY = 8
#: bytes whose words are hashed at once
BLOCK = 1 << 20

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


#: Words of these characters only are cut into pieces here; others are given
#: to the tokenizer whole.  (ASCII and the Latin-1 letters: no normalisation,
#: one-to-one lower case.)
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: fixed value: the tokenizer's own pieces, for lower-cased plain words
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
_RAW = "\0"


_SPACE = re.compile(rb"[\x20\x09-\x0d]")


class _Numbers(dict):
    """Numbers keys in the order they come; ``new`` lists those not yet learned."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self.new.append(key)
        n = self[key] = len(self)
        return n


class _Rows:
    """Ragged rows of numbers, in one flat array."""

    def __init__(self) -> None:
        self.flat, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.begin = self.length

    def add(self, flat: list[np.ndarray], length: list[np.ndarray]) -> None:
        self.flat, self.length = np.concatenate([self.flat, *flat]), np.concatenate([self.length, *length])
        self.begin = np.cumsum(self.length) - self.length

    def joined(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``k`` one after another, and their lengths."""
        n = self.length[k]
        shift = np.cumsum(n) - n
        return self.flat[np.repeat(self.begin[k] - shift, n) + np.arange(int(n.sum()))], n


class TokenIds:
    """Token ids of texts, with a memory of words and of pieces of words.

    The tokenizer lower-cases, drops white space and cuts a text into pieces
    (runs of letters, digits, runs of signs) that it encodes each for itself,
    so a word's ids are those of its pieces and a text's those of its words.
    A piece's last token, and no other, is one that ends a word.  Each memory
    is emptied when it holds more than ``most``."""

    def __init__(self, path: str, most: int = MOST_KNOWN) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.tok, self.most = Tokenizer.from_str(json.dumps(made)), most
        # the same model over pieces that are cut and lower-cased already
        made["normalizer"] = None
        made["pre_tokenizer"]["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        self.piece_tok = Tokenizer.from_str(json.dumps(made))
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.words, self.word_ids, self.pieces, self.piece_ids = {}, _Rows(), _Numbers(), _Rows()

    def _learn_pieces(self) -> None:
        flat, length = [], []
        new, self.pieces.new = self.pieces.new, []
        at = 0
        while at < len(new):
            if new[at].startswith(_RAW):
                ids = np.array(self.tok.encode(new[at][1:], add_special_tokens=False).ids, np.uint32)
                flat.append(ids)
                length.append(np.array([len(ids)], np.int64))
                at += 1
                continue
            some = list(itertools.takewhile(lambda x: not x.startswith(_RAW), new[at:at + 256]))
            ids = np.array(self.piece_tok.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            assert len(last) == len(some), "a piece without one last token"
            flat.append(ids)
            length.append(np.diff(last, prepend=-1))
            at += len(some)
        self.piece_ids.add(flat, length)

    def _learn_words(self, new: list[bytes]) -> None:
        numbers, count, number = [], [], self.pieces.__getitem__
        for w in new:
            x = w.decode()
            if _PLAIN.fullmatch(x) and "<|" not in x:
                got = _PIECE.findall(x.lower())
                numbers.extend(map(number, got))
                count.append(len(got))
            else:
                numbers.append(number(_RAW + x))
                count.append(1)
        self._learn_pieces()
        flat, n = self.piece_ids.joined(np.array(numbers, np.int64))
        ends = np.cumsum(count)
        total = np.concatenate([[0], np.cumsum(n)])
        self.word_ids.add([flat], [total[ends] - total[ends - count]])

    def _numbers(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of every word of ``data``; learns those not known."""
        starts, ends, h = word_hashes(data)
        kinds, first, back = np.unique(h, return_index=True, return_inverse=True)
        numbers, new, known = [], [], self.words
        for x, a, b in zip(kinds.tolist(), starts[first].tolist(), ends[first].tolist()):
            n = known.get(x)
            if n is None:
                n = known[x] = len(known)
                new.append(data[a:b])
            numbers.append(n)
        if new:
            self._learn_words(new)
        return starts, np.array(numbers, np.int64)[back]

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Each text's ids and the end id."""
        if len(self.words) > self.most:
            self.words, self.word_ids = {}, _Rows()
        if len(self.pieces) > self.most:
            self.pieces, self.piece_ids = _Numbers(), _Rows()
        data = b"\n".join(texts)
        starts, numbers, at = [], [], 0
        while at < len(data):  # blocks end at white space
            end = _SPACE.search(data, min(at + BLOCK, len(data)))
            end = end.start() if end else len(data)
            some, k = self._numbers(data[at:end])
            starts.append(some + at)
            numbers.append(k)
            at = max(end, at + 1)
        starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        ends = np.cumsum([len(x) + 1 for x in texts])
        cut = np.searchsorted(starts, ends)
        begin = 0
        for stop in cut.tolist():
            yield np.append(self.word_ids.joined(numbers[begin:stop])[0], np.uint32(END_ID))
            begin = stop


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
                 keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece."""
    path = tokenizer or default_tokenizer()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        schema = schema_of(PIECES)
        known = worker_memory().get(("token ids", path)) or TokenIds(path)
        worker_memory()["token ids", path] = known

        def rows():
            for big in it:
                for at in range(0, big.num_rows, 2000):
                    b = big.slice(at, 2000)
                    for doc, ids in zip(b.column(0).to_pylist(), known.of(text_bytes(b.column(1)))):
                        for k in range(0, len(ids), capacity):
                            raw = ids[k:k + capacity].astype("<u4").tobytes()
                            yield doc, k // capacity, k, len(raw) // 4, zlib.crc32(raw), raw if keep_ids else None

        yield batch_of([], schema)
        yield from batches(rows(), schema)

    out = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)
    return out if keep_ids else out.drop("ids")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit in the given order: (bin, offset) of every item and the fill of every bin."""
    bins, offs = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with room r is open
    for k, n in enumerate(lengths.tolist()):
        fits = some >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[k], offs[k] = b, fill[b]
        fill[b] += n
        if room - n:
            by_room[room - n].append(b)
            some |= 1 << (room - n)
    return bins, offs, np.array(fill, np.int64)


def _round(items: DataFrame, number: int, n: int, capacity: int) -> DataFrame:
    """Pack ``items`` (column length) in groups; adds bin, offset and the bin's fill."""
    groups = max(1, -(-n // GROUP))
    keys = [c for c in items.columns if c not in ("length", "ids")]
    dealt = items.withColumn("__group", F.pmod(F.xxhash64(F.lit(number), *keys), F.lit(groups)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["__group"].iloc[0])
        pdf = pdf.sort_values(["length", *keys], ascending=False, kind="stable").drop(columns="__group")
        b, off, fill = best_fit(pdf["length"].to_numpy(), capacity)
        return pdf.assign(bin=(number << 56) + (group << 24) + b, off=off, fill=fill[b])

    return dealt.groupBy("__group").applyInPandas(pack, f"{fields}, bin bigint, off bigint, fill bigint")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    # dealt by a row number: equal pieces (a third of all may be null texts) go to all groups
    pieces = written(pieces.withColumn("__n", F.monotonically_increasing_id()), "pieces")
    first = written(_round(pieces, 0, pieces.count(), capacity).drop("__n"), "bins-0")
    level, moves = first, []
    for number in range(1, ROUNDS + 1):
        open_bins = (level.filter(F.col("fill") < capacity - NEARLY).groupBy("bin")
                     .agg(F.max("fill").alias("length")).withColumnRenamed("bin", "child"))
        n = open_bins.count()
        if n < 2:
            break
        level = written(_round(open_bins, number, n, capacity), f"bins-{number}")
        moves.append(level.select("child", "bin", "off"))
        if n <= GROUP or level.select("bin").distinct().count() == n:
            break
    # from the last round down: where each open bin of the first round ends up
    path = None
    for m in reversed(moves):
        if path is not None:
            up = path.select(F.col("child").alias("bin"), F.col("bin").alias("top"), F.col("off").alias("more"))
            m = m.join(up, "bin", "left").select(
                "child", F.coalesce("top", "bin").alias("bin"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"))
        path = m
    out = first.drop("fill")
    if path is not None:
        up = path.select(F.col("child").alias("bin"), F.col("bin").alias("top"), F.col("off").alias("more"))
        out = out.join(up, "bin", "left").withColumn("off", F.col("off") + F.coalesce("more", F.lit(0))) \
            .withColumn("bin", F.coalesce("top", "bin")).drop("top", "more")
    return out.withColumnRenamed("bin", "sequence_id").withColumnRenamed("off", "offset")


def packed_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, tokenizer)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id and the ids (little-endian
    32-bit) of its pieces in order; a group is one sequence, so bounded."""
    packed = pack(token_pieces(docs, tokenizer, keep_ids=True))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    return packed.groupBy("sequence_id").agg(F.unhex(F.concat_ws("", parts)).alias("ids"))
