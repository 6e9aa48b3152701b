"""Best-fit packing of token sequences.

Bounded-space online best-fit: a fixed number of bins is open; a bitset whose bit f says
that an open bin has f places free gives the fullest bin that a piece fits into. When a
new bin is needed and all are open, the fullest one is closed.
"""

from __future__ import annotations

import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.bpe import CACHED_CHARS, PLAIN, _LATIN, byte_alphabet, load
from chronoframe.llm.common import Scratch

CAPACITY = 2048
OPEN_BINS = 256
#: Pieces of one task; those of bins that stay open at its end are packed again.
PIECES_A_TASK = 20_000
END = 0
CACHE = 400_000

PLAIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\s{_LATIN}0-9]+")


class WordIds(dict):
    """Packed ids of a text by a word-level vocabulary; words are looked up once."""

    def __init__(self, source: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(raw)]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE:  # what was used since the last time stays
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text) or "İ" in text:
            return self.whole(text)  # special tokens, or characters that are normalised
        return b"".join(map(self.__getitem__, PLAIN_SPLIT.findall(text.lower())))


class OpenBins:
    """The open bins by free space. put() gives a bin for a length; bins are only ever numbered upwards."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS, first: int = 0):
        self.capacity, self.most, self.next = capacity, most, first
        self.bits, self.count = 0, 0
        self.by_free: dict[int, list[int]] = {}

    def add(self, number: int, free: int) -> None:
        """An open bin of which so much is free; the fullest goes if there are too many."""
        if free <= 0:
            return
        if self.count >= self.most:
            self.take((self.bits & -self.bits).bit_length() - 1)
        self.by_free.setdefault(free, []).append(number)
        self.bits |= 1 << free
        self.count += 1

    def take(self, free: int) -> int:
        own = self.by_free[free]
        number = own.pop()
        self.count -= 1
        if not own:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return number

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece; the fullest bin that has room, else a new one."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self.take(free)
        else:
            free, number = self.capacity, self.next
            self.next += 1
        self.add(number, free - length)
        return number, self.capacity - free


def tokenized(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each text with id 0 after it.

    Null texts count as empty and give one piece of one token.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def run(batches):
        own = load(sent.value, WordIds)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, ids, rows = b.slice(at, 500), [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    packed = own.encode(text or "") + struct.pack("<I", END)
                    for k, cut in enumerate(range(0, len(packed), 4 * capacity)):
                        piece = packed[cut : cut + 4 * capacity]
                        ids.append(doc)
                        rows.append((k, k * capacity, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _fill(pieces: DataFrame, width: int, turn: int, capacity: int, open_bins: int) -> DataFrame:
    """Adds sequence_id and offset; each of width tasks packs its share, in an order given by a hash."""
    share = F.pmod(F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32"), F.lit(width)).cast("int")
    order = F.xxhash64(F.lit(turn + 100), "doc_id", "piece", "ids_crc32")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    dealt = pieces.select(*names, share.alias("share"), order.alias("turn")).repartition(width, "share")
    dealt = dealt.sortWithinPartitions("share", "turn", "doc_id", "piece").select(*names, "share")

    def run(batches):
        bins, at = None, None
        for b in batches:
            numbers, places = [], []
            for s, size in zip(b.column(5).to_pylist(), b.column(3).to_pylist()):
                if s != at:
                    at, bins = s, OpenBins(capacity, open_bins)
                number, place = bins.put(size)
                numbers.append((turn << 56) + (s << 32) + number)
                places.append(place)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], [*names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, turns: int = 3, full: float = 0.985) -> DataFrame:
    """Packs the token ids of all texts: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Tasks pack about 20,000 pieces each. The pieces of sequences that stay less than 98.5 %
    full, mostly those open at the end of a task, are dealt to fewer tasks and packed
    again, in three turns at most. Null texts count as empty and take one token; null ids
    stay null; repeated rows are packed each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    left, done = scratch.keep(tokenized(docs, vocabulary, capacity)), []
    for turn in range(1, turns + 1):
        width = max(1, -(-left.count() // PIECES_A_TASK))
        packed = scratch.keep(_fill(left, width, turn, capacity, open_bins))
        if turn == turns or width == 1:
            done.append(packed)
            break
        poor = packed.groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(F.col("filled") < int(full * capacity)).select("sequence_id")
        done.append(packed.join(poor, "sequence_id", "left_anti"))
        left = scratch.keep(packed.join(poor, "sequence_id", "left_semi").select(left.columns))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
