"""Byte-level BPE encoding and decoding.

The merges of a piece of text are done with a priority queue of merge ranks over a doubly
linked list of symbols; an entry of the queue whose symbols have changed since is stale
and skipped. Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from chronoframe.llm.common import held

#: How text is split before merging. Fixed value.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ſ"
#: The same split for texts of these characters only; the standard library is faster here.
PLAIN = re.compile(rf"[\t\n\r\x20-\x7e¡-±´-¸º»¿-ſ]*")
PLAIN_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
#: Pieces remembered by a Python worker, and the longest of them.
CACHE = 400_000
CACHED_CHARS = 64


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder(dict):
    """Ids of pieces as packed little-endian 32-bit integers; missing pieces are merged.

    With special tokens: their text always becomes their id, wherever it stands.
    """

    def __init__(self, source: bytes):
        d = json.loads(source)
        alphabet = byte_alphabet()
        vocab, pairs = d["model"]["vocab"], d["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.tokens = {i: t.encode() for t, i in self.special.items()}
        self.tokens |= {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        self.old: dict[str, bytes] = {}
        self.first = [0] * 256
        for i, t in self.tokens.items():
            if len(t) == 1:
                self.first[t[0]] = i
        self.merges = {}
        for rank, pair in enumerate(pairs):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            ids = self.merge(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE:  # what was used since the last time stays
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.first[b] for b in data]
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = []
        for i in range(n - 1):
            if (m := merges.get((ids[i], ids[i + 1]))) is not None:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of its symbols was merged away
            k = after[j]
            ids[i], ids[j], after[i] = joined, -1, k
            if k >= 0:
                before[k] = i
                if (m := merges.get((joined, ids[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, joined, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], joined))) is not None:
                heapq.heappush(heap, (m[0], h, ids[h], joined, m[1]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed."""
        parts = self.cuts.split(text) if self.cuts and "<|" in text else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                split = PLAIN_SPLIT if PLAIN.fullmatch(part) else SPLIT
                out.append(b"".join(map(self.__getitem__, split.findall(part))))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; broken UTF-8 gives replacement characters."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(packed).cast("I")]).decode("utf-8", "replace")


def load(source: bytes, kind=Encoder):
    """An encoder for a vocabulary file's bytes, made once in a Python process."""
    return held((kind, hashlib.sha256(source).digest()), lambda: kind(source))


ROUND_TRIP = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes each text with the vocabulary file at a path, decodes it; digests of both.

    A null text counts as empty: no tokens, digests of nothing. Null ids stay null;
    repeated rows give equal rows; an empty table gives none. The file is read on the
    driver and broadcast: its size does not depend on the data.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        own = load(sent.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, rows = b.slice(at, 500), []
                for text in part.column(1).to_pylist():
                    packed = own.encode(text or "")
                    rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(own.decode(packed).encode()).hexdigest()))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *cols], names)

    return docs.select("doc_id", "text").mapInArrow(run, ROUND_TRIP)
