"""Duplicate word sequences by prefix-partitioned suffix trees.

The suffixes that may share a long enough prefix are split by prefixes of variable length,
one word longer at a time, until a part is small enough for memory. The suffix tree of a
part is built from its sorted suffixes and their common prefixes; an internal node at
least a window deep is a maximal repeat, and its leaves are the places where it starts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import anchors as A
from chronoframe.llm.common import Scratch

WINDOW = 20
#: Places of an anchor in a window, by level of splitting; the first anchor has 5 words.
RANGES = (16, 1)
#: Suffixes of one tree.
PART = 50_000


def parts(suffixes: np.ndarray, rows: np.ndarray, depth: int = 0):
    """Splits rows of a suffix matrix by prefixes of growing length until at most PART share one.

    A part of suffixes that are equal throughout is not split further.
    """
    if len(rows) <= PART or depth == suffixes.shape[1]:
        if len(rows) > 1:
            yield rows
        return
    word = suffixes[rows, depth]
    order = np.argsort(word, kind="stable")
    cuts = np.flatnonzero(np.diff(word[order])) + 1
    for own in np.split(rows[order], cuts):
        if len(own) > 1:
            yield from parts(suffixes, own, depth + 1)


class Tree:
    """The suffix tree of some suffixes: its leaves in order and its internal nodes.

    order: rows, sorted. lcp[i]: words that order[i - 1] and order[i] share. nodes():
    (depth, first leaf, end) of internal nodes, found with a stack over the lcp.
    """

    def __init__(self, suffixes: np.ndarray, rows: np.ndarray):
        own = np.ascontiguousarray(suffixes[rows].astype(">u4"))
        to = np.argsort(own.view(f"V{own.shape[1] * 4}").ravel(), kind="stable")
        self.order, own = rows[to], own[to]
        differ = own[1:] != own[:-1]
        equal = ~differ.any(axis=1)
        self.lcp = np.concatenate([[0], np.where(equal, own.shape[1], differ.argmax(axis=1))]) if len(own) else np.zeros(0, np.int64)

    def nodes(self):
        stack: list[list[int]] = []
        for i, depth in enumerate([*self.lcp.tolist(), 0]):
            left = i - 1
            while stack and stack[-1][0] > depth:
                top = stack.pop()
                yield top[0], top[1], i
                left = top[1]
            if depth and (not stack or stack[-1][0] < depth):
                stack.append([depth, left])

    def deep(self, depth: int):
        """(first leaf, end) of the topmost nodes that are at least so deep."""
        inside = np.concatenate([[False], self.lcp[1:] >= depth, [False]])
        step = np.diff(inside.astype(np.int8))
        return zip((np.flatnonzero(step == 1)).tolist(), (np.flatnonzero(step == -1) + 1).tolist())


def later_starts(rows: list, r: int, window: int) -> np.ndarray:
    """For segments (gk, doc_id, th, p, lo, hi, data): whether the window from each place starts earlier in another one too."""
    width = r - 1 + window
    ids: dict[bytes, int] = {}
    words = np.empty((len(rows), width + r - 1), np.uint32)
    words[:] = 0xFFFFFFFF - np.arange(words.size, dtype=np.uint32).reshape(words.shape)  # no word: equal to nothing
    group, first = np.empty(len(rows), np.uint32), np.empty(len(rows), np.int64)
    key = None
    for i, (gk, _, _, p, lo, hi, data) in enumerate(rows):
        if gk != key:
            key, number = gk, i
        group[i], first[i] = number, p - r + 1
        at = lo - first[i]
        words[i, at : at + hi - lo] = [ids.setdefault(w, len(ids)) for w in data.split(b" ")]
    lo = np.array([row[4] for row in rows]) - first
    hi = np.array([row[5] for row in rows]) - first
    place = np.arange(r)
    i, t = np.nonzero((place[None] >= lo[:, None]) & (place[None] + window <= hi[:, None]))
    # a suffix starts with its group, so that no node spans two groups
    suffixes = np.concatenate([group[i][:, None], np.lib.stride_tricks.sliding_window_view(words, width, axis=1)[i, t]], axis=1)
    docs, start = np.array([row[1] for row in rows], np.int64)[i], first[i] + t
    out = np.zeros((len(rows), r), bool)
    for part in parts(suffixes, np.arange(len(i))):
        tree = Tree(suffixes, part)
        for a, z in tree.deep(window + 1):
            leaves = tree.order[a:z]
            d, s = docs[leaves], start[leaves]
            least = d.min()
            later = (d > least) | (s > s[d == least].min())
            out[i[leaves[later]], t[leaves[later]]] = True
    return out


def solve(r: int, window: int = WINDOW):
    def run(batches):
        for rows in A.groups(batches):
            first = np.array([row[3] - r + 1 for row in rows], np.int64)
            yield from A.run_rows(rows, later_starts(rows, r, window), first, window)

    return run


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of docs(doc_id, text).

    The first of equal windows stays: that of the least doc_id, a null id being the
    least of all, then of the earliest start. Rows that repeat an id are one document in
    that respect, so neither loses what it shares with the other at the same place. Null
    texts have no words.
    """
    scratch = Scratch(docs.sparkSession)
    own = A.keyed(docs)
    ranges = RANGES if window == WINDOW else tuple(dict.fromkeys((max(1, window * 4 // 5), 1)))
    runs = scratch.keep(A.covered(own, A.Shape(A.Words, window, ranges), lambda r: solve(r, window), True, scratch))
    found = own.join(A.merged(runs), ["doc_id", "th"], "left")

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, rows = b.slice(at, 500), []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words, kept, end = text.encode().split(), [], 0
                    for a, z in A.union_of(runs):
                        kept += words[end:a]
                        end = z
                    kept += words[end:]
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = found.select("doc_id", "text", "runs").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(A.NO_ID)))
