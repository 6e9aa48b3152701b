"""Duplicate byte strings by a column-wise suffix array of many documents.

The segments that may hold equal windows are a collection whose suffixes are sorted by
inserting one symbol of each document in each round, from the last column to the first.
A round reads the order and the common prefixes of the round before from front to back
and writes new ones: the symbols before the sorted suffixes are the column of the
collection's Burrows-Wheeler transform, a stable sort by them is the next order, and the
common prefix of two neighbours with the same symbol is one more than the least that lay
between them. These sequences are the size of one batch of groups and kept in memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import anchors as A
from chronoframe.llm.common import Scratch, numbered, renamed

WINDOW = 400
#: Places of an anchor in a window, by level of splitting; the first anchor has 128 bytes.
RANGES = (273, 17, 1)
NONE = 256  # where a segment has no byte


def repeated_starts(group: np.ndarray, symbols: np.ndarray, window: int, rank: np.ndarray | None = None) -> np.ndarray:
    """For rows of symbols, grouped and aligned: whether the window from each early column recurs.

    group: numbers that do not fall. symbols: uint16, NONE where a row has no byte, which
    equals nothing. Column x of the result is true if another row of the group has the same
    window symbols at x; with ranks, a row of a lower one.
    """
    n, width = symbols.shape
    starts = width - window + 1
    out = np.zeros((n, starts), bool)
    columns = np.ascontiguousarray(symbols.T)
    base = group.astype(np.int64) * (NONE + 1)
    order, common = np.arange(n), np.zeros(n + 1, np.int64)
    for x in range(width - 1, -1, -1):
        bwt = columns[x][order]
        key = base[order] + bwt
        to = np.argsort(key, kind="stable")
        key, order = key[to], order[to]
        tied = np.concatenate([[False], key[1:] == key[:-1]]) & (bwt[to] != NONE)
        at = np.flatnonzero(tied)
        after = np.zeros(n + 1, np.int64)
        if len(at):
            bounds = np.empty(2 * len(at), np.int64)
            bounds[::2], bounds[1::2] = to[at - 1] + 1, to[at] + 1
            after[at] = np.minimum.reduceat(common, bounds)[::2] + 1
        if x == width - 1:
            after[:n][tied] = 1
        common = after
        if x < starts:
            deep = common >= window
            if rank is None:
                out[order, x] = deep[:n] | deep[1:]
            elif deep.any():
                least = np.minimum.reduceat(rank[order], np.flatnonzero(~deep[:n]))
                out[order, x] = rank[order] != least[np.cumsum(~deep[:n]) - 1]
    return out


def solve(r: int, window: int = WINDOW, keep_first: bool = False):
    """Runs that repeated windows cover, of segments sorted by group; keep_first: the earliest of equal windows is not covered."""

    def run(batches):
        for rows in A.groups(batches):
            width = r - 1 + window
            symbols = np.full((len(rows), width), NONE, np.uint16)
            first = np.empty(len(rows), np.int64)
            for i, (_, _, _, p, lo, hi, data) in enumerate(rows):
                first[i] = p - r + 1
                symbols[i, lo - first[i] : hi - first[i]] = np.frombuffer(data, np.uint8)
            keys = np.array([row[0] for row in rows])
            group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
            rank = None
            if keep_first:  # by document, then place; equal ones, which repeat an id, tie
                places = np.array([(row[1], row[3]) for row in rows])
                rank = np.unique(places, axis=0, return_inverse=True)[1].ravel()
            yield from A.run_rows(rows, repeated_starts(group, symbols, window, rank), first, window)

    return run


def _cut_out(data: bytes, runs) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs, what is left)."""
    spans, kept, at = A.union_of(runs), [], 0
    for a, z in spans:
        kept.append(data[at:a])
        at = z
    kept.append(data[at:])
    return sum(z - a for a, z in spans), len(spans), b"".join(kept)


def repeats(docs: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(doc_id, th, text, runs) of all documents: runs of bytes that strings of window bytes cover that start elsewhere too.

    Equal rows count as different documents. Null texts count as empty.
    """
    own = A.keyed(docs)
    ranges = RANGES if window == WINDOW else _ranges(window)
    runs = scratch.keep(A.covered(own, A.Shape(A.Bytes, window, ranges), lambda r: solve(r, window), False, scratch))
    return own.join(A.merged(runs), ["doc_id", "th"], "left")


def _ranges(window: int) -> tuple[int, ...]:
    """About two thirds of a window, the square root of that, and 1."""
    r = max(1, 2 * window // 3)
    return tuple(dict.fromkeys((r, max(1, round(r**0.5)), 1)))


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of docs(doc_id, text).

    A null text counts as empty; null ids stay null; each of repeated rows is a document,
    so that a long enough one is removed in all of them; an empty table gives no rows.
    """
    found = repeats(docs, Scratch(docs.sparkSession), window)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, rows = b.slice(at, 500), []
                for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = text.encode()
                    n, spans, kept = _cut_out(data, runs)
                    rows.append((len(data), n, spans, hashlib.sha256(kept).hexdigest()))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = found.select("doc_id", "text", "runs").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(A.NO_ID)))


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the bytes of text that strings of window bytes cover which start earlier too, and n_chars set where there is one.

    Earlier is in a smaller doc_id, a null one being the least, or before in the same
    document, so that the first copy of a passage stays. Rows that repeat an id are one
    document in that respect and keep what they share at the same place. A character that
    loses some of its bytes goes as a whole. Null texts stay null, other columns stay as
    they are whatever their names, and an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    shape = A.Shape(A.Bytes, window, RANGES if window == WINDOW else _ranges(window))
    found = A.covered(A.keyed(docs.select("doc_id", "text")), shape, lambda r: solve(r, window, True), True, scratch)
    runs = A.merged(scratch.keep(found))

    def cut(texts, runs):
        import pandas as pd

        out = []
        for text, own in zip(texts, runs):
            out.append(text if text is None or own is None or not len(own) else _cut_out(text.encode(), own)[2].decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    cut.__annotations__ = {}
    udf = F.pandas_udf(cut, "string", F.PandasUDFType.SCALAR)
    own, at = numbered(docs)
    text = F.col(at["text"])
    left = own.withColumn("doc_id", F.coalesce(F.col(at["doc_id"]).cast("bigint"), F.lit(A.NO_ID))).withColumn("th", F.xxhash64(F.coalesce(text, F.lit(""))))
    out = left.join(runs, ["doc_id", "th"], "left").withColumn("left", udf(text, F.col("runs")))
    new = {"text": F.col("left")}
    if "n_chars" in at:
        new["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    return out.select(renamed(at, **new))
