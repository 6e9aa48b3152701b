"""Where texts may repeat: content-chosen anchors, and the segments around them.

Texts are sequences of units (bytes or words) and a window is L consecutive units. In each
window the k-gram with the least hash, the leftmost of equals, is its anchor: equal
windows have equal anchors at equal places. All windows with an anchor in a place t of
0..r-1 before it, r = L - k + 1, lie in the segment from r - 1 units before the anchor to
L units after its start. So windows can only be equal if their segments are in the group
of one anchor, and groups can be solved apart.

Equal segments of a group are one class, solved once. A group of too many classes is split
exactly: the places t are cut into pieces of a smaller r, each of which has a longer
anchor, up to r = 1, where the anchor is the window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import Scratch, shuffle_width

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Units whose windows are hashed at a time, so that a long text needs little memory.
CHUNK = 1 << 20
#: A group of more classes is split.
HOT = 200
NO_ID = -(1 << 63)

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (BASE, INVERSE):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def spans_hash(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of x[start:end] for many spans, by one running sum."""
    up, down = _powers(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class Bytes:
    """A text as UTF-8 bytes."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    @classmethod
    def of(cls, text: str | None):
        return cls((text or "").encode())

    def hashes(self, lo: int, hi: int) -> np.ndarray:
        return _BYTE[np.frombuffer(self.data, np.uint8, hi - lo, lo)]

    def edges(self, lo: np.ndarray, hi: np.ndarray):
        """Where spans of units start and end in the data."""
        return lo, hi

    def cut(self, lo: int, hi: int) -> bytes:
        return self.data[lo:hi]


class Words:
    """A text as words of other characters than the six ASCII spaces, joined by one space."""

    def __init__(self, data: bytes):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.start = np.concatenate([[0], gaps + 1]) if data else np.zeros(0, np.int64)
        self.end = np.concatenate([gaps, [len(data)]]) if data else np.zeros(0, np.int64)
        self.size = len(self.start)

    @classmethod
    def of(cls, text: str | None):
        return cls(b" ".join((text or "").encode().split()))

    def hashes(self, lo: int, hi: int) -> np.ndarray:
        if hi <= lo:
            return np.zeros(0, np.uint64)
        a, b = int(self.start[lo]), int(self.end[hi - 1])
        x = _BYTE[np.frombuffer(self.data, np.uint8, b - a, a)]
        return spans_hash(x, self.start[lo:hi] - a, self.end[lo:hi] - a)

    def edges(self, lo: np.ndarray, hi: np.ndarray):
        return self.start[lo], self.end[hi - 1]

    def cut(self, lo: int, hi: int) -> bytes:
        return self.data[self.start[lo] : self.end[hi - 1]] if hi > lo else b""


@dataclass(frozen=True)
class Shape:
    """Units, the window L, and the places of each level: r of the first anchor, ..., 1."""

    units: type
    window: int
    ranges: tuple[int, ...]


def anchors(text, window: int, r: int):
    """(places, hashes) of the anchors of a text, in order."""
    k, last = window - r + 1, -1
    for at in range(0, text.size - window + 1, CHUNK):
        hi = min(text.size, at + CHUNK + window - 1)
        x = text.hashes(at, hi)
        n = len(x) - k + 1
        first = np.arange(n)
        h = spans_hash(x, first, first + k)
        both = (h & np.uint64(0xFFFFFFFF00000000)) | first.astype(np.uint64)
        padded = np.full(-(-n // r) * r, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:n] = both
        grid = padded.reshape(-1, r)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = len(x) - window + 1
        least = np.minimum(behind[:windows], ahead[r - 1 : r - 1 + windows])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
        place = place[place + at > last]
        if len(place):
            last = int(place[-1]) + at
            yield place + at, h[place]


def segment(p: int, lo: int, hi: int, window: int, r: int) -> tuple[int, int]:
    """First unit and end of the segment of an anchor within lo..hi."""
    return max(lo, p - r + 1), min(hi, p + window)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MEMBERS = "gk bigint, s bigint, doc_id bigint, th bigint, src bigint, p bigint, lo bigint, hi bigint"
_NAMES = [x.split()[0] for x in MEMBERS.split(", ")]


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], _NAMES)


def _first_keys(shape: Shape):
    """Only the groups of all anchors of texts (text)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                found = [h for data in b.column(0).slice(at, 200).to_pylist() for _, h in anchors(shape.units.of(data), shape.window, shape.ranges[0])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["gk"])

    return run


def _first_members(shape: Shape):
    """Members (group, class, document, anchor, segment) of all texts (doc_id, th, text)."""

    def run(batches):
        digest, r = xxhash.xxh3_64_intdigest, shape.ranges[0]
        for b in batches:
            for at in range(0, b.num_rows, 200):
                keys, classes, docs, hashes, places, los, his = [], [], [], [], [], [], []
                for doc, th, data in zip(*(c.to_pylist() for c in b.slice(at, 200).columns)):
                    text = shape.units.of(data)
                    for p, h in anchors(text, shape.window, r):
                        lo, hi = np.maximum(p - r + 1, 0), np.minimum(p + shape.window, text.size)
                        a, z = text.edges(lo, hi)
                        raw = text.data
                        classes += [digest(raw[x:y], g) for x, y, g in zip(a.tolist(), z.tolist(), (p - lo).tolist())]
                        keys.append(h.view(np.int64))
                        docs.append(np.full(len(p), doc, np.int64))
                        hashes.append(np.full(len(p), th, np.int64))
                        places.append(p)
                        los.append(lo)
                        his.append(hi)
                if keys:
                    joined = [np.concatenate(x) for x in (keys, docs, hashes, places, los, his)]
                    own = [joined[0], np.array(classes, np.uint64).view(np.int64), joined[1], joined[2], np.zeros(len(classes), np.int64), *joined[3:]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in own], _NAMES)

    return run


def _next_members(shape: Shape, level: int):
    """Members of a level from segments (gk, doc_id, th, p, lo, hi, data) of the level before."""

    def run(batches):
        digest, r, old = xxhash.xxh3_64_intdigest, shape.ranges[level], shape.ranges[level - 1]
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows = []
                for gk, doc, th, q, lo, hi, data in zip(*(c.to_pylist() for c in b.slice(at, 200).columns)):
                    text = shape.units(data)
                    for j in range(-(-old // r)):
                        p = q - j * r
                        if p < lo or p + shape.window - r + 1 > hi:
                            continue
                        a, z = segment(p, lo, hi, shape.window, r)
                        if z - a < shape.window:
                            continue
                        key = _signed(digest(text.cut(p - lo, p - lo + shape.window - r + 1), (gk + j) & 0xFFFFFFFFFFFFFFFF))
                        rows.append((key, _signed(digest(text.cut(a - lo, z - lo), p - a)), doc, th, q, p, a, z))
                if rows:
                    yield _rows(rows)

    return run


def _cut(shape: Shape, first: bool):
    """Segments' own data from sources (doc_id, th, base, data, wanted)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                doc, th, base, data = (c.to_pylist() for c in part.columns[:4])
                wanted = part.column(4)
                n = np.diff(np.asarray(wanted.offsets))
                flat = wanted.flatten()
                gk, g, p, lo, hi = (np.asarray(flat.field(x)) for x in ("gk", "g", "p", "lo", "hi"))
                ids = np.repeat(np.arange(len(n)), n)
                for start, end in _portions(n):
                    cut, begin = [], int(n[:start].sum())
                    rows = slice(begin, begin + int(n[start:end].sum()))
                    for i in range(start, end):
                        text = shape.units.of(data[i]) if first else shape.units(data[i])
                        own = slice(begin, begin + int(n[i]))
                        a, z = text.edges(lo[own] - base[i], hi[own] - base[i])
                        raw = text.data
                        cut += [raw[x:y] for x, y in zip(a.tolist(), z.tolist())]
                        begin += int(n[i])
                    docs, hashes = np.array(doc, np.int64)[ids[rows]], np.array(th, np.int64)[ids[rows]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (gk[rows], g[rows], docs, hashes, p[rows], lo[rows], hi[rows])), pa.array(cut, pa.binary())], ["gk", "g", "doc_id", "th", "p", "lo", "hi", "data"])

    return run


def _portions(n: np.ndarray, most: int = 20_000):
    """Ranges of rows that make about so many segments each."""
    start, total = 0, 0
    for i, x in enumerate(n.tolist()):
        total += x
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(n):
        yield start, len(n)


def keyed(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as (doc_id, th, text): a null id becomes the least number, th is a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def covered(docs: DataFrame, shape: Shape, solve: Callable, keep_first: bool, scratch: Scratch) -> DataFrame:
    """(doc_id, th, a, z): runs of units that repeated windows cover, of keyed documents.

    solve(r) gives a function for mapInArrow over segments (gk, doc_id, th, p, lo, hi,
    data) sorted by group, whose rows are such runs. keep_first: the earliest of equal
    windows is not covered.
    """
    width = shuffle_width(docs.sparkSession)
    members = docs.mapInArrow(_first_members(shape), MEMBERS)
    keys = docs.select("text").mapInArrow(_first_keys(shape), "gk bigint")
    seen = scratch.keep(keys.groupBy("gk").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gk"))
    found = scratch.keep(members.join(seen, "gk", "left_semi"))
    source = docs.select("doc_id", "th", F.lit(0).cast("bigint").alias("src"), F.lit(0).cast("bigint").alias("base"), F.col("text").alias("data"))
    runs = []
    for level, r in enumerate(shape.ranges):
        one = F.struct("doc_id", "p", "th", "src", "lo", "hi")
        classes = scratch.keep(found.groupBy("gk", "s").agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("one")))
        many = classes.where("n > 1").select("gk", "s", *([F.col("one.doc_id").alias("d1"), F.col("one.p").alias("p1")] if keep_first else []))
        copies = found.join(many, ["gk", "s"])
        if keep_first:
            copies = copies.where("doc_id != d1 OR p != p1")
        runs.append(copies.where(F.col("hi") - F.col("lo") >= shape.window).select("doc_id", "th", F.col("lo").alias("a"), F.col("hi").alias("z")))
        if r == 1:
            break
        sizes = scratch.keep(classes.groupBy("gk").agg(F.count(F.lit(1)).alias("g")).where("g > 1"))
        wanted = classes.join(sizes, "gk").select("gk", "g", "one.*").where(F.col("hi") - F.col("lo") >= shape.window)
        wanted = wanted.groupBy("doc_id", "th", "src").agg(F.collect_list(F.struct("gk", "g", "p", "lo", "hi")).alias("wanted"))
        cut = source.join(wanted, ["doc_id", "th", "src"]).select("doc_id", "th", "base", "data", "wanted")
        segments = scratch.keep(cut.mapInArrow(_cut(shape, level == 0), "gk bigint, g bigint, doc_id bigint, th bigint, p bigint, lo bigint, hi bigint, data binary"))
        cold = segments.where(F.col("g") <= HOT).select("gk", "doc_id", "th", "p", "lo", "hi", "data")
        dealt = cold.repartition(width, "gk").sortWithinPartitions("gk")
        runs.append(scratch.keep(dealt.mapInArrow(solve(r), "doc_id bigint, th bigint, a bigint, z bigint")))
        hot = segments.where(F.col("g") > HOT)
        if hot.isEmpty():
            break
        found = scratch.keep(hot.select("gk", "doc_id", "th", "p", "lo", "hi", "data").mapInArrow(_next_members(shape, level + 1), MEMBERS))
        source = hot.select("doc_id", "th", F.col("p").alias("src"), F.col("lo").alias("base"), "data")
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out


def groups(batches, most: int = 4000):
    """Lists of rows (gk, doc_id, th, p, lo, hi, data) of whole groups, about so many rows each."""
    rows: list = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if len(rows) >= most and row[0] != rows[-1][0]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def run_rows(rows: list, covered_starts: np.ndarray, first: np.ndarray, window: int):
    """Runs of units from a matrix of covered window starts; first: the unit of each row's column 0."""
    n, r = covered_starts.shape
    edge = np.zeros((n, r + 2), np.int8)
    edge[:, 1:-1] = covered_starts
    step = np.diff(edge, axis=1)
    i, a = np.nonzero(step == 1)
    _, z = np.nonzero(step == -1)
    if len(i):
        at = first[i]
        doc, th = (np.array([row[c] for row in rows], np.int64)[i] for c in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, th, at + a, at + z - 1 + window)], ["doc_id", "th", "a", "z"])


def merged(runs: DataFrame) -> DataFrame:
    """(doc_id, th, runs): sorted arrays of (a, z) for each document that has any."""
    return runs.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("runs"))


def union_of(runs) -> list[tuple[int, int]]:
    """Sorted runs (a, z) with overlapping and touching ones joined."""
    out: list[list[int]] = []
    for r in () if runs is None else runs:
        a, z = r["a"], r["z"]
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]
