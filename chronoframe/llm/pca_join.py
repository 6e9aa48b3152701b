"""Near-duplicate embeddings by a PCA-ordered tiled comparison.

Vectors of length one are turned so that the leading dimensions hold the most variance.
The first two give a grid of cells as wide as the greatest distance of a pair at the
threshold, so that only neighbouring cells are compared, block against block. Within a
tile the products of leading dimensions are added up first; the norms of what is left of
two vectors bound the rest, and a tile is left as soon as no pair can reach the threshold.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import Scratch, shuffle_width
from chronoframe.llm.components import Forest, components

THRESHOLD = 0.98
#: Vectors that the turn is fitted on (it changes the cost, never the result), and rows of a block and of a tile.
SAMPLE, BLOCK, TILE, STEP = 5000, 1000, 256, 8
SLACK = 1e-9


def turn(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes by falling variance around the origin, as columns."""
    values, axes = np.linalg.eigh(sample.T @ sample)
    return axes[:, np.argsort(-values, kind="stable")]


def unit(v) -> np.ndarray | None:
    """The vector at length one, or None if it is null, zero or holds nulls or non-finite numbers."""
    if v is None or len(v) == 0 or any(x is None for x in v):
        return None
    x = np.asarray(v, np.float64)
    top = np.abs(x).max() if np.isfinite(x).all() else 0.0
    if not top:
        return None
    x = x / top  # so that squares neither overflow nor vanish
    return x / math.sqrt(float(x @ x))


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
    """(i, j) of rows of a and b whose product reaches the threshold; i < j if they are the same rows."""
    rest_a = np.sqrt(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1])
    rest_b = np.sqrt(np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1])
    order_a, order_b = np.argsort(a[:, 0], kind="stable"), np.argsort(b[:, 0], kind="stable")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    for s in range(0, len(a), TILE):
        i = order_a[s : s + TILE]
        low, high = np.searchsorted(b[order_b, 0], [a[i[0], 0] - reach, a[i[-1], 0] + reach], side="left")
        for t in range(low, high, TILE):
            j = order_b[t : min(high, t + TILE)]
            x, y, rx, ry = a[i], b[j], rest_a[i], rest_b[j]
            dots = np.zeros((len(i), len(j)))
            d, width = 0, a.shape[1]
            while d < width:
                e = min(width, d + STEP)
                dots += x[:, d:e] @ y[:, d:e].T
                d = e
                bound = dots + rx[:, d : d + 1] * ry[:, d : d + 1].T if d < width else dots
                p, q = np.nonzero(bound >= threshold - SLACK)
                if not len(p):
                    break
                if len(p) * 8 < dots.size:  # few are left: each on its own
                    part = dots[p, q] + np.einsum("ij,ij->i", x[p, d:], y[q, d:])
                    keep = part >= threshold - SLACK
                    p, q = p[keep], q[keep]
                    break
            if len(p):
                p, q = i[p], j[q]
                if same:
                    keep = p < q
                    p, q = p[keep], q[keep]
                yield p, q


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, from the vectors as they are."""
    return np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))


_CLASS = ["label", "rep", "weight", "dim", "x", "y", "vector"]


def _place(axes, width: float):
    """Cells of classes (label, rep, weight, embedding); unusable vectors are left out."""

    def run(batches):
        turns = pickle.loads(axes)
        for b in batches:
            rows = []
            for label, rep, weight, v in zip(*(c.to_pylist() for c in b.columns)):
                u = unit(v)
                if u is None:
                    continue
                lead = u @ turns[len(u)][:, :2] if len(u) in turns else u[:2]
                x, y = (int(math.floor(c / width)) for c in (*lead, 0.0)[:2])
                rows.append((label, rep, weight, len(u), x, y, np.asarray(v, np.float64).tobytes()))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _CLASS)

    return run


def _compare(axes, threshold: float):
    """Links of groups of rows (key, left, rep, weight, vector): (rep, links) rows with v null, and spanning edges (u, v)."""

    def run(batches):
        turns, forest, links = pickle.loads(axes), Forest(), {}

        def close(rows):
            both = all(r[1] == 0 for r in rows)
            sides = [rows, rows] if both else [[r for r in rows if r[1] == 0], [r for r in rows if r[1] == 1]]
            if not sides[0] or not sides[1] or (both and len(rows) < 2):
                return
            raw = [np.frombuffer(b"".join(r[4] for r in s)).reshape(len(s), -1) for s in sides]
            turned = []
            for x in raw:
                y = x / np.abs(x).max(axis=1, keepdims=True)
                y = y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]
                turned.append(y @ turns[y.shape[1]] if y.shape[1] in turns else y)
            scaled = [x / np.abs(x).max(axis=1, keepdims=True) for x in raw]
            reps, weights = ([np.array([r[c] for r in s]) for s in sides] for c in (2, 3))
            for i, j in near_pairs(*turned, threshold, both):
                keep = cosines(scaled[0][i], scaled[1][j]) >= threshold
                i, j = i[keep], j[keep]
                for u, v, m, n in zip(reps[0][i].tolist(), reps[1][j].tolist(), weights[0][i].tolist(), weights[1][j].tolist()):
                    links[u] = links.get(u, 0) + n
                    links[v] = links.get(v, 0) + m
                    forest.join(u, v)

        key, rows = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != key:
                    if rows:
                        close(rows)
                    key, rows = row[0], []
                rows.append(row)
        if rows:
            close(rows)
        out = [(u, None, n) for u, n in links.items()] + [(u, v, None) for u, v in forest.edges()]
        for at in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[at : at + 50_000])], ["u", "v", "n"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of vectors(vec_id, embedding, label).

    Vectors of one label and one length are linked at a cosine of the threshold or more.
    Null labels, and vectors that are null, empty, zero or hold null or non-finite
    numbers, link with nothing: a component of their own. Null ids stay null. Rows that
    repeat an id are vectors each, of one component. Equal vectors of a label are
    compared as one with a weight.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")).alias("embedding"))  # -0.0 as 0.0
    good = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    hashes = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding", "label").alias("h2")]
    classes = own.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = scratch.keep(classes.select("label", "rep", "weight", "embedding", *hashes))
    rows = classes.count()
    share = min(1.0, SAMPLE / max(1, rows))
    sample = classes.where(F.pmod(F.col("h1"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("embedding").limit(2 * SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        if (u := unit(r["embedding"])) is not None:
            by_dim.setdefault(len(u), []).append(u)
    axes = pickle.dumps({d: turn(np.array(x)) for d, x in by_dim.items()})
    width = math.sqrt(max(1e-6, 2 - 2 * threshold)) + 1e-6
    placed = scratch.keep(classes.select("label", "rep", "weight", "embedding").mapInArrow(_place(axes, width), "label string, rep bigint, weight bigint, dim int, x int, y int, vector binary"))
    cells = scratch.keep(placed.groupBy("label", "dim", "x", "y").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    cell = ["label", "dim", "x", "y"]
    mine = placed.join(cells, cell).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    mine = mine.withColumn("to", F.explode(steps)).withColumn("nx", F.col("x") + F.col("to.i")).withColumn("ny", F.col("y") + F.col("to.j"))
    other = cells.select("label", "dim", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("blocks").alias("others"))
    pairs = mine.join(other, ["label", "dim", "nx", "ny"]).withColumn("nb", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    here, there = F.struct("x", "y", "block"), F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nb").alias("block"))
    key = F.concat_ws("|", "dim", *[F.concat_ws(",", *[s[c].cast("string") for c in ("x", "y", "block")]) for s in (F.least(here, there), F.greatest(here, there))], "label")
    dealt = pairs.select(key.alias("key"), F.when(here <= there, 0).otherwise(1).alias("side"), "rep", "weight", "vector")
    dealt = dealt.repartition(shuffle_width(spark), "key").sortWithinPartitions("key", "rep")
    found = scratch.keep(dealt.mapInArrow(_compare(axes, threshold), "u bigint, v bigint, n bigint"))
    roots = components(found.where(F.col("v").isNotNull()).select("u", "v"), scratch)
    links = found.where(F.col("n").isNotNull()).groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    usable = placed.select("rep", F.lit(1).alias("usable"))
    said = classes.select("label", "h1", "h2", "rep", "weight").join(usable, "rep").join(links, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    said = scratch.keep(said.select("label", "h1", "h2", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")))
    out = own.select("vec_id", "label", *hashes).join(said, ["label", "h1", "h2"], "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
