"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated bits are grouped into partitions of unequal threshold: if two fingerprints
differ in at most tau bits and the thresholds of m partitions sum to tau - m + 1, they
differ in no more than its threshold within some partition. Dynamic programming chooses
the thresholds that make the fewest candidates on a sample. Keys within each threshold
are probed and every candidate is verified on all 64 bits.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.anchors import mix
from chronoframe.llm.common import Scratch, held, numbered, renamed, shuffle_width
from chronoframe.llm.components import Forest, components

BITS, RADIUS, WIDTH, SEED = 64, 3, 3, 42
#: Fingerprints that the partitions are planned on; the plan changes the cost, never the result.
PLAN_SAMPLE = 4000
#: Rows of one block; a key with more is compared block by block in as many tasks.
BLOCK = 1000


def shingles(text: str, width: int) -> list[bytes]:
    """Runs of so many words joined by a space, repeats included; of fewer words the one there is."""
    raw = text.encode().lower().split()  # of bytes: only A-Z and the six ASCII spaces
    if len(raw) <= width:
        return [b" ".join(raw)] if raw else []
    if width == 3:
        return [b"%b %b %b" % x for x in zip(raw, raw[1:], raw[2:])]
    return [b" ".join(raw[i : i + width]) for i in range(len(raw) - width + 1)]


def fingerprint(text: str, width: int = WIDTH) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; 0 without words."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles(text, width)], np.uint64)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed number) of docs(doc_id, text); null texts count as empty."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                fps = np.array([fingerprint(t or "", width) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


# ---- the plan


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of equal size; each takes the bits that correlate most with those it has."""
    x = bits - bits.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0)) + 1e-9
    corr = np.abs((x.T @ x) / np.outer(norm, norm))
    np.fill_diagonal(corr, 0)
    left, out = set(range(bits.shape[1])), []
    for k in range(m):
        size = len(left) // (m - k)
        own = [max(left, key=lambda i: (corr[i, sorted(left)].sum(), -i))]
        left.discard(own[0])
        while len(own) < size:
            nxt = max(left, key=lambda i: (corr[i, own].sum(), -i))
            own.append(nxt)
            left.discard(nxt)
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with a given sum; costs[i][t + 1] is that of threshold t of partition i."""
    best = {0: (0.0, [])}
    for own in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in enumerate(own, -1):
                if s + t not in nxt or c + x < nxt[s + t][0]:
                    nxt[s + t] = (c + x, [*ts, t])
        best = nxt
    return best[total]


def plan(sample: np.ndarray, rows: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition, of the number of partitions that costs least."""
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    if len(sample) < 2:
        bits = np.vstack([bits, np.zeros((2, BITS))])
    found = None
    for m in range(2, radius + 2):
        groups, costs = group_bits(bits, m), []
        for own in groups:
            x = bits[:, own]
            part = x.sum(axis=1)
            near = np.zeros(radius + 1)
            for at in range(0, len(x), 1000):
                d = part[at : at + 1000, None] + part[None] - 2 * (x[at : at + 1000] @ x.T)
                near += [(d <= t + 0.5).sum() for t in range(radius + 1)]
            share = np.maximum(near - len(x), 0) / max(1, len(x) * (len(x) - 1))
            probes = [sum(_choose(len(own), j) for j in range(t + 1)) for t in range(radius + 1)]
            costs.append([0.0] + [50.0 * rows * probes[t] + share[t] * rows * rows for t in range(radius + 1)])
        cost, ts = allocate(costs, radius - m + 1)
        if found is None or cost < found[0]:
            found = cost, list(zip(groups, ts))
    return found[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


# ---- probing and verifying


def _probe(parts):
    masks = [(k, np.uint64(sum(1 << b for b in bits)), [np.uint64(0)] if t == 0 else [np.uint64(sum(1 << b for b in c)) for j in range(t + 1) for c in itertools.combinations(bits, j)]) for k, (bits, t) in enumerate(parts) if t >= 0]

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, mask, flips in masks:
                for f in flips:
                    n = len(fp)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(((fp & mask) ^ f).view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(n, f == 0))], ["part", "key", "fp", "own"])

    return run


def _verify(radius: int):
    """Spanning edges of the links within groups of rows (part, key, b1, b2, block, own, fp), sorted by group."""

    def compare(rows: dict[str, np.ndarray], forest: Forest) -> None:
        fp, own, block = rows["fp"], rows["own"], rows["block"]
        if rows["b1"][0] == rows["b2"][0]:
            _join_near(fp[own], fp, radius, forest)
        else:
            first = block == rows["b1"][0]
            _join_near(fp[first & own], fp[~first], radius, forest)
            _join_near(fp[~first & own], fp[first & ~own], radius, forest)

    def run(batches):
        forest, held = Forest(), None
        for b in batches:
            now = {f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(b.schema, b.columns)}
            if held is not None:
                now = {n: np.concatenate([held[n], x]) for n, x in now.items()}
            if not len(now["fp"]):
                continue
            new = np.zeros(len(now["fp"]) - 1, bool)
            for n in ("part", "key", "b1", "b2"):
                new |= now[n][1:] != now[n][:-1]
            cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, z in zip(cuts, cuts[1:]):
                if z - a > 1:
                    compare({n: x[a:z] for n, x in now.items()}, forest)
            held = {n: x[cuts[-1] :] for n, x in now.items()}
        if held is not None and len(held["fp"]) > 1:
            compare(held, forest)
        out = forest.edges()
        for at in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[at : at + 50_000])], ["u", "v"])

    return run


def _join_near(left: np.ndarray, right: np.ndarray, radius: int, forest: Forest) -> None:
    """Joins what links within the radius connect between two lists of fingerprints.

    Links are not listed: a row's hits are joined by their labels, of which a dense group
    soon has one.
    """
    if not len(left) or not len(right):
        return
    if len(left) * len(right) <= 64:
        for a in left.tolist():
            for b in right.tolist():
                if a != b and ((a ^ b) & ((1 << BITS) - 1)).bit_count() <= radius:
                    forest.join(a, b)
        return
    nodes = np.unique(np.concatenate([left, right]))
    x, y = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    label = np.arange(len(nodes))
    for at in range(0, len(left), 256):
        near = np.bitwise_count((left[at : at + 256, None] ^ right[None]).view(np.uint64)) <= radius
        near &= x[at : at + 256, None] != y[None]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            own, others = label[x[at + i]], label[y[near[i]]]
            if (others != own).any():
                met = np.unique(np.append(others, own))
                label[np.isin(label, met)] = met[0]
    for i in np.flatnonzero(label != np.arange(len(nodes))).tolist():
        forest.join(int(nodes[i]), int(nodes[label[i]]))


def links(fps: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect all fingerprints of fps(fp), each once, that are within the radius.

    They span each group that is connected by such links; a third link within a triangle
    may be left out. Keys with more than a block of rows are compared in pairs of blocks,
    each in its own task.
    """
    rows = fps.count()
    share = min(1.0, PLAN_SAMPLE / max(1, rows))
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * PLAN_SAMPLE).collect()
    parts = plan(np.array([r["fp"] for r in sample], np.int64).view(np.uint64), rows, radius)
    probes = fps.select("fp").mapInArrow(_probe(parts), "part int, key bigint, fp bigint, own boolean")
    hot = scratch.keep(probes.groupBy("part", "key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > BLOCK).select("part", "key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    dealt = probes.join(hot, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = ["part", "key", "b1", "b2"]
    dealt = dealt.select("part", "key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "own", "fp")
    dealt = dealt.repartition(shuffle_width(fps.sparkSession), *group).sortWithinPartitions(*group)
    return dealt.mapInArrow(_verify(radius), "u bigint, v bigint")


def _classes(own: DataFrame, least, radius: int, scratch: Scratch) -> DataFrame:
    """(fp, least) with the smallest least of the component, for fingerprints own(fp, ...)."""
    fps = scratch.keep(own.groupBy("fp").agg(F.min(least).alias("least")))
    roots = components(links(fps, scratch, radius), scratch)
    joined = scratch.keep(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    firsts = joined.groupBy("root").agg(F.min("least").alias("first"))
    return scratch.keep(joined.select("root", "fp").join(firsts, "root").select("fp", F.col("first").alias("least")))


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links.

    Texts of equal fingerprints are linked; documents without words have fingerprint 0.
    Null ids stay null and count as no id: a component of nulls only has a null id.
    Repeated rows give equal rows; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    own = scratch.keep(fingerprints(docs, width))
    named = _classes(own, F.col("doc_id"), radius, scratch)
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def first_of_each(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """docs without the near-duplicates of a document that stays: of each component the least (doc_id, hash of the text).

    Nulls sort first among ids; of rows that repeat in full one stays.
    """
    scratch = Scratch(docs.sparkSession)
    key = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    own = scratch.keep(fingerprints(docs.select(key.alias("doc_id"), "text"), width))
    stay = _classes(own, F.col("doc_id"), radius, scratch).select(F.col("least").alias("_key")).distinct()
    stay = scratch.keep(stay.select(F.coalesce(F.col("_key.doc_id").cast("string"), F.lit("")).alias("_id"), F.col("_key.th").alias("_th")))
    numbers, at = numbered(docs)
    marked = numbers.withColumns({"_id": F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit("")), "_th": F.xxhash64(F.coalesce(at["text"], F.lit("")))})
    return marked.join(stay, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select(renamed(at))


# ---- the pipeline's stage: similar shingle sets

#: The stage's shingles have five words; texts that share four fifths of all their shingles are near-duplicates.
SIMILAR_WIDTH, SHARE, OF = 5, 4, 5
#: The stage's fingerprints have four times 64 bits. Candidates that differ in more of them than the radius are not
#: compared: at a similarity of 0.8 they differ in 38.9 bits on average with a deviation of 5.7, so that it is five
#: deviations away. Sets below SHORT are compared anyway.
LIMBS, SIMILAR_RADIUS, SHORT = "abcd", 68, 16
#: Documents that common shingles are counted on, and how many of these at most; both change the cost, never the result.
COMMON_SAMPLE, COMMON, COMMON_LEAST = 4000, 20_000, 8
#: Rounds in which each shared shingle compares its documents with one of them, before all that are still apart are compared:
#: that is at once if there are less than so many pairs for each place of a shared shingle.
STAR_ROUNDS, LITTLE = 6, 20
#: Tokens of a bucket, and sets that are compared with one other in a task, about.
BUCKET, PARTNERS = 500_000, 100
#: A token of so many sets that are still apart is dense; each set of a dense token gets so many homes among them. Those of a
#: home meet in blocks of about so many sets or hashes.
DENSE, HOMES, HOME_BLOCK, HOME_SIZE = 64, 8, 256, 1 << 20
#: Stands after the homes of a set that has fewer.
NO_HOME = (1 << 63) - 1


def shingle_set(text: str, width: int = SIMILAR_WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, width)], np.uint64))


def set_prefix(u: np.ndarray, common: dict[int, int]) -> np.ndarray:
    """The first shingles of a set in an order that is the same for all: two sets as similar as SHARE / OF have one of them in common.

    Common shingles come last, by falling rank: the most frequent has rank 0.
    """
    size = len(u) - (SHARE * len(u) + OF - 1) // OF + 1 if len(u) else 0
    rank = np.array([common.get(x, -1) for x in u.tolist()])
    first = u[rank < 0][:size] if len(u) else u
    if len(first) < size:
        late = np.argsort(-rank, kind="stable")[: int((rank >= 0).sum())]
        first = np.concatenate([first, u[late[: size - len(first)]]])
    return first


def _wide(u: np.ndarray) -> list[int]:
    """The fingerprint of a set of hashes: a limb for each of several hashes derived from them."""
    out = []
    for k in range(len(LIMBS)):
        h = mix(u * np.uint64(2 * k + 1) + np.uint64(k))
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(h), 1 << 14):
            ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0]))
    return out


def _sketch(common: dict[int, int]):
    """Of (_id, _th, text): _id, _th, set (a hash of the shingle set), fp, n and the set's prefix: packed numbers, and apart the common ones."""

    def run(batches):
        held(None, dict)  # another stage's model goes
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [shingle_set(t or "") for t in part.column(2).to_pylist()]
                prefixes = [set_prefix(u, common) for u in sets]
                late = [[x for x in u.tolist() if x in common] for u in prefixes]
                cols = [
                    pa.array(np.array([xxhash.xxh64_intdigest(u.tobytes(), SEED) for u in sets], np.uint64).view(np.int64)),
                    pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in zip(*map(_wide, sets))], list(LIMBS)),
                    pa.array([len(u) for u in sets], pa.int32()),
                    pa.array([u[: len(u) - len(c)].tobytes() for u, c in zip(prefixes, late)], pa.binary()),
                    pa.array([np.array(c, np.uint64).view(np.int64) for c in late], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["_id", "_th", "set", "fp", "n", "prefix", "late"])

    return run


def _distinct(tokens: list[np.ndarray], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of a token and a set, sorted."""
    t, s = np.concatenate(tokens), np.concatenate(sets)
    order = np.lexsort((s, t))
    t, s = t[order], s[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
    return t[new], s[new]


def _dealt(buckets: int, most: int = 1 << 19):
    """Of (set, prefix): the different pairs of a token and a set, packed by bucket of the token, about so many at a time."""

    def run(batches):
        tokens, sets, held = [], [], 0

        def out():
            t, s = _distinct(tokens, sets)
            own = (t % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(own, kind="stable")
            own, t, s = own[order], t[order], s[order]
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            cols = [pa.array(own[cuts[:-1]]), *(pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()) for x in (t, s))]
            return pa.RecordBatch.from_arrays(cols, ["bucket", "tokens", "sets"])

        for b in batches:
            for number, prefix in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if prefix:
                    tokens.append(np.frombuffer(prefix, np.uint64))
                    sets.append(np.full(len(tokens[-1]), number & ((1 << BITS) - 1), np.uint64))
                    held += len(tokens[-1])
                if held >= most:
                    yield out()
                    tokens, sets, held = [], [], 0
        if held:
            yield out()

    return run


def _met(batches):
    """Of (bucket, tokens, sets) sorted by bucket: (token, set) of the tokens that several sets have."""

    def out(tokens, sets):
        t, s = _distinct(tokens, sets)
        same = t[1:] == t[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        t, s = t[many].view(np.int64), s[many].view(np.int64)
        for at in range(0, len(t), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (t, s)], ["token", "set"])

    bucket, tokens, sets = None, [], []
    for b in batches:
        for now, t, s in zip(*(c.to_pylist() for c in b.columns)):
            if now != bucket and tokens:
                yield from out(tokens, sets)
                tokens, sets = [], []
            bucket = now
            tokens.append(np.frombuffer(t, np.uint64))
            sets.append(np.frombuffer(s, np.uint64))
    if tokens:
        yield from out(tokens, sets)


def _hashes(batches):
    """Of (set, text): set and all its shingle hashes."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t or "").view(np.int64) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], ["set", "all"])


def _packed_hashes(batches):
    """Of (set, text): set and the lower four bytes of its shingle hashes, sorted."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            rows = [np.unique((shingle_set(t or "") & np.uint64(0xFFFFFFFF)).astype(np.uint32)).tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["set", "low"])


def _compare(batches):
    """Of (u, block, v, low) sorted so that u's own hashes, with a null v, come first: the pairs (u, v) that are similar."""
    at, own = None, None
    for b in batches:
        rows = []
        for u, block, v, low in zip(*(c.to_pylist() for c in b.columns)):
            other = np.frombuffer(low, np.uint32)
            if v is None:
                at, own = (u, block), other
                continue
            assert at == (u, block)
            union = len(np.union1d(own, other))
            if (len(own) + len(other) - union) * OF >= union * SHARE:
                rows.append((u, v))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["u", "v"])


def _common(texts: DataFrame) -> dict[int, int]:
    """The ranks of the shingles that a bounded sample has most often."""
    rows = texts.count()
    share = min(1.0, COMMON_SAMPLE / max(1, rows))
    sample = texts.where(F.pmod(F.xxhash64("_id", "_th"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(2 * COMMON_SAMPLE)
    counts = sample.select(F.col("_th").alias("set"), "text").mapInArrow(_hashes, "set bigint, all array<bigint>").select(F.explode("all").alias("h")).groupBy("h").count()
    top = counts.where(F.col("count") >= COMMON_LEAST).orderBy(F.desc("count"), "h").limit(COMMON).collect()
    return {r["h"] & ((1 << BITS) - 1): i for i, r in enumerate(top)}


def _may_be_similar(a: str, b: str):
    """Whether two sets' sizes and fingerprints allow the similarity."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    near = sum(F.bit_count(F.col(f"{a}fp")[x].bitwiseXOR(F.col(f"{b}fp")[x])) for x in LIMBS) <= SIMILAR_RADIUS
    return (n * OF >= m * SHARE) & (m * OF >= n * SHARE) & (near | (F.least(n, m) < SHORT))


def _lows(sets: DataFrame, named: DataFrame, texts: DataFrame) -> DataFrame:
    """set and low (see _packed_hashes) of sets(set), for named(set, least), a document of each, and texts(_id, _th, text)."""
    asked = named.join(sets.distinct(), "set", "left_semi").select("set", "least._id", "least._th")
    return asked.join(texts, ["_id", "_th"]).dropDuplicates(["set"]).select("set", "text").mapInArrow(_packed_hashes, "set bigint, low binary")


def _shared_counts(lows: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of several sorted sets of different hashes share."""
    hashes, at, often = np.unique(np.concatenate(lows), return_inverse=True, return_counts=True)
    column = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[at]
    row = np.repeat(np.arange(len(lows)), [len(x) for x in lows])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(lows), len(lows)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, z = np.searchsorted(column, (start, start + 4096))
        x = np.zeros((len(lows), 4096), np.float32)
        x[row[a:z], column[a:z] - start] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def _may_meet(home: int, within: bool, block: np.ndarray, n: np.ndarray, root: np.ndarray, fp: np.ndarray, homes: np.ndarray):
    """The pairs of places of a home that sizes and fingerprints allow to be similar, a stripe at a time; see _meet for those left out."""
    fp, place = fp.view(np.uint64), np.arange(len(n))
    for at in range(0, len(n), 256):
        own = slice(at, at + 256)
        may = root[own, None] != root[None]
        may &= place[own, None] > place[None] if within else block[own, None] < block[None]
        may &= (n[own, None] * OF >= n[None] * SHARE) & (n[None] * OF >= n[own, None] * SHARE)
        apart = sum(np.bitwise_count(fp[own, k, None] ^ fp[None, :, k]).astype(np.int16) for k in range(len(LIMBS)))
        may &= (apart <= SIMILAR_RADIUS) | (np.minimum(n[own, None], n[None]) < SHORT)
        left, right = np.nonzero(may)
        left += at
        new = np.ones(len(left), bool)
        for k in range(homes.shape[1]):
            earlier = homes[left, k]
            new &= (earlier >= home) | (homes[right] != earlier[:, None]).all(axis=1)
        yield left[new], right[new]


def _near(batches):
    """Of (home, b1, b2, block, set, n, root, fp, homes, the last two as a column each) sorted by the first three: (home, set) of the sets that _may_meet one."""

    def out(rows: np.ndarray):
        pairs = _may_meet(int(rows[0, 0]), rows[0, 1] == rows[0, 2], rows[:, 3], rows[:, 5], rows[:, 6], np.ascontiguousarray(rows[:, 7 : 7 + len(LIMBS)]), rows[:, 7 + len(LIMBS) :])
        met = rows[np.unique(np.concatenate([x for both in pairs for x in both])), 4]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(met), rows[0, 0])), pa.array(met)], ["home", "set"])

    kept = []
    for b in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
        if not len(rows):
            continue
        rows = np.concatenate([*kept, rows])
        cuts = [0, *(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1).tolist()]
        for a, z in zip(cuts, cuts[1:]):
            if z - a > 1:
                yield out(rows[a:z])
        kept = [rows[cuts[-1] :]]
    if kept and len(kept[0]) > 1:
        yield out(kept[0])


def _meet(home: int, within: bool, rows: list[tuple], forest: Forest) -> None:
    """Joins what is similar among the rows (block, set, n, root, fp, homes, low) of a home: within a block or between two.

    Left out are pairs that are connected already and those that have an earlier home in common, where they meet.
    """
    block, sets, n, root = (np.array(x, np.int64) for x in list(zip(*rows))[:4])
    fp = np.array([r[4] for r in rows], np.int64)
    homes = np.array([[*r[5], *[NO_HOME] * (HOMES - len(r[5]))] for r in rows], np.int64)
    left, right = (np.concatenate(x) for x in zip(*_may_meet(home, within, block, n, root, fp, homes)))
    if not len(left):
        return
    lows = [np.frombuffer(r[6], np.uint32) for r in rows]
    size = np.array([len(x) for x in lows])
    if len(left) > len(rows):
        both = _shared_counts(lows)[left, right]
    else:
        both = np.array([len(np.intersect1d(lows[i], lows[j], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist())])
    alike = both * OF >= (size[left] + size[right] - both) * SHARE
    for i, j in zip(left[alike].tolist(), right[alike].tolist()):
        forest.join(int(sets[i]), int(sets[j]))


def _meetings(batches):
    """Of (home, b1, b2, block, set, n, root, fp, homes, low) sorted by the first three: edges that span what is similar."""
    forest, at, rows = Forest(), None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for home, b1, b2, *row in zip(*cols):
            if at != (home, b1, b2):
                if len(rows) > 1:
                    _meet(at[0], at[1] == at[2], rows, forest)
                at, rows = (home, b1, b2), []
            rows.append(tuple(row))
    if len(rows) > 1:
        _meet(at[0], at[1] == at[2], rows, forest)
    out = forest.edges()
    for start in range(0, len(out), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[start : start + 50_000])], ["u", "v"])


def _homes(now: DataFrame, dense: DataFrame) -> DataFrame:
    """(set, fp, n, root, homes) of the sets of dense(token, all): different tokens, drawn by hashes, the larger ones sooner.

    The draw is the same for all, so that sets with many tokens in common are likely to have a home in common.
    """
    draw = lambda k: -F.log((F.pmod(F.xxhash64(F.lit(k), "token"), F.lit(1 << 30)) + 1) / float(1 << 30)) / F.col("all")
    first = [F.min_by("token", F.struct(draw(k), F.col("token"))).alias(f"h{k}") for k in range(HOMES)]
    own = now.join(dense.select("token", "all"), "token").groupBy("set").agg(F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("root").alias("root"), *first)
    return own.select("set", "fp", "n", "root", F.array_distinct(F.array(*[f"h{k}" for k in range(HOMES)])).alias("homes"))


def _in_blocks(places: DataFrame, blocks) -> DataFrame:
    """(home, b1, b2, block, set) of places(set, n, root, home): each block of a home beside each other one, and itself.

    blocks: how many a home has, an aggregate. Homes whose sets are all connected are left out.
    """
    groups = places.groupBy("home").agg(blocks.cast("int").alias("blocks"), (F.min("root") != F.max("root")).alias("open")).where("open").select("home", "blocks")
    dealt = places.select("set", "home").join(groups, "home").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("home", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "set")


def _similar_at_home(homes: DataFrame, named: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges that span the similar sets among those with a home in common, of what _homes gives.

    Blocks of a home are compared with each other in as many tasks, so that no pair is ever a row:
    a set has a row for each block of each of its homes. That is done twice: first by sizes and
    fingerprints alone, and then with their hashes for those sets that may be similar to one
    there. Most that share a home have no more in common than a passage, and their hashes stay.
    """
    width, group, rows = shuffle_width(texts.sparkSession), ["home", "b1", "b2"], F.count(F.lit(1))
    places = homes.select("set", "n", "root", F.explode("homes").alias("home"))
    # blocks get larger before they get more than eight
    few = F.least(F.ceil(rows / HOME_BLOCK), F.greatest(F.lit(8), F.ceil(rows / (8 * HOME_BLOCK))))
    flat = homes.select("set", "n", "root", *[F.col("fp")[x].alias(x) for x in LIMBS], *[F.coalesce(F.get("homes", F.lit(k)), F.lit(NO_HOME)).alias(f"h{k}") for k in range(HOMES)])
    dealt = _in_blocks(places, few).join(flat, "set").select(*group, "block", *flat.columns)
    dealt = dealt.repartition(width, *group).sortWithinPartitions(*group)
    near = scratch.keep(dealt.mapInArrow(_near, "home bigint, set bigint").distinct())
    asked = scratch.keep(near.select("set").distinct())
    full = homes.join(asked, "set", "left_semi").select("set", "n", "root", F.array(*[F.col("fp")[x] for x in LIMBS]).alias("fp"), "homes")
    full = scratch.keep(full.join(_lows(asked, named, texts), "set"))
    blocks = F.greatest(F.ceil(rows / HOME_BLOCK), F.ceil(F.sum("n") / HOME_SIZE))
    dealt = _in_blocks(near.join(full.select("set", "n", "root"), "set"), blocks).join(full, "set").select(*group, "block", "set", "n", "root", "fp", "homes", "low")
    found = scratch.keep(dealt.repartition(width, *group).sortWithinPartitions(*group).mapInArrow(_meetings, "u bigint, v bigint"))
    for t in (near, asked, full):
        scratch.drop(t)
    return found


def _similar(pairs: DataFrame, named: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of pairs(u, v) whose shingle sets are as similar as SHARE / OF, compared shingle by shingle.

    A set of many pairs is compared in blocks of about PARTNERS, each with its own copy of it.
    named(set, least): a document of each set; texts(_id, _th, text).
    """
    asked = pairs.select(F.col("u").alias("set")).unionByName(pairs.select(F.col("v").alias("set")))
    sets = scratch.keep(_lows(asked, named, texts))
    blocks = scratch.keep(pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("blocks")))
    first = blocks.join(sets, F.col("u") == F.col("set")).select("u", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("bigint").alias("v"), "low")
    others = pairs.join(blocks, "u").select("u", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), "v")
    others = others.join(sets.withColumnRenamed("set", "v"), "v").select("u", "block", "v", "low")
    dealt = first.unionByName(others).repartition(shuffle_width(texts.sparkSession), "u", "block").sortWithinPartitions("u", "block", F.col("v").asc_nulls_first())
    return dealt.mapInArrow(_compare, "u bigint, v bigint")


def _rooted(named: DataFrame, roots: DataFrame) -> DataFrame:
    """named with the root of each set, which is itself where roots(node, root) has none."""
    return named.select("set", "least").join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))


def _near_by_bits(named: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of sets, of named(set, fp): the edges that the pigeonhole search of the first limbs gives, and the sets of equal limbs.

    At most about as many as sets, as edges only span what is connected.
    """
    firsts = scratch.keep(named.groupBy(F.col("fp")["a"].alias("bits")).agg(F.min("set").alias("first")))
    same = named.select("set", F.col("fp")["a"].alias("bits")).join(firsts, "bits").select(F.col("first").alias("u"), F.col("set").alias("v"))
    first = lambda x: firsts.select(F.col("bits").alias(x), F.col("first").alias(f"{x}_set"))
    near = links(firsts.select(F.col("bits").alias("fp")), scratch).distinct()
    near = near.join(first("u"), "u").join(first("v"), "v").select(F.col("u_set").alias("u"), F.col("v_set").alias("v"))
    return same.unionByName(near).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar_sets(shared: DataFrame, named: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the sets that similar pairs connect, of shared(token, set, fp, n): each set's prefix.

    named and texts are those of _similar.

    The pigeonhole search of the fingerprints comes first: what it finds is compared in full, and what
    is similar is connected. Its radius does not reach all that are similar, which the shared tokens do.
    A dense group would have a pair for each two members. So each token first compares its sets
    with one of them, chosen anew each round, and sets that are connected already are not compared
    again. Then the sets of dense tokens meet at their homes, within tasks. Then all pairs of a token
    that are still apart and have no home in common are compared: each has one set outside the
    token's largest component.
    """
    edges = roots = before = homes = last_now = None
    common = scratch.keep(shared.groupBy("set").agg((F.count(F.lit(1)) / F.max("n")).alias("common")))

    def grouped():
        """shared with roots, and the tokens whose sets are apart."""
        nonlocal last_now
        if roots is None:
            now = shared.withColumn("root", F.col("set"))
        else:
            if last_now is not None:
                scratch.drop(last_now)
            now = last_now = scratch.keep(shared.join(scratch.keep(_rooted(named, roots).select("set", "root")), "set"))
        cells = now.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
        tokens = cells.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("big"), F.sum("c").alias("all"), F.max("c").alias("most"))
        return now, scratch.keep(tokens.where("all > most"))

    def connect(found):
        nonlocal edges, roots
        edges = found if edges is None else edges.unionByName(found)
        roots = scratch.keep(components(edges, scratch))

    if not (near := scratch.keep(_near_by_bits(named, scratch))).isEmpty():
        connect(scratch.keep(_similar(near, named, texts, scratch)))
    for k in range(STAR_ROUNDS + 1):
        now, tokens = grouped()
        work = tokens.agg(F.sum(F.col("all") * (F.col("all") - F.col("most"))), F.sum("all")).first()
        if not work[0]:
            break
        last = k == STAR_ROUNDS or work[0] <= LITTLE * work[1] or (before is not None and work[0] > 0.8 * before)
        before = work[0]
        if last and not (dense := tokens.where(F.col("all") >= DENSE)).isEmpty():
            homes = scratch.keep(_homes(now, dense))
            connect(_similar_at_home(homes, named, texts, scratch))
            now, tokens = grouped()
        now = now.withColumn("homes", F.lit(None).cast("array<bigint>")) if homes is None else now.join(homes.select("set", "homes"), "set", "left")
        apart = now.join(tokens.select("token", "big"), "token")
        side = lambda x: [F.col("set").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("fp", "n", "root", "homes")]]
        if last:
            left = apart.where("root != big").select("token", *side("u"))
        else:
            middle = F.max_by(F.struct("set", "fp", "n", "root", "homes"), F.struct("common", F.xxhash64(F.lit(k), "set")) if k % 2 == 0 else F.struct(F.xxhash64(F.lit(k), "set"))).alias("m")
            left = apart.join(common, "set").groupBy("token").agg(middle).select("token", "m.*").select("token", *side("u"))
        new = (F.col("u_root") != F.col("v_root")) & ~F.coalesce(F.arrays_overlap("u_homes", "v_homes"), F.lit(False))
        pairs = left.join(apart.select("token", *side("v")), "token").where(new & _may_be_similar("u_", "v_"))
        pairs = scratch.keep(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        connect(scratch.keep(_similar(pairs, named, texts, scratch)))
        if last:
            break
    return shared.select(F.col("set").alias("node"), F.col("set").alias("root")).limit(0) if roots is None else roots


def first_of_similar(docs: DataFrame) -> DataFrame:
    """docs without those that are similar to one that stays, directly or through others: of each component the least (doc_id, hash of the text).

    Two texts are similar if they share four fifths of their distinct shingles of five words (a
    shingle is known by its 64-bit hash, of which 32 bits are compared in the end, so that sets of
    n shingles seem to share n * n / 2^32 more); a text of fewer words is one shingle, and all without
    words are alike. The pigeonhole search of fingerprints finds the nearest of them, and the sets'
    first shingles the rest. Sets that similar share one of their first shingles in any order; those that
    do are candidates, the radius thins them out, and the rest are compared in full. A null text
    counts as empty and a null id sorts first; of rows that repeat an id and a text one stays. Other
    columns stay as they are whatever their names; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    numbers, at = numbered(docs)
    marked = numbers.withColumns({"_id": F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit("")), "_th": F.xxhash64(F.coalesce(at["text"], F.lit("")))})
    texts = marked.select("_id", "_th", F.col(at["text"]).alias("text"))
    fields = f"_id string, _th bigint, set bigint, fp struct<{','.join(f'{x}:bigint' for x in LIMBS)}>, n int, prefix binary, late array<bigint>"
    own = scratch.keep(texts.mapInArrow(_sketch(_common(texts)), fields))
    least = F.min(F.struct(F.col("_id").try_cast("bigint").alias("id"), "_th", "_id"))
    named = scratch.keep(own.groupBy("set").agg(least.alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n")))
    width = shuffle_width(docs.sparkSession)
    size = own.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    buckets = max(4 * width, int(size // BUCKET))  # several for each task, so that tasks are even
    places = own.select("set", "prefix").mapInArrow(_dealt(buckets), "bucket int, tokens binary, sets binary")
    places = places.repartition(max(width, buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(_met, "token bigint, set bigint")
    late = own.select(F.explode("late").alias("token"), "set").distinct()
    shared = scratch.keep(places.unionByName(late).join(named.select("set", "fp", "n"), "set"))
    scratch.drop(own)
    roots = similar_sets(shared, named, texts, scratch)
    stay = scratch.keep(_rooted(named, roots).groupBy("root").agg(F.min("least").alias("least")).select("least._id", "least._th"))
    return marked.join(stay, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select(renamed(at))
