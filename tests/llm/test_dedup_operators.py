"""Repeated passages, near-duplicates and embeddings, held against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from chronoframe.llm import anchors, column_bwt, pca_join, simhash, suffix_trees
from tests.llm.helpers import EDGES, clashing, components, documents, words


def corpus(seed, n=60):
    """Texts that share passages, whole copies and near copies, with some words very frequent."""
    r = random.Random(seed)
    shared = [words(100 + i, r.randrange(5, 60), 400) for i in range(6)]
    rows = []
    for i in range(n):
        w = words(seed * 1000 + i, r.randrange(0, 80), 400)
        for _ in range(r.randrange(3)):
            at = r.randrange(len(w) + 1)
            w[at:at] = shared[min(r.randrange(6), r.randrange(6))]
        rows.append((i, " ".join(w)))
    rows += [(n + i, rows[i * 3][1]) for i in range(6)]
    rows += [(n + 10 + i, rows[i * 5][1].replace("w1", "é1", 1)) for i in range(6)]
    return rows


def brute_bytes(rows, window):
    seen = Counter(t.encode()[i : i + window] for _, t in rows for i in range(len(t.encode()) - window + 1))
    out = []
    for d, t in rows:
        b = t.encode()
        cover = [False] * len(b)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                cover[i : i + window] = [True] * window
        spans = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        out.append((d, len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return Counter(out)


def brute_words(rows, window):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = t.encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = []
    for d, t in rows:
        w = t.encode().split()
        cover = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                cover[i : i + window] = [True] * window
        out.append((d, len(w), sum(cover), hashlib.sha256(b" ".join(x for x, c in zip(w, cover) if not c)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [200, 3])
def test_column_wise_arrays_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT", hot)  # 3: groups are split down to single windows
    rows = corpus(1)
    got = column_bwt.digests(spark.createDataFrame(rows, "doc_id bigint, text string"), 40)
    assert Counter(tuple(r) for r in got.collect()) == brute_bytes(rows, 40)


@pytest.mark.parametrize("hot", [200, 3])
def test_removal_keeps_the_first_copy(spark, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT", hot)
    rows = [(d, t.replace("é", "e")) for d, t in corpus(4)]
    first: dict = {}
    for d, t in rows:
        for i in range(len(t) - 39):
            first.setdefault(t[i : i + 40], (d, i))
    want = {}
    for d, t in rows:
        gone = {j for i in range(len(t) - 39) if first[t[i : i + 40]] < (d, i) for j in range(i, i + 40)}
        want[d] = "".join(c for i, c in enumerate(t) if i not in gone)
    got = column_bwt.remove(spark.createDataFrame(rows, "doc_id bigint, text string"), 40).collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and any(want[d] != t for d, t in rows)


@pytest.mark.parametrize("hot", [200, 3])
def test_suffix_trees_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT", hot)
    rows = corpus(2)
    got = suffix_trees.digests(spark.createDataFrame(rows, "doc_id bigint, text string"), 8)
    assert Counter(tuple(r) for r in got.collect()) == brute_words(rows, 8)


def test_prefix_parts_and_tree_nodes():
    text = np.array([1, 2, 1, 2, 1, 3], np.uint32)
    suffixes = np.full((6, 6), 0xFFFFFFFF, np.uint32) - np.arange(36, dtype=np.uint32).reshape(6, 6)
    for i in range(6):
        suffixes[i, : 6 - i] = text[i:]
    tree = suffix_trees.Tree(suffixes, np.arange(6))
    assert tree.order.tolist() == [0, 2, 4, 1, 3, 5] and tree.lcp.tolist() == [0, 3, 1, 0, 2, 0]
    assert sorted(tree.nodes()) == [(1, 0, 3), (2, 3, 5), (3, 0, 2)]
    assert list(tree.deep(2)) == [(0, 2), (3, 5)]
    assert sorted(len(p) for p in suffix_trees.parts(suffixes, np.arange(6))) == [6]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = anchors.Bytes(bytes(random.Random(5).randrange(4) for _ in range(5000)))
    whole = [p for place, _ in anchors.anchors(text, 40, 20) for p in place.tolist()]
    monkeypatch.setattr(anchors, "CHUNK", 64)
    assert [p for place, _ in anchors.anchors(text, 40, 20) for p in place.tolist()] == whole
    assert len(set(whole)) == len(whole) and max(np.diff(whole)) <= 20


def test_passage_edges(spark):
    got = {r["doc_id"]: tuple(r)[1:4] for r in column_bwt.digests(clashing(spark, "n_bytes", "th", "runs")).collect()}
    assert len(got) == len({r[0] for r in EDGES}) and got[1] == (0, 0, 0) and got[7][1] == got[7][0] == 100000
    got = {r["doc_id"]: tuple(r)[1:3] for r in suffix_trees.digests(clashing(spark, "n_words")).collect()}
    assert got[7] == (20000, 19999) or got[7][1] >= 19980
    for f in (column_bwt.digests, suffix_trees.digests):
        assert f(documents(spark, []).limit(0)).count() == 0
        assert f(clashing(spark, "s")).count() == len(EDGES)


def test_repeated_rows_are_documents_each(spark):
    text = " ".join(words(9, 200, 5000))
    df = spark.createDataFrame([(1, text), (1, text), (2, "x")], "doc_id bigint, text string")
    assert [r["n_removed"] for r in column_bwt.digests(df).where("doc_id = 1").collect()] == [len(text)] * 2
    assert [r["n_removed"] for r in suffix_trees.digests(df).where("doc_id = 1").collect()] == [0, 0]


# ---- SimHash


def brute_fingerprint(text, width=3):
    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for text in [r[1] or "" for r in EDGES] + [t for _, t in corpus(3)]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("block", [1000, 8])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, block):
    from chronoframe.llm.common import Scratch
    from chronoframe.llm.components import components as connected

    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(7)
    values = {r.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        for _ in range(12):
            v ^= sum(1 << b for b in r.sample(range(64), r.randrange(1, 5)))
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(values)]
    edges = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]
    scratch = Scratch(spark)
    roots = {x["node"]: x["root"] for x in connected(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), scratch), scratch).collect()}
    assert {v: roots.get(v, v) for v in signed} == components(signed, edges)


def test_thresholds_are_the_cheapest_of_their_sum():
    costs = [[0, 5, 9, 30], [0, 1, 2, 3], [0, 10, 20, 25]]
    import itertools

    best = min((sum(c[t + 1] for c, t in zip(costs, ts)), ts) for ts in itertools.product(range(-1, 3), repeat=3) if sum(ts) == 1)
    assert simhash.allocate(costs, 1)[0] == best[0] and sum(simhash.allocate(costs, 1)[1]) == 1


def test_near_duplicate_edges(spark):
    rows = simhash.near_duplicates(clashing(spark, "fp", "component_id")).collect()
    by = Counter((r["doc_id"], r["component_id"]) for r in rows)
    assert len(rows) == len(EDGES) and by[2, 1] == by[5, 1] == by[1, 1] == 1 and by[4, 4] == 2
    assert simhash.near_duplicates(documents(spark, []).limit(0)).count() == 0
    kept = simhash.first_of_each(clashing(spark, "fp")).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([1, None, 4, 6, 7, 8])


def test_similar_texts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COMMON_SAMPLE", 100)
    r, rows = random.Random(5), []
    for _ in range(30):
        base = words(r.random(), r.randrange(40, 200), 5000)
        for changed in (0, 1, 1, 2, 3, 4, 6):
            now = list(base)
            for at in r.sample(range(len(now)), min(changed, len(now) // 25)):
                now[at] = f"x{r.randrange(10**6)}"
            rows.append(now)
    dense = words(9, 150, 5000)
    rows += [[*dense[:i], f"y{i}", *dense[i + 1 :]] for i in range(0, 140, 2)]
    rows += [["same", "line"] * 6 + words(i, 12, 5000) for i in range(40)]
    sets = [{" ".join(x[i : i + 5]) for i in range(len(x) - 4)} for x in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b) - 1e-9
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    assert sum(len(sets[i] & sets[j]) < 0.95 * len(sets[i] | sets[j]) for i, j in edges) > 100
    docs = documents(spark, [(i, " ".join(x), "en", "s", 1) for i, x in enumerate(rows)])
    want = {i for i, root in components(range(len(rows)), edges).items() if i == root}
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
    monkeypatch.setattr(simhash, "STAR_ROUNDS", 0)
    for dense, block in ((10**6, 256), (2, 256), (2, 16), (20, 8)):
        monkeypatch.setattr(simhash, "DENSE", dense)
        monkeypatch.setattr(simhash, "HOME_BLOCK", block)
        assert {x["doc_id"] for x in simhash.first_of_similar(docs).collect()} == want


def test_shared_counts_and_meetings():
    r = np.random.default_rng(4)
    lows = [np.unique(r.integers(0, 9000, r.integers(1, 8000), dtype=np.uint32)) for _ in range(12)]
    got = simhash._shared_counts(lows)
    assert all(got[i, j] == len(np.intersect1d(lows[i], lows[j])) for i in range(12) for j in range(i))
    row = lambda block, k, root, homes, low: (block, k, len(low), root, [0] * 4, homes, low.tobytes())
    rows = [row(0, 1, 1, [5], lows[0]), row(1, 2, 2, [5], lows[0]), row(1, 3, 3, [4, 5], lows[0]), row(0, 4, 4, [4, 5], lows[0]), row(0, 6, 1, [5], lows[1])]
    for within, want in ((True, {1: 1, 2: 1, 3: 1, 4: 1, 6: 6}), (False, {1: 1, 2: 1, 3: 1, 4: 1, 6: 6})):
        forest = simhash.Forest()
        simhash._meet(5, within, rows, forest)
        assert {k: forest.find(k) for k in want} == want
    forest = simhash.Forest()
    simhash._meet(5, False, rows[2:4], forest)
    assert not forest.edges()  # they meet at home 4


def test_hashes_are_dealt_only_of_sets_that_may_be_similar(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COMMON_LEAST", 10**6)
    monkeypatch.setattr(simhash, "STAR_ROUNDS", 0)
    asked, lows = [], simhash._lows
    monkeypatch.setattr(simhash, "_lows", lambda sets, *more: asked.append(sets.distinct().count()) or lows(sets, *more))
    line = words(1, 30, 5000)
    rows = [line + words(100 + i, 60, 5000) for i in range(80)]
    rows += [[*rows[0][:-1], f"z{i}"] for i in range(3)]
    docs = documents(spark, [(i, " ".join(x), "en", "s", 1) for i, x in enumerate(rows)])
    assert {x["doc_id"] for x in simhash.first_of_similar(docs).collect()} == set(range(80))
    assert asked and max(asked) < 12  # 83 when all that share the line were dealt with their hashes


def test_pigeonhole_search_comes_before_shared_shingles(spark, monkeypatch):
    found, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *x: found.append(links(*x)) or found[-1])
    base = words(1, 400, 5000)
    rows = [base, [*base[:-1], "z"], *(words(i, 400, 5000) for i in (2, 3))]
    docs = documents(spark, [(i, " ".join(x), "en", "s", 1) for i, x in enumerate(rows)])
    assert {x["doc_id"] for x in simhash.first_of_similar(docs).collect()} == {0, 2, 3}
    limbs = [simhash._wide(simhash.shingle_set(" ".join(x)))[0] for x in rows]
    assert [{r["u"], r["v"]} for r in found[0].distinct().collect()] == [{limbs[0], limbs[1]}]


def test_similar_edges(spark):
    kept = simhash.first_of_similar(clashing(spark, "fp", "prefix")).collect()
    assert sorted(str(x["doc_id"]) for x in kept) == ["1", "4", "6", "7", "8", "None"]
    assert simhash.first_of_similar(documents(spark, []).limit(0)).count() == 0


def test_component_of_a_chain(spark):
    from chronoframe.llm.common import Scratch
    from chronoframe.llm.components import components as connected

    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 300)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(chain, "u bigint, v bigint"), Scratch(spark)).collect()}
    assert {got[i] for i in range(61)} == {0} and got[300] == 200 and 100 not in got


# ---- embeddings


@pytest.mark.parametrize("block", [1000, 16])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pca_join, "BLOCK", block)
    r = np.random.default_rng(3)
    base = r.normal(size=(12, 16))
    rows = []
    for i in range(160):
        v = base[i % 12] + r.normal(size=16) * 0.12 * (i % 5)
        rows.append((i, [float(np.float32(x)) for x in v * (1 + i % 3)], i % 2))
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(10)]
    bad = [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] + [1.0] * 15, 0), (304, [float("inf")] + [1.0] * 15, 0), (305, [], 0), (306, rows[0][1], None), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 as n_links", "2 as x")
    good = {i: (np.array(v), l) for i, v, l in rows}
    edges = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and good[a][0] @ good[b][0] / np.sqrt((good[a][0] @ good[a][0]) * (good[b][0] @ good[b][0])) >= 0.98]
    edges.append((307, 308))
    ids = [x[0] for x in rows + bad]
    roots, degree = components(ids, edges), Counter(x for e in edges for x in e)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pca_join.near_duplicates(df).collect()}
    assert len(edges) > 50 and got == {i: (degree[i], roots[i], roots[i] == i) for i in ids}
    assert pca_join.near_duplicates(df.limit(0)).count() == 0
