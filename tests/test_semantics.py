"""Named scenarios, and as-of reads held against a model that loops over versions."""

import random

import pytest
from pyspark.sql import functions as F

from chronoframe.operators import catalog as C
from chronoframe.operators import maintenance as M
from chronoframe.operators import planner as P
from chronoframe.operators import telemetry as R
from chronoframe.operators import transactions as X
from chronoframe.operators import visibility as V

VERSIONS = "k string, ts bigint, kind int, value bigint, txn_id bigint"


def model(rows, target):
    """Newest version not after the target of each key, by looping as a reader would."""
    out = {}
    for key in {r[0] for r in rows}:
        at = target
        while True:
            older = [r for r in rows if r[0] == key and r[1] <= at]
            if not older:
                break
            ts = max(r[1] for r in older)
            best = min((r for r in older if r[1] == ts), key=lambda r: r[2])
            if best[2] != 2:
                out[key] = best
                break
            at = ts - 1
    return out


@pytest.mark.parametrize("seed", [501, 502, 503])
def test_as_of_equals_model(spark, seed):
    r = random.Random(seed)
    rows = list({(f"{r.randrange(8):02d}", r.randrange(40), r.randrange(4)): None for _ in range(300)})
    rows = [(k, ts, kind, None if kind in (0, 2) else ts * 10 + kind, None) for k, ts, kind in rows]
    df = spark.createDataFrame(rows, VERSIONS)
    for target in (0, 7, 20, 39, 100):
        got = {x["k"]: tuple(x) for x in V.select_as_of(df, target).collect()}
        assert got == model(rows, target)


def test_scan_fails_on_a_visible_intent(spark):
    df = spark.createDataFrame([("a", 1, 1, 5, None), ("a", 2, 3, 6, 9)], VERSIONS)
    with pytest.raises(V.IntentFound):
        V.scan(df, 2)
    assert V.scan(df, 1).collect()[0]["value"] == 5


def test_bounds(spark):
    df = spark.createDataFrame([("a", 1, 1, 1, None), ("b", 1, 1, 2, None)], VERSIONS)
    assert V.span(df, "a", "a").count() == 0
    assert V.span(df, "a", "b").count() == 1
    with pytest.raises(ValueError):
        V.span(df, "b", "a")
    with pytest.raises(ValueError):
        V.Snapshot(df, 9, 1)
    assert V.select_as_of(df.limit(0), 5).count() == 0


def test_committed_unresolved_intent_is_visible_and_aborted_is_not(spark):
    rows = [("a", 1, 1, 1, None), ("a", 5, 3, 2, 10), ("b", 1, 1, 1, None), ("b", 5, 3, 2, 11), ("c", 1, 1, 1, None), ("c", 5, 3, 2, 12)]
    txns = spark.createDataFrame([(10, 2, 5), (11, 3, 5), (12, 1, 5)], "txn_id bigint, status int, commit_ts bigint")
    got = {r["k"]: (r["value"], r["conflict"]) for r in X.interpret(spark.createDataFrame(rows, VERSIONS), txns, 9).collect()}
    assert got == {"a": (2, False), "b": (1, False), "c": (None, True)}


def test_overlay(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, value bigint")
    own = spark.createDataFrame([("a", None, True), ("c", 3, False)], "k string, value bigint, is_delete boolean")
    assert {tuple(r) for r in X.overlay(base, own).collect()} == {("b", 2), ("c", 3)}


def test_write_skew_commits_and_write_write_conflict_aborts(spark):
    rows = [(1, 0, 5, "a", "g"), (2, 0, 6, "b", "g"), (3, 0, 7, "a", "g")]
    got = X.first_committer_wins(spark.createDataFrame(rows, "txn_id bigint, read_ts bigint, commit_ts bigint, k string, g string"))
    assert {r["txn_id"]: r["committed"] for r in got.collect()} == {1: True, 2: True, 3: False}


def test_routes_and_split(spark):
    cat = spark.createDataFrame([(1, 1, None, "g"), (2, 1, "g", "p"), (3, 1, "p", None)], "range_id bigint, generation bigint, start_key string, end_key string")
    keys = spark.createDataFrame([("",), ("a",), ("g",), ("o",), ("p",), ("z",)], "k string")
    assert [r["range_id"] for r in C.route(keys, cat).orderBy("k").collect()] == [1, 1, 2, 2, 3, 3]
    assert C.tiling_faults(cat).count() == 0
    assert C.tiling_faults(C.split(cat, 2, "k")).count() == 0
    with pytest.raises(ValueError):
        C.split(cat, 2, "g")


def test_rates_after_resets(spark):
    rows = [(1, i * 1_000_000, x) for i, x in enumerate([100, 200, 500, 1], 1)]
    got = R.rates(spark.createDataFrame(rows, "id bigint, at_us bigint, reads bigint"), ["id"], ["reads"]).orderBy("at_us").collect()
    assert [(r["reads_rate"], r["samples"]) for r in got] == [(0, 0), (100, 1), (300, 2), (0, 0)]


def test_policy_and_balance(spark):
    assert P.Policy().faults() == []
    cols = "node_id bigint, logical_bytes bigint, write_rate bigint, read_rate bigint, leaders bigint, apply_backlog bigint, hosted_replicas bigint"
    none = spark.createDataFrame([], "node_id bigint")
    for share, expected in ((51, False), (80, True)):
        nodes = spark.createDataFrame([(1, *[share] * 6), (2, *[100 - share] * 6)], cols)
        assert P.overloaded(P.score(nodes, P.Policy()), none, P.Policy()).first()["overloaded"] is expected


def test_median_key_needs_two(spark):
    cat = spark.createDataFrame([(1, 1, None, None)], "range_id bigint, generation bigint, start_key string, end_key string")
    keys = lambda *k: spark.createDataFrame([(1, x) for x in k], "range_id bigint, k string")
    assert P.median_keys(keys("z", "a", "m"), cat).first()["split_key"] == "m"
    assert P.median_keys(keys("same", "same"), cat).count() == 0


def test_compaction_keeps_versions_and_refuses_repeats(spark):
    rows = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 0, None), ("b", 1, 1, 2)], "k string, ts bigint, kind int, value bigint")
    out = M.compact(rows, 20)
    assert out.count() == 3 and out.groupBy("k").agg(F.countDistinct("output").alias("n")).where("n > 1").count() == 0
    with pytest.raises(M.Conflict):
        M.compact(rows.unionByName(rows), 20)


def test_frontier(spark):
    seq = lambda *x: spark.createDataFrame([(i,) for i in x], "seq bigint")
    assert M.frontier(seq(1, 2, 3, 5)).first()[0] == 3
    assert M.frontier(seq(2, 3)).first()[0] == 0


def test_bloom_grows_with_the_keys(spark):
    probes = spark.range(0, 400).selectExpr("concat(if(id < 200, 'a', 'k'), id) as k")
    for n in (1000, 300_000):
        keys = spark.range(n).selectExpr("concat('k', id) as k")
        got = {r["k"]: r["may_contain"] for r in M.bloom_keys(keys, probes).collect()}
        assert all(got[f"k{i}"] for i in range(200, 400)) and sum(got[f"a{i}"] for i in range(200)) <= 12
    assert not any(r["may_contain"] for r in M.bloom_keys(keys.limit(0), probes).collect())


def first_committer_model(rows):
    """Transactions one after another by commit time, then id."""
    newest, out = {}, {}
    for commit, txn, read, keys in sorted((c, t, r, k) for t, (r, c, k) in rows.items()):
        out[txn] = all(newest.get(k, -1) <= read for k in keys)
        if out[txn]:
            newest.update(dict.fromkeys(keys, commit))
    return out


@pytest.mark.parametrize("seed", [601, 602])
def test_first_committer_wins_equals_model(spark, seed):
    r = random.Random(seed)
    rows = {t: ((at := r.randrange(200)), at + r.randrange(1, 12), r.sample(range(9), r.randrange(1, 4))) for t in range(120)}
    df = spark.createDataFrame([(t, a, b, f"{k}") for t, (a, b, keys) in rows.items() for k in keys], "txn_id bigint, read_ts bigint, commit_ts bigint, k string")
    want = first_committer_model(rows)
    assert {x["txn_id"]: x["committed"] for x in X.first_committer_wins(df).collect()} == want and 10 < sum(want.values()) < 110
    assert X.first_committer_wins(df.limit(0)).count() == 0


def test_a_chain_of_conflicts_that_crosses_all_stretches(spark):
    rows = {t: (t * 10, t * 10 + 15, ["x", f"{t % 7}"]) for t in range(400)}  # each overlaps the one before on x
    df = spark.createDataFrame([(t, a, b, k) for t, (a, b, keys) in rows.items() for k in keys] * 2, "txn_id bigint, read_ts bigint, commit_ts bigint, k string")
    got = X.first_committer_wins(df).collect()
    assert {x["txn_id"]: x["committed"] for x in got} == first_committer_model(rows) == {t: t % 2 == 0 for t in rows}
    assert len(got) == len(rows)


def test_rounds_of_a_chain_are_few_however_many_partitions(spark, monkeypatch):
    rows = {t: (t * 10, t * 10 + 15, ["x", f"{t % 7}"]) for t in range(400)}
    df = spark.createDataFrame([(t, a, b, k) for t, (a, b, keys) in rows.items() for k in keys], "txn_id bigint, read_ts bigint, commit_ts bigint, k string")
    tables, keep = [], X.keep
    monkeypatch.setattr(X, "keep", lambda *a: tables.append(1) or keep(*a))
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {x["txn_id"]: x["committed"] for x in X.first_committer_wins(df).collect()}
        none = X.first_committer_wins(df.withColumn("commit_ts", F.col("read_ts"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == first_committer_model(rows) and all(x["committed"] for x in none)
    assert len(tables) <= 4 + 4  # stretches: 33, 9, 3 and 1; 40, 10, 3 and 1


def test_recovery_refuses_more_records_than_its_bound(spark):
    txns = spark.createDataFrame([(i, i % 3 + 1, 1) for i in range(9)], "txn_id bigint, status int, epoch bigint")
    assert {(x["txn_id"], x["status"], x["epoch"]) for x in X.recover(txns, 9).collect()} == {(i, 3 if i % 3 == 0 else i % 3 + 1, 1 + (i % 3 == 0)) for i in range(9)}
    with pytest.raises(X.TooLarge):
        X.recover(txns, 8)


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x.split("hashpartitioning(")[1].split("#")[0] for x in plan.splitlines() if "Exchange hashpartitioning(" in x]


def test_route_pins_are_dealt_by_transaction_alone(spark):
    from chronoframe.plans import registry

    assert set(shuffles(registry.queries()["t16_route_pins"](spark, "/root/testdata/sf0.001"))) == {"txn_id"}
    cat = spark.createDataFrame([(1, 1), (2, 3)], "range_id bigint, generation bigint")
    routes = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "range_id bigint, generation bigint")
    assert not shuffles(C.stale(routes, cat)) and sorted(map(tuple, C.stale(routes, cat).collect())) == [(2, 2), (3, 1)]


def test_resolution_deals_writes_by_key_and_by_transaction_alone(spark):
    from chronoframe.plans import registry

    by = shuffles(registry.queries()["t10_resolution"](spark, "/root/testdata/sf0.001"))
    assert by.count("txn_id") == 1 and len(by) <= 4  # writes by key and transaction, versions by key and time and by key


def test_checksums_and_key_hashes(spark):
    from chronoframe.functions import scalars as S

    known = [(b"123456789", 0xE3069283), (b"", 0), (bytes(32), 0x8A9136AA), (None, None)]  # published values
    df = spark.createDataFrame([(k,) for k, _ in known], "k binary").select("k", S.crc32c(F.col("k")).alias("c"))
    assert [x["c"] for x in df.collect()] == [c for _, c in known]
    keys = [b"", b"a", b"foobar", b"000123"]
    want = []
    for k in keys:
        v = 14695981039346656037 ^ 0x9E3779B97F4A7C15
        for b in k:
            v = (v ^ b) * 1099511628211 % 2**64
        m = (v + 0x9E3779B97F4A7C15) % 2**64
        m = (m ^ m >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        m = (m ^ m >> 27) * 0x94D049BB133111EB % 2**64
        want.append((v, (m ^ m >> 31) | 1))
    assert list(zip(*(x.tolist() for x in S.key_hashes(keys)))) == want


def test_bloom_holds_every_key_and_few_others(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    got = M.bloom_keys(keys, spark.range(12000).select(F.col("id").cast("string").alias("k"))).collect()
    assert all(x["may_contain"] for x in got if int(x["k"]) < 2000)
    assert 0 < sum(x["may_contain"] for x in got if int(x["k"]) >= 2000) < 0.02 * 10000


def test_digest_of_more_levels_is_told_apart(spark, monkeypatch):
    from chronoframe.operators import audit as A

    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), "id")
    said = lambda d: [tuple(x) for x in A.digest(d, ["k"], [F.col("k"), F.col("id")]).collect()]
    monkeypatch.setattr(A, "LEAF", 1)  # two levels
    assert said(df) == said(df.repartition(7)) and said(df)[0][0] == 3000
    assert said(df) != said(df.withColumn("id", F.when(F.col("id") == 5, 6).otherwise(F.col("id"))))


def test_digest_counts_lines_with_a_null_and_leaves_them_out(spark):
    from hashlib import md5, sha256

    from chronoframe.operators import audit as A

    said = lambda rows: tuple(A.digest(spark.createDataFrame(rows, "k string, x bigint"), ["k", "x"], [F.col("k"), F.col("x")]).first())
    leaf = md5(b"a").hexdigest()[:2] + sha256(b"1=a:1=1|1=a:1=2").hexdigest()
    assert said([("a", 2), ("a", None), (None, 3), ("a", 1), ("b", None)]) == (5, sha256(leaf.encode()).hexdigest())
    assert said([]) == (None, None)


def test_ranks_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("y"))
    got = V.ranked(df, [F.col("x"), F.desc("y")]).collect()
    assert sorted((r["x"], r["rank"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_selection_of_several_actions(spark):
    rows = [(1, 5, 7, 9, 1), (2, 7, 8, 8, 2), (1, 1, 2, 7, 3), (3, 1, 2, 6, 4), (4, 0, 0, 5, 5), (5, 0, 9, 0, 6), (6, 3, 4, 3, 7)]
    df = spark.createDataFrame(rows, "range_id bigint, source bigint, target bigint, improvement bigint, place bigint")
    pick = lambda n: [x["place"] for x in P.select_actions(df, P.Policy(max_actions=n)).orderBy("place").collect()]
    assert pick(1) == [1] and pick(3) == [1, 4, 5] and pick(9) == [1, 4, 5, 7]
