"""Queries of the range catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.operators import catalog as C
from chronoframe.plans.reads import T
from chronoframe.plans.registry import query

_IN = "(start_key IS NULL OR k >= start_key) AND (end_key IS NULL OR k < end_key)"
_SPLITS = ", splits AS (SELECT parent_id, min(child_id) AS left_id, max(child_id) AS right_id, CASE parent_id % 4 WHEN 0 THEN 'committed' WHEN 1 THEN 'copying' WHEN 2 THEN 'aborted' ELSE 'prepared' END AS state FROM lineage GROUP BY parent_id)"


def _splits(f):
    p = F.col("parent_id") % 4
    state = F.when(p == 0, "committed").when(p == 1, "copying").when(p == 2, "aborted").otherwise("prepared")
    return f.lineage().groupBy("parent_id").agg(F.min("child_id").alias("left_id"), F.max("child_id").alias("right_id")).withColumn("state", state)


@query("c1_route", f"SELECT event_id, kind, range_id, generation FROM versions JOIN catalog ON {_IN}")
def c1(f):
    return C.route(f.versions(), f.catalog()).select("event_id", "kind", "range_id", "generation")


@query("c2_lookup", "SELECT range_id, generation, start_key, end_key FROM catalog WHERE range_id = 3")
def c2(f):
    return f.catalog().where("range_id = 3")


@query("c3_span_in_ranges", "SELECT range_id, greatest(start_key, '000010') AS lo, least(end_key, '000090') AS hi FROM catalog WHERE greatest(start_key, '000010') < least(end_key, '000090')")
def c3(f):
    return C.intersect(f.catalog(), "000010", "000090")


@query("c4_contains", """SELECT range_id, (start_key IS NULL OR start_key <= '000060') AND (end_key IS NULL OR '000060' < end_key) AS has_key,
(start_key IS NULL OR start_key <= '000040') AND (end_key IS NULL OR end_key >= '000060') AS has_span FROM catalog""")
def c4(f):
    return f.catalog().select("range_id", C.contains(F.lit("000060")).alias("has_key"), C.contains_span("000040", "000060").alias("has_span"))


@query("c5_tiling", """, broken AS (SELECT range_id, start_key, CASE WHEN range_id = 1 THEN end_key || '0' WHEN range_id = 2 THEN '000000' || end_key ELSE end_key END AS end_key FROM catalog),
x AS (SELECT *, lag(end_key) OVER w AS prior, row_number() OVER w AS p FROM broken WINDOW w AS (ORDER BY start_key NULLS FIRST))
SELECT range_id, CASE WHEN prior > start_key THEN 'overlap' ELSE 'gap' END AS fault FROM x WHERE p > 1 AND prior <> start_key""")
def c5(f):
    r = F.col("range_id")
    end = F.when(r == 1, F.concat("end_key", F.lit("0"))).when(r == 2, F.concat(F.lit("000000"), "end_key")).otherwise(F.col("end_key"))
    return C.tiling_faults(f.catalog().withColumn("end_key", end))


def _described(f):
    r = F.col("range_id")
    node = lambda i: F.struct((r * 10 + i).alias("replica_id"), ((r + i) % 5 + F.when(r == 4, 0).otherwise(1)).alias("node_id"))
    last = F.struct((r * 10 + F.when(r == 2, 1).otherwise(2)).alias("replica_id"), ((r + F.when(r == 3, 0).otherwise(2)) % 5 + F.when(r == 4, 0).otherwise(1)).alias("node_id"))
    return f.catalog().withColumn("replicas", F.array(node(0), node(1), last))


@query("c6_descriptor_faults", "SELECT * FROM (VALUES (CAST(2 AS BIGINT), 'repeated replica'), (3, 'repeated node'), (4, 'zero id')) v(range_id, fault)")
def c6(f):
    return C.descriptor_faults(_described(f))


@query("c7_ranges_of_node", ", r AS (SELECT range_id, unnest(CASE WHEN range_id = 3 THEN [range_id % 5 + 1, (range_id + 1) % 5 + 1] WHEN range_id = 4 THEN [range_id % 5, (range_id + 1) % 5, (range_id + 2) % 5] ELSE [range_id % 5 + 1, (range_id + 1) % 5 + 1, (range_id + 2) % 5 + 1] END) AS node FROM catalog) SELECT range_id FROM r WHERE node = 4")
def c7(f):
    return C.on_node(_described(f), 4).select("range_id")


@query("c8_fingerprint", "SELECT sha256(string_agg(range_id || '/' || generation || '/' || coalesce('+' || start_key, '-') || '/' || coalesce('+' || end_key, '-'), ';' ORDER BY range_id)) AS fingerprint FROM catalog")
def c8(f):
    return C.fingerprint(f.catalog())


_SPLIT = ", after AS (SELECT range_id, generation, start_key, end_key FROM catalog WHERE range_id <> 2 UNION ALL SELECT 5, 1, start_key, '000050' FROM catalog WHERE range_id = 2 UNION ALL SELECT 6, 1, '000050', end_key FROM catalog WHERE range_id = 2)"


def _middle(f):
    """A key strictly inside range 2, whatever the size of the data."""
    return f"{f.n * 3 // 8:06d}"


_MIDDLE = "lpad(CAST((SELECT n * 3 // 8 FROM nn) AS VARCHAR), 6, '0')"
_SPLIT = _SPLIT.replace("'000050'", _MIDDLE)


@query("c9_split", _SPLIT + "SELECT range_id, CAST(generation AS BIGINT) AS generation, start_key, end_key FROM after")
def c9(f):
    return C.split(f.catalog(), 2, _middle(f))


@query("c10_lineage", ", below AS (SELECT CAST(1 AS BIGINT) AS range_id, 0 AS depth UNION ALL SELECT l.child_id, b.depth + 1 FROM below b JOIN lineage l ON l.parent_id = b.range_id) SELECT range_id, depth, range_id NOT IN (SELECT parent_id FROM lineage) AS live FROM below")
def c10(f):
    return C.descendants(f.lineage(), 1)


@query("c11_versions_by_range", f"SELECT range_id, count(*) AS n, count(DISTINCT k) AS keys FROM versions JOIN catalog ON {_IN} GROUP BY range_id")
def c11(f):
    return C.route(f.versions(), f.catalog()).groupBy("range_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("keys"))


@query("c12_split_proof", ", p AS (SELECT k, ts, kind, value FROM versions JOIN catalog ON " + _IN + " WHERE range_id = 2 AND kind <> 3) SELECT k, ts, kind, value, CAST(count(*) AS BIGINT) AS surplus FROM p WHERE ts % 97 = 0 GROUP BY ALL")
def c12(f):
    parent = C.route(f.versions(), f.catalog()).where("range_id = 2")
    children = C.route(f.versions(), C.split(f.catalog(), 2, _middle(f))).where("range_id IN (5, 6) AND ts % 97 != 0")
    return C.split_proof(parent, children)


@query("c13_bootstrap_image", f"SELECT k, ts, kind, value FROM versions WHERE ts <= {T} AND kind <> 3")
def c13(f):
    return C.image(f.versions(), T).select("k", "ts", "kind", "value")


@query("c14_delta_replay", _SPLIT + f"SELECT idx, command_type, range_id FROM log JOIN after ON {_IN} WHERE idx > 500 AND entry_type = 0")
def c14(f):
    return C.replay_delta(f.log(), C.split(f.catalog(), 2, _middle(f)), 500).select("idx", "command_type", "range_id")


@query("c15_stale_routes", "SELECT CAST(i AS BIGINT) AS range_id, CAST(i % 3 AS BIGINT) AS generation FROM range(1, 9) r(i) WHERE i % 3 <> 1 OR i > 4")
def c15(f):
    routes = f.spark.range(1, 9).select(F.col("id").alias("range_id"), (F.col("id") % 3).alias("generation"))
    return C.stale(routes, f.catalog())


@query("c16_recovery_roles", _SPLITS + "SELECT unnest([left_id, right_id]) AS range_id, 'shadow' AS role FROM splits WHERE state IN ('copying', 'prepared') UNION ALL SELECT parent_id, 'retired' FROM splits WHERE state = 'committed'")
def c16(f):
    return C.recovery_roles(_splits(f))


_STEPS = [("view", "click"), ("click", "purchase"), ("view", "view"), ("signup", "view"), ("click", "view"), ("purchase", "view")]


@query("c17_illegal_steps", ", h AS (SELECT user_id AS id, event_id AS seq, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM ev) SELECT id, seq, prior, state FROM h WHERE prior IS NOT NULL AND prior || '>' || state NOT IN (" + ", ".join(f"'{a}>{b}'" for a, b in _STEPS) + ")")
def c17(f):
    h = f.events().select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return C.illegal_steps(h, _STEPS)


@query("c18_exclusion", "SELECT user_id AS range_id, count(DISTINCT event_id // 100) AS n FROM ev WHERE event_type = 'signup' GROUP BY user_id HAVING count(DISTINCT event_id // 100) > 1")
def c18(f):
    ops = f.events().select(F.col("user_id").alias("range_id"), F.expr("event_id div 100").alias("operation_id"), (F.col("event_type") == "signup").alias("active"))
    return C.exclusive_faults(ops)


@query("c19_placement", """, votes AS (SELECT range_id, replica_id, max(requests) AS match_index, replica_id < 3 AS voter, replica_id = 1 AS leader FROM counter_samples GROUP BY range_id, replica_id)
SELECT m.range_id, m.state, c.generation, c.start_key, c.end_key, count(*) FILTER (voter) AS voters, count(*) FILTER (NOT voter) AS learners, max(CASE WHEN leader THEN match_index END) AS leader_match
FROM (SELECT CAST(i AS BIGINT) AS range_id, CASE WHEN i % 2 = 0 THEN 'joint' ELSE 'learning' END AS state FROM range(1, 5) r(i)) m LEFT JOIN catalog c USING (range_id) LEFT JOIN votes USING (range_id) GROUP BY ALL""")
def c19(f):
    votes = f.counter_samples().groupBy("range_id", "replica_id").agg(F.max("requests").alias("match_index"))
    votes = votes.withColumns({"voter": F.col("replica_id") < 3, "leader": F.col("replica_id") == 1})
    moves = f.spark.range(1, 5).select(F.col("id").alias("range_id"), F.when(F.col("id") % 2 == 0, "joint").otherwise("learning").alias("state"))
    return C.placement(moves, f.catalog(), votes)
