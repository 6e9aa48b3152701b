"""Queries of scoring and planning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoframe.operators import catalog as C
from chronoframe.operators import planner as P
from chronoframe.plans.registry import query

POLICY = P.Policy(max_in=2, max_out=2)
_W = dict(P.Policy().node_weights)


def _nodes(f):
    n = F.col("node_id")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("node_id")) - 1
    return f.node_metrics().withColumns({
        "place": place.cast("bigint"), "healthy": n % 11 != 7, "available": n % 13 != 5, "warming": n % 17 == 2, "migrations_in": n % 3, "migrations_out": n % 4,
    })


_NODES = ", nodes AS (SELECT *, row_number() OVER (ORDER BY node_id) - 1 AS place, node_id % 11 <> 7 AS healthy, node_id % 13 <> 5 AS available, node_id % 17 = 2 AS warming, node_id % 3 AS migrations_in, node_id % 4 AS migrations_out FROM node_metrics)"


def _ranges(f):
    r = F.col("range_id")
    rows = f.table("lineitem").groupBy((F.col("l_partkey") % 40 + 1).alias("range_id")).agg(
        F.sum(F.round("l_extendedprice").cast("bigint")).alias("logical_bytes"), F.sum(F.col("l_quantity").cast("bigint")).alias("write_rate"), F.count(F.lit(1)).alias("read_rate"),
        F.sum(F.col("l_linenumber").cast("bigint")).alias("apply_backlog"),
    )
    rows = rows.withColumns({
        "generation": r % 3 + 1, "physical_bytes": F.col("logical_bytes") * 2, "samples": r % 6 + 1, "active": r % 19 != 0, "splitting": r % 23 == 5, "migrating": r % 29 == 7,
        "unsplittable": r % 31 == 0, "cooled": r % 37 == 0, "no_target": F.lit(False),
    })
    first = _replicas(f).where("replica_id % 10 = 0").select("range_id", F.col("node_id").alias("leader"))
    return rows.join(first, "range_id")


def _replicas(f):
    nodes = f.node_metrics()
    n = nodes.count()
    place = _nodes(f).select("place", "node_id")
    ids = f.spark.range(1, 41).select(F.col("id").alias("range_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    ids = ids.select("range_id", (F.col("range_id") * 10 + F.col("i")).alias("replica_id"), ((F.col("range_id") * 7 + F.col("i") * 3) % n).alias("place"))
    r = F.col("replica_id")
    return ids.join(place, "place").select("range_id", "replica_id", "node_id", (r % 17 != 3).alias("healthy"), (r % 23 != 1).alias("voter"), (r % 4 - r % 2).alias("lag"))


_RANGES = _NODES + """, replicas AS (SELECT range_id, range_id * 10 + i AS replica_id, node_id, (range_id * 10 + i) % 17 <> 3 AS healthy, (range_id * 10 + i) % 23 <> 1 AS voter, (range_id * 10 + i) % 4 - (range_id * 10 + i) % 2 AS lag
FROM (SELECT CAST(r AS BIGINT) AS range_id, CAST(i AS BIGINT) AS i FROM range(1, 41) a(r), range(0, 3) b(i)) x JOIN nodes ON place = (range_id * 7 + i * 3) % (SELECT count(*) FROM nodes)),
sums AS (SELECT l_partkey % 40 + 1 AS range_id, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS logical_bytes, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS write_rate, count(*) AS read_rate, CAST(sum(l_linenumber) AS BIGINT) AS apply_backlog FROM lineitem GROUP BY 1),
ranges AS (SELECT s.*, s.range_id % 3 + 1 AS generation, logical_bytes * 2 AS physical_bytes, s.range_id % 6 + 1 AS samples, s.range_id % 19 <> 0 AS active, s.range_id % 23 = 5 AS splitting, s.range_id % 29 = 7 AS migrating,
s.range_id % 31 = 0 AS unsplittable, s.range_id % 37 = 0 AS cooled, false AS no_target, p.node_id AS leader FROM sums s JOIN replicas p ON p.range_id = s.range_id AND p.replica_id % 10 = 0)"""


def _score(table: str, over: str = "") -> str:
    """DuckDB SQL of the score of a table's rows, with totals over a partition."""
    return " + ".join(f"CASE WHEN sum({m}) OVER ({over}) = 0 THEN 0 ELSE CAST({m} AS HUGEINT) * count(*) OVER ({over}) * 1000000 // CAST(sum({m}) OVER ({over}) AS HUGEINT) * {w} END" for m, w in _W.items())


_SCORED = f", scored AS (SELECT *, CAST({_score('nodes')} AS BIGINT) AS score FROM nodes)"
_POT = "CAST(sum(CAST(score - mean AS HUGEINT) * (score - mean)) AS BIGINT) AS potential"


@query("p1_node_score", _NODES + _SCORED + "SELECT node_id, score FROM scored")
def p1(f):
    return P.score(_nodes(f), POLICY).select("node_id", "score")


@query("p2_range_load", _RANGES + "SELECT range_id, logical_bytes * 4 + write_rate * 3 + read_rate * 2 + apply_backlog * 2 AS load FROM ranges")
def p2(f):
    return _ranges(f).select("range_id", P.load(POLICY).alias("load"))


@query("p3_potential", _NODES + _SCORED + f"SELECT {_POT} FROM (SELECT score, CAST((sum(score) OVER ()) // (count(*) OVER ()) AS BIGINT) AS mean FROM scored)")
def p3(f):
    return P.potential(P.score(_nodes(f), POLICY))


@query("p4_split_warranted", _RANGES + "SELECT range_id, logical_bytes >= 67108864 OR (logical_bytes >= 1048576 AND samples >= 3 AND (read_rate >= 1400 OR write_rate >= 38000)) AS warranted, CASE WHEN logical_bytes >= 67108864 THEN 'RANGE_TOO_LARGE' WHEN logical_bytes >= 1048576 AND samples >= 3 AND (read_rate >= 1400 OR write_rate >= 38000) THEN 'RANGE_TOO_HOT' END AS reason FROM ranges")
def p4(f):
    return P.splits(_ranges(f), P.Policy(hot_reads=1400, hot_writes=38000))


@query("p5_median_key", ", d AS (SELECT DISTINCT range_id, k, start_key, end_key FROM versions JOIN catalog ON (start_key IS NULL OR k >= start_key) AND (end_key IS NULL OR k < end_key)), r AS (SELECT *, row_number() OVER (PARTITION BY range_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY range_id) AS n FROM d) SELECT range_id, k AS split_key FROM r WHERE n > 1 AND i = n // 2 AND (start_key IS NULL OR k > start_key) AND (end_key IS NULL OR k < end_key)")
def p5(f):
    return P.median_keys(C.route(f.versions(), f.catalog()), f.catalog())


_TARGETS = _RANGES + """, targets AS (SELECT r.*, p.replica_id, p.node_id AS source, t.node_id AS target FROM ranges r JOIN replicas p ON p.range_id = r.range_id AND p.healthy AND p.voter JOIN nodes s ON s.node_id = p.node_id AND s.healthy AND s.migrations_out < 2
JOIN nodes t ON t.node_id <> p.node_id AND t.healthy AND t.available AND NOT t.warming AND t.migrations_in < 2 WHERE r.active AND NOT r.splitting AND NOT r.migrating AND r.samples >= 3 AND NOT EXISTS (SELECT 1 FROM replicas q WHERE q.range_id = r.range_id AND q.node_id = t.node_id))"""
_BYTES = ("logical_bytes", "write_rate", "read_rate", "apply_backlog")
_AFTER = _TARGETS + ", moved AS (SELECT c.range_id, c.source, c.target, n.node_id, " + ", ".join(f"CASE n.node_id WHEN c.source THEN greatest(n.{m} - c.{m}, 0) WHEN c.target THEN n.{m} + c.{m} ELSE n.{m} END AS {m}" for m in _BYTES) + """,
CASE n.node_id WHEN c.source THEN greatest(n.hosted_replicas - 1, 0) WHEN c.target THEN n.hosted_replicas + 1 ELSE n.hosted_replicas END AS hosted_replicas,
CASE WHEN c.leader <> c.source THEN n.leaders WHEN n.node_id = c.source THEN greatest(n.leaders - 1, 0) WHEN n.node_id = c.target THEN n.leaders + 1 ELSE n.leaders END AS leaders FROM targets c, nodes n),
rescored AS (SELECT range_id, source, target, CAST(""" + _score("moved", "PARTITION BY range_id, source, target") + f""" AS BIGINT) AS score FROM moved),
after AS (SELECT range_id, source, target, {_POT} FROM (SELECT *, CAST((sum(score) OVER w) // (count(*) OVER w) AS BIGINT) AS mean FROM rescored WINDOW w AS (PARTITION BY range_id, source, target)) GROUP BY ALL)"""


def _targets(f):
    return P.move_targets(_ranges(f), _replicas(f), _nodes(f), POLICY)


@query("p6_move_targets", _TARGETS + "SELECT range_id, source, target FROM targets")
def p6(f):
    return _targets(f).select("range_id", "source", "target")


@query("p7_projected_potential", _AFTER + "SELECT range_id, source, target, potential FROM after")
def p7(f):
    return P.projected(_targets(f), _nodes(f), POLICY)


@query("p8_overloaded", _NODES + _SCORED + "SELECT node_id, score, CAST(14 * 1100000 AS BIGINT) AS threshold, score > 14 * 1100000 AS overloaded FROM scored ORDER BY score DESC, node_id LIMIT 1")
def p8(f):
    return P.overloaded(P.score(_nodes(f), POLICY), _nodes(f).select("node_id"), POLICY)


@query("p9_cooldown", _RANGES + "SELECT range_id FROM ranges WHERE range_id NOT IN (SELECT i FROM range(1, 41) r(i) WHERE i % 4 = 0 AND i * 10 > 200)")
def p9(f):
    cool = f.spark.range(1, 41).where("id % 4 = 0").select(F.col("id").alias("range_id"), (F.col("id") * 10).alias("until"))
    return P.without_cooldown(_ranges(f), cool, "range_id", 200).select("range_id")


_LEADS = _RANGES + ", m AS (SELECT node_id AS source, leaders AS most FROM nodes ORDER BY leaders DESC, node_id LIMIT 1), lead AS (SELECT source, most FROM m, (SELECT min(leaders) AS least FROM nodes) WHERE most > least + 1), transfers AS (SELECT r.range_id, p.replica_id, source, p.node_id AS target FROM ranges r JOIN lead ON r.leader = source JOIN replicas p ON p.range_id = r.range_id AND p.healthy AND p.voter AND p.lag = 0 JOIN nodes t ON t.node_id = p.node_id AND t.healthy AND t.available WHERE p.node_id <> source AND t.leaders < most AND NOT r.splitting AND NOT r.migrating)"


@query("p10_leader_candidates", _LEADS + "SELECT range_id, replica_id, source, target FROM transfers")
def p10(f):
    return P.leader_transfers(_ranges(f), _replicas(f), _nodes(f)).select("range_id", "replica_id", "source", "target")


_MOVES = _AFTER + _SCORED + f", before AS (SELECT {_POT} FROM (SELECT score, CAST((sum(score) OVER ()) // (count(*) OVER ()) AS BIGINT) AS mean FROM scored)), cand AS (SELECT t.range_id, t.source, t.target, 2 AS kind, CAST(greatest(1, t.physical_bytes) AS BIGINT) AS cost, CAST(greatest(b.potential - a.potential, 0) AS BIGINT) AS improvement, '' AS split_key FROM targets t JOIN after a USING (range_id, source, target), before b)"


def _moves(f):
    before = P.potential(P.score(_nodes(f), POLICY)).first()[0]
    t = _targets(f)
    after = P.projected(t, _nodes(f), POLICY)
    gain = F.greatest(F.lit(before) - F.col("potential"), F.lit(0)).cast("bigint")
    return t.select("range_id", "source", "target", "physical_bytes").join(after, ["range_id", "source", "target"]).select("range_id", "source", "target", F.lit(2).alias("kind"), F.greatest(F.lit(1), F.col("physical_bytes")).cast("bigint").alias("cost"), gain.alias("improvement"), F.lit("").alias("split_key"))


@query("p11_move_candidates", _MOVES + "SELECT range_id, source, target, cost, improvement FROM cand")
def p11(f):
    return _moves(f).select("range_id", "source", "target", "cost", "improvement")


_PLACED = _MOVES + ", placed AS (SELECT *, row_number() OVER (ORDER BY improvement // cost DESC, (improvement % cost) * 1000000000000000000::HUGEINT // cost DESC, kind, range_id, source, target) AS place FROM cand)"


@query("p12_candidate_order", _PLACED + "SELECT range_id, source, target, place FROM placed")
def p12(f):
    return P.ordered(_moves(f)).select("range_id", "source", "target", "place")


_OFFERED = """, cand AS (SELECT user_id % 40 + 1 AS range_id, event_id % 7 + 1 AS source, event_id % 11 + 1 AS target, 2 AS kind,
  CAST(sum(event_id % 13 + 1) AS BIGINT) AS cost, CAST(sum(user_id % 17) AS BIGINT) AS improvement FROM ev WHERE event_id % 7 <> event_id % 11 GROUP BY ALL)""" + _PLACED[len(_MOVES):]
_NEXT = ", c{i} AS (SELECT * FROM c{j} WHERE range_id NOT IN (SELECT range_id FROM b{j}) AND source NOT IN (SELECT unnest([source, target]) FROM b{j}) AND target NOT IN (SELECT unnest([source, target]) FROM b{j})), b{i} AS (SELECT * FROM c{i} ORDER BY place LIMIT 1)"
_CHOSEN = _OFFERED + ", c1 AS (SELECT * FROM placed WHERE improvement >= 1), b1 AS (SELECT * FROM c1 ORDER BY place LIMIT 1)"


def _offered(f):
    """Moves between eleven nodes that all events offer."""
    e, u = F.col("event_id"), F.col("user_id")
    rows = f.events().where(e % 7 != e % 11).groupBy((u % 40 + 1).alias("range_id"), (e % 7 + 1).alias("source"), (e % 11 + 1).alias("target"))
    return P.ordered(rows.agg(F.lit(2).alias("kind"), F.sum(e % 13 + 1).alias("cost"), F.sum(u % 17).alias("improvement")).withColumn("split_key", F.lit("")))


@query("p13_select_one", _CHOSEN + " SELECT range_id, source, target, place FROM b1")
def p13(f):
    return P.select_actions(_offered(f), POLICY).select("range_id", "source", "target", "place")


@query("p13_select_three", _CHOSEN + _NEXT.format(i=2, j=1) + _NEXT.format(i=3, j=2) + " SELECT range_id, source, target, place FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3)")
def p13b(f):
    return P.select_actions(_offered(f), P.Policy(max_actions=3)).select("range_id", "source", "target", "place")


@query("p14_noop_reason", _RANGES + "SELECT CASE WHEN bool_or(splitting OR migrating) THEN 'OPERATION_IN_PROGRESS' WHEN bool_or(samples < 3) THEN 'INSUFFICIENT_SAMPLES' WHEN bool_or(unsplittable) THEN 'HOT_UNSPLITTABLE_KEYSPACE' WHEN bool_or(cooled) THEN 'COOLDOWN' WHEN bool_or(no_target) THEN 'NO_ELIGIBLE_TARGET' ELSE 'BALANCED' END AS reason FROM ranges WHERE active")
def p14(f):
    return P.noop_reason(_ranges(f), POLICY)


@query("p15_validate_plan", _TARGETS + """, plan AS (SELECT range_id, source, target, CASE WHEN range_id % 5 = 0 THEN generation + 1 ELSE generation END AS generation FROM targets),
v AS (SELECT p.range_id, p.source, p.target, CASE WHEN r.generation IS NULL THEN 'range is gone' WHEN r.generation <> p.generation THEN 'generation changed' WHEN t.node_id % 2 = 1 THEN 'target not available' END AS reason FROM plan p LEFT JOIN (SELECT * FROM ranges WHERE range_id % 7 <> 1) r USING (range_id) LEFT JOIN nodes t ON t.node_id = p.target) SELECT * FROM v WHERE reason IS NOT NULL""")
def p15(f):
    plan = _targets(f).select("range_id", "source", "target", F.when(F.col("range_id") % 5 == 0, F.col("generation") + 1).otherwise(F.col("generation")).alias("generation"))
    fresh = _nodes(f).withColumn("healthy", F.col("healthy") & (F.col("node_id") % 2 == 0))
    return P.invalid_actions(plan, _ranges(f).where("range_id % 7 != 1"), fresh)


@query("p16_policy", "SELECT * FROM (VALUES ('default', 0), ('thresholds', 1), ('alpha', 1)) v(name, faults)", plain=True)
def p16(f):
    rows = [("default", len(P.Policy().faults())), ("thresholds", len(P.Policy(start_ppm=1, recovery_ppm=2).faults())), ("alpha", len(P.Policy(alpha=0).faults()))]
    return f.spark.createDataFrame(rows, "name string, faults int")


_EVENTS = ", actions AS (SELECT event_id // 5 AS action_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'executing' ELSE 'planned' END AS state, event_id // 5 % 40 + 1 AS range_id, us AS at_us FROM ev)"


def _events(f):
    t = F.col("event_type")
    state = F.when(t == "purchase", "succeeded").when(t == "error", "failed").when(t == "signup", "executing").otherwise("planned")
    return f.events().select(F.expr("event_id div 5").alias("action_id"), F.col("event_id").alias("seq"), state.alias("state"), F.expr("event_id div 5 % 40 + 1").alias("range_id"), F.col("us").alias("at"))


@query("p17_action_fold", _EVENTS + "SELECT action_id, arg_max(state, seq) AS state, max(at_us) AS updated_at FROM actions GROUP BY action_id")
def p17(f):
    return P.action_states(_events(f))


@query("p17_cooldowns", _EVENTS + "SELECT range_id, max(at_us) + 300000000 AS until FROM actions WHERE state IN ('succeeded', 'failed') GROUP BY range_id")
def p17b(f):
    return P.cooldowns(_events(f), 300000000)


@query("p18_reconcile", _EVENTS + ", a AS (SELECT action_id, arg_max(state, seq) AS state, max(range_id) AS range_id FROM actions GROUP BY action_id) SELECT range_id, action_id, state, operation_id FROM a LEFT JOIN (SELECT event_id // 5 % 40 + 1 AS range_id, max(event_id) AS operation_id FROM ev WHERE event_type = 'click' GROUP BY 1) o USING (range_id) WHERE state NOT IN ('succeeded', 'failed')")
def p18(f):
    e = _events(f)
    acts = P.action_states(e).join(e.select("action_id", "range_id").distinct(), "action_id").select("range_id", "action_id", "state")
    ops = f.events().where("event_type = 'click'").select(F.expr("event_id div 5 % 40 + 1").alias("range_id"), F.col("event_id").alias("operation_id"))
    return P.reconcile(acts, ops)
