"""Queries of telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.operators import catalog as C
from chronoframe.operators import telemetry as R
from chronoframe.plans.registry import query

_IN = "(start_key IS NULL OR k >= start_key) AND (end_key IS NULL OR k < end_key)"
_ROUTED = f", routed AS (SELECT v.*, range_id FROM versions v JOIN catalog ON {_IN})"
_SIZE = "length(k) + CASE WHEN value IS NULL THEN 0 ELSE 8 END"
_SIZES = _ROUTED + f""", live AS (SELECT range_id, count(*) AS key_count, CAST(sum({_SIZE}) AS BIGINT) AS logical_bytes FROM (SELECT * FROM routed WHERE kind < 2 QUALIFY row_number() OVER (PARTITION BY range_id, k ORDER BY ts DESC, kind) = 1) WHERE kind = 1 GROUP BY range_id),
sizes AS (SELECT range_id, CAST(sum({_SIZE} + 9) AS BIGINT) AS historical_bytes, coalesce(max(key_count), 0) AS key_count, coalesce(max(logical_bytes), 0) AS logical_bytes FROM routed LEFT JOIN live USING (range_id) GROUP BY range_id)"""
# one sample of each replica and hour falls back, so that every replica has resets
_SAMPLES = ", samples AS (SELECT range_id, replica_id, node_id, at_us, CASE WHEN at_us // 3600000000 % 97 = 0 THEN reads // 2 ELSE reads END AS reads, writes, requests FROM counter_samples)"
_RATED = _SAMPLES + """, lagged AS (SELECT *, lag(at_us) OVER w AS t, lag(reads) OVER w AS r, lag(writes) OVER w AS wr FROM samples WINDOW w AS (PARTITION BY range_id, replica_id ORDER BY at_us)),
marked AS (SELECT *, t IS NULL OR reads < r OR writes < wr AS reset FROM lagged),
islands AS (SELECT *, CAST(sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY range_id, replica_id ORDER BY at_us) AS BIGINT) AS island FROM marked),
rated AS (SELECT *, CASE WHEN reset THEN 0 ELSE CAST(CAST(reads - r AS HUGEINT) * 1000000 // (at_us - t) AS BIGINT) END AS reads_rate, CASE WHEN reset THEN 0 ELSE CAST(CAST(writes - wr AS HUGEINT) * 1000000 // (at_us - t) AS BIGINT) END AS writes_rate,
row_number() OVER (PARTITION BY range_id, replica_id, island ORDER BY at_us) - 1 AS samples FROM islands)"""


def _samples(f):
    fall = F.expr("at_us div 3600000000 % 97 = 0")
    return f.counter_samples().withColumn("reads", F.when(fall, F.expr("reads div 2")).otherwise(F.col("reads")))


def _rated(f):
    return R.rates(_samples(f), ["range_id", "replica_id"], ["reads", "writes"])


def _sizes(f):
    return R.logical_size(C.route(f.versions(), f.catalog()), ["range_id"])


_REPLICAS = _SIZES + """, counted AS (SELECT range_id, replica_id, node_id, max(reads) // 100 AS read_rate, max(writes) // 100 AS write_rate, max(requests) // 100 AS request_rate, max(requests) AS commit_index, count(*) AS samples FROM counter_samples GROUP BY ALL),
replicas AS (SELECT c.*, CASE WHEN replica_id = 1 THEN s.logical_bytes ELSE s.logical_bytes - replica_id * 10 END AS logical_bytes, s.key_count - replica_id AS key_count, historical_bytes + replica_id AS physical_bytes, commit_index - 5 + replica_id * 3 AS applied_index,
replica_id = range_id % 3 + 1 AS is_leader, replica_id <> 3 OR range_id = 2 AS voter, range_id <> 4 AS active, node_id <> 5 OR replica_id <> 1 AS healthy FROM counted c JOIN sizes s USING (range_id))"""


def _replicas(f):
    r = F.col("replica_id")
    s = f.counter_samples().groupBy("range_id", "replica_id", "node_id").agg(
        F.expr("max(reads) div 100").alias("read_rate"), F.expr("max(writes) div 100").alias("write_rate"), F.expr("max(requests) div 100").alias("request_rate"),
        F.max("requests").alias("commit_index"), (F.max("requests") - 5 + r * 3).alias("applied_index"), F.count(F.lit(1)).alias("samples"),
    )
    s = s.join(_sizes(f), "range_id")
    return s.withColumns({
        "logical_bytes": F.when(r == 1, F.col("logical_bytes")).otherwise(F.col("logical_bytes") - r * 10), "key_count": F.col("key_count") - r, "physical_bytes": F.col("historical_bytes") + r,
        "is_leader": r == F.col("range_id") % 3 + 1, "voter": (r != 3) | (F.col("range_id") == 2), "active": F.col("range_id") != 4, "healthy": (F.col("node_id") != 5) | (r != 1),
    })


@query("r1_logical_size", _SIZES + "SELECT range_id, key_count, logical_bytes FROM sizes")
def r1(f):
    return _sizes(f).select("range_id", "key_count", "logical_bytes")


@query("r2_historical_bytes", _SIZES + "SELECT range_id, historical_bytes FROM sizes")
def r2(f):
    return _sizes(f).select("range_id", "historical_bytes")


@query("r3_rates", _RATED + "SELECT range_id, replica_id, at_us, reads_rate, writes_rate FROM rated")
def r3(f):
    return _rated(f).select("range_id", "replica_id", "at_us", "reads_rate", "writes_rate")


@query("r4_resets", """SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(1000000 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT)), (1, 2000000, 100, 1, 1), (1, 3000000, 300, 2, 1), (1, 4000000, 0, 0, 2),
(2, 2000000, 0, 0, 1), (2, 1000000, 0, 0, 2), (3, 1000000, 0, 0, 1)) v(id, at_us, reads_rate, samples, island)""")
def r4(f):
    rows = f.counter_edge()
    order = F.when((F.col("id") == 2) & (F.col("at_us") == 1000000), 9000000).when(F.col("reads") == 900, 9000000).otherwise(F.col("at_us"))
    return R.rates(rows.withColumn("arrival", order), ["id"], ["reads"], arrival="arrival").select("id", "at_us", "reads_rate", "samples", "island")


@query("r5_smoothed", _RATED + """SELECT range_id, replica_id, island, count(*) AS samples, list_reduce(list(reads_rate ORDER BY at_us), lambda p, x: 250000 * x // 1000000 + 750000 * p // 1000000) AS smoothed FROM rated WHERE samples > 0 GROUP BY ALL""")
def r5(f):
    return R.smoothed(_rated(f), ["range_id", "replica_id"], "reads_rate", 250_000)


@query("r6_samples", _RATED + "SELECT range_id, replica_id, island, max(samples) AS samples FROM rated GROUP BY ALL")
def r6(f):
    return _rated(f).groupBy("range_id", "replica_id", "island").agg(F.max("samples").alias("samples"))


@query("r7_range_rollup", _REPLICAS + """SELECT range_id, max(logical_bytes) AS logical_bytes, arg_max(key_count, logical_bytes * 10 - replica_id) AS key_count, max(physical_bytes) AS physical_bytes, CAST(sum(read_rate) AS BIGINT) AS read_rate, CAST(sum(request_rate) AS BIGINT) AS request_rate,
max(CASE WHEN is_leader THEN write_rate END) AS write_rate, max(CASE WHEN is_leader THEN commit_index END) AS commit_index, max(CASE WHEN is_leader THEN applied_index END) AS applied_index, max(samples) AS samples,
greatest(max(CASE WHEN is_leader THEN commit_index END) - max(CASE WHEN is_leader THEN applied_index END), 0) AS apply_backlog FROM replicas GROUP BY range_id""")
def r7(f):
    return R.roll_ranges(_replicas(f))


@query("r8_node_rollup", _REPLICAS + """SELECT node_id, count(*) FILTER (voter AND active) AS hosted_replicas, count(*) FILTER (is_leader) AS leaders, CAST(coalesce(sum(logical_bytes) FILTER (voter AND active), 0) AS BIGINT) AS logical_bytes,
CAST(coalesce(sum(read_rate) FILTER (voter AND active), 0) AS BIGINT) AS read_rate, CAST(coalesce(sum(write_rate) FILTER (voter AND active), 0) AS BIGINT) AS write_rate, bool_and(healthy) AS healthy FROM replicas GROUP BY node_id""")
def r8(f):
    return R.roll_nodes(_replicas(f))


@query("r9_in_flight", ", m AS (SELECT user_id % 7 AS source, user_id % 5 AS target, event_type = 'purchase' AS active, cents AS load FROM ev), s AS (SELECT source AS node_id, 1 AS o, 0 AS i, 0 AS l FROM m WHERE active UNION ALL SELECT target, 0, 1, load FROM m WHERE active) SELECT node_id, CAST(sum(o) AS BIGINT) AS migrations_out, CAST(sum(i) AS BIGINT) AS migrations_in, CAST(sum(l) AS BIGINT) AS incoming_load FROM s GROUP BY node_id")
def r9(f):
    u = F.col("user_id")
    return R.in_flight(f.events().select((u % 7).alias("source"), (u % 5).alias("target"), (F.col("event_type") == "purchase").alias("active"), F.col("cents").alias("load")))


@query("r10_warm_up", ", o AS (SELECT user_id AS node_id, event_id AS seen, event_type <> 'error' AS available FROM ev), b AS (SELECT node_id, max(seen) AS bad FROM o WHERE NOT available GROUP BY node_id) SELECT node_id, max(bad) IS NOT NULL AND count(*) FILTER (available AND seen > bad) < 3 AS warming, count(*) FILTER (available AND seen > bad) AS streak FROM o LEFT JOIN b USING (node_id) GROUP BY node_id")
def r10(f):
    return R.warming(f.events().select(F.col("user_id").alias("node_id"), F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("available")), 3)


@query("r11_repeated_ids", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def r11(f):
    return R.repeated_ids(f.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("r12_engine_counters", "SELECT kind, count(*) AS entries, CAST(sum(CASE WHEN value IS NULL THEN 0 ELSE 8 END) AS BIGINT) AS value_bytes, max(ts) AS newest FROM versions GROUP BY kind")
def r12(f):
    return f.versions().groupBy("kind").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.when(F.col("value").isNull(), 0).otherwise(8)).cast("bigint").alias("value_bytes"), F.max("ts").alias("newest"))


@query("r13_health", _REPLICAS + "SELECT count(DISTINCT node_id) AS nodes, count(DISTINCT range_id) AS ranges, count(*) FILTER (healthy) AS healthy, count(*) FILTER (applied_index < commit_index) AS lagging, count(*) FILTER (NOT active) AS inactive FROM replicas")
def r13(f):
    c = F.count_if
    return _replicas(f).agg(F.countDistinct("node_id").alias("nodes"), F.countDistinct("range_id").alias("ranges"), c("healthy").alias("healthy"), c(F.col("applied_index") < F.col("commit_index")).alias("lagging"), c(~F.col("active")).alias("inactive"))


@query("r14_point_summary", "SELECT * FROM node_metrics WHERE node_id = (SELECT max(node_id) FROM node_metrics)")
def r14(f):
    nodes = f.node_metrics()
    return nodes.where(F.col("node_id") == nodes.agg(F.max("node_id")).first()[0])


@query("r15_recent_actions", "SELECT event_id, event_type, k FROM ev ORDER BY event_id DESC LIMIT 25")
def r15(f):
    return f.events().orderBy(F.desc("event_id")).limit(25).select("event_id", "event_type", "k")
