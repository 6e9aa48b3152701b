"""Queries of log replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.plans.rates import _RATED, _samples
from chronoframe.plans.reads import as_of
from chronoframe.plans.registry import query
from chronoframe.plans.upkeep import _ARRIVED, _arrived
from chronoframe.sources.fixtures import TARGET
from chronoframe.sources.shared import folder
from chronoframe.streaming import replay as L

_OUTCOME = "CASE WHEN idx <= 1000 THEN 'durable' WHEN idx = i THEN 'no-op' WHEN idx < i THEN 'late' WHEN ts <= t THEN 'version went back' ELSE 'applied' END"


@query("l1_apply_loop", _ARRIVED + f"SELECT k, idx, {_OUTCOME} AS outcome FROM tops")
def l1(f):
    return L.dispositions(_arrived(f), ["k"], 1000).select("k", "idx", "outcome")


@query("l1_apply_stream", ", a AS (SELECT k, idx, CASE WHEN idx % 41 = 0 THEN ts - 30000000000000 ELSE ts END AS ts FROM log), t AS (SELECT *, max(ts) OVER (PARTITION BY k ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a) SELECT k, idx, CASE WHEN ts <= top THEN 'version went back' ELSE 'applied' END AS outcome FROM t")
def l1b(f):
    i = F.col("idx")
    rows = f.log().select("k", "idx", F.when(i % 41 == 0, F.col("ts") - 30000000000000).otherwise(F.col("ts")).alias("ts"))
    return L.drain(rows.coalesce(1), L.apply_stream, folder(f.spark, "stream"))


@query("l2_watermarks", "SELECT term, max(ts) AS applied, greatest(max(ts), max(CASE WHEN entry_type = 1 THEN ts + 1000 * term END)) AS safe_read FROM log GROUP BY term")
def l2(f):
    log = f.log()
    return L.watermarks(log, log.where("entry_type = 1").select("term", (F.col("ts") + 1000 * F.col("term")).alias("ts")), ["term"])


@query("l3_late_entries", _ARRIVED + f"SELECT outcome, count(*) AS n FROM (SELECT {_OUTCOME} AS outcome FROM tops) GROUP BY outcome")
def l3(f):
    return L.dispositions(_arrived(f), ["k"], 1000).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("l4_clock", ", c AS (SELECT user_id, event_id, us // 3600000000 * 3600000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ev) SELECT user_id, event_id, max(ms * 65536 - n) OVER (PARTITION BY user_id ORDER BY event_id) + n AS hlc FROM c")
def l4(f):
    ms = F.expr("us div 3600000000 * 3600000")
    return L.clock(f.events().select("user_id", "event_id", F.col("event_id").alias("seq"), ms.alias("ms")), ["user_id"]).select("user_id", "event_id", "hlc")


@query("l5_observe", "SELECT user_id, event_id, max(ts - event_id % 7 * 10000000000) OVER (PARTITION BY user_id ORDER BY event_id) AS observed FROM ev")
def l5(f):
    seen = (F.col("ts") - F.col("event_id") % 7 * 10000000000).alias("ts")
    return L.observe(f.events().select("user_id", "event_id", F.col("event_id").alias("seq"), seen), ["user_id"]).select("user_id", "event_id", "observed")


@query("l6_replay_batches", ", b AS (SELECT idx // 7 AS batch, min(idx) AS first, max(idx) AS last FROM log GROUP BY 1) SELECT batch, first, last, CASE WHEN last <= 4000 THEN 'skipped' WHEN first <= 4000 THEN 'rejected' ELSE 'replayed' END AS outcome FROM b")
def l6(f):
    b = f.log().groupBy(F.expr("idx div 7").alias("batch")).agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    return L.replay_batches(b, 4000)


@query("l7_catch_up", as_of(None) + "SELECT k, ts, kind, value FROM chosen")
def l7(f):
    from chronoframe.operators.visibility import select_as_of

    v = f.versions()
    base = v.where(F.col("ts") <= TARGET)
    return select_as_of(base.unionByName(v.where(F.col("ts") > TARGET))).select("k", "ts", "kind", "value")


@query("l8_sample_stream", _RATED + "SELECT range_id, replica_id, at_us, reads_rate FROM rated")
def l8(f):
    rows = _samples(f).select("range_id", "replica_id", "at_us", "reads")
    return L.drain(rows.coalesce(1), L.sample_stream, folder(f.spark, "stream"))


@query("l9_fair_queue", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM ev")
def l9(f):
    return L.fair_order(f.events().select("user_id", "event_id", F.col("event_id").alias("seq")), "user_id").select("user_id", "event_id", "turn")


@query("l10_trace_tail", "SELECT event_id, k, ts FROM ev ORDER BY event_id DESC LIMIT 100")
def l10(f):
    return f.events().orderBy(F.desc("event_id")).limit(100).select("event_id", "k", "ts")


@query("l11_schedule", "SELECT event_id % 48 AS slot, event_type, count(*) AS n FROM ev GROUP BY ALL")
def l11(f):
    return f.events().groupBy((F.col("event_id") % 48).alias("slot"), "event_type").agg(F.count(F.lit(1)).alias("n"))
