"""Queries of digests, invariants and advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.operators import audit as A
from chronoframe.operators import catalog as C
from chronoframe.operators import visibility as V
from chronoframe.plans.reads import T, as_of
from chronoframe.plans.registry import query


def _digest(table: str, order: str, parts: list[str], by: str | None = None) -> str:
    """DuckDB SQL of the digest of a table of a million rows at most, whose tree has one level: first column of the order is the key."""
    line = " || ':' || ".join(f"length(CAST({p} AS VARCHAR)) || '=' || CAST({p} AS VARCHAR)" for p in parts)
    g, gb = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f""", inner_ AS (SELECT {g}substr(md5(k), 1, 2) AS bucket, count(*) AS c, sha256(string_agg({line}, '|' ORDER BY {order})) AS d FROM {table} GROUP BY {g}bucket)
SELECT {g}CAST(sum(c) AS BIGINT) AS entries, sha256(string_agg(bucket || d, '|' ORDER BY bucket)) AS digest FROM inner_ {gb}"""


_VALUE = "coalesce(CAST(value AS VARCHAR), '-')"


def _said(c):
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


@query("d1_visible_digest", as_of() + ", live AS (SELECT k, value FROM chosen WHERE kind = 1)" + _digest("live", "k", ["k", "value"]))
def d1(f):
    rows = V.report_scan(f.versions(), T).where("NOT conflict")
    return A.digest(rows, ["k"], [F.col("k"), F.col("value")])


@query("v11_state_digest", as_of(None) + ", live AS (SELECT k, value FROM chosen WHERE kind = 1)" + _digest("live", "k", ["k", "value"]))
def v11(f):
    return A.digest(V.report_scan(f.versions()).where("NOT conflict"), ["k"], [F.col("k"), F.col("value")])


@query("d2_version_digest", ", said AS (SELECT k, ts, kind, " + _VALUE + " AS value FROM versions)" + _digest("said", "k, ts, kind", ["k", "ts", "kind", "value"]))
def d2(f):
    return A.digest(f.versions(), ["k", "ts", "kind"], [F.col("k"), F.col("ts"), F.col("kind"), _said("value")])


@query("d3_image_digest", ", said AS (SELECT k, ts, kind, " + _VALUE + " AS value, range_id FROM versions JOIN catalog ON (start_key IS NULL OR k >= start_key) AND (end_key IS NULL OR k < end_key))" + _digest("said", "k, ts, kind", ["k", "ts", "kind", "value"], "range_id"))
def d3(f):
    return A.digest(C.route(f.versions(), f.catalog()), ["k", "ts", "kind"], [F.col("k"), F.col("ts"), F.col("kind"), _said("value")], ["range_id"])


@query("d3_record_digest", ", recs AS (SELECT CAST(txn_id AS VARCHAR) AS k, status, read_ts, commit_ts, epoch FROM txns)" + _digest("recs", "k", ["k", "status", "read_ts", "commit_ts", "epoch"]))
def d3b(f):
    rows = f.txns().withColumn("k", F.col("txn_id").cast("string"))
    return A.digest(rows, ["k"], [F.col(c) for c in ("k", "status", "read_ts", "commit_ts", "epoch")])


@query("d4_historical_digest", f", said AS (SELECT k, ts, kind, {_VALUE} AS value FROM versions WHERE ts <= {T})" + _digest("said", "k, ts, kind", ["k", "ts", "kind", "value"]))
def d4(f):
    return A.digest(f.versions().where(F.col("ts") <= T), ["k", "ts", "kind"], [F.col("k"), F.col("ts"), F.col("kind"), _said("value")])


@query("a1_bank_total", ", last AS (SELECT e.event, a.account, max(b.event) AS at FROM (SELECT DISTINCT event FROM bank) e, (SELECT DISTINCT account FROM bank) a JOIN bank b ON b.account = a.account AND b.event <= e.event GROUP BY ALL) SELECT l.event, CAST(sum(balance) AS BIGINT) AS total, sum(balance) = 1500 AS conserved FROM last l JOIN bank b ON b.account = l.account AND b.event = l.at GROUP BY l.event")
def a1(f):
    # each event adds the change of its accounts; the running sum of the changes is the total
    from pyspark.sql import Window

    b = f.bank()
    change = b.withColumn("d", F.col("balance") - F.coalesce(F.lag("balance").over(Window.partitionBy("account").orderBy("event")), F.lit(0)))
    by_event = change.groupBy("event").agg(F.sum("d").alias("d"))
    total = F.sum("d").over(Window.partitionBy(F.lit(0)).orderBy("event"))
    return by_event.select("event", total.alias("total")).withColumn("conserved", F.col("total") == 1500)


@query("a1_invariants", """SELECT 'repeated event' AS rule, count(*) AS violations FROM (SELECT event_id FROM ev GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'same version twice', count(*) FROM (SELECT k, ts, kind FROM versions GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'marker with value', count(*) FROM versions WHERE kind IN (0, 2) AND value IS NOT NULL
UNION ALL SELECT 'intent without record', count(*) FROM versions v WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM txns t WHERE t.txn_id = v.txn_id) UNION ALL SELECT 'tiling', 0""")
def a1b(f):
    v = f.versions()
    rules = {
        "repeated event": f.events().groupBy("event_id").count().where("count > 1"),
        "same version twice": v.groupBy("k", "ts", "kind").count().where("count > 1"),
        "marker with value": v.where("kind IN (0, 2) AND value IS NOT NULL"),
        "intent without record": v.where("kind = 3").join(f.txns(), "txn_id", "left_anti"),
        "tiling": C.tiling_faults(f.catalog()),
    }
    out = None
    for name, bad in rules.items():
        row = bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


@query("a2_equality", as_of() + ", seen AS (SELECT k, CASE WHEN CAST(k AS BIGINT) % 10 = 1 THEN value + 1 ELSE value END AS value FROM chosen WHERE CAST(k AS BIGINT) % 7 <> 3 UNION ALL SELECT 'zz', 1) SELECT k, CASE WHEN s.k IS NULL THEN 'missing' WHEN c.k IS NULL THEN 'surplus' ELSE 'different' END AS difference FROM chosen c FULL JOIN seen s USING (k) WHERE s.k IS NULL OR c.k IS NULL OR c.value IS DISTINCT FROM s.value")
def a2(f):
    mine = V.select_as_of(f.versions(), T).select("k", "value")
    n = F.col("k").cast("bigint")
    seen = mine.where(n % 7 != 3).select("k", F.when(n % 10 == 1, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    seen = seen.unionByName(f.spark.createDataFrame([("zz", 1)], "k string, value bigint"))
    return A.differences(mine, seen, ["k"], ["value"])


_LOGS = ", logs AS (SELECT r AS replica, idx, term, CASE WHEN r = 2 AND idx % 997 = 0 THEN k || 'x' ELSE k END AS k FROM log, range(0, 3) x(r) WHERE r <> 1 OR idx < 9000)"


@query("a3_log_matching", _LOGS + "SELECT idx, count(DISTINCT term || '/' || k) AS contents, count(*) AS copies FROM logs GROUP BY idx HAVING count(DISTINCT term || '/' || k) > 1")
def a3(f):
    log = f.log().withColumn("replica", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("replica != 1 OR idx < 9000")
    k = F.when((F.col("replica") == 2) & (F.col("idx") % 997 == 0), F.concat("k", F.lit("x"))).otherwise(F.col("k"))
    return log.groupBy("idx").agg(F.countDistinct(F.concat_ws("/", "term", k)).alias("contents"), F.count(F.lit(1)).alias("copies")).where("contents > 1")


# a leader's first entry of a term is an empty one: the node that wrote it is its key
@query("a3_leaders_by_term", "SELECT term, count(DISTINCT k) AS leaders, count(DISTINCT k) > 1 AS violated FROM log WHERE entry_type = 1 GROUP BY term")
def a3b(f):
    return f.log().where("entry_type = 1").groupBy("term").agg(F.countDistinct("k").alias("leaders")).withColumn("violated", F.col("leaders") > 1)


_FACTS = ", facts AS (SELECT 'node/' || node_id || '/leaders' AS field, CAST(leaders AS VARCHAR) AS value FROM node_metrics UNION ALL SELECT 'node/' || node_id || '/replicas', CAST(hosted_replicas AS VARCHAR) FROM node_metrics)"


def _facts(f):
    pairs = F.expr("stack(2, 'leaders', cast(leaders as string), 'replicas', cast(hosted_replicas as string)) as (name, value)")
    return f.node_metrics().select("node_id", pairs).select(F.concat(F.lit("node/"), F.col("node_id").cast("string"), F.lit("/"), F.col("name")).alias("field"), "value")


@query("a4_grounding", _FACTS + """, said AS (SELECT event_id // 20 AS id, CASE WHEN event_id % 3 = 0 THEN 'node/' || user_id % 25 || '/leaders' ELSE 'node/' || user_id % 40 || '/replicas' END AS field, CAST(event_id % 6 AS VARCHAR) AS value FROM ev),
x AS (SELECT id, field, count(*) AS n, min(value) AS value FROM said GROUP BY ALL) SELECT id, field, CASE WHEN n > 1 THEN 'duplicate' WHEN f.value IS NULL THEN 'unknown field' WHEN f.value <> x.value THEN 'wrong value' ELSE 'ok' END AS verdict FROM x LEFT JOIN facts f USING (field)""")
def a4(f):
    e, u = F.col("event_id"), F.col("user_id")
    field = F.when(e % 3 == 0, F.concat(F.lit("node/"), (u % 25).cast("string"), F.lit("/leaders"))).otherwise(F.concat(F.lit("node/"), (u % 40).cast("string"), F.lit("/replicas")))
    said = f.events().select(F.expr("event_id div 20").alias("id"), field.alias("field"), (e % 6).cast("string").alias("value"))
    return A.grounded(said, _facts(f))


@query("a5_approval", ", advice AS (SELECT event_id AS id, user_id % 40 + 1 AS range_id, event_id % 4 AS generation, event_id % 3 = 0 AS planned FROM ev) SELECT id, CASE WHEN generation <> range_id % 3 + 1 THEN 'stale' WHEN NOT planned THEN 'planner disagrees' ELSE 'approved' END AS outcome FROM advice")
def a5(f):
    e, r = F.col("event_id"), F.col("user_id") % 40 + 1
    advice = f.events().select(e.alias("id"), r.alias("range_id"), (e % 4).alias("generation"), (e % 3 == 0).alias("planned"))
    ranges = f.spark.range(1, 41).select(F.col("id").alias("range_id"), (F.col("id") % 3 + 1).alias("now"))
    joined = advice.join(ranges, "range_id")
    return joined.select("id", F.when(F.col("generation") != F.col("now"), "stale").when(~F.col("planned"), "planner disagrees").otherwise("approved").alias("outcome"))


@query("a6_shadow_agreement", "SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS agreed, count(*) FILTER (event_id % 3 = 1) AS disagreed, count(*) FILTER (event_id % 3 = 2) AS invalid FROM ev GROUP BY event_type")
def a6(f):
    c = lambda i: F.count_if(F.col("event_id") % 3 == i)
    return f.events().groupBy("event_type").agg(c(0).alias("agreed"), c(1).alias("disagreed"), c(2).alias("invalid"))


@query("a7_quorum", ", acks AS (SELECT user_id % 50 AS group_id, event_type IN ('view', 'click') AS acked, user_id % 3 <> 0 AS old_voter, user_id % 50 > 25 AND event_id % 2 = 0 AS new_voter FROM ev) SELECT group_id, count(*) FILTER (old_voter AND acked) > (count(*) FILTER (old_voter)) // 2 AND (count(*) FILTER (new_voter) = 0 OR count(*) FILTER (new_voter AND acked) > (count(*) FILTER (new_voter)) // 2) AS has_quorum FROM acks GROUP BY group_id")
def a7(f):
    u = F.col("user_id")
    acks = f.events().select((u % 50).alias("group_id"), F.col("event_type").isin("view", "click").alias("acked"), (u % 3 != 0).alias("old_voter"), ((u % 50 > 25) & (F.col("event_id") % 2 == 0)).alias("new_voter"))
    return A.quorum(acks)


@query("a8_commit_index", ", m AS (SELECT user_id % 20 AS group_id, user_id, max(event_id) AS match_index FROM ev GROUP BY ALL) SELECT group_id, list_sort(list(match_index), 'DESC')[count(*) // 2 + 1] AS commit_index FROM m GROUP BY group_id")
def a8(f):
    m = f.events().groupBy((F.col("user_id") % 20).alias("group_id"), "user_id").agg(F.max("event_id").alias("match_index"))
    return A.commit_index(m)
