"""Queries of transactions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoframe.operators import catalog as C
from chronoframe.operators import transactions as X
from chronoframe.plans.reads import T, as_of
from chronoframe.plans.registry import query

#: Versions that a transaction at T may see, with their records, as DuckDB CTEs.
_SEEN = f""", joined AS (SELECT v.*, t.status, t.commit_ts FROM versions v LEFT JOIN txns t USING (txn_id) WHERE ts <= {T}),
seen AS (SELECT * FROM joined WHERE NOT coalesce(kind = 3 AND (status = 3 OR (status = 2 AND commit_ts > {T})), false))"""
_INTERPRETED = _SEEN + as_of(None, table="seen")
_OUT = "SELECT k, CASE WHEN NOT coalesce(kind = 3 AND status = 1, false) THEN value END AS value, ts, coalesce(kind = 3 AND status = 1, false) AS conflict, kind = 3 AND status IS NULL AS orphan FROM chosen WHERE kind <> 0"
_LAST = ", last AS (SELECT txn_id, k, arg_max(value, seq) AS value0, arg_max(is_delete, seq) AS is_delete, max(seq) AS s, read_ts FROM txn_writes GROUP BY txn_id, k, read_ts), buffered AS (SELECT l.txn_id, l.k, w.value, w.is_delete, w.read_ts FROM last l JOIN txn_writes w ON w.txn_id = l.txn_id AND w.k = l.k AND w.seq = l.s)"
_ROUTED = _LAST + ", routed AS (SELECT b.*, range_id, generation FROM buffered b JOIN catalog ON (start_key IS NULL OR k >= start_key) AND (end_key IS NULL OR k < end_key))"
_NEWEST = as_of(None)
_CONFLICT = ", conflicts AS (SELECT b.txn_id, b.k, b.range_id, b.value, b.is_delete, b.read_ts, coalesce(c.kind = 3 OR c.ts > b.read_ts, false) AS refused FROM routed b LEFT JOIN chosen c ON c.k = b.k)"


def _buffered(f):
    return X.buffered(f.txn_writes(), "read_ts")


def _routed(f):
    return C.route(_buffered(f), f.catalog())


def _prepared(f):
    """Writes with their range, whether its participant is prepared, and their transaction's status.

    What is written meets the versions by key first and then its transaction, so that it is dealt twice in all.
    """
    rows = C.route(X.buffered(X.conflicts(f.versions(), f.txn_writes()), "read_ts", "refused"), f.catalog())
    part, txn = Window.partitionBy("txn_id", "range_id"), Window.partitionBy("txn_id")
    rows = rows.withColumn("prepared", ~F.bool_or("refused").over(part))
    return rows.withColumn("status", F.when(F.bool_and("prepared").over(txn), X.COMMITTED).otherwise(X.ABORTED))


_PARTS = _ROUTED + _NEWEST + _CONFLICT + ", parts AS (SELECT txn_id, range_id, NOT bool_or(refused) AS prepared FROM conflicts GROUP BY ALL), decided AS (SELECT txn_id, CASE WHEN bool_and(prepared) THEN 2 ELSE 3 END AS status FROM parts GROUP BY txn_id)"


@query("t1_interpret_intents", _INTERPRETED + _OUT)
def t1(f):
    return X.interpret(f.versions(), f.txns(), T)


@query("t2_txn_scan", ", r AS (SELECT start_key, end_key FROM catalog WHERE range_id = 2)" + _INTERPRETED + _OUT + " AND k >= (SELECT start_key FROM r) AND k < (SELECT end_key FROM r)")
def t2(f):
    part = C.intersect(f.catalog().where("range_id = 2"), None, None).first()
    return X.interpret(f.versions(), f.txns(), T, part["lo"], part["hi"])


_OWN = ", own AS (SELECT k, value, is_delete FROM buffered WHERE txn_id BETWEEN 1 AND 60 QUALIFY row_number() OVER (PARTITION BY k ORDER BY txn_id DESC) = 1)"
_OVER = _LAST + _OWN + _INTERPRETED + ", base AS (SELECT k, value FROM chosen WHERE kind <> 0) SELECT k, CASE WHEN o.is_delete IS NOT NULL THEN o.value ELSE b.value END AS value FROM base b FULL JOIN own o USING (k) WHERE NOT coalesce(o.is_delete, false)"


def _own(f):
    """The writes of a buffer that sixty orders have filled one after another."""
    rows = X.buffered(f.txn_writes()).where("txn_id BETWEEN 1 AND 60")
    return rows.groupBy("k").agg(F.max_by(F.struct("value", "is_delete"), "txn_id").alias("w")).select("k", "w.value", "w.is_delete")


def _base(f):
    seen = X.interpret(f.versions(), f.txns(), T)
    return seen.select("k", "value")


_OVER = _OVER.replace("SELECT k, value FROM chosen WHERE kind <> 0", "SELECT k, CASE WHEN NOT coalesce(kind = 3 AND status = 1, false) THEN value END AS value FROM chosen WHERE kind <> 0")


@query("t3_read_your_writes", _OVER + " AND k IN ('000004', '000050', '000100')")
def t3(f):
    return X.overlay(_base(f), _own(f)).where(F.col("k").isin("000004", "000050", "000100"))


@query("t4_overlay_scan", _OVER)
def t4(f):
    return X.overlay(_base(f), _own(f))


@query("t5_buffer_limits", _LAST + "SELECT txn_id, count(*) AS keys, CAST(sum(length(k) + CASE WHEN value IS NULL THEN 0 ELSE 8 END) AS BIGINT) AS bytes FROM buffered GROUP BY txn_id")
def t5(f):
    return X.buffered(f.txn_writes()).groupBy("txn_id").agg(F.count(F.lit(1)).alias("keys"), F.sum(F.length("k") + F.when(F.col("value").isNull(), 0).otherwise(8)).alias("bytes"))


@query("t6_participants", _ROUTED + "SELECT txn_id, string_agg(DISTINCT range_id || '/' || generation, ',' ORDER BY range_id || '/' || generation) AS participants, arg_min(range_id, k) AS home FROM routed GROUP BY txn_id")
def t6(f):
    part = F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", F.col("range_id").cast("string"), F.col("generation").cast("string")))), ",")
    return _routed(f).groupBy("txn_id").agg(part.alias("participants"), F.min_by("range_id", "k").alias("home"))


@query("t7_prepare_conflicts", _ROUTED + _NEWEST + _CONFLICT + "SELECT txn_id, k, refused FROM conflicts")
def t7(f):
    return X.conflicts(f.versions(), _routed(f)).select("txn_id", "k", "refused")


@query("t8_prepare_intents", _PARTS + "SELECT c.txn_id, k, read_ts + 1 AS ts, 3 AS kind, value, is_delete FROM conflicts c JOIN parts USING (txn_id, range_id) WHERE prepared")
def t8(f):
    return _prepared(f).where("prepared").select("txn_id", "k", (F.col("read_ts") + 1).alias("ts"), F.lit(3).alias("kind"), "value", "is_delete")


@query("t9_decisions", _PARTS + "SELECT txn_id, status FROM decided")
def t9(f):
    return X.decisions(_prepared(f))


@query("t10_resolution", _PARTS + """SELECT k, read_ts + 1 AS ts, CASE WHEN status = 3 THEN 2 WHEN is_delete THEN 0 ELSE 1 END AS kind, CASE WHEN status = 2 AND NOT is_delete THEN value END AS value, c.txn_id
FROM conflicts c JOIN parts p USING (txn_id, range_id) JOIN decided d ON d.txn_id = c.txn_id WHERE prepared""")
def t10(f):
    return X.resolve(_prepared(f).withColumn("commit_ts", F.col("read_ts") + 1))


@query("t11_commit_timestamp", _ROUTED + ", floors AS (SELECT range_id, max(ts) AS floor FROM (SELECT v.ts, c.range_id FROM versions v JOIN catalog c ON (start_key IS NULL OR v.k >= start_key) AND (end_key IS NULL OR v.k < end_key)) GROUP BY range_id) SELECT txn_id, greatest(max(read_ts), max(floor)) + 1 AS commit_ts FROM routed JOIN floors USING (range_id) GROUP BY txn_id")
def t11(f):
    floors = C.route(f.versions(), f.catalog()).groupBy("range_id").agg(F.max("ts").alias("floor"))
    rows = _routed(f).join(floors, "range_id")
    return rows.groupBy("txn_id").agg((F.greatest(F.max("read_ts"), F.max("floor")) + 1).alias("commit_ts"))


@query("t12_recover", "SELECT txn_id, CASE WHEN status = 1 THEN 3 ELSE status END AS status, read_ts, commit_ts, CASE WHEN status = 1 THEN epoch + 1 ELSE epoch END AS epoch FROM txns")
def t12(f):
    return X.recover(f.txns(), None)  # all records, however many


@query("t13_status_lookup", ", ids AS (SELECT event_id AS txn_id FROM ev) SELECT txn_id, coalesce(a.status, b.status) AS status FROM ids LEFT JOIN (SELECT * FROM txns WHERE txn_id % 2 = 0) a USING (txn_id) LEFT JOIN (SELECT * FROM txns WHERE txn_id % 4 <> 1) b USING (txn_id)")
def t13(f):
    t = f.txns()
    return X.status_of(f.events().select(F.col("event_id").alias("txn_id")), t.where("txn_id % 2 = 0"), t.where("txn_id % 4 != 1"))


@query("t14_read_only", "SELECT txn_id FROM txns WHERE txn_id NOT IN (SELECT txn_id FROM txn_writes)")
def t14(f):
    return f.txns().join(f.txn_writes(), "txn_id", "left_anti").select("txn_id")


@query("t15_drain_ready", ", r AS (SELECT range_id, t.status FROM versions v JOIN txns t USING (txn_id) JOIN catalog ON (start_key IS NULL OR k >= start_key) AND (end_key IS NULL OR k < end_key)) SELECT range_id, bool_and(status <> 1) AS ready, count(*) FILTER (status = 1) AS pending FROM r GROUP BY range_id")
def t15(f):
    rows = C.route(f.versions().join(f.txns().select("txn_id", "status"), "txn_id"), f.catalog())
    return rows.groupBy("range_id").agg(F.bool_and(F.col("status") != 1).alias("ready"), F.count_if(F.col("status") == 1).alias("pending"))


@query("t16_route_pins", _ROUTED + ", pins AS (SELECT DISTINCT txn_id, range_id, CASE WHEN txn_id % 7 = 0 THEN generation + 1 ELSE generation END AS generation FROM routed) SELECT txn_id, bool_or(c.generation IS NULL OR c.generation <> p.generation) AS aborted FROM pins p LEFT JOIN catalog c USING (range_id) GROUP BY txn_id")
def t16(f):
    pin = F.when(F.col("txn_id") % 7 == 0, F.col("generation") + 1).otherwise(F.col("generation"))
    pins = C.with_stale(_routed(f).select("txn_id", "range_id", pin.alias("generation")), f.catalog())
    return pins.groupBy("txn_id").agg(F.bool_or("stale").alias("aborted"))


_FOLD = """, w AS (SELECT DISTINCT txn_id, read_ts, read_ts + 1415577600000 AS commit_ts, k FROM txn_writes),
fold AS (SELECT 0 AS round, *, 1 AS state FROM w
  UNION ALL SELECT round + 1, txn_id, read_ts, commit_ts, k, CASE WHEN state <> 1 THEN state WHEN bool_or(done > read_ts) OVER t THEN 3 WHEN bool_or(waits > read_ts) OVER t THEN 1 ELSE 2 END
  FROM (SELECT *, max(CASE WHEN state = 2 THEN commit_ts END) OVER x AS done, max(CASE WHEN state = 1 THEN commit_ts END) OVER x AS waits, bool_or(state = 1) OVER () AS more
    FROM fold WINDOW x AS (PARTITION BY k ORDER BY commit_ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE more WINDOW t AS (PARTITION BY txn_id))
SELECT DISTINCT txn_id, state = 2 AS committed FROM fold WHERE round = (SELECT max(round) FROM fold)"""


@query("t17_first_committer", _FOLD)
def t17(f):
    # a transaction takes six hours
    return X.first_committer_wins(f.txn_writes().select("txn_id", "read_ts", (F.col("read_ts") + 1415577600000).alias("commit_ts"), "k"))


@query("t18_canonical_writes", "SELECT txn_id, count(*) = count(DISTINCT k) AS unique_keys, list(k ORDER BY seq) = list(k ORDER BY k) AS sorted FROM txn_writes GROUP BY txn_id")
def t18(f):
    keys = F.transform(F.array_sort(F.collect_list(F.struct("seq", "k"))), lambda x: x["k"])
    rows = f.txn_writes().groupBy("txn_id").agg(keys.alias("keys"))
    return rows.select("txn_id", (F.size(F.array_distinct("keys")) == F.size("keys")).alias("unique_keys"), (F.array_sort("keys") == F.col("keys")).alias("sorted"))


@query("t19_close", "SELECT txn_id, CASE status WHEN 2 THEN 'refused' WHEN 3 THEN 'unchanged' ELSE 'aborted' END AS outcome, CASE WHEN status = 1 THEN 3 ELSE status END AS status FROM txns")
def t19(f):
    return X.close(f.txns())
