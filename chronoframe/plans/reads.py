"""Queries of scans, as-of reads and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.functions import scalars as S
from chronoframe.operators import visibility as V
from chronoframe.plans.registry import query
from chronoframe.sources import logs
from chronoframe.sources.fixtures import TARGET

T = TARGET
KEY, LOW, HIGH = "000004", "000003", "000009"


def as_of(target: int | None = T, where: str = "true", table: str = "versions") -> str:
    """DuckDB SQL of the chosen version of each key, as CTEs that end in `chosen`."""
    time = "true" if target is None else f"ts <= {target}"
    return f""", w1 AS (SELECT *, row_number() OVER (PARTITION BY k, ts ORDER BY kind) AS r1 FROM {table} WHERE {time} AND {where}),
w2 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC) AS r2 FROM w1 WHERE r1 = 1 AND kind <> 2),
chosen AS (SELECT * EXCLUDE (r1, r2) FROM w2 WHERE r2 = 1) """


_REPORT = "SELECT k, CASE WHEN kind = 1 THEN value END AS value, ts, kind = 3 AS conflict FROM chosen WHERE kind <> 0"
_FULL = "SELECT k, ts, kind, value, txn_id, event_id FROM chosen"
_ALL = ["k", "ts", "kind", "value", "txn_id", "event_id"]


@query("s1_full_scan", as_of(None) + _REPORT)
def s1(f):
    return V.report_scan(f.versions())


@query("s2_range_scan", as_of(None, f"k >= '{LOW}' AND k < '{HIGH}'") + _REPORT)
def s2(f):
    return V.report_scan(f.versions(), None, LOW, HIGH)


@query("s3_point_read", as_of(None, f"k = '{KEY}'") + _REPORT)
def s3(f):
    return V.report_scan(f.versions().where(F.col("k") == KEY))


@query("s4_table_iterator", f"SELECT k, ts, kind, value, row_number() OVER (ORDER BY k, ts DESC, kind) AS rank FROM versions WHERE k >= '{LOW}' AND k < '{HIGH}'")
def s4(f):
    return V.ranked(V.span(f.versions(), LOW, HIGH), [F.col("k"), F.desc("ts"), F.col("kind")]).select("k", "ts", "kind", "value", "rank")


@query("s5_seek", f"SELECT k, ts, kind, value FROM versions WHERE k > '{KEY}' OR (k = '{KEY}' AND (ts < {T} OR (ts = {T} AND kind >= 1))) ORDER BY k, ts DESC, kind LIMIT 1")
def s5(f):
    return V.seek(f.versions(), KEY, T, 1).select("k", "ts", "kind", "value")


@query("s6_exact_key", f"SELECT k, ts, kind, value FROM versions WHERE k = '{KEY}' AND kind = 1 AND ts = (SELECT max(ts) FROM versions WHERE k = '{KEY}' AND kind = 1)")
def s6(f):
    v = f.versions()
    newest = v.where((F.col("k") == KEY) & (F.col("kind") == 1)).agg(F.max("ts")).first()[0]
    return V.exact(v, KEY, newest, 1).select("k", "ts", "kind", "value")


@query("s7_candidate", f"SELECT k, ts, kind, value FROM versions WHERE k = '{KEY}' AND ts <= {T} ORDER BY ts DESC, kind LIMIT 1")
def s7(f):
    return V.candidate(f.versions(), KEY, T).select("k", "ts", "kind", "value")


@query("s8_snapshot_range", f"SELECT k, ts, kind, value FROM versions WHERE k >= '{LOW}' AND k < '{HIGH}'")
def s8(f):
    return V.span(f.versions(), LOW, HIGH).select("k", "ts", "kind", "value")


@query("s9_log_range", "SELECT idx, term, entry_type, command_type, k, ts FROM log WHERE idx BETWEEN 100 AND 400")
def s9(f):
    return logs.entries(f.log(), 100, 400)


@query("s10_wal_prefix", "SELECT idx, term, k, ts FROM log WHERE idx < (SELECT min(idx) FROM log WHERE idx % 777 = 0)")
def s10(f):
    return logs.valid_prefix(f.log().withColumn("valid", F.col("idx") % 777 != 0)).select("idx", "term", "k", "ts")


@query("s11_local_reads", as_of(None, "kind < 2") + "SELECT k, value, ts FROM chosen WHERE kind = 1")
def s11(f):
    return V.scan(f.versions().where("kind < 2"))


@query("s12_frozen_iterator", "SELECT k, ts, kind, value, row_number() OVER (PARTITION BY k ORDER BY ts DESC, kind) AS place FROM versions")
def s12(f):
    from pyspark.sql import Window

    return f.versions().select("k", "ts", "kind", "value", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("ts"), "kind")).alias("place"))


@query("v1_get_mvcc_at", as_of(T, f"k = '{KEY}'") + _FULL)
def v1(f):
    return V.get_mvcc(f.versions(), KEY, T).select(*_ALL)


@query("v2_scan_mvcc_at", as_of() + _FULL)
def v2(f):
    return V.select_as_of(f.versions(), T).select(*_ALL)


@query("v3_scan_at", as_of() + _REPORT)
def v3(f):
    return V.report_scan(f.versions(), T)


@query("v4_get_at", as_of(T, "k = '000007'") + _REPORT)
def v4(f):
    return V.report_scan(f.versions().where("k = '000007'"), T)


@query("v5_clamped_scan", as_of(None) + ", latest AS (SELECT max(ts) AS m FROM versions) SELECT k, ts, kind, value, m AS used FROM chosen, latest")
def v5(f):
    versions = f.versions()
    used = V.clamp(1 << 62, versions.agg(F.max("ts")).first()[0])
    return V.select_as_of(versions, used).select("k", "ts", "kind", "value", F.lit(used).cast("bigint").alias("used"))


@query("v6_duplicates", """, twice AS (SELECT k, ts, kind, value, 1 AS source FROM versions UNION ALL SELECT k, ts, kind, value + (event_id % 2), 2 FROM versions WHERE event_id % 5 = 0)
SELECT k, ts, kind, count(*) AS n, count(DISTINCT source) AS sources, count(DISTINCT coalesce(CAST(value AS VARCHAR), 'null')) AS contents FROM twice GROUP BY ALL HAVING count(*) > 1""")
def v6(f):
    v = f.versions()
    twice = v.select("k", "ts", "kind", "value", F.lit(1).alias("source")).unionByName(v.where("event_id % 5 = 0").select("k", "ts", "kind", (F.col("value") + F.col("event_id") % 2).alias("value"), F.lit(2).alias("source")))
    return V.duplicates(twice, "source")


@query("v7_export_versions", "SELECT DISTINCT k, ts, kind, value FROM versions")
def v7(f):
    return V.export(f.versions().unionByName(f.versions()))


_MARKS = "SELECT replica_id, max(ts) - (replica_id * 3000000000000) AS applied, max(ts) - (replica_id * 2000000000000) AS safe_read, replica_id = 2 AS shadow FROM (SELECT *, event_id % 4 AS replica_id FROM versions) GROUP BY replica_id"


def _marks(f):
    v = f.versions().withColumn("replica_id", F.col("event_id") % 4)
    m, r = F.max("ts"), F.col("replica_id")
    return v.groupBy("replica_id").agg((m - r * 3000000000000).alias("applied"), (m - r * 2000000000000).alias("safe_read")).withColumn("shadow", r == 2)


@query("v8_freshness_gate", f""", marks AS ({_MARKS}), latest AS (SELECT max(ts) - 1000000000000 AS t FROM versions)
SELECT replica_id, CASE WHEN shadow THEN 'not serving' ELSE 'behind' END AS reason FROM marks, latest WHERE shadow OR t > greatest(applied, safe_read)""")
def v8(f):
    target = f.versions().agg(F.max("ts")).first()[0] - 1000000000000
    return V.behind(_marks(f), target).select("replica_id", "reason")


@query("v9_snapshot_scan", as_of(T, f"k >= '{LOW}' AND k < '{HIGH}'") + _REPORT)
def v9(f):
    applied = f.versions().agg(F.max("ts")).first()[0]
    return V.Snapshot(f.versions(), T, applied).scan(LOW, HIGH)


@query("v10_oldest_protected", f"SELECT least({T}, min(read_ts)) AS oldest FROM txns WHERE status = 1")
def v10(f):
    open_ = f.spark.range(1).select(F.lit(T).cast("bigint").alias("ts"))
    return V.oldest_protected(open_, f.txns().where("status = 1").select(F.col("read_ts").alias("ts")))


@query("v_edge_binary", """, w1 AS (SELECT *, row_number() OVER (PARTITION BY key, ts ORDER BY kind) AS r1 FROM kv_edge), w2 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC) AS r2 FROM w1 WHERE r1 = 1 AND kind <> 2)
SELECT hex(key) AS k, ts, kind, hex(value) AS value FROM w2 WHERE r2 = 1""")
def v_edge(f):
    return V.select_as_of(f.kv_edge().withColumnRenamed("key", "k")).select(F.hex("k").alias("k"), "ts", "kind", F.hex("value").alias("value"))


@query("f1_hybrid_time", "SELECT event_id, us // 1000 * 65536 + event_id % 65536 AS ts, us // 1000 AS physical, event_id % 65536 AS logical, us // 1000 * 65536 + event_id % 65536 + 1 AS next FROM ev")
def f1(f):
    ts = S.hlc(F.expr("us div 1000"), F.col("event_id") % 65536)
    return f.events().select("event_id", ts.alias("ts")).select("event_id", "ts", S.physical(F.col("ts")).alias("physical"), S.logical(F.col("ts")).alias("logical"), S.following(F.col("ts")).alias("next"))


@query("f2_compare", """SELECT a.event_id, a.kind, CASE WHEN a.k = '000005' AND a.ts = 111738880000000000 AND a.kind = 1 THEN 0
WHEN a.k < '000005' OR (a.k = '000005' AND (a.ts > 111738880000000000 OR (a.ts = 111738880000000000 AND a.kind < 1))) THEN -1 ELSE 1 END AS side FROM versions a""")
def f2(f):
    a = (F.col("k"), F.col("ts"), F.col("kind"))
    return f.versions().select("event_id", "kind", S.compare(a, (F.lit("000005"), F.lit(T), F.lit(1))).alias("side"))


@query("f3_key_codec", "SELECT hex(key) || hex(-1 - ts) || '0' || kind AS coded, hex(key) AS key, ts, kind FROM kv_edge")
def f3(f):
    coded = S.encode_key(F.col("key"), F.col("ts"), F.col("kind"))
    back = f.kv_edge().select(coded.alias("c")).select("c", S.decode_key(F.col("c")).alias("d"))
    return back.select(F.hex("c").alias("coded"), F.hex("d.key").alias("key"), "d.ts", "d.kind")


@query("f5_saturating", """SELECT event_id, CAST(least(CAST(us AS HUGEINT) * 1000000, 18446744073709551615) // 1000 AS BIGINT) AS product, greatest(us - 1704500000000000, 0) AS difference,
CAST(CAST(us AS HUGEINT) * 3 // 7 AS BIGINT) AS scaled, us + event_id AS total FROM ev""")
def f5(f):
    us = F.col("us")
    product = S.mul_sat(us, 1000000)
    return f.events().select("event_id", ((product - product % 1000) / 1000).cast("bigint").alias("product"), S.sub_sat(us, 1704500000000000).cast("bigint").alias("difference"), S.mul_div(us, 3, F.lit(7)).cast("bigint").alias("scaled"), S.add_sat(us, F.col("event_id")).cast("bigint").alias("total"))


@query("f6_common_prefix", """, p AS (SELECT file_number, smallest_user AS a, largest_user AS b FROM file_stats)
SELECT file_number, CAST((SELECT max(i) FROM range(0, 7) r(i) WHERE a[1:i] = b[1:i]) AS INTEGER) AS shared FROM p""")
def f6(f):
    return f.file_stats().select("file_number", S.common_prefix(F.col("smallest_user"), F.col("largest_user")).cast("int").alias("shared"))


@query("f9_kinds", "SELECT kind, count(*) AS n, kind IN (1, 3) AS carries, kind BETWEEN 0 AND 3 AS valid FROM versions GROUP BY kind")
def f9(f):
    k = F.col("kind")
    return f.versions().groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", "n", S.carries_value(k).alias("carries"), S.valid_kind(k).alias("valid"))


@query("f10_majority", "SELECT i AS n, i // 2 + 1 AS majority, i // 2 AS middle FROM range(0, 32) r(i)", plain=True)
def f10(f):
    n = F.col("id")
    return f.spark.range(32).select(n.alias("n"), S.majority(n).alias("majority"), S.middle(n).alias("middle"))


#: The key hash in DuckDB: one step a character, then the mix; all numbers wrap at 64 bits.
KEY_HASH = f""", steps AS (SELECT k, 0 AS i, xor({S.HASH_OFFSET}::UBIGINT, {S.HASH_SEED}::UBIGINT) AS v FROM @KEYS
  UNION ALL SELECT k, i + 1, CAST(CAST(xor(v, CAST(ascii(substr(k, i + 1, 1)) AS UBIGINT)) AS UHUGEINT) * {S.HASH_PRIME} % 18446744073709551616::UHUGEINT AS UBIGINT) FROM steps WHERE i < length(k)),
m0 AS (SELECT k, v, CAST((CAST(v AS UHUGEINT) + {S.HASH_SEED}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS m FROM steps WHERE i = length(k)),
""" + ", ".join(f"m{i + 1} AS (SELECT k, v, CAST(CAST(xor(m, m >> {shift}) AS UHUGEINT) * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT AS UBIGINT) AS m FROM m{i})" for i, (shift, factor) in enumerate(S.MIX)) + """,
hashed AS (SELECT k, v AS first, m | 1::UBIGINT AS delta FROM m3)"""  # noqa: E501


@query("f7_key_hash", KEY_HASH.replace("@KEYS", "(SELECT DISTINCT k FROM versions)") + " SELECT k, CAST(first AS VARCHAR) AS first, CAST(delta AS VARCHAR) AS delta FROM hashed")
def f7(f):
    return f.versions().select("k").distinct().select("k", S.hash_of_key(F.col("k")).alias("h")).select("k", "h.first", "h.delta")


@query("f8_checksum", f""", bits AS (SELECT CAST(i AS BIGINT) AS x, CAST(i AS BIGINT) AS v, 0 AS step FROM range(0, 256) r(i)
  UNION ALL SELECT x, CASE WHEN v & 1 = 1 THEN xor(v >> 1, {S.CASTAGNOLI}::BIGINT) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
steps AS (SELECT k, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT k FROM versions)
  UNION ALL SELECT k, i + 1, xor(c >> 8, b.v) FROM steps JOIN (SELECT x, v FROM bits WHERE step = 8) b ON b.x = xor(c, ascii(substr(k, i + 1, 1))::BIGINT) & 255 WHERE i < length(k))
SELECT k, xor(c, 4294967295::BIGINT) AS checksum FROM steps WHERE i = length(k)""")
def f8(f):
    return f.versions().select("k").distinct().select("k", S.crc32c(F.col("k").cast("binary")).alias("checksum"))
