"""Queries of writes and of upkeep: flush, merge, compaction, pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.functions import scalars as S
from chronoframe.operators import catalog as C
from chronoframe.operators import maintenance as M
from chronoframe.plans.reads import _REPORT, KEY_HASH, T, as_of
from chronoframe.plans.registry import query
from chronoframe.sources.shared import folder

_FILES = ", placed AS (SELECT CASE WHEN event_id < 2000 THEN 1000 + CAST(k AS BIGINT) * 4 // n ELSE (event_id - 2000) // 500 + 1 END AS file_number, v.* FROM versions v, nn)"


def _placed(f):
    e = F.col("event_id")
    number = F.when(e < 2000, F.lit(1000) + F.floor(F.col("k").cast("bigint") * 4 / f.n)).otherwise(F.expr("(event_id - 2000) div 500 + 1")).cast("bigint")
    return f.versions().withColumn("file_number", number)


_BATCHES = ", b AS (SELECT txn_id AS batch_id, txn_id * 10 + seq - 1 AS seq, k, CASE WHEN is_delete THEN 0 ELSE 1 END AS kind, CASE WHEN NOT is_delete THEN value END AS value FROM txn_writes)"


def _batches(f):
    m = F.transform(F.array_sort(F.collect_list(F.struct("seq", "k", "value", "is_delete"))), lambda x: F.struct(x["k"].alias("k"), x["value"].alias("value"), x["is_delete"].alias("is_delete")))
    return f.txn_writes().groupBy(F.col("txn_id").alias("batch_id")).agg(m.alias("mutations")).withColumn("first", F.col("batch_id") * 10)


@query("w1_put_delete", as_of(None, "kind < 2") + "SELECT k, kind, ts, value FROM chosen")
def w1(f):
    from chronoframe.operators.visibility import select_as_of

    return select_as_of(f.versions().where("kind < 2")).select("k", "kind", "ts", "value")


@query("w2_write_batch", _BATCHES + "SELECT batch_id, seq, k, kind, value FROM b")
def w2(f):
    return M.explode_batches(_batches(f))


@query("w3_batch_faults", ", r AS (SELECT event_id, k, CASE WHEN event_id % 101 = 0 THEN 7 ELSE kind END AS kind, CASE WHEN event_id % 103 = 0 THEN NULL WHEN event_id % 107 = 0 THEN 1 ELSE value END AS value FROM versions) SELECT event_id, kind, CASE WHEN kind > 3 THEN 'kind' WHEN kind IN (0, 2) AND value IS NOT NULL THEN 'marker with value' WHEN kind IN (1, 3) AND value IS NULL THEN 'no value' END AS fault FROM r WHERE kind > 3 OR (kind IN (0, 2) AND value IS NOT NULL) OR (kind IN (1, 3) AND value IS NULL)")
def w3(f):
    e = F.col("event_id")
    rows = f.versions().select("event_id", "k", F.when(e % 101 == 0, 7).otherwise(F.col("kind")).alias("kind"), F.when(e % 103 == 0, None).when(e % 107 == 0, 1).otherwise(F.col("value")).alias("value"))
    return M.batch_faults(rows).select("event_id", "kind", "fault")


_CLAIMS = ", claims AS (SELECT idx, term, md5(k) AS digest FROM log UNION ALL SELECT idx, term, md5(k || CASE WHEN idx % 30 = 0 THEN 'x' ELSE '' END) FROM log WHERE idx % 10 = 0)"


@query("w4_apply_once", _CLAIMS + "SELECT idx, count(*) AS copies, CASE WHEN count(DISTINCT term || digest) > 1 THEN 'conflict' ELSE 'applied' END AS outcome FROM claims GROUP BY idx")
def w4(f):
    d = lambda c: F.md5(c.cast("binary"))
    log = f.log()
    again = log.where("idx % 10 = 0").select("idx", "term", d(F.concat("k", F.when(F.col("idx") % 30 == 0, "x").otherwise(""))).alias("digest"))
    return M.apply_once(log.select("idx", "term", d(F.col("k")).alias("digest")).unionByName(again))


_ARRIVED = ", arrived AS (SELECT k, idx + CASE WHEN idx % 37 = 0 THEN 100 ELSE 0 END AS arrival, idx, CASE WHEN idx % 41 = 0 THEN ts - 30000000000000 ELSE ts END AS ts FROM log), tops AS (SELECT *, max(idx) OVER w AS i, max(ts) OVER w AS t FROM arrived WINDOW w AS (PARTITION BY k ORDER BY arrival, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
_FAULT = "CASE WHEN idx < i THEN 'late' WHEN idx = i THEN 'repeated' WHEN ts <= t THEN 'version went back' END"


def _arrived(f):
    i = F.col("idx")
    return f.log().select("k", F.struct((i + F.when(i % 37 == 0, 100).otherwise(0)).alias("a"), i.alias("i")).alias("arrival"), "idx", F.when(i % 41 == 0, F.col("ts") - 30000000000000).otherwise(F.col("ts")).alias("ts"))


@query("w5_order_faults", _ARRIVED + f"SELECT k, idx, {_FAULT} AS fault FROM tops WHERE {_FAULT} IS NOT NULL")
def w5(f):
    return M.order_faults(_arrived(f), ["k"]).select("k", "idx", "fault")


@query("w6_applied_index", "SELECT term, max(idx) AS applied, count(*) FILTER (entry_type = 1) AS noops FROM log GROUP BY term")
def w6(f):
    return f.log().groupBy("term").agg(F.max("idx").alias("applied"), F.count_if(F.col("entry_type") == 1).alias("noops"))


@query("w7_routed_writes", "SELECT batch_id, seq, k, range_id, generation FROM b JOIN catalog ON (start_key IS NULL OR k >= start_key) AND (end_key IS NULL OR k < end_key)".join((_BATCHES, "")))
def w7(f):
    return C.route(M.explode_batches(_batches(f)), f.catalog()).select("batch_id", "seq", "k", "range_id", "generation")


@query("w8_flush", "SELECT k, ts, kind, value FROM versions")
def w8(f):
    return M.flush(f.versions(), folder(f.spark, "flush"), 8)


@query("w9_last_write", ", r AS (SELECT k, ts, kind, value, event_id AS seq FROM versions UNION ALL SELECT k, ts, kind, value + 1, event_id + 1000000 FROM versions WHERE event_id % 3 = 0) SELECT k, ts, kind, value, seq FROM r QUALIFY row_number() OVER (PARTITION BY k, ts, kind ORDER BY seq DESC) = 1")
def w9(f):
    v = f.versions().select("k", "ts", "kind", "value", F.col("event_id").alias("seq"))
    return M.last_write(v.unionByName(v.where("seq % 3 = 0").select("k", "ts", "kind", (F.col("value") + 1).alias("value"), (F.col("seq") + 1000000).alias("seq"))))


@query("w10_rotation")
def w10(f):
    rows = C.route(f.versions(), f.catalog()).groupBy("range_id", F.col("event_id").alias("seq")).agg(F.sum(F.length("k") + 17).cast("bigint").alias("size"))
    return M.rotate(rows, 4096, "range_id")


@query("m1_merge", _FILES + "SELECT file_number, k, ts, kind, value, row_number() OVER (PARTITION BY k ORDER BY ts DESC, kind, file_number) AS place FROM placed")
def m1(f):
    from pyspark.sql import Window

    rows = _placed(f).select("file_number", "k", "ts", "kind", "value")
    merged = M.merge(rows.where("file_number >= 1000"), rows.where("file_number < 1000"))
    return merged.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("ts"), "kind", "file_number")))


@query("m2_pick_compaction", ", seed AS (SELECT smallest_user AS lo, largest_user AS hi FROM file_stats WHERE level = 0 AND (SELECT count(*) FROM file_stats WHERE level = 0) >= 4 ORDER BY file_number LIMIT 1), g AS (SELECT lo, hi, 0 AS d FROM seed UNION ALL SELECT (SELECT min(smallest_user) FROM file_stats f WHERE f.smallest_user <= g.hi AND f.largest_user >= g.lo), (SELECT max(largest_user) FROM file_stats f WHERE f.smallest_user <= g.hi AND f.largest_user >= g.lo), d + 1 FROM g WHERE d < 20) SELECT file_number, f.level FROM file_stats f, (SELECT lo, hi FROM g WHERE d = 20) s WHERE f.smallest_user <= s.hi AND f.largest_user >= s.lo AND f.level <= 1")
def m2(f):
    return M.pick_compaction(f.file_stats()).select("file_number", "level")


@query("m3_compaction", "SELECT k, ts, kind, value FROM versions")
def m3(f):
    return M.compact(_placed(f), 65536).select("k", "ts", "kind", "value")


@query("m4_prune_point", "SELECT file_number, level FROM file_stats WHERE smallest_user <= '000070' AND largest_user >= '000070'")
def m4(f):
    return M.prune_point(f.file_stats(), "000070").select("file_number", "level")


@query("m5_prune_span", "SELECT level, count(*) AS files FROM file_stats WHERE smallest_user < '000080' AND largest_user >= '000070' GROUP BY level")
def m5(f):
    return M.prune_span(f.file_stats(), "000070", "000080").groupBy("level").agg(F.count(F.lit(1)).alias("files"))


_BLOOM = KEY_HASH.replace("@KEYS", "(SELECT DISTINCT k FROM versions UNION SELECT lpad(CAST(i AS VARCHAR), 6, '0') FROM nn, range(0, 4 * n) r(i))") + f""",
size AS (SELECT greatest(64, (count(DISTINCT k) * {S.BITS_A_KEY} + 7) // 8 * 8) AS bits FROM versions),
spots AS (SELECT k, CAST((CAST(first AS UHUGEINT) + CAST(p AS UHUGEINT) * CAST(delta AS UHUGEINT)) % 18446744073709551616::UHUGEINT AS UBIGINT) % CAST(bits AS UBIGINT) AS spot FROM hashed, size, range(0, {S.PROBES}) r(p)),
filled AS (SELECT DISTINCT spot FROM spots WHERE k IN (SELECT k FROM versions))
SELECT k, bool_and(spot IN (SELECT spot FROM filled)) AS may_contain FROM spots WHERE CAST(k AS BIGINT) < 4 * (SELECT n FROM nn) GROUP BY k"""


@query("m6_bloom", _BLOOM)
def m6(f):
    probes = f.spark.range(0, 4 * f.n).select(f.key(F.col("id")).alias("k"))
    return M.bloom_keys(f.versions(), probes)


@query("m7_obsolete_files", "SELECT file_number FROM file_stats WHERE file_number % 3 = 0 AND file_number NOT IN (SELECT file_number FROM file_stats WHERE level = 1)")
def m7(f):
    return f.file_stats().where("file_number % 3 = 0").join(f.file_stats().where("level = 1"), "file_number", "left_anti").select("file_number")


@query("m8_wal_coverage", "SELECT idx // 700 AS segment, count(*) AS entries, min(idx) AS first, max(idx) AS last, max(idx) <= 5000 AS covered FROM log GROUP BY 1")
def m8(f):
    return f.log().groupBy(F.expr("idx div 700").alias("segment")).agg(F.count(F.lit(1)).alias("entries"), F.min("idx").alias("first"), F.max("idx").alias("last"), (F.max("idx") <= 5000).alias("covered"))


@query("m9_frontier", ", done AS (SELECT idx AS seq FROM log WHERE idx % 613 <> 0), r AS (SELECT seq, seq - row_number() OVER (ORDER BY seq) AS island FROM done) SELECT coalesce(max(seq), 0) AS frontier FROM r WHERE island = 0")
def m9(f):
    return M.frontier(f.log().where("idx % 613 != 0").select(F.col("idx").alias("seq")))


@query("m10_edit_fold", ", edits AS (SELECT file_number, file_number AS seq, true AS added FROM file_stats UNION ALL SELECT file_number, file_number + 100000, false FROM file_stats WHERE level = 0 AND file_number % 2 = 0) SELECT file_number FROM edits GROUP BY file_number HAVING arg_max(added, seq)")
def m10(f):
    s = f.file_stats().select("file_number", F.col("file_number").alias("seq"), F.lit(True).alias("added"), "level")
    gone = s.where("level = 0 AND file_number % 2 = 0").select("file_number", (F.col("seq") + 100000).alias("seq"), F.lit(False).alias("added"))
    return M.fold_edits(s.drop("level").unionByName(gone))


@query("m11_table_stats", _FILES + "SELECT file_number, count(*) AS entries, count(*) FILTER (kind = 0) AS deletions, CAST(sum(length(k) + 9 + CASE WHEN value IS NULL THEN 0 ELSE 8 END) AS BIGINT) AS raw_bytes, min(k) AS smallest, max(k) AS largest, min(ts) AS oldest, max(ts) AS newest FROM placed GROUP BY file_number")
def m11(f):
    raw = F.sum(F.length("k") + 9 + F.when(F.col("value").isNull(), 0).otherwise(8))
    return _placed(f).groupBy("file_number").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("kind") == 0).alias("deletions"), raw.cast("bigint").alias("raw_bytes"),
        F.min("k").alias("smallest"), F.max("k").alias("largest"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"),
    )


@query("m12_structure", "SELECT a.file_number AS left_file, b.file_number AS right_file FROM file_stats a JOIN file_stats b ON a.level = 1 AND b.level = 1 AND a.file_number < b.file_number AND a.smallest_user <= b.largest_user AND b.smallest_user <= a.largest_user")
def m12(f):
    # disjoint files sort the same by both bounds, so each can only overlap its neighbour unless a later one starts before an earlier ends
    from pyspark.sql import Window

    files = f.file_stats().where("level = 1")
    w = Window.partitionBy("level").orderBy("smallest_user")
    near = files.withColumns({"left_file": F.lag("file_number").over(w), "end": F.lag("largest_user").over(w)})
    return near.where(F.col("end") >= F.col("smallest_user")).select("left_file", F.col("file_number").alias("right_file"))


@query("m13_compacted_reads", as_of() + _REPORT)
def m13(f):
    from chronoframe.operators.visibility import report_scan

    return report_scan(M.compact(_placed(f), 65536), T)
