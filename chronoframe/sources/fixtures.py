"""Version logs, transactions, catalogs and samples derived from the plain tables.

Each table is given as a DataFrame and, in ORACLE, as DuckDB SQL. Physical milliseconds
are microseconds divided by 1000 without rounding; a version is milliseconds * 65536 plus
a logical part; keys are numbers padded to six digits, so that text order is byte order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A time within January 2024, as a version.
TARGET = 1705000000000 * 65536


class Fixtures:
    """The derived tables of one data folder; each is built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._n = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def n(self) -> int:
        """Users: one more than the greatest id."""
        if self._n is None:
            self._n = self.table("events").agg(F.max("user_id")).first()[0] + 1
        return self._n

    def key(self, x):
        return F.lpad(x.cast("string"), 6, "0")

    def events(self) -> DataFrame:
        us = F.unix_micros(F.col("ts").cast("timestamp"))
        return self.table("events").select(
            "event_id", "user_id", "event_type", us.alias("us"), self.key(F.col("user_id")).alias("k"),
            (F.expr("unix_micros(cast(ts as timestamp)) div 1000") * 65536 + F.col("event_id") % 65536).alias("ts"),
            F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        )

    def versions(self) -> DataFrame:
        """k, ts, kind (0 delete, 1 value, 2 abort, 3 intent), value, txn_id, event_id."""
        none = F.lit(None).cast("bigint")
        e, signup, error = F.col("event_id"), F.col("event_type") == "signup", F.col("event_type") == "error"
        first = F.struct(F.when(error, 0).when(signup, 3).otherwise(1).alias("kind"), F.when(error, none).otherwise(F.col("cents")).alias("value"), F.when(signup, e).alias("txn_id"))
        done = F.struct(F.lit(1).alias("kind"), F.col("cents").alias("value"), none.alias("txn_id"))
        undone = F.struct(F.lit(2).alias("kind"), none.alias("value"), none.alias("txn_id"))
        rows = F.when(signup & (e % 3 == 0), F.array(first, done)).when(signup & (e % 3 == 1), F.array(first, undone)).otherwise(F.array(first))
        return self.events().select("k", "ts", "event_id", F.explode(rows).alias("r")).select("k", "ts", "r.kind", "r.value", "r.txn_id", "event_id")

    def txns(self) -> DataFrame:
        e = F.col("event_id")
        status = F.when((e % 3 == 0) | (e % 9 == 5), 2).when((e % 3 == 1) | (e % 9 == 8), 3).otherwise(1)
        return self.events().where("event_type = 'signup'").select(e.alias("txn_id"), status.alias("status"), (F.col("ts") - 3932160000).alias("read_ts"), F.col("ts").alias("commit_ts"), F.lit(1).cast("bigint").alias("epoch"))

    def txn_writes(self) -> DataFrame:
        """Two writes for each order; a later one may repeat the key of an earlier."""
        n, c = F.lit(self.n), F.col("o_custkey")
        total = F.round(F.col("o_totalprice") * 100).cast("bigint")
        gone = F.col("o_orderstatus") == "F"
        one = F.struct(F.lit(1).alias("seq"), self.key(c % n).alias("k"), F.when(~gone, total).alias("value"), gone.alias("is_delete"))
        two = F.struct(F.lit(2).alias("seq"), self.key((c * 7 + 3) % n).alias("k"), (total + 1).alias("value"), F.lit(False).alias("is_delete"))
        read = (F.lit(1704067200000) + (F.col("o_orderkey") * 172800) % 2592000000) * 65536
        return self.table("orders").select(F.col("o_orderkey").alias("txn_id"), read.alias("read_ts"), F.explode(F.array(one, two)).alias("w")).select("txn_id", "w.seq", "read_ts", "w.k", "w.value", "w.is_delete")

    def catalog(self) -> DataFrame:
        """Four ranges that tile all keys; a null bound is open."""
        cuts = [None, *(f"{self.n * i // 4:06d}" for i in (1, 2, 3)), None]
        rows = [(i + 1, 1, cuts[i], cuts[i + 1]) for i in range(4)]
        return self.spark.createDataFrame(rows, "range_id bigint, generation bigint, start_key string, end_key string")

    def log(self) -> DataFrame:
        e, noop = F.col("event_id"), F.col("event_id") % 50 == 0
        return self.events().select((e + 1).alias("idx"), (F.expr("event_id div 1000") + 1).alias("term"), F.when(noop, 1).otherwise(0).alias("entry_type"), F.when(F.col("event_type") == "error", 2).otherwise(1).alias("command_type"), "k", "ts")

    def counter_samples(self) -> DataFrame:
        """Hourly running totals of reads, writes and requests by replica."""
        u = F.col("user_id")
        ids = self.events().select((u % 4 + 1).alias("range_id"), (u % 3 + 1).alias("replica_id"), "event_type", F.expr("us div 3600000000 * 3600000000").alias("at_us"))
        hours = ids.groupBy("range_id", "replica_id", "at_us").agg(
            F.count_if(F.col("event_type").isin("click", "view")).alias("r"), F.count_if(F.col("event_type").isin("purchase", "signup")).alias("w"), F.count(F.lit(1)).alias("q")
        )
        from pyspark.sql import Window

        w = Window.partitionBy("range_id", "replica_id").orderBy("at_us")
        return hours.select("range_id", "replica_id", ((F.col("range_id") + F.col("replica_id")) % 5 + 1).alias("node_id"), "at_us", F.sum("r").over(w).alias("reads"), F.sum("w").over(w).alias("writes"), F.sum("q").over(w).alias("requests"))

    def node_metrics(self) -> DataFrame:
        s, line = self.table("supplier"), self.table("lineitem")
        j = s.join(line, s.s_suppkey == line.l_suppkey)
        return j.groupBy(F.col("s_nationkey").cast("bigint").alias("node_id")).agg(
            F.countDistinct("s_suppkey").alias("hosted_replicas"), F.countDistinct(F.when(F.col("s_acctbal") > 0, F.col("s_suppkey"))).alias("leaders"),
            F.sum(F.round("l_extendedprice").cast("bigint")).alias("logical_bytes"), F.sum(F.col("l_quantity").cast("bigint")).alias("write_rate"),
            F.count(F.lit(1)).alias("read_rate"), F.sum(F.col("l_linenumber").cast("bigint")).alias("apply_backlog"),
        )

    def file_stats(self) -> DataFrame:
        """The first 2,000 events as four disjoint files of level 1, each further 500 as one file of level 0."""
        e, u = F.col("event_id"), F.col("user_id")
        number = F.when(e < 2000, F.lit(1000) + F.floor(u * 4 / self.n)).otherwise(F.expr("(event_id - 2000) div 500 + 1")).cast("bigint")
        return self.events().groupBy(number.alias("file_number"), F.when(e < 2000, 1).otherwise(0).alias("level")).agg(
            F.min("k").alias("smallest_user"), F.max("k").alias("largest_user"), F.min("ts").alias("smallest_version"), F.max("ts").alias("largest_version"),
            F.count(F.lit(1)).alias("entries"), F.count_if(F.col("event_type") == "error").alias("deletions"),
        )

    def lineage(self) -> DataFrame:
        return self.spark.range(1, 16).select(F.col("id").alias("parent_id"), F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("child_id"))

    def counter_edge(self) -> DataFrame:
        return self.spark.createDataFrame(COUNTER_EDGE, "id bigint, at_us bigint, reads bigint")

    def kv_edge(self) -> DataFrame:
        rows = [(bytes.fromhex(k), ts, kind, None if v is None else bytes.fromhex(v)) for k, ts, kind, v in KV_EDGE]
        return self.spark.createDataFrame(rows, "key binary, ts bigint, kind int, value binary")

    def bank(self) -> DataFrame:
        rows, balance = [(0, a, 250) for a in range(6)], [250] * 6
        for i in range(20):
            source, to = i % 6, (i + 3) % 6
            balance[source] -= 7
            balance[to] += 7
            rows += [(i + 1, source, balance[source]), (i + 1, to, balance[to])]
        return self.spark.createDataFrame(rows, "event bigint, account bigint, balance bigint")


#: Samples of one counter with a reset, a clock that goes back, and two samples at one time. Fixed values.
COUNTER_EDGE = [(1, 1000000, 100), (1, 2000000, 200), (1, 3000000, 500), (1, 4000000, 1), (2, 2000000, 100), (2, 1000000, 300), (3, 1000000, 100), (3, 1000000, 900)]
#: Keys, versions, kinds and values in hexadecimal that stand at edges of the order. Fixed values.
KV_EDGE = [
    ("", 1, 1, "61"), ("00", 2, 1, ""), ("00", 3, 0, None), ("0000", 2, 1, "62"), ("7f", 5, 3, "63"), ("7f", 5, 2, None),
    ("7f", 4, 1, "64"), ("80", 6, 1, "65"), ("80", 6, 3, "66"), ("ff", 7, 1, ""), ("ff", 6, 0, None), ("ff", 5, 1, "67"),
]

ORACLE = """WITH RECURSIVE
nn AS (SELECT max(user_id) + 1 AS n FROM events),
ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, lpad(CAST(user_id AS VARCHAR), 6, '0') AS k,
  (epoch_us(ts) // 1000) * 65536 + event_id % 65536 AS ts, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
versions AS (
  SELECT k, ts, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 3 ELSE 1 END AS kind,
    CASE WHEN event_type <> 'error' THEN cents END AS value, CASE WHEN event_type = 'signup' THEN event_id END AS txn_id, event_id FROM ev
  UNION ALL SELECT k, ts, 1, cents, NULL, event_id FROM ev WHERE event_type = 'signup' AND event_id % 3 = 0
  UNION ALL SELECT k, ts, 2, NULL, NULL, event_id FROM ev WHERE event_type = 'signup' AND event_id % 3 = 1),
txns AS (SELECT event_id AS txn_id, CASE WHEN event_id % 3 = 0 OR event_id % 9 = 5 THEN 2 WHEN event_id % 3 = 1 OR event_id % 9 = 8 THEN 3 ELSE 1 END AS status,
  ts - 3932160000 AS read_ts, ts AS commit_ts, CAST(1 AS BIGINT) AS epoch FROM ev WHERE event_type = 'signup'),
ow AS (SELECT o_orderkey AS txn_id, (1704067200000 + (o_orderkey * 172800) % 2592000000) * 65536 AS read_ts, o_custkey AS c,
  CAST(round(o_totalprice * 100) AS BIGINT) AS total, o_orderstatus = 'F' AS gone, n FROM orders, nn),
txn_writes AS (
  SELECT txn_id, 1 AS seq, read_ts, lpad(CAST(c % n AS VARCHAR), 6, '0') AS k, CASE WHEN NOT gone THEN total END AS value, gone AS is_delete FROM ow
  UNION ALL SELECT txn_id, 2, read_ts, lpad(CAST((c * 7 + 3) % n AS VARCHAR), 6, '0'), total + 1, false FROM ow),
catalog AS (SELECT CAST(i AS BIGINT) AS range_id, CAST(1 AS BIGINT) AS generation, CASE WHEN i > 1 THEN lpad(CAST(n * (i - 1) // 4 AS VARCHAR), 6, '0') END AS start_key,
  CASE WHEN i < 4 THEN lpad(CAST(n * i // 4 AS VARCHAR), 6, '0') END AS end_key FROM nn, range(1, 5) r(i)),
log AS (SELECT event_id + 1 AS idx, event_id // 1000 + 1 AS term, CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS entry_type,
  CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS command_type, k, ts FROM ev),
hours AS (SELECT user_id % 4 + 1 AS range_id, user_id % 3 + 1 AS replica_id, us // 3600000000 * 3600000000 AS at_us,
  count(*) FILTER (event_type IN ('click', 'view')) AS r, count(*) FILTER (event_type IN ('purchase', 'signup')) AS w, count(*) AS q FROM ev GROUP BY ALL),
counter_samples AS (SELECT range_id, replica_id, (range_id + replica_id) % 5 + 1 AS node_id, at_us, CAST(sum(r) OVER x AS BIGINT) AS reads, CAST(sum(w) OVER x AS BIGINT) AS writes,
  CAST(sum(q) OVER x AS BIGINT) AS requests FROM hours WINDOW x AS (PARTITION BY range_id, replica_id ORDER BY at_us)),
node_metrics AS (SELECT CAST(s_nationkey AS BIGINT) AS node_id, count(DISTINCT s_suppkey) AS hosted_replicas, count(DISTINCT CASE WHEN s_acctbal > 0 THEN s_suppkey END) AS leaders,
  CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS logical_bytes, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS write_rate, count(*) AS read_rate,
  CAST(sum(l_linenumber) AS BIGINT) AS apply_backlog FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1),
file_stats AS (SELECT CASE WHEN event_id < 2000 THEN 1000 + user_id * 4 // n ELSE (event_id - 2000) // 500 + 1 END AS file_number, CASE WHEN event_id < 2000 THEN 1 ELSE 0 END AS level,
  min(k) AS smallest_user, max(k) AS largest_user, min(ts) AS smallest_version, max(ts) AS largest_version, count(*) AS entries, count(*) FILTER (event_type = 'error') AS deletions FROM ev, nn GROUP BY 1, 2),
lineage AS (SELECT CAST(i AS BIGINT) AS parent_id, CAST(c AS BIGINT) AS child_id FROM range(1, 16) r(i), LATERAL (SELECT unnest([i * 2, i * 2 + 1]) AS c)),
counter_edge AS (SELECT * FROM (VALUES @COUNTER) v(id, at_us, reads)),
kv_edge AS (SELECT unhex(k) AS key, CAST(ts AS BIGINT) AS ts, kind, unhex(v) AS value FROM (VALUES @KV) v(k, ts, kind, v)),
moves AS (SELECT CAST(i AS BIGINT) AS i FROM range(0, 20) r(i)),
deltas AS (SELECT 0 AS event, a AS account, 250 AS d FROM range(0, 6) r(a) UNION ALL SELECT i + 1, i % 6, -7 FROM moves UNION ALL SELECT i + 1, (i + 3) % 6, 7 FROM moves),
bank AS (SELECT CAST(event AS BIGINT) AS event, CAST(account AS BIGINT) AS account, CAST(sum(d) OVER (PARTITION BY account ORDER BY event) AS BIGINT) AS balance FROM deltas)
"""
ORACLE = ORACLE.replace("@COUNTER", ", ".join(f"(CAST({a} AS BIGINT), CAST({b} AS BIGINT), CAST({c} AS BIGINT))" for a, b, c in COUNTER_EDGE))
ORACLE = ORACLE.replace("@KV", ", ".join(f"('{k}', {ts}, {kind}, {'NULL' if v is None else repr(v)})" for k, ts, kind, v in KV_EDGE))
