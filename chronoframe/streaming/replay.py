"""Replay of ordered logs: as batches, and as a stream with state by range."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType


def dispositions(log: DataFrame, by: list[str], durable: int = 0) -> DataFrame:
    """Adds outcome for entries of log(arrival, idx, ts, ...): durable, no-op, late, version went back or applied.

    An entry is held against all that arrived before it in its group.
    """
    w = Window.partitionBy(*by).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    top = log.withColumns({"_i": F.max("idx").over(w), "_t": F.max("ts").over(w)})
    outcome = (
        F.when(F.col("idx") <= durable, "durable").when(F.col("idx") == F.col("_i"), "no-op").when(F.col("idx") < F.col("_i"), "late").when(F.col("ts") <= F.col("_t"), "version went back").otherwise("applied")
    )
    return top.withColumn("outcome", outcome).drop("_i", "_t")


def watermarks(log: DataFrame, barriers: DataFrame, by: list[str]) -> DataFrame:
    """The greatest applied version of each group and its safe read time, which barriers raise."""
    applied = log.groupBy(*by).agg(F.max("ts").alias("applied"))
    raised = barriers.groupBy(*by).agg(F.max("ts").alias("_b"))
    return applied.join(raised, by, "left").withColumn("safe_read", F.greatest("applied", "_b")).drop("_b")


def clock(events: DataFrame, by: list[str]) -> DataFrame:
    """The hybrid timestamps that a clock gives for events(by..., seq, ms): max(physical, last + 1).

    max(ms_j * 65536 + (i - j)) over all earlier j is the same number as the fold gives, so
    a running maximum replaces it and no group is gathered.
    """
    w = Window.partitionBy(*by).orderBy("seq")
    n = F.row_number().over(w)
    df = events.withColumn("_n", n)
    return df.withColumn("hlc", F.max(F.col("ms") * 65536 - F.col("_n")).over(w) + F.col("_n")).drop("_n")


def observe(events: DataFrame, by: list[str]) -> DataFrame:
    """The greatest timestamp seen so far."""
    return events.withColumn("observed", F.max("ts").over(Window.partitionBy(*by).orderBy("seq")))


def replay_batches(batches: DataFrame, frontier: int) -> DataFrame:
    """batches(first, last, ...) with outcome: skipped below the frontier, rejected across it, replayed after it."""
    outcome = F.when(F.col("last") <= frontier, "skipped").when(F.col("first") <= frontier, "rejected").otherwise("replayed")
    return batches.withColumn("outcome", outcome)


def fair_order(messages: DataFrame, group: str) -> DataFrame:
    """Messages of groups in turn: the n-th of each group before the n+1-th of any."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy("seq"))
    return messages.withColumn("turn", turn).orderBy("turn", group)


class Applier(StatefulProcessor):
    """Keeps the last applied index and version of a key; emits each entry with its outcome."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("top", StructType([StructField("idx", LongType()), StructField("ts", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        found = self.state.get() if self.state.exists() else None
        idx, ts = found if found is not None else (0, -1)
        for pdf in rows:
            out = []
            for row in pdf.sort_values("idx").itertuples():
                outcome = "no-op" if row.idx == idx else "late" if row.idx < idx else "version went back" if row.ts <= ts else "applied"
                if outcome == "applied":
                    idx, ts = int(row.idx), int(row.ts)
                out.append((key[0], int(row.idx), outcome))
            self.state.update((idx, ts))
            yield pd.DataFrame(out, columns=["k", "idx", "outcome"])

    def close(self) -> None:
        pass


class Sampler(StatefulProcessor):
    """Keeps the last sample of a counter; emits each sample's rate by second, 0 after a reset."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("last", StructType([StructField("at_us", LongType()), StructField("reads", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        last = self.state.get() if self.state.exists() else None
        for pdf in rows:
            out = []
            for row in pdf.sort_values("at_us").itertuples():
                at, reads = int(row.at_us), int(row.reads)
                if last is not None and at == last[0]:
                    continue
                good = last is not None and at > last[0] and reads >= last[1]
                out.append((*key, at, (reads - last[1]) * 1_000_000 // (at - last[0]) if good else 0))
                last = (at, reads)
            if last is not None:
                self.state.update(last)
            yield pd.DataFrame(out, columns=["range_id", "replica_id", "at_us", "reads_rate"])

    def close(self) -> None:
        pass


def apply_stream(log: DataFrame) -> DataFrame:
    """Outcome of each entry of a stream log(k, idx, ts), with state by key."""
    return log.groupBy("k").transformWithStateInPandas(Applier(), "k string, idx bigint, outcome string", "Append", "None")


def sample_stream(samples: DataFrame) -> DataFrame:
    """Rates of a stream of samples(range_id, replica_id, at_us, reads), with state by counter."""
    return samples.groupBy("range_id", "replica_id").transformWithStateInPandas(Sampler(), "range_id bigint, replica_id bigint, at_us bigint, reads_rate bigint", "Append", "None")


def drain(rows: DataFrame, build, folder: str) -> DataFrame:
    """Rows of a stream over a table: written to a shared folder, streamed to its end, read back."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows.write.parquet(f"{folder}/in")
    out = build(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
    out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")
