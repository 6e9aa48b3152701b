"""As-of reads over versions(k, ts, kind, value, ...).

Per key the newest version not after a time is chosen; of versions at one time that of
the lowest kind counts, and where that is an abort the time is passed over. The time is
always applied below the windows: above them it would change the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.scalars import ABORT, DELETE, INTENT, VALUE
from chronoframe.sources.shared import keep


class IntentFound(RuntimeError):
    """A scan met a provisional version."""


def span(df: DataFrame, start=None, end=None, key: str = "k") -> DataFrame:
    """Rows with start <= key < end; None is open; equal bounds are empty; reversed ones are an error."""
    if start is not None and end is not None and start > end:
        raise ValueError("the end of a range lies before its start")
    if start is not None:
        df = df.where(F.col(key) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(key) < F.lit(end))
    return df


def clamp(target: int, latest: int | None) -> int | None:
    """The time that a read uses: never after the latest version; None if there is none."""
    return None if latest is None else min(target, latest)


def select_as_of(versions: DataFrame, target: int | None = None, start=None, end=None) -> DataFrame:
    """One uninterpreted version for each key that has one at the target."""
    df = span(versions, start, end)
    if target is not None:
        df = df.where(F.col("ts") <= target)
    first = F.row_number().over(Window.partitionBy("k", "ts").orderBy("kind"))
    df = df.withColumn("_rank", first).where(f"_rank = 1 AND kind != {ABORT}")
    newest = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("ts")))
    return df.withColumn("_rank", newest).where("_rank = 1").drop("_rank")


def get_mvcc(versions: DataFrame, key, target: int | None = None) -> DataFrame:
    """select_as_of for one key: the filter reaches the scan."""
    return select_as_of(versions.where(F.col("k") == F.lit(key)), target)


def report_scan(versions: DataFrame, target: int | None = None, start=None, end=None) -> DataFrame:
    """Live values; provisional versions stand as rows with conflict true."""
    chosen = select_as_of(versions, target, start, end).where(f"kind != {DELETE}")
    conflict = F.col("kind") == INTENT
    return chosen.select("k", F.when(~conflict, F.col("value")).alias("value"), "ts", conflict.alias("conflict"))


def scan(versions: DataFrame, target: int | None = None, start=None, end=None) -> DataFrame:
    """Live values (k, value, ts); any provisional version in the span fails the scan."""
    found = report_scan(versions, target, start, end)
    if not found.where("conflict").isEmpty():
        raise IntentFound("a provisional version is visible")
    return found.where("NOT conflict").select("k", "value", "ts")


def get(versions: DataFrame, key, target: int | None = None) -> DataFrame:
    """The live value of one key, or no row."""
    return scan(versions.where(F.col("k") == F.lit(key)), target)


def duplicates(versions: DataFrame, source: str) -> DataFrame:
    """(k, ts, kind) that stand more than once: in how many sources, with how many values."""
    value = F.struct(F.col("value"))
    return versions.groupBy("k", "ts", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(source).alias("sources"), F.countDistinct(value).alias("contents")).where("n > 1")


def canonical(df: DataFrame):
    """Key rising, version falling, kind rising."""
    return df.orderBy("k", F.desc("ts"), "kind")


def export(versions: DataFrame) -> DataFrame:
    """Every distinct version."""
    return versions.select("k", "ts", "kind", "value").dropDuplicates()


def behind(watermarks: DataFrame, target: int) -> DataFrame:
    """Replicas of watermarks(applied, safe_read, shadow, ...) that cannot serve the target, with the reason."""
    late = F.lit(target) > F.greatest("applied", "safe_read")
    return watermarks.withColumn("reason", F.when(F.col("shadow"), "not serving").when(late, "behind")).where("reason IS NOT NULL")


class Snapshot:
    """Reads at one time. A time after the greatest applied version is refused; 0 is an empty history."""

    def __init__(self, versions: DataFrame, target: int, applied: int):
        if target > applied:
            raise ValueError("the snapshot's time has not been applied")
        self.target = target
        self.versions = versions.where(F.col("ts") <= target)

    def get(self, key) -> DataFrame:
        return get(self.versions, key, self.target)

    def scan(self, start=None, end=None) -> DataFrame:
        return report_scan(self.versions, self.target, start, end)


def oldest_protected(*holders: DataFrame) -> DataFrame:
    """The least ts among tables of open snapshots and transactions."""
    out = holders[0].select("ts")
    for more in holders[1:]:
        out = out.unionByName(more.select("ts"))
    return out.agg(F.min("ts").alias("oldest"))


def seek(versions: DataFrame, key, ts: int, kind: int) -> DataFrame:
    """The first version at or after a target in canonical order."""
    k = F.col("k")
    after = (k > F.lit(key)) | ((k == F.lit(key)) & ((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("kind") >= kind))))
    return canonical(versions.where(after)).limit(1)


def exact(versions: DataFrame, key, ts: int, kind: int) -> DataFrame:
    return versions.where((F.col("k") == F.lit(key)) & (F.col("ts") == ts) & (F.col("kind") == kind))


def candidate(versions: DataFrame, key, target: int) -> DataFrame:
    """The newest version of a key at or before a target, deletions too."""
    return canonical(versions.where((F.col("k") == F.lit(key)) & (F.col("ts") <= target))).limit(1)


def live_kinds() -> tuple[int, int]:
    return DELETE, VALUE


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with their rank from 1 in an order of all of them.

    Rows are dealt to ranges of the order and kept as a table; a rank is a place within a
    range and the sizes of the ranges before, of which there is one row a range.
    """
    kept = keep(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return kept.join(F.broadcast(offsets), "_range").withColumn("rank", place + F.col("_before")).drop("_range", "_before")
