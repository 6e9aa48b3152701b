"""Writes, flushes, ordered merges, compaction and what may be pruned."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.scalars import BITS_A_KEY, PROBES, probe_bits


class Conflict(RuntimeError):
    """Two different batches claim one index."""


def explode_batches(batches: DataFrame) -> DataFrame:
    """batches(batch_id, first, mutations array<struct<k, value, is_delete>>): the i-th mutation has sequence first + i."""
    rows = batches.select("batch_id", "first", F.posexplode("mutations").alias("i", "m"))
    kind = F.when(F.col("m.is_delete"), 0).otherwise(1)
    return rows.select("batch_id", (F.col("first") + F.col("i")).alias("seq"), F.col("m.k").alias("k"), kind.alias("kind"), F.when(kind == 1, F.col("m.value")).alias("value"))


def batch_faults(rows: DataFrame, longest_key: int = 1 << 20) -> DataFrame:
    """Rows of versions that break a rule: kind, size, a value where none may be, or none where one must."""
    fault = (
        F.when(~F.col("kind").between(0, 3), "kind")
        .when((F.length("k") == 0) | (F.length("k") > longest_key), "key size")
        .when(F.col("kind").isin(0, 2) & F.col("value").isNotNull(), "marker with value")
        .when(F.col("kind").isin(1, 3) & F.col("value").isNull(), "no value")
    )
    return rows.withColumn("fault", fault).where("fault IS NOT NULL")


def apply_once(batches: DataFrame) -> DataFrame:
    """idx, digest, copies and outcome of batches(idx, term, digest): applied once, or a conflict of contents."""
    each = F.struct("term", "digest")
    return batches.groupBy("idx").agg(F.count(F.lit(1)).alias("copies"), F.when(F.countDistinct(each) > 1, "conflict").otherwise("applied").alias("outcome"))


def order_faults(log: DataFrame, by: list[str]) -> DataFrame:
    """Entries of log(arrival, idx, ts, ...) at or below an index, or a version, that arrived before them within a group."""
    w = Window.partitionBy(*by).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    top = log.withColumns({"_i": F.max("idx").over(w), "_t": F.max("ts").over(w)})
    fault = F.when(F.col("idx") < F.col("_i"), "late").when(F.col("idx") == F.col("_i"), "repeated").when(F.col("ts") <= F.col("_t"), "version went back")
    return top.withColumn("fault", fault).where("fault IS NOT NULL").drop("_i", "_t")


def last_write(rows: DataFrame) -> DataFrame:
    """Of rows with the same (k, ts, kind) the one written last, by seq."""
    rank = F.row_number().over(Window.partitionBy("k", "ts", "kind").orderBy(F.desc("seq")))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def flush(versions: DataFrame, path: str, files: int) -> DataFrame:
    """Writes versions as files that are sorted and disjoint by key, and checks what was written."""
    cols = ["k", "ts", "kind", "value"]
    dealt = versions.select(cols).repartitionByRange(files, "k").sortWithinPartitions("k", F.desc("ts"), "kind")
    dealt.write.mode("overwrite").parquet(path)
    back = versions.sparkSession.read.parquet(path)
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)"))).first()
    if mark(back) != mark(versions):
        raise RuntimeError("what was written is not what was given")
    return back


def rotate(batches: DataFrame, limit: int, by: str) -> DataFrame:
    """The table of each of batches(by, seq, size): one closes once its size has reached the limit, after the whole batch."""
    schema = f"`{by}` {batches.schema[by].dataType.simpleString()}, seq bigint, generation bigint"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        total, number, out = 0, 0, []
        pdf = pdf.sort_values("seq")
        for size in pdf["size"]:
            out.append(number)
            total += size
            if total >= limit:
                total, number = 0, number + 1
        return pd.DataFrame({by: pdf[by], "seq": pdf["seq"], "generation": out})

    return batches.groupBy(by).applyInPandas(fold, schema)


def merge(*inputs: DataFrame) -> DataFrame:
    """All rows of inputs(file_number, k, ts, kind, value) in canonical order, ties by file; none is dropped."""
    out = inputs[0]
    for more in inputs[1:]:
        out = out.unionByName(more)
    return out.orderBy("k", F.desc("ts"), "kind", "file_number")


def overlaps(a: str, b: str):
    return (F.col(f"{a}.smallest_user") <= F.col(f"{b}.largest_user")) & (F.col(f"{b}.smallest_user") <= F.col(f"{a}.largest_user"))


def pick_compaction(files: DataFrame, trigger: int = 4) -> DataFrame:
    """Files to compact: from the oldest of level 0, all of levels 0 and 1 that overlap the span, until it grows no more.

    No file is picked below the trigger. The span of all picked files is one interval, so
    each round needs only its two bounds; rounds end when no file is added.
    """
    near = files.where("level <= 1")
    if near.where("level = 0").count() < trigger:
        return near.limit(0)
    lo, hi = near.where("level = 0").orderBy("file_number").select("smallest_user", "largest_user").first()
    while True:
        picked = near.where((F.col("smallest_user") <= hi) & (F.col("largest_user") >= lo))
        new = picked.agg(F.min("smallest_user"), F.max("largest_user")).first()
        if tuple(new) == (lo, hi):
            return picked
        lo, hi = new


def compact(inputs: DataFrame, target: int) -> DataFrame:
    """Rows of inputs(k, ts, kind, value) with an output number; a key is in one output, and outputs are cut by key near the target size.

    Sizes are added up over keys in order within coarse key ranges, each of which starts
    an output of its own, so that no task orders all keys. Repeated versions are an error.
    """
    rows = inputs.select("k", "ts", "kind", "value")
    if not rows.groupBy("k", "ts", "kind").count().where("count > 1").isEmpty():
        raise Conflict("a version stands in two inputs")
    size = rows.groupBy("k").agg(F.sum(F.length("k") + 9 + F.when(F.col("value").isNull(), 0).otherwise(8)).alias("size"))
    w = Window.partitionBy("stripe").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("stripe", F.substring("k", 1, 4))
    number = F.floor(F.coalesce(F.sum("size").over(w), F.lit(0)) / target)
    return rows.join(size.select("k", F.concat_ws("-", "stripe", number.cast("string")).alias("output")), "k")


def prune_point(files: DataFrame, key: str) -> DataFrame:
    """Files that may hold a key: all of level 0 that span it, at most one of each deeper level."""
    return files.where((F.col("smallest_user") <= key) & (F.col("largest_user") >= key))


def prune_span(files: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if end is not None:
        files = files.where(F.col("smallest_user") < end)
    return files if start is None else files.where(F.col("largest_user") >= start)


def frontier(done: DataFrame) -> DataFrame:
    """The largest n such that done(seq) holds 1..n, by runs of consecutive numbers."""
    runs = done.select("seq").distinct()
    gaps = runs.select((F.col("seq") + 1).alias("seq")).join(runs, "seq", "left_anti")
    start = runs.where("seq = 1").agg(F.count(F.lit(1)).alias("has"))
    return gaps.where("seq > 1").agg(F.min("seq").alias("gap")).join(F.broadcast(start)).select(F.when(F.col("has") > 0, F.col("gap") - 1).otherwise(F.lit(0)).cast("bigint").alias("frontier"))


def fold_edits(edits: DataFrame) -> DataFrame:
    """Live files after edits(file_number, seq, added): the last event of each counts."""
    return edits.groupBy("file_number").agg(F.max_by("added", "seq").alias("live")).where("live").select("file_number")


def bloom_keys(versions: DataFrame, probes: DataFrame) -> DataFrame:
    """Which of probes(k) may be among the keys: a bitmap of set positions by hash, joined on position.

    The bitmap has ten bits for each distinct key of all versions, in whole bytes and 64 at least, and seven
    probes a key. Positions are kept as rows, so that the filter is as large as the data and
    not broadcast.
    """
    keys = versions.select("k").distinct()
    bits = max(64, -(-BITS_A_KEY * keys.count() // 8) * 8)
    at = lambda df: df.select("k", F.explode(probe_bits(F.col("k"), bits)).alias("bit"))
    set_ = at(keys).select("bit").distinct().withColumn("is_set", F.lit(1))
    return at(probes.distinct()).join(set_, "bit", "left").groupBy("k").agg((F.count("is_set") == PROBES).alias("may_contain"))
