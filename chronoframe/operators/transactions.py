"""Snapshot-isolation transactions over versions, txns and txn_writes."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.scalars import ABORT, DELETE, INTENT, VALUE
from chronoframe.operators.visibility import select_as_of, span
from chronoframe.sources.shared import keep

PENDING, COMMITTED, ABORTED = 1, 2, 3


class Corrupt(RuntimeError):
    """A provisional version without its transaction's record."""


def interpret(versions: DataFrame, txns: DataFrame, target: int, start=None, end=None) -> DataFrame:
    """k, value, ts, conflict: what a transaction reading at the target sees.

    Provisional versions of transactions that aborted or committed later are left out
    below the windows, so that older versions show; those of pending ones are conflicts;
    those of committed ones count as their values. orphan: no record was found.
    """
    df = span(versions, start, end).where(F.col("ts") <= target)
    home = txns.select("txn_id", F.col("status").alias("_status"), F.col("commit_ts").alias("_commit"))
    intent = F.col("kind") == INTENT
    df = df.join(home, "txn_id", "left")
    hidden = intent & ((F.col("_status") == ABORTED) | ((F.col("_status") == COMMITTED) & (F.col("_commit") > target)))
    chosen = select_as_of(df.where(~F.coalesce(hidden, F.lit(False))), target)
    conflict = intent & (F.col("_status") == PENDING)
    out = chosen.where(f"kind != {DELETE}").select("k", F.when(~F.coalesce(conflict, F.lit(False)), F.col("value")).alias("value"), "ts", F.coalesce(conflict, F.lit(False)).alias("conflict"), (intent & F.col("_status").isNull()).alias("orphan"))
    return out


def buffered(writes: DataFrame, *also: str) -> DataFrame:
    """The last write of each key of a transaction: txn_id, k, value, is_delete, and columns that have one value for these two.

    Rows are dealt by transaction before they are grouped: hardly any key is written
    twice, so that groups of what a task scans would hold all of it at once. What a caller
    groups by transaction stays where it is.
    """
    last = [F.max_by(c, "seq").alias(c) for c in ("value", "is_delete")]
    width = int(writes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that tasks are not put together
    return writes.repartition(width, "txn_id").groupBy("txn_id", "k", *also).agg(*last).select("txn_id", "k", "value", "is_delete", *also)


def overlay(base: DataFrame, writes: DataFrame, start=None, end=None) -> DataFrame:
    """base(k, value) with one transaction's buffered writes over it; deletions take rows away."""
    own = span(writes.select("k", F.col("value").alias("_value"), "is_delete"), start, end)
    both = base.select("k", "value").join(own, "k", "full_outer")
    wrote = F.col("is_delete").isNotNull()
    return both.where(~F.coalesce("is_delete", F.lit(False))).select("k", F.when(wrote, F.col("_value")).otherwise(F.col("value")).alias("value"))


def conflicts(versions: DataFrame, writes: DataFrame) -> DataFrame:
    """Each write with whether preparing it must be refused: its key's newest version is an intent or lies after the read time.

    The newest version is the one that select_as_of chooses, found by grouping instead of sorting.
    """
    first = versions.select("k", "ts", "kind").repartition("k", "ts").groupBy("k", "ts").agg(F.min("kind").alias("kind")).where(f"kind != {ABORT}")
    newest = first.groupBy("k").agg(F.max_by("kind", "ts").alias("_kind"), F.max("ts").alias("_ts"))
    joined = writes.join(newest, "k", "left")
    refused = (F.col("_kind") == INTENT) | (F.col("_ts") > F.col("read_ts"))
    return joined.withColumn("refused", F.coalesce(refused, F.lit(False))).drop("_kind", "_ts")


def decisions(prepared: DataFrame) -> DataFrame:
    """Committed exactly if all participants of prepared(txn_id, range_id, prepared) are."""
    return prepared.groupBy("txn_id").agg(F.when(F.bool_and("prepared"), COMMITTED).otherwise(ABORTED).alias("status"))


def resolve(writes: DataFrame) -> DataFrame:
    """Versions that settle the intents of writes(txn_id, k, value, is_delete, prepared, status, commit_ts): nothing for refused participants."""
    kind = F.when(F.col("status") == ABORTED, ABORT).when(F.col("is_delete"), DELETE).otherwise(VALUE)
    return writes.where("prepared").select("k", F.col("commit_ts").alias("ts"), kind.alias("kind"), F.when(kind == VALUE, F.col("value")).alias("value"), "txn_id")


class TooLarge(RuntimeError):
    """More records than one recovery takes."""


def recover(txns: DataFrame, most: int | None = 4096) -> DataFrame:
    """Pending records are aborted in the next epoch.

    A recovery of more records than the most is refused as a whole; None lifts the bound.
    """
    if most is not None and txns.limit(most + 1).count() > most:
        raise TooLarge(f"more than {most} records")
    pending = F.col("status") == PENDING
    return txns.withColumns({"epoch": F.when(pending, F.col("epoch") + 1).otherwise(F.col("epoch")), "status": F.when(pending, ABORTED).otherwise(F.col("status"))})


def close(txns: DataFrame) -> DataFrame:
    """Outcome of aborting each transaction: pending becomes aborted, aborted stays, committed refuses."""
    outcome = F.when(F.col("status") == COMMITTED, "refused").when(F.col("status") == ABORTED, "unchanged").otherwise("aborted")
    return txns.select("txn_id", outcome.alias("outcome"), F.when(F.col("status") == PENDING, ABORTED).otherwise(F.col("status")).alias("status"))


_WRITE = "stretch int, commit_ts bigint, txn_id bigint, read_ts bigint, k string, done bigint, open bigint"
_SCHEMA = pa.schema([(n, pa.int32() if n == "stretch" else pa.string() if n == "k" else pa.int64()) for n in [x.split()[0] for x in _WRITE.split(", ")]])
#: Stands for no commit time.
_NEVER = -(2**63)


def _decide(batches, fresh: bool):
    """Rows of _WRITE with their state, done with the committed writers before them in their stretch, and whether they are their transaction's first.

    Stretches are whole and sorted, and so are their transactions. In a fresh table nothing is
    known of earlier stretches, so that what was read before a stretch's first commit waits.
    Holds the last committed and the last undecided writer of the keys of one stretch.
    """
    done, waiting, stretch, floor = {}, {}, None, _NEVER

    def decided(rows, starts):
        nonlocal done, waiting, stretch, floor
        at, commit, read, keys = (rows.column(n).to_pylist() for n in ("stretch", "commit_ts", "read_ts", "k"))
        known, opened = (pc.fill_null(rows.column(n), _NEVER).to_pylist() for n in ("done", "open"))
        states, first = [], np.zeros(len(keys), bool)
        first[starts] = True
        for i, j in zip(starts, [*starts[1:], len(keys)]):
            if at[i] != stretch:
                done, waiting, stretch, floor = {}, {}, at[i], commit[i] if fresh and at[i] else _NEVER
            state = COMMITTED
            for x in range(i, j):
                last, after = done.get(keys[x], _NEVER), read[x]
                if last > known[x]:
                    known[x] = last
                if known[x] > after:
                    state = ABORTED
                    break
                if floor > after or opened[x] > after or waiting.get(keys[x], _NEVER) > after:
                    state = PENDING
            if state != ABORTED:
                (done if state == COMMITTED else waiting).update(dict.fromkeys(keys[i:j], commit[i]))
            states += [state] * (j - i)
        kept = [rows.column(n) for n in _SCHEMA.names]
        kept[5] = pa.array(known, pa.int64())
        return pa.RecordBatch.from_arrays([*kept, pa.array(states, pa.int32()), pa.array(first)], names=[*_SCHEMA.names, "state", "first"])

    rest = None
    for b in batches:
        rows = pa.Table.from_batches([b]).cast(_SCHEMA)
        rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
        if not rows.num_rows:
            continue
        rows = rows.to_batches()[0]
        ids = [rows.column(i).to_numpy() for i in range(3)]
        starts = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1).tolist()]
        whole = starts.pop()  # the last transaction may go on in the next batch
        rest = pa.Table.from_batches([rows.slice(whole)])
        if starts:
            yield decided(rows.slice(0, whole), starts)
    if rest is not None:
        yield decided(rest.combine_chunks().to_batches()[0], [0])


def _with_earlier(found: DataFrame, merged: int) -> DataFrame:
    """Undecided rows as _WRITE in stretches of so many of the old ones, with the greatest commit times of their keys' writers in earlier stretches.

    Committed writers are those of earlier old stretches, undecided ones those of earlier new stretches.
    They come from one row for each key and stretch, so that a hot key's rows never meet.
    """
    last = lambda state: F.max(F.when(F.col("state") == state, F.col("commit_ts")))
    new = F.expr(f"stretch div {merged}").cast("int")
    before = lambda c: Window.partitionBy("k").orderBy(c).rangeBetween(Window.unboundedPreceding, -1)
    ends = found.groupBy("k", "stretch").agg(last(COMMITTED).alias("c"), last(PENDING).alias("o")).withColumn("new", new)
    ends = ends.select(F.col("k").alias("k2"), F.col("stretch").alias("s2"), F.max("c").over(before("stretch")).alias("c"), F.max("o").over(before("new")).alias("open"))
    same = F.col("k").eqNullSafe(F.col("k2")) & (F.col("stretch") == F.col("s2"))
    rows = found.where(F.col("state") == PENDING).drop("open").join(ends, same)
    return rows.withColumns({"done": F.greatest("done", "c"), "stretch": new}).select(*_SCHEMA.names)


#: Mean times from read to commit that a stretch spans at least, and stretches that become one in a round.
SPAN, MERGED = 8, 4


def first_committer_wins(writes: DataFrame) -> DataFrame:
    """txn_id and committed of writes(txn_id, read_ts, commit_ts, k), in order of commit, ties by id.

    A transaction aborts if a key that it writes has a version after its read time from one
    that committed before it. The order is cut into stretches, and a task decides the
    transactions of a stretch one after another. One is refused if a key has a committed
    writer after its read time, waits if it has an undecided one, there or in an earlier
    stretch, and else commits. What waits goes into the next round with the greatest commit
    times of its keys, in stretches of four old ones: the first stretch is always decided
    whole, so the last round has but one, and rounds are as many as the logarithm to base four
    of the stretches, and one.
    There are at most as many stretches as a shuffle has partitions, and so few that one
    spans eight mean times from read to commit: in shorter ones nearly all would wait.
    Repeated rows count once; a transaction has one read time and one commit time.
    """
    order = ["commit_ts", "txn_id"]
    rows = writes.select("commit_ts", "txn_id", "read_ts", F.col("k").cast("string").alias("k"))
    commit = F.col("commit_ts").cast("double")
    took, span = rows.agg(F.avg(commit - F.col("read_ts")), F.max(commit) - F.min(commit)).first()
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if took and took > 0:
        width = max(1, min(width, int(span / (took * SPAN))))
    none = F.lit(None).cast("bigint")
    dealt = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumns({"stretch": F.spark_partition_id(), "done": none, "open": none}).select(*_SCHEMA.names)
    decided = None
    while True:
        found = keep(dealt.mapInArrow(partial(_decide, fresh=decided is None), _WRITE + ", state int, first boolean"))
        new = found.where((F.col("state") != PENDING) & F.col("first")).select("txn_id", (F.col("state") == COMMITTED).alias("committed"))
        decided = new if decided is None else decided.unionByName(new)
        if width == 1 or found.where(F.col("state") == PENDING).isEmpty():
            return decided
        width = -(-width // MERGED)
        dealt = _with_earlier(found, MERGED).repartition(width, "stretch").sortWithinPartitions("stretch", *order)


def status_of(ids: DataFrame, active: DataFrame, archived: DataFrame) -> DataFrame:
    """The record of each id, from active ranges first, then from archives."""
    both = active.select("txn_id", "status", F.lit(0).alias("_order")).unionByName(archived.select("txn_id", "status", F.lit(1).alias("_order")))
    rank = F.row_number().over(Window.partitionBy("txn_id").orderBy("_order", "status"))
    return ids.join(both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_order"), "txn_id", "left")
