"""Scores, potentials, and the choice of splits, leader transfers and moves.

A cluster has at most 1,024 nodes and 4,096 ranges of 31 replicas, so candidates are
enumerated by joins of tables whose sizes have those bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.scalars import add_sat, mul_div

#: The most nodes of a cluster.
MAX_NODES = 1024

SCALE = 1_000_000


@dataclass(frozen=True)
class Policy:
    """Weights, thresholds and limits of planning. The defaults are fixed values."""

    version: int = 1
    alpha: int = 250_000
    min_samples: int = 3
    start_ppm: int = 200_000
    recovery_ppm: int = 100_000
    node_weights: tuple = (("logical_bytes", 4), ("write_rate", 3), ("read_rate", 2), ("leaders", 2), ("apply_backlog", 2), ("hosted_replicas", 1))
    range_weights: tuple = (("logical_bytes", 4), ("write_rate", 3), ("read_rate", 2), ("apply_backlog", 2))
    split_bytes: int = 64 << 20
    hot_reads: int = 10_000
    hot_writes: int = 5_000
    min_bytes: int = 1 << 20
    min_improvement: int = 1
    max_actions: int = 1
    max_in: int = 1
    max_out: int = 1
    max_replicas: int = 0
    max_bytes: int = 0
    max_writes: int = 0
    max_leaders: int = 0

    def faults(self) -> list[str]:
        """What makes the policy unusable."""
        rules = {
            "version": self.version > 0,
            "alpha": 0 < self.alpha <= SCALE,
            "samples": self.min_samples > 0,
            "thresholds": self.start_ppm > self.recovery_ppm,
            "node weights": sum(w for _, w in self.node_weights) > 0,
            "range weights": sum(w for _, w in self.range_weights) > 0,
            "sizes": 0 < self.min_bytes <= self.split_bytes,
            "actions": self.max_actions > 0 and self.max_in > 0 and self.max_out > 0,
        }
        return [name for name, ok in rules.items() if not ok]


def _weighted(value: Column, total: Column, count: Column, weight: int) -> Column:
    return mul_div(value, count * SCALE, total) * weight


def score(nodes: DataFrame, policy: Policy, by: list[str] | None = None) -> DataFrame:
    """Adds score: the share of each metric in its total, as millionths of a node's fair share, cut to whole numbers and weighted.

    Totals are over all nodes, unhealthy ones too.
    """
    w = Window.partitionBy(*(by or [F.lit(0)])).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count(F.lit(1)).over(w)
    total = F.lit(0)
    for metric, weight in policy.node_weights:
        total = total + _weighted(F.col(metric), F.sum(metric).over(w), n, weight)
    return nodes.withColumn("score", total.cast("bigint"))


def potential(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sum of squared distances of scores from their mean, cut to a whole number."""
    w = Window.partitionBy(*(by or [F.lit(0)])).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = F.floor(F.sum("score").over(w) / F.count(F.lit(1)).over(w)).cast("bigint")
    d = F.col("score") - F.col("_mean")
    return scores.withColumn("_mean", mean).groupBy(*(by or [])).agg(F.sum(d * d).alias("potential"))


def load(policy: Policy) -> Column:
    """Weighted load of a range, saturating."""
    total = F.lit(0)
    for metric, weight in policy.range_weights:
        total = add_sat(total, F.col(metric) * weight)
    return total.cast("bigint")


def splits(ranges: DataFrame, policy: Policy) -> DataFrame:
    """warranted and reason for each range: too large comes before too hot."""
    ready = F.col("samples") >= policy.min_samples
    large = F.col("logical_bytes") >= policy.split_bytes
    hot = (F.col("logical_bytes") >= policy.min_bytes) & ready & ((F.col("read_rate") >= policy.hot_reads) | (F.col("write_rate") >= policy.hot_writes))
    reason = F.when(large, "RANGE_TOO_LARGE").when(hot, "RANGE_TOO_HOT")
    return ranges.select("range_id", (large | hot).alias("warranted"), reason.alias("reason"))


def median_keys(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """The middle one of the distinct keys(range_id, k), where there are two at least and it lies strictly inside the range.

    Keys are ranked within coarse stripes whose counts are added up, so that the keys of
    one range are never gathered.
    """
    own = keys.select("range_id", "k").distinct().withColumn("stripe", F.substring("k", 1, 4))
    stripes = own.groupBy("range_id", "stripe").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("range_id").orderBy("stripe")
    every = Window.partitionBy("range_id")
    placed = stripes.select("range_id", "stripe", (F.sum("n").over(w) - F.col("n")).alias("before"), "n", F.sum("n").over(every).alias("total"))
    home = placed.where((F.floor(F.col("total") / 2) >= F.col("before")) & (F.floor(F.col("total") / 2) < F.col("before") + F.col("n")) & (F.col("total") > 1))
    ranked = own.join(home, ["range_id", "stripe"]).withColumn("at", F.row_number().over(Window.partitionBy("range_id", "stripe").orderBy("k")) + F.col("before") - 1)
    found = ranked.where(F.col("at") == F.floor(F.col("total") / 2)).select("range_id", F.col("k").alias("split_key")).join(catalog.select("range_id", "start_key", "end_key"), "range_id")
    inside = (F.col("start_key").isNull() | (F.col("split_key") > F.col("start_key"))) & (F.col("end_key").isNull() | (F.col("split_key") < F.col("end_key")))
    return found.where(inside).select("range_id", "split_key")


def overloaded(scores: DataFrame, cooling: DataFrame, policy: Policy) -> DataFrame:
    """node_id, score, threshold and overloaded of the highest-scored node; one that cools down has the lower threshold."""
    weight = sum(w for _, w in policy.node_weights)
    top = scores.orderBy(F.desc("score"), "node_id").limit(1)
    cool = cooling.select("node_id", F.lit(True).alias("_cool")).distinct()
    limit = lambda ppm: weight * (SCALE + ppm)
    joined = top.join(cool, "node_id", "left").withColumn("threshold", F.when(F.col("_cool"), limit(policy.recovery_ppm)).otherwise(limit(policy.start_ppm)).cast("bigint"))
    return joined.select("node_id", "score", "threshold", (F.col("score") > F.col("threshold")).alias("overloaded"))


def without_cooldown(df: DataFrame, cooldowns: DataFrame, key: str, now: int) -> DataFrame:
    """Rows whose key has no cooldown(key, until) that lies ahead."""
    return df.join(cooldowns.where(F.col("until") > now).select(key), key, "left_anti")


def move_targets(ranges: DataFrame, replicas: DataFrame, nodes: DataFrame, policy: Policy) -> DataFrame:
    """Every (range, source, target) that may be moved.

    The source holds a healthy voter; the target is another healthy, available node that
    has warmed up, has room, and holds no replica of the range.
    """
    r = ranges.where("active AND NOT splitting AND NOT migrating").where(F.col("samples") >= policy.min_samples)
    held = replicas.where("healthy AND voter").select("range_id", "replica_id", F.col("node_id").alias("source"))
    source = nodes.where("healthy").where(F.col("migrations_out") < policy.max_out).select(F.col("node_id").alias("source"))
    t = nodes.where("healthy AND available AND NOT warming").where(F.col("migrations_in") < policy.max_in)
    if policy.max_replicas:
        t = t.where(F.col("hosted_replicas") < policy.max_replicas)
    t = t.select(F.col("node_id").alias("target"), F.col("logical_bytes").alias("_bytes"), F.col("write_rate").alias("_writes"), F.col("leaders").alias("_leaders"))
    pairs = r.join(held, "range_id").join(source, "source").join(t, F.col("source") != F.col("target"))
    for most, own, size in ((policy.max_bytes, "_bytes", "logical_bytes"), (policy.max_writes, "_writes", "write_rate")):
        if most:
            pairs = pairs.where(F.col(own) <= most - F.least(F.col(size), F.lit(most)))
    if policy.max_leaders:
        pairs = pairs.where((F.col("_leaders") < policy.max_leaders) | (F.col("leader") != F.col("source")))
    taken = replicas.select("range_id", F.col("node_id").alias("target"))
    return pairs.drop("_bytes", "_writes", "_leaders").join(taken, ["range_id", "target"], "left_anti")


def projected(candidates: DataFrame, nodes: DataFrame, policy: Policy, leader_only: bool = False) -> DataFrame:
    """range_id, source, target and the potential after each candidate, with clamped subtraction at the source.

    A move changes two nodes, so two terms of the sums of scores and of their squares are
    replaced. Only where the subtraction is clamped a total changes, and with it every score:
    those candidates are scored against all nodes, of which there are at most MAX_NODES.
    """
    keys, metrics = ["range_id", "source", "target"], [m for m, _ in policy.node_weights]
    rows = score(nodes, policy).select("node_id", "score", *metrics).limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"a cluster has at most {MAX_NODES} nodes")
    n, total = len(rows), {m: sum(r[m] for r in rows) for m in metrics}
    leads = F.lit(1) if leader_only else (F.col("leader") == F.col("source")).cast("bigint")
    delta = {m: F.lit(0).cast("bigint") if leader_only else F.col(m) for m in metrics if m not in ("leaders", "hosted_replicas")}
    delta |= {"leaders": leads, "hosted_replicas": F.lit(0 if leader_only else 1)}
    c = candidates.select(*keys, *[x.cast("bigint").alias(f"_{m}") for m, x in delta.items()])
    schema = ", ".join(f"{x} bigint" for x in ("node_id", "score", *metrics))
    known = candidates.sparkSession.createDataFrame([tuple(r) for r in rows], schema)
    ends = [known.select(F.col("node_id").alias(end), F.struct("score", *metrics).alias(f"_{end}")) for end in ("source", "target")]
    both = c.join(ends[0], "source").join(ends[1], "target")
    less = {m: F.greatest(F.col(f"_source.{m}") - F.col(f"_{m}"), F.lit(0)) for m in metrics}
    more = {m: F.col(f"_target.{m}") + F.col(f"_{m}") for m in metrics}
    clamped = F.lit(False)
    for m in metrics:
        clamped = clamped | (F.col(f"_source.{m}") < F.col(f"_{m}"))
    both = both.withColumn("_clamped", clamped)

    def scored(values):
        out = F.lit(0)
        for m, weight in policy.node_weights:
            out = out + _weighted(values[m], F.lit(total[m]).cast("bigint"), F.lit(n).cast("bigint"), weight)
        return out.cast("decimal(38,0)")

    whole = lambda x: F.lit(x).cast("decimal(38,0)")
    was, now = [F.col(f"_{end}.score").cast("decimal(38,0)") for end in ("source", "target")], ["_less", "_more"]
    near = both.where(~F.col("_clamped")).withColumns({"_less": scored(less), "_more": scored(more)})
    sums = whole(sum(r["score"] for r in rows)) - was[0] - was[1] + F.col(now[0]) + F.col(now[1])
    squares = whole(sum(r["score"] ** 2 for r in rows)) - was[0] * was[0] - was[1] * was[1] + F.col(now[0]) * F.col(now[0]) + F.col(now[1]) * F.col(now[1])
    near = near.select(*keys, sums.cast("decimal(38,0)").alias("_sum"), squares.cast("decimal(38,0)").alias("_squares"))
    near = near.withColumn("_mean", F.floor((F.col("_sum") - F.col("_sum") % n) / n).cast("decimal(19,0)"))
    value = F.col("_squares") - F.col("_mean") * F.col("_sum") * 2 + F.col("_mean") * F.col("_mean") * n
    near = near.select(*keys, value.cast("bigint").alias("potential"))
    every = F.array(*[F.struct(*[F.lit(r[x]).cast("bigint").alias(x) for x in ("node_id", *metrics)]) for r in rows]) if rows else F.expr("cast(array() as array<struct<node_id:bigint>>)")
    far = both.where("_clamped").withColumn("_node", F.explode(every)).withColumn("_at", F.col("_node.node_id"))
    own = {m: F.when(F.col("_at") == F.col("source"), less[m]).when(F.col("_at") == F.col("target"), more[m]).otherwise(F.col(f"_node.{m}")) for m in metrics}
    far = far.select(*keys, F.col("_at").alias("node_id"), *[x.alias(m) for m, x in own.items()])
    return near.unionByName(potential(score(far, policy, keys), keys))


def ordered(candidates: DataFrame) -> DataFrame:
    """Adds place: by improvement over cost falling, compared as products of whole numbers; then kind, range, source, target, key.

    The quotient to 38 digits orders all fractions of 64-bit numbers but those closer than
    that, which the remainders then order.
    """
    cost, gain = F.greatest(F.col("cost"), F.lit(1)).cast("decimal(38,0)"), F.col("improvement").cast("decimal(38,0)")
    whole = (gain - gain % cost) / cost
    part = ((gain % cost) * F.lit(10**18).cast("decimal(19,0)")).cast("decimal(38,0)")
    digits = (part - part % cost) / cost
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("_whole"), F.desc("_part"), "kind", "range_id", "source", "target", "split_key")
    return candidates.withColumns({"_whole": whole, "_part": digits}).withColumn("place", F.row_number().over(w).cast("bigint")).drop("_whole", "_part")


def select_actions(candidates: DataFrame, policy: Policy) -> DataFrame:
    """The first candidates in order of place, no range or node twice, each with the least improvement.

    Each choice rules out later ones, so there is a round for each action, of which the
    policy allows few: the first candidate that is left, by a sort that keeps one row a
    task. A node 0 is none.
    """
    left, chosen = candidates.where(F.col("improvement") >= policy.min_improvement), []
    for _ in range(policy.max_actions):
        best = left.orderBy("place").limit(1).collect()
        if not best:
            break
        chosen += best
        nodes = [x for x in (best[0]["source"], best[0]["target"]) if x]
        left = left.where(F.col("range_id") != best[0]["range_id"])
        for end in ("source", "target") if nodes else ():
            left = left.where(~F.coalesce(F.col(end).isin(nodes), F.lit(False)))
    return candidates.sparkSession.createDataFrame(chosen, candidates.schema)


def noop_reason(ranges: DataFrame, policy: Policy) -> DataFrame:
    """Why nothing is done, by fixed priority, from flags of ranges and of the cycle."""
    ready = F.col("samples") >= policy.min_samples
    flags = ranges.where("active").agg(
        F.bool_or(F.col("splitting") | F.col("migrating")).alias("a"), F.bool_or(~ready).alias("b"), F.bool_or("unsplittable").alias("c"), F.bool_or("cooled").alias("d"), F.bool_or("no_target").alias("e")
    )
    reason = F.when(F.col("a"), "OPERATION_IN_PROGRESS").when(F.col("b"), "INSUFFICIENT_SAMPLES").when(F.col("c"), "HOT_UNSPLITTABLE_KEYSPACE").when(F.col("d"), "COOLDOWN").when(F.col("e"), "NO_ELIGIBLE_TARGET").otherwise("BALANCED")
    return flags.select(reason.alias("reason"))


def leader_transfers(ranges: DataFrame, replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates that move a leader from the node with most leaders to a caught-up healthy voter with fewer, in order."""
    most = nodes.orderBy(F.desc("leaders"), "node_id").limit(1).select(F.col("node_id").alias("source"), F.col("leaders").alias("_most"))
    least = nodes.agg(F.min("leaders").alias("_least"))
    lead = most.join(least).where(F.col("_most") > F.col("_least") + 1)
    r = ranges.where("NOT splitting AND NOT migrating").join(lead, F.col("leader") == F.col("source"))
    held = replicas.where("healthy AND voter AND lag = 0").select("range_id", "replica_id", F.col("node_id").alias("target"))
    t = nodes.where("healthy AND available").select(F.col("node_id").alias("target"), F.col("leaders").alias("_own"))
    return r.join(held, "range_id").join(t, "target").where("target != source AND _own < _most").drop("_own", "_most", "_least")


def invalid_actions(plan: DataFrame, ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Actions that fresh metrics no longer allow, with the reason."""
    r = ranges.select("range_id", F.col("generation").alias("_g"), "splitting", "migrating")
    t = nodes.select(F.col("node_id").alias("target"), (F.col("healthy") & F.col("available")).alias("_ok"))
    j = plan.join(r, "range_id", "left").join(t, "target", "left")
    reason = F.when(F.col("_g").isNull(), "range is gone").when(F.col("_g") != F.col("generation"), "generation changed").when(F.col("splitting") | F.col("migrating"), "in progress").when(F.col("target").isNotNull() & ~F.coalesce("_ok", F.lit(False)), "target not available")
    return j.select("range_id", "source", "target", reason.alias("reason")).where("reason IS NOT NULL")


def action_states(events: DataFrame) -> DataFrame:
    """The last state of each action of events(action_id, seq, state, range_id, at)."""
    return events.groupBy("action_id").agg(F.max_by("state", "seq").alias("state"), F.max("at").alias("updated_at"))


def cooldowns(events: DataFrame, wait: int) -> DataFrame:
    """Until when each range cools down after its last finished action."""
    return events.where("state IN ('succeeded', 'failed')").groupBy("range_id").agg((F.max("at") + wait).alias("until"))


def reconcile(actions: DataFrame, operations: DataFrame) -> DataFrame:
    """Unfinished actions with the last operation on their range, if there is one."""
    last = operations.groupBy("range_id").agg(F.max("operation_id").alias("operation_id"))
    return actions.where("state NOT IN ('succeeded', 'failed')").join(last, "range_id", "left")
