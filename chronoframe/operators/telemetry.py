"""Counters, rates, smoothed rates and rollups by range and node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.scalars import U64, mul_div, wide

SCALE = 1_000_000


def logical_size(versions: DataFrame, by: list[str], key: str = "k") -> DataFrame:
    """Live keys and bytes, and bytes of all versions, of versions(by..., k, ts, kind, value as a number of 8 bytes).

    Here only values and deletions count, so that an abort or an intent does not hide what
    is older: not the rule of as-of reads.
    """
    size = F.length(key) + F.when(F.col("value").isNull(), 0).otherwise(8)
    rank = F.row_number().over(Window.partitionBy(*by, key).orderBy(F.desc("ts"), "kind"))
    plain = versions.where("kind < 2").withColumn("_r", rank).where("_r = 1 AND kind = 1")
    live = plain.groupBy(*by).agg(F.count(F.lit(1)).alias("key_count"), F.sum(size).cast("bigint").alias("logical_bytes"))
    history = versions.groupBy(*by).agg(F.sum(size + 9).cast("bigint").alias("historical_bytes"))
    out = history.join(live, by, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("key_count", "logical_bytes")})


def rates(samples: DataFrame, by: list[str], counters: list[str], time: str = "at_us", arrival: str | None = None) -> DataFrame:
    """Adds island, samples and a rate by second for each counter.

    A sample starts a new island, with rates 0, if it is the first, its time lies before
    the last one's, or any counter fell. A sample at the time of the last one kept is
    left out: of equal times only the first counts, and all others follow it.
    """
    order = arrival or time
    w = Window.partitionBy(*by).orderBy(order)
    kept = samples.withColumn("_same", F.lag(time).over(w) == F.col(time)).where("NOT coalesce(_same, false)").drop("_same")
    prior = {f"_{c}": F.lag(c).over(w) for c in counters} | {"_time": F.lag(time).over(w)}
    df = kept.withColumns(prior)
    reset = F.col("_time").isNull() | (F.col(time) < F.col("_time"))
    for c in counters:
        reset = reset | (F.col(c) < F.col(f"_{c}"))
    df = df.withColumn("_reset", reset).withColumn("island", F.sum(F.col("_reset").cast("int")).over(w))
    step = F.col(time) - F.col("_time")
    speed = {f"{c}_rate": F.when(F.col("_reset"), F.lit(0).cast("bigint")).otherwise(F.least(mul_div(F.col(c) - F.col(f"_{c}"), SCALE, step), wide(U64)).cast("bigint")) for c in counters}
    within = Window.partitionBy(*by, "island").orderBy(order)
    df = df.withColumns(speed | {"samples": F.row_number().over(within).cast("bigint") - 1})
    return df.drop("_reset", *prior)


def smoothed(rated: DataFrame, by: list[str], rate: str, alpha: int, time: str = "at_us") -> DataFrame:
    """The last smoothed rate of each island: the first rate as it is, then two products, each cut to a whole number.

    The rates of one island are folded in order; islands end at every reset.
    """
    rows = rated.where("samples > 0").groupBy(*by, "island").agg(F.array_sort(F.collect_list(F.struct(time, F.col(rate).alias("r")))).alias("s"))
    part = lambda x, m: ((x * m) - (x * m) % SCALE) / SCALE
    fold = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.element_at("s", 1)["r"], lambda acc, x: (part(x["r"], F.lit(alpha)) + part(acc, F.lit(SCALE - alpha))).cast("bigint"))
    return rows.select(*by, "island", F.size("s").cast("bigint").alias("samples"), fold.alias("smoothed"))


def roll_ranges(replicas: DataFrame) -> DataFrame:
    """Ranges of replica metrics: sizes from the largest replica, reads and requests added up, writes and progress from the leader."""
    lead = lambda c: F.max(F.when(F.col("is_leader"), F.col(c)))
    return replicas.groupBy("range_id").agg(
        F.max("logical_bytes").alias("logical_bytes"), F.max_by("key_count", F.struct("logical_bytes", -F.col("replica_id"))).alias("key_count"), F.max("physical_bytes").alias("physical_bytes"),
        F.sum("read_rate").alias("read_rate"), F.sum("request_rate").alias("request_rate"), lead("write_rate").alias("write_rate"), lead("commit_index").alias("commit_index"), lead("applied_index").alias("applied_index"),
        F.max("samples").alias("samples"), F.greatest(lead("commit_index") - lead("applied_index"), F.lit(0)).alias("apply_backlog"),
    )


def roll_nodes(replicas: DataFrame) -> DataFrame:
    """Nodes of replica metrics: sums over active voters, leaders over all, unhealthy if any replica is."""
    counts = F.col("voter") & F.col("active")
    part = lambda c: F.coalesce(F.sum(F.when(counts, F.col(c))), F.lit(0))
    return replicas.groupBy("node_id").agg(
        F.count_if(counts).alias("hosted_replicas"), F.count_if("is_leader").alias("leaders"), part("logical_bytes").alias("logical_bytes"), part("read_rate").alias("read_rate"),
        part("write_rate").alias("write_rate"), F.bool_and("healthy").alias("healthy"),
    )


def in_flight(migrations: DataFrame) -> DataFrame:
    """Active migrations out of and into each node of migrations(source, target, active, load)."""
    sides = F.array(F.struct(F.col("source").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("l")), F.struct(F.col("target").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.col("load").cast("bigint").alias("l")))
    rows = migrations.where("active").select(F.explode(sides).alias("s")).select("s.*")
    return rows.groupBy("node_id").agg(F.sum("o").alias("migrations_out"), F.sum("i").alias("migrations_in"), F.sum("l").alias("incoming_load"))


def warming(observations: DataFrame, least: int) -> DataFrame:
    """Whether nodes of observations(node_id, at, available) still warm up: seen unavailable, and fewer than so many in a row since."""
    last_bad = observations.where("NOT available").groupBy("node_id").agg(F.max("at").alias("_bad"))
    joined = observations.join(last_bad, "node_id", "left")
    since = F.count_if(F.col("available") & (F.col("at") > F.col("_bad")))
    return joined.groupBy("node_id").agg((F.max("_bad").isNotNull() & (since < least)).alias("warming"), F.coalesce(since, F.lit(0)).alias("streak"))


def repeated_ids(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
