"""Ranges that tile the keys: routing, validation, splits and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most ranges of a catalog, which bounds what a route has to know; and the deepest lineage.
MAX_RANGES, MAX_DEPTH = 4096, 128


def route(keys: DataFrame, catalog: DataFrame, key: str = "k") -> DataFrame:
    """Adds range_id and generation of the range that holds each key; keys in no range are left out.

    A catalog has at most 4,096 ranges, so its sorted bounds are a literal array: a key's
    place among them is found within the scan by halving, without a join or shuffle.
    """
    rows = catalog.select("range_id", "generation", "start_key", "end_key").orderBy(F.col("start_key").asc_nulls_first()).limit(MAX_RANGES + 1).collect()
    if len(rows) > MAX_RANGES:
        raise ValueError("a catalog has at most 4096 ranges")
    if not rows:
        return keys.withColumns({"range_id": F.lit(None).cast("bigint"), "generation": F.lit(None).cast("bigint")}).where("false")
    starts = F.array(*[F.lit(r["start_key"] or "") for r in rows])
    entry = F.array(*[F.struct(F.lit(r["range_id"]).alias("range_id"), F.lit(r["generation"]).alias("generation"), F.lit(r["end_key"]).cast("string").alias("end_key"), F.lit(r["start_key"]).cast("string").alias("start_key")) for r in rows])
    place = _halved(starts, len(rows), F.col(key))
    found = keys.withColumn("_at", F.try_element_at(entry, F.nullif(place, F.lit(0))))
    inside = (F.col("_at.end_key").isNull() | (F.col(key) < F.col("_at.end_key"))) & F.col("_at.range_id").isNotNull()
    return found.where(inside).withColumns({"range_id": F.col("_at.range_id"), "generation": F.col("_at.generation")}).drop("_at")


def _halved(starts: Column, n: int, key: Column) -> Column:
    """How many of n sorted starts are not after the key: each step halves where that may be."""
    zero = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step(acc, _):
        at = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        before = F.try_element_at(starts, at + 1) <= key
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & before, at + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~before, at).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), zero, step, lambda acc: acc["lo"])


def intersect(catalog: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Parts of a span within each range: range_id, lo, hi; null is open."""
    lo = F.greatest(F.col("start_key"), F.lit(start).cast("string"))
    hi = F.least(F.col("end_key"), F.lit(end).cast("string"))
    return catalog.select("range_id", lo.alias("lo"), hi.alias("hi")).where("lo IS NULL OR hi IS NULL OR lo < hi")


def contains(key: Column) -> Column:
    return (F.col("start_key").isNull() | (F.col("start_key") <= key)) & (F.col("end_key").isNull() | (key < F.col("end_key")))


def contains_span(start: str | None, end: str | None) -> Column:
    low = F.col("start_key").isNull() if start is None else F.col("start_key").isNull() | (F.col("start_key") <= start)
    high = F.col("end_key").isNull() if end is None else F.col("end_key").isNull() | (F.col("end_key") >= end)
    return low & high


def tiling_faults(catalog: DataFrame, partial: bool = False) -> DataFrame:
    """range_id and fault: gap or overlap to the range before, or an open side that is not covered."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("start_key").asc_nulls_first())
    df = catalog.withColumns({"prior": F.lag("end_key").over(w), "place": F.row_number().over(w), "next": F.lead("range_id").over(w)})
    first, last = F.col("place") == 1, F.col("next").isNull()
    fault = (
        F.when(~first & (F.col("prior").isNull() | F.col("start_key").isNull() | (F.col("prior") > F.col("start_key"))), "overlap")
        .when(~first & (F.col("prior") < F.col("start_key")), "gap")
        .when(F.lit(not partial) & ((first & F.col("start_key").isNotNull()) | (last & F.col("end_key").isNotNull())), "not covered")
    )
    return df.select("range_id", fault.alias("fault")).where("fault IS NOT NULL")


def descriptor_faults(ranges: DataFrame) -> DataFrame:
    """Faults of ranges(range_id, generation, start_key, end_key, replicas array<struct<replica_id, node_id>>)."""
    ids, nodes = F.transform("replicas", lambda r: r["replica_id"]), F.transform("replicas", lambda r: r["node_id"])
    checks = {
        "zero id": (F.col("range_id") == 0) | (F.col("generation") == 0) | F.array_contains(ids, 0) | F.array_contains(nodes, 0),
        "empty interval": F.col("start_key") >= F.col("end_key"),
        "repeated replica": F.size(F.array_distinct(ids)) < F.size(ids),
        "repeated node": F.size(F.array_distinct(nodes)) < F.size(nodes),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return ranges.select("range_id", F.explode(found).alias("fault"))


def on_node(ranges: DataFrame, node: int) -> DataFrame:
    return ranges.where(F.exists("replicas", lambda r: r["node_id"] == node))


def fingerprint(catalog: DataFrame) -> DataFrame:
    """SHA-256 of the ranges in order of their ids; a catalog is small by its limit of ranges."""
    say = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(c)))
    line = F.concat_ws("/", F.col("range_id").cast("string"), F.col("generation").cast("string"), say("start_key"), say("end_key"))
    rows = F.array_sort(F.collect_list(F.struct("range_id", line.alias("line"))))
    return catalog.agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["line"]), ";").cast("binary"), 256).alias("fingerprint"))


def split(catalog: DataFrame, parent: int, at: str) -> DataFrame:
    """The catalog with a range replaced by two children of generation 1 and fresh ids; the key must lie strictly inside."""
    ids = catalog.agg(F.max("range_id")).first()[0]
    own = catalog.where(F.col("range_id") == parent)
    if own.where((F.col("start_key").isNull() | (F.col("start_key") < at)) & (F.col("end_key").isNull() | (F.lit(at) < F.col("end_key")))).isEmpty():
        raise ValueError("the split key does not lie strictly inside the range")
    left = F.struct(F.lit(ids + 1).alias("range_id"), F.lit(1).cast("bigint").alias("generation"), F.col("start_key"), F.lit(at).alias("end_key"))
    right = F.struct(F.lit(ids + 2).alias("range_id"), F.lit(1).cast("bigint").alias("generation"), F.lit(at).alias("start_key"), F.col("end_key"))
    children = own.select(F.explode(F.array(left, right)).alias("c")).select("c.range_id", "c.generation", "c.start_key", "c.end_key")
    return catalog.where(F.col("range_id") != parent).select("range_id", "generation", "start_key", "end_key").unionByName(children)


def descendants(lineage: DataFrame, root: int) -> DataFrame:
    """range_id and depth of everything below a range; live: without children. Too deep a chain, or a cycle, is an error."""
    spark = lineage.sparkSession
    found = spark.sql(
        f"""WITH RECURSIVE below(range_id, depth) MAX RECURSION LEVEL {MAX_DEPTH} AS (
            SELECT cast({root} AS bigint), 0 UNION ALL SELECT l.child_id, b.depth + 1 FROM below b JOIN {{lineage}} l ON l.parent_id = b.range_id)
            SELECT range_id, depth FROM below""",
        lineage=lineage,
    )
    parents = lineage.select(F.col("parent_id").alias("range_id"), F.lit(True).alias("_p")).distinct()
    return found.join(parents, "range_id", "left").select("range_id", "depth", F.col("_p").isNull().alias("live"))


def split_proof(parent: DataFrame, children: DataFrame) -> DataFrame:
    """Versions that are in the parent and not in its children, or the other way round; equal multisets give no rows."""
    cols = ["k", "ts", "kind", "value"]
    a, b = parent.where("kind != 3").select(cols), children.where("kind != 3").select(cols)
    counted = a.withColumn("d", F.lit(1)).unionByName(b.withColumn("d", F.lit(-1)))
    return counted.groupBy(cols).agg(F.sum("d").alias("surplus")).where("surplus != 0")


def image(versions: DataFrame, barrier: int) -> DataFrame:
    """What a child starts from: versions up to the barrier, without intents."""
    return versions.where((F.col("ts") <= barrier) & (F.col("kind") != 3))


def replay_delta(log: DataFrame, catalog: DataFrame, after: int) -> DataFrame:
    """Puts and deletes after an index, with the child that each goes to; no-ops only advance."""
    return route(log.where((F.col("idx") > after) & (F.col("entry_type") == 0) & F.col("command_type").isin(1, 2)), catalog)


def stale(routes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Routes whose generation is not the catalog's, or whose range is gone."""
    return with_stale(routes, catalog).where("stale").drop("stale")


def with_stale(routes: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds whether a route is stale. A catalog has at most 4,096 ranges and is broadcast: by a shuffle all routes would meet in a task for each range."""
    now = catalog.select("range_id", F.col("generation").alias("_now"))
    return routes.join(F.broadcast(now), "range_id", "left").withColumn("stale", F.expr("_now IS NULL OR generation != _now")).drop("_now")


def recovery_roles(splits: DataFrame) -> DataFrame:
    """Children of open splits are shadows, parents of committed ones are retired."""
    children = splits.where("state NOT IN ('committed', 'aborted')").select(F.explode(F.array("left_id", "right_id")).alias("range_id"), F.lit("shadow").alias("role"))
    return children.unionByName(splits.where("state = 'committed'").select(F.col("parent_id").alias("range_id"), F.lit("retired").alias("role")))


def illegal_steps(history: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Steps of history(id, seq, state) from one state to the next that are not allowed."""
    w = Window.partitionBy("id").orderBy("seq")
    steps = history.select("id", "seq", F.lag("state").over(w).alias("prior"), "state").where("prior IS NOT NULL")
    pair = F.concat_ws(">", "prior", "state")
    return steps.where(~pair.isin([f"{a}>{b}" for a, b in allowed]))


def exclusive_faults(operations: DataFrame) -> DataFrame:
    """Ranges with more than one active operation; equal retries count once."""
    active = operations.where("active").select("range_id", "operation_id").distinct()
    return active.groupBy("range_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def placement(migrations: DataFrame, catalog: DataFrame, voters: DataFrame) -> DataFrame:
    """Each migration with its range's bounds, its voters and learners, and the leader's match index."""
    v = voters.groupBy("range_id").agg(F.count_if("voter").alias("voters"), F.count_if(~F.col("voter")).alias("learners"), F.max(F.when(F.col("leader"), F.col("match_index"))).alias("leader_match"))
    return migrations.join(catalog.select("range_id", "generation", "start_key", "end_key"), "range_id", "left").join(v, "range_id", "left")
