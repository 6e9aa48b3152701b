"""Ordered logs as sources: a range of entries, and the longest valid prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotApplied(RuntimeError):
    """Entries were asked for that have not been applied."""


def entries(log: DataFrame, first: int, last: int) -> DataFrame:
    """Entries first..last; it is an error if the log ends before."""
    applied = log.agg(F.max("idx")).first()[0]
    if applied is None or last > applied:
        raise NotApplied(f"entry {last} lies after the last one, {applied}")
    return log.where(F.col("idx").between(first, last))


def valid_prefix(log: DataFrame) -> DataFrame:
    """Entries of log(idx, valid, ...) before the first invalid one; what follows is a torn tail."""
    torn = log.where("NOT valid").agg(F.min("idx").alias("_torn"))
    return log.join(F.broadcast(torn)).where(F.col("_torn").isNull() | (F.col("idx") < F.col("_torn"))).drop("_torn")


def corrupt(log: DataFrame) -> DataFrame:
    """Valid entries that follow an invalid one: damage within the log rather than a torn tail."""
    torn = log.where("NOT valid").agg(F.min("idx").alias("_torn"))
    return log.join(F.broadcast(torn)).where("valid AND idx > _torn").drop("_torn")
