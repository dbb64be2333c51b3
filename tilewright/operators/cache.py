"""Caches and queues as windows over an access log: what stays, what goes, what comes next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def within_ttl(entries: DataFrame, now, seconds: int) -> DataFrame:
    """Entries accessed in the last ``seconds`` before ``now`` (a Column): a plain filter, pushed to the scan."""
    return entries.where(F.col("accessed") >= F.expr(f"timestampadd(SECOND, -{seconds}, {now})"))


def within_quota(entries: DataFrame, quota: int, *space: str) -> DataFrame:
    """Of each cache the newest entries whose sizes add up to ``quota`` at most; equal times go by path."""
    newest = W.partitionBy(*space).orderBy(F.desc("accessed"), F.desc("path")).rowsBetween(W.unboundedPreceding, 0)
    return entries.withColumn("held", F.sum("size").over(newest)).where(F.col("held") <= quota).drop("held")


def evicted(entries: DataFrame, limit: int, *space: str) -> DataFrame:
    """What one trim of a memory cache drops: least recently used first, until what is left costs ``limit`` at most. Protected entries and the newest stay."""
    newest = F.row_number().over(W.partitionBy(*space).orderBy(F.desc("tick"))) == 1
    marked = entries.withColumn("free", ~newest & ~F.col("protected"))
    total = F.sum("cost").over(W.partitionBy(*space))
    before = F.coalesce(F.sum(F.when(F.col("free"), F.col("cost"))).over(W.partitionBy(*space).orderBy("tick").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("left", total - before).where(F.col("free") & (F.col("left") > limit)).drop("free", "left")


def next_in_queue(queue: DataFrame, *space: str) -> DataFrame:
    """Of each queue the entry of the best current priority; unknown ones last, the first of equals: one aggregate."""
    order = F.struct(F.coalesce("priority", F.lit(2**31 - 1)).alias("p"), F.col("position").alias("at"))
    return queue.groupBy(*space).agg(F.min_by("item", order).alias("item"))


def last_of(queue: DataFrame, capacity: int, *space: str) -> DataFrame:
    """What a ring of ``capacity`` still holds: the last entries of each."""
    return queue.withColumn("back", F.row_number().over(W.partitionBy(*space).orderBy(F.desc("position")))).where(F.col("back") <= capacity).drop("back")


def first_of_each(rows: DataFrame, *key: str) -> DataFrame:
    """Each key once, at the place where it first came."""
    return rows.groupBy(*key).agg(F.min("position").alias("position"))
