"""Keyed state over an event log, as batches: retries, retention and fades. The streaming forms give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.functions import geo


def retries(events: DataFrame) -> DataFrame:
    """Events (tile, ts, seq, outcome, retry_after) with the failures in a row up to each, and when the tile may be tried again."""
    by = W.partitionBy("tile").orderBy("ts", "seq")
    run = events.withColumn("run", F.sum(F.when(F.col("outcome") == "success", 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    nth = F.sum(F.when(F.col("outcome") == "success", 0).otherwise(1)).over(W.partitionBy("tile", "run").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0))
    counted = run.withColumn("failures", nth.cast("int")).drop("run")
    wait = geo.backoff(F.col("outcome"), F.col("failures") - 1, F.col("retry_after"))
    return counted.withColumn("wait", wait)


def blocked_until(events: DataFrame) -> DataFrame:
    """The time up to which all fetches wait: the latest end of a global cooldown. One small aggregate."""
    cool = geo.global_cooldown(F.col("outcome"), F.col("retry_after"))
    return events.select((F.col("ts").cast("timestamp").cast("double") + cool).alias("until")).agg(F.max("until").alias("until"))


def holds(events: DataFrame, seconds: float) -> DataFrame:
    """(key, start, last, n): runs of sightings of a key whose gaps are ``seconds`` at most."""
    by = W.partitionBy("key").orderBy("ts")
    at = F.col("ts").cast("timestamp").cast("double")
    new = F.when(at - F.lag(at).over(by) <= seconds, 0).otherwise(1)
    numbered = events.withColumn("run", F.sum(new).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("key", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) between two snapshots (id, value): added, removed, changed or same. A full outer join."""
    b, a = before.select("id", F.col("value").alias("old"), F.lit(True).alias("was")), after.select("id", F.col("value").alias("new"), F.lit(True).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return b.join(a, "id", "full").select("id", change.alias("change"))
