"""Keyed state over streams. Each gives the same rows as its batch form in ``operators.lifecycle``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GLOBAL = {"missing_authorization_token", "unauthorized", "forbidden"}


def wait_after(outcome: str, failures: int, retry_after: float | None) -> float:
    """Seconds to wait after the nth failure in a row."""
    given = 0.0 if retry_after is None or retry_after != retry_after else retry_after
    if outcome == "rate_limited":
        return max(given, 5.0)
    fixed = {"parse_failed": 120.0, "not_found": 600.0, "gone": 600.0, "client": 60.0, **dict.fromkeys(GLOBAL, 30.0)}
    return fixed.get(outcome, min(0.5 * 2.0 ** min(failures - 1, 6), 30.0))


def retries(events: DataFrame) -> DataFrame:
    """Events (tile, ts, seq, outcome, retry_after) with the failures in a row, and the wait; state is one number a tile."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        counts, waits = [], []
        for outcome, given in zip(rows.outcome, rows.retry_after, strict=True):
            failures = 0 if outcome == "success" else failures + 1
            counts.append(failures)
            waits.append(None if outcome == "success" else wait_after(outcome, failures, given))
        state.update((failures,))
        yield pd.DataFrame({"tile": key[0], "seq": rows.seq.to_numpy(), "failures": counts, "wait": waits})

    return events.groupBy("tile").applyInPandasWithState(run, "tile bigint, seq bigint, failures int, wait double", "failures int", "append", GroupStateTimeout.NoTimeout)


def holds(events: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """(key, start, last, n): sightings whose gaps are ``seconds`` at most, once the watermark has passed them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = timed.groupBy("key", F.session_window("ts", f"{seconds} seconds").alias("w"))
    return by.agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")).select("key", "start", "last", "n")


def fades(seen: DataFrame, fade_in: float = 0.15, fade_out: float = 0.25) -> DataFrame:
    """Sightings (key, at, visible) with the opacity that the key has reached; a key that has faded out is forgotten."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alpha, target, last = state.get if state.exists else (0.0, 0.0, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("at").itertuples():
            if last is not None:
                dt = max(0.0, r.at - last)
                alpha = min(target, alpha + dt / fade_in) if target > alpha else max(target, alpha - dt / fade_out)
            target, last = (1.0 if r.visible else 0.0), r.at
            out.append((key[0], r.at, alpha))
        if alpha <= 1e-4 and target == 0.0:
            state.remove()
        else:
            state.update((alpha, target, last))
        yield pd.DataFrame(out, columns=["key", "at", "alpha"])

    return seen.groupBy("key").applyInPandasWithState(run, "key bigint, at double, alpha double", "alpha double, target double, last double", "append", GroupStateTimeout.NoTimeout)


def notices(events: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Events (kind, at) of which each kind passes once in ``seconds``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at in pd.concat(list(batches)).sort_values("at")["at"]:
            if last is None or at - last >= seconds:
                out.append((key[0], at))
                last = at
        state.update((last,))
        yield pd.DataFrame(out, columns=["kind", "at"])

    return events.groupBy("kind").applyInPandasWithState(run, "kind string, at double", "last double", "append", GroupStateTimeout.NoTimeout)


def upsert(changes: DataFrame, path: str, checkpoint: str):
    """Keep the newest version of each marker (id, version, removed, ...) at ``path``: each batch is merged into a new version of the table, so a batch that comes again changes nothing."""
    spark = changes.sparkSession

    def merge(batch: DataFrame, epoch: int) -> None:
        old = spark.read.schema(batch.schema).parquet(f"{path}/v{epoch}") if epoch else batch.limit(0)
        newest = old.unionByName(batch).groupBy("id").agg(F.max_by(F.struct(*batch.columns), "version").alias("r"))
        newest.select("r.*").where("NOT removed").write.mode("overwrite").parquet(f"{path}/v{epoch + 1}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
