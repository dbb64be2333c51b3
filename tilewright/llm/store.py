"""Reading tables and cutting lineage in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to Python; long documents make it fewer rows.
BATCH_BYTES = 8 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, by a path that only Spark needs to be able to open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once by bytes: a batch is never many huge texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset the warehouse, which a cluster shares, or in local mode a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        local = context.master.startswith("local")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tilewright-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tilewright-checkpoints")
        named = context.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tilewright/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later stages, and
    retries after a lost executor, start from these files instead of the whole lineage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes in a column: a sum that is combined on the map side."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def deal(spark: SparkSession, total_bytes: int, each: int) -> int:
    """Partitions so that each holds about ``each`` bytes, at least as many as the session deals."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-total_bytes // each))
