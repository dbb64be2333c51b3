"""Where queries and their SQL are registered, and the tables that queries derive their inputs from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with SQL for DuckDB if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointing(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the session names; where none is, to the warehouse, which a cluster shares, or in local mode to a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and context.master.startswith("local"):
        import tempfile

        named = tempfile.mkdtemp(prefix="tilewright-")
    context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tilewright-checkpoints")


def lon_of(k: str):
    return F.expr(f"(({k} * 137) % 360) - 180 + (({k} * 31) % 100) / CAST(100 AS DOUBLE)")


def lat_of(k: str):
    return F.expr(f"(({k} * 53) % 160) - 80 + (({k} * 17) % 100) / CAST(100 AS DOUBLE)")


#: The same coordinates in DuckDB: points (id, lat, lon, weight, nation).
POINTS = """points AS (SELECT c_custkey AS id, ((c_custkey * 53) % 160) - 80 + ((c_custkey * 17) % 100) / CAST(100 AS DOUBLE) AS lat,
  ((c_custkey * 137) % 360) - 180 + ((c_custkey * 31) % 100) / CAST(100 AS DOUBLE) AS lon, c_acctbal AS weight, c_nationkey AS nation FROM customer)"""
#: Normalized world coordinates (x, y) of points, by another formula than the library's.
WORLD = POINTS + """, world AS (SELECT *, (lon + 180) / 360 AS x, (1 - asinh(tan(radians(lat))) / pi()) / 2 AS y FROM points)"""


def tile_sql(z: int) -> str:
    """SQL of tx, ty at a zoom over ``world``."""
    n = 1 << z
    return f"CAST(least(greatest(floor(x * {n}), 0), {n - 1}) AS BIGINT) AS tx, CAST(least(greatest(floor(y * {n}), 0), {n - 1}) AS BIGINT) AS ty"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, lat, lon, weight, nation): a marker for each customer."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), lat_of("c_custkey").alias("lat"), lon_of("c_custkey").alias("lon"), F.col("c_acctbal").alias("weight"), F.col("c_nationkey").alias("nation"))
