"""Connected components of an edge table by least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.store import written


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id that each end of an edge (a, b) is connected with.

    Each round, a node takes the least label among its own and its neighbours', combined
    on the map side, and then its label's label. Rounds are about the logarithm of the
    longest path, and each is written, so that none is done again.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        nearer = labels.join(seen, "id").select("id", "label", F.least("label", "near").alias("next"))
        onward = nearer.join(labels.select(F.col("id").alias("next"), F.col("label").alias("beyond")), "next", "left")
        new = written(onward.select("id", F.least("next", "beyond").alias("label"), (F.least("next", "beyond") != F.col("label")).alias("moved")), "labels")
        labels = new.select("id", "label")
        if new.where("moved").isEmpty():
            return labels
