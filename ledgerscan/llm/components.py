"""Connected components of an edge table, in Spark joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscan.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, comp`` of every node of ``edges`` (``u, v`` long): ``comp`` is the smallest node reachable.

    Every round takes the smallest label among the neighbours, then the label of that label, so the
    number of rounds grows with the logarithm of the longest path. Labels are written each round.
    """
    both = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.select(F.inline(both))  # not a union, which would make the edges twice
    both = written(both.filter("u is not null and v is not null").distinct())
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("comp")))
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("comp").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("u")).select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        lower = written(lower)
        if lower.filter("comp <> old").isEmpty():
            return lower.select("node", "comp")
        jump = lower.select(F.col("node").alias("at"), F.col("comp").alias("next"))
        labels = written(lower.join(jump, F.col("comp") == F.col("at")).select("node", F.col("next").alias("comp")))
