"""Small-step connected components for groups that share something."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize


def roots(links: DataFrame) -> DataFrame:
    """(node, root) from links (a, b): labels fall to the least one in reach, with shortcuts, until none changes.

    Each round is written to the shared folder.
    """
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "group-links")
    now = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "group-roots")
    while True:
        near = both.join(now, both["b"] == now["node"]).groupBy("a").agg(F.min("root").alias("_m"))
        step = now.join(near, now["node"] == near["a"], "left").select("node", F.least("root", F.coalesce("_m", "root")).alias("root"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        then = materialize(step.join(up, "root", "left").select("node", F.least("root", F.coalesce("_up", "root")).alias("root"), F.col("root").alias("_was")).select("node", "root"), "group-roots")
        if then.join(now.withColumnRenamed("root", "_old"), "node").where("root <> _old").isEmpty():
            return then
        now = then
