"""Connected components of links between rows, by alternating large-star and small-star steps.

Each step only takes minima of neighbours (aggregated map-side, then joined back; that join is Spark's own to split
where a node has very many links). The links of each round are written to the shared
folder, which cuts the lineage; rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import broadcast_if_small, columns_of, discard, materialize, numbered_rows

#: Ids of rows that go are broadcast up to this many; beyond it the join shuffles.
GOING_BROADCAST = 1_000_000


def _large_star(links: DataFrame) -> DataFrame:
    """Each neighbour above u is linked to the least of u and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u and its neighbours below it are linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    rest = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """From links (a, b) of one ordered type to rows (node, root): root is the least node reachable.

    Nodes without a link aren't listed. Loops and repeated links do no harm, nulls are left out.
    """
    spark = links.sparkSession
    now = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    state = None
    for _ in range(rounds):
        then = materialize(_small_star(_large_star(now)), "links")
        found = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_if(F.col("a") < F.col("b"))).first()
        discard(spark, now)
        now = then
        if found == state:
            break
        state = found
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def keep_least(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their group, all columns kept: one row of each group.

    grouped: from rows of doc_id (unique, not null) and text to doc_id and component_id, the group's least doc_id. Where ids of ``docs``
    repeat or are null, rows stand for themselves: a null id is the greatest, and of equal ids the first row is the least.
    """
    held, own = numbered_rows(docs, "doc_id", "near-rows")
    found = materialize(grouped(held.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("doc_id").alias("rid"), F.col("component_id").alias("component")), "near-groups")
    if own:
        going = found.where("rid <> component")
    else:
        order = F.struct(F.col("id").isNull(), "id", "rid")
        named = found.join(held.select("rid", F.col("row.doc_id").alias("id")), "rid")
        least = named.groupBy("component").agg(F.min(order).alias("least"))
        staying = least.select(F.col("least.rid").alias("rid"))
        going = found.join(staying, "rid", "left_anti")
    going = materialize(going.select("rid"), "near-duplicates")
    return held.join(broadcast_if_small(going, GOING_BROADCAST), "rid", "left_anti").select(*columns_of("row", docs.columns))
