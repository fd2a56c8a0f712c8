"""Exact deduplication by 128-bit content hash, with bytes compared inside groups.

One narrow pass turns each row into (id, row number, MD5, SHA-256). Groups of one
hash are aggregated with map-side combine, so a group that holds a third of all rows
costs one row per task. Only texts of groups with two or more rows are read again:
the least and the greatest text of a group are equal exactly when all its texts are.
Rows of a hash for which they differ (a collision) are regrouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import broadcast_if_small, columns_of, join_groups, materialize, numbered_rows, quoted

#: Duplicate groups are broadcast up to this many (16-byte hashes); beyond it the join shuffles.
BROADCAST_GROUPS = 500_000


def _labelled(joined: DataFrame) -> DataFrame:
    return joined.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. ``keep`` is "max" or "min": which id of equal texts stays.
    Rows that repeat both id and text are told apart by their position, and one of them
    stays. A null id is the least one. Empty input gives an empty result. Other columns of
    ``docs`` are ignored, whatever their names. ``digest`` gives hex text of any hash;
    a weak one only makes more groups go the byte-comparing way.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    source = docs.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("text"))
    order = {"max": F.max, "min": F.min}[keep](F.struct("doc_id", "rid")).alias("keep")
    size = F.count("*").alias("group_size")
    narrow = materialize(
        source.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.unhex(digest(F.col("text"))).alias("h"), F.unhex(F.sha2("text", 256)).alias("sha")),
        "exact-hashes",
    )
    groups = materialize(narrow.groupBy("h").agg(size, order), "exact-groups")
    repeated = materialize(groups.where("group_size > 1").select("h"), "exact-repeated")
    read_again = source.select("doc_id", "text", F.unhex(digest(F.col("text"))).alias("h"))
    within = read_again.join(broadcast_if_small(repeated, BROADCAST_GROUPS), "h", "left_semi")
    collided = materialize(
        within.groupBy("h").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least <> most").select("h"),
        "exact-collided",
    )
    if collided.isEmpty():
        return _labelled(join_groups(narrow, groups, "h", "group_size"))
    clear = narrow.join(collided, "h", "left_anti")
    mixed = materialize(
        read_again.join(collided, "h", "left_semi").select("doc_id", F.monotonically_increasing_id().alias("rid"), "h", "text", F.unhex(F.sha2("text", 256)).alias("sha")),
        "exact-mixed",
    )
    regrouped = mixed.join(mixed.groupBy("h", "text").agg(size, order), ["h", "text"])
    return _labelled(join_groups(clear, groups, "h", "group_size")).unionByName(_labelled(regrouped))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, all columns kept.

    Where ids repeat or are null, rows are told apart by their place in the table: a null id is the least one, and of rows
    of one id the last stays for "max", the first for "min". Empty input gives an empty result.
    """
    held, own = numbered_rows(docs, id_col, "exact-rows")
    rows = held.select("rid", F.col(f"row.{quoted(text_col)}").alias("text"), F.col(f"row.{quoted(id_col)}").alias("id"))
    if own:
        staying = exact_dedup(rows, "rid", "text", keep).where("kept").select(F.col("doc_id").alias("rid"))
    else:
        found = exact_dedup(rows, "rid", "text", keep).select(F.col("doc_id").alias("rid"), "keep_id")
        order = {"max": F.max, "min": F.min}[keep](F.struct("id", "rid")).alias("best")
        staying = found.join(rows.select("rid", "id"), "rid").groupBy("keep_id").agg(order).select(F.col("best.rid").alias("rid"))
    return held.join(staying, "rid", "left_semi").select(*columns_of("row", docs.columns))
